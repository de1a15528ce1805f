"""JDBC sources.

The refresh jobs read the source database through partitioned JDBC scans:
the id range [lower, upper] is cut into ``num_partitions`` strides, one
query per task.  The bounds only place the cuts - rows outside them still
land in the first or last partition - so they come from
``source_bounds`` (min and max of the id) rather than a row count.  Filters
and projections written on the returned DataFrame are pushed into the
source query by Spark.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def jdbc_options(url: str, dbtable: str, driver: str | None = None, **extra) -> dict[str, str]:
    opts = {"url": url, "dbtable": dbtable}
    if driver:
        opts["driver"] = driver
    opts.update({k: str(v) for k, v in extra.items()})
    return opts


def jdbc_scan(spark: SparkSession, url: str, dbtable: str, driver: str | None = None,
              **extra) -> DataFrame:
    """Single-query JDBC read of a table or a ``(subquery) alias``."""
    return spark.read.format("jdbc").options(**jdbc_options(url, dbtable, driver, **extra)).load()


def source_bounds(spark: SparkSession, url: str, dbtable: str, column: str,
                  driver: str | None = None) -> tuple[int, int] | None:
    """(min, max) of ``column`` in the source, computed by the database."""
    q = f"(select min({column}) as lo, max({column}) as hi from {dbtable}) bounds"
    row = jdbc_scan(spark, url, q, driver).collect()[0]
    if row["lo"] is None:
        return None
    return int(row["lo"]), int(row["hi"])


def partitioned_jdbc_options(url: str, dbtable: str, column: str, lower: int, upper: int,
                             num_partitions: int, driver: str | None = None,
                             fetch_size: int = 10_000) -> dict[str, str]:
    if num_partitions < 1:
        raise ValueError("num_partitions must be >= 1")
    if upper < lower:
        raise ValueError("upper bound below lower bound")
    return jdbc_options(url, dbtable, driver, partitionColumn=column, lowerBound=lower,
                        upperBound=max(upper, lower + 1), numPartitions=num_partitions,
                        fetchsize=fetch_size)


def partitioned_jdbc_scan(spark: SparkSession, url: str, dbtable: str, column: str,
                          num_partitions: int, driver: str | None = None,
                          bounds: tuple[int, int] | None = None) -> DataFrame:
    """Parallel JDBC read with stride partitions on a numeric ``column``;
    bounds default to the source's own min and max."""
    if bounds is None:
        bounds = source_bounds(spark, url, dbtable, column, driver) or (0, 0)
    opts = partitioned_jdbc_options(url, dbtable, column, bounds[0], bounds[1], num_partitions, driver)
    return spark.read.format("jdbc").options(**opts).load()
