"""N-way cogroup of keyed tables: sizes, values, first-or-default and per-group
functions.

A cogroup gives, for every key present in any input, the values of each
input under that key (an empty group where an input lacks the key).  Here
it stays a relation: every input row tagged with its side, its value in that
side's own column with that side's own type.  Sizes and first-or-default are
aggregates over (key, side), and values are delivered by position, so no
per-key list is built and a key holding a third of all rows is spread over
many tasks.  Functions of a whole group get it as a stream, in bounded memory.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator, Sequence
from functools import reduce
from itertools import groupby

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import DoubleType, FloatType, StructType

from amity.functions.numbers import round_half_up
from amity.plans.ranking import position_in_group


def cogroup_n(inputs: Sequence[DataFrame], key: str = "key", value: str = "value",
              order: str | None = None) -> DataFrame:
    """Tagged union of n >= 2 inputs, each with columns ``key``, ``value``
    (and ``order`` if given): (key, side, v0 .. v{n-1}[, order]), side = 0 .. n-1.
    A row has its value in its side's column, with the type that side has."""
    if len(inputs) < 2:
        raise ValueError("cogroup needs at least two inputs")
    types = [df.schema[value].dataType for df in inputs]
    parts = [df.select(F.col(key), F.lit(i).alias("side"),
                       *[(F.col(value) if j == i else F.lit(None).cast(t)).alias(f"v{j}") for j, t in enumerate(types)],
                       *([F.col(order)] if order else []))
             for i, df in enumerate(inputs)]
    return reduce(DataFrame.unionByName, parts)


def _per_side(agg_of_side, n: int) -> list[Column]:
    return [agg_of_side(i).alias(f"v{i}") for i in range(n)]


def cogroup_sizes(grouped: DataFrame, n: int, key: str = "key") -> DataFrame:
    """Size of every side's group per key: (key, n0 .. n{n-1}); absent side 0."""
    return grouped.groupBy(key).agg(*[
        F.count(F.when(F.col("side") == i, F.lit(1))).cast("bigint").alias(f"n{i}") for i in range(n)])


def cogroup_values(grouped: DataFrame, n: int, order: str, key: str = "key") -> DataFrame:
    """The values themselves, side by side: (key, pos, v0 .. v{n-1}), where row pos
    of a key has the pos-th value of every side by ``order`` (from 1), null where
    a side has fewer. Values of equal ``order`` stand in either order."""
    at = position_in_group(grouped, [key, "side"], [order], "pos")
    return at.groupBy(key, "pos").agg(*_per_side(
        lambda i: F.max(F.when(F.col("side") == i, F.col(f"v{i}"))), n))


def first_or_default(grouped: DataFrame, n: int, key: str = "key", order: str | None = None,
                     default=None, round_bits: int | None = None) -> DataFrame:
    """Per key and side, the first value (smallest ``order``, else smallest
    value - a deterministic "first") or ``default`` when the side's group is
    empty; with ``round_bits`` fractions are rounded HALF_UP.
    (key, v0 .. v{n-1})."""
    def first(i: int) -> Column:
        mine = F.col("side") == i
        v = F.min_by(F.when(mine, F.col(f"v{i}")), F.when(mine, F.col(order or f"v{i}")))
        if round_bits is not None and isinstance(grouped.schema[f"v{i}"].dataType, (DoubleType, FloatType)):
            v = round_half_up(v, round_bits)
        return F.coalesce(v, F.lit(default)) if default is not None else v

    return grouped.groupBy(key).agg(*_per_side(first, n))


def _rows(batches: Iterator[pa.RecordBatch], key: str) -> Iterator[tuple]:
    """(key, side, value) row by row."""
    for b in batches:
        sides = b.column("side").to_pylist()
        columns = [b.column(f"v{j}") for j in range(b.num_columns - 2)]
        for i, k in enumerate(b.column(key).to_pylist()):
            yield k, sides[i], columns[sides[i]][i].as_py()


def cogroup_apply(inputs: Sequence[DataFrame], fn: Callable[[object, Iterator[tuple]], Iterable[tuple]], schema: StructType,
                  key: str = "key", value: str = "value", order: str | None = None, batch: int = 1_000) -> DataFrame:
    """``fn(key, values)`` for every key: ``values`` iterates over (side, value) by
    side, then ``order``, and ``fn`` yields rows of ``schema``.

    Groups are streams: Spark sorts them (spilling to disk as needed), and the
    task holds an Arrow batch and what ``fn`` keeps, whatever the size of a group.
    ``fn`` need not read its group to the end. A key's group is one task's work;
    what an aggregate can say is better said by ``cogroup_sizes`` and the like."""
    grouped = cogroup_n(inputs, key, value, order)
    out = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done: list[tuple] = []
        for k, rows in groupby(_rows(batches, key), key=lambda r: r[0]):
            for row in fn(k, ((side, v) for _, side, v in rows)):
                done.append(row)
                if len(done) >= batch:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*done), out)], schema=out)
                    done = []
        if done:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*done), out)], schema=out)

    by = [key, "side"] + ([order] if order else [])
    ready = grouped.repartition(key).sortWithinPartitions(*by)
    return ready.drop(*([order] if order else [])).mapInArrow(run, schema)
