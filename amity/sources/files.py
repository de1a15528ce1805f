"""File sources and sinks: CSV with a header, text lines, whole files,
delimited text.

Sinks replace the target path (``mode("overwrite")``) and keep Spark's
parallel file layout; ``single_file=True`` coalesces to one file, which only
suits small outputs because one task then writes everything.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def csv_scan(spark: SparkSession, path: str) -> DataFrame:
    """CSV with a header row; every column is text (no schema inference, so
    no extra pass over the data)."""
    return spark.read.option("header", "true").csv(path)


def text_scan(spark: SparkSession, path: str) -> DataFrame:
    """One row per line (column ``value``); files are split across tasks, so
    line order across the whole input is not promised."""
    return spark.read.text(path)


def whole_text_scan(spark: SparkSession, path: str) -> DataFrame:
    """One row per file with its whole content (column ``value``): for small files.
    Of large ones ``whole_text_chunks`` gives the text in rows of bounded size."""
    return spark.read.option("wholetext", "true").text(path)


def file_lines(spark: SparkSession, path: str) -> DataFrame:
    """(path, block, at, value): the lines of text files with their place. A large
    file is read as byte ranges (``spark.sql.files.maxPartitionBytes``) by several
    tasks; a line belongs to the range it starts in, however far it reaches into the
    next. ``block`` is the first byte of the range, ``at`` rises with the lines of it."""
    return (spark.read.text(path)
            .select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("block"),
                    "value").withColumn("at", F.monotonically_increasing_id()).select("path", "block", "at", "value"))


def whole_text_chunks(spark: SparkSession, path: str) -> DataFrame:
    """(path, chunk, value): the whole text of every file in chunks 0, 1, ... of
    whole lines, joined by ``\n`` - so is a file, from its chunks. A chunk holds the
    lines of one byte range, so no row and no task ever holds a whole large file."""
    lines = file_lines(spark, path).groupBy("path", "block").agg(F.collect_list(F.struct("at", "value")).alias("lines"))
    text = F.array_join(F.transform(F.array_sort("lines"), lambda x: x["value"]), "\n")
    number = F.row_number().over(Window.partitionBy("path").orderBy("block")) - 1   # one row a byte range
    return lines.select("path", "block", text.alias("value")).withColumn("chunk", number).select("path", "chunk", "value")


def _writer(df: DataFrame, single_file: bool):
    return (df.coalesce(1) if single_file else df).write.mode("overwrite")


def write_csv(df: DataFrame, path: str, single_file: bool = False) -> None:
    _writer(df, single_file).option("header", "true").csv(path)


def write_text(df: DataFrame, path: str, column: str = "value", single_file: bool = False) -> None:
    """Write one string column as text lines."""
    _writer(df.select(F.col(column).cast("string").alias("value")), single_file).text(path)


def delimited_lines(df: DataFrame, sep: str = "\t") -> DataFrame:
    """Each row as one line: fields as text joined by ``sep``, a null field
    printed as ``null``, no quoting, no header."""
    fields = [F.coalesce(F.col(c).cast("string"), F.lit("null")) for c in df.columns]
    return df.select(F.concat_ws(sep, *fields).alias("value"))


def write_delimited(df: DataFrame, path: str, sep: str = "\t", single_file: bool = False) -> None:
    write_text(delimited_lines(df, sep), path, single_file=single_file)
