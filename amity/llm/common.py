"""What the operators of this subpackage share: written intermediates, the
definition of a word, and the key of a document.

Documents come as rows (doc_id, text, ...). Rows that are equal in doc_id and
text count as one document wherever an operator compares documents; rows that
share a doc_id and differ in text are told apart by ``text_key``."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from amity.session import hadoop_fs, scratch_path

#: A word is a longest run of characters outside this class; bytes.split() of
#: UTF-8 text and this class agree.
SPACE = r"[\x20\x09-\x0D]+"


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/documents.parquet")


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` written once to the shared folder and read back: cuts the lineage
    at files that outlive any executor, and gives later joins real sizes. The
    folder is dropped when the session's JVM ends."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    fs, p = hadoop_fs(spark, path)
    fs.deleteOnExit(p)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def text_key(text: str = "text") -> Column:
    """64-bit key of a text; null and empty texts have different keys."""
    return F.xxhash64(F.col(text).isNull(), F.col(text))


def words(text: str | Column) -> Column:
    """Array of the words of a text; null for null."""
    c = F.col(text) if isinstance(text, str) else text
    return F.filter(F.split(c, SPACE), lambda w: w != "")
