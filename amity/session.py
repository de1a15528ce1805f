"""Session helpers: a local session for tests and benches, and the shared
scratch folder that lineage cuts and written intermediates go to."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: int | str = "*", shuffle_partitions: int = 8,
                  app_name: str = "amity") -> SparkSession:
    """Session for local runs. On a cluster the caller builds its own session;
    every operator only needs a SparkSession."""
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app_name)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "16g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def checkpoint_root(spark: SparkSession) -> str:
    """Shared folder named by ``spark.checkpoint.dir``, else the one the
    session already called ``setCheckpointDir`` with.

    On a cluster this names storage every executor can reach; it is read,
    never replaced, and its absence is an error. Only a ``local`` master, where
    driver and executors share one disk, gets a folder of its own."""
    sc = spark.sparkContext
    root = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir", None)
    if not root:
        root = sc.getCheckpointDir()
    if not root:
        if not (sc.master == "local" or sc.master.startswith("local[")):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        root = tempfile.mkdtemp(prefix="amity-ckpt-")
        spark.conf.set("spark.checkpoint.dir", root)
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(root)
    return root


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh, never reused sub-folder of the application's own folder in the
    shared checkpoint folder. The application's folder is dropped when its driver's
    JVM ends."""
    base = f"{checkpoint_root(spark).rstrip('/')}/amity-{spark.sparkContext.applicationId}"
    fs, p = hadoop_fs(spark, base)
    if not fs.exists(p):
        fs.mkdirs(p)
        fs.deleteOnExit(p)   # takes folders that exist only
    return f"{base}/{name}-{uuid.uuid4().hex[:12]}"


def staged(df: DataFrame, name: str) -> DataFrame:
    """``df`` written once to the shared folder and read back: the lineage ends at
    files that outlive any executor, and later joins see real sizes."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def hadoop_fs(spark: SparkSession, path: str):
    """Hadoop FileSystem for ``path`` (HDFS, S3A, local, ...)."""
    jvm = spark.sparkContext._jvm
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(conf), p


def delete_path(spark: SparkSession, path: str) -> bool:
    """Recursive delete through the Hadoop FileSystem of the path."""
    fs, p = hadoop_fs(spark, path)
    if fs.exists(p):
        return bool(fs.delete(p, True))
    return False
