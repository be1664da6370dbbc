"""The folder that the driver and all executors share, and small files on whatever file system Spark uses."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``. Where the session names none, one machine gets a local folder and a cluster an error."""
    named = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.sparkContext.getCheckpointDir()
    if not named:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="tremor-shared-"))
        named = spark.sparkContext.getCheckpointDir()
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(named)
    return named.rstrip("/")


def written(df: DataFrame, label: str) -> DataFrame:
    """``df`` as a Parquet table in the shared folder: lineage ends there, and any executor can read it again."""
    path = f"{shared_dir(df.sparkSession)}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: Rows of a bucket, about: what is built into a hash table from the other side of a join has no more keys.
BUCKET_ROWS = 300_000


def buckets(spark: SparkSession, rows: int) -> int:
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-rows // BUCKET_ROWS))


def dealt(df: DataFrame, label: str, key: str, n: int, ready: bool = False) -> DataFrame:
    """``df`` as a table in the shared folder, one file for each of ``n`` buckets of ``key``: what joins or groups it by the key moves the other side only.

    ``ready``: it is partitioned so already.
    """
    name = f"{label}-{uuid.uuid4().hex}"
    table = name.replace("-", "_")
    df = df if ready else df.repartition(n, key)
    df.write.bucketBy(n, key).option("path", f"{shared_dir(df.sparkSession)}/{name}").saveAsTable(table)
    return df.sparkSession.table(table)


def _path(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark._jsc.hadoopConfiguration())
    return fs, fs.makeQualified(p)


def qualified(spark: SparkSession, path: str) -> str:
    """A path with its scheme: one without is on the file system that Spark itself would use."""
    uri = _path(spark, path)[1].toString()
    return uri.replace("file:/", "file:///", 1) if uri.startswith("file:/") and not uri.startswith("file://") else uri


def exists(spark: SparkSession, path: str) -> bool:
    fs, p = _path(spark, path)
    return fs.exists(p)


def delete(spark: SparkSession, path: str) -> None:
    fs, p = _path(spark, path)
    fs.delete(p, True)


def read_text(spark: SparkSession, path: str) -> str | None:
    """A small file as text; None where there is none."""
    if not exists(spark, path):
        return None
    return spark.read.text(qualified(spark, path), wholetext=True).first()[0]


def write_text(spark: SparkSession, path: str, text: str) -> str:
    """A small file in one step: readers see the old content or the new one. Returns its path."""
    fs, p = _path(spark, path)
    part = p.suffix(f".{uuid.uuid4().hex}.part")
    out = fs.create(part, True)
    try:
        out.write(bytearray(text.encode()))
    finally:
        out.close()
    fs.delete(p, False)
    if not fs.rename(part, p):
        raise OSError(f"{path}: not written")
    return p.toString()
