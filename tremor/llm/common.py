"""What the text operators share: the shared folder, written tables, word and hash expressions."""

from __future__ import annotations

import gc
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tremor.sources.shared import shared_dir

#: White space of every contract here: blank, tab, line feed, vertical tab, form feed, carriage return.
WS = " \t\n\x0b\x0c\r"
WS_RUN = r"[\x20\x09-\x0D]+"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def written_path(df: DataFrame, label: str) -> str:
    """The path of ``df`` as a table in the shared folder."""
    path = f"{shared_dir(df.sparkSession)}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return path


def written(df: DataFrame, label: str) -> DataFrame:
    """``df`` as a table in the shared folder: cuts lineage, survives lost executors, and its size is known to the planner."""
    return df.sparkSession.read.schema(df.schema).parquet(written_path(df, label))


def forget_path(spark: SparkSession, path: str) -> None:
    """Deletes the files of a table; nothing may read it later."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def forget(df: DataFrame) -> None:
    """Deletes the files of a table that ``written`` made; nothing may read it later."""
    for path in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        forget_path(df.sparkSession, path)


def release(spark: SparkSession) -> None:
    """Lets Spark delete the shuffle files of jobs that are done: it does so once the driver has dropped their plans."""
    gc.collect()
    spark._jvm.System.gc()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ascii_lower(c: Column) -> Column:
    """A-Z lower-cased, all else as it is. Plain ``lower`` is right, and faster, where all is ASCII."""
    return F.when(F.octet_length(c) == F.length(c), F.lower(c)).otherwise(F.translate(c, UPPER, UPPER.lower()))


def words_of(text: Column) -> Column:
    """Runs without white space; none for null or blank texts."""
    trimmed = F.btrim(F.coalesce(text, F.lit("")), F.lit(WS))
    return F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, WS_RUN, -1))
