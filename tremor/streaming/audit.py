"""Extension: the audit log as a stream. Entries arrive as JSON files; windows count them by class, late ones up to a watermark."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

ENTRY = (
    "timestamp timestamp, operation string, destination string, content_hash string, content_length int, sanitized_length int, "
    "redaction_count int, categories_found array<string>, classification string, blocked boolean, block_reason string"
)


def read_audit(spark: SparkSession, folder: str, files_per_trigger: int = 100) -> DataFrame:
    return spark.readStream.schema(ENTRY).option("maxFilesPerTrigger", files_per_trigger).json(folder)


def windowed(entries: DataFrame, width: str = "10 minutes", late: str = "1 hour") -> DataFrame:
    """n, blocked and redactions by window and class; state is kept no longer than the watermark."""
    counted = entries.withWatermark("timestamp", late).groupBy(F.window("timestamp", width).alias("w"), "classification")
    return counted.agg(F.count("*").alias("n"), F.count(F.when(F.col("blocked"), 1)).alias("blocked"), F.sum("redaction_count").alias("redactions")).select(
        F.col("w.start").alias("window_start"), "classification", "n", "blocked", "redactions"
    )


def append_audit(entries: DataFrame, folder: str) -> None:
    """Adds entries as JSON lines; what is there stays."""
    entries.write.mode("append").json(folder)
