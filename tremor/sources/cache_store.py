"""The embedding cache between sessions: versioned tables below one folder, and a pointer that changes in one step."""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable
from dataclasses import dataclass, replace

from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tremor.operators import cost
from tremor.sources.shared import read_text, shared_dir, write_text

SCHEMA = "key string, embedding array<float>, last_used long"
VERSION = 1


@dataclass(frozen=True)
class CacheStore:
    """Entries and what was counted so far. A disabled cache holds nothing, hits nothing and writes nothing."""

    spark: SparkSession
    folder: str
    entries: DataFrame
    most: int = 100_000
    enabled: bool = True
    hits: int = 0
    misses: int = 0
    evictions: int = 0
    dirty: bool = False

    @property
    def stats(self) -> dict:
        asked = self.hits + self.misses
        return {"hits": self.hits, "misses": self.misses, "evictions": self.evictions, "hit_rate": round(self.hits / asked, 4) if asked else 0.0}


def load(spark: SparkSession, folder: str, most: int = 100_000, enabled: bool = True) -> CacheStore:
    """What ``flush`` left there; nothing where there is nothing, or nothing that can be read. Entries without a vector go."""
    entries = spark.createDataFrame([], SCHEMA)
    if enabled:
        try:
            at = json.loads(read_text(spark, f"{folder}/current.json") or "null")
            if isinstance(at, dict) and at.get("version") == VERSION:
                found = spark.read.schema(SCHEMA).parquet(at["table"]).filter("key is not null and embedding is not null")
                found.limit(1).count()
                entries = found
        except (ValueError, KeyError, PySparkException):
            pass  # a cache that cannot be read is an empty one
    return CacheStore(spark, folder, entries, most, enabled)


def embed(store: CacheStore, docs: DataFrame, call: Callable[[list[str]], list[list[float]]], model: str, now: int, text: str = "text", batch: int = 100) -> tuple[DataFrame, CacheStore]:
    """``docs`` with embedding, and the store after it: only misses reach ``call``; beyond ``most`` entries the ones used longest ago go."""
    if not store.enabled:
        out, _ = cost.cached_embed(docs, store.spark.createDataFrame([], SCHEMA), call, model, now, batch, text)
        return out, store
    seen = cost.cache_stats(docs, store.entries, model, text).first()
    out, entries = cost.cached_embed(docs, store.entries, call, model, now, batch, text)
    path = f"{shared_dir(store.spark)}/cache-{uuid.uuid4().hex}"
    entries.write.parquet(path)
    entries = store.spark.read.schema(SCHEMA).parquet(path)
    # vectors of this session come from what was written, so no text is sent twice
    out = cost.keyed(docs, model, text).join(entries.select(F.col("key").alias("cache_key"), "embedding"), "cache_key", "left")
    over = max(0, entries.count() - store.most)
    if over:
        entries = cost.evict(entries, store.most)
    return out, replace(store, entries=entries, hits=store.hits + seen.hits, misses=store.misses + seen.misses, evictions=store.evictions + over, dirty=True)


def flush(store: CacheStore) -> CacheStore:
    """Writes the entries as a new table, then turns the pointer to it: a reader sees all of the old or all of the new."""
    if not store.enabled or not store.dirty:
        return store
    path = f"{store.folder}/entries-{uuid.uuid4().hex}"
    store.entries.write.parquet(path)
    write_text(store.spark, f"{store.folder}/current.json", json.dumps({"version": VERSION, "table": path}))
    return replace(store, entries=store.spark.read.schema(SCHEMA).parquet(path), dirty=False)
