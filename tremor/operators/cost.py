"""Cost projection and the content-hash cache."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tremor.functions.text import approx_tokens, cache_key


#: Ranges of time that are counted at once to find what to evict.
_BUCKETS = 1024


@dataclass(frozen=True)
class Prices:
    embedding_per_million: float = 0.02
    input_per_million: float = 2.5
    output_per_million: float = 10.0
    chars_per_token: int = 4
    embedding_batch: int = 100
    suggestion_batch: int = 10


def keyed(docs: DataFrame, model: str, text: str = "text") -> DataFrame:
    return docs.withColumn("cache_key", cache_key(F.lit(model), F.coalesce(F.col(text), F.lit(""))))


def cache_misses(docs: DataFrame, cache: DataFrame, model: str, text: str = "text") -> DataFrame:
    """Rows whose key the cache lacks; equal texts are a miss each."""
    return keyed(docs, model, text).join(cache.select(F.col("key").alias("cache_key")).distinct(), "cache_key", "left_anti")


def embedding_cost(docs: DataFrame, cache: DataFrame | None = None, model: str = "default", text: str = "text", prices: Prices = Prices()) -> DataFrame:
    """One row: documents, cache_hits, paid documents, tokens of those, batches and dollars."""
    rows = keyed(docs, model, text).withColumn("tokens", approx_tokens(F.length(F.coalesce(F.col(text), F.lit(""))), prices.chars_per_token))
    if cache is None:
        rows = rows.withColumn("hit", F.lit(False))
    else:
        known = cache.select(F.col("key").alias("cache_key")).distinct().withColumn("hit", F.lit(True))
        rows = rows.join(known, "cache_key", "left").withColumn("hit", F.coalesce("hit", F.lit(False)))
    paid = F.when(~F.col("hit"), F.col("tokens")).otherwise(0)
    out = rows.agg(F.count("*").alias("documents"), F.count(F.when(F.col("hit"), 1)).alias("cache_hits"), F.coalesce(F.sum(paid), F.lit(0)).alias("paid_tokens"))
    out = out.withColumn("paid_documents", F.col("documents") - F.col("cache_hits"))
    return out.select(
        "documents", "cache_hits", "paid_documents", "paid_tokens",
        F.ceil(F.col("paid_documents") / prices.embedding_batch).cast("long").alias("batches"),
        F.round(F.col("paid_tokens") / F.lit(1e6) * prices.embedding_per_million, 4).alias("usd"),
    )


def suggestion_cost(n_gaps: int, n_components: int, prices: Prices = Prices()) -> dict[str, float]:
    calls = -(-n_gaps // prices.suggestion_batch)
    chars_in, chars_out = calls * (200 + 80 * n_components) + 180 * n_gaps, 120 * n_gaps
    tokens = lambda n: max(1, n // prices.chars_per_token) if n else 0
    usd = tokens(chars_in) / 1e6 * prices.input_per_million + tokens(chars_out) / 1e6 * prices.output_per_million
    return {"calls": calls, "input_tokens": tokens(chars_in), "output_tokens": tokens(chars_out), "usd": round(usd, 4)}


def estimate(docs: DataFrame, n_gaps: int, n_components: int, embeddings: bool = True, suggestions: bool = True, **more) -> dict:
    e = embedding_cost(docs, **more).first().asDict() if embeddings else None
    s = suggestion_cost(n_gaps, n_components) if suggestions else None
    return {"embedding": e, "suggestions": s, "total_usd": round(sum(x["usd"] for x in (e, s) if x), 4)}


def cached_embed(docs: DataFrame, cache: DataFrame, embed: Callable[[list[str]], list[list[float]]], model: str, now: int, batch: int = 100, text: str = "text") -> tuple[DataFrame, DataFrame]:
    """(docs with embedding, cache with the new entries and last use). Only misses reach the function, ``batch`` at a time."""
    rows = keyed(docs, model, text)
    known = cache.select(F.col("key").alias("cache_key"), F.col("embedding").alias("known"))
    missing = rows.join(known, "cache_key", "left_anti").select("cache_key", F.coalesce(F.col(text), F.lit("")).alias("t")).dropDuplicates(["cache_key"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = b.column(1).to_pylist()
            v = [x for lo in range(0, len(texts), batch) for x in embed(texts[lo : lo + batch])]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(v, pa.list_(pa.float32()))], names=["cache_key", "known"])

    fresh = missing.mapInArrow(run, "cache_key string, known array<float>")
    every = known.unionByName(fresh)
    out = rows.join(every, "cache_key", "left").withColumnRenamed("known", "embedding")
    used = rows.select("cache_key").distinct().withColumn("used", F.lit(now).cast("long"))
    kept = every.join(cache.select(F.col("key").alias("cache_key"), "last_used"), "cache_key", "left").join(used, "cache_key", "left")
    return out, kept.select(F.col("cache_key").alias("key"), F.col("known").alias("embedding"), F.coalesce("used", "last_used").alias("last_used"))


def evict(cache: DataFrame, most: int) -> DataFrame:
    """The ``most`` entries used last; equal times go by key.

    The border is found by counting: ``_BUCKETS`` ranges of time a pass, then ranges within the range of the border, so no task orders the
    whole cache. Only entries of the time at the border need an order, and a top-k gives it.
    """
    if most <= 0:
        return cache.limit(0)
    ends = cache.agg(F.min("last_used"), F.max("last_used"), F.count("*")).first()
    if ends[2] <= most:
        return cache
    lo, hi, room = ends[0], ends[1], most
    while lo < hi:
        width = -(-(hi - lo + 1) // _BUCKETS)
        inside = cache.filter((F.col("last_used") >= lo) & (F.col("last_used") <= hi))
        counts = dict(inside.groupBy(F.floor((F.col("last_used") - lo) / width).alias("b")).agg(F.count("*").alias("n")).collect())
        at = max(counts)
        while counts.get(at, 0) <= room:
            room -= counts.get(at, 0)
            at -= 1
        lo, hi = lo + at * width, min(hi, lo + (at + 1) * width - 1)
    edge = cache.filter(F.col("last_used") == lo).orderBy("key").limit(room)
    return cache.filter(F.col("last_used") > lo).unionByName(edge)


def cache_stats(docs: DataFrame, cache: DataFrame, model: str, text: str = "text") -> DataFrame:
    """One row: hits, misses, hit_rate (4 decimals, 0 for no look-ups)."""
    known = cache.select(F.col("key").alias("cache_key")).distinct().withColumn("hit", F.lit(1))
    out = keyed(docs, model, text).join(known, "cache_key", "left").agg(F.count("hit").alias("hits"), (F.count("*") - F.count("hit")).alias("misses"))
    return out.withColumn("hit_rate", F.coalesce(F.round(F.col("hits") / F.nullif(F.col("hits") + F.col("misses"), F.lit(0)), 4), F.lit(0.0)))
