"""Exact vector retrieval: top-k by cosine, filters before and after it, grouping by entity, batches of queries.

A single query is a projection and a top-k that each task cuts to k before anything moves. A batch of queries is held against all
rows in blocks of a checked size, a tile of distances at a time, and each task keeps k rows a query.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

MAX_QUERY_FLOATS = 16_000_000
#: Queries and rows of a tile of distances.
TILE = (1024, 1024)


def cosine_distance(a: Column, b: Column) -> Column:
    """1 - cosine, as 64-bit floats; null for a zero vector."""
    dot = F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)
    norm = lambda v: F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))
    return 1 - dot / F.nullif(norm(a) * norm(b), F.lit(0.0))


def knn(store: DataFrame, query: list[float] | None, k: int, where: dict | None = None, contains: str | None = None, id_col: str = "vec_id", text_col: str = "text") -> DataFrame:
    """The k nearest rows with distance and similarity; equal distances go by id. Conditions of ``where`` hold before the cut."""
    if query is None:
        raise ValueError("a query vector is needed")
    for name, value in (where or {}).items():
        store = store.filter(F.col(name).eqNullSafe(F.lit(value)))
    if contains is not None:
        store = store.filter(F.col(text_col).contains(contains))
    q = F.array(*(F.lit(float(x)) for x in query))
    near = store.withColumn("distance", cosine_distance(F.col("embedding"), q)).orderBy(F.asc_nulls_last("distance"), id_col).limit(k)
    return near.withColumn("similarity", 1 - F.col("distance"))


def knn_text(store: DataFrame, text: str, embed: Callable[[list[str]], list[list[float]]], k: int, **more) -> DataFrame:
    return knn(store, embed([text])[0], k, **more)


def after_threshold(near: DataFrame, threshold: float, entity: str = "component_id", exclude: tuple = ()) -> DataFrame:
    """After the cut: what is excluded has used up its places."""
    out = near.filter(F.col("similarity") >= threshold)
    return out.filter(~F.coalesce(F.col(entity).isin(*exclude), F.lit(False))) if exclude else out


def by_entity(near: DataFrame, entity: str = "component_id", id_col: str = "vec_id", extra: tuple = (), per: tuple = ()) -> DataFrame:
    """Per entity: best_score, match_count, avg_score, documents best first, and ``extra`` columns of the best one; ``per``: of each query."""
    order = F.struct(F.col("distance"), F.col(id_col))
    text = F.col("text") if "text" in near.columns else F.lit(None).cast("string")
    return (
        near.filter(F.col(entity).isNotNull() & (F.col(entity).cast("string") != ""))
        .groupBy(*per, entity)
        .agg(
            F.max("similarity").alias("best_score"),
            F.count("*").alias("match_count"),
            F.coalesce(F.avg("similarity"), F.lit(0.0)).alias("avg_score"),
            F.sort_array(F.collect_list(F.struct(F.col("distance"), F.col(id_col).alias("id"), text.alias("text")))).alias("docs"),
            *(F.min_by(c, order).alias(c) for c in extra),
        )
    )


def rerank(groups: DataFrame, k: int, *ties: str) -> DataFrame:
    return groups.orderBy(F.desc("best_score"), *ties).limit(k)


def batch_knn(store: DataFrame, queries: DataFrame, k: int, id_col: str = "vec_id", query_col: str = "query_id", block_floats: int = MAX_QUERY_FLOATS, digits: int | None = None) -> DataFrame:
    """query_id, vec_id, distance, rank for the k nearest rows of each query; equal distances go by id. ``digits``: distances are rounded before they are compared.

    ``queries``: query_id, embedding; a null or zero vector has no distances. Each task holds a share of the rows against a block of queries of
    ``block_floats`` values at most; more queries take more blocks, and each block reads the store once. The shares are as many as
    the cores, so what tasks send grows with the queries alone.
    """
    asked = queries.select(F.col(query_col).cast("long").alias("query_id"), "embedding").filter("embedding is not null")
    size = asked.agg(F.count("*"), F.max(F.size("embedding"))).first()
    blocks = max(1, -(-(size[0] * (size[1] or 0)) // block_floats))
    rows = store.select(F.col(id_col).alias("vec_id"), "embedding").filter("embedding is not null")
    rows = rows.repartition(max(1, store.sparkSession.sparkContext.defaultParallelism), "vec_id")
    near = None
    for block in range(blocks):
        part = asked.filter(F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == block) if blocks > 1 else asked
        found = _block(rows, part, k, digits)
        near = found if near is None else near.unionByName(found)
    w = Window.partitionBy("query_id").orderBy("distance", "vec_id")
    return near.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def _matrix(embeddings: pa.Array) -> np.ndarray:
    return embeddings.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(embeddings), -1)


def nearest(best: tuple, d: np.ndarray, ids: np.ndarray, k: int, digits: int | None = None) -> tuple:
    """``best`` (query, distance and id, flat and in this order; at most k a query) after the distances ``d`` (query, row) of further rows."""
    q0, d0, i0 = best
    n = np.bincount(q0, minlength=len(d))
    last = np.cumsum(n) - 1
    full = n >= k
    most = np.where(full, d0[last], np.inf) if len(q0) else np.full(len(d), np.inf)
    q, r = np.nonzero(d <= (most + (0 if digits is None else 10.0**-digits))[:, None])
    new, own = d[q, r], ids[r]
    if digits is not None:
        new = np.round(new, digits)
    if len(q0):
        keep = ~full[q] | (new < most[q]) | ((new == most[q]) & (own < i0[last[q]]))
        q, new, own = q[keep], new[keep], own[keep]
    if not len(q):
        return best
    q, new, own = np.concatenate([q0, q]), np.concatenate([d0, new]), np.concatenate([i0, own]) if len(i0) else own
    order = np.lexsort((own, new, q))
    q, new, own = q[order], new[order], own[order]
    first = np.arange(len(q)) - np.searchsorted(q, q) < k
    return q[first], new[first], own[first]


def _block(rows: DataFrame, queries: DataFrame, k: int, digits: int | None) -> DataFrame:
    """For each task and query, the k nearest rows of the task."""
    kind = rows.schema["vec_id"].dataType
    ids = to_arrow_type(kind)
    asked = queries.toArrow().combine_chunks()
    q = np.concatenate([_matrix(c) for c in asked.column("embedding").chunks]) if asked.num_rows else np.zeros((0, 0))
    shared = rows.sparkSession.sparkContext.broadcast((asked.column("query_id").to_numpy(), q / np.maximum(np.linalg.norm(q, axis=1, keepdims=True), 1e-300)))
    wide, most = TILE

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        qs, unit = shared.value
        best = [(np.zeros(0, np.int64), np.zeros(0), np.zeros(0, np.int64))] * -(-len(qs) // wide)
        # The first tiles are small: what is found in them keeps most of the later rows out.
        high = min(64, most)
        for b in batches:
            at = 0
            while len(qs) and at < b.num_rows:
                part, at, high = b.slice(at, high), at + high, min(2 * high, most)
                own, v = np.array(part.column(0).to_pylist()), _matrix(part.column(1))
                norm = np.linalg.norm(v, axis=1)
                v /= np.where(norm == 0, np.nan, norm)[:, None]
                for j in range(len(best)):
                    d = 1 - unit[j * wide : (j + 1) * wide] @ v.T
                    best[j] = nearest(best[j], np.where(np.isnan(d), np.inf, d), own, k, digits)
        for j, (q, d, i) in enumerate(best):
            yield pa.RecordBatch.from_arrays([pa.array(qs[q + j * wide], pa.int64()), pa.array(i.tolist(), ids), pa.array(d, pa.float64())], names=["query_id", "vec_id", "distance"])

    return rows.mapInArrow(run, f"query_id long, vec_id {kind.simpleString()}, distance double")


def best_per_component(matches: DataFrame, entity: str = "component_id", order: str = "query_ord") -> DataFrame:
    """Over several queries the best match of an entity; equal ones go to the earlier query."""
    return matches.groupBy(entity).agg(F.max_by(F.struct(*(c for c in matches.columns if c != entity)), F.struct("best_score", -F.col(order))).alias("m")).select(entity, "m.*")


def hashed_words(dim: int = 64) -> Callable[[list[str]], list[list[float]]]:
    """A model-free stand-in for an embedding service: signed hashed words, unit length, equal in every process."""
    import re
    import zlib

    def embed(texts: list[str]) -> list[list[float]]:
        out = np.zeros((len(texts), dim))
        for row, t in zip(out, texts, strict=True):
            for w in re.findall(r"\w+", (t or "").lower()):
                h = zlib.crc32(w.encode())
                row[h % dim] += 1 if h >> 31 else -1
        norm = np.linalg.norm(out, axis=1, keepdims=True)
        return (out / np.where(norm == 0, 1, norm)).tolist()

    return embed


def embed_documents(docs: DataFrame, embed: Callable[[list[str]], list[list[float]]], batch: int = 100) -> DataFrame:
    """Adds embedding; the function gets ``batch`` texts at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = b.column("text").to_pylist()
            v = [x for lo in range(0, len(texts), batch) for x in embed(texts[lo : lo + batch])]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(v, pa.list_(pa.float32()))], names=[*b.schema.names, "embedding"])

    return docs.mapInArrow(run, docs.limit(0).withColumn("embedding", F.expr("cast(null as array<float>)")).schema)


def upsert(store: DataFrame, rows: DataFrame, key: str = "doc_id", order: str | None = None) -> DataFrame:
    """Rows replace those of the store with their key. Of equal new keys the last by ``order`` stays; without one, the greatest row."""
    rest = F.struct(*(c for c in rows.columns if c != key))
    by = F.struct(order, rest) if order else rest
    fresh = rows.groupBy(key).agg(F.max_by(rest, by).alias("_r")).select(key, "_r.*").select(*rows.columns)
    return store.join(fresh.select(key), key, "left_anti").unionByName(fresh, allowMissingColumns=True)


def by_metadata(store: DataFrame, column: str, value) -> DataFrame:
    return store.filter(F.col(column) == value).withColumn("distance", F.lit(0.0))


def count(store: DataFrame) -> int:
    return store.count()


def search_modules(store: DataFrame, query: list[float] | str, k: int, embed: Callable[[list[str]], list[list[float]]] | None = None, id_col: str = "doc_id") -> DataFrame:
    """The nearest documents about the use of a module, one row each: what is asked for are modules, so they are not grouped."""
    vector = embed([query])[0] if isinstance(query, str) else query
    return knn(store, vector, k, where={"doc_type": "module_usage"}, id_col=id_col)
