"""SimHash near-dedup with pivot distance tables.

A fingerprint has a pivot row: its Hamming distances to ``PIVOTS`` fixed reference fingerprints. Two fingerprints whose rows
differ by more than the radius in any coordinate cannot be that close, so pairs are discarded on their rows alone, in
order of the first coordinate, and only survivors are compared bit by bit. That holds for every pair that is looked at.

Pivot rows alone deal out too few pairs to be an index: distances of unlike fingerprints are all near 32, so a coordinate tells
about a third of the pairs apart. So distinct fingerprints first go to tables such that two within ``radius`` bits share a
bucket in one table at least: of ``blocks`` bit blocks, ``radius`` can differ, and each choice of the others is a table. A bucket answers
with one edge a member (to the least member it is linked to), not with its pairs; edges then become components. Copies of a text are
one fingerprint from the start. Buckets above ``most`` fingerprints are dealt again by further bits, and what is still above goes
into tiles that together hold all its pairs, so a task never holds more than twice ``most``.

Defined results: texts without words have fingerprint zero, linked like any other; with fewer words than a shingle the whole
sequence is the shingle; repeated rows are in one component; null ids are ignored as component ids, a component
of nulls alone has null; further columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tremor.operators.components import connected_components

from . import near_copies
from .common import release, table, written

SEED = 42
PIVOTS = 48
MOST = 16_384


def simhash(text: str | None, width: int = 3) -> int:
    """The fingerprint, unsigned: bit i is set if it is in over half the hashes of the shingles, repeats included."""
    words = text.encode().lower().split() if text else []
    if not words:
        return 0
    shingles = [b" ".join(words)] if len(words) < width else map(b" ".join, zip(*(words[i:] for i in range(width)), strict=False))
    h = np.fromiter((xxhash.xxh64_intdigest(s, SEED) for s in shingles), np.uint64)
    if len(h) == 1:
        return int(h[0])
    ones = np.zeros(64, np.int64)
    for lo in range(0, len(h), 8192):
        ones += np.unpackbits(h[lo : lo + 8192].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(h), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, width: int = 3, also: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, fp (as a signed 64-bit integer), n_words, words_hash (of all words in order), and the long columns ``also``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in (whole.slice(lo, 512) for lo in range(0, whole.num_rows, 512)):
                fps, n, hashes = [], [], []
                for t in b.column(1):
                    text = t.as_py()
                    words = text.encode().lower().split() if text else []
                    fps.append(simhash(text, width))
                    n.append(len(words))
                    hashes.append(xxhash.xxh64_intdigest(b" ".join(words), SEED))
                columns = [pa.array(np.array(fps, np.uint64).view(np.int64)), pa.array(n, pa.int64()), pa.array(np.array(hashes, np.uint64).view(np.int64))]
                yield pa.RecordBatch.from_arrays([b.column(0), *columns, *(b.column(c) for c in also)], names=["doc_id", "fp", "n_words", "words_hash", *also])

    schema = ", ".join(["doc_id long, fp long, n_words long, words_hash long", *(f"{c} long" for c in also)])
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"), *also).mapInArrow(run, schema)


def _pivots(n: int = PIVOTS) -> np.ndarray:
    """Reference fingerprints: digests of their numbers."""
    return np.array([xxhash.xxh64_intdigest(f"pivot {i}".encode(), SEED) for i in range(n)], np.uint64)


def linked(fps: np.ndarray, radius: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of places in ``fps`` (distinct, unsigned) within ``radius`` bits, block by block."""
    rows = np.bitwise_count(fps[:, None] ^ _pivots()[None, :]).astype(np.int8)
    order = np.argsort(rows[:, 0], kind="stable")
    fps, rows = fps[order], rows[order]
    ends = np.searchsorted(rows[:, 0], rows[:, 0] + radius, side="right")
    for lo in range(0, len(fps), 256):
        hi = min(lo + 256, len(fps))
        top = int(ends[hi - 1])
        i, j = np.nonzero((np.arange(lo, top)[None, :] > np.arange(lo, hi)[:, None]) & (np.abs(rows[lo:hi, 1][:, None] - rows[lo:top, 1][None, :]) <= radius))
        i, j = i + lo, j + lo
        for c in (0, *range(2, rows.shape[1])):
            if not len(i):
                break
            near = np.abs(rows[i, c] - rows[j, c]) <= radius
            i, j = i[near], j[near]
        near = np.bitwise_count(fps[i] ^ fps[j]) <= radius
        yield order[i[near]], order[j[near]]


def forest(fps: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """For each member with a link, itself and the least member that its links lead to."""
    label = np.arange(len(fps))
    for i, j in linked(fps, radius):
        while True:
            a, b = label[i], label[j]
            if (a == b).all():
                break
            low = np.minimum(a, b)
            np.minimum.at(label, a, low)
            np.minimum.at(label, b, low)
            while (label[label] != label).any():
                label = label[label]
    joined = np.flatnonzero(label != np.arange(len(fps)))
    return fps[joined], fps[label[joined]]


def _masks(radius: int, blocks: int) -> list[int]:
    cuts = [64 * k // blocks for k in range(blocks + 1)]
    block = [((1 << hi) - 1) ^ ((1 << lo) - 1) for lo, hi in zip(cuts, cuts[1:], strict=False)]
    sums = [sum(c) for c in combinations(block, blocks - radius)]
    return [m - (1 << 64) if m >> 63 else m for m in sums]


def _tables(masks: list[int]) -> Column:
    return F.explode(F.array(*(F.struct(F.lit(t).alias("t"), F.col("fp").bitwiseAND(F.lit(m)).alias("k")) for t, m in enumerate(masks))))


def _in_buckets(members: DataFrame, by: list[str], radius: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            us, vs = [], []
            for got in b.column("fps"):
                u, v = forest(np.array(got.as_py(), np.int64).view(np.uint64), radius)
                us.append(u)
                vs.append(v)
            if us:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x).view(np.int64)) for x in (us, vs)], names=["u", "v"])

    return members.groupBy(*by).agg(F.collect_list("fp").alias("fps")).select("fps").mapInArrow(run, "u long, v long")


def _close(u: Column, v: Column, radius: int) -> Column:
    """Not discarded by any pivot, and within ``radius`` bits."""
    out = F.lit(True)
    for p in _pivots().view(np.int64).tolist():
        out = out & (F.abs(F.bit_count(u.bitwiseXOR(F.lit(p))) - F.bit_count(v.bitwiseXOR(F.lit(p)))) <= radius)
    return out & (F.bit_count(u.bitwiseXOR(v)) <= radius)


def _sizes(members: DataFrame, by: list[str]) -> DataFrame:
    return members.groupBy(*by).agg(F.count("*").alias("n"), F.min("fp").alias("u"), F.max("fp").alias("v")).filter("n > 1")


def links(fps: DataFrame, radius: int, blocks: int, most: int = MOST) -> DataFrame:
    """Edges (u, v) that join any two of the distinct ``fp`` within ``radius`` bits by a path of such pairs."""
    dealt = fps.select("fp", _tables(_masks(radius, blocks)).alias("x")).select("fp", "x.t", "x.k")
    sizes = written(_sizes(dealt, ["t", "k"]), "simhash-buckets")
    pairs = sizes.filter((F.col("n") == 2) & _close(F.col("u"), F.col("v"), radius)).select("u", "v")
    # The rest of the buckets, met once more by their key.
    members = written(dealt.join(sizes.filter("n > 2").select("t", "k", "n"), ["t", "k"]), "simhash-members")
    out = pairs.unionByName(_in_buckets(members.filter(F.col("n") <= most), ["t", "k"], radius))
    finer = members.filter(F.col("n") > most).select("t", "k", "fp", _tables(_masks(radius, radius + 1)).alias("x"))
    finer = written(finer.select("t", "k", F.col("x.t").alias("t2"), F.col("x.k").alias("k2"), "fp"), "simhash-finer")
    by = ["t", "k", "t2", "k2"]
    finer = finer.join(_sizes(finer, by).select(*by, "n"), by)
    tiles = F.ceil(F.col("n") / F.lit(most)).cast("int")
    own = finer.withColumn("g", tiles).withColumn("c", F.pmod(F.xxhash64("fp", F.lit("tile")), F.col("g")).cast("int"))
    own = own.withColumn("o", F.explode(F.sequence(F.lit(0), F.col("g") - 1)))
    own = own.select(*by, "fp", F.least("c", "o").alias("lo"), F.greatest("c", "o").alias("hi"))
    return out.unionByName(_in_buckets(own, [*by, "lo", "hi"], radius)).distinct()


def simhash_components(prints: DataFrame, radius: int = 2, blocks: int = 4) -> DataFrame:
    """``prints`` (doc_id, fp) with component (a fingerprint, never null) and component_id, the least doc_id reachable over links of ``radius`` bits."""
    fps = written(prints.groupBy("fp").agg(F.min("doc_id").alias("least")), "simhash-prints")
    parts = connected_components(links(fps, radius, blocks)).select(F.col("node").alias("fp"), "component")
    fps = fps.join(parts, "fp", "left").select("fp", "least", F.coalesce("component", "fp").alias("component"))
    fps = written(fps, "simhash-parts")
    ids = fps.groupBy("component").agg(F.min("least").alias("component_id"))
    return prints.join(fps.join(ids, "component").select("fp", "component", "component_id"), "fp", "left")


def keep_one(docs: DataFrame, least: float = near_copies.LEAST) -> DataFrame:
    """One row of each group of near-duplicates, texts of ``least`` Jaccard similarity in five-word shingles: the least doc_id, then the least text.

    SimHash fingerprints and their distances to pivots lead to the pairs that are compared, see ``near_copies``.
    """
    prints = written(near_copies.signatures(docs.withColumn("_h", F.xxhash64("text")), also=("_h",)), "near-docs")
    edges = written(near_copies.links(prints, least), "near-links")
    release(docs.sparkSession)
    parts = connected_components(edges).select(F.col("node").alias("id"), "component")
    group = prints.select("doc_id", "_h", "id").join(parts, "id", "left").select("doc_id", "_h", F.coalesce("component", "id").alias("g"))
    # min over (id, hash) with nulls last; one row a group
    first = group.groupBy("g").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "_h")).alias("x")).select("x.doc_id", "x._h")
    first = written(first.groupBy("doc_id", "_h").agg(F.count("*").alias("n")), "near-kept").select(F.col("doc_id").alias("_d"), F.col("_h").alias("_k"))
    kept = docs.withColumn("_h", F.xxhash64("text")).join(first.hint("merge"), (F.col("_h") == F.col("_k")) & F.col("doc_id").eqNullSafe(F.col("_d")))
    # repeated rows agree in id and text
    copies = prints.groupBy("doc_id", "_h").agg(F.count("*").alias("n")).filter("n > 1")
    if copies.isEmpty():
        return kept.drop("_h", "_k", "_d")
    return kept.dropDuplicates(["doc_id", "_h"]).drop("_h", "_k", "_d")


def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    prints = written(fingerprints(table(spark, sf_dir, "documents")), "simhash-docs")
    out = simhash_components(prints)
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
