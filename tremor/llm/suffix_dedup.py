"""Exact substring dedup by a logarithmic family of sparse suffix arrays.

Strings are made of bytes, and beside that of words (runs without white space): bytes of ``BYTES.length``-byte strings that start
twice are removed, and runs of ``WORDS.length`` words that stand in another document too are reported as passages.

Which suffixes are indexed: among the ``gram``-unit grams of any ``length``-unit string the one with the least hash is its
anchor. Equal strings have equal anchors at equal places, so suffixes at anchors (about one in 160 bytes, one in 20 words) find every
long match; a full array would cost eight bytes for each byte of text. The stretch of string starts that share an anchor is its
context; a suffix-array row is the anchor's fingerprint (which orders the array: a scan only asks for equality to a depth), the
fingerprint of the whole context, and how often it was seen.

Family: a batch of documents becomes a sorted array, is merge-scanned (a sort-merge join) against each level for anchors that
were seen before, and is added as a level; two levels of one size merge into the next, so each row is rewritten a
logarithmic number of times. Copies of a context collapse before any shuffle. A family can be saved and loaded, and meets
new batches later.

Extension: a context seen twice repeats at every start. Where an anchor stands in several contexts, the text of one sample
of each meet by anchor, and their strings are sorted by fingerprint to find the starts that repeat. Anchors with more than
``MOST`` contexts are dealt into tiles; each tile finds its own repeats and sends its distinct fingerprints, by ranges, to meet those of the
other tiles, so no task collects a hot anchor. Joins by anchor are salted by ``SALTS``.

Fingerprints have 128 bits in effect (anchor and context, or anchor and string). Defined results: null texts are empty; texts
under ``length`` bytes keep all; repeated rows, with null ids too, are copies of each other, and count as other documents; further
columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import forget, forget_path, release, table, written, written_path

BATCHES = 2
MOST = 512
SALTS = 4
_CHUNK = 1 << 18
_BASE = 0x9E3779B97F4A7C15
_LOW = np.uint64((1 << 24) - 1)
#: Words that a task remembers between texts.
_ROOM = 300_000


class _Hashes(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) >= _ROOM:
            self.clear()
        h = self[word] = xxhash.xxh64_intdigest(word, 42)
        return h


@dataclass(frozen=True)
class Unit:
    """What strings are made of. ``across``: a string repeats only where it stands in another document."""

    number: int
    length: int
    gram: int
    width: int  # bytes that hold one
    across: bool

    def raw(self, text: str | None, known: _Hashes) -> bytes:
        data = text.encode() if text else b""
        if self.width == 1:
            return data
        words = data.split()
        return np.fromiter(map(known.__getitem__, words), np.uint64, len(words)).tobytes() if len(words) >= self.length else b""

    def values(self, raw: bytes) -> np.ndarray:
        return _bytes_table()[np.frombuffer(raw, np.uint8)] if self.width == 1 else np.frombuffer(raw, np.uint64)


BYTES = Unit(0, length=400, gram=80, width=1, across=False)
WORDS = Unit(1, length=51, gram=10, width=8, across=True)
UNITS = (BYTES, WORDS)


@cache
def _powers(size: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse, modulo 2**64."""

    def of(x: int) -> np.ndarray:
        out = np.full(size, x, np.uint64)
        out[0] = 1
        return np.multiply.accumulate(out)

    return of(_BASE), of(pow(_BASE, -1, 1 << 64))


@cache
def _bytes_table() -> np.ndarray:
    return np.array([xxhash.xxh64_intdigest(bytes([b]), 42) | 1 for b in range(256)], np.uint64)


def grams(values: np.ndarray, size: int) -> np.ndarray:
    """A 64-bit fingerprint of each ``size``-unit string in ``values``."""
    n = len(values)
    if n < size:
        return np.empty(0, np.uint64)
    room = 1 << max(18, int(n).bit_length())
    up, down = _powers(room)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(values * up[:n], out=sums[1:])
    h = (sums[size:] - sums[:-size]) * down[: n - size + 1]
    h ^= h >> np.uint64(31)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(29)
    h *= np.uint64(0x94D049BB133111EB)
    h ^= h >> np.uint64(32)
    return h


def contexts(raw: bytes, unit: Unit = BYTES) -> Iterator[tuple[list[int], list[int], list[int], list[int]]]:
    """Anchor and context fingerprints (signed), first start and number of starts, chunk by chunk of string starts."""
    length, width = unit.length, unit.width
    window = length - unit.gram + 1
    for at in range(0, len(raw) // width - length + 1, _CHUNK):
        h = grams(unit.values(raw[at * width : (at + _CHUNK + length - 1) * width]), unit.gram)
        # place in the low bits: the least value names its place, the first one where hashes tie
        low = (h & ~_LOW) | np.arange(len(h), dtype=np.uint64)
        w = 1
        while 2 * w <= window:
            low = np.minimum(low[:-w], low[w:])
            w *= 2
        if w < window:
            low = np.minimum(low[: len(low) - (window - w)], low[window - w :])
        place = (low & _LOW).astype(np.int64)
        cut = np.flatnonzero(np.diff(place)) + 1
        first, end = np.concatenate([[0], cut]), np.concatenate([cut, [len(place)]])
        keys = h[place[first]].view(np.int64).tolist()
        starts, counts = (first + at).tolist(), (end - first).tolist()
        whole = [xxhash.xxh3_64_intdigest(raw[s * width : (s + c + length - 1) * width]) for s, c in zip(starts, counts, strict=True)]
        yield keys, np.array(whole, np.uint64).view(np.int64).tolist(), starts, counts


def repeated_starts(samples: list[bytes], groups: np.ndarray, owners: np.ndarray, unit: Unit = BYTES) -> list[np.ndarray]:
    """For each sample of a context, which of its strings repeat among the samples of its group: at another start, or with another owner."""
    sizes = np.array([len(s) // unit.width for s in samples])
    ends = np.cumsum(sizes)
    h = grams(unit.values(b"".join(samples)), unit.length)
    n_starts = sizes - unit.length + 1
    at = np.concatenate([np.arange(e - s, e - s + n) for s, e, n in zip(sizes, ends, n_starts, strict=True)])
    h, g = h[at], np.repeat(groups, n_starts)
    o = np.repeat(owners, n_starts) if unit.across else np.arange(len(h))
    order = np.lexsort((o, h, g))
    h, g, o = h[order], g[order], o[order]
    first = np.flatnonzero(np.concatenate([[True], (h[1:] != h[:-1]) | (g[1:] != g[:-1])]))
    n = np.diff(np.append(first, len(h)))
    out = np.zeros(len(h), bool)
    out[order] = np.repeat(o[first] != o[first + n - 1], n)
    return np.split(out, np.cumsum(n_starts)[:-1])


def intervals(starts: np.ndarray) -> list[tuple[int, int]]:
    """Runs of set places: (first, past the last)."""
    edge = np.flatnonzero(np.diff(np.concatenate([[0], starts.astype(np.int8), [0]])))
    return list(zip(edge[::2].tolist(), edge[1::2].tolist(), strict=True))


_ROWS = "doc_id long, h long, key long, ctx long, place long"
_LEVEL = "key long, ctx long, n long"
_REPEATS = "key long, c long"


def _place(start: int, count: int, counts: int, unit: int) -> int:
    """Where a context is, in one number: first start, number of starts, whether it counts, and the unit."""
    return start << 22 | count << 2 | counts << 1 | unit


START, COUNT, COUNTS, UNIT = "shiftright(place, 22)", "shiftright(place, 2) & 1048575", "shiftright(place, 1) & 1", "place & 1"


def suffix_rows(docs: DataFrame, units: tuple[Unit, ...] = UNITS) -> DataFrame:
    """One row for each anchored suffix of ``docs`` (doc_id, h, text). A context of words counts once in a document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = _Hashes()
        for b in batches:
            for lo in range(0, b.num_rows, 512):
                cols: list[list] = [[] for _ in range(5)]
                part = b.slice(lo, 512)
                for doc_id, h, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), part.column(2), strict=True):
                    for unit in units:
                        seen: set[tuple[int, int]] = set()
                        for keys, ctx, starts, counts in contexts(unit.raw(text.as_py(), known), unit):
                            one = [1] * len(keys)
                            if unit.across:
                                for i, got in enumerate(zip(keys, ctx, strict=True)):
                                    one[i] = int(got not in seen)
                                    seen.add(got)
                            places = [_place(s, c, n, unit.number) for s, c, n in zip(starts, counts, one, strict=True)]
                            for col, v in zip(cols, ([doc_id] * len(keys), [h] * len(keys), keys, ctx, places), strict=True):
                                col += v
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], names=[c.split()[0] for c in _ROWS.split(", ")])

    return docs.select("doc_id", "h", "text").mapInArrow(run, _ROWS)


class SuffixFamily:
    """Levels of suffix arrays; ``repeats`` are the anchors that merge-scans have met twice. Both are tables, by path."""

    def __init__(self, spark: SparkSession, levels: list[tuple[int, str]] = (), repeats: list[str] = ()):
        self.spark, self.levels, self.repeats = spark, [tuple(x) for x in levels], list(repeats)

    def saved(self) -> dict:
        """What ``SuffixFamily(spark, **saved)`` needs to go on; as long as the tables are there."""
        return {"levels": self.levels, "repeats": self.repeats}

    def level(self, path: str) -> DataFrame:
        return self.spark.read.schema(_LEVEL).parquet(path)

    @staticmethod
    def _array(rows: DataFrame) -> DataFrame:
        return rows.groupBy("key", "ctx").agg(F.sum("n").alias("n")).sortWithinPartitions("key", "ctx")

    def add(self, rows: DataFrame) -> None:
        """A batch of ``suffix_rows``: array, merge-scan, carry."""
        path = written_path(self._array(rows.select("key", "ctx", F.expr(COUNTS).alias("n"))), "suffix-level")
        release(self.spark)
        # each side has an anchor once, with its contexts, so a hot one is not a hot key
        by_key = lambda p: self.level(p).groupBy("key").agg(F.sum("n").alias("n"), F.count("*").alias("c"))
        seen = by_key(path).filter("n > 1").select("key", "c")
        for _, other in self.levels:
            met = by_key(path).alias("a").hint("merge").join(by_key(other).alias("b"), "key")
            seen = seen.unionByName(met.select("key", F.expr("a.c + b.c").alias("c")))
        self.repeats.append(written_path(seen, "suffix-repeats"))
        release(self.spark)
        size = 0
        while self.levels and self.levels[-1][0] == size:
            old = self.levels.pop()[1]
            merged = written_path(self._array(self.level(path).unionByName(self.level(old))), "suffix-level")
            forget_path(self.spark, path)
            forget_path(self.spark, old)
            path, size = merged, size + 1
            release(self.spark)
        self.levels.append((size, path))

    def repeated(self) -> DataFrame:
        """Level rows (key, ctx, n) of all anchors that occur more than once, each context once; ``c``: contexts of the anchor, at most.

        A hot anchor goes to ``SALTS`` tasks, by its contexts.
        """
        keys = self.spark.read.schema(_REPEATS).parquet(*self.repeats).groupBy("key").agg(F.sum("c").alias("c"))
        keys = keys.withColumn("s", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))).hint("merge")
        rows = self.spark.read.schema(_LEVEL).parquet(*(path for _, path in self.levels))
        met = rows.withColumn("s", F.pmod("ctx", F.lit(SALTS)).cast("int")).join(keys, ["key", "s"]).drop("s")
        return met if len(self.levels) == 1 else met.groupBy("key", "ctx").agg(F.sum("n").alias("n"), F.max("c").alias("c"))

    def forget(self) -> None:
        for path in [p for _, p in self.levels] + self.repeats:
            forget_path(self.spark, path)
        self.levels, self.repeats = [], []


_FOUND = "key long, ctx long, runs array<struct<lo:long,hi:long>>"
_RUNS = pa.list_(pa.struct([("lo", pa.int64()), ("hi", pa.int64())]))
_SAMPLE = "key long, ctx long, data binary, tiles int, unit byte, owner long"


def _samples(docs: DataFrame, hits: DataFrame, most: int) -> DataFrame:
    """For contexts of anchors that have several: the text of one place of each, as often as its document is repeated."""
    units = {u.number: u for u in UNITS}
    several = hits.filter("c > 1").groupBy("key", "ctx").agg(*(F.first(c).alias(c) for c in ("doc_id", "h", "place", "n", "c")))
    # A context seen in one document belongs to that document, one seen in several to none.
    owner = F.when(F.col("n") > 1, F.xxhash64(F.lit("many"), "key", "ctx")).otherwise(F.xxhash64("doc_id", "h"))
    cols = [F.col("key"), F.col("ctx"), F.expr(START).alias("start"), F.expr(COUNT).alias("count"), F.ceil(F.col("c") / F.lit(most)).cast("int").alias("tiles"), F.expr(UNIT).alias("unit"), owner.alias("owner")]
    here = several.groupBy("doc_id", "h").agg(F.collect_list(F.struct(*cols)).alias("at")).hint("merge")
    there = docs.select(F.col("doc_id").alias("d2"), F.col("h").alias("h2"), "text")
    texts = here.join(there, F.expr("h = h2 and doc_id <=> d2")).select("text", "at")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = _Hashes()
        for b in batches:
            for lo in range(0, b.num_rows, 256):
                rows = []
                part = b.slice(lo, 256)
                for text, at in zip(part.column(0), part.column(1).to_pylist(), strict=True):
                    raw = {k: units[k].raw(text.as_py(), known) for k in {x["unit"] for x in at}}
                    for x in at:
                        u = units[x["unit"]]
                        rows.append((x["key"], x["ctx"], raw[x["unit"]][x["start"] * u.width : (x["start"] + x["count"] + u.length - 1) * u.width], x["tiles"], x["unit"], x["owner"]))
                types = (pa.int64(), pa.int64(), pa.binary(), pa.int32(), pa.int8(), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(types)], names=[c.split()[0] for c in _SAMPLE.split(", ")])

    return texts.mapInArrow(cut, _SAMPLE)


def _partly(samples: DataFrame) -> DataFrame:
    """The runs of starts, from the first of the context, that repeat."""

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def done(rows: list[tuple]) -> Iterator[pa.RecordBatch]:
            for u in UNITS:
                if mine := [r for r in rows if r[3] == u.number]:
                    found = repeated_starts([r[2] for r in mine], np.array([r[0] for r in mine]), np.array([r[4] for r in mine]), u)
                    kept = [(r[0], r[1], [{"lo": lo, "hi": hi} for lo, hi in intervals(f)]) for r, f in zip(mine, found, strict=True) if f.any()]
                    yield pa.RecordBatch.from_arrays([pa.array([k[i] for k in kept], t) for i, t in enumerate((pa.int64(), pa.int64(), _RUNS))], names=["key", "ctx", "runs"])

        held, size = [], 0
        for b in batches:  # sorted by key and context
            for row in zip(*(b.column(k).to_pylist() for k in range(5)), strict=True):
                if held and held[-1][:2] == row[:2]:
                    continue
                if size > 4 << 20 and held[-1][0] != row[0]:
                    yield from done(held)
                    held, size = [], 0
                held.append(row)
                size += len(row[2])
        if held:
            yield from done(held)

    met = samples.filter("tiles = 1").select("key", "ctx", "data", "unit", "owner").repartition("key").sortWithinPartitions("key", "ctx").mapInArrow(meet, _FOUND)

    return met.unionByName(_in_tiles(samples.filter("tiles > 1").withColumn("tile", F.pmod("ctx", "tiles").cast("int"))))


def _groups(batches: Iterator[pa.RecordBatch], n: int) -> Iterator[list[tuple]]:
    """Rows of sorted batches, grouped by their first ``n`` columns."""
    held: list[tuple] = []
    for b in batches:
        for row in zip(*(c.to_pylist() for c in b.columns), strict=True):
            if held and held[-1][:n] != row[:n]:
                yield held
                held = []
            held.append(row)
    if held:
        yield held


def _distinct(h: np.ndarray, o: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct values of ``h``, the least owner of each, and whether it has several."""
    order = np.lexsort((o, h))
    h, o = h[order], o[order]
    first = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]]))
    last = np.append(first[1:], len(h)) - 1
    return h[first], o[first], o[first] != o[last]


def _in_tiles(samples: DataFrame) -> DataFrame:
    """As ``_partly``, for anchors whose contexts do not fit one task."""
    units = {u.number: u for u in UNITS}

    def once(rows: list[tuple], at: int) -> list[tuple]:
        return [r for i, r in enumerate(rows) if not i or r[at] != rows[i - 1][at]]

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _groups(batches, 2):
            (key, tile, _, _, tiles, number, _), u = rows[0], units[rows[0][5]]
            rows = once(rows, 2)
            parts = [grams(u.values(r[3]), u.length) for r in rows]
            h = np.concatenate(parts)
            # numbers that no other tile uses stand for starts, and for strings of several owners
            own = (np.arange(len(h)) << 24) + tile
            o = np.repeat(np.array([r[6] for r in rows]), [len(x) for x in parts]) if u.across else own
            h, o, many = _distinct(h, o)
            o = np.where(many, own[: len(h)], o)
            part = (h >> np.uint64(40)).astype(np.int64) % tiles
            for p in np.unique(part).tolist():
                mine = part == p
                yield pa.RecordBatch.from_pydict({"key": pa.array([key]), "part": pa.array([p]), "tile": pa.array([tile]), "s": pa.array([h[mine].tobytes()]), "o": pa.array([o[mine].tobytes()])})

    def across(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _groups(batches, 2):
            of = np.repeat(np.arange(len(rows)), [len(r[3]) // 8 for r in rows])
            h = np.frombuffer(b"".join(r[3] for r in rows), np.uint64)
            values, _, many = _distinct(h, np.frombuffer(b"".join(r[4] for r in rows), np.int64))
            hit = many[np.searchsorted(values, h)]
            for k in np.unique(of[hit]).tolist():
                yield pa.RecordBatch.from_pydict({"key": pa.array([rows[k][0]]), "tile": pa.array([rows[k][2]], pa.int32()), "s": pa.array([h[hit & (of == k)].tobytes()])})

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _groups(batches, 2):
            told = np.frombuffer(b"".join(r[4] for r in rows if r[2] is None), np.uint64)
            rows = once([r for r in rows if r[2] is not None], 2)
            u = units[rows[0][3]]
            found = repeated_starts([r[4] for r in rows], np.zeros(len(rows), np.int64), np.array([r[5] for r in rows]), u)
            found = [f | np.isin(grams(u.values(r[4]), u.length), told) for r, f in zip(rows, found, strict=True)]
            kept = [(r[0], r[2], [{"lo": lo, "hi": hi} for lo, hi in intervals(f)]) for r, f in zip(rows, found, strict=True) if f.any()]
            yield pa.RecordBatch.from_arrays([pa.array([k[i] for k in kept], t) for i, t in enumerate((pa.int64(), pa.int64(), _RUNS))], names=["key", "ctx", "runs"])

    dealt = samples.select("key", "tile", "ctx", "data", "tiles", "unit", "owner").repartition("key", "tile").sortWithinPartitions("key", "tile", "ctx")
    strings = dealt.mapInArrow(spread, "key long, part long, tile long, s binary, o binary")
    told = strings.repartition("key", "part").sortWithinPartitions("key", "part").mapInArrow(across, "key long, tile int, s binary")
    none = F.lit(None)
    both = samples.select("key", "tile", "ctx", "unit", "data", "owner").unionByName(
        told.select("key", "tile", none.cast("long").alias("ctx"), none.cast("byte").alias("unit"), F.col("s").alias("data"), none.cast("long").alias("owner"))
    )
    return both.repartition("key", "tile").sortWithinPartitions("key", "tile", F.asc_nulls_first("ctx")).mapInArrow(finish, _FOUND)


def _union(runs: list[dict], length: int) -> list[tuple[int, int]]:
    """Runs of units covered by the strings that start in ``runs``, joined where they touch."""
    out: list[tuple[int, int]] = []
    for lo, hi in sorted((r["lo"], r["hi"] - 1 + length) for r in runs):
        if out and lo <= out[-1][1]:
            out[-1] = (out[-1][0], max(hi, out[-1][1]))
        else:
            out.append((lo, hi))
    return out


def keyed(docs: DataFrame) -> DataFrame:
    """doc_id, text and h, a hash that tells texts of one id apart."""
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).withColumn("h", F.xxhash64("text"))


def repeats_in(docs: DataFrame, rows: DataFrame, family: SuffixFamily, most: int = MOST, last: bool = False) -> DataFrame:
    """doc_id, h, and the runs of repeated string starts, in bytes and in words, of the documents that ``rows`` (a written table) are of.

    ``docs`` are all documents that the family was told of, of which ``rows`` are the suffixes, or of a part of them that has
    every repeat in itself; the family keeps no texts. With ``last``, rows and family are deleted once they have been read.
    """
    spark = docs.sparkSession
    known = written(family.repeated(), "suffix-known")
    if last:
        family.forget()
    release(spark)
    # The copies of one context meet here; Spark's skew handling splits them, as the other side is a row.
    hits = written(rows.join(known.hint("merge"), ["key", "ctx"]).filter("n > 1 or c > 1"), "suffix-hits")
    forget(known)
    if last:
        forget(rows)
    release(spark)
    samples = written(_samples(docs, hits, most), "suffix-samples")
    release(spark)
    # A context that repeats as a whole needs nothing else.
    whole = F.array(F.struct(F.lit(0).cast("long").alias("lo"), F.expr(COUNT).alias("hi")))
    found = hits.filter("n > 1").withColumn("runs", whole).unionByName(hits.filter("n <= 1").join(_partly(samples).hint("merge"), ["key", "ctx"]))
    shifted = F.transform("runs", lambda r: F.struct((r["lo"] + F.expr(START)).alias("lo"), (r["hi"] + F.expr(START)).alias("hi")))
    # sets: repeated rows have equal runs
    of = lambda u: F.flatten(F.collect_set(F.when(F.expr(UNIT) == u.number, shifted)))
    found = written(found.groupBy("doc_id", "h").agg(of(BYTES).alias("runs"), of(WORDS).alias("word_runs")), "suffix-found")
    for t in (hits, samples):
        forget(t)
    release(spark)
    return found


_RESULT = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, n_passages long, n_passage_words long"


def removed(docs: DataFrame, found: DataFrame, keep_bytes: bool = False) -> DataFrame:
    """``docs`` without the bytes of the runs that ``found`` names (see ``repeats_in``)."""
    found = found.select(F.col("doc_id").alias("d2"), F.col("h").alias("h2"), "runs", "word_runs").hint("merge")
    schema = _RESULT + (", kept binary" if keep_bytes else "")

    def finish(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in frames:
            out = []
            for doc_id, text, runs, word_runs in zip(b.column(0).to_pylist(), b.column(1), b.column(2), b.column(3), strict=True):
                data = (text.as_py() or "").encode()
                spans, kept, at = _union(runs.as_py() or [], BYTES.length), [], 0
                for lo, hi in spans:
                    kept.append(data[at:lo])
                    at = hi
                left = b"".join([*kept, data[at:]])
                passages = _union(word_runs.as_py() or [], WORDS.length)
                row = (doc_id, len(data), len(data) - len(left), len(spans), hashlib.sha256(left).hexdigest(), len(passages), sum(hi - lo for lo, hi in passages))
                out.append((*row, left) if keep_bytes else row)
            types = [pa.int64()] * 4 + [pa.string()] + [pa.int64()] * 2 + [pa.binary()] * keep_bytes
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], t) for k, t in enumerate(types)], names=[c.split()[0] for c in schema.split(", ")])

    joined = docs.join(found, F.expr("h = h2 and doc_id <=> d2"), "left").select("doc_id", "text", "runs", "word_runs")
    return joined.mapInArrow(finish, schema)


def substring_dedup(docs: DataFrame, batches: int = BATCHES, most: int = MOST, keep_bytes: bool = False) -> DataFrame:
    """Removes every byte that a ``BYTES.length``-byte string covers which starts anywhere else too.

    Returns doc_id, n_bytes, n_removed, n_spans, kept_sha256, n_passages and n_passage_words (maximal runs of words, and words in them, of which
    each ``WORDS.length`` in a row stand in another document) and, on demand, kept (binary: a cut may part a character).
    """
    docs = keyed(docs)
    rows = written(suffix_rows(docs), "suffix-rows")
    family = SuffixFamily(docs.sparkSession)
    for k in range(batches):
        family.add(rows.filter(F.pmod("h", F.lit(batches)) == k))
    found = repeats_in(docs, rows, family, most, last=True)
    return removed(docs, found, keep_bytes)


def op2_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup(table(spark, sf_dir, "documents"))
