"""Language ID by word-first backoff.

A word that the model knows adds its log frequency in each language; an unknown word adds the mean over its character
n-grams, of the longest order of which the model knows any, down to single letters. The model is fitted on a
bounded sample (``sample_rows`` documents in expectation), which bounds what goes to the driver and to every task: it holds every
word and n-gram that the sample has twice, up to ``max_words`` and ``max_grams`` of them, and every label that ``min_docs`` documents of it have.
Scoring reads whole texts.

Defined results: ``und`` with score 0 for null texts and texts without a letter, and for all texts where nothing could be
learned; ties go to the language that sorts first; a null id counts as the empty text in the split, which holds it out;
repeated rows score alike; further columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table, written

UNKNOWN = "und"
ORDERS = (5, 4, 3, 2, 1)
_WORD = re.compile(r"[^\W\d_]+")
_SMOOTH = 0.5
#: Words and n-grams that a task remembers between texts.
_ROOM = 100_000
#: Words of a text that are looked up at once, fewer than the room.
_PART = 4096


def held_out() -> Column:
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))) % 5 == 0


def bounded_sample(df: DataFrame, rows: int, n: int | None = None) -> DataFrame:
    """All rows, or about ``rows`` of them by a hash of their columns and place: the same ones at every run over the same files.

    The place counts, so rows that are alike in all columns are not all taken or all left.
    """
    n = df.count() if n is None else n
    if n <= rows:
        return df
    place = df.withColumn("_place", F.monotonically_increasing_id())
    return place.filter(F.pmod(F.xxhash64(F.lit("sample"), *df.columns, "_place"), F.lit(1 << 30)) < int(rows / n * (1 << 30))).drop("_place")


def grams_of(word: str, order: int) -> list[str]:
    w = f"^{word}$"
    return [w[i : i + order] for i in range(len(w) - order + 1)] if order > 1 else list(word)


class Entries:
    """Words or n-grams as sorted hashes, with the row of each: a few bytes an entry in every task."""

    def __init__(self, texts: list[str], base: int):
        h = np.fromiter((xxhash.xxh64_intdigest(t) for t in texts), np.uint64, len(texts))
        order = np.argsort(h, kind="stable")
        self.hashes, self.rows = h[order], (order + base).astype(np.int32)

    def __len__(self) -> int:
        return len(self.hashes)

    def find(self, texts: list[str]) -> np.ndarray:
        """The row of each; -1 where it is not known."""
        if not texts or not len(self):
            return np.full(len(texts), -1, np.int32)
        h = np.fromiter(map(xxhash.xxh64_intdigest, texts), np.uint64, len(texts))
        at = np.minimum(np.searchsorted(self.hashes, h), len(self) - 1)
        return np.where(self.hashes[at] == h, self.rows[at], -1)


@dataclass
class Model:
    langs: list[str]
    words: Entries
    grams: list[Entries]  # by ORDERS
    rows: np.ndarray  # log probabilities, a column for each language


def fit(docs: DataFrame, sample_rows: int = 20_000, max_words: int = 200_000, max_grams: int = 200_000, min_docs: int = 2) -> Model:
    """Learns from text and lang of ``docs``, of which it takes the rows with both."""
    known = docs.select("doc_id", "text", "lang").filter("text is not null and lang is not null")
    known = written(bounded_sample(known, sample_rows, docs.filter("lang is not null").count()), "lang-sample")
    langs = sorted(r.lang for r in known.groupBy("lang").agg(F.count("*").alias("n")).filter(F.col("n") >= min_docs).select("lang").collect())
    at = {lang: i for i, lang in enumerate(langs)}
    # labels are as many as the sample has documents at most
    known = known.filter(F.col("lang").isin(langs)) if langs else known.limit(0)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found: Counter = Counter()
            for text, lang in zip(b.column(0), b.column(1), strict=True):
                for w, n in Counter(_WORD.findall(text.as_py().lower())).items():
                    found[w, lang.as_py()] += n
            keys = list(found)
            yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in keys], pa.string()), pa.array([k[1] for k in keys], pa.string()), pa.array([found[k] for k in keys], pa.int64())], names=["word", "lang", "n"])

    words = known.select("text", "lang").mapInArrow(count, "word string, lang string, n long")
    words = written(words.groupBy("word", "lang").agg(F.sum("n").alias("n")), "lang-words")

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found: Counter = Counter()
            for w, lang in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                for order in ORDERS:
                    for g in grams_of(w, order):
                        found[order, g, lang] += 1
            keys = list(found)
            yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in keys], pa.int32()), pa.array([k[1] for k in keys], pa.string()), pa.array([k[2] for k in keys], pa.string()), pa.array([found[k] for k in keys], pa.int64())], names=["o", "word", "lang", "n"])

    grams = words.select("word", "lang").mapInArrow(spread, "o int, word string, lang string, n long")
    grams = written(grams.groupBy("o", "word", "lang").agg(F.sum("n").alias("n")), "lang-grams")

    words = words.withColumn("o", F.lit(0))
    totals = np.zeros((max(ORDERS) + 1, max(1, len(langs))))
    for r in words.unionByName(grams).groupBy("o", "lang").agg(F.sum("n").alias("n")).collect():
        totals[r.o, at[r.lang]] = r.n

    def most(df: DataFrame, limit: int) -> pa.Table:
        """The most frequent entries, each with its counts by language; as columns, which the driver holds in little memory."""
        by = df.groupBy("o", "word").agg(F.sum("n").alias("total"), F.collect_list("lang").alias("langs"), F.collect_list("n").alias("ns"))
        return by.filter("total >= 2").orderBy(F.desc("total"), "o", "word").limit(limit).drop("total").toArrow()

    found = [most(words, max_words), most(grams, max_grams)] if langs else []
    rows, texts, base = [], {o: ([], 0) for o in (0, *ORDERS)}, 0
    for got in found:
        order = got.column("o").to_numpy()
        n = np.zeros((got.num_rows, len(langs)))
        each = got.column("langs").combine_chunks()
        of = np.repeat(np.arange(got.num_rows), pa.compute.list_value_length(each).to_numpy(zero_copy_only=False))
        n[of, [at[lang] for lang in each.flatten().to_pylist()]] = got.column("ns").combine_chunks().flatten().to_numpy()
        # by order, so that the entries of one follow each other
        by = np.argsort(order, kind="stable")
        rows.append(np.log((n + _SMOOTH) / (totals[order] + 1))[by])
        names = got.column("word").take(pa.array(by)).to_pylist()
        for o in np.unique(order).tolist():
            lo, hi = np.searchsorted(order[by], [o, o + 1])
            texts[o] = (names[lo:hi], base + int(lo))
        base += got.num_rows
    every = np.concatenate(rows) if rows else np.zeros((0, len(langs)))
    return Model(langs, Entries(*texts[0]), [Entries(*texts[o]) for o in ORDERS], every)


class Scorer:
    """Scores texts; rows of words are remembered, those of unknown ones in a room of ``_ROOM`` rows."""

    def __init__(self, model: Model):
        self.m, self.n = model, len(model.rows)
        self.rows = np.concatenate([model.rows, np.zeros((_ROOM, len(model.langs)))])
        self.at: dict[str, int] = {}
        self.next = self.n

    def _learn(self, words: list[str]) -> None:
        rows = self.m.words.find(words).tolist()
        self.at.update((w, r) for w, r in zip(words, rows, strict=True) if r >= 0)
        for word in (w for w, r in zip(words, rows, strict=True) if r < 0):
            v = 0.0
            for order, entries in zip(ORDERS, self.m.grams, strict=True):
                hit = entries.find(grams_of(word, order))
                hit = hit[hit >= 0]
                if len(hit):
                    v = self.m.rows[hit].mean(0)
                    break
            self.rows[self.next] = v
            self.at[word] = self.next
            self.next += 1

    def __call__(self, text: str | None) -> tuple[str, float]:
        words = _WORD.findall(text.lower()) if text else []
        if not self.m.langs or not any(c.isalpha() for w in words for c in w):
            return UNKNOWN, 0.0
        total = np.zeros(len(self.m.langs))
        for lo in range(0, len(words), _PART):
            part = words[lo : lo + _PART]
            idx = list(map(self.at.get, part))
            if None in idx:
                fresh = {w for w, i in zip(part, idx, strict=True) if i is None}
                if self.next + len(fresh) > len(self.rows) or len(self.at) + len(fresh) > 2 * _ROOM:
                    self.at, self.next, fresh = {}, self.n, set(part)
                self._learn(list(fresh))
                idx = [self.at[w] for w in part]
            total += self.rows[idx].sum(0)
        p = np.exp(total - total.max())
        best = int(total.argmax())
        return self.m.langs[best], float(p[best] / p.sum())


def identify(docs: DataFrame, model: Model, *also: str) -> DataFrame:
    """doc_id, lang_pred, score, and the columns ``also`` as they are."""
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(model)
    cols = ["doc_id", "text", *(c for c in also if c != "text")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        score = Scorer(shared.value)
        for b in batches:
            got = [score(t.as_py()) for t in b.column("text")]
            keep = [b.column(n) for n in ("doc_id", *also)]
            yield pa.RecordBatch.from_arrays([*keep, pa.array([g[0] for g in got], pa.string()), pa.array([g[1] for g in got], pa.float64())], names=["doc_id", *also, "lang_pred", "score"])

    given = docs.select(*cols)
    types = [f"`{n}` {given.schema[n].dataType.simpleString()}" for n in ("doc_id", *also)]
    return given.mapInArrow(run, ", ".join([*types, "lang_pred string", "score double"]))


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = fit(docs.filter(~held_out()))
    return identify(docs.select("doc_id", "text"), model).select("doc_id", held_out().alias("held_out"), "lang_pred", "score")
