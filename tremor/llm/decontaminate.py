"""Benchmark decontamination by template canonicalisation.

Words become a template: numbers, units that follow them and names inside a sentence turn into typed placeholders, the rest
is lower-cased without outer punctuation. Windows of ``window`` template words are hashed and met with those of
the benchmark items; matching windows on one diagonal (document place less item place) are an alignment, and so are stretches of diagonals up to ``shift`` apart that follow each other in both. Texts are read twice: word by word,
and with runs of names, of number words and of a number and its unit in one placeholder each and every capitalised word a name, so a value may take
another number of words and a name may begin a sentence. An alignment counts
as a leak where it covers ``cover`` of the item or a run of ``run`` words, and its slots are consistent: one value
of the item stands for one value of the document, in ``consistent`` of the cases. Where over half of the covered words are slots,
most of their values have to be equal as well. So a question that was asked anew with other
numbers and names is found, and two texts that merely share a layout are not.

Which items a text has to be aligned with: a leak matches a number of windows of the item at least, which follows from ``cover``,
``run`` and the most words that a window of it spans. One fewer of them, those that most items share, name no candidates; at least one
other window of a leak does. So phrases that a whole benchmark shares cost nothing, and no leak is lost.

The benchmark's windows are looked up in each task while the items stay under ``max_item_chars`` characters, which is checked;
beyond it, the same windows of documents and items meet in a shuffled join, which names the candidates of each document, and the same
scoring follows: both give the same rows.

Defined results: null and empty texts match nothing; items shorter than a window match as a whole; repeated rows of
documents give repeated rows of leaks; an item row that is repeated counts once, equal items are reported under each of
their ids; null item ids are kept; ties between alignments go to the greater coverage, then to the longer run; further
columns are ignored; an empty benchmark or table gives an empty result.
"""

from __future__ import annotations

import math
import re
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import table, written

#: Words for numbers, and units that count after a number.
NUMBER_WORDS = frozenset("zero one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen twenty thirty forty fifty sixty seventy eighty ninety hundred thousand million billion half dozen".split())
UNITS = frozenset("kg g mg km m cm mm mi ft in lb lbs oz l ml h hr hrs min mins s sec secs hour hours minute minutes second seconds day days week weeks month months year years meter meters metre metres kilometer kilometers mile miles inch inches foot feet gram grams kilogram kilograms pound pounds ounce ounces liter liters litre litres percent dollars dollar euros euro cents cent degrees mph kmh".split())
_NUMBER = re.compile(r"[+\-−$€£]*\d[\d.,:/]*(%|[a-zµ°]{1,3})?\Z", re.IGNORECASE)
_EDGE = "\"'“”‘’()[]{}<>«»*_.,;:!?…#|&%"
PLAIN, NUMBER, NAME, UNIT = range(4)
_MARKS = np.array([xxhash.xxh64_intdigest(f"slot {k}".encode()) for k in range(4)], np.uint64)
_BASE = 0x9E3779B97F4A7C15 | 1
_SUFFIX = re.compile(r"(.*\d)([a-zµ°%]{1,3})\Z", re.IGNORECASE)
_ROOM = 200_000


@dataclass(frozen=True)
class Rule:
    window: int = 8
    cover: float = 0.6
    run: int = 13
    consistent: float = 0.8
    shift: int = 8
    max_item_chars: int = 20_000_000


@dataclass
class View:
    """Template words of a text: hashes, kinds, and the word each begins with (and the end of the last)."""

    hashes: np.ndarray
    kinds: np.ndarray
    starts: np.ndarray
    joined: bool = False

    def values(self, words: list[str], q: int) -> tuple[str, str]:
        """The value of a slot, and its unit where the two are in one."""
        run = [w.strip(_EDGE).lower() for w in words[self.starts[q] : self.starts[q + 1]]]
        if self.kinds[q] != NUMBER or not self.joined:
            return " ".join(run), ""
        if len(run) > 1 and run[-1] in UNITS:
            return " ".join(run[:-1]), run[-1]
        m = _SUFFIX.match(run[-1])
        return (" ".join([*run[:-1], m[1]]), m[2]) if m else (" ".join(run), "")


class Templates:
    """Template words of texts, with the properties of a word remembered between texts."""

    def __init__(self):
        self.at: dict[str, int] = {}
        self.hash = np.zeros(_ROOM + 1, np.uint64)
        self.flag = np.zeros(_ROOM + 1, np.uint8)  # 1 number, 2 capitalised, 4 unit, 8 ends a sentence, 16 number without digits, 32 ends in a mark

    def _learn(self, word: str) -> int:
        i = self.at[word] = len(self.at)
        core = word.strip(_EDGE)
        low = core.lower()
        flag = 8 * (word.rstrip("\"'”’)").endswith((".", "!", "?", ":")))
        if _NUMBER.match(core):
            flag |= 1
        elif low and all(part in NUMBER_WORDS for part in low.split("-")):
            flag |= 17
        elif low in UNITS:
            flag |= 4
        if len(core) > 1 and core[0].isupper() and core[1:].islower():
            flag |= 2
        if word[-1] in ",;:.!?":
            flag |= 32
        self.hash[i], self.flag[i] = xxhash.xxh64_intdigest(low.encode()), flag
        return i

    def __call__(self, text: str | None) -> tuple[list[str], list[View]]:
        """Words, and their two views: word by word, and with runs in one."""
        words = text.split() if text else []
        hashes, flags = np.empty(len(words), np.uint64), np.empty(len(words), np.uint8)
        for lo in range(0, len(words), 8192):
            part = words[lo : lo + 8192]
            if len(self.at) + len(part) > _ROOM:
                self.at.clear()
            at, learn = self.at, self._learn
            idx = [at[w] if w in at else learn(w) for w in part]
            hashes[lo : lo + len(part)], flags[lo : lo + len(part)] = self.hash[idx], self.flag[idx]
        places = np.arange(len(words) + 1)
        if not len(words):
            none = View(hashes, np.zeros(0, np.int8), places)
            return words, [none, none]
        after = lambda x: np.concatenate([[False], x[:-1]])
        number, name = flags & 1 == 1, flags & 2 == 2
        unit = (flags & 4 == 4) & after(number)
        kinds = np.zeros(len(words), np.int8)
        kinds[name & ~np.concatenate([[True], flags[:-1] & 8 == 8])] = NAME
        kinds[unit] = UNIT
        kinds[number] = NUMBER
        slot = kinds > 0
        single = View(np.where(slot, _MARKS[kinds], hashes), kinds, places)
        kinds = np.where(number | unit, NUMBER, np.where(name, NAME, PLAIN)).astype(np.int8)
        goes_on = unit | (~after(flags & 32 == 32) & (((kinds == NAME) & after(kinds == NAME)) | ((flags & 16 == 16) & after(number))))
        starts = np.flatnonzero(~goes_on)
        kinds = kinds[starts]
        return words, [single, View(np.where(kinds > 0, _MARKS[kinds], hashes[starts]), kinds, np.append(starts, len(words)), joined=True)]


def windows(hashes: np.ndarray, size: int) -> np.ndarray:
    """A hash for each window; a text that is shorter has one for the whole, in which its length counts."""
    if not len(hashes):
        return np.empty(0, np.uint64)
    n = min(size, len(hashes))
    with np.errstate(over="ignore"):
        out = np.full(len(hashes) - n + 1, n, np.uint64)
        for k in range(n):
            out = out * np.uint64(_BASE) + hashes[k : len(hashes) - n + 1 + k]
        return out ^ (out >> np.uint64(29))


def spared(view: View, rule: Rule) -> int:
    """So many windows of an item need not name it: a leak matches more."""
    size = min(rule.window, len(view.hashes))
    span = int((view.starts[size:] - view.starts[:-size]).max()) if size else 1
    return max(0, min(math.ceil(rule.cover * int(view.starts[-1]) / span - 1e-9), math.ceil(rule.run / span)) - 1)


class Table:
    """Windows of one view of the items: those that name an item, sorted, and all of each item."""

    def __init__(self, views: list[View], rule: Rule):
        self.views, self.window = views, rule.window
        self.windows = [windows(v.hashes, rule.window) for v in views]
        self.sizes = {min(rule.window, len(v.hashes)) for v in views if len(v.hashes)}
        shared = Counter(h for w in self.windows for h in np.unique(w).tolist())
        naming = []
        for k, (v, w) in enumerate(zip(views, self.windows, strict=True)):
            left = spared(v, rule)
            for h, n in sorted(Counter(w.tolist()).items(), key=lambda x: (-shared[x[0]], x[0])):
                left -= n
                if left < 0:
                    naming.append((h, k))
        naming.sort()
        self.h = np.array([h for h, _ in naming], np.uint64)
        self.of = np.array([k for _, k in naming], np.int64)
        self.known = np.zeros(1 << 20, bool)
        self.known[(self.h >> np.uint64(44)).astype(np.int64)] = True

    def met(self, hashes: np.ndarray) -> dict[int, dict[int, set[int]]]:
        """By item and diagonal, the places in the item."""
        found: dict[int, dict[int, set[int]]] = defaultdict(lambda: defaultdict(set))
        for size in self.sizes:
            if len(hashes) < size:
                continue
            h = windows(hashes, size)
            some = h[self.known[(h >> np.uint64(44)).astype(np.int64)]]
            if not len(some):
                continue
            lo, hi = np.searchsorted(self.h, some, "left"), np.searchsorted(self.h, some, "right")
            named = {k for a, b in set(zip(lo.tolist(), hi.tolist(), strict=True)) for k in self.of[a:b].tolist() if min(self.window, len(self.views[k].hashes)) == size}
            if not named:
                continue
            order = np.argsort(h, kind="stable")
            ordered = h[order]
            for k in named:
                lo, hi = np.searchsorted(ordered, self.windows[k], "left"), np.searchsorted(ordered, self.windows[k], "right")
                for at in np.flatnonzero(hi > lo).tolist():
                    for p in order[lo[at] : hi[at]].tolist():
                        found[k][p - at].update(range(at, at + size))
        return found


def chains(diagonals: dict[int, set[int]], shift: int) -> Iterator[dict[int, int]]:
    """Alignments (place in the item to place in the document) over stretches of diagonals at most ``shift`` apart, in order in both."""
    runs = []
    for d, places in diagonals.items():
        q = np.array(sorted(places))
        runs += [(int(r[0]), int(r[-1]) + 1, d) for r in np.split(q, np.flatnonzero(np.diff(q) > 1) + 1)]
    runs.sort(key=lambda r: (r[0] + r[2], r[0]))
    top = max(r[1] for r in runs) + shift
    best: list[int] = []
    back: list[int | None] = []
    last: set[int] = set(range(len(runs)))
    for j, (a, b, d) in enumerate(runs):
        score, prior = b - a, None
        for i in range(j - 1, -1, -1):
            a2, b2, d2 = runs[i]
            if a + d - a2 - d2 > top:
                break
            if d2 != d and abs(d2 - d) <= shift and a2 < a and b2 < b and b2 + d2 < b + d:
                gain = b - max(a, b2, b2 + d2 - d)
                if best[i] + gain > score:
                    score, prior = best[i] + gain, i
        best.append(score)
        back.append(prior)
        last.discard(prior)
    for j in last:
        if back[j] is None:
            continue
        to: dict[int, int] = {}
        k: int | None = j
        steps = []
        while k is not None:
            steps.append(runs[k])
            k = back[k]
        done = end = -1
        for a, b, d in reversed(steps):
            for q in range(max(a, done, end - d), b):
                to[q] = q + d
            done, end = b, b + d
        yield to


class Items:
    """Benchmark items ready to be met."""

    def __init__(self, items: list[tuple[int | None, str | None]], rule: Rule):
        self.rule, self.t = rule, Templates()
        self.ids = [i for i, _ in items]
        read = [self.t(text) for _, text in items]
        self.words = [words for words, _ in read]
        self.tables = [Table([views[v] for _, views in read], rule) for v in range(2)]

    def leaks(self, text: str | None) -> list[tuple]:
        """(item index, covered words, coverage, longest run, consistency, slots that differ) of each leaked item."""
        words, views = self.t(text)
        best: dict[int, tuple] = {}
        for view, known in zip(views, self.tables, strict=True):
            for of, diagonals in known.met(view.hashes).items():
                for shift, places in diagonals.items():
                    self._score(best, of, known.views[of], words, view, {q: q + shift for q in places})
                if len(diagonals) > 1:
                    for to in chains(diagonals, self.rule.shift):
                        self._score(best, of, known.views[of], words, view, to)
        return [best[k] for k in sorted(best)]

    def _score(self, best: dict[int, tuple], of: int, item: View, words: list[str], view: View, to: dict[int, int]) -> None:
        n = len(self.words[of])
        covered = run = longest = plain = 0
        for q in range(len(item.kinds)):
            size = int(item.starts[q + 1] - item.starts[q])
            run = run + size if q in to else 0
            covered += size if q in to else 0
            longest = max(longest, run)
        if covered < self.rule.cover * n and longest < self.rule.run:
            return
        pairs = []
        for q in sorted(to):
            if item.kinds[q] == PLAIN:
                plain += 1
                continue
            (a, u), (b, v) = item.values(self.words[of], q), view.values(words, to[q])
            pairs += [(a, b), (u, v)] if u or v else [(a, b)]
        # mostly slots: a shared layout, unless most of their values are the same too
        if 2 * plain < len(to) and 2 * sum(a != b for a, b in pairs) > len(pairs):
            return
        stands: dict[str, Counter] = defaultdict(Counter)
        for a, b in pairs:
            stands[a][b] += 1
        even = sum(c.most_common(1)[0][1] for c in stands.values()) / len(pairs) if pairs else 1.0
        if even >= self.rule.consistent:
            row = (of, covered, covered / n, longest, even, sum(a != b for a, b in pairs))
            if of not in best or row[1:3] > best[of][1:3]:
                best[of] = row


_LEAKS = "doc_id long, text_hash long, item_id long, n_covered long, coverage double, longest_run long, consistency double, n_slots_changed long"


def _rows(b: pa.RecordBatch, of) -> pa.RecordBatch:
    out: list[tuple] = []
    for doc_id, h, text, items in zip(b.column("doc_id").to_pylist(), b.column("h").to_pylist(), b.column("text"), of(b), strict=True):
        out += [(doc_id, h, items.ids[k], *rest) for k, *rest in items.leaks(text.as_py())]
    types = [pa.int64()] * 4 + [pa.float64(), pa.int64(), pa.float64(), pa.int64()]
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], t) for k, t in enumerate(types)], names=[c.split()[0] for c in _LEAKS.split(", ")])


def leaks(docs: DataFrame, benchmark: DataFrame, rule: Rule = Rule()) -> DataFrame:
    """One row for each document and item it leaks; ``text_hash`` tells rows with one doc_id apart."""
    docs = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).withColumn("h", F.xxhash64("text"))
    items = benchmark.select(F.col("item_id").cast("long"), F.col("text").cast("string")).filter("text is not null").distinct()
    chars = items.agg(F.sum(F.length("text"))).first()[0] or 0
    if chars <= rule.max_item_chars:
        shared = docs.sparkSession.sparkContext.broadcast([tuple(r) for r in items.orderBy("item_id", "text").collect()])

        def lookup(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            known = Items(shared.value, rule)
            for b in batches:
                yield _rows(b, lambda b: [known] * b.num_rows)

        return docs.mapInArrow(lookup, _LEAKS)
    return _leaks_by_join(docs, items, rule)


def _leaks_by_join(docs: DataFrame, items: DataFrame, rule: Rule) -> DataFrame:
    """For benchmarks of any size: a shuffled join of window hashes names the items that a document has to be scored against."""

    def of_docs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = Templates()
        for b in batches:
            for doc_id, h, text in zip(*(b.column(c) for c in ("doc_id", "h", "text")), strict=True):
                for v, view in enumerate(t(text.as_py())[1]):
                    # items below a window's length are met by windows of their own length
                    parts = [windows(view.hashes, s) for s in range(1, rule.window + 1) if len(view.hashes) >= s]
                    w = np.unique(np.concatenate([np.empty(0, np.uint64), *parts])).view(np.int64)
                    yield pa.RecordBatch.from_arrays([pa.array([x.as_py()] * len(w), pa.int64()) for x in (doc_id, h)] + [pa.array(np.full(len(w), v)), pa.array(w)], names=["doc_id", "h", "v", "w"])

    def of_items(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = Templates()
        for b in batches:
            rows = []
            for item_id, ih, text in zip(*(b.column(c).to_pylist() for c in ("item_id", "ih", "text")), strict=True):
                for v, view in enumerate(t(text)[1]):
                    rows += [(item_id, ih, v, h, n, spared(view, rule)) for h, n in Counter(windows(view.hashes, rule.window).view(np.int64).tolist()).items()]
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], pa.int64()) for k in range(6)], names=["item_id", "ih", "v", "w", "places", "spared"])

    item_windows = items.withColumn("ih", F.xxhash64("text")).mapInArrow(of_items, "item_id long, ih long, v long, w long, places long, spared long")
    item_windows = written(item_windows, "leak-windows")
    shared = item_windows.groupBy("v", "w").agg(F.count("*").alias("n"))
    common = Window.partitionBy("item_id", "ih", "v").orderBy(F.desc("n"), "w")
    naming = item_windows.join(shared, ["v", "w"]).withColumn("before", F.sum("places").over(common)).filter("before > spared").select("item_id", "ih", "v", "w")
    doc_windows = docs.select("doc_id", "h", "text").mapInArrow(of_docs, "doc_id long, h long, v long, w long")
    met = doc_windows.join(naming, ["v", "w"]).select("doc_id", "h", "item_id", "ih").distinct()
    met = written(met, "leak-candidates")
    texts = items.withColumn("ih", F.xxhash64("text")).withColumnRenamed("text", "item_text").distinct()
    both = met.alias("m").join(texts.alias("i"), F.expr("m.item_id <=> i.item_id and m.ih = i.ih")).selectExpr("m.doc_id", "m.h", "i.item_id", "i.item_text")
    both = both.alias("m").join(docs.alias("d"), F.expr("m.doc_id <=> d.doc_id and m.h <=> d.h")).selectExpr("d.doc_id", "d.h", "d.text", "m.item_id", "m.item_text")

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield _rows(b, lambda b: [Items([(i, t)], rule) for i, t in zip(b.column("item_id").to_pylist(), b.column("item_text").to_pylist(), strict=True)])

    return both.mapInArrow(score, _LEAKS)


def op1_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return out.select("doc_id", "item_id", "n_covered", F.round("coverage", 6).alias("coverage"), "longest_run", F.round("consistency", 6).alias("consistency"), "n_slots_changed")
