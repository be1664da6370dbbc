"""Operators without SQL against plain versions of what they compute."""

import math
import random
import re
import zlib
from collections import Counter, defaultdict
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from tremor.llm import decontaminate, language_id, packing, suffix_dedup, toxicity
from tremor.llm.tokens import Encoder

rng = random.Random(11)
SMALL = Path("/root/testdata/sf0.01")


# --- op1 ------------------------------------------------------------------------------------------------------------

NOUNS = "apples pears boats lamps chairs maps coins books keys bells rings stones".split()
VERBS = "buys sells finds loses paints carries counts drops hides shows".split()
NAMES = ["Ann", "Bob", "Carla", "Dmitri", "Eve", "Farid"]
FILL = "and then the quiet old river near a small town where nobody ever asked about it again".split()


def item():
    who = rng.sample(NAMES, 2)
    parts = [f"when {w} {rng.choice(VERBS)} {rng.randint(2, 99)} {rng.choice(NOUNS)} and {rng.randint(2, 9)} kg of {rng.choice(NOUNS)}" for w in who]
    return f"so {', '.join(parts)}, how many {rng.choice(NOUNS)} does {who[0]} have after {rng.randint(2, 9)} days?"


def asked_anew(text):
    names = dict(zip(NAMES, rng.sample(NAMES, len(NAMES)), strict=True))
    numbers = defaultdict(lambda: str(rng.randint(2, 99)))
    out = [names.get(w.strip(",?"), None) for w in text.split()]
    return " ".join(w.replace(w.strip(",?"), o) if o else re.sub(r"\d+", lambda m: numbers[m[0]], w) for w, o in zip(text.split(), out, strict=True))


def plain_leaks(text, items, rule):
    """All windows against all windows; alignments on one diagonal only."""
    t = decontaminate.Templates()
    words, views = t(text)
    out = {}
    for k, (item_id, item_text) in enumerate(items):
        item_words, item_views = t(item_text)
        for mine, theirs in zip(views, item_views, strict=True):
            size = min(rule.window, len(theirs.hashes))
            if not size:
                continue
            diagonals = defaultdict(set)
            for p in range(len(mine.hashes) - size + 1):
                for q in range(len(theirs.hashes) - size + 1):
                    if (mine.hashes[p : p + size] == theirs.hashes[q : q + size]).all():
                        diagonals[p - q].update(range(q, q + size))
            for d, places in diagonals.items():
                sizes = [int(theirs.starts[q + 1] - theirs.starts[q]) for q in range(len(theirs.kinds))]
                covered = sum(sizes[q] for q in places)
                run = longest = 0
                for q, n in enumerate(sizes):
                    run = run + n if q in places else 0
                    longest = max(longest, run)
                if covered < rule.cover * len(item_words) and longest < rule.run:
                    continue
                pairs, slots = [], 0
                for q in sorted(places):
                    if theirs.kinds[q]:
                        slots += 1
                        (a, u), (b, v) = theirs.values(item_words, q), mine.values(words, q + d)
                        pairs += [(a, b), (u, v)] if u or v else [(a, b)]
                if 2 * slots > len(places) and 2 * sum(a != b for a, b in pairs) > len(pairs):
                    continue
                stands = defaultdict(Counter)
                for a, b in pairs:
                    stands[a][b] += 1
                if sum(max(c.values()) for c in stands.values()) < rule.consistent * len(pairs):
                    continue
                out[k] = max(out.get(k, (0.0, 0)), (covered / len(item_words), longest))
    return {(items[k][0], round(c, 9), n) for k, (c, n) in out.items()}


def test_leaks_against_all_windows(spark):
    shared = "so when Ann buys 5 apples and 3 kg of pears"  # a phrase that many items begin with
    items = [(i, item()) for i in range(25)] + [(100 + i, f"{shared}, {' '.join(rng.sample(FILL, 9))}") for i in range(12)] + [(200, "how many lamps"), (None, item()), (3, None)]
    fill = lambda n: " ".join(rng.choice(FILL) for _ in range(n))
    docs = []
    for i in range(90):
        body = rng.choice([x for _, x in items if x])
        kind = i % 6
        middle = [body, asked_anew(body), " ".join(body.split()[: rng.randint(6, 16)]), shared, fill(20), body.replace(" and ", " but ", 1)][kind]
        docs.append((i if i % 17 else None, f"{fill(rng.randint(0, 40))} {middle} {fill(rng.randint(0, 40))}"))
    docs += [docs[0], docs[0], (500, " ".join([shared] * 300)), (501, None), (502, "")]
    rule = decontaminate.Rule(shift=0)
    known = [(i, t) for i, t in items if t]
    want = sorted((str(d), str(h), str(x), c, n) for d, text in docs for x, c, n in plain_leaks(text, known, rule) for h in [zlib.crc32((text or "").encode())])
    assert len(want) > 60
    df = spark.createDataFrame(docs, "doc_id long, text string").withColumn("h", F.lit("x")).withColumn("item_id", F.lit(1)).withColumn("w", F.lit(1))
    # an item row that is repeated counts once, in both ways
    bench = spark.createDataFrame(items + items[:5], "item_id long, text string").withColumn("ih", F.lit(0))
    texts = {r.h: zlib.crc32((r.text or "").encode()) for r in df.select(F.xxhash64("text").alias("h"), "text").collect()}
    for r in (rule, decontaminate.Rule(shift=0, max_item_chars=0)):
        rows = decontaminate.leaks(df, bench, r).collect()
        got = sorted((str(x.doc_id), str(texts[x.text_hash]), str(x.item_id), round(x.coverage, 9), x.longest_run) for x in rows)
        if r.max_item_chars:
            assert got == want
        else:
            # the join meets a text once, however often it is repeated
            assert set(got) == set(want)
    both = [sorted(map(str, set(decontaminate.leaks(df, bench, r).collect()))) for r in (decontaminate.Rule(), decontaminate.Rule(max_item_chars=0))]
    assert both[0] == both[1]


# --- op2 ------------------------------------------------------------------------------------------------------------


def test_family_meets_new_batches(spark):
    noise = lambda n: "".join(rng.choice("abcdefgh ij") for _ in range(n))
    p, q = noise(700), noise(600)
    texts = [(i, noise(300) + (p if i % 3 == 0 else "") + noise(200) + (q if i % 4 == 1 else "")) for i in range(24)]
    docs = suffix_dedup.keyed(spark.createDataFrame(texts, "doc_id long, text string"))
    rows = suffix_dedup.written(suffix_dedup.suffix_rows(docs), "rows")
    family = suffix_dedup.SuffixFamily(spark)
    family.add(rows.filter("doc_id < 12"))
    for lo, hi in ((12, 18), (18, 24)):
        family = suffix_dedup.SuffixFamily(spark, **family.saved())
        family.add(rows.filter(f"doc_id >= {lo} and doc_id < {hi}"))
    assert sorted(size for size, _ in family.levels) == [0, 1]
    got = {r.doc_id: r for r in suffix_dedup.removed(docs, suffix_dedup.repeats_in(docs, rows, family)).collect()}
    whole = {r.doc_id: r for r in suffix_dedup.substring_dedup(docs).collect()}
    assert got == whole and sum(r.n_removed > 0 for r in got.values()) == 12


def test_chunk_border(spark, monkeypatch):
    noise = lambda n: "".join(rng.choice("abcdefgh ij") for _ in range(n))
    p = noise(900)
    texts = [(1, noise(suffix_dedup._CHUNK - 500) + p + noise(300)), (2, noise(50) + p), (3, " ".join("abc" for _ in range(suffix_dedup._CHUNK // 3)))]
    got = {r.doc_id: r for r in suffix_dedup.substring_dedup(spark.createDataFrame(texts, "doc_id long, text string")).collect()}
    assert [(got[i].n_removed, got[i].n_spans) for i in (1, 2)] == [(900, 1)] * 2 and got[3].n_removed == len(texts[2][1]) and got[3].n_passages == 0


def test_passages_of_other_documents(spark):
    words = lambda n: [rng.choice("abcdefghij") + rng.choice("klmnopqrst") + str(rng.randrange(1000)) for _ in range(n)]
    shared, own = words(58), words(60)
    long = ["longer" + w * 9 for w in shared]
    texts = [(i, words(rng.randint(0, 80)) + (shared[rng.randint(0, 4) : 58 - rng.randint(0, 4)] if i % 2 else []) + words(rng.randint(0, 80))) for i in range(20)]
    texts += [(30, own + own), (31, shared[:50]), (32, long), (33, long), (34, words(10) + shared + words(5) + shared)]
    counts = defaultdict(set)
    for i, w in texts:
        for k in range(len(w) - 50):
            counts[tuple(w[k : k + 51])].add(i)
    want = {}
    for i, w in texts:
        cover = [False] * len(w)
        for k in range(len(w) - 50):
            if len(counts[tuple(w[k : k + 51])]) > 1:
                cover[k : k + 51] = [True] * 51
        want[i] = (sum(c and not (k and cover[k - 1]) for k, c in enumerate(cover)), sum(cover))
    for most in (suffix_dedup.MOST, 2):
        got = suffix_dedup.substring_dedup(spark.createDataFrame([(i, "\t".join(w)) for i, w in texts], "doc_id long, text string"), most=most)
        assert {r.doc_id: (r.n_passages, r.n_passage_words) for r in got.collect()} == want
    assert want[30] == (0, 0) and want[31] == (0, 0) and want[32][0] == 1


# --- op3 ------------------------------------------------------------------------------------------------------------


def slow_sum_of_squares(lengths, capacity):
    bins, place = [], []
    for s in lengths:
        gaps = Counter(capacity - sum(b) for b in bins if sum(b) < capacity)
        best = None
        for g in [g for g in sorted(gaps) if g >= s] or [capacity]:
            after = gaps.copy()
            if g in gaps:
                after[g] -= 1
            if g > s:
                after[g - s] += 1
            cost = sum(v * v for v in after.values())
            if best is None or cost < best[0]:
                best = (cost, g)
        if best[1] in gaps:
            k = next(j for j, b in enumerate(bins) if capacity - sum(b) == best[1])
        else:
            bins.append([])
            k = len(bins) - 1
        bins[k].append(s)
        place.append(k)
    return sorted(sum(b) for b in bins)


def test_sum_of_squares_rule():
    for capacity in (8, 31):
        lengths = sorted((rng.randint(1, capacity) for _ in range(120)), reverse=True)
        place, offset, fill = packing.sum_of_squares(np.array(lengths), capacity)
        bins = defaultdict(int)
        for k, s in zip(place.tolist(), lengths, strict=True):
            bins[k] += s
        assert sorted(bins.values()) == sorted(fill.tolist()) == slow_sum_of_squares(lengths, capacity) and fill.max() <= capacity


def test_packing_in_shares(spark):
    rng = random.Random(3)  # the same texts whatever ran before
    texts = [(i, " ".join(rng.choice(FILL) for _ in range(rng.randint(0, 60)))) for i in range(300)] + [(7, "again"), (7, "again"), (None, None), (None, "x"), (400, "river " * 400)]
    df = spark.createDataFrame(texts, "doc_id long, text string").withColumn("length", F.lit(3)).withColumn("bin", F.lit("b"))
    enc, capacity = Encoder("byte_bpe_50k.json", 1000), 64
    got = packing.pack(packing.token_pieces(df, capacity), capacity, share=120).collect()  # many tasks, and a second round
    want = Counter()
    for i, t in texts:
        ids = np.append(enc.encode(t), 0).astype("<u4")
        n, k = len(ids), 0
        while n:
            size = n % capacity or capacity
            start = len(ids) - n
            want[i, k, start, size, zlib.crc32(ids[start : start + size].tobytes())] += 1
            n, k = n - size, k + 1
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got) == want
    bins = defaultdict(list)
    for r in got:
        bins[r.sequence_id].append((r.offset, r.length))
    for parts in bins.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= capacity
    least = -(-sum(r.length for r in got) // capacity)
    # a share may leave one sequence with room
    assert len(bins) <= 1.05 * least + -(-len(got) // 120), (len(bins), least)


# --- op4 ------------------------------------------------------------------------------------------------------------

ALPHABETS = {"aa": "abcdef", "bb": "cdefgh", "cc": "éfghij"}


def test_language_scores(spark):
    say = lambda lang, n: " ".join("".join(rng.choice(ALPHABETS[lang]) for _ in range(rng.randint(1, 4))) for _ in range(n))
    train = [(i, say(lang, rng.randint(5, 60)), lang) for i, lang in enumerate(["aa", "bb", "cc", "aa"] * 15)] + [(90, "zz zz", "only"), (91, None, "aa"), (92, "ab ab", None)]
    words, grams = Counter(), Counter()
    for _, t, lang in train:
        if t and lang in ALPHABETS:
            words.update((w, lang) for w in re.findall(r"[^\W\d_]+", t.lower()))
    for w, lang in words:
        for o in (5, 4, 3, 2, 1):
            s = f"^{w}$" if o > 1 else w
            grams.update((o, s[k : k + o], lang) for k in range(len(s) - o + 1))
    langs = sorted(ALPHABETS)
    total_words = {g: sum(n for (_, x), n in words.items() if x == g) for g in langs}
    total_grams = {(o, g): sum(n for (p, _, x), n in grams.items() if (p, x) == (o, g)) for o in range(1, 6) for g in langs}
    n_words, n_grams = Counter(), Counter()
    for (w, _), n in words.items():
        n_words[w] += n
    for (o, g, _), n in grams.items():
        n_grams[o, g] += n

    def score(t):
        found = re.findall(r"[^\W\d_]+", (t or "").lower())
        if not found:
            return "und", 0.0
        log = dict.fromkeys(langs, 0.0)
        for w in found:
            if n_words[w] >= 2:
                for g in langs:
                    log[g] += math.log((words[w, g] + 0.5) / (total_words[g] + 1))
                continue
            for o in (5, 4, 3, 2, 1):
                s = f"^{w}$" if o > 1 else w
                known = [s[k : k + o] for k in range(len(s) - o + 1) if n_grams[o, s[k : k + o]] >= 2]
                if known:
                    for g in langs:
                        log[g] += sum(math.log((grams[o, x, g] + 0.5) / (total_grams[o, g] + 1)) for x in known) / len(known)
                    break
        top = max(log.values())
        p = {g: math.exp(v - top) for g, v in log.items()}
        best = max(langs, key=lambda g: log[g])
        return best, p[best] / sum(p.values())

    asked = [(i, say(rng.choice(langs), rng.randint(1, 6))) for i in range(60)] + [(70, "ab" * 40), (71, "12"), (72, None), (None, "ÉF éf"), (73, "zz"), (73, "zz"), (74, "ab cd " * 9000)]
    df = spark.createDataFrame(asked, "doc_id long, text string").withColumn("score", F.lit(9)).withColumn("word", F.lit("w")).withColumn("n", F.lit(1)).withColumn("lang", F.lit("bb"))
    known = spark.createDataFrame(train, "doc_id long, text string, lang string").withColumn("o", F.lit(1)).withColumn("total", F.lit(1))
    got = sorted((str(r.doc_id), r.lang_pred, round(r.score, 9)) for r in language_id.identify(df, language_id.fit(known)).select("doc_id", "lang_pred", F.col("score")).collect())
    assert got == sorted((str(i), score(t)[0], round(score(t)[1], 9)) for i, t in asked)


@pytest.mark.skipif(not SMALL.exists(), reason="needs the tables")
def test_held_out_languages(spark):
    docs = spark.read.parquet(str(SMALL / "documents.parquet"))
    out = language_id.op4_language_id(spark, str(SMALL)).join(docs.select("doc_id", "lang"), "doc_id").filter("held_out and lang is not null and lang_pred <> 'und'")
    n, right = out.agg(F.count("*"), F.count(F.when(F.col("lang") == F.col("lang_pred"), 1))).first()
    assert n > 100 and right >= 0.97 * n


# --- op8 ------------------------------------------------------------------------------------------------------------


def test_clause_scores_one_transducer_after_the_other():
    T = toxicity
    lexicon = {"idiot": (T.ABUSE, 2.0), "fool": (T.ABUSE, 3.5), "kill": (T.VIOLENCE, 2.0), "maul": (T.VIOLENCE, 4.0), "you": (T.TARGET, 2.0), "him": (T.TARGET, 2.0), "not": (T.NEGATION, 2.0), "said": (T.REPORT, 2.0)}
    model = T.Model(lexicon, {"idio": 2.5}, [1.0, 0.5, 0.25, -3.0])
    g = T.Grammar(model)
    vocabulary = [*lexicon, "idiotic", "paper", "glass", "of", "the"]

    def slow(clause):
        symbols = []
        for w in re.findall(r"[^\W\d_]+", clause.lower()):
            s = lexicon.get(w)
            if (s is None or s[0] not in (T.ABUSE, T.VIOLENCE)) and w.startswith("idio"):
                s = (T.ABUSE, 2.5)
            symbols.append(s or (T.OTHER, 0.0))
        weights = [1.0] * len(symbols)
        row = [s for s, _ in symbols]
        for t in (T.insult(), T.threat(), T.target(), T.negation(), T.reported()):
            state = t.start
            for i, s in enumerate(row):
                state, row[i], f = t.step(state, s)
                weights[i] *= f
        best, held = 0.0, 0.0
        for (c, w), out, f in zip(symbols, row, weights, strict=True):
            if c == T.VIOLENCE:
                held = max(held, w)
            if out == T.INSULT:
                best = max(best, w * f)
            elif out == T.THREAT:
                best, held = max(best, held * f), 0.0
        return best

    for _ in range(400):
        text = "".join(" ".join(rng.choice(vocabulary) for _ in range(rng.randint(0, 12))) + rng.choice([". ", ", ", "\n"]) for _ in range(rng.randint(0, 6)))
        parts = re.split(r"[.!?;:,\n]+", text.lower()) if text else []
        want = [slow(p) for p in parts]
        assert [s for _, s in g.clauses(text)] == pytest.approx(want)
        hits = [s for s in want if s]
        x = [max(hits, default=0.0), math.log1p(sum(hits)), 10 * len(hits) / (len(want) + 10)]
        assert g.score(text) == pytest.approx(1 / (1 + math.exp(-(x[0] + 0.5 * x[1] + 0.25 * x[2] - 3.0))))


@pytest.mark.skipif(not SMALL.exists(), reason="needs the tables")
def test_held_out_toxicity(spark):
    labels = spark.read.parquet(str(SMALL / "labels.parquet")).select("doc_id", "toxic")
    out = toxicity.op8_toxicity(spark, str(SMALL)).join(labels, "doc_id").filter("held_out")
    n, right = out.agg(F.count("*"), F.count(F.when(F.col("toxic") == F.col("predicted"), 1))).first()
    assert n > 50 and right >= 0.93 * n
