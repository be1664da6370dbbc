"""Nulls, repeated rows, ties, very long texts, empty tables and clashing columns, where other tests do not have them."""

import hashlib
import random
import re

import numpy as np
from pyspark.sql import functions as F

import corpus_pipeline
from tremor.llm import language_id, line_dedup, near_copies, packing, quality_rules, secret_scan, simhash, token_files, toxicity
from tremor.llm.tokens import Encoder
from tremor.operators.components import connected_components

rng = random.Random(23)
NAMES = ("h", "t", "w", "n", "key", "kind", "spans", "base", "all", "gone", "_t", "lines", "score", "term", "toxic", "at", "name", "shard", "fp", "least", "u", "v")


def clashing(df, *but):
    return df.select("*", *(F.lit(7).alias(c) for c in NAMES if c not in but and c not in df.columns))


def test_secret_scan_long_and_repeated(spark):
    letters = secret_scan.LOWER + secret_scan.UPPER + secret_scan.DIGITS
    key = "".join(rng.choice(letters) for _ in range(60_000))
    many = " ".join("token=" + "".join(rng.choice(letters) for _ in range(14)) for _ in range(1500))
    rows = [(1, key), (1, key), (2, many), (None, None), (None, "x"), (3, "z" * 50_000), (4, "deadbeef" * 4000)]
    got = secret_scan.secret_spans(clashing(spark.createDataFrame(rows, "doc_id long, text string"))).select("doc_id", secret_scan.joined("base").alias("b"), secret_scan.joined("spans").alias("s")).collect()
    by = {}
    for r in got:
        by.setdefault(r.doc_id, []).append((r.b, r.s))
    assert by[1] == [("", "entropy_base64:0:60000")] * 2 and by[None] == [("", "")] * 2 and by[3] == [("", "")] and by[4] == [("hex:0:32000", "hex:0:32000")]
    want = ",".join(f"assign:{m.start()}:{m.end()}" for m in re.finditer(r"token=[A-Za-z0-9]{14}", many))
    assert by[2][0][0] == want and len(want.split(",")) == 1500


def test_running_sums_over_blocks(spark):
    for n in (0, 1, secret_scan._BLOCK, secret_scan._BLOCK * 3 + 5):
        df = spark.range(1).select(F.expr(f"transform(sequence(1, {n}), x -> x * 3)" if n else "cast(array() as array<bigint>)").cast("array<bigint>").alias("v"))
        got = df.select(secret_scan.running(F.col("v"), 0, lambda a, x: a + x)).first()[0]
        assert got == [3 * k * (k + 1) // 2 for k in range(n)]


def test_toxicity_edges(spark):
    df = spark.createDataFrame([(i, "you blargh" if i % 3 == 0 else "a river", int(i % 3 == 0)) for i in range(90)], "doc_id long, text string, toxic int")
    model = toxicity.fit(clashing(df, "toxic"), clashing(df.select("doc_id", "toxic"), "toxic"))
    rows = [(1, "paper. blargh, blargh"), (1, "paper. blargh, blargh"), (None, None), (2, "glass. " * 30_000 + "you blargh"), (3, "blargh" * 20_000)]
    got = {}
    for r in toxicity.toxicity(clashing(spark.createDataFrame(rows, "doc_id long, text string")), model).collect():
        got.setdefault(r.doc_id, []).append(r)
    # of clauses that score alike the first is the top one
    assert [(r.n_clauses, r.top_clause) for r in got[1]] == [(2, 1)] * 2 and got[1][0].score == got[1][1].score
    assert got[None][0].top_clause == -1 and got[2][0].top_clause == 30_000 and 0 <= got[3][0].score <= 1


def test_line_dedup_edges(spark):
    common = [f"common {i}" for i in range(400)]
    rows = [(None, "\n".join([f"own {i}", *common, f"own {i}"])) for i in range(12)] + [(5, "one\nCOMMON 3 \n"), (5, "two\ncommon 3"), (5, "two\ncommon 3"), (6, ""), (6, None)]
    got = sorted((str(r.doc_id), r.text, r.n_lines, r.n_dropped) for r in line_dedup.line_dedup(clashing(spark.createDataFrame(rows, "doc_id long, text string"))).collect())
    want = [("None", f"own {i}\nown {i}", 402, 400) for i in range(12)] + [("5", "one\n", 3, 1), ("5", "two", 2, 1), ("5", "two", 2, 1), ("6", "", 1, 0), ("6", "", 1, 0)]
    assert got == sorted(want)
    # repeated rows are documents of their own
    ten = spark.createDataFrame([(1, "same line")] * 10, "doc_id long, text string")
    assert [r.n_dropped for r in line_dedup.line_dedup(ten).collect()] == [1] * 10


def test_quality_long(spark):
    text = " ".join(f"w{i}" for i in range(120_000))
    r = quality_rules.ledger(clashing(spark.createDataFrame([(1, text), (1, text)], "doc_id long, text string"))).collect()
    assert [(x.n_words, x.n_repeat_words, x.word_chars) for x in r] == [(120_000, 0, sum(len(w) for w in text.split()))] * 2


def test_null_components(spark):
    far = 0x0F0F_0F0F_0F0E_0000
    df = spark.createDataFrame([(None, 0), (None, 1), (4, far), (9, far + 1), (None, -1)], "doc_id long, fp long")
    got = sorted((r.fp, r.component_id) for r in simhash.simhash_components(clashing(df, "fp")).select("fp", "component_id").collect())
    assert got == [(-1, None), (0, None), (1, None), (far, 4), (far + 1, 4)]


def test_dense_bucket_in_tiles(spark):
    prints = sorted({(1 << i) | (1 << j) for i in range(40) for j in range(40)})
    df = spark.createDataFrame([(p,) for p in prints], "fp long")
    for most in (5, 10_000):
        parts = {r.node: r.component for r in connected_components(simhash.links(df, 2, 4, most)).collect()}
        assert {parts[p] for p in prints} == {min(prints)}


def test_keys_over_a_shard_border(spark, tmp_path):
    rows = [(None, f"text {i % 40}") for i in range(150)] + [(7, f"text {i}") for i in range(150)]
    df = clashing(spark.createDataFrame(rows, "doc_id long, text string").repartition(3))
    uri = str(tmp_path / "ids")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        manifest = token_files.write_tokens(df, uri)
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert manifest.count() > 1
    enc = Encoder("byte_bpe_50k.json", 1000)
    got = token_files.read_tokens(manifest, uri).collect()
    assert sum(r.n_tokens for r in got) == sum(len(enc.encode(t)) + 1 for _, t in rows) and len(got) == 300
    at = 0
    for r in sorted(got, key=lambda r: r.start):
        assert r.start == at
        at += r.n_tokens
    reader = token_files.TokenReader(uri, manifest.collect(), most=1)
    seen = {tuple(reader.get(7, k).tolist()) for k in range(3)}
    assert seen <= {tuple(np.append(enc.encode(t), 0).tolist()) for _, t in rows} and reader.get(8) is None and len(reader.open) == 1


def test_near_copies_recall(spark):
    """All pairs by brute force against the links of the operator."""
    vocabulary = [f"w{i}" for i in range(3000)]
    texts = []
    for _ in range(60):
        base = [rng.choice(vocabulary) for _ in range(rng.randint(8, 300))]
        texts.append(base)
        for _ in range(3):
            other = list(base)
            for _ in range(rng.randint(0, max(1, len(base) // 40))):
                k = rng.randrange(len(other))
                other[k : k + rng.randint(0, 2)] = [rng.choice(vocabulary)] * rng.randint(0, 2)
            texts.append(other)
    sets = [{tuple(t[k : k + 5]) for k in range(max(1, len(t) - 4))} for t in texts]
    pairs = [(i, j) for i in range(len(sets)) for j in range(i) if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])]
    prints = near_copies.signatures(spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)], "doc_id long, text string"))
    label = {r.node: r.component for r in connected_components(near_copies.links(prints)).collect()}
    ids = {r.doc_id: label.get(r.id, r.id) for r in prints.collect()}
    found = sum(ids[i] == ids[j] for i, j in pairs)
    assert len(pairs) > 60 and found >= 0.99 * len(pairs)
    # nothing is linked that brute force would not reach
    reach = list(range(len(texts)))
    for i, j in pairs:
        a, b = reach[i], reach[j]
        reach = [a if x == b else x for x in reach]
    assert all(reach[i] == reach[j] for i in range(len(texts)) for j in range(i) if ids[i] == ids[j])


def test_pipeline_edges(spark, tmp_path):
    words = {"aa": "the and of with from that was have ship lake".split(), "bb": "der und die von mit das war haben haus baum".split()}
    say = lambda lang, n: " ".join(rng.choice(words[lang]) + rng.choice("klmnprst") + str() for _ in range(n))
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    rows = [(i, say("aa" if i % 2 else "bb", 60), ("aa" if i % 2 else "bb") if i % 5 else None, None, None) for i in range(30)]
    rows += [rows[3], rows[3], (None, say("aa", 50), None, "s", 1), (None, say("aa", 50), None, "s", 1), (None, None, None, None, None)]
    bench = spark.createDataFrame([(1, "nothing like it stands in any of these texts at all")], "item_id long, text string")
    for name, data in (("some", rows), ("none", [])):
        at = f"{tmp_path}/{name}"
        clashing(spark.createDataFrame(data, schema), "n_chars").write.parquet(f"{at}/documents.parquet")
        clashing(bench).write.parquet(f"{at}/benchmark.parquet")
        docs = spark.read.parquet(f"{at}/documents.parquet")
        for _, stage in corpus_pipeline.STAGES[:-1]:
            docs = stage(spark, docs, at)
            assert docs.columns == corpus_pipeline.COLUMNS
        kept = docs.collect()
        # one of the repeated rows stays, and all different rows without an id
        assert len(kept) == (32 if data else 0)
        placed = corpus_pipeline.run(spark, at)
        assert sum(r.length for r in placed.collect()) == sum(len(Encoder("byte_bpe_50k.json", 100).encode(r.text)) + 1 for r in kept)


def test_language_room(spark, monkeypatch):
    """Words that are forgotten and asked for again score as before."""
    words = ["".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 6))) for _ in range(400)]
    train = spark.createDataFrame([(i, " ".join(rng.choice(words) + "xy"[i % 2] for _ in range(50)), "ab"[i % 2]) for i in range(40)], "doc_id long, text string, lang string")
    model = language_id.fit(train)
    texts = [" ".join(rng.choice(words) + rng.choice("xyz") for _ in range(rng.randint(1, 300))) for _ in range(60)]
    want = [language_id.Scorer(model)(t) for t in texts]
    monkeypatch.setattr(language_id, "_ROOM", 24)
    monkeypatch.setattr(language_id, "_PART", 16)
    small = language_id.Scorer(model)
    got = [small(t) for t in texts]
    assert [g[0] for g in got] == [w[0] for w in want] and np.allclose([g[1] for g in got], [w[1] for w in want])


def test_encoder_tails():
    enc = Encoder("byte_bpe_50k.json", 40)
    marks = [".", ",", "!!", "$$$", "'", "_", "...", "?!", "\"", "’", "é.", "1.", "-"]
    texts = [" ".join(rng.choice(["stone", "Über", "naïve", "x", "token's", "don't", "中文", "a1", ""]) + rng.choice(marks) for _ in range(rng.randint(1, 30))) for _ in range(400)]
    for lo in range(0, 400, 50):
        for t, raw in zip(texts[lo : lo + 50], enc.encode_many(texts[lo : lo + 50]), strict=True):
            assert np.frombuffer(raw, "<u4").tolist() == enc.tokenizer.encode(t, add_special_tokens=False).ids
