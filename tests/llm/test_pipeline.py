"""The pipeline against a brute-force version of its stages."""

import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tremor.llm.simhash import simhash
from tremor.llm.tokens import Encoder

WS = " \t\n\x0b\x0c\r"
rng = random.Random(3)
LANGS = {"aa": "the and of with from that was have ship lake".split(), "bb": "der und die von mit das war haben haus baum".split()}
LINE = "Copyright by nobody"
ITEM = "Wide rivers carry old boats past nine quiet towns while seven tired sailors sing about distant golden harbours."


def say(lang, n):
    return " ".join(rng.choice(LANGS[lang]) + rng.choice(["", rng.choice("klmnprst") + rng.choice("aeiou")]) for _ in range(n))


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    rows = []
    for i in range(60):
        lang = rng.choice(["aa", "bb"])
        text = say(lang, rng.randint(40, 90)) + ("\n" + LINE if i % 4 == 0 else "") + ("\n" + ITEM + "\n" + say(lang, 9) if i % 15 == 7 else "")
        rows.append((i, text, lang, f"s{i % 3}", len(text)))
    near = rows[3][1].split(" ")
    near[20] = "changed"
    rows += [(70, rows[2][1], "aa", "s", 1), (71, " ".join(near), rows[3][2], "s", 1), (72, "12 34 ..", "aa", "s", 1), (73, None, "aa", "s", None), (74, LINE, "aa", "s", 1), (None, say("bb", 50), "bb", "s", 1)]
    at = tmp_path_factory.mktemp("sf")
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{at}/documents.parquet")
    spark.createDataFrame([(1, ITEM)], "item_id long, text string").write.parquet(f"{at}/benchmark.parquet")
    return str(at), rows


def brute(rows):
    kept = [(i, t) for i, t, *_ in rows if t and re.search(r"[^\W\d_]", t)]
    norm = lambda s: s.strip(WS).lower()
    n = Counter(k for _, t in kept for k in {norm(x) for x in t.split("\n")})
    gone = {k for k, c in n.items() if c >= 10 and k}
    kept = [(i, "\n".join(x for x in t.split("\n") if norm(x) not in gone), t) for i, t in kept]
    kept = [(i, t) for i, t, before in kept if t or t == before]
    group, out = [], []
    for i, t in sorted(kept, key=lambda r: (r[0] is None, r[0] or 0)):
        f = simhash(t)
        if len(t.split()) >= 20 and any(bin(f ^ g).count("1") <= 6 for g in group):
            continue
        group.append(f)
        out.append((i, t))
    return [(i, t) for i, t in out if ITEM not in t]


def test_stages(spark, folder):
    at, rows = folder
    want = brute(rows)
    docs = spark.read.parquet(f"{at}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, at)
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"], name
    got = sorted(((r.doc_id, r.text) for r in docs.collect()), key=str)
    assert got == sorted(want, key=str)
    assert docs.filter(F.col("n_chars") != F.length("text")).count() == 0


def test_run(spark, folder):
    at, rows = folder
    enc = Encoder("byte_bpe_50k.json", 1000)
    want = {i: np.append(enc.encode(t), 0).astype("<u4") for i, t in brute(rows)}
    got = corpus_pipeline.run(spark, at).collect()
    assert {(r.doc_id, r.length, r.ids_crc32) for r in got} == {(i, len(x), zlib.crc32(x.tobytes())) for i, x in want.items()}
    fill = Counter()
    for r in got:
        fill[r.sequence_id] += r.length
    assert max(fill.values()) <= 2048 and len(fill) == -(-sum(fill.values()) // 2048)
