"""The near-duplicate stage against brute force."""

import random

import numpy as np

from tremor.llm import near_copies, simhash

rng = random.Random(11)


def words(n):
    return [rng.choice("bcdfghklmnprst") + rng.choice("aeiou") + rng.choice("bcdfghklmnprst") + rng.choice("aeiou") for _ in range(n)]


def frame(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string")


def test_null_ids_are_not_one_group(spark):
    texts = [" ".join(words(40)) for _ in range(5)]
    kept = simhash.keep_one(frame(spark, [(None, t) for t in texts] + [(None, texts[0])])).collect()
    assert sorted(r.text for r in kept) == sorted(texts)


def shingle_set(text):
    w = text.lower().split()
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()


def similarity(a, b):
    a, b = shingle_set(a), shingle_set(b)
    return len(a & b) / len(a | b) if a or b else 1.0


def edited(text, k):
    """``k`` scattered words changed, or as many put at the end, or as many taken out in one block."""
    w = text.split()
    how = rng.randrange(3)
    if how == 0:
        for i in rng.sample(range(len(w)), k):
            w[i] = words(1)[0]
    elif how == 1:
        w += words(5 * k)
    else:
        at = rng.randrange(len(w) - 5 * k)
        del w[at : at + 5 * k]
    return " ".join(w)


def groups_kept(texts, least_words=0):
    """Places of the first member of each component of pairs at 0.8 and more."""
    label = list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            short = min(len(texts[i].split()), len(texts[j].split())) < least_words
            if texts[i] == texts[j] or not short and similarity(texts[i], texts[j]) >= 0.8:
                a, b = label[i], label[j]
                label = [min(a, b) if x in (a, b) else x for x in label]
    return sorted(set(label))


def test_pairs_near_the_border(spark):
    texts = []
    for n in (40, 80, 200, 500):
        for _ in range(10):
            base = " ".join(words(n))
            texts += [base] + [edited(base, max(1, round(f * n))) for f in (0.01, 0.02, 0.025, 0.04)]
    rng.shuffle(texts)
    kept = [r.doc_id for r in simhash.keep_one(frame(spark, list(enumerate(texts)))).collect()]
    assert sorted(kept) == groups_kept(texts, 20)


def test_tiles(spark):
    base = [" ".join(words(60)) for _ in range(3)]
    texts = [edited(b, 1) for b in base for _ in range(12)]
    prints = near_copies.signatures(frame(spark, list(enumerate(texts)))).cache()
    ids = {r.id: r.doc_id for r in prints.collect()}
    whole, dealt = ({(ids[r.u], ids[r.v]) for r in near_copies.links(prints, most=m).collect()} for m in (2048, 3))
    for edges in (whole, dealt):
        assert all(similarity(texts[u], texts[v]) >= 0.8 for u, v in edges)
        label = list(range(len(texts)))
        for u, v in edges:
            a, b = label[u], label[v]
            label = [min(a, b) if x in (a, b) else x for x in label]
        assert sorted(set(label)) == groups_kept(texts)


def test_short_texts(spark):
    base = [words(n) for n in (4, 5, 7, 8, 13, 18, 19, 19)]
    texts = [" ".join(w) for w in base]
    texts += [" ".join([*w, "2024"]) for w in base] + [" ".join([*w[:-1], "other"]) for w in base] + ["", " ", "!"]
    kept = [r.doc_id for r in simhash.keep_one(frame(spark, list(enumerate(texts)))).collect()]
    want = groups_kept([" ".join(t.split()) for t in texts])
    assert sorted(kept) == want and len(want) < len(texts) - 8


def sets_at(n, kind):
    """Two sets of shingle hashes at 0.8 similarity or a little more: some left out, or as many changed."""
    k = n // 4 if kind == "longer" else n // 9
    s = np.array(rng.sample(range(1 << 32), n + k), np.uint32)
    return np.sort(s[:n]), np.sort(s if kind == "longer" else s[k:])


def test_nearest_pivots():
    """Counts, pivots and keys against their definitions, bit by bit."""
    s = np.array(rng.sample(range(1 << 32), 300), np.uint32)
    for some in (s[:1], s[:7], s):
        bits = [[int(h) >> i & 1 for h in near_copies._mix(np.array([x], np.uint64) * near_copies._BASE + near_copies._WORDS) for i in range(64)] for x in some]
        assert near_copies.counts(some).tolist() == [2 * sum(column) - len(some) for column in zip(*bits, strict=True)]
    c = np.array([near_copies.counts(s[:n]) for n in (1, 3, 8, 20, 50, 100, 150, 200, 300)])
    keys = near_copies.tables(c)
    assert keys.shape == (9, 60) and len(np.unique(keys // 512**2, axis=0)) == 1
    for block in (0, 1, 2, 63, 118, 119):
        pivots = near_copies.pivots(block)
        differ = (pivots[:, None, :] != pivots[None, :, :]).sum(2)
        assert set(differ[~np.eye(256, dtype=bool)].tolist()) == {128}
        got = keys[:, block // 2] // (1 if block % 2 else 512) % 512
        for text, symbol in zip(c, got.tolist(), strict=True):
            away = (np.abs(text)[None, :] * (pivots * text[None, :] < 0)).sum(1)
            far = np.abs(text).sum() - away
            assert (far if symbol % 2 == 0 else away)[symbol // 2] == min(away.min(), far.min())


def test_pivots_lead_to_pairs_at_the_border():
    """Of pairs at 0.8, of every length, 0.995 share a bucket and are not discarded there."""
    for n in (4, 8, 9, 18, 40, 90, 300):
        for kind in ("longer", "changed"):
            if kind == "changed" and n < 9:
                continue
            a, b = (np.array([near_copies.counts(s) for s in x]) for x in zip(*(sets_at(n, kind) for _ in range(400)), strict=True))
            met = (near_copies.tables(a) == near_copies.tables(b)).any(1)
            differ = ((a > 0) != (b > 0))[:, : near_copies.CHECKED].sum(1)
            assert (met & (differ <= near_copies.RADIUS)).mean() >= 0.995, (n, kind)


def test_close_against_all_pairs():
    """Short and long runs of a key: the same components as by all pairs."""
    draw = np.random.default_rng(4)
    for lengths in ([1, 2, 3, 1, 40, 128, 129, 300], [1], [500], []):
        key = np.repeat(np.arange(len(lengths)), lengths)
        base = draw.integers(1 << 63, size=(5, 2), dtype=np.uint64)
        fp = base[draw.integers(5, size=len(key))] ^ (np.uint64(1) << draw.integers(60, size=(len(key), 2), dtype=np.uint64))
        size = draw.choice([10, 12, 13, 30], len(key))
        got = near_copies._roots(len(key), *near_copies.close(key, fp, size, 0.8))
        label = list(range(len(key)))
        for i in range(len(key)):
            for j in range(i):
                if key[i] == key[j] and min(size[i], size[j]) >= 0.8 * max(size[i], size[j]) and np.bitwise_count(fp[i] ^ fp[j]).sum() <= near_copies.RADIUS:
                    a, b = label[i], label[j]
                    if a != b:
                        label = [min(a, b) if x in (a, b) else x for x in label]
        assert got.tolist() == label


def test_buckets_above_the_bound(spark):
    base = [" ".join(words(60)) for _ in range(3)]
    texts = [edited(b, 1) for b in base for _ in range(12)] + [" ".join(words(60)) for _ in range(20)]
    prints = near_copies.signatures(frame(spark, list(enumerate(texts)))).cache()
    ids = {r.id: r.doc_id for r in prints.collect()}
    for bucket in (0, 1, 3):
        label = list(range(len(texts)))
        for r in near_copies.links(prints, bucket=bucket).collect():
            a, b = label[ids[r.u]], label[ids[r.v]]
            label = [min(a, b) if x in (a, b) else x for x in label]
        assert sorted(set(label)) == groups_kept(texts)
