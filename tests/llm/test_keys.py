"""Random keys that look like paths, base32 and lower-case keys."""

import random
import re

from tremor.llm import secret_scan

rng = random.Random(2)


def key(alphabet, n):
    return "".join(rng.choice(alphabet) for _ in range(n))


def test_random_keys(spark):
    letters = secret_scan.UPPER + secret_scan.LOWER + secret_scan.DIGITS
    slashed = [f"{key(letters, 14)}/{key(letters, 12)}/{key(letters, 12)}" for _ in range(30)]
    base32 = [key(secret_scan.UPPER + "234567", 32) for _ in range(30)]
    lower = [key(secret_scan.LOWER + secret_scan.DIGITS, 30) for _ in range(30)]
    paths = ["home/User1/files/Doc2", "src/main/java/MyClass2/Test", "usr/share/Lib2/x86_64", "INTERNATIONALIZATIONSERVICE", "internationalizationofservices"]
    rows = [(i, f"see {t} here") for i, t in enumerate(slashed + base32 + lower + paths)]
    got = {r.doc_id: r.s for r in secret_scan.secret_spans(spark.createDataFrame(rows, "doc_id long, text string")).select("doc_id", secret_scan.joined("spans").alias("s")).collect()}
    hit = [bool(re.search("entropy", got[i])) for i, _ in rows]
    assert sum(hit[:30]) >= 28 and sum(hit[30:60]) >= 28 and sum(hit[60:90]) >= 28 and not any(hit[90:])
