"""Quality rules as a bitmask ledger.

Each rule is evaluated once for a document; its failure is one bit of ``failures`` beside the measurements it used.
Policies are versioned masks over those bits, so a new policy, or an ablation that leaves one rule out, re-reads the
ledger and never the texts. Everything is a projection within a row: no shuffle, no Python.

Defined results: a null text has no words and measures zero everywhere; a text without words fails rule 0; repeated rows
give repeated ledger rows; further columns are ignored; an empty table gives an empty ledger.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import WS, table, words_of

SYMBOLS = "#*$%&|<>"
#: (name, failure condition over the measurements), the bit being the place in this list. Append only: bits are stored.
RULES: list[tuple[str, str]] = [
    ("few_words", "n_words < 50"),
    ("repeated_windows", "100 * n_repeat_words > 50 * n_words"),
    ("symbol_heavy", "10 * n_symbols > n_words"),
    ("duplicate_lines", "2 * n_dup_lines > n_lines"),
    ("shouting", "2 * n_upper > word_chars"),
    ("short_words", "word_chars < 2 * n_words"),
    ("long_words", "word_chars > 15 * n_words"),
    ("few_distinct_words", "n_words >= 50 AND 10 * n_distinct_words < n_words"),
    ("exclaiming", "4 * n_exclaimed > n_words"),
]


@dataclass(frozen=True)
class Policy:
    """A document is rejected when a rule of ``rules`` fails."""

    version: str
    rules: tuple[str, ...]

    @property
    def mask(self) -> int:
        names = [n for n, _ in RULES]
        return sum(1 << names.index(r) for r in self.rules)


POLICIES = {
    "v1": Policy("v1", ("few_words", "repeated_windows")),
    "v2": Policy("v2", tuple(n for n, _ in RULES)),
}


def _count(text: Column, pattern: str) -> Column:
    """Characters outside ``pattern``, which names what to take away."""
    return F.length(F.regexp_replace(text, pattern, "")).cast("long")


def measure(docs: DataFrame) -> DataFrame:
    """doc_id and the measurements of RULES."""
    text = F.coalesce("text", F.lit(""))
    base = docs.select("doc_id", text.alias("t")).select("doc_id", "t", words_of(F.col("t")).alias("w"), F.split("t", "\n", -1).alias("all_lines"))
    base = base.select(
        "doc_id",
        "w",
        F.size("w").cast("long").alias("n_words"),
        F.length(F.array_join("w", "")).cast("long").alias("word_chars"),
        (F.length("t") - F.length(reduce(lambda t, x: F.replace(t, F.lit(x), F.lit("")), SYMBOLS, F.col("t")))).cast("long").alias("n_symbols"),
        _count(F.col("t"), r"[^A-ZÀ-ÖØ-Þ]+").alias("n_upper"),
        F.filter("all_lines", lambda x: F.btrim(x, F.lit(WS)) != "").alias("lines"),
        F.size(F.filter("w", lambda x: x.endswith("!"))).cast("long").alias("n_exclaimed"),
        F.transform(
            F.when(F.size("w") >= 3, F.sequence(F.lit(0), F.size("w") - 3)).otherwise(F.array().cast("array<int>")),
            lambda i: F.struct(F.xxhash64(F.get("w", i), F.get("w", i + 1), F.get("w", i + 2)).alias("h"), i.alias("i")),
        ).alias("win"),
    )
    # Only texts with a repeated window sort theirs; equal hashes are then neighbours.
    base = base.withColumn("sorted", F.when(F.size(F.array_distinct(F.col("win.h"))) < F.size("win"), F.sort_array("win")).otherwise(F.expr("cast(null as array<struct<h:bigint,i:int>>)")))
    near = lambda k: (F.get("sorted", k)["h"] == F.get("sorted", k - 1)["h"]) | (F.get("sorted", k)["h"] == F.get("sorted", k + 1)["h"])
    base = base.withColumn(
        "at",
        F.sort_array(
            F.transform(
                F.filter(F.sequence(F.lit(0), F.size("sorted") - 1), lambda k: F.coalesce(near(k), F.lit(False))),
                lambda k: F.get("sorted", k)["i"],
            )
        ),
    )
    covered = F.aggregate(
        F.transform("at", lambda x, k: F.least(F.lit(3), F.coalesce(F.get("at", k + 1) - x, F.lit(3)))), F.lit(0), lambda a, x: a + x
    )
    return base.select(
        "doc_id",
        "n_words",
        "word_chars",
        "n_symbols",
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.coalesce(covered, F.lit(0)).cast("long").alias("n_repeat_words"),
        F.size("lines").cast("long").alias("n_lines"),
        "n_upper",
        F.size(F.array_distinct("w")).cast("long").alias("n_distinct_words"),
        "n_exclaimed",
    )


def ledger(docs: DataFrame) -> DataFrame:
    """The measurements and ``failures``, one bit for each rule that fails."""
    bits = None
    for bit, (_, fails) in enumerate(RULES):
        b = F.when(F.expr(fails), F.lit(1 << bit)).otherwise(F.lit(0)).cast("long")
        bits = b if bits is None else bits.bitwiseOR(b)
    return measure(docs).withColumn("failures", bits)


def apply_policy(rows: DataFrame, policy: Policy, to: str = "kept") -> DataFrame:
    return rows.withColumn(to, F.col("failures").bitwiseAND(F.lit(policy.mask)) == 0)


def ablations(rows: DataFrame, policy: Policy) -> DataFrame:
    """For each rule of a policy: documents that fail it, that fail nothing else, and that are kept without it.

    One pass: a document adds to a rule where its masked bits have that bit, or are that bit alone.
    """
    masked = F.col("failures").bitwiseAND(F.lit(policy.mask))
    names = [n for n, _ in RULES]
    aggs = [F.count(F.when(masked == 0, 1)).alias("kept")]
    for r in policy.rules:
        bit = 1 << names.index(r)
        aggs += [F.count(F.when(masked.bitwiseAND(F.lit(bit)) != 0, 1)).alias(f"f_{r}"), F.count(F.when(masked == bit, 1)).alias(f"o_{r}")]
    row = rows.agg(*aggs)
    parts = ", ".join(f"'{r}', f_{r}, o_{r}, kept + o_{r}" for r in policy.rules)
    return row.selectExpr(f"stack({len(policy.rules)}, {parts}) AS (rule, n_failed, n_failed_alone, n_kept_without)")


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = apply_policy(apply_policy(ledger(table(spark, sf_dir, "documents")), POLICIES["v1"], "base_kept"), POLICIES["v2"])
    return rows.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        (~F.col("base_kept")).alias("base_failed"), "kept", "failures",
    )


_WS_SQL = "chr(32)||chr(9)||chr(10)||chr(11)||chr(12)||chr(13)"
ORACLE = rf"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT doc_id, t, list_filter(regexp_split_to_array(t, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w,
             list_filter(string_split(t, chr(10)), lambda x: trim(x, {_WS_SQL}) <> '') AS l FROM d),
win AS (SELECT doc_id, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS g
        FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM w)),
rep AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS n FROM win) WHERE n >= 2),
cov AS (SELECT doc_id, count(DISTINCT i + j) AS n FROM rep, (SELECT unnest(range(3)) AS j) GROUP BY doc_id),
m AS (SELECT w.doc_id, len(w) AS n_words, length(regexp_replace(t, '[\x20\x09-\x0D]+', '', 'g')) AS word_chars,
        length(regexp_replace(t, '[^#*$%&|<>]+', '', 'g')) AS n_symbols,
        len(l) - len(list_distinct(l)) AS n_dup_lines, coalesce(cov.n, 0) AS n_repeat_words, len(l) AS n_lines,
        length(regexp_replace(t, '[^A-ZÀ-ÖØ-Þ]+', '', 'g')) AS n_upper,
        len(list_distinct(w)) AS n_distinct_words,
        len(list_filter(w, lambda x: ends_with(x, '!'))) AS n_exclaimed
      FROM w LEFT JOIN cov ON cov.doc_id = w.doc_id),
f AS (SELECT *, {" + ".join(f"CASE WHEN {c} THEN {1 << b} ELSE 0 END" for b, (_, c) in enumerate(RULES))} AS failures FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
       (failures & {POLICIES["v1"].mask}) <> 0 AS base_failed, (failures & {POLICIES["v2"].mask}) = 0 AS kept,
       cast(failures AS BIGINT) AS failures
FROM f
"""
