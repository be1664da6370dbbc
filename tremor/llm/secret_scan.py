"""Secret scan: fixed patterns, and sliding-window Shannon entropy per character class over candidate strings.

DataFrame functions only, all within a row. Patterns are cut out by ``split`` and ``regexp_extract_all`` over the same
expression, so the places of matches are running sums of lengths. The work for a text grows with its length, also where it is one
candidate, and by the power 1.5 of its matches. For the entropy of a candidate, a window moves over its
characters: one count goes up and one goes down at each step, and the sum of n log n follows from those two; no
window is counted anew. A candidate whose best window reaches the threshold of its class is a span, unless the
allow-list knows it or a pattern span covers it.

Places are code points, ends exclusive. Defined results: a null text is an empty one; repeated rows give repeated results;
further columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

#: Kind, pattern, group whose length counts, and its least length; kinds in the order of reports.
ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
BASE = [("assign", ASSIGN, 2, 12), ("access", r"AKIA[A-Z0-9]+", 0, 18), ("hex", r"[0-9a-f]+", 0, 16)]
#: For candidates nothing shorter than the least length can matter where a match is one run of characters.
_SCAN = {"access": r"AKIA[A-Z0-9]{14,}", "hex": r"[0-9a-f]{16,}"}


@dataclass(frozen=True)
class CharClass:
    """Candidates are runs of ``run``; one is flagged where a window of ``width`` has ``bits`` of entropy or more."""

    kind: str
    run: str
    alphabet: str
    width: int
    bits: float


LOWER, UPPER, DIGITS = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789"
CLASSES = (
    CharClass("entropy_hex", r"(?<![A-Za-z0-9+/_-])(?=[0-9A-F]*[0-9])(?=[0-9A-F]*[A-F])[0-9A-F]{24,}(?![A-Za-z0-9+/_-])", DIGITS + "ABCDEF", 24, 3.1),
    CharClass("entropy_base64", r"(?<![A-Za-z0-9+/_-])(?=[A-Za-z0-9+/_-]*[0-9])(?=[A-Za-z0-9+/_-]*[a-z])(?=[A-Za-z0-9+/_-]*[A-Z])[A-Za-z0-9+/_-]{20,}={0,2}", LOWER + UPPER + DIGITS + "+/_-=", 20, 3.6),
    # a letter past F tells the next two from hex
    CharClass("entropy_base32", r"(?<![A-Za-z0-9+/_-])(?=[A-Z2-7]*[2-7])(?=[A-Z2-7]*[G-Z])[A-Z2-7]{24,}={0,6}(?![A-Za-z0-9+/_=-])", UPPER + "234567=", 24, 3.5),
    CharClass("entropy_lower", r"(?<![A-Za-z0-9+/_-])(?=[a-z0-9]*[0-9])(?=[a-z0-9]*[g-z])[a-z0-9]{20,}(?![A-Za-z0-9+/_-])", LOWER + DIGITS, 20, 3.5),
)
#: Whole candidates that are known to be harmless: examples, paths of names (no letter after a digit, no capital or small letter by itself
#: within a name, as random keys have), identifiers with a fixed layout.
ALLOW = (
    r"(?i)example|sample|placeholder|changeme|your[_-]",
    r"(?i)^[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}$",
    r"^(?!.*(?:[0-9][A-Za-z]|[a-z][A-Z](?![a-z]{2})|[A-Z][a-z](?![a-z]|[A-Z][a-z]{2})|[0-9]{5}))(?:[A-Za-z0-9_.-]+/){2,}[A-Za-z0-9_.-]*$",
    r"(?i)abcdefgh|01234567|qwertyui",
)
_SPAN = "struct<s:bigint,k:int,e:bigint,m:string>"
_SPANS = f"array<{_SPAN}>"
#: Elements that one step of a running sum copies at most.
_BLOCK = 512


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` over a value that is computed once, however often it is named."""
    return F.get(F.transform(F.array(value), body), 0)


def running(values: Column, zero: int, plus: Callable[[Column, Column], Column]) -> Column:
    """What ``plus``, an associative function, makes of the elements before each one; block by block, so the cost is not quadratic."""
    start = F.struct(F.lit(zero).cast("long").alias("at"), F.expr("cast(array() as array<bigint>)").alias("out"))
    step = lambda a, x: F.struct(plus(a["at"], x).alias("at"), F.concat(a["out"], F.array(a["at"])).alias("out"))

    def in_blocks(v: Column) -> Column:
        many = F.ceil(F.size(v) / F.lit(_BLOCK)).cast("int")
        numbers = F.when(many > 0, F.sequence(F.lit(0), many - 1)).otherwise(F.expr("cast(array() as array<int>)"))
        return F.transform(numbers, lambda b: F.slice(v, b * _BLOCK + 1, _BLOCK))

    def placed(blocks: Column) -> Column:
        totals = F.transform(blocks, lambda x: F.aggregate(x, F.lit(zero).cast("long"), plus))
        before = F.arrays_zip(blocks.alias("x"), F.aggregate(totals, start, step)["out"].alias("at"))
        return F.flatten(F.transform(before, lambda p: F.transform(F.aggregate(p["x"], start, step)["out"], lambda v: plus(p["at"], v))))

    return let(let(values, in_blocks), placed)


def matches(text: Column, pattern: str, kind: int) -> Column:
    """Spans (start, kind, end, text) of all matches."""
    long = lambda x: F.length(x).cast("long")
    found, gaps = F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.split(text, pattern, -1)
    # one gap more than matches: zipping leaves it without a match
    parts = F.filter(F.zip_with(found, gaps, lambda m, g: F.struct(long(g).alias("g"), long(m).alias("n"), m.alias("m"))), lambda x: x["m"].isNotNull())

    def spans(parts: Column) -> Column:
        before = running(F.transform(parts, lambda x: x["g"] + x["n"]), 0, lambda a, x: a + x)
        return F.zip_with(parts, before, lambda x, at: F.struct((at + x["g"]).alias("s"), F.lit(kind).alias("k"), (at + x["g"] + x["n"]).alias("e"), x["m"].alias("m")))

    return F.when(text.rlike(pattern), let(parts, spans)).otherwise(F.expr(f"cast(array() as {_SPANS})"))


def _entropy(candidate: Column, c: CharClass) -> Column:
    """The highest entropy, in bits, of a window over ``candidate``; a shorter candidate has none.

    The candidate is split into places in the alphabet once; each step reads the one that comes and the one that goes.
    """
    n_of = {i: 0.0 if i < 2 else i * math.log2(i) for i in range(c.width + 2)}
    table_ = F.array(*(F.lit(v) for v in n_of.values()))
    codes = F.transform(F.split(candidate, ""), lambda x: F.instr(F.lit(c.alphabet), x))  # from 1
    lagged = lambda x: F.arrays_zip(x.alias("came"), F.slice(F.concat(F.array_repeat(F.lit(0), c.width), x), F.lit(1), F.size(x)).alias("went"))
    steps = let(codes, lagged)

    def step(a: Column, x: Column) -> Column:
        came, went, seen = x["came"], x["went"], a["i"] + 1
        counts = F.transform(a["n"], lambda n, j: n + F.when(j + 1 == came, 1).otherwise(0) - F.when(j + 1 == went, 1).otherwise(0))
        up, down = F.get(a["n"], came - 1), F.get(a["n"], went - 1)
        total = F.when(came == went, a["t"]).otherwise(
            a["t"] + F.get(table_, up + 1) - F.get(table_, up) + F.when(went > 0, F.get(table_, down - 1) - F.get(table_, down)).otherwise(F.lit(0.0))
        )
        bits = F.when(seen >= c.width, F.lit(math.log2(c.width)) - total / F.lit(float(c.width))).otherwise(F.lit(0.0))
        return F.struct(seen.alias("i"), counts.alias("n"), total.alias("t"), F.greatest(a["best"], bits).alias("best"))

    start = F.struct(F.lit(0).alias("i"), F.array_repeat(F.lit(0), len(c.alphabet)).alias("n"), F.lit(0.0).alias("t"), F.lit(0.0).alias("best"))
    return F.aggregate(steps, start, step)["best"]


def _entropy_spans(text: Column, c: CharClass, kind: int) -> Column:
    allowed = lambda s: reduce(or_, [s.rlike(p) for p in ALLOW])
    return F.filter(matches(text, c.run, kind), lambda x: ~allowed(x["m"]) & (_entropy(x["m"], c) >= c.bits))


def secret_spans(docs: DataFrame) -> DataFrame:
    """doc_id, base (pattern spans) and spans (all), each an array of struct(s, k, e) in order; k is the place in KINDS."""
    d = docs.select("doc_id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("t"))
    groups = F.regexp_extract_all("t", F.lit(ASSIGN), F.lit(2))
    long_enough = F.filter(F.zip_with(matches(F.col("t"), ASSIGN, 0), F.transform(groups, F.length), lambda x, n: F.struct(x.alias("x"), n.alias("n"))), lambda y: y["n"] >= 12)
    placed = lambda spans: F.transform(spans, lambda x: F.struct(x["s"].alias("s"), x["k"].alias("k"), x["e"].alias("e")))
    base = F.concat(F.transform(long_enough, lambda y: y["x"]), matches(F.col("t"), _SCAN["access"], 1), matches(F.col("t"), _SCAN["hex"], 2))
    more = F.concat(*(_entropy_spans(F.col("t"), c, len(BASE) + i) for i, c in enumerate(CLASSES)))
    d = d.select("doc_id", F.array_sort(placed(base)).alias("base"), placed(more).alias("more"))
    # In order of starts, pattern spans first at equal ones, a span is covered where an earlier pattern span ends no sooner.
    d = d.select("doc_id", "base", F.array_sort(F.concat("base", "more")).alias("all"))
    ends = F.transform("all", lambda x: F.when(x["k"] < len(BASE), x["e"]).otherwise(F.lit(-1).cast("long")))
    covered = F.zip_with("all", running(ends, -1, lambda a, x: F.greatest(a, x)), lambda x, end: F.struct(x.alias("x"), ((x["k"] >= len(BASE)) & (end >= x["e"])).alias("gone")))
    return d.select("doc_id", "base", F.transform(F.filter(covered, lambda y: ~y["gone"]), lambda y: y["x"]).alias("spans"))


KINDS = [k for k, *_ in BASE] + [c.kind for c in CLASSES]


def joined(spans: str) -> Column:
    names = F.array(*(F.lit(k) for k in KINDS))
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", F.get(names, x["k"]), x["s"], x["e"])), ",")


def op5_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = secret_spans(table(spark, sf_dir, "documents"))
    n = lambda k: F.size(F.filter("base", lambda x: x["k"] == k)).cast("long")
    return rows.select("doc_id", *(n(k).alias(f"n_{name}") for k, (name, *_) in enumerate(BASE)), F.sha2(joined("base"), 256).alias("base_sha256"), joined("spans").alias("spans"))


def _found_sql(name: str, pattern: str) -> str:
    """A table of all matches: doc_id, s, e, m, places being running sums of the lengths of gaps and matches."""
    p = pattern.replace("'", "''")
    return f"""{name} AS (SELECT r, doc_id, i, ms[i] AS m, cast(list_sum(list_transform(gs[1:i], lambda g: length(g))) + coalesce(list_sum(list_transform(ms[1:i - 1], lambda x: length(x))), 0) AS BIGINT) AS s
  FROM (SELECT r, doc_id, ms, gs, unnest(range(1, len(ms) + 1)) AS i FROM (SELECT r, doc_id, regexp_extract_all(t, '{p}') AS ms, string_split_regex(t, '{p}') AS gs FROM d)))"""


# The same in another way: candidates are whole runs of the wide alphabet with the equal signs after them, tested as a whole; no look-around is
# needed then. What may not follow a letter pair in a name is spelled out likewise.
_ALLOWED_SQL = """(regexp_matches(x, '(?i)example|sample|placeholder|changeme|your[_-]') OR regexp_matches(x, '(?i)^[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}$') OR regexp_matches(x, '(?i)abcdefgh|01234567|qwertyui')
  OR (regexp_matches(x, '^(?:[A-Za-z0-9_.-]+/){2,}[A-Za-z0-9_.-]*$') AND NOT regexp_matches(x, '[0-9][A-Za-z]|[a-z][A-Z](?:$|[^a-z]|[a-z](?:$|[^a-z]))|[A-Z][a-z](?:$|[^A-Za-z]|[A-Z](?:$|[^a-z]|[a-z](?:$|[^a-z])))|[0-9]{5}')))"""
_CANDIDATES_SQL = [
    "SELECT r, doc_id, s, 3 AS k, body AS x FROM runs WHERE regexp_full_match(body, '[0-9A-F]{24,}') AND regexp_matches(body, '[0-9]') AND regexp_matches(body, '[A-F]')",
    "SELECT r, doc_id, s, 4, body || repeat('=', least(q, 2)) FROM runs WHERE length(body) >= 20 AND regexp_matches(body, '[0-9]') AND regexp_matches(body, '[a-z]') AND regexp_matches(body, '[A-Z]')",
    "SELECT r, doc_id, s, 5, body || repeat('=', q) FROM runs WHERE q <= 6 AND NOT (q > 0 AND after) AND regexp_full_match(body, '[A-Z2-7]{24,}') AND regexp_matches(body, '[2-7]') AND regexp_matches(body, '[G-Z]')",
    "SELECT r, doc_id, s, 6, body FROM runs WHERE regexp_full_match(body, '[a-z0-9]{20,}') AND regexp_matches(body, '[0-9]') AND regexp_matches(body, '[g-z]')",
]
_NAMES_SQL = "[" + ", ".join(f"'{k}'" for k in KINDS) + "]"
_LIMITS_SQL = ", ".join(f"({3 + i}, {c.width}, {c.bits})" for i, c in enumerate(CLASSES))
_JOIN_SQL = f"string_agg(({_NAMES_SQL})[k + 1] || ':' || s || ':' || e, ',' ORDER BY s, k)"
ORACLE = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents),
{_found_sql("f_assign", ASSIGN)},
{_found_sql("f_access", BASE[1][1])},
{_found_sql("f_hex", BASE[2][1])},
{_found_sql("f_run", "[A-Za-z0-9+/_-]+=*")},
base AS (
  SELECT r, doc_id, s, 0 AS k, s + length(m) AS e FROM f_assign WHERE length(regexp_extract(m, '{ASSIGN.replace("'", "''")}', 2)) >= 12
  UNION ALL SELECT r, doc_id, s, 1, s + length(m) FROM f_access WHERE length(m) >= 18
  UNION ALL SELECT r, doc_id, s, 2, s + length(m) FROM f_hex WHERE length(m) >= 16),
runs AS (SELECT f.r, f.doc_id, s, rtrim(m, '=') AS body, length(m) - length(rtrim(m, '=')) AS q, regexp_matches(substr(t, s + length(m) + 1, 1), '[A-Za-z0-9+/_-]') AS after
  FROM f_run f JOIN d ON d.r = f.r WHERE length(m) >= 20),
candidates AS ({" UNION ALL ".join(_CANDIDATES_SQL)}),
limits(k, w, bits) AS (VALUES {_LIMITS_SQL}),
more AS (SELECT r, doc_id, s, c.k, s + length(x) AS e FROM candidates c JOIN limits l ON l.k = c.k
  WHERE NOT {_ALLOWED_SQL} AND length(x) >= w
  AND list_max(list_transform(range(1, length(x) - w + 2), lambda i: list_aggregate(string_split(substr(x, i, w), ''), 'entropy'))) >= bits),
every AS (SELECT * FROM base UNION ALL SELECT * FROM more WHERE NOT EXISTS (SELECT 1 FROM base b WHERE b.r = more.r AND b.s <= more.s AND more.e <= b.e)),
b AS (SELECT r, count(*) FILTER (k = 0) AS n_assign, count(*) FILTER (k = 1) AS n_access, count(*) FILTER (k = 2) AS n_hex, {_JOIN_SQL} AS spans FROM base GROUP BY r),
a AS (SELECT r, {_JOIN_SQL} AS spans FROM every GROUP BY r)
SELECT d.doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex, sha256(coalesce(b.spans, '')) AS base_sha256, coalesce(a.spans, '') AS spans
FROM d LEFT JOIN b ON b.r = d.r LEFT JOIN a ON a.r = d.r
"""
