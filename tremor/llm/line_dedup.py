"""Line dedup: hash normalised lines, count the documents of each hash, drop frequent lines, reassemble by position.

DataFrame functions only. The text itself is shuffled once, to meet its document's dropped hashes; what is
exploded carries 128 bits of hash for each distinct line of a document. Hot lines pre-aggregate before the
shuffle, and the frequent hashes are a written table, so the planner broadcasts them only below its size limit.
A document's dropped hashes are dealt into as many groups as the root of their number, and a line looks into one: the work
within a text grows with the power 1.5 of its lines at most.

Defined results: a null or empty text is one empty line; lines whose key is shorter than ``min_chars`` never go; every row
is a document of its own, so repeated rows, and rows that share an id, count each; null ids are kept; further columns are
ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import WS, ascii_lower, forget, table, written


def line_key(line: Column) -> Column:
    return ascii_lower(F.btrim(line, F.lit(WS)))


def _hash(key: Column) -> Column:
    return F.struct(F.xxhash64(key).alias("a"), F.xxhash64(F.lit("line"), key).alias("b"))


def line_dedup(docs: DataFrame, min_docs: int = 10, min_chars: int = 1, keep: Sequence[str] = ()) -> DataFrame:
    """Drops every line whose key is in at least ``min_docs`` documents.

    Returns doc_id, text (what is kept), n_lines (before), n_dropped, and the columns ``keep`` as they are.
    """
    # Rows of one id and one text lose the same lines, so these two tell apart what has to be.
    lines = docs.select("doc_id", *keep, F.xxhash64("text").alias("_t"), F.split(F.coalesce("text", F.lit("")), "\n", -1).alias("lines"))
    keyed = lines.select(
        "doc_id",
        "_t",
        F.explode(
            F.transform(
                F.array_distinct(F.filter(F.transform("lines", line_key), lambda k: F.length(k) >= min_chars)), _hash
            )
        ).alias("h"),
    )
    frequent = written(keyed.groupBy("h").count().filter(F.col("count") >= min_docs).select("h"), "frequent-lines")
    hits = keyed.join(frequent, "h", "left_semi").groupBy("doc_id", "_t").agg(F.collect_set("h").alias("gone"))
    groups = F.ceil(F.sqrt(F.size("gone"))).cast("int")
    dealt = F.transform(F.sequence(F.lit(0), groups - 1), lambda g: F.filter("gone", lambda h: F.pmod(h["a"], groups) == g))
    hits = written(hits.select("doc_id", "_t", dealt.alias("gone")), "line-hits")
    forget(frequent)
    # One plan at every size: the hits grow with the documents, so they are never broadcast.
    hits = hits.select(F.col("doc_id").alias("hit_id"), F.col("_t").alias("hit_t"), "gone").hint("merge")
    hashed = F.transform("lines", lambda x: F.struct(x.alias("x"), _hash(line_key(x)).alias("h"), (F.length(line_key(x)) >= min_chars).alias("counts")))
    stay = F.filter(hashed, lambda y: ~(y["counts"] & F.array_contains(F.get("gone", F.pmod(y["h"]["a"], F.size("gone")).cast("int")), y["h"])))
    kept = F.when(F.col("gone").isNull(), F.col("lines")).otherwise(F.transform(stay, lambda y: y["x"]))
    joined = lines.join(hits, (F.col("_t") == F.col("hit_t")) & F.col("doc_id").eqNullSafe(F.col("hit_id")), "left").select("doc_id", *keep, "lines", kept.alias("kept"))
    return joined.select(
        "doc_id",
        *keep,
        F.array_join("kept", "\n").alias("text"),
        F.size("lines").cast("long").alias("n_lines"),
        (F.size("lines") - F.size("kept")).cast("long").alias("n_dropped"),
    )


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = line_dedup(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


ORACLE = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, text FROM documents),
lines AS (
  SELECT r, doc_id, i, l, translate(trim(l, chr(32)||chr(9)||chr(10)||chr(11)||chr(12)||chr(13)),
         'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k
  FROM (SELECT r, doc_id, unnest(ls) AS l, unnest(range(len(ls))) AS i
        FROM (SELECT r, doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM d))),
frequent AS (SELECT k FROM lines WHERE length(k) >= 1 GROUP BY k HAVING count(DISTINCT r) >= 10),
marked AS (SELECT lines.*, f.k IS NOT NULL AS gone FROM lines LEFT JOIN frequent f ON lines.k = f.k)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped,
       sha256(coalesce(string_agg(l, chr(10) ORDER BY i) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM marked GROUP BY r, doc_id
"""
