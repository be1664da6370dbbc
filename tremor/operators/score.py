"""Scores, the merge of structural and semantic evidence, and risk by variant."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tremor.functions.ordinals import BOOST, CRITICALITY_FACTOR, criticality_name, criticality_rank, lookup, risk_level, round2, score


def scored_impacts(impacts: DataFrame, semantic: DataFrame) -> DataFrame:
    """Full outer merge on component_id.

    ``impacts``: component_id, depth, is_direct, min_coupling, criticality. ``semantic``: component_id, best_score, criticality (one
    row each). Both: the structural score times the boost. Semantic alone: similarity times the criticality factor, depth 0.
    """
    i = impacts.select("component_id", "depth", "is_direct", F.col("min_coupling").alias("coupling"), F.col("criticality").alias("crit_i"), F.lit(True).alias("in_graph"))
    s = semantic.select("component_id", "best_score", F.col("criticality").alias("crit_s"))
    both = i.join(s, "component_id", "full_outer")
    crit = F.coalesce("crit_i", "crit_s", F.lit("medium"))
    base = score(F.col("coupling"), crit, F.col("depth"))
    value = (
        F.when(F.col("in_graph") & F.col("best_score").isNotNull(), base * BOOST)
        .when(F.col("in_graph"), base)
        .otherwise(F.col("best_score") * lookup(CRITICALITY_FACTOR, crit, 1.0))
    )
    return both.select(
        "component_id",
        F.coalesce("depth", F.lit(0)).alias("depth"),
        F.coalesce("is_direct", F.lit(False)).alias("is_direct"),
        F.coalesce("coupling", F.lit("semantic")).alias("coupling"),
        crit.alias("criticality"),
        round2(value).alias("score"),
        F.col("best_score").isNotNull().alias("has_semantic"),
        F.col("in_graph").isNotNull().alias("in_graph"),
    )


def variant_risks(members: DataFrame, changed: DataFrame, scored: DataFrame, components: DataFrame) -> DataFrame:
    """Per variant with a changed or impacted component: sum of rounded scores, direct and indirect counts, highest criticality.

    What was found by similarity alone never reaches a variant. Sums are decimals, so they do not depend on order.
    """
    touched = scored.filter("in_graph").select("component_id", "is_direct", "score").unionByName(
        changed.select("component_id").distinct().select("component_id", F.lit(True).alias("is_direct"), F.lit(0.0).alias("score"))
    )
    crit = components.select(F.col("id").alias("component_id"), criticality_rank(F.col("criticality")).alias("crit"))
    rows = members.select("variant_id", "component_id").distinct().join(touched, "component_id").join(crit, "component_id", "left")
    out = rows.groupBy("variant_id").agg(
        F.count("*").alias("affected_count"),
        F.count(F.when(F.col("is_direct"), 1)).alias("direct_count"),
        F.count(F.when(~F.col("is_direct"), 1)).alias("indirect_count"),
        criticality_name(F.greatest(F.max("crit"), F.lit(1))).alias("max_criticality"),
        F.sum(F.col("score").cast("decimal(18,2)")).cast("double").alias("risk_score"),
    )
    return out.withColumn("risk_level", risk_level(F.col("risk_score")))


def ranked(scored: DataFrame, *ties: str) -> DataFrame:
    return scored.orderBy(F.desc("score"), *ties)


def report_summary(changed: DataFrame, scored: DataFrame, risks: DataFrame, n_variants: int) -> DataFrame:
    s = scored.agg(F.count(F.when(F.col("is_direct"), 1)).alias("direct"), F.count(F.when(~F.col("is_direct"), 1)).alias("indirect"))
    one = changed.agg(F.count("*").alias("changed")).crossJoin(s).crossJoin(risks.agg(F.count("*").alias("variants_affected")))
    return one.select(
        "changed", "direct", "indirect", (F.col("direct") + F.col("indirect")).alias("total"), "variants_affected",
        F.greatest(F.lit(n_variants).cast("long"), F.col("variants_affected")).alias("variants_total"),
    )


def short_path(chain, head: int = 3, tail: int = 3, most: int = 7):
    """At most ``most`` nodes in full; longer ones by their first and last."""
    cut = F.concat(F.slice(chain, 1, head), F.array(F.lit("...")), F.slice(chain, -tail, tail))
    return F.array_join(F.when(F.size(chain) > most, cut).otherwise(chain), " → ")
