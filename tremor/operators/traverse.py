"""Bounded breadth-first blast radius with first-discovery paths, and the variants it reaches.

A level is two equi-joins of the frontier with the edges, an anti-join with what was visited, and a first-of-group. The order
of discovery is a pair of keys, not one global sort: a node is ordered by its parent's key and its place among the
parent's edges, and only the first row of a target has to be found, by a partial aggregate (``min``) that no hub
can skew. Each level is a written table, so plans stay short and executors can be lost.

The edges are written twice, dealt by component and by module, and stay where they are: a level sends its frontier to them and streams
them past a hash table of its part of it. A module is passed once, as all behind it is found then; so the rows that all levels
make together are as many as the edges. Chains are put together at the end, from each level and its parents.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tremor.functions.ordinals import COUPLING, coupling_name, coupling_rank, criticality_name, criticality_rank
from tremor.operators.graph import GraphTables, bipartite
from tremor.sources.shared import buckets, dealt, written

MAX_DEPTH = 5


@dataclass(frozen=True)
class Laid:
    """Edges (component_id, module_id, coupling, mod_ord) dealt by component, and (these and comp_ord) by module."""

    by_component: DataFrame
    by_module: DataFrame


def laid_out(edges: DataFrame) -> Laid:
    edges = written(edges.select("component_id", "module_id", "coupling", "mod_ord", "comp_ord"), "bfs-edges")
    n = buckets(edges.sparkSession, edges.count())
    return Laid(dealt(edges.drop("comp_ord"), "bfs-by-component", "component_id", n), dealt(edges, "bfs-by-module", "module_id", n))


def traverse(edges: DataFrame | Laid, changed: DataFrame, max_depth: int = MAX_DEPTH, weak: bool = True, paths: bool = True, chains: bool = True) -> DataFrame:
    """Impacted components with depth, min_coupling, source, chain and ``ord``, the key of discovery (compare as arrays).

    ``edges``: component_id, module_id, coupling, mod_ord, comp_ord. ``changed``: component_id, and pos, the place in the request.
    Without ``weak``, edges that leave a component must not be loose or optional; those that enter one may be.
    Without ``paths`` only component_id and depth are found, with one distinct less a level; without ``chains``, all but chain and source.
    """
    laid = edges if isinstance(edges, Laid) else laid_out(edges)
    rank = coupling_rank(F.col("coupling"))
    every = laid.by_component.select(F.col("component_id").alias("c"), F.col("module_id").alias("m"), rank.alias("k1"), "mod_ord", "coupling")
    out = (every if weak else every.filter("coupling not in ('loose', 'optional')")).drop("coupling")
    into = laid.by_module.select(F.col("module_id").alias("m"), F.col("component_id").alias("n"), rank.alias("k2"), "comp_ord")
    here = lambda df: df.hint("shuffle_hash")
    start = changed.groupBy(F.col("component_id").alias("c")).agg(F.min("pos").cast("long").alias("pos"))
    start = every.select("c").join(here(start), "c").groupBy("c").agg(F.first("pos").alias("pos"))
    # ord: the key of discovery; rank: the least coupling on the way; p, by: the parent and the module that led here
    level = written(start.select("c", F.array("pos").alias("ord"), F.lit(COUPLING["tight"]).alias("rank")), "bfs-level")
    levels, visited, passed = [level], level.select("c"), None
    for depth in range(1, max_depth + 1):
        met = here(level).join(out, "c")
        if paths:
            # Of a module, only the first parent can be the first discovery of anything behind it.
            step = met.groupBy("m").agg(F.min(F.struct("ord", "mod_ord", F.least("rank", "k1").alias("rank"), "c")).alias("p"))
        else:
            step = met.select("m").distinct()
        if passed is not None:
            step = step.join(passed, "m", "left_anti")
        step = written(step, "bfs-step")
        passed = step.select("m") if passed is None else passed.unionByName(step.select("m"))
        met = here(step).join(into, "m")
        if paths:
            key = F.concat("p.ord", F.array(F.col("p.mod_ord").cast("long"), F.col("comp_ord").cast("long")))
            best = met.groupBy(F.col("n").alias("c")).agg(F.min(F.struct(key.alias("ord"), F.least("p.rank", "k2").alias("rank"), F.col("p.c").alias("p"), F.col("m").alias("by"))).alias("b"))
            level = best.join(visited, "c", "left_anti").select("c", "b.*")
        else:
            level = met.select(F.col("n").alias("c")).distinct().join(visited, "c", "left_anti")
        level = written(level, "bfs-level")
        if level.isEmpty():
            break
        levels.append(level)
        visited = visited.unionByName(level.select("c"))
    if not paths:
        found = [v.select(F.col("c").alias("component_id"), F.lit(d).alias("depth")) for d, v in enumerate(levels) if d] or [level.select(F.col("c").alias("component_id"), F.lit(0).alias("depth")).limit(0)]
        return reduce(DataFrame.unionByName, found)
    before = levels[0].select("c", F.array("c").alias("chain"))
    found = []
    for depth, level in enumerate(levels[1:], 1):
        if not chains:
            found.append(level.select("c", F.lit(depth).alias("depth"), "rank", "ord"))
            continue
        # Only parents that led somewhere are met, each of them once by its key.
        at = level.join(before.select(F.col("c").alias("p"), "chain"), "p").withColumn("chain", F.concat("chain", F.array("by", "c"))).select("c", F.lit(depth).alias("depth"), "rank", "chain", "ord")
        at = written(at, "bfs-chains") if depth + 1 < len(levels) else at
        before = at
        found.append(at)
    if not found:
        found = [levels[0].select("c", F.lit(0).alias("depth"), "rank", F.array("c").alias("chain"), "ord").limit(0)]
    return reduce(DataFrame.unionByName, found).select(
        F.col("c").alias("component_id"),
        "depth",
        (F.col("depth") == 1).alias("is_direct"),
        F.when(F.col("rank") == 0, F.lit("unknown")).otherwise(coupling_name(F.col("rank"))).alias("min_coupling"),
        *([F.element_at("chain", 1).alias("source"), "chain"] if chains else []),
        "ord",
    )


def in_order(impacts: DataFrame) -> DataFrame:
    """Discovery order: level by level, then by key."""
    return impacts.orderBy("depth", "ord")


def describe_path(chain, depth, coupling):
    return F.concat(F.array_join(chain, " → "), F.format_string(" (depth=%d, min_coupling=%s)", depth, coupling))


def shared_with_changed(edges: DataFrame, changed: DataFrame) -> DataFrame:
    """component_id with shared_modules, the sorted modules it has in common with any changed component."""
    mine = edges.join(changed.select("component_id").distinct(), "component_id", "left_semi").select("module_id").distinct()
    return edges.join(mine, "module_id", "left_semi").groupBy("component_id").agg(F.sort_array(F.collect_set("module_id")).alias("shared_modules"))


def variant_impacts(members: DataFrame, changed: DataFrame, impacts: DataFrame, components: DataFrame) -> DataFrame:
    """Per variant that has a changed or impacted component: sorted affected components, direct and indirect counts, highest
    criticality (low at least; components the graph does not define add none)."""
    direct = F.col("depth") <= 1
    touched = impacts.select("component_id", "depth").unionByName(changed.select("component_id", F.lit(0).alias("depth")).distinct())
    crit = components.select(F.col("id").alias("component_id"), criticality_rank(F.col("criticality")).alias("crit"))
    rows = members.select("variant_id", "component_id").distinct().join(touched, "component_id").join(crit, "component_id", "left")
    return rows.groupBy("variant_id").agg(
        F.sort_array(F.collect_set("component_id")).alias("affected_components"),
        F.count(F.when(direct, 1)).alias("direct_count"),
        F.count(F.when(~direct, 1)).alias("indirect_count"),
        criticality_name(F.greatest(F.max("crit"), F.lit(1))).alias("max_criticality"),
    )


def impact_of(g: GraphTables, ids: list[str], max_depth: int = MAX_DEPTH, weak: bool = True) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Impacts (with criticality and shared modules), variant impacts, and the changed components the graph knows."""
    spark = g.components.sparkSession
    edges = bipartite(g)
    asked = spark.createDataFrame([(c, i) for i, c in enumerate(ids)], "component_id string, pos int")
    changed = asked.join(g.components.select(F.col("id").alias("component_id")), "component_id", "left_semi")
    crit = g.components.select(F.col("id").alias("component_id"), "criticality")
    impacts = traverse(edges, changed, max_depth, weak).join(crit, "component_id", "left")
    impacts = impacts.withColumn("criticality", F.coalesce("criticality", F.lit("medium")))
    impacts = impacts.join(shared_with_changed(edges, changed), "component_id", "left")
    impacts = impacts.withColumn("shared_modules", F.coalesce("shared_modules", F.expr("cast(array() as array<string>)")))
    impacts = written(impacts, "impacts")
    return impacts, variant_impacts(g.variant_components, changed, impacts, g.components), changed


def result_summary(changed: DataFrame, impacts: DataFrame, variants: DataFrame) -> DataFrame:
    """One row of counts."""
    i = impacts.agg(F.count(F.when(F.col("is_direct"), 1)).alias("direct"), F.count(F.when(~F.col("is_direct"), 1)).alias("indirect"), F.count("*").alias("paths"))
    one = changed.agg(F.count("*").alias("changed")).crossJoin(i).crossJoin(variants.agg(F.count("*").alias("variants_affected")))
    return one.select("changed", "direct", "indirect", (F.col("direct") + F.col("indirect")).alias("total"), "variants_affected", "paths")
