"""Gaps in the metadata of a graph: one rule, one relational query; findings in a fixed, stable order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tremor.functions.ordinals import SEVERITY, lookup
from tremor.operators.graph import GraphTables, bipartite
from tremor.sources.shared import buckets, dealt, written

#: Fixed values.
GENERIC_PREFIXES = ("Service:", "Class ", "Directory module:")
COLUMNS = ["gap_type", "severity", "entity_id", "entity_name", "description", "question", "check_no", "row_no", "resolved", "resolution", "suggestion"]


def orphan_components(components: DataFrame, edges: DataFrame) -> DataFrame:
    return components.join(edges.select(F.col("component_id").alias("id")), "id", "left_anti")


def isolated_modules(edges: DataFrame) -> DataFrame:
    """module_id and the one component_id that uses it: the least and the greatest user are one."""
    ends = edges.groupBy("module_id").agg(F.min("component_id").alias("component_id"), F.max("component_id").alias("last"))
    return ends.filter("component_id = last").drop("last")


def missing_description(text: Column) -> Column:
    t = F.btrim(F.coalesce(text, F.lit("")), F.lit(" \t\r\n\x0b\x0c"))
    out = t == ""
    for p in GENERIC_PREFIXES:
        out = out | t.startswith(p)
    return out


def coupling_ambiguity(edges: DataFrame) -> DataFrame:
    """component_id of two modules at least, all tight, with their number."""
    g = edges.groupBy("component_id").agg(F.count("*").alias("n_modules"), F.min("coupling").alias("lo"), F.max("coupling").alias("hi"))
    return g.filter("n_modules >= 2 and lo = 'tight' and hi = 'tight'").select("component_id", "n_modules")


def no_variant_assignment(components: DataFrame, members: DataFrame, variants: DataFrame) -> DataFrame:
    """Nothing where there are no variants at all."""
    some = variants.limit(1).select(F.lit(True).alias("_some"))
    return components.join(members.select(F.col("component_id").alias("id")), "id", "left_anti").crossJoin(some).drop("_some")


def missing_link_counts(located: DataFrame, edges: DataFrame) -> DataFrame:
    """Per component with modules: parent, siblings (others there with modules), linked (siblings that share a module) and missing, the rest.

    ``located``: component_id, parent, ord. Pairs are counted, never listed: a hub module of a large parent only adds to sums. Components of one
    parent with equal module sets form a class with a size; classes are what meets by module.
    """
    sets = _classes(located, edges)
    size = sets.groupBy("parent", "class").agg(F.count("*").alias("n"), F.first("modules").alias("modules"))
    size = written(size, "link-classes")
    mods = size.select("parent", "class", "n", F.explode("modules").alias("m"))
    x, y = mods.select("parent", "m", F.col("class").alias("a")), mods.select("parent", "m", F.col("class").alias("b"), "n")
    met = x.join(y, ["parent", "m"]).groupBy("parent", "a", "b").agg(F.first("n").alias("n")).groupBy("parent", "a").agg(F.sum("n").alias("linked"))
    total = size.groupBy("parent").agg(F.sum("n").alias("siblings"))
    per = met.join(total, "parent").select("parent", F.col("a").alias("class"), (F.col("siblings") - 1).alias("siblings"), (F.col("linked") - 1).alias("linked"))
    return sets.select("component_id", "parent", "class", "ord").join(per, ["parent", "class"]).select("parent", "component_id", "siblings", "linked", (F.col("siblings") - F.col("linked")).alias("missing"), "ord")


def _classes(located: DataFrame, edges: DataFrame) -> DataFrame:
    """component_id, parent, ord, its sorted modules, and the class that these make in the parent."""
    sets = edges.groupBy("component_id").agg(F.sort_array(F.collect_set("module_id")).alias("modules"))
    return located.join(sets, "component_id").withColumn("class", F.struct(F.xxhash64("modules").alias("a"), F.hash("modules").alias("b")))


def potential_missing_links(located: DataFrame, edges: DataFrame, of: DataFrame | None = None) -> DataFrame:
    """Pairs (c1 before c2 by ord) of one parent whose module sets are not empty and have nothing in common.

    ``located``: component_id, parent, ord; ``of`` (component_id): only pairs with one of these. The pairs of a parent are as many as its members
    squared, so over whole tables ``missing_link_counts`` answers; what pairs share is found by a join
    on modules inside the parent, and taken away.
    """
    has = located.join(edges.select("component_id").distinct(), "component_id", "left_semi")
    a = has.select(F.col("component_id").alias("c1"), "parent", F.col("ord").alias("o1"))
    b = has.select(F.col("component_id").alias("c2"), "parent", F.col("ord").alias("o2"))
    used = has.join(edges.select("component_id", "module_id").distinct(), "component_id")
    x = used.select(F.col("component_id").alias("c1"), "parent", "module_id")
    y = used.select(F.col("component_id").alias("c2"), "parent", "module_id")
    if of is not None:
        asked = of.select(F.col("component_id").alias("c1")).distinct()
        a, x = a.join(asked, "c1", "left_semi"), x.join(asked, "c1", "left_semi")
    sharing = x.join(y, ["parent", "module_id"]).select("parent", "c1", "c2").distinct()
    pairs = a.join(b, "parent").filter("o1 <> o2" if of is not None else "o1 < o2").join(sharing, ["parent", "c1", "c2"], "left_anti")
    if of is None:
        return pairs.select("parent", "c1", "c2", "o1", "o2")
    back = F.col("o1") > F.col("o2")
    first = [F.when(back, F.col(x)).otherwise(F.col(y)).alias(z) for x, y, z in (("c2", "c1", "c1"), ("c1", "c2", "c2"), ("o2", "o1", "o1"), ("o1", "o2", "o2"))]
    return pairs.select("parent", *first).distinct()


def no_api_surface(components: DataFrame) -> DataFrame:
    return components.filter(F.coalesce(F.size("api_surface"), F.lit(0)) <= 0)


def low_confidence(parsed: DataFrame, least: float = 0.5) -> DataFrame:
    return parsed.filter(F.col("confidence") < least)


def parent_dir(path: Column) -> Column:
    return F.when(path.contains("/"), F.regexp_replace(path, r"/[^/]*$", "")).otherwise(F.lit("."))


def _gap(df: DataFrame, no: int, kind: str, severity: str, entity: Column, name: Column, description: Column, question: Column, order: list) -> DataFrame:
    return df.select(
        F.lit(kind).alias("gap_type"), F.lit(severity).alias("severity"), entity.alias("entity_id"), name.alias("entity_name"),
        description.alias("description"), question.alias("question"), F.lit(no).alias("check_no"),
        *[c.alias(f"_o{i}") for i, c in enumerate(order)],
        F.lit(False).alias("resolved"), F.lit(None).cast("string").alias("resolution"), F.lit("").alias("suggestion"),
    )


def detect(g: GraphTables, parsed: DataFrame | None = None) -> DataFrame:
    """All gaps; order by severity, check_no, row_no (a pair that compares). ``parsed`` (id, name, source_file, confidence, ord) adds two rules."""
    c = g.components
    # Seven rules read the edges, most of them by component: they are worked out once and dealt so.
    edges = written(bipartite(g).select("component_id", "module_id", "coupling"), "gap-edges")
    edges = dealt(edges, "gap-edges-by-component", "component_id", buckets(c.sparkSession, edges.count()))
    L, fs, col = F.lit, F.format_string, F.col
    by_load = [col("load_ord").cast("long"), L("")]
    parts = [
        _gap(orphan_components(c, edges), 0, "orphan_component", "critical", col("id"), col("name"),
             fs("'%s' uses no module, so no change can be traced to it or from it.", "name"),
             fs("Which modules or services does '%s' use?", "name"), by_load),
        _gap(isolated_modules(edges), 1, "isolated_module", "medium", col("module_id"), col("module_id"),
             fs("Nothing but %2$s uses module '%1$s': no path leads through it.", "module_id", "component_id"),
             fs("Is '%2$s' the only user of module '%1$s'?", "module_id", "component_id"), [L(0).cast("long"), col("module_id")]),
        _gap(c.filter(missing_description(col("description"))), 2, "missing_description", "high", col("id"), col("name"),
             fs("'%s' is described by nothing, or by a generated line; searches by meaning will miss it.", "name"),
             fs("In a sentence or two: what is '%s' for?", "name"), by_load),
        _gap(c.join(coupling_ambiguity(edges).withColumnRenamed("component_id", "id"), "id"), 3, "coupling_ambiguity", "medium", col("id"), col("name"),
             fs("'%2$s' is tied tightly to each of its %1$d modules, which looks like a default.", "n_modules", "name"),
             fs("How close is '%s' to each of these: tight, loose or optional? %s", "name", F.array_join(F.transform("modules", lambda m: m["module_id"]), ", ")), by_load),
        _gap(no_api_surface(c), 4, "no_api_surface", "low", col("id"), col("name"),
             fs("No interface is known for '%s', so searches for one cannot find it.", "name"),
             fs("What interface does '%s' offer?", "name"), by_load),
        _gap(no_variant_assignment(c, g.variant_components, g.variants), 5, "no_variant_assignment", "medium", col("id"), col("name"),
             fs("No variant ships '%s'.", "name"),
             fs("Which variants ship '%s'?", "name"), by_load),
    ]
    if parsed is not None:
        located = parsed.select(col("id").alias("component_id"), parent_dir(col("source_file")).alias("parent"), "ord")
        pairs = potential_missing_links(located, edges)
        parts += [
            _gap(pairs, 6, "potential_missing_link", "low", F.concat("c1", L(":"), "c2"), F.concat("c1", L(" <-> "), "c2"),
                 fs("'%s' and '%s' lie side by side in %s without a module in common.", "c1", "c2", "parent"),
                 fs("Is anything common to '%s' and '%s', both in %s?", "c1", "c2", "parent"), [col("o1").cast("long"), F.format_string("%012d", col("o2").cast("long"))]),
            _gap(low_confidence(parsed), 7, "low_confidence", "high", col("id"), col("name"),
                 fs("'%s' was recognised with %s%% confidence only; it may be no component at all.", "name", F.round(col("confidence") * 100).cast("int")),
                 fs("Should '%s' (from %s) count as a component, and what is it for?", "name", "source_file"), [col("ord").cast("long"), L("")]),
        ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    # An order by the columns themselves: a row number would bring all gaps of a rule to one task.
    return out.withColumn("row_no", F.struct("_o0", "_o1")).select(*COLUMNS)


def in_order(gaps: DataFrame) -> DataFrame:
    return gaps.orderBy(lookup(SEVERITY, F.col("severity"), 9), "check_no", "row_no")


def completeness(gaps: DataFrame) -> DataFrame:
    """One row: the share of resolved gaps, 1.0 where there are none."""
    return gaps.agg(F.coalesce(F.avg(F.col("resolved").cast("double")), F.lit(1.0)).alias("completeness"))


def gap_summary(gaps: DataFrame) -> DataFrame:
    """Per severity and type, with totals (grouping sets): n_gaps, n_resolved; null stands for all."""
    return gaps.groupingSets([["severity"], ["gap_type"], []], "severity", "gap_type").agg(
        F.count("*").alias("n_gaps"), F.count(F.when(F.col("resolved"), 1)).alias("n_resolved")
    )


def auto_resolve(gaps: DataFrame) -> DataFrame:
    """Low ones: a missing interface always, a missing link where something is suggested."""
    hit = (F.col("severity") == "low") & ((F.col("gap_type") == "no_api_surface") | ((F.col("gap_type") == "potential_missing_link") & (F.col("suggestion") != "")))
    return gaps.withColumn("resolved", F.col("resolved") | hit).withColumn("resolution", F.when(hit, F.coalesce("resolution", F.lit("auto-resolved"))).otherwise(F.col("resolution")))


def questions(gaps: DataFrame, most: int = 10) -> DataFrame:
    """The first ones that are open: a top-k, each task sends ``most`` rows."""
    return in_order(gaps.filter(~F.col("resolved"))).limit(most)


def carry_over(before: DataFrame, after: DataFrame, by: str = "entity") -> DataFrame:
    """What was resolved stays so in a new detection, by entity or by entity and type."""
    keys = ["entity_id"] if by == "entity" else ["entity_id", "gap_type"]
    done = before.filter("resolved").groupBy(*keys).agg(F.max("resolution").alias("_r")).withColumn("_done", F.lit(True))
    out = after.join(done, keys, "left")
    out = out.withColumn("resolved", F.col("resolved") | F.coalesce("_done", F.lit(False))).withColumn("resolution", F.coalesce("_r", "resolution"))
    return out.select(*COLUMNS)
