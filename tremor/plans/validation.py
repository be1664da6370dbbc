"""Checks of a graph, and the suite of assertions that pins its behaviour: every check is a query that must give no rows."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tremor.operators import graph, traverse
from tremor.operators.graph import GraphTables
from tremor.sources.shared import write_text


def problem_rows(components: DataFrame, edges: DataFrame) -> DataFrame:
    """One row (problem) for each thing that forbids a compile: no components, no edges, and components that are named like their id."""
    spark = components.sparkSession
    none = lambda df, what: spark.range(1).select(F.lit(what).alias("problem")).join(df.limit(1).select(F.lit(True).alias("_x")), F.lit(True), "left_anti")
    same = components.filter("name is null or name = '' or name = id").select(F.concat("id", F.lit(": name equals id")).alias("problem"))
    return none(components, "no components").unionByName(none(edges, "no edges")).unionByName(same)


def problems(g: GraphTables, most: int = 100) -> list[str]:
    """The first of them, for a report."""
    found = problem_rows(g.components, g.edges)
    rank = F.when(F.col("problem") == "no components", 0).when(F.col("problem") == "no edges", 1).otherwise(2)
    return [r[0] for r in found.orderBy(rank, "problem").limit(most).collect()]


@dataclass(frozen=True)
class Case:
    """``name`` holds while ``expected`` is what the graph gives for ``kind`` and ``arg``."""

    category: str
    name: str
    kind: str
    arg: str
    expected: object


def observe(g: GraphTables, kind: str, arg: str):
    match kind:
        case "count":
            return graph.graph_summary(g.components, g.edges, g.variants).first()[arg]
        case "exists":
            return g.components.filter(F.col("id") == arg).count()
        case "users":
            return sorted({r[0] for r in graph.module_components(g, arg).collect()})
        case "members":
            return sorted({r[0] for r in g.variant_components.filter(F.col("variant_id") == arg).select("component_id").collect()})
        case "direct" | "indirect" | "reached":
            impacts = traverse.impact_of(g, [arg], 3)[0]
            if kind != "reached":
                impacts = impacts.filter("is_direct" if kind == "direct" else "not is_direct")
            return sorted(r[0] for r in impacts.select("component_id").collect())
        case "bipartite":
            return g.edges.join(g.components.select(F.col("id").alias("module_id")), "module_id", "left_semi").count()
        case "bare_edges":
            return g.edges.filter("coupling is null or usage is null").count()
    raise ValueError(kind)


def generate(g: GraphTables, direct: int = 15, indirect: int = 5, cycles: int = 3) -> list[Case]:
    """A suite from the graph as it is; samples of it are bounded, as it is read by people."""
    ids = [r.id for r in g.components.orderBy("load_ord").limit(max(indirect, cycles)).collect()]
    out = [Case("structure", f"{k}_holds", "count", k, observe(g, "count", k)) for k in ("component_count", "module_count", "edge_count", "variant_count", "shared_module_count")]
    out += [Case("structure", f"{i}_exists", "exists", i, 1) for i in ids]
    out += [Case("structure", "bipartite", "bipartite", "", observe(g, "bipartite", "")), Case("structure", "edges_have_attributes", "bare_edges", "", 0)]
    shared = graph.shared_module_lists(graph.bipartite(g)).orderBy("module_id").limit(direct).collect()
    for r in shared:
        out.append(Case("structure", f"users_of_{r.module_id}", "users", r.module_id, r.components))
        out.append(Case("direct_impact", f"{r.components[0]}_through_{r.module_id}", "direct", r.components[0], observe(g, "direct", r.components[0])))
    for i in ids[:indirect]:
        if far := observe(g, "indirect", i):
            out.append(Case("indirect_impact", f"beyond_{i}", "indirect", i, far))
    for r in g.variants.orderBy("load_ord").limit(direct).collect():
        out.append(Case("variant", f"members_of_{r.id}", "members", r.id, observe(g, "members", r.id)))
    out += [Case("cycle", f"ends_from_{i}", "reached", i, observe(g, "reached", i)) for i in ids[:cycles]]
    return out


def run(g: GraphTables, cases: list[Case]) -> list[tuple[Case, object]]:
    """The cases that fail, with what was seen."""
    seen = [(c, observe(g, c.kind, c.arg)) for c in cases]
    return [(c, v) for c, v in seen if v != c.expected]


def to_pytest(cases: list[Case]) -> str:
    """A test module; the fixture ``graph`` has to give the graph."""
    head = '"""Generated."""\n\nimport pytest\n\nfrom tremor.plans.validation import observe\n\n'
    rows = ",\n".join(f"    ({c.category!r}, {c.name!r}, {c.kind!r}, {c.arg!r}, {c.expected!r})" for c in cases)
    return f"{head}CASES = [\n{rows},\n]\n\n\n@pytest.mark.parametrize(\"category,name,kind,arg,expected\", CASES)\ndef test_graph(graph, category, name, kind, arg, expected):\n    assert observe(graph, kind, arg) == expected\n"


def write_pytest(spark: SparkSession, cases: list[Case], path: str) -> str:
    return write_text(spark, path, to_pytest(cases))
