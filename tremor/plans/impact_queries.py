"""Queries over the order tables for graph, traversal, score and gap operators, with their DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tremor.functions.ordinals import coupling_rank
from tremor.operators import gaps, graph, score, traverse
from tremor.operators.components import connected_components
from tremor.plans import tables as T
from tremor.sources.shared import written

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def _found(spark: SparkSession, sf_dir: str, **what) -> DataFrame:
    return traverse.traverse(T.laid(spark, sf_dir), T.changed(spark, sf_dir), T.MAX_DEPTH, **what)


def _depths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """component_id, depth, is_direct: all that counts of components need."""
    return _found(spark, sf_dir, paths=False).withColumn("is_direct", F.col("depth") == 1)


def _rated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Impacts with criticality, without their chains, which no score needs."""
    comp = T.components(spark, sf_dir).select(F.col("id").alias("component_id"), "criticality")
    return _found(spark, sf_dir, chains=False).join(comp, "component_id", "left")


_W = f"WITH {T.EDGES_SQL},\n{T.levels_sql()}"
_WC = f"WITH {T.EDGES_SQL},\n{T.levels_sql()},\n{T.COMPONENTS_SQL}"


@query(f"{_W} SELECT component_id, depth FROM found")
def bfs_min_depth(spark, sf_dir):
    return _found(spark, sf_dir, paths=False)


@query(f"{_W} SELECT depth, count(*) AS n FROM found GROUP BY depth")
def bfs_depth_histogram(spark, sf_dir):
    return bfs_min_depth(spark, sf_dir).groupBy("depth").agg(F.count("*").alias("n"))


@query(f"WITH {T.EDGES_SQL},\n{T.levels_sql(weak=False)} SELECT component_id, depth FROM found")
def bfs_strict(spark, sf_dir):
    return _found(spark, sf_dir, weak=False, paths=False)


@query(f"{_W} SELECT component_id, depth, depth = 1 AS is_direct, min_coupling, chain[1] AS source, array_to_string(chain, ' → ') || ' (depth=' || depth || ', min_coupling=' || min_coupling || ')' AS path FROM found")
def bfs_best_path(spark, sf_dir):
    found = _found(spark, sf_dir)
    path = traverse.describe_path(F.col("chain").cast("array<string>"), F.col("depth"), F.col("min_coupling"))
    return found.select("component_id", "depth", "is_direct", "min_coupling", "source", path.alias("path"))


@query(f"{_WC}, mine AS (SELECT DISTINCT module_id FROM e SEMI JOIN changed USING (component_id)) SELECT component_id, list_sort(list(DISTINCT module_id)) AS shared_modules FROM e SEMI JOIN mine USING (module_id) SEMI JOIN found USING (component_id) GROUP BY component_id")
def shared_with_changed(spark, sf_dir):
    found = _depths(spark, sf_dir)
    return traverse.shared_with_changed(T.edges(spark, sf_dir), T.changed(spark, sf_dir)).join(found.select("component_id"), "component_id", "left_semi")


_VARIANT = """, touched AS (SELECT component_id, depth FROM found UNION ALL SELECT component_id, 0 FROM changed),
rows AS (SELECT comp.variant_id, component_id, depth, CASE criticality WHEN 'critical' THEN 4 WHEN 'high' THEN 3 WHEN 'medium' THEN 2 ELSE 1 END AS r, criticality
  FROM comp JOIN touched ON comp.id = component_id)"""
_NAME = "CASE max(r) WHEN 4 THEN 'critical' WHEN 3 THEN 'high' WHEN 2 THEN 'medium' ELSE 'low' END AS max_criticality"


@query(f"{_WC}{_VARIANT} SELECT variant_id, list_sort(list(DISTINCT component_id)) AS affected_components, count(*) FILTER (depth <= 1) AS direct_count, count(*) FILTER (depth > 1) AS indirect_count, {_NAME} FROM rows GROUP BY variant_id")
def variant_impacts(spark, sf_dir):
    return traverse.variant_impacts(T.members(spark, sf_dir), T.changed(spark, sf_dir), _depths(spark, sf_dir), T.components(spark, sf_dir))


_SCORE = "round_even(cast((CASE min_coupling WHEN 'tight' THEN 1.0 WHEN 'loose' THEN 0.5 ELSE 0.2 END) * (CASE criticality WHEN 'critical' THEN 4 WHEN 'high' THEN 2 WHEN 'medium' THEN 1 ELSE 0.5 END) / depth * {boost} AS DOUBLE), 2)"
_SCORED = f", scored AS (SELECT component_id, depth, min_coupling, criticality, {_SCORE.format(boost='1')} AS score FROM found JOIN comp ON id = component_id)"
_LEVEL = "CASE WHEN {x} >= 7 THEN 'CRITICAL' WHEN {x} >= 4 THEN 'HIGH' WHEN {x} >= 2 THEN 'MEDIUM' ELSE 'LOW' END"


def _no_semantic(spark):
    return spark.createDataFrame([], "component_id long, best_score double, criticality string")


@query(f"{_WC}{_SCORED} SELECT component_id, depth, depth = 1 AS is_direct, min_coupling AS coupling, criticality, score FROM scored")
def scored_impacts(spark, sf_dir):
    found = _rated(spark, sf_dir)
    return score.scored_impacts(found, _no_semantic(spark)).select("component_id", "depth", "is_direct", "coupling", "criticality", "score")


@query(f"{_WC}{_SCORED} SELECT component_id, score, {_LEVEL.format(x='score')} AS level FROM scored ORDER BY score DESC, component_id LIMIT 20")
def top_impacts(spark, sf_dir):
    found = _rated(spark, sf_dir)
    return score.ranked(score.scored_impacts(found, _no_semantic(spark)), "component_id").limit(20).select("component_id", "score", score.risk_level(F.col("score")).alias("level"))


@query(f"""{_WC}{_SCORED}, touched AS (SELECT component_id, depth, score FROM scored UNION ALL SELECT component_id, 0, 0 FROM changed),
rows AS (SELECT variant_id, component_id, depth, score, CASE criticality WHEN 'critical' THEN 4 WHEN 'high' THEN 3 WHEN 'medium' THEN 2 ELSE 1 END AS r FROM comp JOIN touched ON id = component_id),
agg AS (SELECT variant_id, count(*) AS affected_count, count(*) FILTER (depth <= 1) AS direct_count, count(*) FILTER (depth > 1) AS indirect_count, {_NAME}, cast(sum(cast(score AS DECIMAL(18, 2))) AS DOUBLE) AS risk_score FROM rows GROUP BY variant_id)
SELECT *, {_LEVEL.format(x='risk_score')} AS risk_level FROM agg""")
def variant_risk(spark, sf_dir):
    scored = score.scored_impacts(_rated(spark, sf_dir), _no_semantic(spark))
    return score.variant_risks(T.members(spark, sf_dir), T.changed(spark, sf_dir), scored, T.components(spark, sf_dir))


#: Similar components beside the graph's own: expensive orders, by a score of their id.
_SEM = "sem AS (SELECT id AS component_id, criticality, 0.25 + (id % 4) * 0.125 AS b FROM comp WHERE o_totalprice > 150000)"


def _semantic(comp):
    return comp.filter("o_totalprice > 150000").select(F.col("id").alias("component_id"), "criticality", (0.25 + F.col("id") % 4 * 0.125).alias("best_score"))


@query(f"""{_WC}, {_SEM}, both_ AS (SELECT f.component_id, depth, {_SCORE.format(boost='(CASE WHEN b IS NULL THEN 1 ELSE 1.25 END)').replace('criticality', 'comp.criticality')} AS score FROM found f JOIN comp ON id = f.component_id LEFT JOIN sem ON sem.component_id = f.component_id WHERE depth <= 1),
rows AS (SELECT variant_id, r.score, CASE criticality WHEN 'critical' THEN 4 WHEN 'high' THEN 3 WHEN 'medium' THEN 2 ELSE 1 END AS r
  FROM comp JOIN (SELECT component_id, score FROM both_ UNION ALL SELECT component_id, 0 FROM changed) r ON id = component_id)
SELECT variant_id, count(*) AS affected_count, {_NAME}, cast(sum(cast(score AS DECIMAL(18, 2))) AS DOUBLE) AS risk_score FROM rows GROUP BY variant_id""")
def variant_risk_semantic(spark, sf_dir):
    """One level of the graph and many similar components outside it: these raise scores of what is in the graph, and reach no variant."""
    changed, comp = T.changed(spark, sf_dir), T.components(spark, sf_dir)
    found = traverse.traverse(T.laid(spark, sf_dir), changed, 1, chains=False).join(comp.select(F.col("id").alias("component_id"), "criticality"), "component_id", "left")
    risks = score.variant_risks(T.members(spark, sf_dir), changed, score.scored_impacts(found, _semantic(comp)), comp)
    return risks.select("variant_id", "affected_count", "max_criticality", "risk_score")


@query("SELECT o_orderkey, CASE WHEN o_totalprice / 50000 >= 7 THEN 'CRITICAL' WHEN o_totalprice / 50000 >= 4 THEN 'HIGH' WHEN o_totalprice / 50000 >= 2 THEN 'MEDIUM' ELSE 'LOW' END AS level FROM orders")
def risk_levels(spark, sf_dir):
    return T.read(spark, sf_dir, "orders").select("o_orderkey", score.risk_level(F.col("o_totalprice") / 50000).alias("level"))


@query(f"WITH {T.EDGES_SQL}, known_modules AS (SELECT count(*) AS n FROM e) SELECT 'no components' AS problem WHERE (SELECT count(*) FROM orders) = 0 UNION ALL SELECT 'no edges' FROM known_modules WHERE n = 0 UNION ALL SELECT o_orderkey || ': name equals id' FROM orders WHERE o_orderkey % 1000 = 7")
def validate_graph(spark, sf_dir):
    """The checks before a compile, where every thousandth order has no name of its own."""
    from tremor.plans import validation

    ident = F.col("o_orderkey").cast("string")
    c = T.read(spark, sf_dir, "orders").select(ident.alias("id"), F.when(F.col("o_orderkey") % 1000 == 7, ident).otherwise(F.concat(F.lit("Order "), ident)).alias("name"))
    return validation.problem_rows(c, T.edges(spark, sf_dir))


@query(f"{_W} SELECT (SELECT count(*) FROM changed) AS changed, count(*) FILTER (depth = 1) AS direct, count(*) FILTER (depth > 1) AS indirect, count(*) AS total, (SELECT count(DISTINCT c_nationkey) FROM customer JOIN orders ON o_custkey = c_custkey WHERE o_orderkey IN (SELECT component_id FROM changed UNION ALL SELECT component_id FROM found)) AS variants_affected, count(*) AS paths FROM found")
def impact_summary(spark, sf_dir):
    changed, comp, found = T.changed(spark, sf_dir), T.components(spark, sf_dir), _depths(spark, sf_dir)
    return traverse.result_summary(changed, found, traverse.variant_impacts(T.members(spark, sf_dir), changed, found, comp))


@query(f"WITH {T.EDGES_SQL} SELECT module_id, count(DISTINCT component_id) AS n_components FROM e GROUP BY 1 HAVING count(DISTINCT component_id) >= 2")
def shared_modules(spark, sf_dir):
    return graph.shared_modules(T.edges(spark, sf_dir))


_OFFERS = "SELECT l_partkey || ':' || l_suppkey AS module_id, l_orderkey AS component_id FROM lineitem"


@query(f"SELECT module_id, min(component_id) AS component_id FROM ({_OFFERS}) GROUP BY 1 HAVING count(DISTINCT component_id) = 1")
def isolated_modules(spark, sf_dir):
    """Here the offers of suppliers are modules: every part is in many orders."""
    return gaps.isolated_modules(_offers(spark, sf_dir))


def _offers(spark, sf_dir):
    return T.read(spark, sf_dir, "lineitem").select(F.concat_ws(":", "l_partkey", "l_suppkey").alias("module_id"), F.col("l_orderkey").alias("component_id"))


@query(f"""WITH {T.EDGES_SQL}, m AS (SELECT module_id, count(DISTINCT component_id) AS n FROM e GROUP BY 1)
SELECT (SELECT count(*) FROM orders) + (SELECT count(*) FROM m) AS total_nodes, (SELECT count(*) FROM orders) AS component_count, (SELECT count(*) FROM m) AS module_count,
  (SELECT count(*) FROM e) AS edge_count, (SELECT count(*) FROM nation) AS variant_count, (SELECT count(*) FROM m WHERE n >= 2) AS shared_module_count""")
def graph_summary(spark, sf_dir):
    # order and part keys are two kinds of ids, so module ids are told apart before they meet component ids
    e = T.edges(spark, sf_dir).withColumn("module_id", F.concat(F.lit("m"), "module_id"))
    comp = T.components(spark, sf_dir).withColumn("id", F.concat(F.lit("c"), "id"))
    return graph.graph_summary(comp, e, T.read(spark, sf_dir, "nation"))


@query(f"WITH {T.EDGES_SQL} SELECT component_id, mod_ord, module_id, coupling FROM e SEMI JOIN changed USING (component_id)")
def component_modules(spark, sf_dir):
    e = T.edges(spark, sf_dir)
    return graph.modules_of(e, T.changed(spark, sf_dir)).select("component_id", "mod_ord", "module_id", "coupling")


@query(f"WITH {T.EDGES_SQL} SELECT module_id, comp_ord, component_id FROM e WHERE module_id IN (SELECT p_partkey FROM part WHERE p_size > 40)")
def module_components(spark, sf_dir):
    asked = T.read(spark, sf_dir, "part").filter("p_size > 40").select(F.col("p_partkey").alias("module_id"))
    return graph.users_of(T.edges(spark, sf_dir), asked)


@query(f"""WITH RECURSIVE {T.EDGES_SQL}, n AS (SELECT DISTINCT 'c' || component_id AS a, 'm' || module_id AS b FROM e),
s AS (SELECT a AS u, b AS v FROM n UNION ALL SELECT b, a FROM n),
r(node, component) USING KEY (node) AS (SELECT DISTINCT u, u FROM s
  UNION SELECT s.v, min(r.component) FROM r JOIN s ON s.u = r.node JOIN recurring.r AS known ON known.node = s.v WHERE r.component < known.component GROUP BY s.v)
SELECT node, component FROM r""")
def connectivity(spark, sf_dir):
    """Orders are even numbers and parts odd ones while they are linked; the least name of a component is found at the end."""
    e = T.edges(spark, sf_dir)
    found = connected_components(e.select((F.col("component_id") * 2).alias("u"), (F.col("module_id") * 2 + 1).alias("v")))
    name = F.concat(F.when(F.col("node").bitwiseAND(1) == 0, "c").otherwise("m"), F.shiftright("node", 1))
    named = written(found.select(name.alias("node"), F.col("component").alias("number")), "named")
    return named.join(named.groupBy("number").agg(F.min("node").alias("component")), "number").select("node", "component")


@query(f"WITH {T.EDGES_SQL} SELECT o_orderkey AS id, 'Order ' || o_orderkey AS name FROM orders WHERE o_orderkey NOT IN (SELECT component_id FROM e)")
def orphan_components(spark, sf_dir):
    return gaps.orphan_components(T.components(spark, sf_dir), T.edges(spark, sf_dir)).select("id", "name")


@query("SELECT s_suppkey AS id FROM supplier WHERE s_nationkey NOT IN (SELECT n_nationkey FROM nation WHERE n_regionkey < 3)")
def no_variant_assignment(spark, sf_dir):
    """Suppliers are components, the nations of three regions are variants."""
    sup = T.read(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("id"), "s_nationkey")
    sold = T.read(spark, sf_dir, "nation").filter("n_regionkey < 3").select("n_nationkey")
    members = sup.join(sold, sup.s_nationkey == sold.n_nationkey).select(F.col("id").alias("component_id"))
    return gaps.no_variant_assignment(sup, members, sold).select("id")


@query(f"WITH {T.EDGES_SQL} SELECT component_id, count(*) AS n_modules FROM e GROUP BY 1 HAVING count(*) >= 2 AND min(coupling) = 'tight' AND max(coupling) = 'tight'")
def coupling_ambiguity(spark, sf_dir):
    return gaps.coupling_ambiguity(T.edges(spark, sf_dir))


#: Descriptions as a detector leaves them: none, blank, generated, or a person's.
_DESCRIBED = "CASE doc_id % 6 WHEN 0 THEN NULL WHEN 1 THEN '' WHEN 2 THEN ' Service: ' || source WHEN 3 THEN 'Class ' || source WHEN 4 THEN 'Directory module: ' || source ELSE text END"


@query(f"WITH d AS (SELECT doc_id, {_DESCRIBED} AS t FROM documents) SELECT doc_id FROM d WHERE trim(coalesce(t, ''), chr(32) || chr(9) || chr(13) || chr(10) || chr(11) || chr(12)) = '' OR regexp_matches(trim(t, chr(32) || chr(9) || chr(13) || chr(10) || chr(11) || chr(12)), '^(Service:|Class |Directory module:)')")
def missing_description(spark, sf_dir):
    return T.read(spark, sf_dir, "documents").filter(gaps.missing_description(F.expr(_DESCRIBED))).select("doc_id")


_HELD = "h AS (SELECT o_orderkey AS id, cast(o_custkey AS VARCHAR) AS parent FROM orders WHERE o_orderkey IN (SELECT component_id FROM e))"


@query(f"""WITH {T.EDGES_SQL}, {_HELD} SELECT a.parent, a.id AS c1, b.id AS c2 FROM h a JOIN h b ON a.parent = b.parent AND a.id < b.id
WHERE NOT EXISTS (SELECT 1 FROM e x JOIN e y ON x.module_id = y.module_id WHERE x.component_id = a.id AND y.component_id = b.id)""")
def potential_missing_link(spark, sf_dir):
    """Orders of one customer without a part in common; a customer has few orders."""
    return gaps.potential_missing_links(_located(spark, sf_dir), T.edges(spark, sf_dir)).select("parent", "c1", "c2")


def _located(spark, sf_dir):
    key = F.col("o_orderkey")
    return T.read(spark, sf_dir, "orders").select(key.alias("component_id"), F.col("o_custkey").cast("string").alias("parent"), key.alias("ord"))


_BY_NATION = "h AS (SELECT o_orderkey AS id, cast(c_nationkey AS VARCHAR) AS parent FROM orders JOIN customer ON o_custkey = c_custkey WHERE o_orderkey IN (SELECT component_id FROM e))"


@query(f"""WITH {T.EDGES_SQL}, {_BY_NATION},
linked AS (SELECT a.id, count(DISTINCT b.id) AS n FROM h a JOIN e x ON x.component_id = a.id JOIN e y ON y.module_id = x.module_id JOIN h b ON b.id = y.component_id AND b.parent = a.parent AND b.id <> a.id GROUP BY a.id),
total AS (SELECT parent, count(*) - 1 AS siblings FROM h GROUP BY parent)
SELECT parent, h.id AS component_id, siblings, coalesce(n, 0) AS linked, siblings - coalesce(n, 0) AS missing FROM h JOIN total USING (parent) LEFT JOIN linked ON linked.id = h.id""")
def missing_link_counts(spark, sf_dir):
    """Orders of one nation: too many for pairs, so they are counted."""
    located = T.members(spark, sf_dir).select("component_id", F.col("variant_id").cast("string").alias("parent"), F.col("component_id").alias("ord"))
    return gaps.missing_link_counts(located, T.edges(spark, sf_dir)).drop("ord")


@query(f"""WITH {T.EDGES_SQL}, {_BY_NATION},
ends AS (SELECT least(a.id, b.id) AS c1, greatest(a.id, b.id) AS c2, a.parent FROM h a JOIN h b ON a.parent = b.parent AND a.id <> b.id WHERE a.id IN (SELECT max(id) FROM h GROUP BY parent))
SELECT DISTINCT parent, c1, c2 FROM ends
WHERE NOT EXISTS (SELECT 1 FROM e x JOIN e y ON x.module_id = y.module_id WHERE x.component_id = c1 AND y.component_id = c2)""")
def missing_link_pairs(spark, sf_dir):
    """The pairs of the newest order of each nation: one request for each parent."""
    located = T.members(spark, sf_dir).select("component_id", F.col("variant_id").cast("string").alias("parent"), F.col("component_id").alias("ord"))
    e = T.edges(spark, sf_dir)
    newest = located.join(e.select("component_id").distinct(), "component_id", "left_semi").groupBy("parent").agg(F.max("component_id").alias("component_id"))
    return gaps.potential_missing_links(located, e, newest).select("parent", "c1", "c2")


def _gaps(spark, sf_dir):
    comp, e = T.components(spark, sf_dir), T.edges(spark, sf_dir)
    parts = [
        gaps.orphan_components(comp, e).select(F.lit("orphan_component").alias("gap_type"), F.lit("critical").alias("severity"), F.col("id").alias("entity_id")),
        gaps.isolated_modules(_offers(spark, sf_dir)).select(F.lit("isolated_module"), F.lit("medium"), "component_id"),
        gaps.coupling_ambiguity(e).select(F.lit("coupling_ambiguity"), F.lit("medium"), "component_id"),
    ]
    return parts[0].union(parts[1]).union(parts[2]).withColumn("resolved", F.col("entity_id") % 5 == 0)


_GAPS = f"""WITH {T.EDGES_SQL}, g AS (
  SELECT 'orphan_component' AS gap_type, 'critical' AS severity, o_orderkey AS entity_id FROM orders WHERE o_orderkey NOT IN (SELECT component_id FROM e)
  UNION ALL SELECT 'isolated_module', 'medium', min(component_id) FROM ({_OFFERS}) GROUP BY module_id HAVING count(DISTINCT component_id) = 1
  UNION ALL SELECT 'coupling_ambiguity', 'medium', component_id FROM e GROUP BY component_id HAVING count(*) >= 2 AND min(coupling) = 'tight' AND max(coupling) = 'tight')"""


@query(f"{_GAPS} SELECT severity, gap_type, count(*) AS n_gaps, count(*) FILTER (entity_id % 5 = 0) AS n_resolved FROM g GROUP BY GROUPING SETS ((severity), (gap_type), ())")
def gap_report_summary(spark, sf_dir):
    return gaps.gap_summary(_gaps(spark, sf_dir))


@query(f"{_GAPS} SELECT coalesce(avg(CASE WHEN entity_id % 5 = 0 THEN 1.0 ELSE 0.0 END), 1.0) AS completeness FROM g")
def completeness(spark, sf_dir):
    return gaps.completeness(_gaps(spark, sf_dir))


@query("SELECT c_custkey, CASE WHEN a < b THEN 'loose' ELSE 'tight' END AS weakest, greatest(a, b) AS strongest FROM (SELECT c_custkey, c_nationkey % 2 + 2 AS a, 3 AS b FROM customer)")
def ordinal_helpers(spark, sf_dir):
    from tremor.functions.ordinals import strongest_coupling, weaker_coupling

    c = T.read(spark, sf_dir, "customer").withColumn("a", F.when(F.col("c_nationkey") % 2 == 0, "loose").otherwise("tight")).withColumn("b", F.lit("tight"))
    return c.select("c_custkey", weaker_coupling(F.col("a"), F.col("b")).alias("weakest"), coupling_rank(strongest_coupling(F.array("a", "b"))).alias("strongest"))
