"""A component graph over the whole order tables: orders are components, parts are modules, nations are variants.

An order and a part are linked by every line; the greatest quantity is the coupling. The request is that all orders of one customer change.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tremor.functions.ordinals import coupling_name, coupling_rank
from tremor.operators.traverse import Laid
from tremor.sources.shared import buckets, dealt, exists

MAX_DEPTH = 5


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: By session and folder, the edges that were written for it.
_EDGES: dict[tuple[str, str], Laid] = {}


def laid(spark: SparkSession, sf_dir: str) -> Laid:
    """The edges dealt by component and by module; two written tables, as traversals and queries read them many times."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _EDGES or not all(exists(spark, t.inputFiles()[0]) for t in (_EDGES[key].by_component, _EDGES[key].by_module)):
        _EDGES[key] = _edges(spark, sf_dir)
    return _EDGES[key]


def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """component_id, module_id, coupling, mod_ord, comp_ord."""
    return laid(spark, sf_dir).by_module


def _edges(spark: SparkSession, sf_dir: str) -> Laid:
    """Lines are dealt by order once, edges by part once; what is written is dealt as it was computed."""
    line = read(spark, sf_dir, "lineitem")
    n = buckets(spark, line.count())
    k = F.when(F.col("l_quantity") >= 34, 3).when(F.col("l_quantity") >= 17, 2).otherwise(1)
    e = line.select(F.col("l_orderkey").cast("long").alias("component_id"), F.col("l_partkey").cast("long").alias("module_id"), k.alias("k")).repartition(n, "component_id")
    e = e.groupBy("component_id", "module_id").agg(F.max("k").alias("k"))
    e = e.withColumn("mod_ord", F.row_number().over(Window.partitionBy("component_id").orderBy("module_id")))
    by_component = dealt(e.select("component_id", "module_id", coupling_name(F.col("k")).alias("coupling"), "mod_ord"), "edges-by-component", "component_id", n, ready=True)
    e = by_component.select("component_id", "module_id", coupling_rank(F.col("coupling")).alias("k"), "mod_ord").repartition(n, "module_id")
    e = e.withColumn("comp_ord", F.row_number().over(Window.partitionBy("module_id").orderBy("component_id")))
    return Laid(by_component, dealt(e.select("component_id", "module_id", coupling_name(F.col("k")).alias("coupling"), "mod_ord", "comp_ord"), "edges-by-module", "module_id", n, ready=True))


CUSTOMER = 1


def changed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """component_id, pos: the orders of the customer, those without lines included."""
    mine = read(spark, sf_dir, "orders").filter(F.col("o_custkey") == CUSTOMER)
    return mine.select(F.col("o_orderkey").alias("component_id"), F.col("o_orderkey").alias("pos"))


def components(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, name, criticality by priority, and the price."""
    p = F.substring("o_orderpriority", 1, 1)
    crit = F.when(p == "1", "critical").when(p == "2", "high").when(p == "3", "medium").otherwise("low")
    return read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.concat(F.lit("Order "), "o_orderkey").alias("name"), crit.alias("criticality"), "o_totalprice")


def members(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = read(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    customers = read(spark, sf_dir, "customer").select("c_custkey", "c_nationkey")
    return orders.join(customers, orders.o_custkey == customers.c_custkey).select(F.col("c_nationkey").alias("variant_id"), F.col("o_orderkey").alias("component_id"))


EDGES_SQL = f"""e AS (
  SELECT component_id, module_id, k, CASE k WHEN 3 THEN 'tight' WHEN 2 THEN 'loose' ELSE 'optional' END AS coupling,
    row_number() OVER (PARTITION BY component_id ORDER BY module_id) AS mod_ord,
    row_number() OVER (PARTITION BY module_id ORDER BY component_id) AS comp_ord
  FROM (SELECT l_orderkey AS component_id, l_partkey AS module_id,
          max(CASE WHEN l_quantity >= 34 THEN 3 WHEN l_quantity >= 17 THEN 2 ELSE 1 END) AS k
        FROM lineitem GROUP BY 1, 2)),
changed AS (SELECT o_orderkey AS component_id FROM orders WHERE o_custkey = {CUSTOMER}),
known AS (SELECT component_id FROM changed WHERE component_id IN (SELECT component_id FROM e))"""
COMPONENTS_SQL = """comp AS (SELECT o_orderkey AS id, 'Order ' || o_orderkey AS name, c_nationkey AS variant_id, o_totalprice, CASE left(o_orderpriority, 1) WHEN '1' THEN 'critical'
  WHEN '2' THEN 'high' WHEN '3' THEN 'medium' ELSE 'low' END AS criticality FROM orders JOIN customer ON o_custkey = c_custkey)"""


def levels_sql(weak: bool = True, depth: int = MAX_DEPTH) -> str:
    """CTEs of a level-wise search with first discoveries: ``found`` has component_id, depth, min rank and chain."""
    strict = "" if weak else " AND a.coupling NOT IN ('loose', 'optional')"
    out = ["l0 AS (SELECT component_id AS c, row_number() OVER (ORDER BY component_id) AS pos, 3 AS rank, [component_id] AS chain, 0 AS depth FROM known)"]
    for d in range(1, depth + 1):
        before = " UNION ALL ".join(f"SELECT c FROM l{i}" for i in range(d))
        out.append(
            f"""l{d} AS (SELECT n AS c, row_number() OVER (ORDER BY pos, mod_ord, comp_ord) AS pos, rank, chain, {d} AS depth FROM (
  SELECT b.component_id AS n, p.pos, a.mod_ord, b.comp_ord, least(p.rank, a.k, b.k) AS rank, list_concat(p.chain, [a.module_id, b.component_id]) AS chain,
    row_number() OVER (PARTITION BY b.component_id ORDER BY p.pos, a.mod_ord, b.comp_ord) AS rn
  FROM l{d - 1} p JOIN e a ON a.component_id = p.c{strict} JOIN e b ON b.module_id = a.module_id
  WHERE b.component_id NOT IN ({before})) WHERE rn = 1)"""
        )
    every = " UNION ALL ".join(f"SELECT * FROM l{d}" for d in range(1, depth + 1))
    out.append(f"found AS (SELECT c AS component_id, depth, pos, CASE rank WHEN 3 THEN 'tight' WHEN 2 THEN 'loose' ELSE 'optional' END AS min_coupling, chain FROM ({every}))")
    return ",\n".join(out)
