"""The component graph: tables and lookups.

Components and variants are nested rows; edges come from them by position. Order means something here (the first
discovery of a traversal wins), so an edge carries its place among its component's modules and among its module's components.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tremor.operators.components import connected_components

COMPONENT_SCHEMA = (
    "id string, name string, description string, team_owner string, criticality string, "
    "modules array<struct<module_id:string,coupling:string,usage:string>>, api_surface array<string>, load_ord int"
)
VARIANT_SCHEMA = (
    "id string, name string, tier string, region string, description string, max_seats int, "
    "components array<struct<component_id:string,features:array<string>,config_overrides:string>>, metadata string, load_ord int"
)


@dataclass(frozen=True)
class GraphTables:
    """edges: component_id, module_id, coupling, usage, mod_ord, comp_ord. variant_components: variant_id, component_id, ord."""

    components: DataFrame
    edges: DataFrame
    variants: DataFrame
    variant_components: DataFrame


def last_wins(df: DataFrame, key: str = "id", order: str = "load_ord") -> DataFrame:
    """Upsert: the last row of a key stays, at the place where the key first came."""
    w = Window.partitionBy(key)
    ranked = df.withColumn("_rn", F.row_number().over(w.orderBy(F.desc(order)))).withColumn("_first", F.min(order).over(w))
    return ranked.filter("_rn = 1").withColumn(order, F.col("_first")).drop("_rn", "_first")


def build_graph(components: DataFrame, variants: DataFrame) -> GraphTables:
    """Fills defaults, upserts by id and derives the edges; edges to a module that is itself a component stay listed."""
    every = components.filter("id is not null")
    # An edge is at the place of its first mention and has the attributes of its last; edges of replaced definitions stay.
    # Definitions move by id before they become edges, in one exchange for all that is asked of a component.
    told = every.repartition("id").select("id", "load_ord", F.posexplode("modules").alias("pos", "m"))
    at = Window.partitionBy("id", "m.module_id")
    edges = (
        told.filter("m.module_id is not null")
        .withColumn("_last", F.row_number().over(at.orderBy(F.desc("load_ord"), F.desc("pos"))))
        .withColumn("_first", F.min(F.struct("load_ord", "pos")).over(at))
        .filter("_last = 1")
        .select(F.col("id").alias("component_id"), "m.module_id", F.coalesce("m.coupling", F.lit("tight")).alias("coupling"), F.coalesce("m.usage", F.lit("")).alias("usage"), "_first")
    )
    edges = edges.select(
        "component_id",
        "module_id",
        "coupling",
        "usage",
        F.row_number().over(Window.partitionBy("component_id").orderBy("_first")).alias("mod_ord"),
        F.row_number().over(Window.partitionBy("module_id").orderBy("_first", "component_id")).alias("comp_ord"),
    )
    nodes = last_wins(every).select(
        "id",
        "name",
        F.coalesce("description", F.lit("")).alias("description"),
        F.coalesce("team_owner", F.lit("")).alias("team_owner"),
        F.coalesce("criticality", F.lit("medium")).alias("criticality"),
        F.coalesce("modules", F.expr("array()")).alias("modules"),
        F.coalesce("api_surface", F.expr("cast(array() as array<string>)")).alias("api_surface"),
        "load_ord",
    )
    known = variants.filter("id is not null")
    members = known.select(F.col("id").alias("variant_id"), "load_ord", F.posexplode("components").alias("pos", "c"))
    members = members.select("variant_id", "c.component_id", F.struct("load_ord", "pos").alias("ord"))
    return GraphTables(nodes, edges, last_wins(known).withColumn("max_seats", F.coalesce("max_seats", F.lit(-1))), members)


def bipartite(g: GraphTables) -> DataFrame:
    """Edges whose module end is a module: what a component is named like is no module for traversal and lookups."""
    return g.edges.join(g.components.select(F.col("id").alias("module_id")), "module_id", "left_anti")


def modules_of(edges: DataFrame, asked: DataFrame) -> DataFrame:
    """Rows of component_id, mod_ord, module_id, coupling (and usage) for the components of ``asked`` (component_id)."""
    return edges.join(asked.select("component_id").distinct(), "component_id", "left_semi").drop("comp_ord")


def users_of(edges: DataFrame, asked: DataFrame) -> DataFrame:
    """Rows of module_id, comp_ord, component_id for the modules of ``asked`` (module_id): a hub's users are rows, not a list."""
    return edges.join(asked.select("module_id").distinct(), "module_id", "left_semi").select("module_id", "comp_ord", "component_id")


def component_modules(g: GraphTables, component_id: str) -> DataFrame:
    asked = g.edges.sparkSession.createDataFrame([(component_id,)], "component_id string")
    return modules_of(bipartite(g), asked).orderBy("mod_ord").select("module_id", "coupling", "usage")


def module_components(g: GraphTables, module_id: str) -> DataFrame:
    asked = g.edges.sparkSession.createDataFrame([(module_id,)], "module_id string")
    return users_of(bipartite(g), asked).orderBy("comp_ord").select("component_id")


def variants_of(members: DataFrame, asked: DataFrame) -> DataFrame:
    """Rows of the members (variant_id, component_id) with the components of ``asked`` (component_id)."""
    return members.join(asked.select("component_id").distinct(), "component_id", "left_semi")


def edges_of(edges: DataFrame, asked: DataFrame) -> DataFrame:
    """The edges between the ends that ``asked`` (component_id, module_id) names."""
    return edges.join(asked.select("component_id", "module_id").distinct(), ["component_id", "module_id"], "left_semi")


def component_variants(g: GraphTables, component_id: str) -> DataFrame:
    asked = g.edges.sparkSession.createDataFrame([(component_id,)], "component_id string")
    return variants_of(g.variant_components, asked).orderBy("ord").select("variant_id")


def edge_attributes(g: GraphTables, component_id: str, module_id: str) -> DataFrame:
    asked = g.edges.sparkSession.createDataFrame([(component_id, module_id)], "component_id string, module_id string")
    return edges_of(g.edges, asked).select("coupling", "usage")


def shared_modules(edges: DataFrame) -> DataFrame:
    """Modules of two components at least, with their number; the list of components is bounded by them."""
    return edges.select("module_id", "component_id").distinct().groupBy("module_id").agg(F.count("*").alias("n_components")).filter("n_components >= 2")


def shared_module_lists(edges: DataFrame) -> DataFrame:
    return edges.groupBy("module_id").agg(F.sort_array(F.collect_set("component_id")).alias("components")).filter("size(components) >= 2")


def graph_summary(components: DataFrame, edges: DataFrame, variants: DataFrame) -> DataFrame:
    """One row: total_nodes, component_count, module_count, edge_count, variant_count, shared_module_count."""
    ids = components.select(F.col("id").alias("module_id")).distinct()
    modules = edges.groupBy("module_id").agg(F.count_distinct("component_id").alias("n")).join(ids, "module_id", "left_anti")
    m = modules.agg(F.count("*").alias("module_count"), F.count(F.when(F.col("n") >= 2, 1)).alias("shared_module_count"))
    one = (
        components.agg(F.count("*").alias("component_count"))
        .crossJoin(m)
        .crossJoin(edges.agg(F.count("*").alias("edge_count")))
        .crossJoin(variants.agg(F.count("*").alias("variant_count")))
    )
    return one.select(
        (F.col("component_count") + F.col("module_count")).alias("total_nodes"),
        "component_count", "module_count", "edge_count", "variant_count", "shared_module_count",
    )


def connectivity(edges: DataFrame) -> DataFrame:
    """(node, component) over component and module ids, each made distinct by a prefix."""
    return connected_components(edges.select(F.concat(F.lit("c:"), "component_id").alias("u"), F.concat(F.lit("m:"), "module_id").alias("v")))


def empty_graph(spark: SparkSession) -> GraphTables:
    return build_graph(spark.createDataFrame([], COMPONENT_SCHEMA), spark.createDataFrame([], VARIANT_SCHEMA))
