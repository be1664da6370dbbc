"""Text documents of a graph, for retrieval."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_COLUMNS = ["doc_id", "text", "component_id", "component_name", "doc_type", "criticality", "team_owner", "module_id", "coupling", "module_count", "load_ord", "part", "pos"]


def _doc(df: DataFrame, kind: str, part: int, doc_id: Column, text: Column, **more: Column) -> DataFrame:
    cols = {"team_owner": F.lit(None).cast("string"), "module_id": F.lit(None).cast("string"), "coupling": F.lit(None).cast("string"), "module_count": F.lit(None).cast("int"), "pos": F.lit(0)} | more
    return df.select(
        doc_id.alias("doc_id"), text.alias("text"), F.col("id").alias("component_id"), F.col("name").alias("component_name"),
        F.lit(kind).alias("doc_type"), "criticality", *(c.alias(n) for n, c in cols.items()), "load_ord", F.lit(part).alias("part"),
    ).select(*_COLUMNS)


def prepare_documents(components: DataFrame) -> DataFrame:
    """Description, one per module use, interface and summary of each component; order by load_ord, part, pos.

    One scan: each component explodes into its documents.
    """
    c, F_ = components, F.col
    described = _doc(
        c, "description", 0, F.concat("id", F.lit("__description")),
        F.format_string("%s (%s): %s\nTeam: %s. Criticality: %s.", "name", "id", F.btrim("description", F.lit(" \t\r\n")), "team_owner", "criticality"),
        team_owner=F_("team_owner"),
    )
    m = c.select("*", F.posexplode("modules").alias("pos", "m"))
    coupling = F.coalesce("m.coupling", F.lit("unknown"))
    used = _doc(
        m, "module_usage", 1, F.concat("id", F.lit("__module__"), "m.module_id"),
        F.format_string("%s uses module '%s': %s. Coupling: %s.", "name", "m.module_id", F.coalesce("m.usage", F.lit("No description available")), coupling),
        module_id=F_("m.module_id"), coupling=coupling, pos=F_("pos"),
    )
    listed = F.array_join(F.transform("api_surface", lambda e: F.concat(F.lit("  - "), e)), "\n")
    api = _doc(c.filter(F.size("api_surface") > 0), "api_surface", 2, F.concat("id", F.lit("__api_surface")), F.concat("name", F.lit(" API endpoints:\n"), listed))
    summary = _doc(
        c, "summary", 3, F.concat("id", F.lit("__summary")),
        F.format_string(
            "Component: %s (ID: %s)\nPurpose: %s\nTeam: %s\nCriticality: %s\nShared modules: %s\nAPI endpoints: %d",
            "name", "id", F.btrim("description", F.lit(" \t\r\n")), "team_owner", "criticality",
            F.array_join(F.transform("modules", lambda x: x["module_id"]), ", "), F.size("api_surface"),
        ),
        team_owner=F_("team_owner"), module_count=F.size("modules"),
    )
    return described.unionByName(used).unionByName(api).unionByName(summary)


def document_stats(docs: DataFrame, kind: str = "doc_type", entity: str = "component_id", text: str = "text") -> DataFrame:
    """Per kind, and for all (null): documents, distinct entities, characters, whole average."""
    n = F.length(F.coalesce(F.col(text), F.lit("")))
    out = docs.rollup(kind).agg(F.count("*").alias("n_docs"), F.count_distinct(entity).alias("n_entities"), F.sum(n).cast("long").alias("n_chars"))
    return out.withColumn("avg_chars", F.expr("n_chars div n_docs"))
