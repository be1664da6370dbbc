"""Ingestion of a source tree: scan, parse, detect, link, merge, and the graph of it all."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tremor.operators import ingest
from tremor.operators.graph import COMPONENT_SCHEMA, VARIANT_SCHEMA, GraphTables, build_graph
from tremor.sources import code, definitions, repository
from tremor.sources.shared import written


@dataclass(frozen=True)
class Ingested:
    graph: GraphTables
    components: DataFrame
    modules: DataFrame
    warnings: DataFrame
    files: DataFrame


def ingest_tree(spark: SparkSession, root: str, detection: str = "auto", granularity: str = "manifest", min_methods: int = 2, languages: tuple[str, ...] = ("typescript", "javascript", "csharp")) -> Ingested:
    """``root`` must be a folder. YAML definitions below it come first; what is detected adds new ids."""
    path = spark._jvm.org.apache.hadoop.fs.Path(root)
    if not path.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(path).isDirectory():
        raise ValueError(f"{root} is not a folder")
    if granularity not in ingest.GRANULARITIES:
        raise ValueError(f"artifact granularity {granularity!r}")
    raw = written(repository.scan(spark, root), "scan")
    files = repository.classified(raw)
    bounds = repository.boundaries(raw)
    parsed = written(repository.ordered(code.python_files(files)), "parsed")
    found = ingest.detect(parsed, bounds.filter(F.col("marker").isin(*repository.MARKERS)), detection, min_methods).withColumn("team_owner", F.lit(""))
    imports = ingest.import_graph(parsed)
    modules = ingest.shared_modules(found, imports, parsed)
    found = ingest.with_api_surface(ingest.wire(found, modules), parsed)
    artifacts = ingest.granularity(code.manifests(files, languages), granularity, bounds)
    components, warned = ingest.merge_manifests(found, artifacts)
    components = written(components, "components")
    defined = [_defined(spark, root, kind, files) for kind in ("components", "variants")]
    graph = build_graph(ingest.combine(defined[0], components), defined[1])
    users = ingest.module_users(components)
    unread = code.sln_warnings(files, code.csproj(files))
    return Ingested(graph, components, users, warned.unionByName(ingest.warnings(components, users)).unionByName(unread), files)


def _defined(spark: SparkSession, root: str, kind: str, files: DataFrame) -> DataFrame:
    if files.filter(F.col("path").rlike(rf"^data/{kind}/[^/]+\.yaml$")).isEmpty():
        return spark.createDataFrame([], COMPONENT_SCHEMA if kind == "components" else VARIANT_SCHEMA)
    return definitions.read_definitions(spark, f"{root}/data/{kind}", kind, tolerant=True)


def ingest_yaml(spark: SparkSession, components: str, variants: str) -> GraphTables:
    return build_graph(definitions.read_definitions(spark, components, "components", True), definitions.read_definitions(spark, variants, "variants", True))


def as_parsed(got: Ingested) -> DataFrame:
    """What gap detection asks of an ingestion: id, name, source_file, confidence, ord."""
    place = F.xxhash64("id")
    return got.components.select("id", "name", "source_file", "confidence", place.alias("ord"))
