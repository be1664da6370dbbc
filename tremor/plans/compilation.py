"""Compiles a curated graph for use: checks, backup, definitions, vectors, configuration, manifest, in that order.

A graph that fails its checks, or components that cannot be written, end it; later steps note what went wrong and go on. The
sinks run on the executors; only counts and small files pass the driver.
"""

from __future__ import annotations

import json
from collections.abc import Callable
from dataclasses import dataclass, field
from datetime import UTC, datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tremor.operators import gaps as G
from tremor.operators import graph, retrieve
from tremor.operators.graph import GraphTables
from tremor.plans import validation
from tremor.sources import definitions
from tremor.sources.shared import exists, qualified, read_text, write_text

VERSION = "2.0.0"


@dataclass
class Compiled:
    root: str
    components: int = 0
    variants: int = 0
    documents: int = 0
    config_updated: bool = False
    manifest: str = ""
    backup: str = ""
    errors: list[str] = field(default_factory=list)

    @property
    def ok(self) -> bool:
        return not self.errors

    def summary(self) -> dict:
        return {"ok": self.ok, "root": self.root, "components_written": self.components, "variants_written": self.variants, "documents_embedded": self.documents, "config_updated": self.config_updated, "manifest": self.manifest, "backup": self.backup, "errors": self.errors}


def _quality(found: DataFrame) -> dict:
    row = found.agg(
        F.count("*").alias("total_gaps"), F.count(F.when(F.col("resolved"), 1)).alias("resolved_gaps"), F.count(F.when(~F.col("resolved"), 1)).alias("unresolved_gaps"),
        F.count(F.when(F.col("severity") == "critical", 1)).alias("critical_gaps"),
    ).first()
    return {"completeness_score": G.completeness(found).first()[0], **row.asDict()}


def embed_and_store(g: GraphTables, embed: Callable, store: DataFrame | None = None, reset: bool = True) -> tuple[DataFrame, int]:
    """(store with the documents of the graph, their number): into an empty store, or over the rows of one that stays."""
    from tremor.operators.documents import prepare_documents

    rows = retrieve.embed_documents(prepare_documents(g.components), embed)
    return (rows if reset or store is None else retrieve.upsert(store, rows, order="load_ord")), prepare_documents(g.components).count()


def compile_graph(g: GraphTables, root: str, config: str | None = None, embed: Callable | None = None, vectors: str | None = None, found: DataFrame | None = None, backup: bool = True) -> Compiled:
    """Writes ``root``/data and ``root``/deployment_manifest.json; ``config`` is a YAML file, ``vectors`` a table that ``embed`` fills."""
    import yaml

    spark = g.components.sparkSession
    out = Compiled(root)
    out.errors += validation.problems(g)
    if out.errors:
        return out
    root, config = qualified(spark, root), config or f"{root}/config/model_config.yaml"
    data, now = f"{root}/data", datetime.now(UTC)
    folders = {"components": f"{data}/components", "variants": f"{data}/variants"}
    if backup:
        stamp = now.strftime("%Y%m%d_%H%M%S")
        for kind, folder in folders.items():
            if exists(spark, folder):
                definitions.copy_folder(spark, folder, f"{data}/backup_{stamp}/{kind}")
                out.backup = f"{data}/backup_{stamp}"

    def step(name: str, run: Callable[[], object]):
        try:
            return run()
        except Exception as e:  # noqa: BLE001  the report names the step; sinks fail in many ways
            out.errors.append(f"{name}: {str(e).splitlines()[0]}")

    def wrote(kind: str, df: DataFrame) -> int:
        definitions.write_definitions(df, folders[kind])
        return df.count()

    out.components = step("components", lambda: wrote("components", g.components)) or 0
    if out.errors:
        return out
    out.variants = step("variants", lambda: wrote("variants", g.variants)) or 0
    if embed is not None and vectors is not None:

        def fill() -> int:
            rows, n = embed_and_store(g, embed)
            rows.write.mode("overwrite").parquet(vectors)
            return n

        out.documents = step("vectors", fill) or 0
    summary = graph.graph_summary(g.components, g.edges, g.variants).first().asDict()
    quality = _quality(found) if found is not None else None

    def configure() -> bool:
        told = yaml.safe_load(read_text(spark, config) or "") or {}
        done = definitions.recompiled_config(told, summary, now.isoformat())
        if quality:
            done["recompilation"]["gap_analysis"] = {k: quality[k] for k in ("completeness_score", "total_gaps", "resolved_gaps")}
        write_text(spark, config, yaml.safe_dump(done, sort_keys=False))
        return True

    out.config_updated = bool(step("configuration", configure))

    def declare() -> str:
        body = {
            "version": VERSION, "compiled_at": now.isoformat(), "graph": summary,
            "compilation": {"components_written": out.components, "variants_written": out.variants, "documents_embedded": out.documents, "config_updated": out.config_updated},
            "deployment": {"api_endpoint": "/api/v1/analyze", "health_check": "/health", "data_directory": data, "config_path": config},
        }
        if quality:
            body["quality"] = {k: quality[k] for k in ("completeness_score", "total_gaps", "unresolved_gaps", "critical_gaps")}
        return write_text(spark, f"{root}/deployment_manifest.json", json.dumps(body, indent=2))

    out.manifest = step("manifest", declare) or ""
    return out
