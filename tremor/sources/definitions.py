"""Component and variant definitions from YAML files, and their sinks."""

from __future__ import annotations

import json
from collections.abc import Iterator
from datetime import UTC, datetime

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tremor.operators.graph import COMPONENT_SCHEMA, VARIANT_SCHEMA
from tremor.sources.shared import qualified


def _component(d: dict) -> dict:
    mods = [{"module_id": m.get("module_id"), "coupling": m.get("coupling"), "usage": m.get("usage")} for m in d.get("modules") or []]
    text = {k: d.get(k) for k in ("description", "team_owner", "criticality")}
    return {"id": d.get("id"), "name": d.get("name"), **text, "modules": mods, "api_surface": [str(x) for x in d.get("api_surface") or []]}


def _variant(d: dict) -> dict:
    comps = [{"component_id": c.get("component_id"), "features": [str(x) for x in c.get("features") or []], "config_overrides": json.dumps(c.get("config_overrides") or {}, default=str, sort_keys=True)} for c in d.get("components") or []]
    text = {k: d.get(k) for k in ("tier", "region", "description", "max_seats")}
    return {"id": d.get("id"), "name": d.get("name"), **text, "components": comps, "metadata": json.dumps(d.get("metadata") or {}, default=str, sort_keys=True)}


def read_definitions(spark: SparkSession, folder: str, kind: str, tolerant: bool = False) -> DataFrame:
    """``kind``: components or variants. Files in order of name; ``tolerant`` skips what does not parse or has no id."""
    import yaml  # a missing parser fails here, before any job

    schema, shape = (COMPONENT_SCHEMA, _component) if kind == "components" else (VARIANT_SCHEMA, _variant)
    fields = T._parse_datatype_string(schema)
    files = spark.read.option("pathGlobFilter", "*.yaml").text(folder, wholetext=True).select(F.input_file_name().alias("path"), "value")
    from pyspark.sql.pandas.types import to_arrow_schema

    arrow = to_arrow_schema(T.StructType([f for f in fields if f.name != "load_ord"] + [T.StructField("path", T.StringType())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for path, value in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                try:
                    d = yaml.safe_load(value)
                    if not (isinstance(d, dict) and d.get("id") and d.get("name")):
                        raise ValueError(f"{path}: id and name are needed")
                except (yaml.YAMLError, ValueError):
                    if tolerant:
                        continue
                    raise
                out.append(shape(d) | {"path": path})
            yield pa.RecordBatch.from_pylist(out, schema=arrow)

    got = files.mapInArrow(run, T.StructType([f for f in fields if f.name != "load_ord"] + [T.StructField("path", T.StringType())]))
    # definitions are files that people write: few enough for one order over their names
    return got.withColumn("load_ord", F.row_number().over(Window.orderBy("path")).cast("int")).drop("path")


def write_definitions(df: DataFrame, folder: str) -> None:
    """One YAML file a row, named by id, keys in a fixed order, written by the executors."""
    keys = [c for c in df.columns if c != "load_ord"]
    uri = qualified(df.sparkSession, folder)

    def write(rows) -> None:
        import pyarrow.fs as pafs
        import yaml

        fs, root = pafs.FileSystem.from_uri(uri)
        fs.create_dir(root, recursive=True)
        for r in rows:
            d = r.asDict(recursive=True)
            for c in d.get("components") or []:
                c["config_overrides"] = json.loads(c["config_overrides"] or "{}")
            if isinstance(d.get("metadata"), str):
                d["metadata"] = json.loads(d["metadata"])
            with fs.open_output_stream(f"{root}/{d['id']}.yaml") as out:
                out.write(yaml.safe_dump({k: d[k] for k in keys}, sort_keys=False, allow_unicode=True).encode())

    df.foreachPartition(write)


def copy_folder(spark: SparkSession, folder: str, to: str) -> str:
    """Copies a folder by the file system of Spark; returns the new one."""
    hadoop, conf = spark._jvm.org.apache.hadoop.fs, spark._jsc.hadoopConfiguration()
    src, dst = hadoop.Path(folder), hadoop.Path(to)
    fs = dst.getFileSystem(conf)
    fs.mkdirs(dst.getParent())
    hadoop.FileUtil.copy(src.getFileSystem(conf), src, fs, dst, False, conf)
    return dst.toString()


def backup(spark: SparkSession, folder: str, to: str) -> str:
    """A copy of a folder of definitions beside others, named by the time; returns the new folder."""
    return copy_folder(spark, folder, f"{to}/backup_{datetime.now(UTC).strftime('%Y%m%dT%H%M%S%fZ')}")


def snapshot(components: DataFrame, variants: DataFrame, summary: DataFrame, folder: str) -> None:
    """Components, variants (without seats) and summary as JSON tables."""
    for name, df in (("components", components), ("variants", variants.drop("max_seats")), ("summary", summary)):
        df.write.mode("overwrite").json(f"{folder}/{name}")


def recompiled_config(config: dict, summary: dict, now: str) -> dict:
    """Stamps the counts; larger graphs are searched less deep."""
    out = {k: dict(v) if isinstance(v, dict) else v for k, v in config.items()}
    out["recompilation"] = {"timestamp": now, **{k: summary[k] for k in ("component_count", "module_count", "edge_count", "variant_count", "shared_module_count")}}
    n = summary["component_count"]
    if n > 20:
        out.setdefault("graph", {})["max_traversal_depth"] = 3 if n > 50 else 4
    return out
