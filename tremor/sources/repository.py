"""Scan of a source tree: files by kind, manifests, service boundaries and what they contain."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
import pyarrow.fs as pafs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tremor.sources.shared import qualified, written

#: Fixed values.
PYTHON_EXTS = (".py",)
CONFIG_EXTS = (".yaml", ".yml", ".toml", ".json", ".ini", ".cfg", ".env")
DOC_EXTS = (".md", ".rst", ".txt")
MARKERS = ("Dockerfile", "docker-compose.yml", "docker-compose.yaml", "package.json", "go.mod", "Cargo.toml", "pom.xml", "build.gradle", "setup.py", "pyproject.toml")
IGNORED = (".git", "__pycache__", "node_modules", ".venv", "venv", ".tox", ".mypy_cache", ".pytest_cache", "dist", "build", ".eggs", "*.egg-info", "chroma_db")
MAX_BYTES = 5_000_000


def scan(spark: SparkSession, root: str, content: bool = True, names: tuple[str, ...] = IGNORED) -> DataFrame:
    """path (below the root), length, content: every file outside ignored folders. Spark's readers pass over names that begin with a dot
    or an underscore, which are part of a source tree; so executors list the tree, a level of folders at a time, and then read it.

    Ignored folders are neither entered nor read. The driver holds the folders of one level, never files.
    """
    base = qualified(spark, root).rstrip("/")
    exact, ends = {n for n in names if not n.startswith("*")}, tuple(n[1:] for n in names if n.startswith("*"))

    def listed(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        fs, at = pafs.FileSystem.from_uri(base)
        for f in frames:
            rows = []
            for folder in f["path"]:
                for info in fs.get_file_info(pafs.FileSelector(f"{at}/{folder}".rstrip("/"))):
                    is_dir, name = info.type == pafs.FileType.Directory, info.base_name
                    if is_dir and (name in exact or bool(ends) and name.endswith(ends)):
                        continue
                    rows.append((f"{folder}/{name}" if folder else name, None if is_dir else info.size))
            yield pd.DataFrame({"path": [r[0] for r in rows], "length": pd.array([r[1] for r in rows], "Int64")})

    todo, levels = [("",)], []
    while todo:
        folders = spark.createDataFrame(todo, "path string")
        found = written(folders.repartition(max(1, min(200, len(todo))), "path").mapInPandas(listed, "path string, length long"), "scan-level")
        levels.append(found.filter("length is not null"))
        todo = [(r.path,) for r in found.filter("length is null").select("path").collect()]
    files = levels[0]
    for level in levels[1:]:
        files = files.unionByName(level)
    if not content:
        return files

    def read(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        fs, at = pafs.FileSystem.from_uri(base)
        for f in frames:
            data = []
            for path, n in zip(f["path"], f["length"], strict=True):
                if n > MAX_BYTES:
                    data.append(None)
                    continue
                with fs.open_input_stream(f"{at}/{path}") as src:
                    data.append(src.read())
            yield f.assign(content=data)

    return files.repartition(F.xxhash64("path")).mapInPandas(read, "path string, length long, content binary")


def ignored(path: Column, names: tuple[str, ...] = IGNORED) -> Column:
    """A folder on the way has an ignored name, or ends as a pattern with a star says."""
    exact, ends = [n for n in names if not n.startswith("*")], [n[1:] for n in names if n.startswith("*")]
    dirs = F.slice(F.split(path, "/"), 1, F.size(F.split(path, "/")) - 1)

    def hit(d: Column) -> Column:
        out = d.isin(*exact)
        for e in ends:
            out = out | d.endswith(e)
        return out

    return F.exists(dirs, hit)


def name_of(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def dir_of(path: Column) -> Column:
    return F.when(path.contains("/"), F.regexp_replace(path, r"/[^/]*$", "")).otherwise(F.lit(""))


def suffix_of(path: Column) -> Column:
    return F.lower(F.regexp_extract(name_of(path), r"^.+(\.[^.]+)$", 1))


def classified(files: DataFrame, max_bytes: int = MAX_BYTES, names: tuple[str, ...] = IGNORED) -> DataFrame:
    """Adds category (python, config, doc or null) and manifest (package_json, csproj, sln or null) to what stays."""
    p, s = F.col("path"), suffix_of(F.col("path"))
    category = F.when(s.isin(*PYTHON_EXTS), "python").when(s.isin(*CONFIG_EXTS) | name_of(p).startswith("."), "config").when(s.isin(*DOC_EXTS), "doc")
    kind = F.when(name_of(p) == "package.json", "package_json").when(s == ".csproj", "csproj").when(s == ".sln", "sln")
    kept = files.filter(~ignored(p, names)).filter(F.col("length") <= max_bytes)
    return kept.withColumn("category", category).withColumn("manifest", kind)


def boundaries(files: DataFrame) -> DataFrame:
    """root_dir, name, marker of folders that hold a marker; of several the greatest name; solution files count where none does."""
    f = files.filter(~ignored(F.col("path"))).select(dir_of(F.col("path")).alias("root_dir"), name_of(F.col("path")).alias("file"))
    marked = f.withColumn("m", F.when(F.col("file").isin(*MARKERS), F.struct(F.lit(1).alias("r"), "file")).when(F.lower("file").endswith(".sln"), F.struct(F.lit(0).alias("r"), "file")))
    b = marked.filter("m is not null").groupBy("root_dir").agg(F.max("m").alias("m"))
    return b.select("root_dir", F.when(F.col("root_dir") == "", ".").otherwise(name_of(F.col("root_dir"))).alias("name"), F.col("m.file").alias("marker"))


def contained(files: DataFrame, bounds: DataFrame) -> DataFrame:
    """root_dir, path, category: a file is in every boundary above it. Each file names its folders, so the join has a key."""
    parts = F.split(dir_of(F.col("path")), "/")
    above = F.array_distinct(F.concat(F.array(F.lit("")), F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, 1, i), "/"))))
    return files.select("path", "category", F.explode(above).alias("root_dir")).join(bounds.select("root_dir"), "root_dir").select("root_dir", "path", "category")


def scan_summary(files: DataFrame) -> DataFrame:
    """One row; the total counts what was too large, but not what was ignored."""
    seen = files.filter(~ignored(F.col("path"))).agg(F.count("*").alias("total_files_scanned"))
    c = classified(files)
    counts = [F.count(F.when(F.col("category") == k, 1)).alias(f"{k}_files") for k in ("python", "config", "doc")] + [F.count("manifest").alias("manifests")]
    return seen.crossJoin(c.agg(*counts)).crossJoin(boundaries(files).agg(F.count("*").alias("boundaries")))


def ordered(files: DataFrame) -> DataFrame:
    """A place for first-match rules: the path itself compares, so nothing has to be numbered in one task."""
    return files.withColumn("ord", F.col("path"))
