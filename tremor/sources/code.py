"""Readers of source and manifest files: what has no relational form is parsed on the executors, the rest is expressions."""

from __future__ import annotations

import ast
import posixpath
import re
from collections.abc import Iterator
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tremor.functions.text import csproj_id, is_internal_npm_dep, npm_id
from tremor.sources.repository import dir_of, name_of

PYTHON = (
    "path string, ok boolean, docstring string, imports array<string>, "
    "classes array<struct<name:string,docstring:string,methods:array<string>,decorators:array<string>,line:int>>, "
    "functions array<struct<name:string,docstring:string,decorators:array<string>,args:array<string>,is_async:boolean,line:int>>"
)


def _dotted(node: ast.AST) -> str:
    match node:
        case ast.Name(id=name):
            return name
        case ast.Attribute(value=v, attr=attr):
            return f"{_dotted(v)}.{attr}".lstrip(".")
        case ast.Call(func=f):
            return _dotted(f)
    return ""


def parse_python(source: str) -> dict | None:
    """Imports and the top-level classes and functions of a module; None if it does not parse."""
    try:
        tree = ast.parse(source)
    except (SyntaxError, ValueError):
        return None
    imports = []
    for n in ast.walk(tree):
        if isinstance(n, ast.Import):
            imports += [a.name for a in n.names]
        elif isinstance(n, ast.ImportFrom) and n.module:
            imports.append(n.module)
    functions = (ast.FunctionDef, ast.AsyncFunctionDef)
    classes = [
        {"name": n.name, "docstring": ast.get_docstring(n) or "", "methods": [m.name for m in n.body if isinstance(m, functions)], "decorators": [_dotted(d) for d in n.decorator_list], "line": n.lineno}
        for n in tree.body if isinstance(n, ast.ClassDef)
    ]
    funcs = [
        {"name": n.name, "docstring": ast.get_docstring(n) or "", "decorators": [_dotted(d) for d in n.decorator_list], "args": [a.arg for a in n.args.args], "is_async": isinstance(n, ast.AsyncFunctionDef), "line": n.lineno}
        for n in tree.body if isinstance(n, functions)
    ]
    return {"docstring": ast.get_docstring(tree) or "", "imports": imports, "classes": classes, "functions": funcs}


def python_files(files: DataFrame) -> DataFrame:
    """One row a Python file (path, content); ``ok`` is false where it does not parse."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        none = {"docstring": "", "imports": [], "classes": [], "functions": []}
        for f in frames:
            got = [(p, parse_python(bytes(c).decode("utf-8", "replace"))) for p, c in zip(f["path"], f["content"], strict=True)]
            yield pd.DataFrame([{"path": p, "ok": g is not None, **(g or none)} for p, g in got], columns=["path", "ok", "docstring", "imports", "classes", "functions"])

    return files.filter("category = 'python'").select("path", "content").mapInPandas(run, PYTHON)


MANIFEST = (
    "path string, id string, name string, description string, team_owner string, language string, confidence double, api_surface array<string>, "
    "modules array<struct<module_id:string,coupling:string,usage:string>>, workspaces array<string>"
)


def package_json(files: DataFrame) -> DataFrame:
    """Components of package.json files: dependencies tight, development ones loose, in file order; bad JSON gives none."""
    shape = (
        "name string, description string, keywords array<string>, types string, typings string, dependencies map<string,string>, devDependencies map<string,string>"
    )
    raw = F.decode("content", "UTF-8")
    f = files.filter("manifest = 'package_json'").select("path", raw.alias("raw")).withColumn("j", F.from_json("raw", shape)).filter(F.get_json_object("raw", "$").startswith("{"))
    g = lambda p: F.get_json_object("raw", p)
    who = F.coalesce(F.nullif(g("$.author.name"), F.lit("")), F.nullif(F.btrim(F.element_at(F.split(F.when(~g("$.author").startswith("{"), g("$.author")), "<"), 1)), F.lit("")), g("$.contributors[0].name"), F.when(~g("$.contributors[0]").startswith("{"), F.btrim(F.element_at(F.split(g("$.contributors[0]"), "<"), 1))), F.lit(""))
    ts = files.filter(name_of(F.col("path")) == "tsconfig.json").select(dir_of(F.col("path")).alias("dir")).distinct().withColumn("ts", F.lit(True))
    folder = dir_of(F.col("path"))
    name = F.coalesce(F.nullif(F.col("j.name"), F.lit("")), F.when(folder == "", F.lit("package")).otherwise(name_of(folder)))

    def deps(col: str, coupling: str):
        usage = lambda v: F.when(is_internal_npm_dep(v), F.concat(F.lit("internal "), v)).otherwise(v)
        return F.transform(F.coalesce(F.map_entries(f"j.{col}"), F.expr("cast(array() as array<struct<key:string,value:string>>)")), lambda e: F.struct(npm_id(e["key"]).alias("module_id"), F.lit(coupling).alias("coupling"), usage(F.coalesce(e["value"], F.lit(""))).alias("usage")))

    told = F.nullif(F.btrim(F.col("j.description")), F.lit(""))
    ws = F.coalesce(F.from_json(g("$.workspaces.packages"), "array<string>"), F.from_json(g("$.workspaces"), "array<string>"), F.expr("cast(array() as array<string>)"))
    rows = f.withColumn("dir", folder).join(ts, "dir", "left")
    return rows.select(
        "path", npm_id(name).alias("id"), name.alias("name"),
        F.substring(F.element_at(F.split(F.coalesce(told, F.concat(name, F.lit(" npm package"))), "\n"), 1), 1, 500).alias("description"), who.alias("team_owner"),
        F.when(F.col("ts") | (F.coalesce("j.types", "j.typings", F.lit("")) != ""), "typescript").otherwise("javascript").alias("language"),
        F.when(told.isNull(), 0.5).otherwise(1.0).alias("confidence"), F.array_sort(F.array_distinct(F.coalesce("j.keywords", F.expr("cast(array() as array<string>)")))).alias("api_surface"),
        F.concat(deps("dependencies", "tight"), deps("devDependencies", "loose")).alias("modules"), ws.alias("workspaces"),
    )


def parse_csproj(path: str, source: bytes) -> dict | None:
    """Facts of a project file, whatever its XML namespace; None for bad XML."""
    try:
        root = ElementTree.fromstring(source)
    except ElementTree.ParseError:
        return None
    tag = lambda e: e.tag.rpartition("}")[2] if isinstance(e.tag, str) else ""
    text = lambda *names: next((e.text.strip() for n in names for e in root.iter() if tag(e) == n and e.text and e.text.strip()), "")
    stem = lambda p: posixpath.splitext(posixpath.basename(p.replace("\\", "/")))[0]
    slug = lambda s: re.sub(r"[^A-Za-z0-9]+", "_", s).strip("_").lower() or "project"
    name = text("AssemblyName", "PackageId") or stem(path)
    modules = []
    for e in root.iter():
        ref = e.attrib.get("Include", "")
        if ref and tag(e) == "ProjectReference":
            at = posixpath.normpath(posixpath.join(posixpath.dirname(path), ref.replace("\\", "/")))
            modules.append({"module_id": slug(stem(ref)), "coupling": "tight", "usage": f"internal project {at}"})
        elif ref and tag(e) == "PackageReference":
            modules.append({"module_id": slug(ref), "coupling": "tight", "usage": f"package {e.attrib.get('Version', '') or next((c.text or '' for c in e if tag(c) == 'Version'), '')}".strip()})
    tags = sorted({t for t in re.split(r"[;,\s]+", text("PackageTags")) if t})
    return {"path": path, "id": slug(name), "name": name, "description": (text("Description") or f"{name} .NET project").split("\n")[0][:500], "team_owner": text("Authors").split(",")[0].strip(), "language": "csharp", "confidence": 1.0 if text("Description") else 0.5, "api_surface": tags, "modules": modules, "workspaces": []}


def csproj(files: DataFrame) -> DataFrame:
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        columns = [c.split()[0] for c in re.sub(r"<[^ ]*>", "", MANIFEST).split(", ")]
        for f in frames:
            got = [parse_csproj(p, bytes(c)) for p, c in zip(f["path"], f["content"], strict=True)]
            yield pd.DataFrame([g for g in got if g], columns=columns)

    return files.filter("manifest = 'csproj'").select("path", "content").mapInPandas(run, MANIFEST)


#: Fixed value: a project entry of a solution file.
SLN = r'(?m)^\s*Project\("\{[0-9A-Fa-f-]+\}"\)\s*=\s*"([^"]+)"\s*,\s*"([^"]+)"\s*,\s*"\{[0-9A-Fa-f-]+\}"'


def sln_projects(files: DataFrame) -> DataFrame:
    """path, name, project of the project entries in solution files; folders are no projects."""
    raw = F.decode("content", "UTF-8")
    pairs = F.arrays_zip(F.regexp_extract_all(raw, F.lit(SLN), F.lit(1)).alias("name"), F.regexp_extract_all(raw, F.lit(SLN), F.lit(2)).alias("project"))
    out = files.filter("manifest = 'sln'").select("path", F.explode(pairs).alias("p")).select("path", "p.name", F.replace("p.project", F.lit("\\"), F.lit("/")).alias("project"))
    return out.filter(F.lower("project").endswith(".csproj")).withColumn("id", csproj_id(F.col("name")))


def sln_warnings(files: DataFrame, projects: DataFrame) -> DataFrame:
    """One row for each solution entry whose project file is not among those that were read."""
    entries = sln_projects(files).withColumn("at", F.concat_ws("/", F.nullif(dir_of(F.col("path")), F.lit("")), "project"))
    lost = entries.join(projects.select(F.col("path").alias("at")), "at", "left_anti")
    return lost.select(F.format_string("solution %s: project '%s' was not found", "path", "project").alias("warning"))


def manifests(files: DataFrame, languages: tuple[str, ...] = ("typescript", "javascript", "csharp")) -> DataFrame:
    """Components of all manifests in an allowed language."""
    return package_json(files).unionByName(csproj(files)).filter(F.col("language").isin(*languages))
