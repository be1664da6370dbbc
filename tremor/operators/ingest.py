"""From parsed files to components: detection, import graph, shared modules, interfaces, granularity, and the merge with YAML.

First-match rules of a walk over files become "least place": files are placed by path, and a minimum over places is a partial
aggregate. Prefix matches are equi-joins on exploded prefixes, never a comparison of all with all. Whatever has a row for each
file, import or module is joined by merging: by its size on disk the planner would broadcast it, and the driver holds many times that.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tremor.functions.text import slug, snake_case, title_case
from tremor.sources.repository import dir_of, name_of

CONFIDENCE = {"boundary": 0.9, "class": 0.7, "directory": 0.6, "class_only": 0.8}
GRANULARITIES = ("manifest", "app", "service")
VERBS = ("get", "post", "put", "delete", "patch")
_EMPTY = "cast(array() as array<string>)"
COLUMNS = ["id", "name", "description", "source_file", "language", "confidence", "classes", "api_surface", "phase", "ord"]


def _first_by_id(df: DataFrame) -> DataFrame:
    rest = [c for c in df.columns if c != "id"]
    return df.groupBy("id").agg(F.min_by(F.struct(*rest), F.struct("phase", "ord")).alias("r")).select("id", "r.*")


def _doc_line(c: Column) -> Column:
    return F.btrim(F.element_at(F.split(F.btrim(c), "\n"), 1))


def class_components(parsed: DataFrame, min_methods: int, private: bool, confidence: float, fallback: str) -> DataFrame:
    c = parsed.filter("ok").select("path", "ord", F.posexplode("classes").alias("pos", "c"))
    c = c.filter(F.size(F.filter("c.methods", lambda m: ~m.startswith("__"))) >= min_methods) if min_methods else c
    c = c if private else c.filter(~F.col("c.name").startswith("_"))
    described = F.when(F.col("c.docstring") != "", _doc_line(F.col("c.docstring"))).otherwise(F.concat(F.lit(fallback), "c.name"))
    ident = snake_case(F.col("c.name"))
    return c.select(
        ident.alias("id"), title_case(ident).alias("name"), described.alias("description"), F.col("path").alias("source_file"), F.lit("python").alias("language"),
        F.lit(confidence).alias("confidence"), F.array("c.name").alias("classes"), F.expr(_EMPTY).alias("api_surface"), F.lit(1).alias("phase"), F.struct("ord", "pos").alias("ord"),
    )


def boundary_components(bounds: DataFrame, parsed: DataFrame) -> DataFrame:
    lead = parsed.filter("docstring <> ''").select("docstring", "ord", F.explode(_above(F.col("path"))).alias("root_dir"))
    lead = lead.groupBy("root_dir").agg(F.min_by("docstring", "ord").alias("doc"))
    # the place of a boundary is its folder
    b = bounds.join(lead.hint("merge"), "root_dir", "left")
    ident = snake_case(slug(F.col("name")))
    return b.select(
        ident.alias("id"), title_case(ident).alias("name"), F.coalesce(_doc_line(F.col("doc")), F.concat(F.lit("Service: "), "name")).alias("description"),
        F.when(F.col("root_dir") == "", ".").otherwise(F.col("root_dir")).alias("source_file"), F.lit("python").alias("language"), F.lit(CONFIDENCE["boundary"]).alias("confidence"),
        F.expr(_EMPTY).alias("classes"), F.expr(_EMPTY).alias("api_surface"), F.lit(0).alias("phase"), F.struct(F.col("root_dir").alias("ord"), F.lit(0).alias("pos")).alias("ord"),
    )


def directory_components(parsed: DataFrame) -> DataFrame:
    top = parsed.filter(F.col("path").contains("/")).withColumn("d", F.element_at(F.split("path", "/"), 1))
    init = F.when(F.col("path") == F.concat("d", F.lit("/__init__.py")), F.col("docstring"))
    g = top.groupBy("d").agg(F.max(init).alias("doc"), F.min("ord").alias("o"))
    ident = snake_case(F.col("d"))
    return g.select(
        ident.alias("id"), title_case(ident).alias("name"), F.coalesce(F.nullif(_doc_line(F.col("doc")), F.lit("")), F.concat(F.lit("Directory module: "), "d")).alias("description"),
        F.col("d").alias("source_file"), F.lit("python").alias("language"), F.lit(CONFIDENCE["directory"]).alias("confidence"), F.expr(_EMPTY).alias("classes"), F.expr(_EMPTY).alias("api_surface"),
        F.lit(0).alias("phase"), F.struct(F.col("o").alias("ord"), F.lit(0).alias("pos")).alias("ord"),
    )


def detect(parsed: DataFrame, bounds: DataFrame, mode: str = "auto", min_methods: int = 2) -> DataFrame:
    """Components by ``mode`` (auto, directory, class); the first with an id wins. ``parsed`` has ord, the place by path."""
    if mode == "directory":
        return _first_by_id(directory_components(parsed))
    if mode == "class":
        return _first_by_id(class_components(parsed, min_methods, True, CONFIDENCE["class_only"], ""))
    if mode != "auto":
        raise ValueError(f"component detection {mode!r}")
    classes = class_components(parsed, min_methods, False, CONFIDENCE["class"], "Class ")
    return _first_by_id(boundary_components(bounds, parsed).unionByName(classes))


def module_name(path: Column) -> Column:
    return F.replace(F.regexp_replace(F.regexp_replace(path, r"\.py$", ""), r"/__init__$", ""), F.lit("/"), F.lit("."))


def _prefixes(dotted: Column, sep: str) -> Column:
    parts = F.split(dotted, "\\" + sep if sep == "." else sep)
    return F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, 1, i), sep))


def _above(path: Column) -> Column:
    return F.array_distinct(F.concat(F.array(F.lit("")), _prefixes(dir_of(path), "/")))


def import_graph(parsed: DataFrame) -> DataFrame:
    """path, dep: each import resolves to the first file (by place) whose module it is or lies below; a file is no dep of its own."""
    modules = parsed.select(module_name(F.col("path")).alias("prefix"), F.struct("ord", "path").alias("target"))
    modules = modules.groupBy("prefix").agg(F.min("target").alias("target"))
    uses = parsed.select("path", F.explode(F.array_distinct("imports")).alias("imp"))
    # What an import resolves to does not depend on the file, so each import is looked up once.
    named = uses.select("imp").distinct().withColumn("prefix", F.explode(_prefixes(F.col("imp"), ".")))
    hit = named.join(modules.hint("merge"), "prefix").groupBy("imp").agg(F.min("target").alias("t"))
    return uses.join(hit.hint("merge"), "imp").filter(F.col("t.path") != F.col("path")).select("path", F.col("t.path").alias("dep")).distinct()


def owners(components: DataFrame, paths: DataFrame) -> DataFrame:
    """path, id: the first component whose source is the path or a folder above it (by phase and place)."""
    own = components.select(F.col("source_file").alias("prefix"), F.struct("phase", "ord", "id").alias("o")).groupBy("prefix").agg(F.min("o").alias("o"))
    above = paths.select("path", F.explode(F.concat(F.array("path"), F.filter(_above(F.col("path")), lambda d: d != ""))).alias("prefix"))
    return above.join(own.hint("merge"), "prefix").groupBy("path").agg(F.min("o").alias("o")).select("path", F.col("o.id").alias("id"))


def shared_modules(components: DataFrame, imports: DataFrame, parsed: DataFrame) -> DataFrame:
    """module_id, source_file, description, used_by (sorted) of files that two components at least import."""
    own = owners(components, imports.select("path").distinct())
    used = imports.join(own.hint("merge"), "path").groupBy("dep").agg(F.sort_array(F.collect_set("id")).alias("used_by")).filter("size(used_by) >= 2")
    docs = parsed.select(F.col("path").alias("dep"), "docstring")
    stem = F.regexp_replace(name_of(F.col("dep")), r"\.py$", "")
    ident = F.when(stem == "__init__", name_of(dir_of(F.col("dep")))).otherwise(stem)
    return used.join(docs.hint("merge"), "dep", "left").select(
        snake_case(ident).alias("module_id"), F.col("dep").alias("source_file"),
        F.coalesce(F.nullif(_doc_line(F.col("docstring")), F.lit("")), F.concat(F.lit("Shared module: "), "dep")).alias("description"), "used_by",
    )


def uses(modules: DataFrame) -> DataFrame:
    """id, module_id, coupling (tight), usage (its description): a row for each component that uses a shared module."""
    return modules.select(F.explode("used_by").alias("id"), "module_id", F.lit("tight").alias("coupling"), F.col("description").alias("usage")).distinct()


def wire(components: DataFrame, modules: DataFrame) -> DataFrame:
    """Adds modules (module_id, tight, its description) to the components that use them; a component's modules are one value, ``uses`` has them as rows."""
    m = uses(modules).groupBy("id").agg(F.sort_array(F.collect_list(F.struct("module_id", "coupling", "usage"))).alias("modules"))
    return components.join(m.hint("merge"), "id", "left").withColumn("modules", F.coalesce("modules", F.expr("cast(array() as array<struct<module_id:string,coupling:string,usage:string>>)")))


def wired_counts(components: DataFrame, modules: DataFrame) -> DataFrame:
    """id, n_modules: how many ``wire`` gives each component, counted by rows, as a component of a whole tree can use very many."""
    n = uses(modules).groupBy("id").agg(F.count("*").alias("n_modules"))
    return components.select("id").join(n.hint("merge"), "id", "left").withColumn("n_modules", F.coalesce("n_modules", F.lit(0).cast("long")))


def api_surface(parsed: DataFrame) -> DataFrame:
    """path, api_surface: routes of decorated functions, and methods of controllers and resources."""
    verb = lambda d: F.upper(F.regexp_extract(d, r"\.(get|post|put|delete|patch)\b", 1))
    routes = F.flatten(F.transform("functions", lambda f: F.transform(F.filter(f["decorators"], lambda d: verb(d) != ""), lambda d: F.concat(verb(d), F.lit(" /"), f["name"]))))
    control = F.filter("classes", lambda c: F.lower(c["name"]).rlike("controller|resource"))
    methods = F.flatten(F.transform(control, lambda c: F.transform(F.filter(c["methods"], lambda m: ~m.startswith("_")), lambda m: F.concat(F.lit("METHOD /"), m))))
    return parsed.select("path", F.array_distinct(F.concat(routes, methods)).alias("api_surface")).filter("size(api_surface) > 0")


def with_api_surface(components: DataFrame, parsed: DataFrame) -> DataFrame:
    found = api_surface(parsed)
    own = owners(components, found.select("path")).join(found.hint("merge"), "path").groupBy("id").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("api_surface")))).alias("api"))
    return components.join(own.hint("merge"), "id", "left").withColumn("api_surface", F.coalesce("api", "api_surface")).drop("api")


def merge_manifests(components: DataFrame, manifests: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(all components with modules, warnings): a manifest whose id is taken is skipped and named."""
    taken = components.select("id")
    fresh = manifests.join(taken, "id", "left_anti")
    fresh = fresh.groupBy("id").agg(F.min_by(F.struct(*(c for c in fresh.columns if c != "id")), "path").alias("r")).select("id", "r.*")
    warnings = manifests.join(taken, "id", "left_semi").select(F.format_string("manifest %s: component id '%s' is taken", "path", "id").alias("warning"))
    rows = fresh.select("id", "name", "description", F.col("path").alias("source_file"), "language", "confidence", "api_surface", "modules", "team_owner")
    return components.select(*rows.columns).unionByName(rows), warnings


def module_users(components: DataFrame) -> DataFrame:
    """module_id, used_by over all components."""
    m = components.select("id", F.explode("modules").alias("m"))
    return m.groupBy(F.col("m.module_id").alias("module_id")).agg(F.sort_array(F.collect_set("id")).alias("used_by"))


def glob_to_regex(glob: Column) -> Column:
    """A glob as fnmatch reads it (stars cross folders), and the same with one more level."""
    quoted = F.regexp_replace(glob, r"([.+^$(){}|\\])", r"\\$1")
    return F.concat(F.lit("^"), F.replace(F.replace(quoted, F.lit("*"), F.lit(".*")), F.lit("?"), F.lit(".")), F.lit("(/[^/]*)?$"))


def _absorb(members: DataFrame, leads: DataFrame) -> DataFrame:
    """``leads``: id, lead. Absorbed components go; their modules join the lead's, each id once, the lead's first."""
    absorbed = leads.filter("id <> lead")
    extra = members.join(absorbed, "id").select(F.col("lead").alias("id"), F.explode("modules").alias("m"))
    extra = extra.groupBy("id", F.col("m.module_id").alias("mid")).agg(F.min(F.col("m")).alias("m")).groupBy("id").agg(F.sort_array(F.collect_list("m")).alias("extra"))
    kept = members.join(absorbed.select("id"), "id", "left_anti").join(extra, "id", "left")
    have = F.transform("modules", lambda m: m["module_id"])
    more = F.filter(F.coalesce("extra", F.expr("cast(array() as array<struct<module_id:string,coupling:string,usage:string>>)")), lambda m: ~F.array_contains(have, m["module_id"]))
    return kept.withColumn("modules", F.concat("modules", more)).drop("extra")


def granularity(members: DataFrame, mode: str, bounds: DataFrame | None = None) -> DataFrame:
    """``members``: id, path, modules, workspaces, … of manifests. app: workspace roots absorb; service: boundaries do."""
    if mode not in GRANULARITIES:
        raise ValueError(f"artifact granularity {mode!r}: one of {GRANULARITIES}")
    if mode == "manifest":
        return members
    m = members.withColumn("dir", dir_of(F.col("path")))
    if mode == "app":
        roots = m.filter("size(workspaces) > 0").select(F.col("id").alias("lead"), F.col("dir").alias("root"), F.explode("workspaces").alias("glob"))
        below = m.select("id", "dir", F.explode(_above(F.col("path"))).alias("root"))
        inside = below.join(roots, "root").filter("id <> lead")
        rel = F.when(F.col("root") == "", F.col("dir")).otherwise(F.expr("substring(dir, length(root) + 2)"))
        hits = inside.filter(F.regexp_like(rel, glob_to_regex(F.col("glob"))))
        return _absorb(members, hits.groupBy("id").agg(F.min_by("lead", F.struct(F.length("root"), "lead")).alias("lead")))
    # The outermost boundary of several members takes them all, so what it holds is not dealt with twice.
    inside = m.select("id", "dir", "path", F.explode(_above(F.col("path"))).alias("root_dir")).join(bounds.select("root_dir"), "root_dir")
    full = inside.groupBy("root_dir").agg(F.count("*").alias("n"), F.min_by("id", F.struct(F.size(F.split("path", "/")), "path")).alias("lead")).filter("n >= 2")
    outer = inside.join(full, "root_dir").groupBy("id").agg(F.min_by("lead", F.struct(F.length("root_dir"), "root_dir")).alias("lead"))
    return _absorb(members, outer)


def combine(defined: DataFrame, detected: DataFrame) -> DataFrame:
    """YAML definitions first; of what was detected, the ids that are new."""
    fresh = detected.join(defined.select("id"), "id", "left_anti")
    last = defined.agg(F.coalesce(F.max("load_ord"), F.lit(0)).alias("last"))
    fresh = fresh.crossJoin(last).withColumn("load_ord", (F.col("last") + F.row_number().over(Window.orderBy("id"))).cast("int")).drop("last")
    return defined.unionByName(fresh.select("id", "name", "description", F.coalesce("team_owner", F.lit("")).alias("team_owner"), F.lit("medium").alias("criticality"), "modules", "api_surface", "load_ord"))


def warnings(components: DataFrame, users: DataFrame) -> DataFrame:
    """One row a warning: modules with one user (five by name), and components of low confidence."""
    lone = users.filter("size(used_by) < 2")
    names = lone.orderBy("module_id").limit(5).agg(F.array_join(F.array_sort(F.collect_list("module_id")), ", ").alias("names"))
    first = lone.agg(F.count("*").alias("n")).crossJoin(names).filter("n > 0").select(F.format_string("%d modules are used by fewer than two components: %s", "n", "names").alias("warning"))
    low = components.filter("confidence < 0.5").select(F.format_string("low confidence: %s", "id").alias("warning"))
    return first.unionByName(low)


def summary(components: DataFrame) -> DataFrame:
    """Per language: components, mean confidence and module uses."""
    return components.groupBy("language").agg(F.count("*").alias("n_components"), F.avg("confidence").alias("avg_confidence"), F.sum(F.size("modules")).alias("n_modules"))
