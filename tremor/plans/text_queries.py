"""Queries over documents and embeddings for retrieval, redaction, cache and cost operators, with their DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from tremor.functions import text as X
from tremor.operators import cost, documents, gaps, graph, redact, retrieve, score, traverse
from tremor.plans import tables as T
from tremor.plans.tables import read
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


#: The request: a fixed vector of 64 values.
QUERY = [((i * 37) % 19 - 9) / 10 for i in range(64)]
_Q = "[" + ", ".join(f"{x}::DOUBLE" for x in QUERY) + "]"
_STORE = f"s AS (SELECT vec_id, label, 1 - list_cosine_similarity(cast(embedding AS DOUBLE[]), {_Q}) AS d FROM embeddings)"


def _store(spark, sf_dir):
    return read(spark, sf_dir, "embeddings")


def _r(c: str):
    return F.round(c, 9)


@query(f"WITH {_STORE} SELECT vec_id, label, round(d, 9) AS distance, round(1 - d, 9) AS similarity FROM s ORDER BY d, vec_id LIMIT 10")
def knn_topk(spark, sf_dir):
    return retrieve.knn(_store(spark, sf_dir), QUERY, 10).select("vec_id", "label", _r("distance").alias("distance"), _r("similarity").alias("similarity"))


@query(f"WITH {_STORE} SELECT vec_id, round(d, 9) AS distance FROM s WHERE label = 3 ORDER BY d, vec_id LIMIT 10")
def knn_filtered(spark, sf_dir):
    return retrieve.knn(_store(spark, sf_dir), QUERY, 10, where={"label": 3}).select("vec_id", _r("distance").alias("distance"))


@query(f"WITH {_STORE}, k AS (SELECT * FROM s ORDER BY d, vec_id LIMIT 50) SELECT vec_id, label, round(1 - d, 9) AS similarity FROM k WHERE 1 - d >= 0.1 AND label <> 2")
def knn_threshold_after_topk(spark, sf_dir):
    near = retrieve.knn(_store(spark, sf_dir), QUERY, 50)
    return retrieve.after_threshold(near, 0.1, "label", (2,)).select("vec_id", "label", _r("similarity").alias("similarity"))


_ENTITY = f"WITH {_STORE}, k AS (SELECT * FROM s ORDER BY d, vec_id LIMIT 100), g AS (SELECT label, max(1 - d) AS best, count(*) AS match_count, avg(1 - d) AS av FROM k GROUP BY label)"


@query(f"{_ENTITY} SELECT label, round(best, 9) AS best_score, match_count, round(av, 9) AS avg_score FROM g")
def knn_by_entity(spark, sf_dir):
    g = retrieve.by_entity(retrieve.knn(_store(spark, sf_dir), QUERY, 100), "label")
    return g.select("label", _r("best_score").alias("best_score"), "match_count", _r("avg_score").alias("avg_score"))


@query(f"{_ENTITY} SELECT label, round(best, 9) AS best_score FROM g ORDER BY best DESC, label LIMIT 5")
def knn_rerank(spark, sf_dir):
    g = retrieve.by_entity(retrieve.knn(_store(spark, sf_dir), QUERY, 100), "label")
    return retrieve.rerank(g, 5, "label").select("label", _r("best_score").alias("best_score"))


_BATCH = """p AS (SELECT q.vec_id AS query_id, e.vec_id, e.label, 1 - list_cosine_similarity(cast(e.embedding AS DOUBLE[]), cast(q.embedding AS DOUBLE[])) AS d
  FROM embeddings q, embeddings e WHERE q.vec_id % 20 = 0),
k AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(d, 9), vec_id) AS rank FROM p) WHERE rank <= 5)"""


def _batch(spark, sf_dir, k=5):
    store = _store(spark, sf_dir)
    asked = store.filter("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), "embedding")
    # rows whose distances differ by rounding alone are ordered by id
    return retrieve.batch_knn(store, asked, k, digits=9)


@query(f"WITH {_BATCH} SELECT query_id, vec_id, rank FROM k")
def batch_knn(spark, sf_dir):
    return _batch(spark, sf_dir).select("query_id", "vec_id", "rank")


@query(f"WITH {_BATCH}, g AS (SELECT query_id, label, max(1 - d) AS best FROM k WHERE query_id <> vec_id GROUP BY 1, 2) SELECT label, round(max(best), 6) AS best_score FROM g GROUP BY label")
def best_per_component(spark, sf_dir):
    near = _batch(spark, sf_dir).filter("query_id <> vec_id").join(_store(spark, sf_dir).select("vec_id", "label"), "vec_id")
    near = near.withColumn("similarity", 1 - F.col("distance"))
    per = near.groupBy("query_id", "label").agg(F.max("similarity").alias("best_score")).withColumnRenamed("query_id", "query_ord")
    return retrieve.best_per_component(per, "label").select("label", F.round("best_score", 6).alias("best_score"))


_W = f"WITH {T.EDGES_SQL},\n{T.levels_sql()},\n{T.COMPONENTS_SQL}"


@query(f"""{_W}, i AS (SELECT component_id, depth, min_coupling, criticality FROM found JOIN comp ON id = component_id),
sem AS (SELECT id AS component_id, criticality, 0.25 + (id % 4) * 0.125 AS b FROM comp WHERE o_totalprice > 150000)
SELECT coalesce(i.component_id, sem.component_id) AS component_id, coalesce(depth, 0) AS depth, coalesce(min_coupling, 'semantic') AS coupling, b IS NOT NULL AS has_semantic,
  round_even(cast(CASE WHEN i.component_id IS NULL THEN b * (CASE sem.criticality WHEN 'critical' THEN 4 WHEN 'high' THEN 2 WHEN 'medium' THEN 1 ELSE 0.5 END)
    ELSE (CASE min_coupling WHEN 'tight' THEN 1.0 WHEN 'loose' THEN 0.5 ELSE 0.2 END) * (CASE i.criticality WHEN 'critical' THEN 4 WHEN 'high' THEN 2 WHEN 'medium' THEN 1 ELSE 0.5 END) / depth
      * (CASE WHEN b IS NULL THEN 1 ELSE 1.25 END) END AS DOUBLE), 1) AS score
FROM i FULL JOIN sem ON i.component_id = sem.component_id""")
def hybrid_merge(spark, sf_dir):
    comp = T.components(spark, sf_dir).select(F.col("id").alias("component_id"), "criticality", "o_totalprice")
    found = traverse.traverse(T.laid(spark, sf_dir), T.changed(spark, sf_dir), T.MAX_DEPTH, chains=False).join(comp.drop("o_totalprice"), "component_id")
    sem = comp.filter("o_totalprice > 150000").withColumn("best_score", 0.25 + F.col("component_id") % 4 * 0.125)
    out = score.scored_impacts(found, sem)
    return out.select("component_id", "depth", "coupling", "has_semantic", F.bround("score", 1).alias("score"))


# --- texts ---------------------------------------------------------------------------------------------------------


def _ascii(pattern: str) -> str:
    for a, b in (("(?-U)", ""), ("(?iuU)", "(?i)"), ("(?iu)", "(?i)"), ("(?mU)", "(?m)"), ("(?U)", "")):
        pattern = pattern.replace(a, b)
    return pattern.replace("'", "''")


def _redact_sql(level: str = "strict") -> str:
    """CTEs: ``red`` has doc_id, text, t (redacted) and ev (categories, one an event)."""
    parts = ["r0 AS (SELECT doc_id, text, coalesce(text, '') AS t, cast([] AS VARCHAR[]) AS ev FROM documents)"]
    for i, (category, pattern) in enumerate(redact.patterns(level), 1):
        p = _ascii(pattern)
        parts.append(
            f"""r{i} AS (SELECT doc_id, text, array_to_string(list_transform(range(1, len(g) + 1), lambda j: g[j] || CASE WHEN j <= len(m) THEN '[REDACTED:{category}:' || left(sha256(m[j]), 8) || ']' ELSE '' END), '') AS t,
  list_concat(ev, list_transform(m, lambda x: '{category}')) AS ev
FROM (SELECT doc_id, text, ev, regexp_extract_all(t, '{p}') AS m, string_split_regex(t, '{p}') AS g FROM r{i - 1}))"""
        )
    parts.append(f"red AS (SELECT * FROM r{len(redact.patterns(level))})")
    return ",\n".join(parts)


_CLASS = f"CASE WHEN list_has_any(ev, {redact.CONFIDENTIAL}) THEN 'confidential' WHEN list_has_any(ev, {redact.INTERNAL}) THEN 'internal' ELSE 'public' END"


@query(f"WITH {_redact_sql()} SELECT doc_id, sha256(t) AS sanitized_sha256, len(ev) AS redaction_count, list_sort(list_distinct(ev)) AS categories FROM red")
def redact_pii(spark, sf_dir):
    r = redact.redact(read(spark, sf_dir, "documents").select("doc_id", "text"))
    return r.select("doc_id", F.sha2("sanitized", 256).alias("sanitized_sha256"), "redaction_count", "categories")


#: A text for each kind of secret, made of the row's own numbers.
_KINDS = """CASE doc_id % 20
  WHEN 0 THEN 'key AKIA' || upper(substr(h, 1, 16)) WHEN 1 THEN 'aws_secret_access_key = ' || h WHEN 2 THEN 'AccountKey=' || h
  WHEN 3 THEN 'ghp_' || h WHEN 4 THEN 'github_pat_' || substr(h, 1, 22) WHEN 5 THEN 'Bearer ' || h || '==' WHEN 6 THEN 'api_key: ' || h
  WHEN 7 THEN 'sk-' || substr(h, 1, 24) WHEN 8 THEN 'xoxb-' || substr(h, 1, 12) WHEN 9 THEN 'eyJ' || substr(h, 1, 12) || '.eyJ' || substr(h, 13, 12) || '.' || substr(h, 25, 12)
  WHEN 10 THEN '-----BEGIN RSA PRIVATE KEY-----' || h || '-----END RSA PRIVATE KEY-----' WHEN 11 THEN 'password=' || substr(h, 1, 9)
  WHEN 12 THEN 'postgresql://u:' || substr(h, 1, 4) || '@db/x' WHEN 13 THEN 'export DATABASE_URL = ' || h WHEN 14 THEN '"private_key": "-----BEGIN EC KEY-----' || h || '"'
  WHEN 15 THEN 'ssn 123-45-' || substr('0000' || (doc_id % 10000), -4) || '.' WHEN 16 THEN 'at 10.0.' || (doc_id % 256) || '.7 and' WHEN 17 THEN 'see /home/' || substr(h, 1, 8) || '/x.txt or'
  WHEN 18 THEN 'mail ' || substr(h, 1, 6) || '@example.org' ELSE 'call 555-123-' || substr('0000' || (doc_id % 10000), -4) END"""


@query(f"WITH documents AS (SELECT doc_id, {_KINDS} AS text FROM (SELECT doc_id, sha256(cast(doc_id AS VARCHAR)) AS h FROM documents)), {_redact_sql()} SELECT doc_id, t AS sanitized, len(ev) AS redaction_count, list_sort(list_distinct(ev)) AS categories FROM red")
def redact_secrets(spark, sf_dir):
    d = read(spark, sf_dir, "documents").select("doc_id", F.sha2(F.col("doc_id").cast("string"), 256).alias("h"))
    return redact.redact(d.select("doc_id", F.expr(_KINDS).alias("text"))).select("doc_id", "sanitized", "redaction_count", "categories")


@query(f"WITH {_redact_sql('moderate')} SELECT category, count(*) AS n FROM (SELECT unnest(ev) AS category FROM red) GROUP BY 1")
def redaction_counts(spark, sf_dir):
    r = redact.redact(read(spark, sf_dir, "documents").select("text"), level="moderate")
    return r.select(F.explode(F.transform("redactions", lambda e: e["category"])).alias("category")).groupBy("category").agg(F.count("*").alias("n"))


@query(" UNION ALL ".join(f"SELECT doc_id, '{c}' AS category, left(m, 20) || '...' AS preview FROM (SELECT doc_id, unnest(regexp_extract_all(coalesce(text, ''), '{_ascii(p)}')) AS m FROM documents)" for c, p in redact.SECRETS + redact.PII))
def pii_scan(spark, sf_dir):
    return redact.scan(read(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", "category", "preview")


@query(f"WITH {_redact_sql()} SELECT {_CLASS} AS classification, count(*) AS n FROM red GROUP BY 1")
def classification(spark, sf_dir):
    r = redact.redact(read(spark, sf_dir, "documents").select("text"))
    return r.groupBy(redact.classification(F.col("categories")).alias("classification")).agg(F.count("*").alias("n"))


#: Every text with lines of code before it that depend on its id; of five rules, two make code.
_CODE = """concat(
  CASE WHEN doc_id % 2 = 0 THEN 'import re\n' ELSE '' END, CASE WHEN doc_id % 3 = 0 THEN 'def f' || doc_id || '(x):\n' ELSE '' END,
  CASE WHEN doc_id % 5 = 0 THEN '    return ' || doc_id || '\n' ELSE '' END, CASE WHEN doc_id % 7 = 0 THEN 'class A' || doc_id || ':\n' ELSE '' END,
  CASE WHEN doc_id % 11 = 0 THEN 'for x in y:\n' ELSE '' END, coalesce(text, ''))"""


@query(f"WITH d AS (SELECT doc_id, {_CODE} AS t FROM documents) SELECT doc_id FROM d WHERE " + " + ".join(f"cast(regexp_matches(t, '{_ascii(p)}') AS INT)" for p in redact.SOURCE_CODE) + " >= 2")
def source_code_flag(spark, sf_dir):
    return read(spark, sf_dir, "documents").filter(redact.has_source_code(F.expr(_CODE))).select("doc_id")


@query("SELECT doc_id, length(text) AS n FROM documents WHERE length(text) > 10000")
def size_guard(spark, sf_dir):
    return read(spark, sf_dir, "documents").filter(redact.too_long(F.col("text"), 10_000)).select("doc_id", F.length("text").alias("n"))


@query("SELECT doc_id FROM documents WHERE contains(lower(coalesce(text, '')), 'idiot') OR contains(lower(coalesce(text, '')), 'license')")
def deny_list(spark, sf_dir):
    return read(spark, sf_dir, "documents").filter(redact.denied(F.col("text"), ("Idiot", "LICENSE"))).select("doc_id")


@query(f"WITH {_redact_sql()} SELECT sha256(coalesce(text, '')) AS content_hash, length(coalesce(text, '')) AS content_length, length(t) AS sanitized_length, len(ev) AS redaction_count, {_CLASS} AS classification, length(coalesce(text, '')) > 10000 AS blocked FROM red")
def audit_entries(spark, sf_dir):
    a = redact.audit(read(spark, sf_dir, "documents"), "embed", "store")
    return a.select("content_hash", "content_length", "sanitized_length", "redaction_count", "classification", "blocked")


@query(f"WITH {_redact_sql()} SELECT count(*) AS total, count(*) FILTER (length(text) > 10000) AS blocked, sum(len(ev)) AS redactions, list_sort(list_distinct(flatten(list(ev)))) AS categories FROM red")
def audit_summary(spark, sf_dir):
    return redact.audit_summary(redact.audit(read(spark, sf_dir, "documents"), "embed", "store"))


# --- cache and cost ------------------------------------------------------------------------------------------------



def _cache(spark, sf_dir):
    docs = read(spark, sf_dir, "documents").filter("doc_id % 4 = 0")
    return cost.keyed(docs, "model-a").select(F.col("cache_key").alias("key")).distinct()


@query("SELECT sha256(cast('model-a' AS BLOB) || '\\x00'::BLOB || encode(coalesce(text, ''))) AS cache_key, count(*) AS n FROM documents GROUP BY 1 HAVING count(*) > 1")
def cache_key_dedupe(spark, sf_dir):
    k = cost.keyed(read(spark, sf_dir, "documents"), "model-a")
    return k.groupBy("cache_key").agg(F.count("*").alias("n")).filter("n > 1")


_TOKENS = "CASE WHEN length(coalesce(text, '')) = 0 THEN 0 ELSE greatest(1, length(text) // 4) END"
_HIT = "coalesce(text, '') IN (SELECT coalesce(text, '') FROM documents WHERE doc_id % 4 = 0)"


@query(f"SELECT count(*) AS documents, count(*) FILTER ({_HIT}) AS cache_hits, count(*) FILTER (NOT {_HIT}) AS paid_documents, sum(CASE WHEN {_HIT} THEN 0 ELSE {_TOKENS} END) AS paid_tokens, cast(ceil(count(*) FILTER (NOT {_HIT}) / 100.0) AS BIGINT) AS batches, round(sum(CASE WHEN {_HIT} THEN 0 ELSE {_TOKENS} END) / 1e6 * 0.02, 4) AS usd FROM documents")
def token_cost(spark, sf_dir):
    return cost.embedding_cost(read(spark, sf_dir, "documents"), _cache(spark, sf_dir), "model-a")


@query(f"SELECT doc_id FROM documents WHERE NOT {_HIT}")
def cache_misses(spark, sf_dir):
    return cost.cache_misses(read(spark, sf_dir, "documents"), _cache(spark, sf_dir), "model-a").select("doc_id")


@query(f"SELECT count(*) FILTER ({_HIT}) AS hits, count(*) FILTER (NOT {_HIT}) AS misses, round(count(*) FILTER ({_HIT}) / count(*), 4) AS hit_rate FROM documents")
def cache_stats(spark, sf_dir):
    return cost.cache_stats(read(spark, sf_dir, "documents"), _cache(spark, sf_dir), "model-a")


@query("SELECT c_custkey AS key FROM customer ORDER BY c_nationkey DESC, c_custkey LIMIT 200")
def cache_evict(spark, sf_dir):
    c = read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("key"), F.col("c_nationkey").cast("long").alias("last_used"))
    return cost.evict(c, 200).select("key")


@query("SELECT lang, count(*) AS n_docs, count(DISTINCT source) AS n_entities, sum(length(text)) AS n_chars, sum(length(text)) // count(*) AS avg_chars FROM documents GROUP BY ROLLUP (lang)")
def doc_stats(spark, sf_dir):
    return documents.document_stats(read(spark, sf_dir, "documents"), "lang", "source")


@query("SELECT p_partkey, lower(regexp_replace(regexp_replace(replace(p_brand, '#', 'X'), '(.)([A-Z][a-z]+)', '\\1_\\2', 'g'), '([a-z0-9])([A-Z])', '\\1_\\2', 'g')) AS snake, lower(trim(regexp_replace(p_type, '[^A-Za-z0-9]+', '_', 'g'), '_')) AS slug FROM part")
def name_helpers(spark, sf_dir):
    p = read(spark, sf_dir, "part")
    return p.select("p_partkey", X.snake_case(F.replace("p_brand", F.lit("#"), F.lit("X"))).alias("snake"), X.csproj_id(F.col("p_type")).alias("slug"))


def _graph(spark, sf_dir, orphans=False):
    """Components with modules from the order tables, as nested rows; with ``orphans``, those without modules too, and price and customer."""
    e = T.laid(spark, sf_dir).by_component
    nested = e.groupBy("component_id").agg(F.sort_array(F.collect_list(F.struct("mod_ord", "module_id", "coupling"))).alias("r"))
    c = T.components(spark, sf_dir).join(nested, F.col("id") == F.col("component_id"), "left" if orphans else "inner")
    if orphans:
        c = c.join(read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), "o_custkey"), "id")
    mods = F.transform("r", lambda x: F.struct(x["module_id"].cast("string").alias("module_id"), x["coupling"].alias("coupling"), F.lit("part").alias("usage")))
    more = ["o_totalprice", "o_custkey"] if orphans else []
    return c.select(F.concat(F.lit("c"), "id").alias("id"), "name", F.lit(" Buys parts ").alias("description"), F.lit("sales").alias("team_owner"), "criticality", mods.alias("modules"), F.array(F.lit("GET /x")).alias("api_surface"), F.col("id").cast("int").alias("load_ord"), *more)


_E = f"WITH {T.EDGES_SQL},\n{T.COMPONENTS_SQL}"


@query(f"""{_E}, c AS (SELECT * FROM comp JOIN (SELECT component_id, list(cast(module_id AS VARCHAR) ORDER BY mod_ord) AS ms, count(*) AS n FROM e GROUP BY 1) ON id = component_id)
SELECT 'c' || id || '__description' AS doc_id, name || ' (c' || id || '): Buys parts' || chr(10) || 'Team: sales. Criticality: ' || criticality || '.' AS text FROM c
UNION ALL SELECT 'c' || e.component_id || '__module__' || module_id, name || ' uses module ''' || module_id || ''': part. Coupling: ' || coupling || '.' FROM e JOIN comp ON id = component_id
UNION ALL SELECT 'c' || id || '__api_surface', name || ' API endpoints:' || chr(10) || '  - GET /x' FROM c
UNION ALL SELECT 'c' || id || '__summary', 'Component: ' || name || ' (ID: c' || id || ')' || chr(10) || 'Purpose: Buys parts' || chr(10) || 'Team: sales' || chr(10) || 'Criticality: ' || criticality || chr(10) || 'Shared modules: ' || array_to_string(ms, ', ') || chr(10) || 'API endpoints: 1' FROM c""")
def prepare_documents(spark, sf_dir):
    return documents.prepare_documents(_graph(spark, sf_dir)).select("doc_id", "text")


@query(f"""{_E}, h AS (SELECT o_orderkey AS id, o_custkey, o_totalprice FROM orders),
v AS (SELECT o_orderkey AS id FROM orders JOIN customer ON o_custkey = c_custkey WHERE c_nationkey < 20)
SELECT 'orphan_component' AS gap_type, 'critical' AS severity, 'c' || id AS entity_id FROM h WHERE id NOT IN (SELECT component_id FROM e)
UNION ALL SELECT 'coupling_ambiguity', 'medium', 'c' || component_id FROM e GROUP BY component_id HAVING count(*) >= 2 AND min(coupling) = 'tight' AND max(coupling) = 'tight'
UNION ALL SELECT 'isolated_module', 'medium', cast(module_id AS VARCHAR) FROM e GROUP BY module_id HAVING count(*) = 1
UNION ALL SELECT 'missing_description', 'high', 'c' || id FROM h WHERE o_totalprice < 100000
UNION ALL SELECT 'no_api_surface', 'low', 'c' || id FROM h WHERE o_totalprice > 200000
UNION ALL SELECT 'no_variant_assignment', 'medium', 'c' || id FROM h WHERE id NOT IN (SELECT id FROM v)
UNION ALL SELECT 'low_confidence', 'high', 'c' || id FROM h WHERE o_totalprice < 50000
UNION ALL SELECT 'potential_missing_link', 'low', 'c' || a.id || ':c' || b.id FROM h a JOIN h b ON a.o_custkey = b.o_custkey AND a.id < b.id
  WHERE a.id IN (SELECT component_id FROM e) AND b.id IN (SELECT component_id FROM e)
  AND NOT EXISTS (SELECT 1 FROM e x JOIN e y ON x.module_id = y.module_id WHERE x.component_id = a.id AND y.component_id = b.id)""")
def gap_detection(spark, sf_dir):
    """All eight rules: cheap orders lack a description or were recognised with little confidence, dear ones lack an interface."""
    base = _graph(spark, sf_dir, orphans=True)
    price = F.col("o_totalprice")
    comp = base.withColumn("description", F.when(price < 100000, F.lit("Class x")).otherwise(F.col("description"))).withColumn("api_surface", F.when(price > 200000, F.expr("cast(array() as array<string>)")).otherwise(F.col("api_surface")))
    comp = written(comp.drop("o_totalprice", "o_custkey"), "components")
    nations = T.members(spark, sf_dir).filter("variant_id < 20").select(F.col("variant_id").cast("string").alias("variant_id"), F.concat(F.lit("c"), "component_id").alias("component_id"))
    g = graph.build_graph(comp, spark.createDataFrame([], graph.VARIANT_SCHEMA))
    variants = nations.select(F.col("variant_id").alias("id")).distinct()
    parsed = base.select("id", "name", F.concat(F.lit("customer/"), "o_custkey", F.lit("/"), "id").alias("source_file"), F.least(price / 100000, F.lit(1.0)).alias("confidence"), F.col("load_ord").alias("ord"))
    found = gaps.detect(graph.GraphTables(g.components, g.edges, variants, nations), parsed)
    return found.select("gap_type", "severity", "entity_id")


@query("SELECT o_orderkey AS entity_id, o_totalprice FROM orders WHERE least(o_totalprice / 100000, 1.0) < 0.5")
def low_confidence(spark, sf_dir):
    d = read(spark, sf_dir, "orders").withColumn("confidence", F.least(F.col("o_totalprice") / 100000, F.lit(1.0)))
    return gaps.low_confidence(d).select(F.col("o_orderkey").alias("entity_id"), "o_totalprice")


@query("SELECT doc_id FROM documents WHERE len(regexp_extract_all(coalesce(text, ''), '[0-9]{4}')) = 0")
def no_api_surface(spark, sf_dir):
    """Numbers of four digits stand for endpoints: documents without any have no interface."""
    d = read(spark, sf_dir, "documents").withColumn("api_surface", F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit("[0-9]{4}"), F.lit(0)))
    return gaps.no_api_surface(d).select("doc_id")


@query(f"{_E} SELECT 'c' || component_id AS component_id, cast(module_id AS VARCHAR) AS module_id, coupling, mod_ord FROM e")
def build_graph_edges(spark, sf_dir):
    g = graph.build_graph(_graph(spark, sf_dir), spark.createDataFrame([], graph.VARIANT_SCHEMA))
    return g.edges.select("component_id", "module_id", "coupling", "mod_ord")


@query(f"""{_E}
SELECT 'o' || component_id || '.py' AS path, 'm' || module_id || '.py' AS dep FROM e""")
def import_graph_first_match(spark, sf_dir):
    """Orders as files that import their parts, at two depths: each import resolves to the file of the part."""
    from tremor.operators import ingest

    e = T.edges(spark, sf_dir)
    users = e.groupBy("component_id").agg(F.flatten(F.collect_list(F.array(F.concat(F.lit("m"), "module_id"), F.concat(F.lit("m"), "module_id", F.lit(".run"))))).alias("imports"))
    files = users.select(F.concat(F.lit("o"), "component_id", F.lit(".py")).alias("path"), F.col("component_id").alias("ord"), "imports")
    parts = e.select("module_id").distinct().select(F.concat(F.lit("m"), "module_id", F.lit(".py")).alias("path"), (-F.col("module_id") - 1).alias("ord"), F.expr("cast(array() as array<string>)").alias("imports"))
    return ingest.import_graph(files.unionByName(parts))


@query(f"""WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents) SELECT doc_id, length(t) > 10000 OR contains(lower(t), 'license') AS stays FROM d""")
def guarded_batch(spark, sf_dir):
    """What the guard would keep from being sent: too long, or with a blocked word."""
    from tremor.plans.guard import Privacy, guarded_batches

    out = guarded_batches(read(spark, sf_dir, "documents").select("doc_id", "text"), Privacy(blocked=("License",)))
    return out.select("doc_id", (~F.col("sent")).alias("stays"))


@query("SELECT (count(*) + 99) // 100 AS embedding_calls, (count(*) + 9) // 10 AS suggestion_calls FROM documents")
def batch_plan(spark, sf_dir):
    n = read(spark, sf_dir, "documents").count()
    p = cost.Prices()
    return spark.createDataFrame([(-(-n // p.embedding_batch), cost.suggestion_cost(n, 1)["calls"])], "embedding_calls long, suggestion_calls long")


@query(f"WITH {_STORE} SELECT vec_id, round(d, 9) AS distance FROM s WHERE label = 1 ORDER BY d, vec_id LIMIT 7")
def search_modules(spark, sf_dir):
    """Rows of one label stand for documents about the use of a module."""
    store = _store(spark, sf_dir).withColumn("doc_type", F.when(F.col("label") == 1, "module_usage").otherwise("description"))
    return retrieve.search_modules(store, QUERY, 7, id_col="vec_id").select("vec_id", _r("distance").alias("distance"))
