"""Compile, guard, cache store, retry and the service calls over them."""

import json
import os

import pytest
import yaml
from pyspark.sql import functions as F

from tremor.functions.retry import Transient, retrying
from tremor.operators import cost, gaps, graph, ingest, redact, retrieve
from tremor.plans import analysis, compilation, guard, ingestion, validation
from tremor.sources import cache_store, code, definitions, repository
from tremor.sources.shared import read_text, write_text

COMPONENTS = [
    ("comp_a", "Component A", "Handles logins for users", "team-a", "high", [("bus", "tight", "events"), ("db", "loose", "rows")], ["GET /a"], 0),
    ("comp_b", "Component B", "Sends bills to customers", "team-b", "medium", [("bus", "tight", "events")], [], 1),
]
VARIANTS = [("v1", "Variant One", "pro", "eu", "d", None, [("comp_a", ["x"], "{}"), ("comp_b", [], "{}")], "{}", 0)]


def make(spark, components=COMPONENTS, variants=VARIANTS):
    return graph.build_graph(spark.createDataFrame(components, graph.COMPONENT_SCHEMA), spark.createDataFrame(variants, graph.VARIANT_SCHEMA))


@pytest.fixture(scope="module")
def g(spark):
    return make(spark)


def test_compile(spark, g, tmp_path):
    root, embed = str(tmp_path), retrieve.hashed_words(16)
    os.makedirs(f"{root}/data/components")
    with open(f"{root}/data/components/old.yaml", "w") as f:
        f.write("id: old\n")
    os.makedirs(f"{root}/config")
    with open(f"{root}/config/model_config.yaml", "w") as f:
        f.write("llm: {model: m}\n")
    found = gaps.detect(g)
    got = compilation.compile_graph(g, root, embed=embed, vectors=f"{root}/data/vectors", found=found)
    assert got.ok and (got.components, got.variants, got.config_updated) == (2, 1, True)
    a = yaml.safe_load(open(f"{root}/data/components/comp_a.yaml"))
    assert list(a) == ["id", "name", "description", "team_owner", "criticality", "modules", "api_surface"] and len(a["modules"]) == 2
    assert yaml.safe_load(open(f"{root}/data/variants/v1.yaml"))["components"][0] == {"component_id": "comp_a", "features": ["x"], "config_overrides": {}}
    config = yaml.safe_load(open(f"{root}/config/model_config.yaml"))
    assert config["llm"] == {"model": "m"} and config["recompilation"]["component_count"] == 2 and config["recompilation"]["gap_analysis"]["total_gaps"] == found.count()
    manifest = json.load(open(f"{root}/deployment_manifest.json"))
    assert manifest["graph"]["component_count"] == 2 and manifest["compilation"]["components_written"] == 2 and manifest["deployment"]["health_check"] == "/health"
    assert manifest["quality"]["unresolved_gaps"] == found.count() and manifest["compilation"]["documents_embedded"] == got.documents == spark.read.parquet(f"{root}/data/vectors").count()
    saved = [d for d in os.listdir(f"{root}/data") if d.startswith("backup_")]
    assert len(saved) == 1 and os.path.exists(f"{root}/data/{saved[0]}/components/old.yaml")
    again = ingestion.ingest_yaml(spark, f"{root}/data/components", f"{root}/data/variants")
    assert {r.id for r in again.components.collect()} >= {"comp_a", "comp_b"}


def test_compile_stops(spark, g, tmp_path, monkeypatch):
    empty = compilation.compile_graph(graph.empty_graph(spark), str(tmp_path / "e"))
    lone = compilation.compile_graph(make(spark, [("x", "X", "", "", "low", [], [], 0)], []), str(tmp_path / "l"))
    same = compilation.compile_graph(make(spark, [("x", "x", "", "", "low", [("m", "tight", "")], [], 0)], []), str(tmp_path / "s"))
    assert empty.errors[0] == "no components" and lone.errors == ["no edges"] and same.errors == ["x: name equals id"]
    assert not any(os.path.exists(tmp_path / d) for d in "els")
    write = definitions.write_definitions

    def failing(df, folder):
        if folder.endswith("variants"):
            raise OSError("disk is full")
        write(df, folder)

    monkeypatch.setattr(definitions, "write_definitions", failing)
    got = compilation.compile_graph(g, str(tmp_path / "v"))
    # variants fail, what comes after goes on
    assert got.errors == ["variants: disk is full"] and got.components == 2 and got.config_updated and got.manifest


def test_guard(spark):
    sent = []

    def ask(prompt, **more):
        sent.append((prompt, more))
        return "yes"

    x = guard.Guard(spark, guard.privacy_from({"security": {"privacy": {"max_prompt_length": 200, "max_embedding_length": 60, "max_batch_size": 2, "blocked_patterns": ["TopSecret"]}}}))
    assert x.generate(ask, "mail a.b@c.org", system="at 10.0.0.1", temperature=0) == "yes"
    assert "a.b@c.org" not in sent[0][0] and "10.0.0.1" not in sent[0][1]["system"] and sent[0][1]["temperature"] == 0
    for bad in (lambda: x.generate(ask, "y" * 201), lambda: x.generate(ask, "a topsecret plan"), lambda: x.embed(len, ["z" * 61]), lambda: x.embed(len, ["a", "b", "c"])):
        with pytest.raises(guard.PrivacyViolation):
            bad()
    assert x.embed(lambda ts: [[float("[REDACTED" in t)] for t in ts], ["call 555-123-4567", "clean"]) == [[1.0], [0.0]] and x.embed(len, []) == []
    assert len(x.embed_one(retrieve.hashed_words(4), "one")) == 4
    log = x.audit()
    assert log.filter("blocked").count() == 4 and x.status()["redactions"] == 2 and len(sent) == 1
    assert "hunter2" not in str(log.collect())
    off = guard.Guard(spark, guard.Privacy(local_only=True))
    assert off.generate(ask, "p") == "" and off.embed(len, ["p"]) == [] and off.embed_one(len, "p") == [] and len(sent) == 1 and off.status()["blocked"] == 3
    with pytest.raises(ValueError):
        guard.privacy_from({"security": {"privacy": {"redaction_level": "some"}}})


def test_retry():
    waits, left = [], [2]

    def call(x):
        if left[0]:
            left[0] -= 1
            raise Transient("later")
        return x

    assert retrying(call, 3, 1.0, sleep=waits.append)(7) == 7 and waits == [1.0, 2.0]
    left[0] = 9
    with pytest.raises(Transient):
        retrying(call, 2, 1.0, sleep=waits.append)(7)
    assert left[0] == 6

    def wrong():
        raise KeyError("caller")

    waits.clear()
    with pytest.raises(KeyError):
        retrying(wrong, 3, sleep=waits.append)()
    assert not waits


def test_cache_store(spark, tmp_path):
    folder, calls = str(tmp_path / "cache"), []

    def embed(texts):
        calls.extend(texts)
        return [[float(len(t))] for t in texts]

    docs = spark.createDataFrame([(i, t) for i, t in enumerate(["a", "bb", "a", "ccc"])], "i int, text string")
    s = cache_store.load(spark, folder)
    out, s = cache_store.embed(s, docs, embed, "m", 1)
    assert {r.i: r.embedding[0] for r in out.collect()} == {0: 1.0, 1: 2.0, 2: 1.0, 3: 3.0} and s.dirty
    s = cache_store.flush(s)
    again = cache_store.load(spark, folder, most=2)
    assert again.entries.count() == 3
    out, again = cache_store.embed(again, docs.filter("i < 2"), lambda ts: 1 / 0, "m", 2)
    assert again.stats == {"hits": 2, "misses": 0, "evictions": 1, "hit_rate": 1.0} and out.filter("embedding is null").count() == 0
    assert {r.last_used for r in again.entries.collect()} == {2}
    write_text(spark, f"{folder}/current.json", "not json")
    assert cache_store.load(spark, folder).entries.count() == 0
    write_text(spark, f"{folder}/current.json", json.dumps({"version": 1, "table": f"{folder}/gone"}))
    assert cache_store.load(spark, folder).entries.count() == 0
    off = cache_store.load(spark, folder, enabled=False)
    out, same = cache_store.embed(off, docs, embed, "m", 3)
    assert out.count() == 4 and same.stats["misses"] == 0 and cache_store.flush(same) is same
    assert read_text(spark, f"{folder}/none") is None


def test_evict_by_ranges(spark):
    rows = [(f"k{i:04d}", [0.0], (i * 7919) % 5003 * 1_000_003) for i in range(3000)] + [(f"t{i}", [0.0], 42) for i in range(20)]
    cache = spark.createDataFrame(rows, cache_store.SCHEMA)
    for most in (0, 1, 7, 1000, 3005, 3020, 9999):
        want = sorted(k for k, _, _ in sorted(rows, key=lambda r: (-r[2], r[0]))[:most])
        assert sorted(r.key for r in cost.evict(cache, most).select("key").collect()) == want


def test_upsert_and_search(spark):
    store = spark.createDataFrame([("a", "old", "module_usage", [1.0, 0.0]), ("b", "b", "summary", [1.0, 0.0])], "doc_id string, text string, doc_type string, embedding array<double>")
    rows = spark.createDataFrame([("a", "first", "module_usage", [0.5, 0.5], 1), ("a", "last", "module_usage", [0.0, 1.0], 2), ("c", "c", "module_usage", [0.9, 0.1], 3)], "doc_id string, text string, doc_type string, embedding array<double>, load_ord int")
    got = retrieve.upsert(store, rows, order="load_ord")
    assert {r.doc_id: r.text for r in got.collect()} == {"a": "last", "b": "b", "c": "c"} and retrieve.count(got) == 3
    assert [r.doc_id for r in retrieve.search_modules(got, "q", 5, lambda ts: [[1.0, 0.0]]).collect()] == ["c", "a"]


def test_batch_knn_blocks(spark):
    rows = [(i, [float((i * k) % 7 - 3) for k in range(1, 5)]) for i in range(60)] + [(99, [0.0] * 4)]
    store = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    asked = store.filter("vec_id % 9 = 1").select(F.col("vec_id").alias("query_id"), "embedding")
    one = sorted((r.query_id, r.rank, r.vec_id) for r in retrieve.batch_knn(store, asked, 3).collect())
    many = sorted((r.query_id, r.rank, r.vec_id) for r in retrieve.batch_knn(store, asked, 3, block_floats=8).collect())
    assert one == many and len(one) == 3 * asked.count()


def test_batch_knn_tiles_and_copies(spark, monkeypatch):
    """Any tiles give the rows of a plain sort; copies whose distances differ by rounding alone are ordered by id; ids may be texts."""
    import numpy as np

    rng = np.random.default_rng(5)
    v = np.round(rng.normal(size=(150, 6)), 1)
    v[40:90] = v[7]
    v[50:90] *= 1 + np.arange(40)[:, None] * 1e-14
    v[149] = 0
    unit = v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-300)
    store = spark.createDataFrame([(f"d{149 - i:03}", i, x.tolist()) for i, x in enumerate(v)], "doc_id string, vec_id long, embedding array<double>")
    asked = store.filter("vec_id % 7 = 0").select(F.col("vec_id").alias("query_id"), "embedding")
    for tile in ((1, 1), (4, 9), (64, 64)):
        monkeypatch.setattr(retrieve, "TILE", tile)
        for name, of in (("vec_id", lambda i: i), ("doc_id", lambda i: f"d{149 - i:03}")):
            got = {(r.query_id, r["rank"]): r.vec_id for r in retrieve.batch_knn(store, asked, 5, id_col=name, digits=9).collect()}
            for q in range(0, 150, 7):
                d = np.where(np.arange(150) == 149, np.inf, np.round(1 - unit @ unit[q], 9))
                assert [got[q, r] for r in range(1, 6)] == [x for _, x in sorted((d[i], of(i)) for i in range(150))[:5]]


def test_missing_links(spark):
    located = spark.createDataFrame([(f"c{i}", "p" if i < 8 else "q", i) for i in range(12)], "component_id string, parent string, ord int")
    mods = {i: [f"m{i % 3}", "hub"] if i % 4 == 0 else [f"m{i % 3}"] for i in range(11)}
    edges = spark.createDataFrame([(f"c{i}", m) for i, ms in mods.items() for m in ms], "component_id string, module_id string")
    pairs = {(f"c{i}", f"c{j}") for i in mods for j in mods if i < j and (i < 8) == (j < 8) and not set(mods[i]) & set(mods[j])}
    assert {(r.c1, r.c2) for r in gaps.potential_missing_links(located, edges).collect()} == pairs
    counts = {r.component_id: r.missing for r in gaps.missing_link_counts(located, edges).collect()}
    assert counts == {f"c{i}": sum(f"c{i}" in p for p in pairs) for i in mods}
    asked = spark.createDataFrame([("c5",), ("c9",)], "component_id string")
    assert {(r.c1, r.c2) for r in gaps.potential_missing_links(located, edges, asked).collect()} == {p for p in pairs if "c5" in p or "c9" in p}


def test_service(spark, g, tmp_path):
    s = analysis.Service()
    for call in (s.summary, s.components, lambda: s.compile(str(tmp_path))):
        with pytest.raises(analysis.NotFound):
            call()
    assert s.status() == {"graph_loaded": False, "vectors_loaded": False, "llm_available": False, "session_active": False} and s.privacy() == {"enabled": False, "log": []}
    tree = tmp_path / "tree"
    (tree / "svc").mkdir(parents=True)
    (tree / "svc" / "Dockerfile").write_text("FROM x")
    (tree / "svc" / "main.py").write_text('"""Main."""\nclass Runner:\n    def run(self): ...\n    def stop(self): ...\n')
    (tree / ".git").mkdir()
    (tree / ".git" / "config.py").write_text("x = 1")
    (tree / "web").mkdir()
    (tree / "web" / "package.json").write_text(json.dumps({"name": "shop", "author": "Ann <a@x>", "description": "Shows\nthings", "dependencies": {"react": "1"}}))
    (tree / "net").mkdir()
    (tree / "net" / "A.csproj").write_text("<Project><PropertyGroup><Authors>Core, Others</Authors></PropertyGroup></Project>")
    (tree / "net" / "All.sln").write_text('Project("{AB-1}") = "A", "A.csproj", "{CD-2}"\nEndProject\nProject("{AB-1}") = "B", "lib\\B.csproj", "{CD-3}"\n')
    estimate = analysis.Service().estimate(str(tree))
    assert estimate["embedding"]["documents"] > 0 and estimate["total_usd"] >= 0
    s.embed, s.guard = retrieve.hashed_words(16), guard.Guard(spark)
    got = s.ingest(str(tree), embed=True)
    assert got["summary"]["component_count"] == 5 and got["documents_embedded"] == s.vectors.count()
    assert any("lib/B.csproj" in w for w in got["warnings"]) and not any("A.csproj'" in w for w in got["warnings"])
    owners = {r["id"]: (r["team_owner"], r["description"]) for r in s.components()}
    assert owners["shop"] == ("Ann", "Shows") and owners["a"][0] == "Core"
    assert {x["gap_type"] for x in s.detect_gaps()} >= {"orphan_component"}
    s.start_session()
    assert s.status()["session_active"] and s.status()["privacy"]["calls"] == 0 and s.privacy()["enabled"]
    with pytest.raises(analysis.BadRequest):
        s.ingest(str(tree / "none"))
    s.graph = g
    done = s.compile(str(tmp_path / "out"))
    assert done["ok"] and done["components_written"] == 2 and done["documents_embedded"] == 0
    loaded = s.ingest_yaml(str(tmp_path / "out/data/components"), str(tmp_path / "out/data/variants"))
    assert loaded["summary"]["component_count"] == 2 and s.session is None
    tests = s.generate_tests(str(tmp_path / "test_generated.py"))
    assert tests["tests_generated"] == sum(tests["summary"].values()) and "def test_graph" in (tmp_path / "test_generated.py").read_text()
    assert not validation.run(s.g, validation.generate(s.g))


def test_scan_passes_over_ignored(spark, tmp_path):
    for p in ("a/.git/x.py", "a/node_modules/y.py", "a/my.egg-info/z.py", "a/.hidden/k.py", "_b/l.py", "top.py"):
        (tmp_path / p).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / p).write_text("x = 1")
    assert sorted(r.path for r in repository.scan(spark, str(tmp_path), content=False).collect()) == ["_b/l.py", "a/.hidden/k.py", "top.py"]


def test_first_boundary_by_path(spark):
    parsed = spark.createDataFrame([("z/api/m.py", 1, "Doc z."), ("a/api/m.py", 2, "Doc a.")], "path string, ord int, docstring string")
    bounds = spark.createDataFrame([("z/api", "api", "Dockerfile"), ("a/api", "api", "Dockerfile")], "root_dir string, name string, marker string")
    rows = ingest._first_by_id(ingest.boundary_components(bounds, parsed)).collect()
    assert [(r.id, r.source_file, r.description) for r in rows] == [("api", "a/api", "Doc a.")]


def test_reports(spark, g):
    embed, asked = retrieve.hashed_words(32), []

    def ask(prompt, **more):
        asked.append((prompt, more))
        return "because"

    from tremor.operators.documents import prepare_documents

    vectors = retrieve.embed_documents(prepare_documents(g.components), embed)
    got = analysis.analyze(g, ["comp_a"], vectors, embed, ask, options=analysis.EXPLAIN, threshold=-1.0)
    rep = analysis.report(got, 1)
    assert rep["llm_used"] and asked[0][1] == analysis.EXPLAIN and rep["variants"][0]["explanation"] == "because"
    text = asked[0][0]
    assert "Variant: Variant One (pro, eu)" in text and "comp_a → bus → comp_b" in text and "shares bus" in text and "~ comp_b (" in text and "): " in text.split("~ comp_b (")[1]
    plain = analysis.terminal(rep, ["comp_a"])
    assert "Direct impacts" in plain and "comp_b" in plain and "because" in plain and plain.count("none") == 1
    listed = analysis.listing(g, True, True, True)
    assert "bus: comp_a, comp_b" in listed and "Variant One (v1): 2 components" in listed and "connected" in listed


SECRETS = {
    "AKIA" + "A1" * 8: "api_key", "aws_secret_access_key = abc": "secret_token", '"private_key": "-----BEGIN EC KEY-----x"': "private_key", "AccountKey=" + "a" * 24: "api_key",
    "ghs_" + "a" * 36: "secret_token", "github_pat_" + "a" * 22: "secret_token", "Bearer abc.def": "secret_token", "api-key: " + "a" * 16: "api_key", "sk-" + "a" * 20: "api_key",
    "xoxp-" + "a" * 10: "secret_token", ".".join(["eyJ" + "a" * 10, "eyJ" + "b" * 10, "c" * 10]): "jwt_token", "-----BEGIN PRIVATE KEY-----x-----END PRIVATE KEY-----": "private_key",
    "pwd: 12345678": "password", "redis://h/0": "connection_string", "REDIS_URL = x": "env_variable",
}


def test_every_secret(spark):
    got = redact.redact(spark.createDataFrame([(k,) for k in SECRETS], "text string")).collect()
    assert len(SECRETS) == len(redact.SECRETS) and all(SECRETS[r.text] in r.categories and r.sanitized != r.text for r in got)
