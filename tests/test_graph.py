"""Golden values of the twelve-component graph, and the small graphs of the fixtures."""

import pytest
from pyspark.sql import functions as F

from tremor.functions import ordinals
from tremor.functions import text as X
from tremor.operators import documents, gaps, graph, retrieve, score, session, traverse
from tremor.plans import analysis, validation

EDGES = {
    "api_gateway": ("critical", "rate_limiter t, access_control t, schema_validator t, cache_layer l, metrics_collector l, config_loader t"),
    "audit_logger": ("high", "event_bus t, db_connector t, query_builder t"),
    "auth_engine": ("critical", "crypto_utils t, session_store t, event_bus l, access_control t"),
    "billing_core": ("critical", "tax_calculator t, currency_utils t, db_connector t, cache_layer l, metrics_collector l, config_loader t"),
    "data_exporter": ("medium", "key_rotation t, schema_validator t, file_storage t, retry_handler t, job_scheduler l"),
    "encryption_service": ("critical", "crypto_utils t, key_rotation t, config_loader t"),
    "notification_service": ("high", "template_engine t, i18n_utils t, event_bus t, file_storage l, retry_handler t, websocket_protocol l"),
    "pricing_engine": ("high", "tax_calculator t, currency_utils t, rate_limiter l"),
    "report_generator": ("medium", "template_engine t, i18n_utils t, currency_utils t, db_connector t, file_storage t, query_builder t, job_scheduler l"),
    "search_service": ("high", "query_builder t, cache_layer l, db_connector t, rate_limiter t, metrics_collector l, i18n_utils t"),
    "websocket_gateway": ("high", "session_store t, websocket_protocol t, metrics_collector l, retry_handler t"),
    "workflow_engine": ("high", "event_bus t, schema_validator t, access_control t, job_scheduler t"),
}
SMALL = ["auth_engine", "billing_core", "notification_service", "api_gateway", "search_service"]
MID = [*SMALL, "report_generator", "pricing_engine", "workflow_engine"]
VARIANTS = {
    "enterprise_apac": list(EDGES), "enterprise_eu": list(EDGES), "enterprise_global": list(EDGES),
    "platform_global": ["auth_engine", "api_gateway", "billing_core", "encryption_service", "data_exporter", "pricing_engine"],
    "professional_eu": [*MID, "encryption_service", "audit_logger"], "professional_global": MID, "starter_eu": SMALL, "starter_global": SMALL,
}


def make(spark, comps, variants):
    """comps: id to (criticality, 'module t, module l'); letters t, l, o are couplings."""
    full = {"t": "tight", "l": "loose", "o": "optional"}
    rows = []
    for i, (cid, (crit, mods)) in enumerate(comps.items()):
        ms = [(m.split()[0], full[m.split()[1]], "x") for m in mods.split(", ")] if mods else []
        rows.append((cid, cid.title(), f"Does {cid}", "team", crit, ms, ["GET /x"], i))
    vs = [(v, v, None, None, None, None, [(c, [], "{}") for c in cs], "{}", i) for i, (v, cs) in enumerate(variants.items())]
    return graph.build_graph(spark.createDataFrame(rows, graph.COMPONENT_SCHEMA), spark.createDataFrame(vs, graph.VARIANT_SCHEMA))


@pytest.fixture(scope="module")
def seed(spark):
    g = make(spark, EDGES, VARIANTS)
    return graph.GraphTables(g.components.cache(), g.edges.cache(), g.variants.cache(), g.variant_components.cache())


def test_summary(seed):
    s = graph.graph_summary(seed.components, seed.edges, seed.variants).first()
    assert s.asDict() == {"total_nodes": 32, "component_count": 12, "module_count": 20, "edge_count": 57, "variant_count": 8, "shared_module_count": 20}
    assert len({r.component for r in graph.connectivity(seed.edges).collect()}) == 1
    assert [r[0] for r in graph.component_modules(seed, "auth_engine").collect()] == ["crypto_utils", "session_store", "event_bus", "access_control"]
    assert [r[0] for r in graph.module_components(seed, "event_bus").collect()] == ["audit_logger", "auth_engine", "notification_service", "workflow_engine"]
    assert graph.edge_attributes(seed, "auth_engine", "event_bus").first().coupling == "loose"
    assert [r[0] for r in graph.component_variants(seed, "audit_logger").collect()] == ["enterprise_apac", "enterprise_eu", "enterprise_global", "professional_eu"]


def test_golden_impacts(spark, seed):
    impacts, variants, changed = traverse.impact_of(seed, ["auth_engine"])
    scored = {r.component_id: r.score for r in score.scored_impacts(impacts, spark.createDataFrame([], "component_id string, best_score double, criticality string")).collect()}
    got = [(r.component_id, r.depth, r.min_coupling, scored[r.component_id], ",".join(r.shared_modules), ",".join(r.chain[1:-1])) for r in traverse.in_order(impacts).collect()]
    assert got == [
        ("encryption_service", 1, "tight", 4.0, "crypto_utils", "crypto_utils"),
        ("websocket_gateway", 1, "tight", 2.0, "session_store", "session_store"),
        ("audit_logger", 1, "loose", 1.0, "event_bus", "event_bus"),
        ("notification_service", 1, "loose", 1.0, "event_bus", "event_bus"),
        ("workflow_engine", 1, "loose", 1.0, "access_control,event_bus", "event_bus"),
        ("api_gateway", 1, "tight", 4.0, "access_control", "access_control"),
        ("data_exporter", 2, "tight", 0.5, "", "crypto_utils,encryption_service,key_rotation"),
        ("billing_core", 2, "tight", 2.0, "", "crypto_utils,encryption_service,config_loader"),
        ("search_service", 2, "loose", 0.5, "", "session_store,websocket_gateway,metrics_collector"),
        ("report_generator", 2, "loose", 0.25, "", "event_bus,audit_logger,db_connector"),
        ("pricing_engine", 2, "loose", 0.5, "", "access_control,api_gateway,rate_limiter"),
    ]
    risks = {r.variant_id: (r.affected_count, r.direct_count, r.indirect_count, r.max_criticality, r.risk_score) for r in score.variant_risks(seed.variant_components, changed, score.scored_impacts(impacts, spark.createDataFrame([], "component_id string, best_score double, criticality string")), seed.components).collect()}
    for v in ("enterprise_apac", "enterprise_eu", "enterprise_global"):
        assert risks[v] == (12, 7, 5, "critical", 16.75)
    assert risks["platform_global"] == (6, 3, 3, "critical", 11.0) and risks["professional_eu"] == (10, 6, 4, "critical", 14.25)
    assert risks["professional_global"] == (8, 4, 4, "critical", 9.25) and risks["starter_eu"] == (5, 3, 2, "critical", 7.5)
    assert {r.variant_id: len(r.affected_components) for r in variants.collect()}["starter_global"] == 5


def test_chain_cycle_and_strict(spark):
    chain = make(spark, {"a": ("critical", "x t"), "b": ("high", "x t, y l"), "c": ("medium", "y t, z t"), "d": ("low", "z o")}, {"v1": ["a", "b"], "v2": ["c", "d"]})
    got = {r.component_id: (r.depth, r.min_coupling) for r in traverse.impact_of(chain, ["a"])[0].collect()}
    assert got == {"b": (1, "tight"), "c": (2, "loose"), "d": (3, "optional")}
    assert {r.component_id for r in traverse.impact_of(chain, ["a"], weak=False)[0].collect()} == {"b"}
    assert {r.component_id for r in traverse.impact_of(chain, ["a"], max_depth=2)[0].collect()} == {"b", "c"}
    assert traverse.impact_of(chain, ["nobody"])[0].count() == 0
    ring = make(spark, {"a": ("high", "m1 t, m3 t"), "b": ("high", "m1 t, m2 t"), "c": ("high", "m2 t, m3 t")}, {})
    assert sorted(r.component_id for r in traverse.impact_of(ring, ["a"])[0].collect()) == ["b", "c"]


def test_edges_stay_where_they_are(spark):
    """Discoveries of a random graph with a hub equal a walk's, and a level does not move the edges."""
    import random

    rnd = random.Random(3)
    pairs = sorted({(f"c{rnd.randrange(60):02}", f"m{rnd.randrange(45):02}") for _ in range(110)} | {(f"c{i:02}", "hub") for i in range(0, 60, 9)})
    kinds = {p: rnd.choice(["tight", "loose", "optional"]) for p in pairs}
    mods, comps = {}, {}
    for c, m in pairs:
        mods.setdefault(c, []).append(m)
        comps.setdefault(m, []).append(c)
    rows = [(c, m, kinds[c, m], mods[c].index(m), comps[m].index(c)) for c, m in pairs]
    edges = spark.createDataFrame(rows, "component_id string, module_id string, coupling string, mod_ord int, comp_ord int")
    asked = ["c09", "c01", "nobody"]
    chains, level = {c: [c] for c in asked if c in mods}, [c for c in asked if c in mods]
    want = {}
    for depth in range(1, 4):
        after = []
        for c in level:
            for m in mods[c]:
                for n in comps[m]:
                    if n not in chains:
                        chains[n] = [*chains[c], m, n]
                        after.append(n)
                        steps = [kinds[(a, b) if (a, b) in kinds else (b, a)] for a, b in zip(chains[n], chains[n][1:], strict=False)]
                        want[n] = (depth, min(steps, key=ordinals.COUPLING.get), chains[n])
        level = after
    laid = traverse.laid_out(edges)
    changed = spark.createDataFrame([(c, i) for i, c in enumerate(asked)], "component_id string, pos int")
    assert {r.component_id: (r.depth, r.min_coupling, r.chain) for r in traverse.traverse(laid, changed, 3).collect()} == want
    assert {r.component_id: r.depth for r in traverse.traverse(laid, changed, 3, paths=False).collect()} == {c: d for c, (d, _, _) in want.items()}
    assert {r.component_id: r.min_coupling for r in traverse.traverse(laid, changed, 3, chains=False).collect()} == {c: k for c, (_, k, _) in want.items()}
    for table, key in ((laid.by_component, "component_id"), (laid.by_module, "module_id")):
        plan = changed.select(F.col("component_id").alias(key)).distinct().hint("shuffle_hash").join(table, key)._jdf.queryExecution().executedPlan().toString()
        assert plan.count("Exchange") == 1 and "SortMergeJoin" not in plan


def test_components_by_contraction(spark, monkeypatch):
    """Chains, stars and random lists; a long chain is followed by doubling, and a round leaves fewer edges than it had."""
    import random

    from tremor.operators import components

    rnd, seen = random.Random(7), []
    counted = components._counted
    monkeypatch.setattr(components, "_counted", lambda rows, what: seen.append(counted(rows, what)) or seen[-1])
    ids = [f"n{i:03}" for i in range(200)]
    mixed = rnd.sample(ids[100:140], 40)
    pairs = [(ids[i], ids[i + 1]) for i in range(60)] + [(ids[99], x) for x in ids[70:99]] + list(zip(mixed, mixed[1:], strict=False)) + [(rnd.choice(ids[140:180]), rnd.choice(ids[140:180])) for _ in range(30)] + [(ids[190], ids[190]), (None, ids[0]), (ids[5], ids[5])]
    root = {x: x for p in pairs for x in p if x and None not in p}
    for _ in ids:
        for a, b in pairs:
            if a and b:
                root[a] = root[b] = min(root[a], root[b])
    got = components.connected_components(spark.createDataFrame(pairs, "u string, v string")).collect()
    assert sorted((r.node, r.component) for r in got) == sorted(root.items())
    # two rounds or three over 160 edges, with a pass for each doubling: stars took the whole list again for each
    assert len(seen) <= 24 and seen[-1][1] == 0


def test_merge_with_semantic(spark):
    impacts = spark.createDataFrame([("a", 1, True, "tight", "high")], "component_id string, depth int, is_direct boolean, min_coupling string, criticality string")
    sem = spark.createDataFrame([("a", 0.9, "high"), ("b", 0.8, "critical")], "component_id string, best_score double, criticality string")
    got = {r.component_id: (r.score, r.coupling, r.depth) for r in score.scored_impacts(impacts, sem).collect()}
    assert got == {"a": (2.5, "tight", 1), "b": (3.2, "semantic", 0)}


def test_rounding_and_levels(spark):
    values = [w * m / d * b for w in (1.0, 0.5, 0.2) for m in (4.0, 2.0, 1.0, 0.5) for d in range(1, 21) for b in (1.0, 1.25)]
    got = spark.createDataFrame([(v,) for v in values], "v double").select("v", ordinals.round2(F.col("v")).alias("r")).collect()
    assert all(r.r == round(r.v, 2) for r in got if abs(r.v * 1000 % 10 - 5) > 1e-9)
    assert [r[0] for r in spark.createDataFrame([(7.0,), (4.0,), (2.0,), (1.9,)], "v double").select(ordinals.risk_level(F.col("v"))).collect()] == ["CRITICAL", "HIGH", "MEDIUM", "LOW"]


def test_names(spark):
    d = spark.createDataFrame([("AuthEngine", "@acme/auth-ui", "My.Proj")], "a string, b string, c string")
    assert d.select(X.snake_case(F.col("a")), X.npm_id(F.col("b")), X.csproj_id(F.col("c")), X.title_case(F.lit("auth_engine")), X.npm_id(F.lit(" react-router "))).first()[:] == ("auth_engine", "acme__auth_ui", "my_proj", "Auth Engine", "react_router")


def test_documents_and_retrieval(seed):
    docs = documents.prepare_documents(seed.components)
    assert {r.doc_type: r.n_docs for r in documents.document_stats(docs).collect()} == {"description": 12, "module_usage": 57, "api_surface": 12, "summary": 12, None: 93}
    embed = retrieve.hashed_words(512)
    vectors = retrieve.embed_documents(docs, embed).cache()
    near = retrieve.knn_text(vectors, "uses module event_bus coupling", embed, 5, id_col="doc_id")
    assert "event_bus" in near.first().text and near.first().similarity > 0.3
    rep = analysis.report(analysis.analyze(seed, ["auth_engine"], vectors, embed, ask=lambda p: "because", threshold=0.1), 8)
    assert rep["summary"]["direct"] == 6 and rep["llm_used"] and rep["variants"][0]["explanation"] == "because"
    assert "| encryption_service | " in analysis.markdown(rep)
    assert retrieve.upsert(vectors, vectors.limit(3)).count() == 93
    with pytest.raises(ValueError):
        retrieve.knn(vectors, None, 3)


def test_gaps_and_session(spark, seed):
    found = gaps.in_order(gaps.detect(seed)).collect()
    assert [(r.gap_type, r.entity_id) for r in found] == [("coupling_ambiguity", c) for c in ("audit_logger", "encryption_service", "workflow_engine")]
    assert gaps.completeness(gaps.detect(seed)).first()[0] == 0.0
    g = make(spark, {"lone": ("high", ""), "b": ("high", "only t")}, {"v": ["b"]})
    kinds = [(r.gap_type, r.entity_id) for r in gaps.in_order(gaps.detect(g)).collect()]
    assert kinds == [("orphan_component", "lone"), ("isolated_module", "only"), ("no_variant_assignment", "lone")]
    s = session.start(g)
    s = session.answer(s, [session.Answer(0, '["only", "new_bus"]')])
    assert ("lone", "only") in {(r.component_id, r.module_id) for r in s.graph.edges.collect()} and s.iteration == 1
    with pytest.raises(IndexError):
        session.answer(s, [session.Answer(-1, "x")])
    assert session.names_in("a, b") == ["a", "b"] and session.names_in("- foo\n- bar") == ["foo", "bar"]
    assert session.suggest([type("G", (), {"question": "q"})()] * 3, lambda p: '["x", "y", "z"]' if "1." in p else "one", 3) == ["x", "y", "z"]


def test_gaps_work_out_edges_once(spark):
    from tremor.sources.shared import written

    g = make(spark, {"lone": ("high", ""), "b": ("high", "only t, both t"), "c": ("low", "both l")}, {"v": ["b"]})
    g = graph.GraphTables(written(g.components, "c"), g.edges, written(g.variants, "v"), g.variant_components)
    found = gaps.detect(g)
    # the places of an edge are windows; no rule computes them again
    assert "Window" not in found._jdf.queryExecution().executedPlan().toString()
    assert {(r.gap_type, r.entity_id) for r in found.collect()} == {("orphan_component", "lone"), ("isolated_module", "only"), ("coupling_ambiguity", "b"), ("no_variant_assignment", "lone"), ("no_variant_assignment", "c")}


def test_validation(seed):
    cases = validation.generate(seed, direct=2, indirect=1, cycles=1)
    assert validation.run(seed, cases) == [] and validation.problems(seed) == []
    assert "parametrize" in validation.to_pytest(cases)


def test_service(seed):
    s = analysis.Service(seed, embed=retrieve.hashed_words())
    assert s.summary()["component_count"] == 12 and s.component("auth_engine")["criticality"] == "critical"
    assert len(s.analyze(["auth_engine"])["impacts"]) == 11
    for call, error in ((lambda: s.component("x"), analysis.NotFound), (lambda: s.analyze(["x"]), analysis.BadRequest), (lambda: s.analyze(["auth_engine"], 21), analysis.BadRequest), (s.questions, analysis.NotFound)):
        with pytest.raises(error):
            call()
