"""The whole analysis of a change, its report, and the service calls over it."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tremor.operators import gaps, graph, redact, retrieve, score, traverse
from tremor.operators.graph import GraphTables
from tremor.sources.shared import written


@dataclass(frozen=True)
class Analysis:
    changed: DataFrame
    impacts: DataFrame
    scored: DataFrame
    risks: DataFrame
    explanations: dict[str, str]
    llm_used: bool


#: What an explanation is asked with.
EXPLAIN = {
    "system": "You assess the risk of software changes. Use only the evidence given, name the paths you rely on, and say so where evidence is thin.",
    "temperature": 0.2,
    "max_tokens": 512,
}
_MATCHES = "component_id string, best_score double, criticality string"


def semantic_matches(g: GraphTables, vectors: DataFrame, ids: list[str], embed: Callable, k: int = 10, threshold: float = 0.7, top: int = 5) -> DataFrame:
    """Best match of every component over the descriptions of the changed ones; their own documents use up places.

    One scan of the store for all of them: the queries are a batch.
    """
    spark = g.components.sparkSession
    told = {r.id: r.description for r in g.components.filter(F.col("id").isin(ids)).select("id", "description").collect()}
    asked = [(i, c) for i, c in enumerate(ids) if c in told]
    if not asked:
        return spark.createDataFrame([], _MATCHES)
    rows = [(i, c, [float(x) for x in v]) for (i, c), v in zip(asked, embed([told[c] for _, c in asked]), strict=True)]
    queries = spark.createDataFrame(rows, "query_id long, query_component string, embedding array<double>")
    near = retrieve.batch_knn(vectors, queries, k, id_col="doc_id").withColumnRenamed("vec_id", "doc_id")
    near = near.join(vectors.drop("embedding"), "doc_id").join(queries.drop("embedding"), "query_id").withColumn("similarity", 1 - F.col("distance"))
    kept = retrieve.after_threshold(near, threshold).filter(~F.col("component_id").eqNullSafe(F.col("query_component")))
    found = retrieve.by_entity(kept, id_col="doc_id", extra=("component_name", "criticality"), per=("query_id",))
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("best_score"), "component_id"))
    found = found.withColumn("_n", place).filter(F.col("_n") <= top).drop("_n").withColumnRenamed("query_id", "query_ord")
    return retrieve.best_per_component(found.filter(~F.col("component_id").isin(ids)))


def analyze(g: GraphTables, ids: list[str], vectors: DataFrame | None = None, embed: Callable | None = None, ask: Callable[..., str] | None = None, max_depth: int = 5, weak: bool = True, options: dict | None = None, **retrieval) -> Analysis:
    """Traversal, retrieval, merge, risk and, on demand, an explanation for each affected variant; a failing ``ask`` only costs that.

    ``ask`` gets the prompt and ``options`` (such as ``EXPLAIN``) by name.
    """
    impacts, variants, changed = traverse.impact_of(g, ids, max_depth, weak)
    semantic = semantic_matches(g, vectors, ids, embed, **retrieval) if vectors is not None else g.components.sparkSession.createDataFrame([], _MATCHES)
    semantic = written(semantic, "semantic")
    scored = written(score.scored_impacts(impacts, semantic), "scored")
    risks = score.variant_risks(g.variant_components, changed, scored, g.components)
    said, used = {}, False
    if ask is not None:
        try:
            hit = {r.variant_id: set(r.affected_components) for r in variants.collect()}
            facts = {r.id: r for r in g.variants.filter(F.col("id").isin(list(hit))).select("id", "name", "tier", "region").collect()}
            for r in risks.orderBy(F.desc("risk_score"), "variant_id").collect():
                said[r.variant_id] = ask(prompt(ids, impacts, semantic, hit.get(r.variant_id), facts.get(r.variant_id), r.risk_level), **(options or {}))
            used = True
        except Exception:  # noqa: BLE001  an explanation is an extra; the caller's service may raise anything
            said, used = {}, False
    return Analysis(changed, impacts, scored, risks, said, used)


def prompt(ids: list[str], impacts: DataFrame, semantic: DataFrame, affected: set[str] | None = None, variant=None, level: str | None = None, lines: int = 30) -> str:
    """Evidence in sections, bounded: ``lines`` impacts with path and shared modules, and three matches with the start of their text.

    With ``affected``, only what concerns these components.
    """
    mine = lambda df: df if affected is None else df.filter(F.col("component_id").isin(sorted(affected)))
    out = ["## Change", f"Changed: {', '.join(ids)}"]
    if variant is not None:
        out.append(f"Variant: {variant.name} ({variant.tier or '-'}, {variant.region or '-'})")
    out += ["", "## Paths in the dependency graph"]
    for r in traverse.in_order(mine(impacts)).limit(lines).collect():
        out.append(f"- {r.component_id} ({r.criticality}): {' → '.join(r.chain)} [{r.min_coupling}]")
        if r.shared_modules:
            out.append(f"  shares {', '.join(r.shared_modules)}")
    near = mine(semantic).orderBy(F.desc("best_score"), "component_id").limit(3).collect()
    if near:
        out += ["", "## Similar descriptions"]
    for r in near:
        text = r.docs[0].text if "docs" in semantic.columns and r.docs else None
        out.append(f"~ {r.component_id} ({r.best_score:.2f})" + (f": {text[:120]}" if text else ""))
    if variant is not None:
        out += ["", "## Task", f"Explain the risk for {variant.name}" + (f" (level {level})" if level else "") + ", what is affected only indirectly, and what would lower it."]
    return "\n".join(out)


def report(a: Analysis, n_variants: int) -> dict:
    """Plain values: summary, direct and indirect impacts by falling score, variants by falling risk."""
    paths = a.impacts.select("component_id", score.short_path(F.col("chain")).alias("path"), "ord")
    rows = a.scored.join(paths, "component_id", "left").orderBy(F.desc("score"), "depth", "ord", "component_id").collect()
    show = lambda r: {"component_id": r.component_id, "score": r.score, "depth": r.depth, "coupling": r.coupling, "criticality": r.criticality, "path": r.path}
    summary = score.report_summary(a.changed, a.scored, a.risks, n_variants).first().asDict()
    risks = [r.asDict() | {"explanation": a.explanations.get(r.variant_id)} for r in a.risks.orderBy(F.desc("risk_score"), "variant_id").collect()]
    return {"summary": summary, "direct": [show(r) for r in rows if r.is_direct], "indirect": [show(r) for r in rows if not r.is_direct], "variants": risks, "llm_used": a.llm_used}


def markdown(rep: dict) -> str:
    out = ["# Change impact", "", *(f"- {k}: {v}" for k, v in rep["summary"].items())]
    for title in ("direct", "indirect"):
        out += ["", f"## {title.capitalize()} impacts", "", "| component | score | depth | coupling | criticality | path |", "|-|-|-|-|-|-|"]
        out += [f"| {r['component_id']} | {r['score']:.2f} | {r['depth']} | {r['coupling']} | {r['criticality']} | {r['path'] or ''} |" for r in rep[title]]
    out += ["", "## Variants", "", "| variant | risk | level | direct | indirect |", "|-|-|-|-|-|"]
    out += [f"| {r['variant_id']} | {r['risk_score']:.2f} | {r['risk_level']} | {r['direct_count']} | {r['indirect_count']} |" for r in rep["variants"]]
    return "\n".join(out) + "\n"


def terminal(rep: dict, changed: list[str] = (), width: int = 60) -> str:
    """The report as plain text for a console."""
    rule = "=" * width
    out = [rule, "Change impact".center(width).rstrip(), rule, f"Changed: {', '.join(changed)}"]
    for title in ("direct", "indirect"):
        out += ["", f"{title.capitalize()} impacts", "-" * width]
        for r in rep[title]:
            out += [f"  {r['component_id']}  {r['score']:.2f}  {r['coupling']}, {r['criticality']}, depth {r['depth']}", *([f"    {r['path']}"] if r["path"] else [])]
        out += [] if rep[title] else ["  none"]
    out += ["", "Variants", "-" * width]
    for r in rep["variants"]:
        out += [f"  {r['variant_id']}  {r['risk_level']} ({r['risk_score']:.2f}), {r['direct_count']} direct, {r['indirect_count']} indirect", *([f"    {r['explanation']}"] if r.get("explanation") else [])]
    out += [] if rep["variants"] else ["  none"]
    return "\n".join([*out, "", "Summary", "-" * width, *(f"  {k}: {v}" for k, v in rep["summary"].items())]) + "\n"


def listing(g: GraphTables, modules: bool = False, variants: bool = False, connectivity: bool = False) -> str:
    """What a person asks about a graph at a prompt: counts and, on demand, shared modules, variants with members, and connectivity."""
    out = [f"{k}: {v}" for k, v in graph.graph_summary(g.components, g.edges, g.variants).first().asDict().items()]
    if modules:
        out += ["", "shared modules", *(f"  {r.module_id}: {', '.join(r.components)}" for r in graph.shared_module_lists(graph.bipartite(g)).orderBy("module_id").collect())]
    if variants:
        out += ["", "variants"]
        members = {r.variant_id: [x.component_id for x in r.m] for r in g.variant_components.groupBy("variant_id").agg(F.sort_array(F.collect_list(F.struct("ord", "component_id"))).alias("m")).collect()}
        for v in g.variants.orderBy("load_ord").collect():
            out += [f"  {v.name} ({v.id}): {len(members.get(v.id, []))} components", *(f"    {c}" for c in members.get(v.id, []))]
    if connectivity:
        parts = graph.connectivity(g.edges).groupBy("component").agg(F.count("*").alias("n"), F.array_sort(F.collect_set("node")).alias("nodes")).orderBy(F.desc("n"), "component").collect()
        out += ["", "connected" if len(parts) <= 1 else f"{len(parts)} parts", *([] if len(parts) <= 1 else (f"  {', '.join(p.nodes)}" for p in parts))]
    return "\n".join(out) + "\n"


class NotFound(LookupError):
    status = 404


class BadRequest(ValueError):
    status = 400


class Service:
    """The calls of a web surface as plain methods; a web framework only has to route to them."""

    def __init__(self, g: GraphTables | None = None, vectors: DataFrame | None = None, embed: Callable | None = None, ask: Callable | None = None, guard=None, cache=None):
        self.graph, self.vectors, self.embed, self.ask, self.session, self.guard, self.cache = g, vectors, embed, ask, None, guard, cache
        self.parsed: DataFrame | None = None

    @property
    def g(self) -> GraphTables:
        if self.graph is None:
            raise NotFound("no graph is loaded")
        return self.graph

    @g.setter
    def g(self, graph: GraphTables) -> None:
        self.graph = graph

    def health(self) -> dict:
        return {"status": "ok"}

    def components(self) -> list[dict]:
        return [r.asDict(True) for r in self.g.components.orderBy("load_ord").collect()]

    def _one(self, df: DataFrame, key: str) -> dict:
        row = df.filter(F.col("id") == key).first()
        if row is None:
            raise NotFound(key)
        return row.asDict(True)

    def component(self, key: str) -> dict:
        mods = [r.asDict() for r in graph.component_modules(self.g, key).collect()]
        return self._one(self.g.components, key) | {"modules": mods, "variants": [r[0] for r in graph.component_variants(self.g, key).collect()]}

    def variants(self) -> list[dict]:
        return [r.asDict(True) for r in self.g.variants.orderBy("load_ord").collect()]

    def variant(self, key: str) -> dict:
        return self._one(self.g.variants, key)

    def summary(self) -> dict:
        return graph.graph_summary(self.g.components, self.g.edges, self.g.variants).first().asDict()

    def analyze(self, ids: list[str], max_depth: int = 5, weak: bool = True) -> dict:
        """Traversal and raw matches by changed component, without scores."""
        if not ids or not 1 <= max_depth <= 20:
            raise BadRequest("at least one id, and a depth from 1 to 20")
        known = {r[0] for r in self.g.components.filter(F.col("id").isin(ids)).select("id").collect()}
        if missing := [i for i in ids if i not in known]:
            raise BadRequest(f"unknown: {', '.join(missing)}")
        impacts, variants, changed = traverse.impact_of(self.g, ids, max_depth, weak)
        matches = [] if self.vectors is None else [r.asDict(True) for r in semantic_matches(self.g, self.vectors, ids, self.embed).collect()]
        return {"summary": traverse.result_summary(changed, impacts, variants).first().asDict(), "impacts": [r.asDict(True) for r in traverse.in_order(impacts).collect()], "variants": [r.asDict(True) for r in variants.orderBy("variant_id").collect()], "semantic": matches}

    def rebuild_vectors(self) -> int:
        from tremor.plans.compilation import embed_and_store

        if self.embed is None:
            raise BadRequest("no embedding function")
        rows, n = embed_and_store(self.g, self.embed)
        self.vectors = written(rows, "vectors")
        return n

    def ingest(self, root: str, detection: str = "auto", granularity: str = "manifest", embed: bool = False) -> dict:
        """Reads a source tree; its graph is the current one from now on."""
        from tremor.operators import ingest
        from tremor.plans import ingestion

        try:
            got = ingestion.ingest_tree(self._spark(), root, detection, granularity)
        except (ValueError, Py4JJavaError) as e:
            raise BadRequest(str(e).splitlines()[0]) from e
        self.graph, self.session, self.parsed = got.graph, None, ingestion.as_parsed(got)
        by_language = [r.asDict() for r in ingest.summary(got.components).orderBy("language").collect()]
        return {"summary": self.summary(), "languages": by_language, "warnings": [r[0] for r in got.warnings.orderBy("warning").collect()], "documents_embedded": self.rebuild_vectors() if embed else 0}

    def ingest_yaml(self, components: str, variants: str, embed: bool = False) -> dict:
        from tremor.plans import ingestion

        self.graph, self.session, self.parsed = ingestion.ingest_yaml(self._spark(), components, variants), None, None
        return {"summary": self.summary(), "documents_embedded": self.rebuild_vectors() if embed else 0}

    def estimate(self, root: str, embeddings: bool = True, suggestions: bool = True) -> dict:
        """What an ingestion of ``root`` would cost; nothing is sent, and what the cache holds is free."""
        from tremor.operators import cost
        from tremor.operators.documents import prepare_documents
        from tremor.plans import ingestion

        got = ingestion.ingest_tree(self._spark(), root)
        found = gaps.detect(got.graph, ingestion.as_parsed(got))
        known = {"cache": self.cache.entries} if self.cache is not None and self.cache.enabled else {}
        return cost.estimate(prepare_documents(got.graph.components), found.count(), got.graph.components.count(), embeddings, suggestions, **known)

    def _spark(self):
        return SparkSession.getActiveSession() if self.graph is None else self.graph.components.sparkSession

    def compile(self, root: str, config: str | None = None, embed: bool = False, backup: bool = True) -> dict:
        from tremor.plans.compilation import compile_graph

        if embed and self.embed is None:
            raise BadRequest("no embedding function")
        found = None if self.session is None else self.session.gaps
        return compile_graph(self.g, root, config, self.embed if embed else None, f"{root}/data/vectors" if embed else None, found, backup).summary()

    def generate_tests(self, path: str) -> dict:
        """Writes a test module of the graph as it is; returns how many cases it has, by category."""
        from tremor.plans import validation

        cases = validation.generate(self.g)
        by = {c.category: sum(x.category == c.category for x in cases) for c in cases}
        return {"tests_generated": len(cases), "test_file": validation.write_pytest(self.g.components.sparkSession, cases, path), "summary": by}

    def status(self) -> dict:
        out = {"graph_loaded": self.graph is not None, "vectors_loaded": self.vectors is not None, "llm_available": self.ask is not None, "session_active": self.session is not None}
        if self.graph is not None:
            out["graph"] = self.summary()
        if self.session is not None:
            out["session"] = {"iteration": self.session.iteration, "complete": self.session.complete, "open": len(self.session.pending)}
        if self.guard is not None:
            out["privacy"] = self.guard.status()
        return out

    def privacy(self) -> dict:
        """Settings of the guard, and its log: hashes of texts are not needed there, lengths and categories are."""
        if self.guard is None:
            return {"enabled": False, "log": []}
        p = self.guard.privacy
        limits = {"max_prompt": p.max_prompt, "max_embedding": p.max_embedding, "max_batch": p.max_batch, "blocked_patterns": len(p.blocked)}
        return {"enabled": True, **limits, **self.guard.status(), "log": [r.asDict() for r in self.guard.audit().collect()]}

    def detect_gaps(self) -> list[dict]:
        return [r.asDict() for r in gaps.in_order(gaps.detect(self.g, self.parsed)).collect()]

    def start_session(self) -> dict:
        from tremor.operators import session

        self.session = session.start(self.g, self.parsed, ask=self.ask)
        return self.questions()

    def questions(self) -> dict:
        if self.session is None:
            raise NotFound("no session")
        return {"iteration": self.session.iteration, "complete": self.session.complete, "questions": [r.asDict() for r in self.session.pending]}

    def answer(self, answers: list[dict]) -> dict:
        from tremor.operators import session

        if self.session is None:
            raise NotFound("no session")
        self.session = session.answer(self.session, [session.Answer(**a) for a in answers], self.parsed)
        self.g = self.session.graph
        return self.questions()

    def audit(self, texts: DataFrame) -> dict:
        return redact.audit_summary(redact.audit(texts, "embed", "store")).first().asDict(True)
