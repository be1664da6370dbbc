"""The refinement loop over gaps: questions, answers, edits of the graph, new detection."""

from __future__ import annotations

import json
import re
from collections.abc import Callable
from dataclasses import dataclass, field, replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tremor.operators import gaps as G
from tremor.operators.graph import GraphTables
from tremor.sources.shared import written

COUPLINGS = ("tight", "loose", "optional")
CRITICALITIES = ("critical", "high", "medium", "low")


@dataclass(frozen=True)
class Answer:
    gap_index: int
    answer: str = ""
    accept_suggestion: bool = False


@dataclass
class Session:
    """``pending``: the questions on hand (a top-k, so few rows), by which answers are numbered."""

    graph: GraphTables
    gaps: DataFrame
    pending: list
    iteration: int = 0
    answered: list[Answer] = field(default_factory=list)
    complete: bool = False


def names_in(text: str) -> list[str]:
    """Names in a free answer: a JSON list, else a comma list, else bullets, else the text cut to 50 characters."""
    text = strip_fence(text)
    try:
        got = json.loads(text)
        if isinstance(got, list):
            return [str(x).strip() for x in got if str(x).strip()]
    except ValueError:
        pass
    if "," in text:
        return [p.strip() for p in text.split(",") if p.strip()]
    if bullets := re.findall(r"(?m)^\s*[-*•]\s*([A-Za-z_][\w.-]*)", text):
        return bullets
    return [text.strip()[:50]] if text.strip() else []


def strip_fence(text: str) -> str:
    return re.sub(r"\A\s*```[a-z]*\n?|\n?```\s*\Z", "", text).strip()


def keyword_near(text: str, name: str, words: tuple[str, ...], reach: int = 30) -> str | None:
    """The first of ``words`` within ``reach`` characters of a name."""
    text = text.lower()
    at = text.find(name.lower())
    if at < 0:
        return None
    near = text[max(0, at - reach) : at + len(name) + reach]
    return next((w for w in words if w in near), None)


def suggest(gaps: list, ask: Callable[[str], str], batch: int = 10) -> list[str]:
    """A suggestion for each gap, ``batch`` to a call; where a reply is no list of the right length, one call each."""
    out: list[str] = []
    for lo in range(0, len(gaps), batch):
        part = gaps[lo : lo + batch]
        prompt = "Answer each question; reply with a JSON list of strings.\n" + "\n".join(f"{i + 1}. {g.question}" for i, g in enumerate(part))
        try:
            got = json.loads(strip_fence(ask(prompt)))
        except ValueError:
            got = None
        if not (isinstance(got, list) and len(got) == len(part)):
            got = [ask(g.question) for g in part]
        out += [str(x) for x in got]
    return out


def start(g: GraphTables, parsed: DataFrame | None = None, ask: Callable[[str], str] | None = None, most: int = 10, auto_resolve: bool = True) -> Session:
    found = written(G.detect(g, parsed), "gaps")
    if ask is not None:
        rows = G.questions(found, most).collect()
        told = found.sparkSession.createDataFrame(
            [(r.gap_type, r.entity_id, s) for r, s in zip(rows, suggest(rows, ask), strict=True)], "gap_type string, entity_id string, _s string"
        )
        found = found.join(F.broadcast(told), ["gap_type", "entity_id"], "left").withColumn("suggestion", F.coalesce("_s", "suggestion")).select(*G.COLUMNS)
    if auto_resolve:
        found = G.auto_resolve(found)
    found = written(found, "gaps")
    pending = G.questions(found, most).collect()
    return Session(g, found, pending, complete=not pending)


def _edit(g: GraphTables, gap, text: str) -> GraphTables:
    """The graph after an answer to a gap. Edges are the truth: exports and documents read them too."""
    spark = g.edges.sparkSession
    add = lambda rows: g.edges.unionByName(
        spark.createDataFrame(rows, "component_id string, module_id string, coupling string, usage string")
        .join(g.edges.select("component_id", "module_id"), ["component_id", "module_id"], "left_anti")
        .withColumn("mod_ord", F.lit(1 << 20) + F.monotonically_increasing_id().cast("int"))
        .withColumn("comp_ord", F.lit(1 << 20) + F.monotonically_increasing_id().cast("int"))
    )
    match gap.gap_type:
        case "orphan_component":
            if names := names_in(text):
                return replace(g, edges=add([(gap.entity_id, n, "tight", "") for n in names]))
        case "isolated_module":
            known = [r.id for r in g.components.filter(F.col("id").isin(names_in(text))).select("id").collect()] if names_in(text) else []
            if known:
                return replace(g, edges=add([(c, gap.entity_id, "loose", "") for c in known]))
        case "missing_description" | "low_confidence":
            hit = F.col("id") == gap.entity_id
            return replace(g, components=g.components.withColumn("description", F.when(hit, F.lit(text.strip())).otherwise(F.col("description"))))
        case "coupling_ambiguity":
            mine = [r.module_id for r in g.edges.filter(F.col("component_id") == gap.entity_id).select("module_id").collect()]
            told = {m: c for m in mine if (c := keyword_near(text, m, COUPLINGS))}
            out = F.col("coupling")
            for m, c in told.items():
                out = F.when((F.col("component_id") == gap.entity_id) & (F.col("module_id") == m), F.lit(c)).otherwise(out)
            return replace(g, edges=g.edges.withColumn("coupling", out))
        case "missing_criticality":
            word = next((w for w in CRITICALITIES if w in text.lower()), None)
            if word:
                hit = F.col("id") == gap.entity_id
                return replace(g, components=g.components.withColumn("criticality", F.when(hit, F.lit(word)).otherwise(F.col("criticality"))))
    return g


def answer(s: Session, answers: list[Answer], parsed: DataFrame | None = None, threshold: float = 0.8, most: int = 10, carry: str = "entity") -> Session:
    """Applies answers, detects again, and keeps what was resolved. Complete when nothing is open or enough is resolved."""
    g, done = s.graph, []
    for a in answers:
        if not 0 <= a.gap_index < len(s.pending):
            raise IndexError(f"gap_index {a.gap_index}")
        gap = s.pending[a.gap_index]
        text = gap.suggestion if a.accept_suggestion and gap.suggestion else a.answer
        g = _edit(g, gap, text)
        done.append((gap.entity_id, gap.gap_type, text))
    g = replace(g, components=written(g.components, "components"), edges=written(g.edges, "edges"))
    told = s.gaps.sparkSession.createDataFrame(done, "entity_id string, gap_type string, _t string")
    before = s.gaps.join(F.broadcast(told), ["entity_id", "gap_type"], "left")
    before = before.withColumn("resolved", F.col("resolved") | F.col("_t").isNotNull()).withColumn("resolution", F.coalesce("_t", "resolution")).select(*G.COLUMNS)
    found = written(G.carry_over(before, G.detect(g, parsed), carry), "gaps")
    pending = G.questions(found, most).collect()
    enough = G.completeness(found).first()[0] >= threshold
    return Session(g, found, pending, s.iteration + 1, [*s.answered, *answers], enough or not pending)
