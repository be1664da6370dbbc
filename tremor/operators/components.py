"""Connected components of an edge list, by contraction.

In a round every node points to the least of its neighbours if that is less than itself, pointers are followed to their roots, and
the edges become edges between roots, each of them once. Two rounds leave half of the nodes at most, and mostly far fewer, so all rounds
together cost little more than the first ones. Minima are partial aggregates; a node or root that many rows look up is one key of
a sort-merge join, which Spark splits where it is skewed, so no task ever holds the neighbours of a node. Every pass is a written
table in the shared folder: lineage is cut, and a lost executor costs one stage. What a pass has changed is observed while it
is written, and the pass before is deleted.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from tremor.sources.shared import delete, written


def _drop(table: DataFrame) -> None:
    for path in {f.rsplit("/", 1)[0] for f in table.inputFiles()}:
        delete(table.sparkSession, path)


def _counted(rows: DataFrame, what) -> tuple[DataFrame, int]:
    """``rows`` as a table, and how many of them meet the condition."""
    seen = Observation()
    table = written(rows.observe(seen, F.count(F.when(what, 1)).alias("n")), "components")
    return table, seen.get["n"]


def _look_up(rows: DataFrame, by: str, roots: DataFrame) -> DataFrame:
    """``rows`` with the root of ``by`` in its place; a node without a pointer is its own root."""
    rest = [c for c in rows.columns if c != by]
    return rows.join(roots.select(F.col("node").alias(by), F.col("root").alias("_r")), by, "left").select(*rest, F.coalesce("_r", by).alias(by))


def _flat(forest: DataFrame) -> DataFrame:
    """(node, root) of pointers (node, root), where roots have no row: each pass halves the way that is left."""
    table = written(forest, "components")
    while True:
        up = table.select(F.col("node").alias("root"), F.col("root").alias("above"))
        after, moved = _counted(table.join(up, "root", "left").select("node", F.coalesce("above", "root").alias("root"), F.col("above").isNotNull().alias("moved")), F.col("moved"))
        _drop(table)
        table = after.select("node", "root")
        if not moved:
            return table


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, component) for every node of ``edges`` (u, v: of one orderable type); component is the least node reachable.

    Self-loops make their node known. Null ends are ignored; an empty list gives no rows.
    """
    edges = edges.select("u", "v").filter("u is not null and v is not null")
    kind = edges.schema["u"].dataType
    every, n = _counted(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), F.col("u") != F.col("v"))
    left, forests = every.filter("u <> v"), []
    while n:
        # Ends are ordered, so a node without a lesser neighbour is never a first end: it is a root of this round.
        forests.append(_flat(left.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("root"))))
        met = _look_up(_look_up(left, "u", forests[-1]), "v", forests[-1]).filter("u <> v")
        old = left
        left, n = _counted(met.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), F.lit(True))
        if len(forests) > 1:
            _drop(old)
    loops = every.filter("u = v").select(F.col("u").alias("node"))
    if not forests:
        return loops.select("node", F.col("node").cast(kind).alias("component"))
    # A root of one round may have a root in a later one; those are fewer, so they are put together from the end.
    whole = forests[-1]
    for forest in reversed(forests[:-1]):
        whole = written(_look_up(forest, "root", whole).unionByName(whole), "components")
    found = whole.unionByName(whole.select(F.col("root").alias("node"), "root").distinct())
    if not loops.isEmpty():
        found = found.unionByName(loops.join(found, "node", "left_anti").select("node", F.col("node").alias("root")))
    return found.select("node", F.col("root").cast(kind).alias("component"))
