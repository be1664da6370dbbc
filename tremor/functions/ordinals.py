"""Ordinal domains and the scores that depend on them."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed values.
COUPLING = {"tight": 3, "loose": 2, "optional": 1}
CRITICALITY = {"critical": 4, "high": 3, "medium": 2, "low": 1}
SEVERITY = {"critical": 0, "high": 1, "medium": 2, "low": 3}
COUPLING_WEIGHT = {"tight": 1.0, "loose": 0.5, "optional": 0.2}
CRITICALITY_FACTOR = {"critical": 4.0, "high": 2.0, "medium": 1.0, "low": 0.5}
BOOST = 1.25
RISK_LEVELS = ((7.0, "CRITICAL"), (4.0, "HIGH"), (2.0, "MEDIUM"))


def lookup(values: dict, key: Column, default) -> Column:
    """A chain of conditions rather than a map: it folds into generated code."""
    return reduce(lambda out, kv: F.when(key == kv[0], F.lit(kv[1])).otherwise(out), values.items(), F.lit(default))


def coupling_rank(c: Column) -> Column:
    return lookup(COUPLING, F.coalesce(c, F.lit("")), 0)


def criticality_rank(c: Column) -> Column:
    return lookup(CRITICALITY, F.coalesce(c, F.lit("")), 0)


def coupling_name(rank: Column) -> Column:
    return lookup({v: k for k, v in COUPLING.items()}, rank, "optional")


def criticality_name(rank: Column, default: str = "low") -> Column:
    return lookup({v: k for k, v in CRITICALITY.items()}, rank, default)


def weaker_coupling(a: Column, b: Column) -> Column:
    """Ties keep the left one."""
    return F.when(coupling_rank(b) < coupling_rank(a), b).otherwise(a)


def higher_criticality(a: Column, b: Column) -> Column:
    """Ties keep the left one."""
    return F.when(criticality_rank(b) > criticality_rank(a), b).otherwise(a)


def strongest_coupling(couplings: Column) -> Column:
    """Of an array; an empty one is optional, as are unknown names."""
    best = F.array_max(F.transform(couplings, lambda c: coupling_rank(c)))
    return coupling_name(F.coalesce(best, F.lit(1)))


def score(coupling: Column, criticality: Column, depth: Column) -> Column:
    """Weight by coupling, times factor by criticality, over the depth; unknown names count as optional and as 1."""
    return (
        lookup(COUPLING_WEIGHT, coupling, COUPLING_WEIGHT["optional"])
        * lookup(CRITICALITY_FACTOR, criticality, 1.0)
        / F.greatest(depth, F.lit(1)).cast("double")
    )


def round2(c: Column) -> Column:
    """Two decimals as half-even rounding of the binary value gives them.

    A decimal with many digits shows on which side of a tie the binary value lies; ``bround`` of the double alone does not.
    """
    return F.bround(c.cast("decimal(38,20)"), 2).cast("double")


def risk_level(risk: Column) -> Column:
    return reduce(lambda out, lv: F.when(risk >= lv[0], F.lit(lv[1])).otherwise(out), reversed(RISK_LEVELS), F.lit("LOW"))
