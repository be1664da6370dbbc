"""Scalar helpers on names and texts, as expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


#: Where a name in mixed case is cut, in this order.
CUTS = (r"(.)([A-Z][a-z]+)", r"([a-z0-9])([A-Z])")


def snake_case(c: Column) -> Column:
    for cut in CUTS:
        c = F.regexp_replace(c, cut, "$1_$2")
    return F.lower(c)


def title_case(c: Column) -> Column:
    return F.initcap(F.replace(c, F.lit("_"), F.lit(" ")))


def slug(c: Column) -> Column:
    """Lower-case letters and digits, all else one underscore, none at the ends."""
    return F.lower(F.btrim(F.regexp_replace(c, r"[^A-Za-z0-9]+", "_"), F.lit("_")))


def _or(c: Column, default: str) -> Column:
    return F.when(c == "", F.lit(default)).otherwise(c)


def npm_id(c: Column) -> Column:
    """Names with a scope keep it before a double underscore."""
    c = F.btrim(c)
    scope, name = slug(F.regexp_extract(c, r"^@([^/]*)/", 1)), slug(F.regexp_extract(c, r"(?s)^@[^/]*/(.*)$", 1))
    scoped = F.when((scope != "") & (name != ""), F.concat(scope, F.lit("__"), name)).otherwise(_or(F.concat(scope, name), "package"))
    return F.when(c.startswith("@") & c.contains("/"), scoped).otherwise(_or(slug(c), "package"))


def csproj_id(c: Column) -> Column:
    return _or(slug(c), "project")


def is_internal_npm_dep(version: Column) -> Column:
    return version.rlike(r"^(workspace:|file:|link:|\.{1,2}/)")


def approx_tokens(n_chars: Column, chars_per_token: int = 4) -> Column:
    """At least one for any text that has a character."""
    return F.when(n_chars <= 0, F.lit(0)).otherwise(F.greatest(F.lit(1), F.floor(n_chars / chars_per_token))).cast("long")


def cache_key(model: Column, text: Column) -> Column:
    return F.sha2(F.concat(model, F.char(F.lit(0)), text), 256)
