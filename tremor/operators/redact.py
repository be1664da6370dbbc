"""Redaction, classification and audit of texts, all as expressions: no row leaves generated code or the JVM.

A pattern is applied by cutting the text at its matches and stringing the gaps and the placeholders together. Patterns run
in order, each on what the one before has left.
"""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Category and pattern, in the order in which they apply.
SECRETS = [
    ("api_key", r"(?:AKIA|ASIA)[A-Z0-9]{16}"),
    ("secret_token", r"(?iu)aws[_\-]?secret[_\-]?access[_\-]?key(?U)\s*[=:]\s*\S+"),
    ("private_key", r'(?s)"private_key"(?U)\s*:\s*(?-U)"-----BEGIN [A-Z ]+ KEY-----[^"]*"'),
    ("api_key", r"(?:AccountKey|SharedAccessKey)\s*=\s*[A-Za-z0-9+/=]{20,}"),
    ("secret_token", r"gh[ps]_[A-Za-z0-9_]{36,}"),
    ("secret_token", r"github_pat_[A-Za-z0-9_]{22,}"),
    ("secret_token", r"Bearer\s+[A-Za-z0-9\-._~+/]+=*"),
    ("api_key", r"(?iu)(?:api[_\-]?key|apikey|access[_\-]?token|auth[_\-]?token|secret[_\-]?key)(?U)\s*[=:]\s*(?-U)['\"]?[A-Za-z0-9\-._~+/]{16,}['\"]?"),
    ("api_key", r"sk-[A-Za-z0-9]{20,}"),
    ("secret_token", r"xox[bpoas]-[A-Za-z0-9\-]{10,}"),
    ("jwt_token", r"eyJ[A-Za-z0-9_-]{10,}\.eyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}"),
    ("private_key", r"-----BEGIN (?:RSA |EC |DSA |OPENSSH )?PRIVATE KEY-----[\s\S]*?-----END (?:RSA |EC |DSA |OPENSSH )?PRIVATE KEY-----"),
    ("password", r"(?iuU)(?:password|passwd|pwd|secret)\s*[=:]\s*['\"]?[^\s'\"]{8,}['\"]?"),
    ("connection_string", r"(?iuU)(?:mongodb|postgres|mysql|redis|amqp|mssql)(?:ql)?://\S+"),
    ("env_variable", r"(?iuU)(?:export\s+)?(?:DATABASE_URL|REDIS_URL|SECRET_KEY|API_SECRET|PRIVATE_KEY)\s*=\s*\S+"),
]
PII = [
    ("pii_email", r"[a-zA-Z0-9._%+\-]+@[a-zA-Z0-9.\-]+\.[a-zA-Z]{2,}"),
    ("pii_phone", r"(?U)(?:\+\d{1,3}[\s\-]?)?\(?\d{3}\)?[\s.\-]?\d{3}[\s.\-]?\d{4}"),
    ("pii_ssn", r"(?U)\b\d{3}-\d{2}-\d{4}\b"),
    ("ip_address", r"(?U)\b(?:\d{1,3}\.){3}\d{1,3}\b"),
]
FILE_PATH = ("file_path", r"(?U)(?:/(?:home|Users|var|etc|opt|srv|usr|tmp)/[^\s:;,\"']+)|(?:[A-Z]:\\[^\s:;,\"']+)")
#: What a text must contain for a pattern to match at all, any of them: a search for a literal is far cheaper than one for a pattern.
#: Literals without a case, or in the case that the pattern asks for.
IMPLIED = {
    SECRETS[0][1]: ("AKIA", "ASIA"), SECRETS[1][1]: ("=", ":"), SECRETS[2][1]: ('"private_key"',), SECRETS[3][1]: ("AccountKey", "SharedAccessKey"),
    SECRETS[4][1]: ("ghp_", "ghs_"), SECRETS[5][1]: ("github_pat_",), SECRETS[6][1]: ("Bearer",), SECRETS[7][1]: ("=", ":"), SECRETS[8][1]: ("sk-",),
    SECRETS[9][1]: ("xox",), SECRETS[10][1]: ("eyJ",), SECRETS[11][1]: ("-----BEGIN",), SECRETS[12][1]: ("=", ":"), SECRETS[13][1]: ("://",), SECRETS[14][1]: ("=",),
    PII[0][1]: ("@",), PII[2][1]: ("-",), PII[3][1]: (".",), FILE_PATH[1]: ("/", ":\\"),
}
SOURCE_CODE = [
    r"(?mU)^\s*def \w+\(.*\):\s*$",
    r"(?mU)^\s*class \w+.*:\s*$",
    r"(?mU)^\s*(?:if|for|while|try|except|with) .*:\s*$",
    r"(?mU)^\s*(?:import |from \S+ import )",
    r"(?mU)^\s*(?:return |yield |raise |assert )",
]
CONFIDENTIAL = ["private_key", "password", "connection_string", "pii_ssn", "secret_token"]
INTERNAL = ["api_key", "jwt_token", "pii_email", "pii_phone"]
LEVELS = ("strict", "moderate", "minimal")


def patterns(level: str = "strict", allow_ips: bool = False, allow_paths: bool = False, custom: tuple[str, ...] = ()) -> list[tuple[str, str]]:
    """Secrets at every level, personal data but at minimal, paths at strict, custom patterns last."""
    if level not in LEVELS:
        raise ValueError(f"level {level!r}")
    out = list(SECRETS)
    if level != "minimal":
        out += [p for p in PII if not (allow_ips and p[0] == "ip_address")]
    if level == "strict" and not allow_paths:
        out.append(FILE_PATH)
    return out + [("secret_token", c) for c in custom]


_EVENTS = "array<struct<category:string,original_length:int,replacement:string>>"


def _has(text: Column, pattern: str) -> Column:
    out = text.rlike(pattern)
    if literals := IMPLIED.get(pattern):
        out = reduce(or_, [F.contains(text, F.lit(x)) for x in literals]) & out
    return out


def _placeholder(category: str):
    return lambda m: F.concat(F.lit(f"[REDACTED:{category}:"), F.substring(F.sha2(m, 256), 1, 8), F.lit("]"))


def _event(category: str):
    return lambda m: F.struct(F.lit(category).alias("category"), F.length(m).alias("original_length"), _placeholder(category)(m).alias("replacement"))


def _finding(category: str):
    return lambda m: F.struct(F.lit(category).alias("category"), F.concat(F.substring(m, 1, 20), F.lit("...")).alias("preview"))


def redact(df: DataFrame, text: str = "text", level: str = "strict", to: str = "sanitized", **gates) -> DataFrame:
    """Adds ``to``, redactions (category, original_length, replacement), redaction_count and categories (sorted)."""
    # The text runs through the patterns; each leaves its events in a column of its own, so that no expression refers to the
    # chain twice and the plan grows by one projection a pattern.
    out = df.withColumn(to, F.coalesce(F.col(text), F.lit("")))
    events = []
    for i, (category, pattern) in enumerate(patterns(level, **gates)):
        has, hits = _has(F.col(to), pattern), F.regexp_extract_all(F.col(to), F.lit(pattern), F.lit(0))
        placed = F.transform(hits, _placeholder(category))
        strung = F.array_join(F.zip_with(F.split(F.col(to), pattern, -1), placed, lambda g, r: F.concat(g, F.coalesce(r, F.lit("")))), "")
        events.append(f"_e{i}")
        out = out.select(
            *(c for c in out.columns if c != to),
            F.when(has, strung).otherwise(F.col(to)).alias(to),
            F.when(has, F.transform(hits, _event(category))).otherwise(F.expr(f"cast(array() as {_EVENTS})")).alias(events[-1]),
        )
    out = out.withColumn("redactions", F.concat(*events)).drop(*events)
    names = F.array_sort(F.array_distinct(F.transform("redactions", lambda e: e["category"])))
    return out.withColumn("redaction_count", F.size("redactions")).withColumn("categories", names)


def scan(df: DataFrame, text: str = "text") -> DataFrame:
    """Findings on the text as it is, secrets and personal data: category and the first 20 characters, one row each."""
    t = F.coalesce(F.col(text), F.lit(""))
    none = F.expr("cast(array() as array<struct<category:string,preview:string>>)")
    found = F.concat(*(F.when(_has(t, p), F.transform(F.regexp_extract_all(t, F.lit(p), F.lit(0)), _finding(c))).otherwise(none) for c, p in SECRETS + PII))
    return df.withColumn("_f", F.explode(found)).select(*df.columns, "_f.category", "_f.preview")


def has_source_code(text: Column) -> Column:
    hits = [F.coalesce(text, F.lit("")).rlike(p).cast("int") for p in SOURCE_CODE]
    total = hits[0]
    for h in hits[1:]:
        total = total + h
    return total >= 2


def redact_for_embedding(df: DataFrame, text: str = "text", level: str = "strict", **gates) -> DataFrame:
    """As ``redact``; texts that look like source code get that category, which counts as no redaction."""
    out = redact(df, text, level, **gates)
    code = has_source_code(F.col("sanitized"))
    event = F.struct(F.lit("source_code").alias("category"), F.length("sanitized").alias("original_length"), F.lit("(source code detected in embedding text)").alias("replacement"))
    return (
        out.withColumn("is_source_code", code)
        .withColumn("redactions", F.when(code, F.concat("redactions", F.array(event))).otherwise(F.col("redactions")))
        .withColumn("categories", F.when(code, F.array_sort(F.array_union("categories", F.array(F.lit("source_code"))))).otherwise(F.col("categories")))
    )


def classification(categories: Column) -> Column:
    any_of = lambda names: F.arrays_overlap(categories, F.array(*(F.lit(n) for n in names)))
    return F.when(any_of(CONFIDENTIAL), "confidential").when(any_of(INTERNAL), "internal").otherwise("public")


def too_long(text: Column, limit: int) -> Column:
    return F.coalesce(F.length(text), F.lit(0)) > limit


def denied(text: Column, words: tuple[str, ...]) -> Column:
    """Case-insensitive substring of a blocked word."""
    out = F.lit(False)
    for w in words:
        out = out | F.contains(F.lower(F.coalesce(text, F.lit(""))), F.lit(w.lower()))
    return out


def audit(df: DataFrame, operation: str, destination: str, text: str = "text", level: str = "strict", limit: int = 10_000, deny: tuple[str, ...] = ()) -> DataFrame:
    """One entry a text, never the text: hash and length of the original, what was redacted, class, and whether it is blocked."""
    r = redact(df.select(F.col(text).alias("text")), "text", level)
    long_, deny_ = too_long(F.col("text"), limit), denied(F.col("text"), deny)
    return r.select(
        F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX").alias("timestamp"),
        F.lit(operation).alias("operation"),
        F.lit(destination).alias("destination"),
        F.sha2(F.coalesce("text", F.lit("")), 256).alias("content_hash"),
        F.length(F.coalesce("text", F.lit(""))).alias("content_length"),
        F.length("sanitized").alias("sanitized_length"),
        "redaction_count",
        F.col("categories").alias("categories_found"),
        classification(F.col("categories")).alias("classification"),
        (long_ | deny_).alias("blocked"),
        F.when(deny_, "blocked pattern").when(long_, "too long").otherwise("").alias("block_reason"),
    )


def audit_summary(entries: DataFrame) -> DataFrame:
    cats = F.array_sort(F.array_distinct(F.flatten(F.collect_set("categories_found"))))
    return entries.agg(F.count("*").alias("total"), F.count(F.when(F.col("blocked"), 1)).alias("blocked"), F.coalesce(F.sum("redaction_count"), F.lit(0)).alias("redactions"), cats.alias("categories"))
