"""What leaves for a service goes through here: redaction, limits, a local mode, and an audit entry for every call."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tremor.operators import redact


class PrivacyViolation(RuntimeError):
    """A text or a batch that must not be sent."""


@dataclass(frozen=True)
class Privacy:
    local_only: bool = False
    level: str = "strict"
    max_prompt: int = 50_000
    max_embedding: int = 10_000
    max_batch: int = 100
    blocked: tuple[str, ...] = ()
    allow_ips: bool = False
    allow_paths: bool = False
    custom: tuple[str, ...] = ()


def privacy_from(config: dict) -> Privacy:
    """Settings from a parsed configuration; what it does not name has its default."""
    p = (config.get("security") or {}).get("privacy") or {}
    names = {"local_only": "local_only_mode", "level": "redaction_level", "max_prompt": "max_prompt_length", "max_embedding": "max_embedding_length", "max_batch": "max_batch_size", "allow_ips": "allow_ip_addresses", "allow_paths": "allow_file_paths"}
    given = {k: p[v] for k, v in names.items() if v in p}
    custom = tuple(c["pattern"] for c in p.get("custom_redaction_patterns") or [] if c.get("pattern"))
    out = Privacy(**given, blocked=tuple(p.get("blocked_patterns") or ()), custom=custom)
    redact.patterns(out.level)  # an unknown level fails here
    return out


AUDIT = "operation string, content_length long, sanitized_length long, redaction_count long, categories array<string>, blocked boolean, reason string"


@dataclass
class Guard:
    """A request is a handful of texts; they pass the same expressions as a table of any size."""

    spark: SparkSession
    privacy: Privacy = Privacy()
    log: list[tuple] = field(default_factory=list)
    calls: int = 0

    def _note(self, operation: str, before: int, after: int = 0, n: int = 0, categories: list[str] = (), reason: str = "") -> None:
        self.log.append((operation, before, after, n, sorted(categories), bool(reason), reason))

    def audit(self) -> DataFrame:
        return self.spark.createDataFrame(self.log, AUDIT)

    def _clean(self, texts: list[str], operation: str, limit: int) -> list:
        """Rows with sanitized, redaction_count and categories, in order; raises, and notes it, for a text that must not leave."""
        p = self.privacy
        df = self.spark.createDataFrame(list(enumerate(texts)), "i int, text string")
        how = redact.redact_for_embedding if operation.startswith("embed") else redact.redact
        rows = how(df, level=p.level, allow_ips=p.allow_ips, allow_paths=p.allow_paths, custom=p.custom)
        flags = rows.withColumn("long", redact.too_long(F.col("text"), limit)).withColumn("denied", redact.denied(F.col("text"), p.blocked))
        out = sorted(flags.select("i", "sanitized", "redaction_count", "categories", "long", "denied").collect())
        for r in out:
            if r.long or r.denied:
                reason = f"longer than {limit}" if r.long else "blocked pattern"
                self._note(operation, len(texts[r.i] or ""), reason=reason)
                raise PrivacyViolation(f"{operation}: {reason}")
        return out

    def generate(self, ask: Callable[..., str], prompt: str, system: str | None = None, **more) -> str:
        """The answer of ``ask`` to the redacted prompt; the empty text in local mode."""
        self.calls += 1
        if self.privacy.local_only:
            self._note("generate", len(prompt), reason="local only")
            return ""
        said = self._clean([prompt], "generate", self.privacy.max_prompt)[0]
        head = self._clean([system], "generate system", self.privacy.max_prompt)[0].sanitized if system else None
        self._note("generate", len(prompt), len(said.sanitized), said.redaction_count, said.categories)
        return ask(said.sanitized, **({"system": head} if head else {}), **more)

    def embed(self, call: Callable[[list[str]], list[list[float]]], texts: list[str]) -> list[list[float]]:
        """Vectors of the redacted texts; none in local mode."""
        self.calls += 1
        total = sum(len(t or "") for t in texts)
        if self.privacy.local_only:
            self._note("embed", total, reason="local only")
            return []
        if len(texts) > self.privacy.max_batch:
            self._note("embed", total, reason=f"more than {self.privacy.max_batch} texts")
            raise PrivacyViolation(f"embed: {len(texts)} texts, {self.privacy.max_batch} at most")
        rows = self._clean(texts, "embed", self.privacy.max_embedding)
        self._note("embed", total, sum(len(r.sanitized) for r in rows), sum(r.redaction_count for r in rows), {c for r in rows for c in r.categories})
        return call([r.sanitized for r in rows]) if rows else []

    def embed_one(self, call: Callable[[list[str]], list[list[float]]], text: str) -> list[float]:
        got = self.embed(call, [text])
        return got[0] if got else []

    def status(self) -> dict:
        """What was sent and what was not, by numbers."""
        p = self.privacy
        found = sorted({c for r in self.log for c in r[4]})
        return {"local_only": p.local_only, "level": p.level, "calls": self.calls, "blocked": sum(r[5] for r in self.log), "redactions": sum(r[3] for r in self.log), "categories": found}


def guarded_batches(docs: DataFrame, privacy: Privacy = Privacy(), text: str = "text") -> DataFrame:
    """The guard over a whole table, as it would be sent for embedding: sanitized, counts, and whether a text must stay."""
    out = redact.redact_for_embedding(docs, text, privacy.level, allow_ips=privacy.allow_ips, allow_paths=privacy.allow_paths, custom=privacy.custom)
    stays = F.lit(privacy.local_only) | redact.too_long(F.col(text), privacy.max_embedding) | redact.denied(F.col(text), privacy.blocked)
    return out.withColumn("sent", ~stays)
