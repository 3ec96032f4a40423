"""Destructive-action guard: one finding per rule, worst severity, redacted excerpts."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions import fixed_values as V
from ..functions.regex import checked, java
from ..functions.severity import label_of, rank
from ..functions.text import let, scanned, sha256, strip


@dataclass(frozen=True)
class GuardConfig:
    disabled_rule_ids: tuple[str, ...] = ()
    extra_rules: tuple[tuple[str, str, str], ...] = ()  # rule id, severity, pattern

    def rules(self) -> list[tuple[str, str, str, str, str]]:
        """rule id, name, severity, owasp, JVM pattern."""
        own = [
            (i, name, severity, V.ACTION_OWASP, java(pattern, flags))
            for i, name, severity, flags, pattern in V.ACTION_RULES
            if i not in self.disabled_rule_ids
        ]
        return own + [(i, i, severity, "custom", checked(pattern)) for i, severity, pattern in self.extra_rules]


def excerpt(text: Column, pattern: str, window: int = 32, cap: int = 120) -> Column:
    """Text around the first match, line breaks marked, secrets redacted, cut to the cap.

    Secrets are redacted behind ``=`` and behind ``:`` alike.
    """
    start = F.regexp_instr(text, F.lit(pattern))
    found = F.regexp_extract(text, pattern, 0)
    low = F.greatest(start - window, F.lit(1))
    around = F.substring(text, low, start - low + F.length(found) + window)
    shown = strip(F.replace(around, F.lit("\n"), F.lit(" ⏎ ")))
    secret = java(V.EXCERPT_SECRET, "i").replace(r"[=:]", "([=:])", 1)
    shown = F.regexp_replace(shown, secret.replace("(?:(?:api", "((?:api", 1).replace("bearer)", "bearer))(?:", 1), "$1$2[REDACTED]")
    return F.when(F.length(shown) > cap, F.concat(F.left(shown, F.lit(cap - 3)), F.lit("…"))).otherwise(shown)


def screen_action(payload: Column, config: GuardConfig | None = None, excerpts: bool = True) -> Column:
    """is_destructive, severity, matches, explanation, payload_sha256.

    Null payload fails closed (critical). Empty payload is clean.
    """
    rules = (config or GuardConfig()).rules()
    return let(scanned(payload), lambda text: let(_found(text, rules, excerpts), lambda found: _result(payload, found)))


def _found(text: Column, rules: list[tuple[str, str, str, str, str]], excerpts: bool) -> Column:
    each = [
        F.when(
            text.rlike(pattern),
            F.struct(
                F.lit(i).alias("rule_id"),
                F.lit(name).alias("name"),
                F.lit(severity).alias("severity"),
                F.lit(owasp).alias("owasp"),
                (excerpt(text, pattern) if excerpts else F.lit(None).cast("string")).alias("excerpt"),
                F.lit(rank(severity)).alias("ord"),
                F.lit(-k).alias("before"),
            ),
        )
        for k, (i, name, severity, owasp, pattern) in enumerate(rules)
    ]
    return F.filter(F.array(*each), lambda m: m.isNotNull())


def _result(payload: Column, found: Column) -> Column:
    worst = F.array_max(F.transform(found, lambda m: F.struct(m["ord"], m["before"], m["name"].alias("name"), m["rule_id"].alias("rule_id"))))
    hit = F.size(found) > 0
    severity = label_of(worst["ord"])
    said = F.concat(
        F.lit("Destructive action detected: "), worst["name"], F.lit(" ("), severity, F.lit(", rule="), worst["rule_id"],
        F.lit("); "), F.size(found).cast("string"), F.lit(" pattern(s) matched"),
    )
    shown = F.transform(
        found, lambda m: F.struct(*(m[c].alias(c) for c in ("rule_id", "name", "severity", "owasp", "excerpt")))
    )
    closed = payload.isNull()
    return F.struct(
        (hit | closed).alias("is_destructive"),
        F.when(closed, "critical").when(hit, severity).otherwise("none").alias("severity"),
        shown.alias("matches"),
        F.when(closed, "guard error: null payload").when(hit, said).otherwise("no destructive action patterns matched").alias("explanation"),
        sha256(payload).alias("payload_sha256"),
    )


def worst_severity(payload: Column, config: GuardConfig | None = None) -> Column:
    """Severity label alone; stops at the first match of each severity, the highest first."""
    rules = (config or GuardConfig()).rules()
    text = scanned(payload)
    out = F.lit("none")
    for level in ("low", "medium", "high", "critical"):
        same = [text.rlike(p) for *_, s, _, p in rules if s == level]
        if same:
            any_of = same[0]
            for c in same[1:]:
                any_of = any_of | c
            out = F.when(any_of, level).otherwise(out)
    return F.when(payload.isNull(), "critical").otherwise(out)
