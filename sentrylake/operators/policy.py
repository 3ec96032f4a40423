"""Policy rules mined from documents, their enforcement, and conduct checks."""

from __future__ import annotations

import re
from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import fixed_values as V
from ..functions.regex import all_matches, first_match, java, matches
from ..functions.text import collapse, let, present, sha256


@dataclass(frozen=True)
class PolicyRule:
    rule_id: str
    title: str = ""
    summary: str = ""
    category: str = "general"
    agent: str = ""
    source_refs: tuple[str, ...] = ()
    violation_patterns: tuple[str, ...] = ()
    severity: str = "medium"

    def valid_patterns(self) -> list[str]:
        """Patterns that compile; the others are skipped."""
        out = []
        for p in self.violation_patterns:
            try:
                re.compile(p)
            except re.error:
                continue
            out.append(p)
        return out


@dataclass(frozen=True)
class PolicyConfig:
    block_on_high: bool = True
    block_on_critical: bool = True
    require_approval_escape: bool = True
    approval_markers: tuple[str, ...] = field(default_factory=lambda: tuple(V.APPROVAL_MARKERS))


def conduct_rules() -> list[PolicyRule]:
    """The two always-on rules; they have no patterns and fire through the conduct check."""
    return [
        PolicyRule(i, title, summary, category, "compliance_monitor", ("Company conduct policy",), (), severity)
        for i, title, category, severity, _, _, summary in V.CONDUCT_RULES
    ]


# --- mining ---------------------------------------------------------------------------------------


def has_secrets(text: Column) -> Column:
    return matches(text, V.SECRET_BODY, "i")


def sentences(text: Column) -> Column:
    """Sentences of at least 24 characters, without a leading keyword-hits header."""
    raw = F.regexp_replace(present(text), r"(?U)^[\s\x1c-\x1f]+|[\s\x1c-\x1f]+\z", "")
    headed = F.lower(raw).startswith(V.POLICY_HEADER)
    parts = F.split(raw, r"(?U)\n[\s\x1c-\x1f]*\n", 2)
    body = F.when(F.size(parts) > 1, F.element_at(parts, 2)).otherwise(F.regexp_replace(raw, V.POLICY_HEADER_LINE, ""))
    compact = collapse(F.when(headed, body).otherwise(raw))
    chunks = F.transform(F.split(compact, r"(?U)(?<=[.!?])[\s\x1c-\x1f]+"), lambda c: F.trim(c))
    return F.filter(chunks, lambda c: F.length(c) >= 24)


def _fragment_pattern(fragment: Column) -> Column:
    """Up to six content words joined by a short gap; null with fewer than two."""
    words = F.regexp_extract_all(F.lower(fragment), F.lit("[a-z]{4,}"), F.lit(0))
    stop = F.array(*map(F.lit, V.POLICY_STOPWORDS))
    words = F.filter(words, lambda w: ~F.array_contains(stop, w))
    return F.when(F.size(words) >= 2, F.array_join(F.slice(words, 1, 6), ".{0,35}"))


def sentence_patterns(sentence: Column) -> Column:
    """Violation patterns of one policy sentence, at most six, without repeats."""
    found = []
    for prefix in V.POLICY_PREFIXES:
        rest = first_match(sentence, rf"\b{prefix}\s+(.{{5,140}})", "i", 1)
        fragment = F.trim(F.element_at(F.split(rest, "[.;]"), 1))
        found.append(F.when(rest != "", _fragment_pattern(fragment)))
    found.append(F.when(matches(sentence, V.POLICY_WITHOUT, "i"), F.lit(V.POLICY_APPROVAL_PATTERN)))
    number = first_match(sentence, V.POLICY_LIMIT, "i", 1)
    unit = first_match(sentence, V.POLICY_LIMIT, "i", 2)
    limit = F.concat(F.lit(V.POLICY_OVER), number, F.lit(r"\s+"), unit)
    found.append(F.when(number != "", limit))
    return F.slice(F.array_distinct(F.filter(F.array(*found), lambda p: p.isNotNull())), 1, 6)


def category(subject: Column, body: Column) -> Column:
    """The category with most keywords present; the first of ties, general with none."""
    blob = F.lower(F.concat(present(subject), F.lit(" "), present(body)))
    scored = [
        F.struct(sum((blob.contains(k).cast("int") for k in keys), F.lit(0)).alias("n"), F.lit(-i).alias("before"), F.lit(name).alias("name"))
        for i, (name, keys) in enumerate(V.POLICY_CATEGORIES)
    ]
    best = F.array_max(F.array(*scored))
    return F.when(best["n"] > 0, best["name"]).otherwise("general")


def mine_rules(
    docs: DataFrame,
    subject_col: str = "subject",
    body_col: str = "body",
    order_col: str = "doc_id",
    agent: str = "compliance_monitor",
    per_doc: int = 8,
    total: int | None = None,
) -> DataFrame:
    """Rules from policy documents: the first ``per_doc`` of each, in sentence order.

    ``total`` keeps the first rules in document order. Documents with likely
    secrets give none; null subject and body count as empty.
    """
    subject, body = present(F.col(subject_col)), present(F.col(body_col))
    clean = docs.where(~has_secrets(F.concat(subject, F.lit("\n"), body)))
    ref = F.coalesce(F.nullif(F.trim(subject), F.lit("")), F.lit("document"))
    each = clean.select(
        F.col(order_col).alias("doc"), ref.alias("ref"), category(subject, body).alias("category"),
        F.posexplode(sentences(body)).alias("pos", "sentence"),
    )
    each = each.where(matches(F.col("sentence"), V.POLICY_SIGNAL, "i")).withColumn("violation_patterns", sentence_patterns(F.col("sentence")))
    each = each.where(F.size("violation_patterns") > 0)
    first = Window.partitionBy("doc").orderBy("pos")  # a document's sentences: bounded by its text
    each = each.withColumn("nth", F.row_number().over(first)).where(F.col("nth") <= per_doc)
    words = F.array_join(F.slice(F.regexp_extract_all("sentence", F.lit("[A-Za-z0-9][A-Za-z0-9'/-]*"), F.lit(0)), 1, 10), " ")
    title = F.when(F.length(words) > 72, F.concat(F.left(words, F.lit(69)), F.lit("…"))).otherwise(words)
    rules = each.select(
        "doc",
        "pos",
        F.concat(F.lit("CPR-"), F.left(F.sha2(F.concat("ref", F.lit(":"), "sentence").cast("binary"), 256), F.lit(16))).alias("rule_id"),
        F.coalesce(F.nullif(title, F.lit("")), F.col("ref")).alias("title"),
        F.left("sentence", F.lit(480)).alias("summary"),
        "category",
        F.lit(agent).alias("agent"),
        F.array("ref").alias("source_refs"),
        "violation_patterns",
        F.when(matches(F.col("sentence"), V.POLICY_HIGH, "i"), "high").otherwise("medium").alias("severity"),
    )
    return rules if total is None else rules.orderBy("doc", "pos").limit(total)


# --- enforcement ----------------------------------------------------------------------------------

FINDING = ("rule_id", "rule_title", "category", "severity", "matched_pattern", "summary")


def conduct(text: Column) -> Column:
    """Conduct findings: profanity toward a client or person, else a directed insult."""
    profane, client = matches(text, V.CONDUCT_PROFANITY, "i"), matches(text, V.CONDUCT_CLIENT, "i")
    directed = matches(text, V.CONDUCT_DIRECTED, "i")

    def made(rule):
        i, title, kind, severity, pattern, summary, _ = rule
        return F.struct(*(F.lit(v).alias(n) for n, v in zip(FINDING, (i, title, kind, severity, pattern, summary))))

    insult = F.when(directed, made(V.CONDUCT_RULES[1]))
    return F.filter(F.array(F.when(profane & (client | directed), made(V.CONDUCT_RULES[0])).otherwise(insult)), lambda x: x.isNotNull())


def evaluate(text: Column, rules: Sequence[PolicyRule], config: PolicyConfig | None = None) -> Column:
    """violation_count, findings, rules_checked, text_hash, should_block.

    A rule gives its first matching pattern; with an approval marker in the text
    a pattern of a rule about approval is passed over for the rule's next. Empty
    or null text, or no rules, is clean without a conduct check.
    """
    config = config or PolicyConfig()

    def report(shown: Column) -> Column:
        return let(_findings(shown, rules, config), lambda found: _report(text, found, rules, config))

    return let(present(text), report)


def _hits(shown: Column, rules: Sequence[PolicyRule], config: PolicyConfig) -> Column:
    """Array of the findings of rules with patterns, in the rules' order."""
    low = F.lower(shown)
    approved = F.lit(False)
    for marker in config.approval_markers:
        approved = approved | low.contains(marker)
    each = []
    for rule in rules:
        escape = config.require_approval_escape and "approval" in rule.summary.lower()
        hits = []
        for pattern in rule.valid_patterns():
            hit = shown.rlike(java(pattern, "i"))
            hits.append(F.when(hit & ~approved if escape else hit, F.lit(pattern[:120])))
        if hits:
            pattern = F.coalesce(*hits)
            values = [F.lit(rule.rule_id), F.lit(rule.title), F.lit(rule.category), F.lit(rule.severity), pattern, F.lit(rule.summary)]
            each.append(F.when(pattern.isNotNull(), F.struct(*(v.alias(n) for n, v in zip(FINDING, values)))))
    none = F.array().cast("array<struct<" + ",".join(f"{n}:string" for n in FINDING) + ">>")
    return F.filter(F.array(*each), lambda x: x.isNotNull()) if each else none


def _findings(shown: Column, rules: Sequence[PolicyRule], config: PolicyConfig) -> Column:
    hits = _hits(shown, rules, config)
    behaved = conduct(shown)
    taken = [r.rule_id for r in rules if r.rule_id in {c[0] for c in V.CONDUCT_RULES} and r.valid_patterns()]
    if taken:
        behaved = F.filter(behaved, lambda f: ~F.array_contains(F.transform(hits, lambda h: h["rule_id"]), f["rule_id"]))
    found = F.concat(hits, behaved) if any(r.valid_patterns() for r in rules) else behaved
    return F.when((shown != "") & F.lit(bool(rules)), found).otherwise(F.filter(behaved, lambda f: F.lit(False)))


def _report(text: Column, found: Column, rules: Sequence[PolicyRule], config: PolicyConfig) -> Column:
    levels = [s for s, on in (("critical", config.block_on_critical), ("high", config.block_on_high)) if on]
    active = (present(text) != "") & F.lit(bool(rules))
    return F.struct(
        F.size(found).alias("violation_count"),
        found.alias("findings"),
        F.when(active, len(rules) + len(V.CONDUCT_RULES)).otherwise(len(rules)).alias("rules_checked"),
        F.left(sha256(text), F.lit(16)).alias("text_hash"),
        F.exists(found, lambda f: f["severity"].isin(*levels) if levels else F.lit(False)).alias("should_block"),
    )


#: Rules of a table that one projection holds as literals.
RULES_AT_ONCE = 100


def enforce_table(
    texts: DataFrame, rules: DataFrame, key: str = "doc_id", text_col: str = "text", config: PolicyConfig | None = None, at_once: int = RULES_AT_ONCE
) -> DataFrame:
    """Findings of a rule table, one row per text and rule, as ``evaluate`` has them but for the conduct check.

    Columns of rules: rule_id, title, category, severity, summary,
    violation_patterns. Rules are configuration and are read by the driver;
    patterns that are no expressions or null are skipped. Each ``at_once`` rules
    are one projection over the texts, so that a pattern compiles once a task.
    """
    listed = [
        PolicyRule(r["rule_id"], r["title"] or "", r["summary"] or "", r["category"] or "", "", (), tuple(p for p in r["violation_patterns"] or () if p is not None), r["severity"] or "")
        for r in rules.select("rule_id", "title", "category", "severity", "summary", "violation_patterns").toLocalIterator()
    ]
    out = None
    for low in range(0, max(len(listed), 1), at_once):
        some = listed[low : low + at_once]
        found = let(present(F.col(text_col)), lambda t: _hits(t, some, config or PolicyConfig()))  # noqa: B023 - called at once
        part = texts.where(F.col(text_col) != "").select(key, F.explode(found).alias("f"))
        part = part.select(key, "f.rule_id", F.col("f.rule_title").alias("title"), "f.category", "f.severity", "f.matched_pattern")
        out = part if out is None else out.unionByName(part)
    return out
