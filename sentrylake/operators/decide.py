"""Allow, review or deny: three votes per payload combined in one projection."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import fixed_values as V
from ..functions.severity import rank_of, label_of
from ..functions.text import present
from . import actions, injection, policy

RANK = ["allow", "review", "deny"]


def _vote(name: str, verdict: Column, severity: Column, score: Column | None, findings: Column) -> Column:
    return F.struct(
        F.lit(name).alias("name"),
        verdict.alias("verdict"),
        severity.alias("severity"),
        (F.lit(None).cast("double") if score is None else score).alias("score"),
        findings.cast("array<string>").alias("findings"),
        F.lit(None).cast("string").alias("error"),
    )


def preset_of(kind: Column) -> Column:
    out = F.lit("balanced")
    for name, preset in V.DECISION_PRESET.items():
        out = F.when(kind == name, preset).otherwise(out)
    return out


def votes(df: DataFrame, payload_col: str = "payload", kind_col: str = "kind") -> DataFrame:
    """Adds the array of the three votes. Unknown kinds fail the job, as a wrong request would."""
    kind = F.col(kind_col)
    known = kind.isin(*V.DECISION_PRESET)
    text = F.when(known, present(F.col(payload_col))).otherwise(F.raise_error(F.concat(F.lit("unknown payload kind: "), F.coalesce(kind, F.lit("null")))))
    out = df.withColumn("__text", text)
    t = F.col("__text")
    out = out.withColumn("__i", injection.detect(t, sensitivity=preset_of(kind)))
    output = kind.isin(*V.DECISION_OUTPUT_KINDS)
    out = out.withColumn("__a", F.when(output, actions.screen_action(t)))
    out = out.withColumn("__p", policy.evaluate(t, policy.conduct_rules()))
    i, a, p = F.col("__i"), F.col("__a"), F.col("__p")
    level = rank_of(i["threat_level"])
    first = _vote(
        "prompt-injection",
        F.when(level >= 3, "deny").when(level == 2, "review").otherwise("allow"),
        i["threat_level"],
        F.round(i["confidence"], 3),
        F.slice(i["matched_patterns"], 1, V.VOTE_FINDINGS_CAP),
    )
    skipped = F.array(F.concat(F.lit("skipped (payload_kind="), kind, F.lit(")")))
    shown = F.transform(F.slice(a["matches"], 1, V.VOTE_FINDINGS_CAP), lambda m: F.concat(m["rule_id"], F.lit(": "), F.coalesce(m["excerpt"], F.lit(""))))
    second = _vote(
        "destructive-action",
        F.when(a["severity"] == "critical", "deny").when(a["severity"] == "high", "review").otherwise("allow"),
        F.coalesce(a["severity"], F.lit("none")),
        None,
        F.when(output, shown).otherwise(skipped),
    )
    worst = F.array_max(F.transform(p["findings"], lambda f: F.greatest(rank_of(f["severity"]), F.lit(1))))
    third = _vote(
        "policy-enforcement",
        F.when(p["should_block"], "deny").when(worst >= 3, "review").otherwise("allow"),
        F.when(p["violation_count"] > 0, label_of(worst)).otherwise("none"),
        None,
        F.transform(F.slice(p["findings"], 1, V.VOTE_FINDINGS_CAP), lambda f: F.concat(f["rule_id"], F.lit(": "), f["rule_title"])),
    )
    return out.withColumn("votes", F.array(first, second, third)).drop("__text", "__i", "__a", "__p")


def resolve(voted: DataFrame, request_id_col: str | None = None) -> DataFrame:
    """Adds outcome, reasons, decision_id and the policy labels.

    Any vote with an error denies; else the strictest verdict wins. Without a
    request id the decision id is a digest of the votes, so that a replay gives
    the same id.
    """
    ranks = F.transform("votes", lambda v: F.when(v["error"].isNotNull(), 2).otherwise(F.array_position(F.array(*map(F.lit, RANK)), v["verdict"]) - 1))
    outcome = F.element_at(F.array(*map(F.lit, RANK)), F.array_max(ranks).cast("int") + 1)
    active = F.filter("votes", lambda v: (v["verdict"] != "allow") | v["error"].isNotNull())
    reasons = F.transform(
        active,
        lambda v: F.concat(v["name"], F.lit(" ("), v["severity"], F.lit("): "), F.when(F.size(v["findings"]) > 0, F.get(v["findings"], F.lit(0))).otherwise(v["severity"])),
    )
    digest = F.left(F.sha2(F.to_json(F.struct(*voted.columns)).cast("binary"), 256), F.lit(32))
    return voted.select(
        "*",
        outcome.alias("outcome"),
        reasons.alias("reasons"),
        (F.coalesce(F.col(request_id_col), digest) if request_id_col else digest).alias("decision_id"),
        F.lit("builtin:v0").alias("policy_bundle_version"),
        F.lit("builtin/strict-v0").alias("resolution_policy"),
        F.lit(True).alias("offline"),
    )


def decide(df: DataFrame, payload_col: str = "payload", kind_col: str = "kind", request_id_col: str | None = None) -> DataFrame:
    return resolve(votes(df, payload_col, kind_col), request_id_col)


def kind_of_role(role: Column) -> Column:
    """Payload kind of a conversation turn."""
    return F.when(role == "user", "user_input").when(role == "assistant", "model_output").otherwise("external_content")
