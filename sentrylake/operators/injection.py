"""Input injection detection as one projection.

Rules are literals in the plan, so each regex compiles once per task; findings
are an array in check order and the verdict is a reduction over it. Nothing is
shuffled and no Python runs.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import fixed_values as V
from ..functions.regex import all_matches, checked, matches
from ..functions.severity import label_of, rank
from ..functions.text import let, present, sha256

FINDING = "struct<type:string,threat:int,confidence:double,label:string,ord:int>"
RESULT = (
    "is_injection boolean, threat_level string, injection_type string, confidence double, "
    "matched_patterns array<string>, explanation string"
)


@dataclass(frozen=True)
class DetectionConfig:
    """Validated on the driver, before a plan is built."""

    sensitivity: str = "balanced"
    custom_patterns: tuple[str, ...] = ()
    blocklist: tuple[str, ...] = ()
    allowlist: tuple[str, ...] = ()

    def __post_init__(self):
        for entry in (*self.blocklist, *self.allowlist):
            if len(entry.strip()) < 3:
                raise ValueError(f"list entry {entry!r} is too short (3 characters at least)")
        for pattern in self.custom_patterns:
            checked(pattern)


def _finding(when: Column, kind: str, threat: str, confidence: float, label: Column, order: int) -> Column:
    made = F.struct(
        F.lit(kind).alias("type"),
        F.lit(rank(threat)).alias("threat"),
        F.lit(confidence).alias("confidence"),
        label.alias("label"),
        F.lit(order).alias("ord"),
    )
    return F.when(when, made)


def _labelled(kind: str, prefix: str, threat: str, confidence: float, order: int):
    """A finding from what was found, for use within an array."""

    def made(x: Column) -> Column:
        return _finding(F.lit(True), kind, threat, confidence, F.concat(F.lit(f"{prefix}:"), x), order)

    return made


def decoded_base64(run: Column) -> Column:
    """A base64 run's text, null where its padding is wrong; bytes that are no UTF-8 are dropped."""
    n = F.length(F.rtrim(run, F.lit("=")))
    pads = F.length(run) - n
    ok = ((n % 4 == 0)) | ((n % 4 == 2) & (pads == 2)) | ((n % 4 == 3) & (pads >= 1))
    padded = F.concat(F.rtrim(run, F.lit("=")), F.repeat(F.lit("="), (F.lit(4) - n % 4) % 4))
    return F.when(ok, F.replace(F.make_valid_utf8(F.unbase64(padded)), F.lit("\ufffd"), F.lit("")))


def base64_keywords(text: Column) -> Column:
    """Per suspicious base64 run its first keyword, in order of the runs."""
    lowered = F.transform(all_matches(text, V.BASE64_RUN), lambda r: F.lower(decoded_base64(r)))
    keyword = F.lit(None).cast("string")
    keywords = lambda d: F.coalesce(*(F.when(d.contains(k), F.lit(k)) for k in V.BASE64_KEYWORDS), keyword)
    return F.filter(F.transform(lowered, keywords), lambda k: k.isNotNull())


def findings(text: Column, canaries: Column | None = None, custom: tuple[str, ...] = ()) -> Column:
    """All findings in check order, before any preset's filter."""
    groups: list[Column] = []
    single: list[Column] = []
    order = 0

    def close():
        if single:
            groups.append(F.filter(F.array(*single), lambda x: x.isNotNull()))
            single.clear()

    for kind, prefix, threat, confidence, flags, patterns in V.INJECTION_FAMILIES:
        if flags == "base64":
            close()
            found = F.when(matches(text, V.BASE64_RUN), base64_keywords(text)).otherwise(F.array().cast("array<string>"))
            groups.append(F.transform(found, _labelled(kind, prefix, threat, confidence, order)))
            order += 1
        elif flags == "canary":
            if canaries is not None:
                close()
                low = F.lower(text)
                hits = F.filter(canaries, lambda c: c.isNotNull() & (c != "") & F.contains(low, F.lower(c)))
                groups.append(F.transform(hits, _labelled(kind, prefix, threat, confidence, order)))
            order += 1
        else:
            for pattern in patterns:
                if flags == "fixed_label":
                    label, used = prefix, ""
                else:
                    shown = pattern[: V.LABEL_CAP] if kind == "credential_exfil" else pattern
                    label, used = f"{prefix}:{shown}", flags
                single.append(_finding(matches(text, pattern, used), kind, threat, confidence, F.lit(label), order))
                order += 1
    for pattern in custom:
        single.append(
            _finding(text.rlike(checked(pattern)), "direct_override", "high", 0.8, F.lit(f"custom:{pattern}"), order)
        )
        order += 1
    close()
    return F.concat(*(g.cast(f"array<{FINDING}>") for g in groups))


def kept(found: Column, sensitivity: str | Column) -> Column:
    """Findings that a preset keeps; unknown presets count as 0.5 and low."""
    if isinstance(sensitivity, str):
        least, threat = V.SENSITIVITY.get(sensitivity, (0.5, "low"))
        return F.filter(found, lambda f: (f["confidence"] >= least) & (f["threat"] >= rank(threat)))
    least, threat = F.lit(0.5), F.lit(rank("low"))
    for name, (c, t) in V.SENSITIVITY.items():
        least = F.when(sensitivity == name, c).otherwise(least)
        threat = F.when(sensitivity == name, rank(t)).otherwise(threat)
    return F.filter(found, lambda f: (f["confidence"] >= least) & (f["threat"] >= threat))


def verdict(found: Column) -> Column:
    """The result struct of kept findings: type and threat of the first with the highest threat."""
    n = F.size(found)
    worst = F.array_max(F.transform(found, lambda f: F.struct(f["threat"], -f["ord"], f["type"].alias("type"))))
    confidence = F.round(F.array_max(F.transform(found, lambda f: f["confidence"])), 3)
    threat = label_of(worst["threat"])
    said = F.concat(
        F.lit("Detected "), worst["type"], F.lit(" ("), threat, F.lit(" threat, "),
        F.bround(confidence * 100).cast("int").cast("string"), F.lit("% confidence) from "), n.cast("string"), F.lit(" signal(s)"),
    )
    hit = n > 0
    return F.struct(
        hit.alias("is_injection"),
        F.when(hit, threat).otherwise("none").alias("threat_level"),
        F.when(hit, worst["type"]).alias("injection_type"),
        F.when(hit, confidence).otherwise(0.0).alias("confidence"),
        F.transform(found, lambda f: f["label"]).alias("matched_patterns"),
        F.when(hit, said).otherwise("No injection patterns detected").alias("explanation"),
    )


def _fixed(hit: bool, threat: str, kind: str | None, confidence: float, labels: list[Column], said: Column) -> Column:
    return F.struct(
        F.lit(hit).alias("is_injection"),
        F.lit(threat).alias("threat_level"),
        F.lit(kind).cast("string").alias("injection_type"),
        F.lit(confidence).alias("confidence"),
        F.array(*labels).cast("array<string>").alias("matched_patterns"),
        said.alias("explanation"),
    )


def detect(
    text: Column,
    config: DetectionConfig | None = None,
    canaries: Column | None = None,
    sensitivity: str | Column | None = None,
) -> Column:
    """The result struct of a text column. Null text fails closed: it is critical, never clean."""
    config = config or DetectionConfig()
    preset = config.sensitivity if sensitivity is None else sensitivity
    low = F.lower(text)
    result = let(text, lambda t: let(kept(findings(t, canaries, config.custom_patterns), preset), verdict))
    for entry in reversed(config.blocklist):
        said = F.lit(f"Input matched blocklist entry: {entry}")
        hit = _fixed(True, "high", "direct_override", 1.0, [F.lit(f"blocklist:{entry}")], said)
        result = F.when(low.contains(entry.lower()), hit).otherwise(result)
    for entry in reversed(config.allowlist):
        clean = _fixed(False, "none", None, 0.0, [], F.lit("Input matched allowlist entry"))
        result = F.when(low.contains(entry.lower()), clean).otherwise(result)
    failed = _fixed(True, "critical", None, 1.0, [F.lit("detection_error")], F.lit("Detection error: null input"))
    return F.when(text.isNull(), failed).otherwise(result)


def screen(
    df: DataFrame,
    text_col: str = "text",
    surface: str | Column = "user_input",
    canaries: Column | None = None,
    block_any: bool = False,
    config: DetectionConfig | None = None,
) -> DataFrame:
    """Adds result, input_sha256, blocked and enforcement for a surface's preset.

    Surfaces: user_input, external_content, tabular_payload (no canaries there).
    Empty input is clean.
    """
    name = F.lit(surface) if isinstance(surface, str) else surface
    preset = F.lit("balanced")
    for known, sensitivity in V.SURFACE_PRESET.items():
        preset = F.when(name == known, sensitivity).otherwise(preset)
    tokens = None if canaries is None else F.when(name == "tabular_payload", F.array().cast("array<string>")).otherwise(canaries)
    text = F.col(text_col)
    empty = _fixed(False, "none", None, 0.0, [], F.lit("Empty input"))
    result = F.when(F.coalesce(text, F.lit("")) == "", empty).otherwise(detect(present(text), config, tokens, preset))
    out = df.withColumn("result", result).withColumn("input_sha256", sha256(text))
    critical = F.col("result.threat_level") == "critical"
    out = out.withColumn("blocked", F.col("result.is_injection") if block_any else (critical & F.col("result.is_injection")))
    label = F.when(~F.col("result.is_injection"), "allowed").when(F.col("blocked"), "blocked").otherwise("logged")
    return out.withColumn("enforcement", label)


def canary_leaks(df: DataFrame, tokens: DataFrame, text_col: str = "text", token_col: str = "token", key: str = "doc_id") -> DataFrame:
    """(key, token) pairs of texts that contain a planted token.

    The token list is a stated query set, usually short; it is broadcast only if
    it is small, by the engine's own size check.
    """
    texts = df.select(key, F.lower(F.col(text_col)).alias("__low"))
    return texts.join(tokens.select(token_col), F.contains(F.col("__low"), F.lower(F.col(token_col)))).select(key, token_col)
