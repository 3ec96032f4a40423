"""Audit event rows and hash-chained logs."""

from __future__ import annotations

import hashlib
import hmac
import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import fixed_values as V
from ..functions.text import present, preview, sha256

EVENT_COLUMNS = [
    "ts", "request_id", "kind", "surface", "source", "action", "outcome", "user_id", "threat", "injection_type",
    "confidence", "patterns", "input_sha256", "preview", "user_prompt", "latency_ms", "model_id", "policy",
]


def guard_events(screened: DataFrame, text_col: str, surface: str, request_id: Column, ts: Column, source: Column, user_id: Column) -> DataFrame:
    """One 18-column audit row per screened row; needs result and enforcement columns. Never the raw text."""
    r, text = F.col("result"), F.col(text_col)
    hit = r["is_injection"]
    return screened.select(
        ts.alias("ts"),
        F.lower(request_id).alias("request_id"),
        F.lit("prompt_injection").alias("kind"),
        F.lit(surface).alias("surface"),
        source.alias("source"),
        F.when(hit, F.col("enforcement")).otherwise("allowed").alias("action"),
        F.when(~hit, "passed").when(F.col("enforcement") == "blocked", "blocked").otherwise("flagged").alias("outcome"),
        user_id.alias("user_id"),
        F.when(hit, r["threat_level"]).otherwise("none").alias("threat"),
        r["injection_type"].alias("injection_type"),
        F.when(hit, r["confidence"]).otherwise(0.0).alias("confidence"),
        F.when(hit, F.slice(r["matched_patterns"], 1, V.EVENT_LIST_CAP)).otherwise(F.array().cast("array<string>")).alias("patterns"),
        sha256(text).alias("input_sha256"),
        preview(text).alias("preview"),
        preview(text).alias("user_prompt"),
        F.lit(None).cast("double").alias("latency_ms"),
        F.lit(None).cast("string").alias("model_id"),
        F.lit(f"OWASP-LLM01-Runtime-{surface}").alias("policy"),
    )


def policy_events(evaluated: DataFrame, report_col: str, text_col: str, surface: str, request_id: Column, ts: Column, source: Column, user_id: Column) -> DataFrame:
    """One 18-column policy audit row per evaluated row."""
    r, text = F.col(report_col), F.col(text_col)
    found = F.slice(r["findings"], 1, V.EVENT_LIST_CAP)
    hit = r["violation_count"] > 0
    return evaluated.select(
        ts.alias("ts"),
        F.lower(request_id).alias("request_id"),
        F.lit("policy_enforcement").alias("kind"),
        F.lit(surface).alias("surface"),
        source.alias("source"),
        F.when(~hit, "allowed").when(r["should_block"], "blocked").otherwise("logged").alias("action"),
        F.when(~hit, "passed").when(r["should_block"], "blocked").otherwise("flagged").alias("outcome"),
        user_id.alias("user_id"),
        r["violation_count"].alias("violation_count"),
        F.transform(found, lambda f: f["rule_id"]).alias("rule_ids"),
        F.transform(found, lambda f: f["severity"]).alias("severities"),
        r["rules_checked"].alias("rules_checked"),
        sha256(text).alias("input_sha256"),
        preview(text).alias("preview"),
        preview(text).alias("user_prompt"),
        F.lit(None).cast("double").alias("latency_ms"),
        F.lit(None).cast("string").alias("model_id"),
        F.lit("ClientPolicy-DocumentDerived").alias("policy"),
    )


def without_passes(events: DataFrame) -> DataFrame:
    return events.where("outcome <> 'passed'")


def recent_events(events: DataFrame, limit: int, user_id=None, order_col: str = "seq") -> DataFrame:
    """Newest first, 1 to 200 rows, optionally of one user."""
    if user_id is not None:
        events = events.where(F.col("user_id") == F.lit(user_id))
    return events.orderBy(F.desc(order_col)).limit(max(1, min(200, limit)))


def generation_outcome(df: DataFrame, outcome_col: str, latency_col: str, prompt_col: str) -> DataFrame:
    """Level, title, clamped latency and prompt preview of a generation's outcome."""
    failed = F.lower(F.col(outcome_col)).isin("error", "failed", "failure", "timeout")
    return df.select(
        "*",
        F.when(failed, "error").when(F.lower(F.col(outcome_col)) == "blocked", "warning").otherwise("info").alias("level"),
        F.concat(F.lit("Generation "), F.lower(F.coalesce(F.col(outcome_col), F.lit("unknown")))).alias("title"),
        F.greatest(F.lit(0.0), F.col(latency_col).cast("double")).alias("latency_clamped"),
        preview(F.col(prompt_col)).alias("prompt_preview"),
    )


def human_decisions(df: DataFrame, decision_col: str, rule_col: str, note_col: str, text_col: str) -> DataFrame:
    """Approved and denied decisions only, with their fields cut to 64, 200 and 2000 characters."""
    made = F.lower(F.trim(decision_col))
    return df.where(made.isin("approved", "denied")).select(
        made.alias("decision"),
        F.left(present(F.col(rule_col)), F.lit(64)).alias("rule_id"),
        F.left(present(F.col(note_col)), F.lit(200)).alias("note"),
        F.left(present(F.col(text_col)), F.lit(2000)).alias("text"),
    )


# --- chain -----------------------------------------------------------------------------------------


_ENCODER = json.JSONEncoder(ensure_ascii=False, sort_keys=True, separators=(",", ":"))


def canonical(obj) -> bytes:
    """Sorted, compact, unescaped JSON: the form that is hashed."""
    return _ENCODER.encode(obj).encode()


def append_lines(records: list[dict], key: bytes, seq: int = 0, tip: str = V.GENESIS) -> Iterator[str]:
    """Chained lines for records in order, from a given tip."""
    for record in records:
        seq += 1
        body = record | {"seq": seq, "prev_hash": tip}
        digest = hashlib.sha256(canonical(body)).hexdigest()
        body |= {"entry_hash": digest, "sig": hmac.new(key, digest.encode(), hashlib.sha256).hexdigest()}
        line = json.dumps(body, ensure_ascii=False, separators=(",", ":"))
        tip = hashlib.sha256(line.encode()).hexdigest()
        yield line


def build_chain(records: DataFrame, key: bytes, chain_col: str, order_col: str, json_col: str, tips: DataFrame | None = None) -> DataFrame:
    """chain, pos, line: each chain folded in order by one task; chains are independent.

    A chain is sequential by definition, so one chain's rows meet in one task
    and stream through it in order; they are never gathered in memory. ``tips``
    (chain, seq, tip) are the ends of stored chains to go on from.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        chain, seq, tip = None, 0, V.GENESIS
        for pdf in batches:
            out = []
            for c, text, last, end in zip(pdf["chain"], pdf["body"], pdf["seq"], pdf["tip"]):
                if c != chain:
                    chain, seq, tip = (c, 0, V.GENESIS) if end is None else (c, int(last), end)
                line = next(append_lines([json.loads(text)], key, seq, tip))
                seq, tip = seq + 1, hashlib.sha256(line.encode()).hexdigest()
                out.append((c, seq, line))
            yield pd.DataFrame(out, columns=["chain", "pos", "line"])

    rows = records.select(F.col(chain_col).cast("string").alias("chain"), F.col(order_col).alias("at"), F.col(json_col).alias("body"))
    if tips is None:
        rows = rows.withColumns({"seq": F.lit(None).cast("long"), "tip": F.lit(None).cast("string")})
    else:
        rows = rows.join(tips.select("chain", "seq", "tip"), "chain", "left")
    dealt = rows.repartition("chain").sortWithinPartitions("chain", "at").select("chain", "body", "seq", "tip")
    return dealt.mapInPandas(run, "chain string, pos long, line string")


LINE_CHECK = "chain string, pos long, ok_json boolean, seq long, prev_hash string, entry_ok boolean, sig_ok boolean, line_hash string"


def check_lines(lines: DataFrame, key: bytes | None = None) -> DataFrame:
    """Per log line what can be checked without its neighbours: JSON, entry hash, signature, line hash.

    Columns of lines: chain, pos, line. Every line is checked on its own, so the
    work spreads over all tasks however long a chain is.
    """

    def one(line: str) -> tuple:
        digest = hashlib.sha256(line.encode()).hexdigest()
        try:
            entry = json.loads(line)
        except ValueError:
            return False, None, None, None, None, digest
        if not isinstance(entry, dict) or entry.get("seq") is None:
            return isinstance(entry, dict), None, None, True, True, digest
        body = {k: v for k, v in entry.items() if k not in ("entry_hash", "sig")}
        stored, sig = str(entry.get("entry_hash", "")), entry.get("sig", "")
        good = stored == hashlib.sha256(canonical(body)).hexdigest()
        signed = not sig or key is None or hmac.compare_digest(hmac.new(key, stored.encode(), hashlib.sha256).hexdigest(), str(sig))
        try:
            seq = int(entry["seq"])
        except (TypeError, ValueError, OverflowError):
            return False, None, None, None, None, digest
        return True, seq, str(entry.get("prev_hash", "")), good, signed, digest

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            made = [(c, p, *one(x)) for c, p, x in zip(pdf["chain"], pdf["pos"], pdf["line"])]
            out = pd.DataFrame(made, columns=["chain", "pos", "ok_json", "seq", "prev_hash", "entry_ok", "sig_ok", "line_hash"])
            out["seq"] = out["seq"].astype("Int64")
            yield out

    kept = lines.where(F.trim("line") != "").select(F.col("chain").cast("string").alias("chain"), F.col("pos").cast("long").alias("pos"), "line")
    return kept.mapInPandas(run, LINE_CHECK)


def verify_chain(lines: DataFrame, key: bytes | None = None) -> DataFrame:
    """One row per chain: ok, entries_checked, first_bad_seq, error of the first failing line.

    ``pos`` numbers a chain's non-blank lines from 1 without holes. Neighbours
    meet by position in one shuffle (each line's hash is sent to the next one), so
    a long chain is not one task's work and no line is read twice.
    Lines without a seq are accepted and counted.
    """
    facts = F.struct("ok_json", "seq", "prev_hash", "entry_ok", "sig_ok")
    own = F.struct(F.col("pos"), facts.alias("line"), F.lit(None).cast("string").alias("tip"))
    sent = F.struct((F.col("pos") + 1).alias("pos"), F.when(F.lit(False), facts).alias("line"), F.col("line_hash").alias("tip"))
    both = check_lines(lines, key).select("chain", F.explode(F.array(own, sent)).alias("e")).select("chain", "e.*")
    met = both.groupBy("chain", "pos").agg(F.max("line").alias("line"), F.max("tip").alias("tip")).where("line IS NOT NULL").select("chain", "pos", "line.*", "tip")
    expected = F.col("pos")
    legacy = F.col("seq").isNull()
    error = (
        F.when(~F.col("ok_json"), "JSON parse error")
        .when(legacy, None)
        .when(F.col("seq") != expected, F.concat(F.lit("sequence gap — expected "), expected.cast("string"), F.lit(", got "), F.col("seq").cast("string")))
        .when(F.col("prev_hash") != F.coalesce("tip", F.lit(V.GENESIS)), F.concat(F.lit("prev_hash mismatch at seq="), F.col("seq").cast("string")))
        .when(~F.col("entry_ok"), F.concat(F.lit("entry_hash mismatch at seq="), F.col("seq").cast("string")))
        .when(~F.col("sig_ok"), F.concat(F.lit("HMAC mismatch at seq="), F.col("seq").cast("string")))
    )
    bad = F.when(error.isNotNull(), F.struct("pos", F.coalesce("seq", expected).alias("seq"), error.alias("error")))
    return (
        met.groupBy("chain")
        .agg(F.min(bad).alias("first"), F.count(F.lit(1)).alias("n"))
        .select(
            "chain",
            F.col("first").isNull().alias("ok"),
            F.coalesce(F.col("first.pos") - 1, F.col("n")).alias("entries_checked"),
            F.col("first.seq").alias("first_bad_seq"),
            F.col("first.error").alias("error"),
        )
    )


def append(lines: DataFrame, records: DataFrame, key: bytes, chain_col: str, order_col: str, json_col: str) -> DataFrame:
    """New lines for the records, behind those of the stored chains; chains that are not stored begin."""
    return build_chain(records, key, chain_col, order_col, json_col, chain_tip(check_lines(lines)))


def chain_tip(checked: DataFrame) -> DataFrame:
    """The last line's position and hash per chain, to append behind."""
    return checked.groupBy("chain").agg(F.max("pos").alias("seq"), F.max_by("line_hash", "pos").alias("tip"))


def link_gaps(df: DataFrame, seq_col: str, hash_col: str, prev_col: str) -> DataFrame:
    """Rows whose predecessor by number is there but whose link to it is wrong."""
    before = df.select((F.col(seq_col) + 1).alias(seq_col), F.col(hash_col).alias("__tip"))
    return df.join(before, seq_col).where(~F.col(prev_col).eqNullSafe(F.col("__tip"))).drop("__tip")


def last_prompt(events: DataFrame, session_col: str, order_col: str, prompt_col: str) -> DataFrame:
    """Adds the session's latest known prompt to each event."""
    so_far = Window.partitionBy(session_col).orderBy(order_col).rowsBetween(Window.unboundedPreceding, 0)
    return events.withColumn("session_prompt", F.last(prompt_col, ignorenulls=True).over(so_far))
