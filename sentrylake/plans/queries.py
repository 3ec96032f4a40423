"""Registered queries of the core library: Spark plan and DuckDB SQL side by side."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import fixed_values as V
from ..functions.text import preview, wrap_untrusted
from ..operators import actions, agent, contracts, decide, evidence, grading, injection, killswitch, ledger, pii, policy, report, usage
from . import seeds as S
from . import sql as Q

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE_SQL[f.__name__] = sql
        return f

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _documents(spark, sf_dir, phrases, *more):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", *more)
    return S.seeded(docs, phrases, "doc_id", "text")


# --- injection -------------------------------------------------------------------------------------

_INJECT = S.seeded_sql("documents", S.INJECTION, "doc_id", "text", more="source, lang")


def _verdict_sql(preset: str) -> str:
    return f"""
WITH f AS (SELECT doc_id, {Q.kept_list(Q.injection_list(), preset)} AS found FROM {_INJECT}),
w AS (SELECT doc_id, found, {Q.worst_of('found')} AS w FROM f)
SELECT doc_id, len(found) > 0 AS is_injection,
       CASE WHEN len(found) > 0 THEN {Q.severity_label('(-w.a)')} ELSE 'none' END AS threat_level,
       w.type AS injection_type,
       coalesce(round(list_max(list_transform(found, lambda x: x.conf)), 3), 0.0) AS confidence,
       len(found)::INT AS n_findings FROM w
"""


def _verdicts(spark, sf_dir, preset: str) -> DataFrame:
    df = _documents(spark, sf_dir, S.INJECTION)
    out = df.select("doc_id", injection.detect(F.col("text"), sensitivity=preset).alias("r"))
    return out.select(
        "doc_id", "r.is_injection", "r.threat_level", "r.injection_type", "r.confidence",
        F.size("r.matched_patterns").alias("n_findings"),
    )


@query(_verdict_sql("balanced"))
def inject_verdicts_balanced(spark, sf_dir):
    return _verdicts(spark, sf_dir, "balanced")


@query(_verdict_sql("strict"))
def inject_verdicts_strict(spark, sf_dir):
    return _verdicts(spark, sf_dir, "strict")


@query(_verdict_sql("permissive"))
def inject_verdicts_permissive(spark, sf_dir):
    return _verdicts(spark, sf_dir, "permissive")


@query(
    f"""
SELECT x.type AS family, count(*) AS n_findings
FROM (SELECT unnest({Q.injection_list()}) AS x FROM {_INJECT}) GROUP BY 1
"""
)
def inject_findings_by_family(spark, sf_dir):
    found = _documents(spark, sf_dir, S.INJECTION).select(injection.findings(F.col("text")).alias("found"))
    return report.findings_by(found)


@query(
    f"""
WITH f AS (SELECT source, {Q.kept_list(Q.injection_list(), 'balanced')} AS found FROM {_INJECT}),
t AS (SELECT source, CASE WHEN len(found) > 0 THEN {Q.severity_label('list_max(list_transform(found, lambda x: x.threat))')} ELSE 'none' END AS threat FROM f)
SELECT source, threat, count(*) AS n, grouping_id(source, threat)::BIGINT AS level FROM t GROUP BY ROLLUP (source, threat)
"""
)
def inject_rollup_source_threat(spark, sf_dir):
    df = _documents(spark, sf_dir, S.INJECTION, "source")
    threat = injection.detect(F.col("text"), sensitivity="balanced")["threat_level"]
    return report.rollup(df.select("source", threat.alias("threat")), "source", "threat")


_CANARY = S.seeded_sql("documents", S.CANARY_TEXT, "doc_id", "text")


@query(
    f"SELECT doc_id, token FROM {_CANARY} JOIN (VALUES {', '.join(f'({S.quoted(c)})' for c in S.CANARIES)}) AS c(token) "
    "ON contains(lower(t), lower(token))"
)
def canary_leaks(spark, sf_dir):
    tokens = spark.createDataFrame([(c,) for c in S.CANARIES], "token string")
    return injection.canary_leaks(_documents(spark, sf_dir, S.CANARY_TEXT), tokens)


@query(
    f"""
WITH f AS (SELECT doc_id, {Q.kept_list(Q.injection_list(canaries=S.CANARIES), 'balanced')} AS found FROM {_CANARY})
SELECT doc_id, CASE WHEN len(found) = 0 THEN 'allowed'
  WHEN list_max(list_transform(found, lambda x: x.threat)) = 4 THEN 'blocked' ELSE 'logged' END AS enforcement,
  coalesce(list_max(list_transform(found, lambda x: x.threat)) = 4, false) AS blocked FROM f
"""
)
def screen_with_canaries(spark, sf_dir):
    tokens = F.array(*map(F.lit, S.CANARIES))
    return injection.screen(_documents(spark, sf_dir, S.CANARY_TEXT), canaries=tokens).select("doc_id", "enforcement", "blocked")


@query(
    f"""
WITH d AS (SELECT doc_id, regexp_extract(t, '[A-Za-z0-9+/]{{20,}}={{0,2}}') AS run FROM {S.seeded_sql('documents', S.BASE64, 'doc_id', 'text')}),
e AS (SELECT doc_id, CASE WHEN run <> '' THEN lower(try(decode(from_base64(run)))) END AS x FROM d)
SELECT doc_id, CASE {' '.join(f"WHEN contains(x, '{k}') THEN '{k}'" for k in V.BASE64_KEYWORDS)} END AS keyword FROM e
"""
)
def base64_payloads(spark, sf_dir):
    df = _documents(spark, sf_dir, S.BASE64)
    return df.select("doc_id", F.get(injection.base64_keywords(F.col("text")), F.lit(0)).alias("keyword"))


_MARKUP = next(f for f in V.INJECTION_FAMILIES if f[1] == "markup")


@query(
    "SELECT page_id, "
    + " + ".join(f"coalesce({Q.match('html', p, 'is')}, false)::INT" for p in _MARKUP[5])
    + " AS n_markup FROM pages"
)
def page_markup_findings(spark, sf_dir):
    pages = table(spark, sf_dir, "pages").select("page_id", "html")
    found = F.filter(injection.findings(F.coalesce("html", F.lit(""))), lambda f: f["type"] == "markup_injection")
    return pages.select("page_id", F.size(found).alias("n_markup"))


def _surface_sql() -> str:
    table_ = S.seeded_sql("documents", S.INJECTION, "doc_id", "text")
    f = f"WITH d AS (SELECT doc_id, doc_id % 3 AS s, {Q.injection_list()} AS a FROM {table_}), "
    f += (
        f"f AS (SELECT doc_id, ['user_input', 'external_content', 'tabular_payload'][s + 1] AS surface, "
        f"CASE WHEN s = 2 THEN {Q.kept_list('a', 'permissive')} ELSE {Q.kept_list('a', 'balanced')} END AS found FROM d) "
    )
    return f + "SELECT doc_id, surface, CASE WHEN len(found) = 0 THEN 'allowed' ELSE 'logged' END AS enforcement FROM f"


@query(_surface_sql())
def screen_surfaces(spark, sf_dir):
    names = F.array(F.lit("user_input"), F.lit("external_content"), F.lit("tabular_payload"))
    df = _documents(spark, sf_dir, S.INJECTION)
    df = df.withColumn("surface", F.element_at(names, (F.col("doc_id") % 3 + 1).cast("int")))
    return injection.screen(df, surface=F.col("surface")).select("doc_id", "surface", "enforcement")


@query("SELECT doc_id, '<untrusted source=\"' || replace(source, '\"', '''') || '\">' || chr(10) || 'x' || doc_id || chr(10) || '</untrusted>' AS wrapped FROM documents")
def wrap_untrusted_content(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "source")
    return docs.select("doc_id", wrap_untrusted(F.col("source"), F.concat(F.lit("x"), F.col("doc_id").cast("string"), F.lit(" \n"))).alias("wrapped"))


# --- destructive actions ---------------------------------------------------------------------------

_ACTIONS = S.seeded_sql("events", S.ACTIONS, "event_id", "props")


def _actions(spark, sf_dir):
    return S.seeded(table(spark, sf_dir, "events").select("event_id", "props"), S.ACTIONS, "event_id", "props")


@query(f"SELECT x.rule_id AS rule_id, count(*) AS n FROM (SELECT unnest({Q.action_list()}) AS x FROM {_ACTIONS}) GROUP BY 1")
def guard_matches(spark, sf_dir):
    result = actions.screen_action(F.col("text"), excerpts=False)
    found = _actions(spark, sf_dir).select(F.explode(result["matches"]).alias("m"))
    return found.groupBy(F.col("m.rule_id").alias("rule_id")).agg(F.count(F.lit(1)).alias("n"))


@query(
    f"""
WITH f AS (SELECT event_id, {Q.action_list()} AS found FROM {_ACTIONS}),
w AS (SELECT event_id, found, list_sort(list_transform(found, lambda x: {{'a': -x.sev, 'b': x.ord, 'rule_id': x.rule_id}}))[1] AS w FROM f)
SELECT event_id, len(found) > 0 AS is_destructive, CASE WHEN len(found) > 0 THEN {Q.severity_label('(-w.a)')} ELSE 'none' END AS severity,
       w.rule_id AS worst_rule FROM w
"""
)
def guard_worst_severity(spark, sf_dir):
    df = _actions(spark, sf_dir).select("event_id", actions.screen_action(F.col("text"), excerpts=False).alias("r"))
    rule = F.nullif(F.regexp_extract("r.explanation", r"rule=([a-z0-9_.]+)\)", 1), F.lit(""))
    return df.select("event_id", "r.is_destructive", "r.severity", rule.alias("worst_rule"))


@query(f"SELECT event_id, sha256(t) AS payload_sha256 FROM {_ACTIONS}")
def guard_payload_digests(spark, sf_dir):
    df = _actions(spark, sf_dir).select("event_id", actions.screen_action(F.col("text"), excerpts=False).alias("r"))
    return df.select("event_id", "r.payload_sha256")


@query()
def guard_excerpts(spark, sf_dir):
    df = _actions(spark, sf_dir).select("event_id", F.explode(actions.screen_action(F.col("text"))["matches"]).alias("m"))
    return df.select("event_id", "m.rule_id", "m.excerpt")


# --- grading ---------------------------------------------------------------------------------------

_PROMPTS = S.seeded_sql("conversations", S.PROMPTS, "conv_id", "text", more="turn")


def _graded(spark, sf_dir, evidence_=False):
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "text")
    df = S.seeded(turns, S.PROMPTS, "conv_id", "text").withColumn("turn_id", F.concat_ws(":", "conv_id", "turn"))
    return grading.grade(df, evidence=evidence_)


_VECTORS = f"SELECT conv_id || ':' || turn AS turn_id, unnest({Q.vector_rows()}) AS v FROM {_PROMPTS}"


@query(
    f"""
WITH v AS ({_VECTORS}),
s AS (SELECT turn_id, count(*) FILTER (WHERE v.matched >= v.required) AS defended, count(*) AS total FROM v GROUP BY 1),
r AS (SELECT *, round_even(defended * 100.0 / total, 0)::INT AS score FROM s)
SELECT turn_id, score, {Q.grade_case('score')} AS grade, defended::INT AS defended, defended || '/' || total AS coverage FROM r
"""
)
def grade_prompts(spark, sf_dir):
    return _graded(spark, sf_dir).select("turn_id", "score", "grade", "defended", "coverage")


@query(
    f"SELECT turn_id, v.vector_id AS vector_id, v.matched >= v.required AS defended, v.matched::INT AS matched_patterns FROM ({_VECTORS})"
)
def grade_vectors_long(spark, sf_dir):
    return grading.vectors_long(_graded(spark, sf_dir), "turn_id").select("turn_id", "vector_id", "defended", "matched_patterns")


@query(
    f"SELECT turn_id, 'OWASP:' || v.owasp || '::' || v.vector_id AS control_id, v.severity AS severity FROM ({_VECTORS}) WHERE v.matched < v.required"
)
def compliance_violations(spark, sf_dir):
    return grading.compliance_violations(_graded(spark, sf_dir), "turn_id").select("turn_id", "control_id", "severity")


_HARDENED = "rtrim(coalesce(text, ''), ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) || chr(10) || chr(10) || " + S.quoted(grading.APPENDIX["base"])


@query(
    f"""
WITH d AS (SELECT conv_id, turn, {_HARDENED} AS t FROM conversations WHERE role = 'system'),
v AS (SELECT conv_id, turn, unnest({Q.vector_rows()}) AS v FROM d),
s AS (SELECT conv_id, turn, round_even(count(*) FILTER (WHERE v.matched >= v.required) * 100.0 / count(*), 0)::INT AS score FROM v GROUP BY ALL)
SELECT conv_id, turn, {Q.grade_case('score')} AS grade FROM s
"""
)
def grade_augmented_prompts(spark, sf_dir):
    turns = table(spark, sf_dir, "conversations").where("role = 'system'").select("conv_id", "turn", "text")
    hardened = turns.withColumn("text", grading.augment(F.col("text")))
    return grading.grade(hardened, evidence=False).select("conv_id", "turn", "grade")


@query()
def grade_evidence(spark, sf_dir):
    return grading.vectors_long(_graded(spark, sf_dir, True), "turn_id").select("turn_id", "vector_id", "confidence", "evidence")


# --- policy ----------------------------------------------------------------------------------------


def _policy_docs(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    subject = S.phrase_of([s for s, _ in S.POLICY_DOCS], F.col("doc_id"))
    body = F.concat(S.phrase_of([b for _, b in S.POLICY_DOCS], F.col("doc_id")), F.lit(" "), F.coalesce("text", F.lit("")))
    return docs.select("doc_id", subject.alias("subject"), body.alias("body"))


@query()
def policy_mine_rules(spark, sf_dir):
    rules = policy.mine_rules(_policy_docs(spark, sf_dir))
    return rules.select("doc", "rule_id", "title", "category", "severity", "violation_patterns")


def _category_sql() -> str:
    docs = ", ".join(f"({k}, {S.quoted(s)}, {S.quoted(b)})" for k, (s, b) in enumerate(S.POLICY_DOCS))
    items = ", ".join(
        f"{{'a': -({' + '.join(f'contains(x, {S.quoted(w)})::INT' for w in words)}), 'b': {i}, 'name': {S.quoted(name)}}}"
        for i, (name, words) in enumerate(V.POLICY_CATEGORIES)
    )
    return f"""
WITH d AS (SELECT doc_id, lower(subject || ' ' || body || ' ' || coalesce(text, '')) AS x FROM documents JOIN (VALUES {docs}) AS s(k, subject, body) ON doc_id % {len(S.POLICY_DOCS)} = k),
c AS (SELECT doc_id, list_sort([{items}])[1] AS c FROM d)
SELECT doc_id, CASE WHEN c.a < 0 THEN c.name ELSE 'general' END AS category FROM c
"""


@query(_category_sql())
def policy_categories(spark, sf_dir):
    docs = _policy_docs(spark, sf_dir)
    return docs.select("doc_id", policy.category(F.col("subject"), F.col("body")).alias("category"))


_RULES = [policy.PolicyRule(i, title, summary, category, "", (), tuple(patterns), severity) for i, title, summary, category, severity, patterns in S.POLICY_RULES]
_TEXTS = S.seeded_sql("documents", S.POLICY_TEXTS, "doc_id", "text")


def _enforce_sql() -> str:
    approved = "(" + " OR ".join(f"contains(lower(t), {S.quoted(m)})" for m in V.APPROVAL_MARKERS) + ")"
    rows = []
    for r in _RULES:
        any_of = " OR ".join(Q.match("t", p, "i") for p in r.violation_patterns)
        escape = f" AND NOT {approved}" if "approval" in r.summary.lower() else ""
        rows.append(f"SELECT doc_id, {S.quoted(r.rule_id)} AS rule_id, {S.quoted(r.severity)} AS severity FROM d WHERE ({any_of}){escape}")
    severities = " ".join(f"WHEN {S.quoted(c[0])} THEN {S.quoted(c[3])}" for c in V.CONDUCT_RULES)
    rows.append(f"SELECT doc_id, c AS rule_id, CASE c {severities} END AS severity FROM (SELECT doc_id, {Q.conduct_id()} AS c FROM d) WHERE c IS NOT NULL")
    return f"WITH d AS (SELECT * FROM {_TEXTS}) " + " UNION ALL ".join(rows)


@query(_enforce_sql())
def policy_enforce(spark, sf_dir):
    docs = _documents(spark, sf_dir, S.POLICY_TEXTS)
    found = docs.select("doc_id", F.explode(policy.evaluate(F.col("text"), _RULES)["findings"]).alias("f"))
    return found.select("doc_id", "f.rule_id", "f.severity")


@query(
    "WITH f AS (" + _enforce_sql() + ") SELECT doc_id, rule_id, severity FROM f WHERE rule_id LIKE 'R-%'"
)
def policy_enforce_table(spark, sf_dir):
    docs = _documents(spark, sf_dir, S.POLICY_TEXTS)
    rows = [(r.rule_id, r.title, r.category, r.severity, r.summary, list(r.violation_patterns)) for r in _RULES]
    rules = spark.createDataFrame(rows, "rule_id string, title string, category string, severity string, summary string, violation_patterns array<string>")
    return policy.enforce_table(docs, rules).select("doc_id", "rule_id", "severity")


@query(f"SELECT doc_id, {Q.conduct_id()} AS conduct FROM {_TEXTS}")
def policy_conduct(spark, sf_dir):
    docs = _documents(spark, sf_dir, S.POLICY_TEXTS)
    return docs.select("doc_id", F.get(policy.conduct(F.col("text")), F.lit(0))["rule_id"].alias("conduct"))


# --- personal data -----------------------------------------------------------------------------------

_PII = S.seeded_sql("documents", S.PII, "doc_id", "text")
_LUHN = (
    "(len(d) BETWEEN 13 AND 19 AND len(list_distinct(string_split(d, ''))) > 1 AND "
    "list_sum(list_transform(range(1, len(d) + 1), lambda i: CASE WHEN (len(d) - i) % 2 = 1 THEN "
    "(CASE WHEN 2 * d[i]::INT > 9 THEN 2 * d[i]::INT - 9 ELSE 2 * d[i]::INT END) ELSE d[i]::INT END)) % 10 = 0)"
)
_MOD97 = (
    "(list_reduce(list_prepend(0, list_transform(string_split(substr(s, 5) || left(s, 4), ''), "
    "lambda c: CASE WHEN c BETWEEN '0' AND '9' THEN c::INT ELSE ascii(c) - 55 END)), "
    "lambda a, v: (a * CASE WHEN v < 10 THEN 10 ELSE 100 END + v) % 97) = 1)"
)


def _pii_sql() -> str:
    all_of = lambda p, g=0: f"regexp_extract_all(t, {S.quoted(p)}, {g})"
    ssn = "list_filter(a, lambda s: NOT (left(s, 3) IN ('000', '666') OR left(s, 1) = '9' OR substr(s, 5, 2) = '00' OR right(s, 4) = '0000'))"
    card = f"list_filter(list_transform(b, lambda s: regexp_replace(s, '[ -]', '', 'g')), lambda d: {_LUHN})"
    iban = f"list_filter(c, lambda s: len(s) BETWEEN 15 AND 34 AND {_MOD97})"
    never = ", ".join(map(S.quoted, V.PII_NINO_NEVER))
    nino = f"list_filter(n, lambda s: upper(left(s, 2)) NOT IN ({never}) AND upper(substr(s, 2, 1)) <> 'O')"
    ip = "list_filter(i, lambda s: s <> '0.0.0.0' AND NOT starts_with(s, '127.'))"
    emails = "len(list_distinct(list_transform(e, lambda s: lower(s))))"
    return f"""
WITH m AS (SELECT doc_id, t, {all_of(V.PII_SSN)} AS a, {all_of(V.PII_CARD)} AS b, {all_of(V.PII_IBAN)} AS c,
  {all_of('(?i)' + V.PII_NINO)} AS n, {all_of(V.PII_IPV4)} AS i, {all_of(V.PII_EMAIL)} AS e,
  len({all_of('(?i)' + V.PII_PASSPORT)}) AS p, len({all_of('(?i)' + V.PII_DOB)}) AS o FROM {_PII})
SELECT doc_id, len({ssn})::INT AS ssn, len({card})::INT AS credit_card, len({iban})::INT AS iban, len({nino})::INT AS uk_nino,
  p::INT AS passport, o::INT AS dob, len({ip})::INT AS ip_address,
  (CASE WHEN {emails} >= {V.PII_BULK} THEN {emails} ELSE 0 END)::INT AS email_bulk,
  {Q.match('t', V.SECRET_BODY, 'i')}::INT AS secrets FROM m
"""


@query(_pii_sql())
def pii_counts(spark, sf_dir):
    found = pii.detectors(F.col("text"))
    found.pop("phone_bulk")  # RE2 has no look-behind; pii_phones and the tests hold it
    return _documents(spark, sf_dir, S.PII).select("doc_id", *(n.cast("int").alias(k) for k, n in found.items()))


@query(
    f"""
WITH c AS ({_pii_sql()}) SELECT doc_id, CASE WHEN ssn + credit_card + iban + uk_nino > 0 THEN 'high'
  WHEN passport + dob + ip_address + email_bulk + secrets > 0 THEN 'medium' ELSE 'none' END AS severity FROM c
"""
)
def pii_worst(spark, sf_dir):
    counts = F.map_filter(pii.scan(F.col("text")), lambda k, _: k != "phone_bulk")
    return _documents(spark, sf_dir, S.PII).select("doc_id", pii.worst(counts).alias("severity"))


@query()
def pii_phones(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    return docs.select("doc_id", pii.distinct_phones(F.col("text")).alias("phones"))


@query()
def pii_redact(spark, sf_dir):
    df = _documents(spark, sf_dir, S.PII).withColumn("r", pii.redact(F.col("text")))
    return df.select("doc_id", F.sha2(F.col("r.text").cast("binary"), 256).alias("text_sha256"), F.aggregate(F.map_values("r.counts"), F.lit(0), lambda a, x: a + x).alias("n"))


@query(
    "SELECT 'sha256:' || sha256(c_custkey::VARCHAR) AS c_custkey, left(c_name, 8) AS c_name, c_mktsegment, "
    "CASE WHEN length(c_name) > 8 THEN 4 ELSE 3 END AS n_applied FROM customer"
)
def minimise_customer(spark, sf_dir):
    customer = table(spark, sf_dir, "customer")
    rules = {"c_custkey": "hash", "c_name": "truncate:8", "c_acctbal": "drop", "c_nationkey": "drop"}
    made = pii.minimise(customer, rules)
    return made.select("c_custkey", "c_name", "c_mktsegment", F.size("applied").alias("n_applied"))


# --- contracts and decisions ---------------------------------------------------------------------------


_CALL_RESULTS = [
    (True, "none", 0, "search"),
    (False, "high", 1, "search"),  # q is missing
    (False, "medium", 1, "mail"),  # cc is not allowed
    (False, "medium", 1, "other"),  # not declared
    (False, "high", 1, ""),  # no JSON
    (False, "high", 1, ""),  # no call
    (False, "high", 1, ""),  # no name
    (False, "high", 1, "search"),  # arguments are a list
]


@query(
    "SELECT event_id, ok, severity, n_findings::INT AS n_findings, tools FROM events JOIN (VALUES "
    + ", ".join(f"({k}, {str(ok).lower()}, {S.quoted(severity)}, {n}, {S.quoted(tools)})" for k, (ok, severity, n, tools) in enumerate(_CALL_RESULTS))
    + f") AS s(k, ok, severity, n_findings, tools) ON event_id % {len(S.CALLS)} = k"
)
def tool_contracts(spark, sf_dir):
    df = S.seeded(table(spark, sf_dir, "events").select("event_id"), S.CALLS, "event_id", None)
    made = df.select("event_id", contracts.inspect(F.col("text"), S.CONTRACTS).alias("r"))
    return made.select("event_id", "r.ok", "r.severity", F.size("r.findings").alias("n_findings"), F.array_join("r.tools", ",").alias("tools"))


_MIXED = [*S.INJECTION, *S.ACTIONS, *S.POLICY_TEXTS]
_TURNS = S.seeded_sql("conversations", _MIXED, "(conv_id * 7 + turn)", "text", more="conv_id, turn, role").replace(
    "SELECT (conv_id * 7 + turn)", "SELECT (conv_id * 7 + turn) AS turn_no"
)


def _votes_sql() -> str:
    strict, balanced = (Q.kept_list("a", p) for p in ("strict", "balanced"))
    return f"""
WITH d AS (SELECT conv_id, turn, role, {Q.injection_list()} AS a, {Q.action_list()} AS g, {Q.conduct_id()} AS c FROM {_TURNS}),
k AS (SELECT *, CASE role WHEN 'user' THEN 'user_input' WHEN 'assistant' THEN 'model_output' ELSE 'external_content' END AS kind,
  CASE WHEN role = 'user' THEN {balanced} ELSE {strict} END AS found FROM d),
v AS (SELECT *, coalesce(list_max(list_transform(found, lambda x: x.threat)), 0) AS threat,
  CASE WHEN kind = 'model_output' THEN coalesce(list_max(list_transform(g, lambda x: x.sev)), 0) ELSE 0 END AS sev FROM k)
SELECT conv_id, turn, role, CASE WHEN threat >= 3 OR sev = 4 OR c IS NOT NULL THEN 'deny' WHEN threat = 2 OR sev = 3 THEN 'review' ELSE 'allow' END AS outcome FROM v
"""


def _turns(spark, sf_dir):
    turns = table(spark, sf_dir, "conversations").withColumn("turn_no", F.col("conv_id") * 7 + F.col("turn"))
    df = S.seeded(turns, _MIXED, "turn_no", "text")
    return df.withColumn("kind", decide.kind_of_role(F.col("role")))


@query(f"SELECT role, outcome, count(*) AS n FROM ({_votes_sql()}) GROUP BY 1, 2")
def decide_turns(spark, sf_dir):
    return report.outcomes(decide.decide(_turns(spark, sf_dir), "text"), "role")


@query(f"SELECT conv_id, turn, outcome FROM ({_votes_sql()})")
def decide_each_turn(spark, sf_dir):
    return decide.decide(_turns(spark, sf_dir), "text").select("conv_id", "turn", "outcome")


@query()
def decide_reasons(spark, sf_dir):
    made = decide.decide(_turns(spark, sf_dir), "text")
    return made.where("outcome <> 'allow'").select("conv_id", "turn", "decision_id", F.array_join("reasons", " | ").alias("reasons"))


# --- kill switch ----------------------------------------------------------------------------------------

def _trips(spark, sf_dir):
    events = table(spark, sf_dir, "events").select("event_id", "user_id", "ts", "event_type")
    return killswitch.first_trips(events, "user_id", "ts", F.col("event_type") == "error", "event_id")


_TRIPS = "SELECT user_id AS run, min(ts) AS ts, arg_min(event_id, (ts, event_id)) AS id FROM events WHERE event_type = 'error' GROUP BY 1"


@query(_TRIPS)
def kill_first_trip(spark, sf_dir):
    return _trips(spark, sf_dir)


def _rolling_sql(seconds: int) -> str:
    return f"SELECT run, ts, id, count(*) OVER (ORDER BY ts RANGE BETWEEN INTERVAL {seconds} SECOND PRECEDING AND CURRENT ROW) AS n FROM ({_TRIPS})"


@query(f"SELECT run, ts, n FROM ({_rolling_sql(3600)})")
def kill_rolling_counts(spark, sf_dir):
    return killswitch.rolling_counts(_trips(spark, sf_dir), 3600).select("run", "ts", "n")


@query(f"SELECT ts AS panicked_at, run, n FROM ({_rolling_sql(3600)}) WHERE n >= 5 ORDER BY ts, id LIMIT 1")
def kill_panic(spark, sf_dir):
    return killswitch.panic(_trips(spark, sf_dir), 3600, 5)


@query(f"SELECT ts AS panicked_at, run, n FROM ({_rolling_sql(60)}) WHERE n >= 5 ORDER BY ts, id LIMIT 1")
def kill_panic_default_window(spark, sf_dir):
    return killswitch.panic(_trips(spark, sf_dir))


@query(f"SELECT run, ts, id FROM ({_TRIPS}) ORDER BY ts DESC, id DESC LIMIT 50")
def kill_recent(spark, sf_dir):
    return killswitch.recent(_trips(spark, sf_dir), 50)


@query(
    f"""
WITH trips AS ({_TRIPS}), panic AS (SELECT ts FROM ({_rolling_sql(3600)}) WHERE n >= 5 ORDER BY ts LIMIT 1)
SELECT e.event_id, coalesce(t.ts <= e.ts, false) AS run_killed, coalesce(e.ts >= (SELECT ts FROM panic), false) AS panic,
       coalesce(t.ts <= e.ts, false) OR coalesce(e.ts >= (SELECT ts FROM panic), false) AS killed
FROM events e LEFT JOIN trips t ON t.run = e.user_id
"""
)
def kill_state_as_of(spark, sf_dir):
    trips = _trips(spark, sf_dir)
    own = trips.select("run", "ts", F.lit(True).alias("on"))
    panic = killswitch.panic(trips, 3600, 5).select(F.lit(None).cast("long").alias("run"), F.col("panicked_at").alias("ts"), F.lit(True).alias("on"))
    asked = table(spark, sf_dir, "events").select(F.col("event_id").alias("query_id"), F.col("user_id").alias("run"), "ts")
    found = killswitch.state_as_of(asked, own.unionByName(panic))
    return found.select(F.col("query_id").alias("event_id"), "run_killed", "panic", "killed")


def _agent_sql() -> str:
    first = "min(struct_pack(ts := ts, id := event_id)) FILTER (WHERE sev = 4)"
    return f"""
WITH a AS (SELECT event_id, user_id, ts, coalesce(list_max(list_transform({Q.action_list()}, lambda x: x.sev)), 0) AS sev
           FROM {S.seeded_sql('events', S.ACTIONS, 'event_id', 'props', more='user_id, ts')}),
f AS (SELECT user_id, {first} AS first FROM a GROUP BY 1),
t AS (SELECT user_id, first.ts AS ts, first.id AS id FROM f WHERE first IS NOT NULL),
c AS (SELECT ts, id, count(*) OVER (ORDER BY ts RANGE BETWEEN INTERVAL 3600 SECOND PRECEDING AND CURRENT ROW) AS n FROM t),
p AS (SELECT min(struct_pack(ts := ts, id := id)) AS panic FROM c WHERE n >= 5)
SELECT event_id, CASE WHEN coalesce(struct_pack(ts := ts, id := event_id) > panic, false) OR coalesce(struct_pack(ts := ts, id := event_id) > first, false) THEN 'refused'
  WHEN sev = 4 THEN 'tripped' WHEN sev > 0 THEN 'flagged' ELSE 'passed' END AS state
FROM a JOIN f USING (user_id) CROSS JOIN p
"""


@query(_agent_sql())
def agent_actions(spark, sf_dir):
    events = table(spark, sf_dir, "events").select("event_id", "props", "user_id", "ts")
    acts = S.seeded(events, S.ACTIONS, "event_id", "props").select(F.col("event_id").alias("id"), F.col("user_id").alias("run"), "ts", F.col("text").alias("payload"))
    return agent.screen_actions(acts, seconds=3600).select(F.col("id").alias("event_id"), "state")


# --- audit ------------------------------------------------------------------------------------------------

_PREVIEW = r"trim(left(trim(regexp_replace(t, '[\s]+', ' ', 'g')), 96))"


@query(
    f"""
WITH f AS (SELECT doc_id, t, {Q.kept_list(Q.injection_list(), 'balanced')} AS found FROM {_INJECT})
SELECT doc_id::VARCHAR AS request_id, CASE WHEN len(found) = 0 THEN 'passed' ELSE 'flagged' END AS outcome,
       CASE WHEN len(found) = 0 THEN 'allowed' ELSE 'logged' END AS action, least(len(found), 12)::INT AS n_patterns, sha256(t) AS input_sha256 FROM f
"""
)
def audit_event_rows(spark, sf_dir):
    screened = injection.screen(_documents(spark, sf_dir, S.INJECTION))
    rows = ledger.guard_events(screened, "text", "user_input", F.col("doc_id").cast("string"), F.lit("2024-01-01T00:00:00+00:00"), F.lit("docs"), F.lit(None).cast("string"))
    return rows.select("request_id", "outcome", "action", F.size("patterns").alias("n_patterns"), "input_sha256")


@query(
    f"WITH f AS ({_enforce_sql()}), d AS (SELECT doc_id FROM documents) "
    "SELECT doc_id::VARCHAR AS request_id, count(rule_id)::INT AS violation_count, "
    "CASE WHEN count(rule_id) = 0 THEN 'passed' WHEN bool_or(severity IN ('high', 'critical')) THEN 'blocked' ELSE 'flagged' END AS outcome "
    "FROM d LEFT JOIN f USING (doc_id) GROUP BY doc_id"
)
def audit_policy_rows(spark, sf_dir):
    docs = _documents(spark, sf_dir, S.POLICY_TEXTS)
    evaluated = docs.withColumn("report", policy.evaluate(F.col("text"), _RULES))
    rows = ledger.policy_events(evaluated, "report", "text", "model_output", F.col("doc_id").cast("string"), F.lit("2024-01-01T00:00:00+00:00"), F.lit("docs"), F.lit(None).cast("string"))
    return rows.select("request_id", "violation_count", "outcome")


@query(
    "SELECT doc_id, left(trim(regexp_replace(text, '[\\x09-\\x0D\\x1C-\\x1F ]+', ' ', 'g')), 96) || CASE WHEN length(text) > 96 THEN '…' ELSE '' END AS preview FROM documents"
)
def previews(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", preview(F.col("text")).alias("preview"))


@query("SELECT event_id, user_id, event_type FROM events ORDER BY event_id DESC LIMIT 100")
def recent_events_topk(spark, sf_dir):
    events = table(spark, sf_dir, "events").select("event_id", "user_id", "event_type")
    return ledger.recent_events(events, 100, order_col="event_id")


@query(
    "SELECT event_id, CASE WHEN event_type = 'error' THEN 'error' ELSE 'info' END AS level, 'Generation ' || event_type AS title, "
    "greatest(0.0, value) AS latency_clamped FROM events"
)
def generation_outcomes(spark, sf_dir):
    events = table(spark, sf_dir, "events").select("event_id", "event_type", "value", "props")
    made = ledger.generation_outcome(events, "event_type", "value", "props")
    return made.select("event_id", "level", "title", "latency_clamped")


@query("SELECT 'approved' AS decision, left(props, 64) AS rule_id, left(event_type, 200) AS note, left(props, 2000) AS text FROM events WHERE event_id % 3 = 0")
def human_decisions(spark, sf_dir):
    events = table(spark, sf_dir, "events")
    made = events.withColumn("d", F.when(F.col("event_id") % 3 == 0, "Approved ").otherwise("pending"))
    return ledger.human_decisions(made, "d", "props", "event_type", "props")


# --- chain: lines of the orders table, hashed as text ------------------------------------------------------

_KEY = b"fixture-key"


def _records(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderstatus")
    body = F.to_json(F.struct(F.col("o_orderkey").alias("order"), F.col("o_orderstatus").alias("status")))
    return orders.select((F.col("o_custkey") % 16).alias("chain"), F.col("o_orderkey").alias("at"), body.alias("body"))


@query("SELECT (o_custkey % 16)::VARCHAR AS chain, true AS ok, count(*) AS entries_checked FROM orders GROUP BY 1")
def chain_build_and_verify(spark, sf_dir):
    lines = ledger.build_chain(_records(spark, sf_dir), _KEY, "chain", "at", "body")
    return ledger.verify_chain(lines, _KEY).select("chain", "ok", "entries_checked")


@query(
    """
WITH n AS (SELECT (o_custkey % 16)::VARCHAR AS chain, count(*) AS n FROM orders GROUP BY 1)
SELECT chain, n < 5 AS ok, least(n, 4) AS entries_checked, CASE WHEN n >= 5 THEN 5 END::BIGINT AS first_bad_seq,
       CASE WHEN n >= 5 THEN 'entry_hash mismatch at seq=5' END AS error FROM n
"""
)
def chain_verify_tampered(spark, sf_dir):
    lines = ledger.build_chain(_records(spark, sf_dir), _KEY, "chain", "at", "body")
    line = F.when(F.col("pos") == 5, F.regexp_replace("line", '"status":"[A-Z]"', '"status":"X"')).otherwise(F.col("line"))
    return ledger.verify_chain(lines.withColumn("line", line), _KEY)


@query(
    """
WITH n AS (SELECT (o_custkey % 16)::VARCHAR AS chain, count(*) AS n FROM orders GROUP BY 1)
SELECT chain, n < 8 AS ok, CASE WHEN n < 8 THEN n - CASE WHEN n >= 7 THEN 1 ELSE 0 END ELSE 6 END AS entries_checked,
       CASE WHEN n >= 8 THEN 8 END::BIGINT AS first_bad_seq FROM n
"""
)
def chain_verify_gap(spark, sf_dir):
    lines = ledger.build_chain(_records(spark, sf_dir), _KEY, "chain", "at", "body").where("pos <> 7")
    lines = lines.withColumn("pos", F.when(F.col("pos") > 7, F.col("pos") - 1).otherwise(F.col("pos")))
    return ledger.verify_chain(lines, _KEY).select("chain", "ok", "entries_checked", "first_bad_seq")


# --- evidence: leaves and seals made of the orders table ----------------------------------------------------

_LEAF_HASH = "sha256('leaf' || o_orderkey)"


def _leaves(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").select(F.col("o_orderkey").cast("long").alias("seq"))
    return orders.withColumn("leaf_hash", F.sha2(F.concat(F.lit("leaf"), F.col("seq").cast("string")).cast("binary"), 256))


_NODE = "sha256(unhex('01') || unhex(min(h) FILTER (WHERE i % 2 = 0)) || unhex(min(h) FILTER (WHERE i % 2 = 1)))"


@query(
    f"""
WITH o AS (SELECT o_orderkey AS seq, (row_number() OVER (ORDER BY o_orderkey) - 1) AS r, {_LEAF_HASH} AS x FROM orders),
l0 AS (SELECT r // 8 AS batch, r % 8 AS i, sha256(unhex('00') || unhex(x)) AS h, count(*) OVER (PARTITION BY r // 8) AS n FROM o),
f AS (SELECT * FROM l0 WHERE n = 8),
l1 AS (SELECT batch, i // 2 AS i, {_NODE} AS h FROM f GROUP BY batch, i // 2),
l2 AS (SELECT batch, i // 2 AS i, {_NODE} AS h FROM l1 GROUP BY batch, i // 2)
SELECT batch, {_NODE} AS root FROM l2 GROUP BY batch
"""
)
def merkle_roots(spark, sf_dir):
    leaves = _ranked(_leaves(spark, sf_dir), "seq", "r").withColumn("batch", F.floor(F.col("r") / 8).cast("long"))
    full = leaves.groupBy("batch").count().where("count = 8").select("batch")
    return evidence.merkle_roots(leaves.join(full, "batch"), ["batch"], "seq", "leaf_hash", 8)


def _ranked(df: DataFrame, order: str, name: str) -> DataFrame:
    """Numbers rows from 0 in order: ranges first, then rows within, so that no task sees all rows."""
    from pyspark.sql import Window

    width = 4096
    ranged = df.withColumn("__range", F.floor(F.col(order) / width))
    sizes = ranged.groupBy("__range").agg(F.count(F.lit(1)).alias("n"))
    before = sizes.select("__range", (F.sum("n").over(Window.orderBy("__range")) - F.col("n")).alias("__before"))
    within = Window.partitionBy("__range").orderBy(order)
    return ranged.join(before, "__range").withColumn(name, F.col("__before") + F.row_number().over(within) - 1).drop("__range", "__before")


_SEALS = """
seals AS (SELECT 's' || g AS seal_id, g * 100 AS first_seq, g * 100 + 79 + (g % 3) * 20 AS last_seq FROM (SELECT DISTINCT o_orderkey // 100 AS g FROM orders)),
leaves AS (SELECT o_orderkey AS seq FROM orders WHERE o_orderkey % 97 <> 0)
"""


def _sealed(spark, sf_dir):
    keys = table(spark, sf_dir, "orders").select("o_orderkey")
    groups = keys.select(F.floor(F.col("o_orderkey") / 100).cast("long").alias("g")).distinct()
    seals = groups.select(
        F.concat(F.lit("s"), F.col("g").cast("string")).alias("seal_id"), (F.col("g") * 100).alias("first_seq"),
        (F.col("g") * 100 + 79 + (F.col("g") % 3) * 20).alias("last_seq"),
    )
    return keys.where("o_orderkey % 97 <> 0").select(F.col("o_orderkey").alias("seq")), seals


@query(
    f"""
WITH {_SEALS},
j AS (SELECT seal_id, first_seq, last_seq, seq, row_number() OVER (PARTITION BY seal_id ORDER BY seq) - 1 AS i FROM seals LEFT JOIN leaves ON seq BETWEEN first_seq AND last_seq),
c AS (SELECT seal_id, first_seq, last_seq, count(seq) AS covered, min(first_seq + i) FILTER (WHERE seq <> first_seq + i) AS hole FROM j GROUP BY ALL)
SELECT seal_id, last_seq - first_seq + 1 AS expected, covered,
       CASE WHEN covered < last_seq - first_seq + 1 THEN coalesce(hole, first_seq + covered) END AS missing_seq FROM c
"""
)
def bundle_range_join(spark, sf_dir):
    leaves, seals = _sealed(spark, sf_dir)
    return evidence.seal_coverage(leaves, seals).select("seal_id", "expected", "covered", "missing_seq")


def _bundle_leaves(spark, sf_dir):
    """Leaves in a chain, with planted faults: a repeated number, a copied hash, a wrong link."""
    clean = _leaves(spark, sf_dir)
    before = clean.select((F.col("seq") + 1).alias("seq"), F.col("leaf_hash").alias("prev_leaf_hash"))
    linked = clean.join(before, "seq", "left").withColumn("recomputed", F.col("leaf_hash"))
    return linked.withColumn("prev_leaf_hash", F.when(F.col("seq") % 500 == 7, F.lit("x")).otherwise(F.col("prev_leaf_hash"))).withColumn(
        "recomputed", F.when(F.col("seq") % 600 == 9, F.lit("y")).otherwise(F.col("recomputed"))
    )


@query(
    """
WITH k AS (SELECT DISTINCT o_orderkey AS seq FROM orders)
SELECT seq, 3 AS "check" FROM k WHERE seq % 600 = 9
UNION ALL SELECT k.seq, 5 AS "check" FROM k JOIN k p ON p.seq + 1 = k.seq WHERE k.seq % 500 = 7
"""
)
def bundle_leaf_failures(spark, sf_dir):
    return evidence.leaf_failures(_bundle_leaves(spark, sf_dir)).select("seq", "check")


@query(
    """
WITH k AS (SELECT DISTINCT o_orderkey AS seq FROM orders)
SELECT seq, 2 AS "check" FROM k WHERE seq % 900 = 11
UNION ALL SELECT k.seq, 4 AS "check" FROM k JOIN k p ON p.seq + 1 = k.seq WHERE k.seq % 700 = 5
"""
)
def bundle_dup_hash(spark, sf_dir):
    """Repeated numbers and copied hashes among leaves."""
    clean = _leaves(spark, sf_dir).distinct()
    of = F.when(F.col("seq") % 700 == 5, F.col("seq") - 1).otherwise(F.col("seq")).cast("string")
    leaves = clean.withColumn("leaf_hash", F.sha2(F.concat(F.lit("leaf"), of).cast("binary"), 256))
    leaves = leaves.unionByName(leaves.where("seq % 900 = 11")).withColumns({"recomputed": F.col("leaf_hash"), "prev_leaf_hash": F.lit(None).cast("string")})
    return evidence.leaf_failures(leaves).where("check IN (2, 4)").select("seq", "check")


@query(
    f"""
SELECT sha256('[' || string_agg('[' || o_orderkey || ',"' || {_LEAF_HASH} || '"]', ',' ORDER BY o_orderkey) || ']') AS digest FROM orders
"""
)
def leaves_digest(spark, sf_dir):
    return spark.createDataFrame([(evidence.leaves_digest(_leaves(spark, sf_dir)),)], "digest string")


def _canonical_sql(fields: list[str], **values: str) -> str:
    """Sorted compact JSON text of a record as an SQL expression; fields without a value are null."""
    return " || ',' || ".join(f"'\"{k}\":' || {values.get(k, chr(39) + 'null' + chr(39))}" for k in sorted(fields)).join(["'{' || ", " || '}'"])


_BUNDLE_LEAF = _canonical_sql(V.LEAF_FIELDS, leaf_id="'\"l' || k || '\"'")
_BUNDLE_SEAL = _canonical_sql(V.SEAL_FIELDS, seal_id="'\"s' || k || '\"'", first_seq="(2 * k)", last_seq="(2 * k)", merkle_root="'\"' || root || '\"'")


def _bundle(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    """Leaves on even numbers, a seal for every tenth key's leaf."""
    keys = table(spark, sf_dir, "orders").select(F.col("o_orderkey").cast("long").alias("k")).distinct()
    leaves = keys.select("k", (2 * F.col("k")).alias("seq"), F.concat(F.lit("l"), F.col("k")).alias("leaf_id"), F.sha2(F.expr(_BUNDLE_LEAF).cast("binary"), 256).alias("leaf_hash"))
    seals = leaves.where("k % 10 = 0").withColumn("root", evidence.leaf_node(F.col("leaf_hash")))
    seals = seals.select(
        "k", F.concat(F.lit("s"), F.col("k")).alias("seal_id"), F.col("seq").alias("first_seq"), F.col("seq").alias("last_seq"),
        F.col("root").alias("merkle_root"), F.sha2(F.expr(_BUNDLE_SEAL).cast("binary"), 256).alias("seal_hash"),
    )
    return leaves, seals


@query(
    f"""
WITH o AS (SELECT DISTINCT o_orderkey AS k FROM orders),
n AS (SELECT count(*) AS leaves, count(*) FILTER (WHERE k % 10 = 0) AS seals, min(k) FILTER (WHERE k % 1000 = 3) AS edited,
      min(k) FILTER (WHERE k % 1000 = 20) AS sealed, min(k) FILTER (WHERE k % 1000 = 30) AS gone FROM o)
SELECT 'clean' AS variant, true AS ok, leaves AS leaves_checked, seals AS seals_checked, NULL::BIGINT AS first_bad_seq, NULL AS error, 'SELF-ATTESTED' AS attestation FROM n
UNION ALL SELECT 'edited leaf', false, (SELECT count(*) FROM o WHERE k < n.edited), 0, 2 * edited, 'leaf_hash mismatch at seq ' || 2 * edited, NULL FROM n
UNION ALL SELECT 'edited seal', false, leaves, 0, 2 * sealed, 'seal_hash mismatch for seal s' || sealed, NULL FROM n
UNION ALL SELECT 'deleted leaf', false, leaves - 1, 0, 2 * gone, 'deleted leaf — seal s' || gone || ' (missing seq ' || 2 * gone || ')', NULL FROM n
UNION ALL SELECT 'odd handover', false, leaves, 0, NULL, 'key handover carries no record', NULL FROM n
"""
)
def bundle_verify(spark, sf_dir):
    """A bundle of all orders that holds, and what is said of it when it has been tampered with."""
    leaves, seals = (x.cache() for x in _bundle(spark, sf_dir))  # each variant reads them
    low = leaves.agg(*(F.min(F.when(F.col("k") % 1000 == r, F.col("k"))).alias(f"r{r}") for r in (3, 20, 30))).first()
    edited = leaves.withColumn("action", F.when(F.col("k") == low["r3"], "x"))
    forged = seals.withColumn("sealed_at", F.when(F.col("k") == low["r20"], "x"))
    variants = [
        ("clean", leaves, seals, []),
        ("edited leaf", edited, seals, []),
        ("edited seal", leaves, forged, []),
        ("deleted leaf", leaves.where(F.col("k") != low["r30"]), seals, []),
        ("odd handover", leaves, seals, [{"retiring_key_id": "a"}]),
    ]
    lines = lambda df: df.select(F.to_json(F.struct(*(c for c in df.columns if c != "k"))).alias("value"))
    out = None
    for name, some, sealed, rotations in variants:
        made = evidence.verify_bundle(lines(some), lines(sealed), rotations=rotations)
        made = made.select(F.lit(name).alias("variant"), "ok", "leaves_checked", "seals_checked", "first_bad_seq", "error", "attestation")
        out = made if out is None else out.unionByName(made)
    leaves.unpersist()
    seals.unpersist()
    return out


@query(
    """
SELECT DISTINCT 'k' || (o_custkey % 50) AS signer_key_id FROM orders WHERE o_custkey % 50 >= 40
"""
)
def unexplained_keys(spark, sf_dir):
    leaves = table(spark, sf_dir, "orders").select(F.concat(F.lit("k"), (F.col("o_custkey") % 50).cast("string")).alias("signer_key_id"))
    keys = spark.range(40).select(F.concat(F.lit("k"), F.col("id").cast("string")).alias("key_id"))
    return evidence.unexplained_keys(leaves, leaves.limit(0), keys)


@query(
    """
SELECT o_orderkey FROM orders WHERE NOT (o_custkey % 5 < 4 AND year(o_orderdate) = 1992 + o_custkey % 5)
"""
)
def cert_interval_cover(spark, sf_dir):
    leaves = table(spark, sf_dir, "orders").select(
        "o_orderkey", F.concat(F.lit("k"), (F.col("o_custkey") % 5).cast("string")).alias("signer_key_id"), F.col("o_orderdate").alias("created_at")
    )
    rows = [(f"k{i}", f"{1992 + i}-01-01 00:00:00", f"{1992 + i}-12-31 23:59:59.999999") for i in range(4)]
    certs = spark.createDataFrame(rows, "key_id string, a string, b string")
    certs = certs.select("key_id", F.col("a").cast("timestamp_ntz").alias("not_before"), F.col("b").cast("timestamp_ntz").alias("not_after"))
    return evidence.certificate_cover(leaves, certs).select("o_orderkey")


# --- usage ----------------------------------------------------------------------------------------------------

_ANCHORS = "SELECT o_orderkey AS last_seq, o_orderkey * 3 AS billable_through FROM orders WHERE o_orderkey % 11 = 3"


def _anchors(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").where("o_orderkey % 11 = 3")
    return orders.select(F.col("o_orderkey").alias("last_seq"), (F.col("o_orderkey") * 3).alias("billable_through"))


@query(
    f"""
WITH a AS ({_ANCHORS})
SELECT CASE WHEN count(*) FILTER (WHERE last_seq BETWEEN 99 AND 900) >= 2 THEN
         max(billable_through) FILTER (WHERE last_seq BETWEEN 99 AND 900) - min(billable_through) FILTER (WHERE last_seq BETWEEN 99 AND 900) END AS lower,
       min(billable_through) FILTER (WHERE last_seq >= 900) - max(billable_through) FILTER (WHERE last_seq <= 99) AS upper FROM a
"""
)
def usage_bounds(spark, sf_dir):
    return usage.usage_bounds(_anchors(spark, sf_dir), 100, 900)


_PROOF = """
p AS (SELECT row_number() OVER (ORDER BY g) AS pos, 's' || g AS seal_id, g * 10 AS first_seq, g * 10 + 9 AS last_seq, g % 11 AS billable,
      'h' || g AS seal_hash, CASE WHEN g % 50 = 3 THEN 'x' ELSE 'h' || lag(g) OVER (ORDER BY g) END AS prev_seal_hash
      FROM (SELECT DISTINCT o_orderkey // 10 AS g FROM orders))
"""


def _proof(spark, sf_dir):
    groups = table(spark, sf_dir, "orders").select(F.floor(F.col("o_orderkey") / 10).cast("long").alias("g")).distinct()
    rows = _ranked(groups, "g", "r").withColumn("pos", F.col("r") + 1)
    before = rows.select((F.col("pos") + 1).alias("pos"), F.concat(F.lit("h"), F.col("g").cast("string")).alias("before"))
    return rows.join(before, "pos", "left").select(
        "pos", F.concat(F.lit("s"), F.col("g").cast("string")).alias("seal_id"), (F.col("g") * 10).alias("first_seq"),
        (F.col("g") * 10 + 9).alias("last_seq"), (F.col("g") % 11).alias("billable"),
        F.concat(F.lit("h"), F.col("g").cast("string")).alias("seal_hash"),
        F.when(F.col("g") % 50 == 3, "x").otherwise(F.col("before")).alias("prev_seal_hash"),
    )


@query(f"WITH {_PROOF} SELECT pos, seal_id, 4 AS \"check\" FROM p WHERE pos > 1 AND prev_seal_hash = 'x'")
def continuity_failures(spark, sf_dir):
    return usage.continuity_failures(_proof(spark, sf_dir)).select("pos", "seal_id", "check")


@query(
    f"WITH {_PROOF}, b AS (SELECT min(pos) FILTER (WHERE pos > 1 AND prev_seal_hash = 'x') AS bad, sum(billable)::BIGINT AS n FROM p) "
    "SELECT bad IS NULL AS ok, CASE WHEN bad IS NOT NULL THEN 'seal does not link to the one before' END AS error, "
    "CASE WHEN bad IS NULL THEN n ELSE 0 END AS billable FROM b"
)
def continuity_check(spark, sf_dir):
    seals = _proof(spark, sf_dir)
    first, last = seals.agg(F.min("first_seq"), F.max("last_seq")).first()
    return usage.continuity(seals, first, last)


@query(
    f"""
WITH a AS ({_ANCHORS})
SELECT 1::BIGINT AS chain, o_orderkey AS start_seq, last_seq, billable_through
FROM (SELECT DISTINCT o_orderkey FROM orders) ASOF LEFT JOIN (SELECT DISTINCT last_seq, billable_through FROM a) AS a ON o_orderkey >= a.last_seq
"""
)
def anchor_as_of(spark, sf_dir):
    starts = table(spark, sf_dir, "orders").select(F.lit(1).cast("long").alias("chain"), F.col("o_orderkey").alias("start_seq")).distinct()
    anchors = _anchors(spark, sf_dir).select(F.lit(1).cast("long").alias("chain"), "last_seq", "billable_through").distinct()
    return usage.anchor_before(starts, anchors)
