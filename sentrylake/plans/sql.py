"""DuckDB expressions for the rules: what RE2 can say of them."""

from __future__ import annotations

from ..functions import fixed_values as V
from ..functions.severity import ORDER, rank
from .seeds import quoted

#: Rules with look-around, which RE2 lacks, as two conditions; exact for one statement per payload.
LOOKAROUND = {
    "sql.delete_no_where": (
        r"(?i)\bDELETE\s+FROM\s+\w[\w\.\"]*\s*(?:;|$|RETURNING\b)", r"(?is)\bDELETE\s+FROM\s.*\bWHERE\b",
    ),
    "sql.update_no_where": (r"(?is)\bUPDATE\s+\w[\w\.\"]*\s+SET\b.*?(?:;|$)", r"(?is)\bUPDATE\s.*\bWHERE\b"),
    "git.push_force": (r"(?i)\bgit\s+push\b[^\n;|&]*?(?:--force(?:[^-]|$)|-f\b)", r"(?i)--force-with-lease"),
}


def match(text: str, pattern: str, flags: str = "") -> str:
    names = "".join(f for f in "ims" if f in flags)
    return f"regexp_matches({text}, {quoted((f'(?{names})' if names else '') + pattern)})"


def severity_label(ordinal: str) -> str:
    return f"[{', '.join(map(quoted, ORDER))}][{ordinal} + 1]"


def injection_list(text: str = "t", canaries: list[str] | None = None) -> str:
    """A list of findings in check order, without base64 payloads."""
    items, order = [], 0
    for kind, prefix, threat, confidence, flags, patterns in V.INJECTION_FAMILIES:
        if flags in ("base64", "canary"):
            for token in canaries or [] if flags == "canary" else []:
                cond = f"contains(lower({text}), {quoted(token.lower())})"
                items.append(f"CASE WHEN {cond} THEN {{'type': {quoted(kind)}, 'threat': {rank(threat)}, 'conf': {confidence}::DOUBLE, 'ord': {order}}} END")
            order += 1
            continue
        for pattern in patterns:
            cond = match(text, pattern, "" if flags == "fixed_label" else flags)
            items.append(f"CASE WHEN {cond} THEN {{'type': {quoted(kind)}, 'threat': {rank(threat)}, 'conf': {confidence}::DOUBLE, 'ord': {order}}} END")
            order += 1
    return f"list_filter([{', '.join(items)}], lambda x: x IS NOT NULL)"


def kept_list(found: str, preset: str) -> str:
    least, threat = V.SENSITIVITY[preset]
    return f"list_filter({found}, lambda x: x.conf >= {least} AND x.threat >= {rank(threat)})"


def worst_of(found: str) -> str:
    """The first finding with the highest threat, as a struct with threat and type."""
    return f"list_sort(list_transform({found}, lambda x: {{'a': -x.threat, 'b': x.ord, 'type': x.type}}))[1]"


def action_condition(rule_id: str, flags: str, pattern: str, text: str = "t") -> str:
    if rule_id in LOOKAROUND:
        yes, no = LOOKAROUND[rule_id]
        return f"(regexp_matches({text}, {quoted(yes)}) AND NOT regexp_matches({text}, {quoted(no)}))"
    return match(text, pattern, flags)


def action_list(text: str = "t") -> str:
    items = [
        f"CASE WHEN {action_condition(i, flags, p, text)} THEN {{'rule_id': {quoted(i)}, 'sev': {rank(s)}, 'ord': {k}}} END"
        for k, (i, _, s, flags, p) in enumerate(V.ACTION_RULES)
    ]
    return f"list_filter([{', '.join(items)}], lambda x: x IS NOT NULL)"


def vector_rows(text: str = "t") -> str:
    """A list of structs (pos, vector_id, owasp, severity, matched, required)."""
    items = []
    for pos, (vector, _, owasp, severity, least, patterns) in enumerate(V.GRADING_VECTORS):
        n = " + ".join(f"{match(text, p, flags)}::INT" for flags, p in patterns)
        items.append(
            f"{{'pos': {pos}, 'vector_id': {quoted(vector)}, 'owasp': {quoted(owasp)}, 'severity': {quoted(severity)}, "
            f"'matched': {n}, 'required': {least}}}"
        )
    return f"[{', '.join(items)}]"


def grade_case(score: str) -> str:
    return "CASE " + " ".join(f"WHEN {score} >= {least} THEN {quoted(g)}" for g, least in V.GRADES) + " END"


def conduct_id(text: str = "t") -> str:
    profane, client, directed = (match(text, p, "i") for p in (V.CONDUCT_PROFANITY, V.CONDUCT_CLIENT, V.CONDUCT_DIRECTED))
    return (
        f"CASE WHEN {profane} AND ({client} OR {directed}) THEN {quoted(V.CONDUCT_RULES[0][0])} "
        f"WHEN {directed} THEN {quoted(V.CONDUCT_RULES[1][0])} END"
    )
