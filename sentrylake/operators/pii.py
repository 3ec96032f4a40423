"""Personal data: counts by detector, redaction, field-level minimisation."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import fixed_values as V
from ..functions.regex import all_matches, matches
from ..functions.severity import label_of, rank
from ..functions.text import present


def ssn(text: Column) -> Column:
    ok = lambda s: ~(F.left(s, F.lit(3)).isin("000", "666") | s.startswith("9") | (F.substring(s, 5, 2) == "00") | (F.right(s, F.lit(4)) == "0000"))
    return F.size(F.filter(all_matches(text, V.PII_SSN), ok))


def _digits(s: Column) -> Column:
    return F.regexp_replace(s, "[ -]", "")


def credit_card(text: Column) -> Column:
    """Luhn numbers of 13 to 19 ASCII digits that are not one repeated digit."""
    found = F.transform(all_matches(text, V.PII_CARD), _digits)
    ok = lambda d: d.rlike("^[0-9]{13,19}$") & ~d.rlike(r"^(.)\1*$") & F.call_function("luhn_check", d)
    return F.size(F.filter(found, ok))


def iban_valid(s: Column) -> Column:
    """ISO 13616: the rearranged number modulo 97 is 1, carried character by character."""
    moved = F.concat(F.substring(s, 5, 34), F.left(s, F.lit(4)))
    values = F.transform(F.split(moved, ""), lambda c: F.when(c.rlike("^[0-9]$"), F.ascii(c) - 48).otherwise(F.ascii(c) - 55))
    rest = F.aggregate(values, F.lit(0), lambda acc, v: (acc * F.when(v < 10, 10).otherwise(100) + v) % 97)
    return (F.length(s) >= 15) & (F.length(s) <= 34) & s.rlike("^[A-Z0-9]+$") & (rest == 1)


def iban(text: Column) -> Column:
    return F.size(F.filter(all_matches(text, V.PII_IBAN), iban_valid))


def uk_nino(text: Column) -> Column:
    prefix = lambda s: F.upper(F.left(s, F.lit(2)))
    return F.size(F.filter(all_matches(text, V.PII_NINO, "i"), lambda s: ~prefix(s).isin(*V.PII_NINO_NEVER) & (F.right(prefix(s), F.lit(1)) != "O")))


def ip_address(text: Column) -> Column:
    return F.size(F.filter(all_matches(text, V.PII_IPV4), lambda s: (s != "0.0.0.0") & ~s.startswith("127.")))


def distinct_emails(text: Column) -> Column:
    return F.size(F.array_distinct(F.transform(all_matches(text, V.PII_EMAIL), F.lower)))


def distinct_phones(text: Column) -> Column:
    found = F.array_distinct(F.transform(all_matches(text, V.PII_PHONE), lambda s: F.regexp_replace(s, r"(?U)\D", "")))
    return F.size(F.filter(found, lambda d: F.length(d).between(7, 15)))


def _bulk(n: Column) -> Column:
    return F.when(n >= V.PII_BULK, n).otherwise(0)


def detectors(text: Column) -> dict[str, Column]:
    """Counts by detector, in the order of the severity table."""
    return {
        "ssn": ssn(text),
        "credit_card": credit_card(text),
        "iban": iban(text),
        "uk_nino": uk_nino(text),
        "passport": F.size(all_matches(text, V.PII_PASSPORT, "i")),
        "dob": F.size(all_matches(text, V.PII_DOB, "i")),
        "ip_address": ip_address(text),
        "email_bulk": _bulk(distinct_emails(text)),
        "phone_bulk": _bulk(distinct_phones(text)),
        "secrets": matches(text, V.SECRET_BODY, "i").cast("int"),
    }


def scan(text: Column) -> Column:
    """Map of non-zero counts; empty for null and blank text."""
    shown = present(text)
    pairs = [x for name, n in detectors(shown).items() for x in (F.lit(name), n)]
    return F.map_filter(F.create_map(*pairs), lambda _, n: n > 0)


def worst(counts: Column) -> Column:
    """Highest severity of the detectors present; unknown detectors are low."""
    table = F.create_map(*(x for k, v in V.PII_SEVERITY.items() for x in (F.lit(k), F.lit(rank(v)))))
    ranks = F.transform(F.map_keys(counts), lambda k: F.coalesce(F.try_element_at(table, k), F.lit(1)))
    return label_of(F.coalesce(F.array_max(ranks), F.lit(0)))


# --- redaction: replacing only what validates needs a callback, so this runs in Arrow batches -------

_SSN, _CARD, _IBAN = re.compile(V.PII_SSN), re.compile(V.PII_CARD), re.compile(V.PII_IBAN)
_NINO = re.compile(V.PII_NINO, re.IGNORECASE)


def luhn(digits: str) -> bool:
    if not (digits.isdigit() and 13 <= len(digits) <= 19):
        return False
    odd = sum(int(c) for c in digits[-1::-2])
    return (odd + sum(sum(divmod(2 * int(c), 10)) for c in digits[-2::-2])) % 10 == 0


def _valid(kind: str, found: re.Match) -> bool:
    s = found.group(0)
    if kind == "ssn":
        area, group, serial = found.groups()
        return not (area in ("000", "666") or area[0] == "9" or group == "00" or serial == "0000")
    if kind == "credit_card":
        digits = re.sub("[ -]", "", s)
        return len(set(digits)) > 1 and luhn(digits)
    if kind == "iban":
        return 15 <= len(s) <= 34 and int("".join(str(int(c, 36)) for c in s[4:] + s[:4])) % 97 == 1
    prefix = found.group(1).upper()
    return prefix not in V.PII_NINO_NEVER and prefix[1] != "O"


REDACTIONS = [("ssn", _SSN, "[REDACTED-SSN]"), ("credit_card", _CARD, "[REDACTED-CARD]"), ("iban", _IBAN, "[REDACTED-IBAN]"), ("uk_nino", _NINO, "[REDACTED-NINO]")]


def redact_one(text: str | None) -> tuple[str, dict[str, int]]:
    """One text with valid identifiers replaced, and their counts."""
    out, counts = text or "", {}
    for kind, pattern, token in REDACTIONS:

        def swap(found: re.Match, kind=kind, token=token) -> str:
            if not _valid(kind, found):
                return found.group(0)
            counts[kind] = counts.get(kind, 0) + 1
            return token

        out = pattern.sub(swap, out)
    return out, counts


def _redact(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
    for series in texts:
        made = [redact_one(x) for x in series]
        yield pd.DataFrame({"text": [t for t, _ in made], "counts": [c for _, c in made]})


def redact(text: Column) -> Column:
    """struct<text, counts>; null counts as empty."""
    return F.pandas_udf(_redact, "text string, counts map<string,int>")(text.cast("string"))


def python_text(df: DataFrame, name: str) -> Column:
    """A column's text as Python's str gives it for the types a record may have."""
    kind = df.schema[name].dataType.simpleString()
    c = F.col(name)
    if kind == "boolean":
        shown = F.when(c, "True").otherwise("False")
    elif kind in ("double", "float"):
        shown = F.regexp_replace(c.cast("string"), "E(-?)([0-9]+)$", "e$1$2")
    else:
        shown = c.cast("string")
    return F.coalesce(shown, F.lit("None"))


def minimise(df: DataFrame, policy: dict[str, str], default: str = "keep") -> DataFrame:
    """Columns dropped, hashed, redacted or truncated by policy, with the applied actions as a map.

    Actions: drop, hash, redact, truncate:N, keep; unknown ones keep. An action is
    listed only where it changed the row (drop and hash always do).
    """
    out, applied = [], []
    kinds = {f.name: f.dataType.simpleString() for f in df.schema.fields}
    for name in df.columns:
        action = policy.get(name, default) or default
        column = F.col(name)
        if action == "drop":
            applied += [F.lit(name), F.lit("drop")]
        elif action == "hash":
            out.append(F.concat(F.lit("sha256:"), F.sha2(python_text(df, name).cast("binary"), 256)).alias(name))
            applied += [F.lit(name), F.lit("hash")]
        elif action == "redact" and kinds[name] == "string":
            done = redact(column)
            out.append(F.when(column.isNotNull(), done["text"]).alias(name))
            applied += [F.lit(name), F.when(F.size(F.map_keys(done["counts"])) > 0, "redact")]
        elif action.startswith("truncate:") and kinds[name] == "string" and re.fullmatch(r"\s*[+-]?\d+\s*", action[9:]):
            n = max(0, int(action[9:]))
            out.append(F.left(column, F.lit(n)).alias(name) if n else F.when(column.isNotNull(), "").alias(name))
            applied += [F.lit(name), F.when(F.length(column) > n, action)]
        else:
            out.append(column)
    done = F.map_filter(F.create_map(*applied), lambda _, v: v.isNotNull()) if applied else F.create_map().cast("map<string,string>")
    return df.select(*out, done.alias("applied"))
