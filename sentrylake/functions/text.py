"""Text helpers shared by the operators."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .fixed_values import PREVIEW_CHARS, SCAN_BYTES

SPACE = r"(?U)[\s\x1c-\x1f]+"


def present(text: Column) -> Column:
    return F.coalesce(text.cast("string"), F.lit(""))


def let(value: Column, use) -> Column:
    """use(value), with the value computed once per row however often it is used.

    Without it the optimizer may copy a large expression into each of its uses.
    """
    return F.get(F.transform(F.array(value), use), F.lit(0))


def sha256(text: Column) -> Column:
    return F.sha2(present(text).cast("binary"), 256)


def strip(text: Column) -> Column:
    return F.regexp_replace(text, r"(?U)^[\s\x1c-\x1f]+|[\s\x1c-\x1f]+\z", "")


def collapse(text: Column) -> Column:
    """White space runs as one space, none at the ends."""
    return F.trim(F.regexp_replace(present(text), SPACE, " "))


def preview(text: Column, chars: int = PREVIEW_CHARS) -> Column:
    """White space collapsed, cut, with a mark if the raw text is longer."""
    raw = present(text)
    return F.concat(F.left(collapse(raw), F.lit(chars)), F.when(F.length(raw) > chars, "…").otherwise(""))


def scanned(text: Column, cap: int = SCAN_BYTES) -> Column:
    """The part of a payload that rules read: its first bytes, without a cut character's rest."""
    raw = present(text)
    head = F.make_valid_utf8(F.substring(raw.cast("binary"), 1, cap))
    return F.when(F.octet_length(raw) <= cap, raw).otherwise(F.regexp_replace(head, "\ufffd+\\z", ""))


def wrap_untrusted(label: Column, text: Column) -> Column:
    """Delimiters around untrusted content."""
    name = F.translate(strip(F.when(present(label) == "", "external").otherwise(present(label))), '"', "'")
    body = F.regexp_replace(present(text), r"(?U)[\s\x1c-\x1f]+\z", "")
    return F.concat(F.lit('<untrusted source="'), name, F.lit('">\n'), body, F.lit("\n</untrusted>"))
