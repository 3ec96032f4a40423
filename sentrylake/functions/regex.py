"""Regular expressions in the JVM's dialect with Python's meaning.

Rules are written in Python's syntax. The JVM needs Unicode classes, Unicode
case folding and newline-only line ends to agree, and its ``\\s`` lacks the four
separators U+001C to U+001F.

Many rules over one text are tried in two steps (``Rules``): most of them need
one of a few words, and looking for those in the case-folded text is far cheaper
than trying a case-blind expression at each of its places.
"""

from __future__ import annotations

import functools
import itertools
import re
from re import _constants as C
from re import _parser

from pyspark.sql import Column
from pyspark.sql import functions as F

_SPACE = re.compile(r"(?<!\\)((?:\\\\)*)\\s")


def java(pattern: str, flags: str = "") -> str:
    """``flags``: any of i, m, s."""
    names = "dU" + ("iu" if "i" in flags else "") + ("m" if "m" in flags else "") + ("s" if "s" in flags else "")
    return f"(?{names})" + _SPACE.sub(r"\1[\\s\\x1c-\\x1f]", pattern)


def checked(pattern: str, flags: str = "") -> str:
    """The JVM form of a caller's pattern; raises if it is no pattern."""
    re.compile(re.sub(r"\\x\{([0-9a-fA-F]+)\}", r"\\u\1", pattern))
    return java(pattern, flags)


def matches(text: Column, pattern: str, flags: str = "") -> Column:
    return text.rlike(java(pattern, flags))


def all_matches(text: Column, pattern: str, flags: str = "", group: int = 0) -> Column:
    return F.regexp_extract_all(text, F.lit(java(pattern, flags)), F.lit(group))


def first_match(text: Column, pattern: str, flags: str = "", group: int = 0) -> Column:
    return F.regexp_extract(text, java(pattern, flags), group)


#: What Java's Unicode case folding takes for an ASCII letter besides A to Z.
_ODD_LETTERS = {"\u0130": "i", "\u0131": "i", "\u017f": "s", "\u212a": "k"}
#: Most words that stand for one expression, or that its parts are multiplied out to.
_MOST = 40


def folded(text: Column) -> Column:
    """The text with each character's case folded, place by place, such that an ASCII word is in it where Java finds it case-blind."""
    odd = text
    for letter, plain in _ODD_LETTERS.items():
        odd = F.replace(odd, F.lit(letter), F.lit(plain))
    return F.when(F.octet_length(text) == F.length(text), F.lower(text)).otherwise(F.lower(odd))


def _product(parts: list[list[str] | None]) -> list[str] | None:
    out = [""]
    for words in parts:
        if words is None or len(out) * len(words) > _MOST:
            return None
        out = [a + b for a, b in itertools.product(out, words)]
    return out


def _strings(op, arg) -> list[str] | None:
    """All strings that a node of an expression stands for, if they are few."""
    if op is C.LITERAL:
        return [chr(arg).lower()] if arg < 128 else None
    if op is C.IN and all(o is C.LITERAL and a < 128 for o, a in arg):
        return sorted({chr(a).lower() for _, a in arg})
    if op is C.SUBPATTERN and not arg[1] and not arg[2]:
        return _product([_strings(*x) for x in arg[3]])
    if op is C.BRANCH:
        found = [_product([_strings(*x) for x in branch]) for branch in arg[1]]
        return None if None in found else sorted({w for words in found for w in words})
    if op is C.MAX_REPEAT and arg[0] in (0, 1) and arg[1] == 1:
        one = _product([_strings(*x) for x in arg[2]])
        return one if one is None or arg[0] else ["", *one]
    return None


def _needed(nodes) -> list[str] | None:
    """Words one of which is in every match of a sequence of nodes: the longest, then the fewest."""
    sets: list[list[str]] = []
    run: list[list[str]] = []
    for op, arg in [*nodes, (None, None)]:
        words = _strings(op, arg)
        grown = None if words is None else _product([*run, words])
        if grown is not None:
            run.append(words)
            continue
        if run:
            sets.append(_product(run))
        run = [words] if words is not None else []
        if words is not None:
            continue
        if op is C.SUBPATTERN and not arg[1] and not arg[2]:
            sets.append(_needed(arg[3]) or [])
        elif op is C.BRANCH:
            found = [_needed(branch) for branch in arg[1]]
            sets.append([] if None in found else [w for words in found for w in words])
        elif op in (C.MAX_REPEAT, C.MIN_REPEAT) and arg[0]:
            sets.append(_needed(arg[2]) or [])
    usable = [_least(x) for x in sets if x and all(x)]
    return max(usable, key=lambda x: (min(4, *map(len, x), 4), -len(x)), default=None)


def _least(words: list[str]) -> list[str]:
    """Without words that hold another one."""
    return sorted(w for w in set(words) if not any(v != w and v in w for v in words))


@functools.lru_cache(maxsize=None)
def needed(pattern: str) -> tuple[tuple[str, ...] | None, bool]:
    """Lower-case ASCII words one of which is in each case-blind match (None: not known), and whether each of them is a match."""
    nodes = _parser.parse(pattern)
    whole = _product([_strings(*x) for x in nodes])
    if whole and all(whole):
        return tuple(_least(whole)), True
    words = _needed(nodes)
    return (tuple(words) if words else None), False


def _foldable(nodes) -> bool:
    """Whether lower-casing an expression's letters and its text leaves what it finds."""
    for op, arg in nodes:
        if op is C.LITERAL and arg < 128 or op in (C.ANY, C.AT):
            continue
        if op is C.IN and all((o is C.LITERAL and a < 128) or (o is C.CATEGORY and a in (C.CATEGORY_SPACE, C.CATEGORY_WORD, C.CATEGORY_DIGIT)) for o, a in arg):
            continue
        if op is C.SUBPATTERN and not arg[1] and not arg[2] and _foldable(arg[3]):
            continue
        if op is C.BRANCH and all(map(_foldable, arg[1])):
            continue
        if op in (C.MAX_REPEAT, C.MIN_REPEAT) and _foldable(arg[2]):
            continue
        return False
    return True


_LETTER = re.compile(r"(\\.)|([A-Z]+)")


def _list(words) -> Column:
    """A constant array, of few expressions however long it is."""
    return F.split(F.lit("\0".join(words)), "\0")


def _tree(words: list[str], first: bool = True) -> str:
    """An expression for the longest of the words that begins at a place, letter by letter."""
    heads = sorted({w[0] for w in words if w})
    ways = [re.escape(h) + _tree([w[1:] for w in words if w[:1] == h], False) for h in heads]
    if first:
        # Some letters are ruled out at once.
        some = [slice(k, k + 5) for k in range(0, len(heads), 5)]
        ways = [f"(?=[{''.join(map(re.escape, heads[k]))}])(?:{'|'.join(ways[k])})" for k in some]
    if not ways:
        return ""
    tree = ways[0] if len(ways) == 1 and "" not in words else f"(?:{'|'.join(ways)})"
    return tree + "?" * ("" in words)


class Rules:
    """Expressions (flags, pattern) that are all tried on the same texts.

    Case-blind ones see the folded text: first which of the words that any of
    them needs are there, then only those that may match, and those not at all
    that are nothing but words.
    """

    def __init__(self, rules: list[tuple[str, str]]):
        self.needs = {(f, p): needed(p) if "i" in f else (None, False) for f, p in rules}
        self.words = sorted({w for words, _ in self.needs.values() for w in words or ()})

    def there(self, fold: Column) -> Column:
        """Words in the folded text: at each place the longest that begins there."""
        if not self.words:
            return F.array().cast("array<string>")
        return F.regexp_extract_all(fold, F.lit(f"(?=({_tree(self.words)}))"), F.lit(1))

    def matches(self, text: Column, fold: Column, there: Column, pattern: str, flags: str = "") -> Column:
        words, whole = self.needs[flags, pattern]
        any_word = F.arrays_overlap(there, _list([v for v in self.words if v.startswith(words)])) if words else F.lit(True)
        if whole:
            return any_word
        if "i" in flags and _foldable(_parser.parse(pattern)):
            plain = _LETTER.sub(lambda m: m[1] or m[2].lower(), pattern)
            found = matches(fold, plain, flags.replace("i", ""))
        else:
            found = matches(text, pattern, flags)
        return F.when(any_word, found).otherwise(F.lit(False)) if words else found
