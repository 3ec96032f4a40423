"""Main-text extraction by a linear-chain conditional random field over DOM leaf blocks.

A page becomes the sequence of its leaf blocks (text between block-level
boundaries, inline markup joined). Each block has features of its ancestors'
tags and class words and of its text; the field scores content against
boilerplate with transitions between neighbouring blocks, is trained by
maximum likelihood on labelled pages and decoded by Viterbi. The labelled pages
are made here from varied layouts with invented words, so that nothing of a
corpus is needed for the fit; ``train`` takes any other labelled blocks as well.

Defined cases: null or empty html gives the empty text; markup that never ends
is read as far as it goes; repeated rows are extracted each; an empty table
gives no rows; an input column named like an output column is replaced by it.
"""

from __future__ import annotations

import functools
import html as entities
import random
import re
from collections import Counter, defaultdict
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .common import extend

#: A comment, a tag with its attributes or other markup, each as far as the page's end if it never ends. A quote is
#: one only as the start of an attribute's value. Nothing is read twice: repetitions are possessive.
TAG = re.compile(
    r"""<!--.*?(?:-->|\Z)
    |<(/?)([a-zA-Z][^\s/>]*+)
      ((?:[\s/]++|(?:=[^\s/>=]*+|[^\s/>=]++)(?:\s*+=\s*+(?:"[^"]*+(?:"|\Z)|'[^']*+(?:'|\Z)|(?=>)|[^\s>"'][^\s>]*+))?+)*+)(?:>|\Z)
    |<(?:[!?]|/(?=[^a-zA-Z]))[^>]*+(?:>|\Z)""",
    re.DOTALL | re.VERBOSE,
)
NAMED = re.compile(r"(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.IGNORECASE)
WORDS = re.compile(r"[a-z]+")

#: HTML's void elements, inline elements, elements whose text is not the page's, and those that end an open one of their kind.
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
INLINE = set(
    "a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp small "
    "span strike strong sub sup time tt u var wbr".split()
)
UNSEEN = set("script style noscript template svg math head title iframe object canvas".split())
RAW = set("script style noscript template iframe title textarea svg math".split())
ENDS = {
    "li": {"li"},
    "dt": {"dt", "dd"},
    "dd": {"dt", "dd"},
    "tr": {"tr", "td", "th"},
    "td": {"td", "th"},
    "th": {"td", "th"},
    "option": {"option"},
}
#: What an optional end tag does not reach across.
FENCE = {"ul", "ol", "dl", "table", "div", "article", "section", "body", "main", "aside", "nav", "form"}


@dataclass
class Block:
    text: str
    path: tuple[str, ...]  # distinct steps "tag" or "tag.word.word" from the outside in, then the innermost one
    linked: int  # characters inside links


def blocks(page: str) -> list[Block]:
    """Leaf blocks of a whole page, in order."""
    out: list[Block] = []
    stack: list[tuple[str, str]] = []
    steps: dict[str, int] = {}  # of the stack, each with how often it is there
    tags: Counter[str] = Counter()
    pieces: list[str] = []
    linked = at = 0

    def path() -> tuple[str, ...]:
        """The distinct steps from the outside in, and at the end the innermost one."""
        return (*steps, stack[-1][1]) if stack else ()

    def flush():
        nonlocal linked
        if pieces:
            text = " ".join(entities.unescape("".join(pieces)).split())
            if text:
                out.append(Block(text, path(), linked))
            pieces.clear()
        linked = 0

    def say(text: str):
        nonlocal linked
        if text:
            pieces.append(text)
            if tags["a"]:
                linked += len(text.strip())

    def close(upto: int):
        if any(t not in INLINE for t, _ in stack[upto:]):
            flush()
        for tag, step in stack[upto:]:
            tags[tag] -= 1
            steps[step] -= 1
            if not steps[step]:
                del steps[step]
        del stack[upto:]

    while m := TAG.search(page, at):
        say(page[at : m.start()])
        at = m.end()
        tag = m[2]
        if tag is None or page[at - 1] != ">":
            continue
        tag = tag.lower()
        if m[1]:
            if tags[tag]:
                close(next(k for k in range(len(stack) - 1, -1, -1) if stack[k][0] == tag))
            continue
        if tag == "br":
            pieces.append(" ")
            continue
        if tag in RAW and not m[3].endswith("/"):
            end = re.compile(rf"</{tag}\b[^>]*>?", re.IGNORECASE).search(page, at)
            stop = end.start() if end else len(page)
            if tag not in UNSEEN:
                flush()
                out += [Block(t, (*steps, tag), 0) for t in [" ".join(page[at:stop].split())] if t]
            at = end.end() if end else len(page)
            continue
        if tag not in INLINE:
            ended = ENDS.get(tag)
            if tags["p"] or (ended and any(tags[t] for t in ended)):
                for k in range(len(stack) - 1, -1, -1):
                    if stack[k][0] == "p" or (ended and stack[k][0] in ended):
                        close(k)
                        if not ended:
                            break
                    elif stack[k][0] in FENCE:
                        break
            flush()
        if tag not in VOID and not (m[3].endswith("/") and tag in INLINE):
            words = [w for g in NAMED.findall(m[3]) for w in WORDS.findall("".join(g).lower())] if m[3] else []
            step = ".".join([tag, *words])
            stack.append((tag, step))
            steps[step] = steps.get(step, 0) + 1
            tags[tag] += 1
    say(page[at:])
    flush()
    return out


def path_features(path: tuple[str, ...]) -> list[str]:
    out = []
    for k, step in enumerate(path):
        tag, *words = step.split(".")
        if tag in ("html", "body"):
            continue
        out.append("in " + tag)
        out += ["named " + w for w in words]
        if k == len(path) - 1:
            out.append("at " + tag)
    return list(dict.fromkeys(out))


def text_features(b: Block) -> list[str]:
    n = len(b.text)
    words = b.text.count(" ") + 1
    return [
        f"words {min(words.bit_length(), 8)}",
        f"links {min(4, 4 * b.linked // max(n, 1))}",
        "stop" if b.text[-1] in ".!?…:;\"'»”" else "no stop",
        "sign" if "©" in b.text or "|" in b.text or "·" in b.text else "no sign",
    ]


@dataclass
class Field:
    weights: dict[str, float] = field(default_factory=dict)  # for content; boilerplate is at 0
    bias: float = 0.0
    steps: np.ndarray = field(default_factory=lambda: np.zeros((2, 2)))  # from, to
    ends: np.ndarray = field(default_factory=lambda: np.zeros((2, 2)))  # start and end, by label

    def __post_init__(self):
        self.paths: dict[tuple[str, ...], float] = {}

    def content(self, b: Block) -> float:
        known = self.paths.get(b.path)
        if known is None:
            if len(self.paths) > 100_000:
                self.paths.clear()
            known = self.paths[b.path] = self.bias + sum(self.weights.get(f, 0.0) for f in path_features(b.path))
        return known + sum(self.weights.get(f, 0.0) for f in text_features(b))

    def decode(self, found: list[Block]) -> list[int]:
        """The likeliest labels, by Viterbi."""
        if not found:
            return []
        (a00, a01), (a10, a11) = self.steps.tolist()
        (s0, s1), (e0, e1) = self.ends.tolist()
        back: list[tuple[int, int]] = []
        v0, v1 = s0, s1 + self.content(found[0])
        for b in found[1:]:
            to0 = (v0 + a00, 0) if v0 + a00 >= v1 + a10 else (v1 + a10, 1)
            to1 = (v0 + a01, 0) if v0 + a01 >= v1 + a11 else (v1 + a11, 1)
            back.append((to0[1], to1[1]))
            v0, v1 = to0[0], to1[0] + self.content(b)
        label = int(v1 + e1 > v0 + e0)
        out = [label]
        for step in reversed(back):
            label = step[label]
            out.append(label)
        return out[::-1]

    def text(self, page: str) -> str:
        found = blocks(page)
        return "\n".join(b.text for b, y in zip(found, self.decode(found)) if y)


def train(pages: list[tuple[list[Block], list[int]]], passes: int = 8, rate: float = 0.25, penalty: float = 2e-4, seed: int = 3) -> Field:
    """Maximum likelihood by forward-backward and adaptive gradient steps."""
    number: dict[str, int] = {}
    data = []
    for found, labels in pages:
        if found:
            rows = [[number.setdefault(f, len(number)) for f in path_features(b.path) + text_features(b)] for b in found]
            data.append((rows, np.array(labels)))
    w, g2 = np.zeros(len(number) + 1), np.full(len(number) + 1, 1e-2)
    steps, ends = np.zeros((2, 2)), np.zeros((2, 2))
    steps2, ends2 = np.full((2, 2), 1e-2), np.full((2, 2), 1e-2)
    order = random.Random(seed)
    for _ in range(passes):
        order.shuffle(data)
        for rows, y in data:
            n = len(rows)
            unary = np.zeros((n, 2))
            unary[:, 1] = [w[r].sum() + w[-1] for r in rows]
            f, b = np.zeros((n, 2)), np.zeros((n, 2))
            f[0] = ends[0] + unary[0]
            for t in range(1, n):
                f[t] = unary[t] + np.logaddexp(f[t - 1, 0] + steps[0], f[t - 1, 1] + steps[1])
            b[-1] = ends[1]
            for t in range(n - 2, -1, -1):
                nxt = unary[t + 1] + b[t + 1]
                b[t] = np.logaddexp(steps[:, 0] + nxt[0], steps[:, 1] + nxt[1])
            z = np.logaddexp(*(f[-1] + ends[1]))
            p = np.exp(f + b - z)
            off = y - p[:, 1]
            grad = defaultdict(float)
            for r, d in zip(rows, off):
                for k in r:
                    grad[k] += d
            at = np.fromiter(grad.keys(), int)
            g = np.fromiter(grad.values(), float) - penalty * w[at]
            g2[at] += g * g
            w[at] += rate * g / np.sqrt(g2[at])
            g = off.sum()
            g2[-1] += g * g
            w[-1] += rate * g / np.sqrt(g2[-1])
            gs = np.zeros((2, 2))
            for t in range(1, n):
                both = np.exp(f[t - 1][:, None] + steps + (unary[t] + b[t])[None, :] - z)
                gs -= both
                gs[y[t - 1], y[t]] += 1
            ge = -np.stack([p[0], p[-1]])
            ge[0, y[0]] += 1
            ge[1, y[-1]] += 1
            steps2 += gs * gs
            steps += rate * gs / np.sqrt(steps2)
            ends2 += ge * ge
            ends += rate * ge / np.sqrt(ends2)
    return Field({f: float(w[k]) for f, k in number.items()}, float(w[-1]), steps, ends)


# Labelled pages. Words that name parts of a layout, as authors use them in class and id.
CONTENT_NAMES = "content article post entry story text body main maintext postbody prose page single copy read".split()
NAMES = {
    "nav": "nav menu navbar navigation breadcrumb breadcrumbs topnav toc tabs links pagination".split(),
    "header": "header masthead topbar top logo branding siteheader hero head".split(),
    "footer": "footer foot bottom copyright colophon legal sitefooter".split(),
    "aside": "sidebar aside side rail widget related recommended trending more popular recent tags".split(),
    "ad": "ad ads advert advertisement banner sponsor sponsored promo promotion adsense advertising teaser".split(),
    "notice": "cookie cookies consent notice gdpr privacy alert popup modal newsletter subscribe paywall warning overlay".split(),
    "form": "form search login signup contact input".split(),
    "comments": "comment comments reply replies discussion disqus respond reader feedback thread responses".split(),
    "share": "share social sharing follow buttons meta byline author".split(),
}
OWN_TAGS = {"nav": ["nav"], "header": ["header"], "footer": ["footer"], "aside": ["aside"], "form": ["form"], "notice": ["dialog"]}


class Layout:
    """One invented page: html and, per leaf block, whether it is content."""

    def __init__(self, seed: int):
        self.r = random.Random(seed)
        self.labels: list[int] = []

    def words(self, low: int, high: int) -> str:
        r = self.r
        made = ["".join(r.choice("aeioubdlmnrstk") for _ in range(r.randint(2, 9))) for _ in range(r.randint(low, high))]
        end = r.choice([".", ".", ".", "", "!", "?"]) if len(made) > 3 else r.choice(["", "", "."])
        return (" ".join(made) + end).capitalize()

    def block(self, tag: str, label: int, low: int, high: int, link: bool = False, before: str = "") -> str:
        self.labels.append(label)
        text = self.words(low, high)
        if link:
            text = f'<a href="/{self.r.randint(1, 99)}">{text}</a>'
        elif self.r.random() < 0.15:
            text = f"<b>{text}</b>"
        elif self.r.random() < 0.1:
            text = f"<b>{text}<br>"
        end = "" if tag == "p" and self.r.random() < 0.15 else f"</{tag}>"
        return f"{before}<{tag}>{text}{end}"

    def several(self, tag: str, label: int, count: tuple[int, int], low: int, high: int, link: float = 0.0) -> str:
        return "".join(self.block(tag, label, low, high, self.r.random() < link) for _ in range(self.r.randint(*count)))

    def box(self, kind: str, inside: str) -> str:
        r = self.r
        own = OWN_TAGS.get(kind, [])
        if own and r.random() < 0.6:
            tag = r.choice(own)
            named = r.random() < 0.3
        else:
            tag, named = r.choice(["div", "div", "section"]), True
        words = r.sample(NAMES[kind], r.randint(1, 2))
        attr = f' {r.choice(["class", "id", "class"])}="{r.choice(["-", "_", " "]).join(words)}"' if named else ""
        return f"<{tag}{attr}>{inside}</{tag}>"

    def boilerplate(self, kind: str) -> str:
        r = self.r
        if kind in ("nav", "share"):
            many = self.several("li", 0, (2, 8), 1, 3, 0.9)
            return self.box(kind, f"<ul>{many}</ul>")
        if kind == "comments":
            head = self.block("h3", 0, 1, 3) if r.random() < 0.6 else ""
            if r.random() < 0.4:
                many = "".join(f"<li>{self.block('p', 0, 3, 70)}</li>" for _ in range(r.randint(1, 5)))
                return self.box(kind, f"{head}<ul>{many}</ul>")
            return self.box(kind, head + self.several(r.choice(["p", "div"]), 0, (1, 6), 3, 90))
        if kind == "form":
            return self.box(kind, self.several(r.choice(["p", "div", "label", "button"]) if 0 else r.choice(["p", "div", "button"]), 0, (1, 4), 1, 6))
        if kind == "aside":
            head = self.block("h4", 0, 1, 4) if r.random() < 0.5 else ""
            many = self.several("li", 0, (2, 6), 2, 9, 0.8) if r.random() < 0.6 else self.several("p", 0, (1, 4), 4, 50, 0.3)
            return self.box(kind, f"{head}<ul>{many}</ul>" if "<li>" in many else head + many)
        if kind == "header":
            return self.box(kind, self.several(r.choice(["div", "p", "h2"]), 0, (1, 3), 1, 8, 0.4))
        long = 60 if kind in ("ad", "notice") else 25
        if r.random() < 0.5:
            self.labels.append(0)  # text of the box itself
            return self.box(kind, ("&copy; " if kind == "footer" and r.random() < 0.7 else "") + self.words(2, long))
        return self.box(kind, self.several("p", 0, (1, 3), 2, long, 0.2))

    def article(self) -> str:
        r = self.r
        out = [self.block("h1", 1, 1, 14)] if r.random() < 0.85 else []
        inner = ["ad", "aside", "share", "notice", "form", "nav", "comments"]
        for _ in range(r.randint(1, 9)):
            kind = r.random()
            if kind < 0.7:
                out.append(self.several("p", 1, (1, 4), 1, r.choice([6, 40, 160]), 0.03))
            elif kind < 0.78:
                out.append(self.block(r.choice(["h2", "h3", "h4"]), 1, 1, 8))
            elif kind < 0.84:
                out.append(f"<ul>{self.several('li', 1, (2, 5), 1, 18, 0.08)}</ul>")
            elif kind < 0.87:
                out.append(f"<blockquote>{self.block('p', 1, 3, 40)}</blockquote>")
            elif kind < 0.9:
                out.append("<table>" + "".join(f"<tr>{self.several('td', 1, (2, 3), 1, 4)}</tr>" for _ in range(r.randint(1, 3))) + "</table>")
            elif kind < 0.92:
                out.append(self.block("pre", 1, 2, 20))
            else:
                out.append(self.boilerplate(r.choice(inner)))
        if r.random() < 0.2:
            out.append(self.boilerplate("comments"))
        body = "".join(out)
        if r.random() < 0.3:
            body = f"<div>{body}</div>"
        style = r.random()
        if style < 0.4:
            return f"<article>{body}</article>"
        if style < 0.55:
            return f"<main>{body}</main>"
        name = r.choice(["-", "_", " "]).join(r.sample(CONTENT_NAMES, r.randint(1, 2)))
        tag = r.choice(["div", "div", "section", "article", "main"])
        return f'<{tag} {r.choice(["class", "id"])}="{name}">{body}</{tag}>'

    def page(self) -> tuple[str, list[int]]:
        r = self.r
        parts = []
        for kind in ("header", "nav", "notice", "ad", "form", "aside"):
            if r.random() < 0.45:
                parts.append(self.boilerplate(kind))
        parts.append(self.article())
        for kind in ("share", "comments", "aside", "ad", "form", "notice", "nav", "footer"):
            if r.random() < (0.8 if kind == "footer" else 0.35):
                parts.append(self.boilerplate(kind))
        head = "<head><title>t</title><style>p{}</style><script>var t=\"</p>\";</script></head>"
        return f"<!DOCTYPE html><html>{head}<body>{'<!-- x -->'.join(parts)}</body></html>", self.labels


def labelled_pages(count: int = 500, seed: int = 11) -> list[tuple[list[Block], list[int]]]:
    out = []
    for k in range(count):
        page, labels = Layout(seed * 100_000 + k).page()
        found = blocks(page)
        if len(found) == len(labels):
            out.append((found, labels))
    return out


@functools.lru_cache(maxsize=1)
def default_field() -> Field:
    return train(labelled_pages())


def extract(df: DataFrame, model: Field | None = None, html_col: str = "html", keep: list[str] | None = None) -> DataFrame:
    """Adds text and n_chars (code points)."""
    shared = df.sparkSession.sparkContext.broadcast(model or default_field())

    def run(pages: list[str]) -> dict:
        texts = [shared.value.text(x) for x in pages]
        return {"text": texts, "n_chars": list(map(len, texts))}

    return extend(df, html_col, run, [T.StructField("text", T.StringType()), T.StructField("n_chars", T.LongType())], keep)
