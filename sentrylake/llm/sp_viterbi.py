"""SentencePiece encoding and decoding by streaming Viterbi.

The lattice runs over positions; an arc is a vocabulary piece. For a BPE model
the best path is the one whose every prefix is itself the merge result of that
prefix: an arc from i to j survives only if its piece may follow the piece that
ended at i, so each position has one survivor and a backpointer. A window of
the longest piece's length is retained; as soon as the backpointers of all
positions in the window meet in one boundary, the ids before it are committed
and forgotten. Memory is bounded by the window and the uncommitted tail.

Pieces never cross from a visible character to a word mark, so texts are cut
there first and words are remembered in a bounded cache.

Defined cases: null and empty text have no ids; characters outside the
vocabulary become their UTF-8 bytes' pieces; an input column named like an
output column is replaced by it.
"""

from __future__ import annotations

import functools
import re
import struct
import zlib
from array import array
from collections.abc import Iterable, Iterator

from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .common import extend

MARK = "▁"
#: Cached words, and the longest that is cached.
CACHE, SHORT = 600_000, 64
#: Characters of text whose words are held at once.
BLOCK = 4_000_000


class BpeModel:
    """Pieces, scores and the merge rules of a BPE model with byte fallback."""

    def __init__(self, path: str):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        n = sp.get_piece_size()
        self.pieces = [sp.id_to_piece(i) for i in range(n)]
        self.special = {i for i in range(n) if sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i)}
        self.bytes = {int(self.pieces[i][3:5], 16): i for i in range(n) if sp.is_byte(i)}
        self.byte_of = {i: b for b, i in self.bytes.items()}
        self.spelling = [
            bytes([self.byte_of[i]]) if i in self.byte_of else b"" if i in self.special else p.encode().replace(MARK.encode(), b" ")
            for i, p in enumerate(self.pieces)
        ]
        plain = [i for i in range(n) if i not in self.special and i not in self.byte_of]
        self.id = {self.pieces[i]: i for i in plain}
        self.rank = {self.pieces[i]: struct.unpack("f", struct.pack("f", sp.get_score(i)))[0] for i in plain}
        self.longest = max(map(len, self.id), default=1)
        #: Pieces the merge loop makes from their own characters, and all suffixes of those.
        self.arcs = {p for p in self.id if len(p) == 1 or self.merged(p) == [p]}
        self.suffixes = {p[k:] for p in self.arcs for k in range(len(p))}
        self.follows: dict[tuple[str, str], bool] = {}
        self.words = WordCache(self)

    def merged(self, text: str) -> list[str]:
        """The plain merge loop, for one short string: the best-scored pair first, the leftmost of ties."""
        symbols = list(text)
        while len(symbols) > 1:
            pairs = [(self.rank[s], -i) for i in range(len(symbols) - 1) if (s := symbols[i] + symbols[i + 1]) in self.rank]
            if not pairs:
                break
            i = -max(pairs)[1]
            symbols[i : i + 2] = [symbols[i] + symbols[i + 1]]
        return symbols

    def may_follow(self, left: str, right: str) -> bool:
        """Whether merging the two pieces' characters gives exactly these two pieces."""
        known = self.follows.get((left, right))
        if known is None:
            if len(self.follows) > CACHE:
                self.follows.clear()
            known = self.follows[left, right] = self.merged(left + right) == [left, right]
        return known

    def ids(self, piece: str) -> list[int]:
        if (i := self.id.get(piece)) is not None:
            return [i]
        return [self.bytes[b] for b in piece.encode("utf-8", "surrogatepass")]


class WordCache(dict):
    """Words -> their ids as unsigned 32-bit numbers; short words stay, up to CACHE of them."""

    def __init__(self, m: BpeModel):
        self.m = m

    def __missing__(self, word: str) -> bytes:
        m = self.m
        pieces = short(m, word) if len(word) <= SHORT else viterbi(m, word)
        ids = array("I", (i for piece in pieces for i in m.ids(piece))).tobytes()
        if len(word) <= SHORT:
            if len(self) > CACHE:
                self.clear()
            self[word] = ids
        return ids


@functools.lru_cache(maxsize=2)
def model(path: str) -> BpeModel:
    return BpeModel(path)


def arrive(m: BpeModel, text: str, j: int, last: list) -> str:
    """The one piece that ends at j and may follow the survivor at its own start."""
    suffixes, arcs, follows = m.suffixes, m.arcs, m.follows
    for i in range(j - 1, -1, -1):
        piece = text[i:j]
        if piece in arcs:
            before = last[i]
            if before is None:
                return piece
            ok = follows.get((before, piece))
            if ok or (ok is None and m.may_follow(before, piece)):
                return piece
        elif piece not in suffixes:
            break
    return text[j - 1]  # a character outside the vocabulary


def short(m: BpeModel, word: str) -> list[str]:
    """The lattice of one short word, all of it within the window."""
    last: list[str | None] = [None]
    for j in range(1, len(word) + 1):
        last.append(arrive(m, word, j, last))
    out, end = [], len(word)
    while end:
        out.append(last[end])
        end -= len(last[end])
    return out[::-1]


def learn(m: BpeModel, words: set[str]) -> None:
    """Caches short words; sorted, they share the survivors of their common prefixes."""
    if len(m.words) + len(words) > CACHE:
        m.words.clear()
    before, last = "", [None]
    for word in sorted(words):
        same, most = 0, min(len(before), len(word))
        while same < most and before[same] == word[same]:
            same += 1
        del last[same + 1 :]
        for j in range(same + 1, len(word) + 1):
            last.append(arrive(m, word, j, last))
        before = word
        m.words[word] = array("I", [i for piece in path_to(last, len(word)) for i in m.ids(piece)]).tobytes()


def viterbi(m: BpeModel, chars: Iterable[str]) -> Iterator[str]:
    """Yields pieces of a stream of characters as soon as they are certain."""
    depth = m.longest
    window = ""  # characters since the committed boundary
    last: list[str | None] = [None]  # last[j]: the surviving piece that ends at j; at 0 the last committed one
    for c in chars:
        window += c
        j = len(window)
        at = max(0, j - depth)
        last.append(arrive(m, window[at:], j - at, last[at:] if at else last))
        if j >= 4 * depth:
            # Where do the paths from all positions an arc can still start from meet?
            ends = set(range(j - depth + 1, j + 1))
            while len(ends) > 1:
                far = max(ends)
                ends.discard(far)
                ends.add(far - len(last[far]))
            meet = ends.pop()
            if meet > 0:
                yield from path_to(last, meet)
                window, last = window[meet:], last[meet:]
    yield from path_to(last, len(window))


def path_to(last: list[str | None], end: int) -> list[str]:
    out = []
    while end > 0:
        out.append(last[end])
        end -= len(last[end])
    return out[::-1]


WORD = re.compile(f"{MARK}*[^{MARK}]+|{MARK}+")


def encode_all(m: BpeModel, texts: list[str]) -> Iterator[bytes]:
    """Each whole text's ids as unsigned 32-bit numbers, with the dummy prefix, without begin or end."""
    held, size = [], 0
    for text in texts:
        held.append(WORD.findall(MARK + text.replace(" ", MARK)) if text else [])
        size += len(text)
        if size > BLOCK:
            yield from _block(m, held)
            held, size = [], 0
    yield from _block(m, held)


def _block(m: BpeModel, held: list[list[str]]) -> Iterator[bytes]:
    learn(m, {w for w in set().union(*held) if len(w) <= SHORT and w not in m.words})
    for words in held:
        yield b"".join(map(m.words.__getitem__, words))


def encode(m: BpeModel, text: str) -> list[int]:
    return array("I", next(encode_all(m, [text]))).tolist()


def decode(m: BpeModel, ids: Iterable[int]) -> str:
    """The text of ids: bytes are joined, marks become spaces, the dummy prefix goes."""
    out = b"".join(map(m.spelling.__getitem__, ids))
    text = out.decode("utf-8", "replace")
    return text[1:] if text.startswith(" ") else text


def caches(path: str) -> tuple:
    return model(path).words, model(path).follows


def encode_column(df: DataFrame, model_path: str, text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """Adds ``ids`` array<int>."""

    def run(texts: list[str]) -> dict:
        m = model(model_path)
        return {"ids": [array("I", x).tolist() for x in encode_all(m, texts)]}

    return extend(df, text_col, run, [T.StructField("ids", T.ArrayType(T.IntegerType(), False))], keep, lambda: caches(model_path))


def digest_column(df: DataFrame, model_path: str, text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """Adds n_tokens, ids_crc32 (little-endian unsigned 32-bit ids) and whether decoding gives the text back."""
    def run(texts: list[str]) -> dict:
        m = model(model_path)
        n, crc, same = [], [], []
        for x, ids in zip(texts, encode_all(m, texts)):
            n.append(len(ids) // 4)
            crc.append(zlib.crc32(ids))
            same.append(decode(m, memoryview(ids).cast("I")) == x.replace(MARK, " "))
        return {"n_tokens": n, "ids_crc32": crc, "round_trip": same}

    fields = [
        T.StructField("n_tokens", T.LongType()),
        T.StructField("ids_crc32", T.LongType()),
        T.StructField("round_trip", T.BooleanType()),
    ]
    return extend(df, text_col, run, fields, keep, lambda: caches(model_path))
