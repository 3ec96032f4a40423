"""Language-model scores by online logistic context mixing.

A text is its lower-cased (A-Z) words, then an end. Each token is coded by
decision bits, each of them predicted under several hashed contexts whose
predictions are mixed in the logistic domain by gated weights:

* repeat: does the token follow its predecessor as before in this document;
* cache: is it one of the document's tokens so far;
* pair: does it follow its predecessor as in the training texts;
* new: is it a token that training never met. Such a word is spelled bit by
  bit, mixing hashed contexts of its bytes (the last four, three and two) by
  weights gated by their evidence; a map from the contexts' predictions to what
  became of them refines the mixture.

The first three are hidden (a token may come by either way), so a token's
probability is the sum over the ways, each with the share of the counts it
stands on. A document starts from the corpus's predictions and the same
weights; along it the weights follow the gradient of its log probability, span
by span (spans double), each span being predicted before it is learned. Total
bits over bytes is the result.

What is learned are counts over all training texts: of tokens and of pairs of
tokens (tables that grow with the input), of the decisions under each context,
and of the bits of words met once, which stand for new ones, each occurrence
left out of its own prediction. All are sums of integers, so the result does
not depend on how rows are partitioned. Tokens and pairs are 64-bit hashes,
pairs cut to 32 bits within a page. Units of texts send their distinct ones to
pages of the hash range, and each page sends the sums back: no table is
collected, broadcast or probed from afar, and no key is hot, since a unit sends
each key once.

Defined cases: null text is empty and consists of the end alone; a null doc_id
is never trained on and never held out; without training rows each token is new
by half, each bit of it a half and N is 0; repeated rows count each; an empty
table gives no rows; other input columns are ignored, whatever their names.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import batches_of, discard, hold, materialise, release, row_key, split_off

END = b"\n"
_LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")
K1, K2, K3 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0xD6E8FEB86659FD93)
#: The hash that stands before a text's first token.
START = np.uint64(0xA0761D6478BD642F)
#: Characters of a unit and of a block that is scored at once; bytes of text per page.
UNIT, BLOCK, PAGE_TEXT = 6_000_000, 2_000_000, 8 << 20
#: Rows that a task gets at once: texts, a unit's keys of a page, a unit or counts or a block of documents.
TEXT_ROWS, KEY_ROWS, LARGE_ROWS = 2000, 64, 4

# --- units and pages ---------------------------------------------------------------------------------


class Numbers(dict):
    """Words -> numbers in order of first sight; the end is 0."""

    def __init__(self):
        super().__init__({END: 0})

    def __missing__(self, word: bytes) -> int:
        self[word] = n = len(self)
        return n


@dataclass
class Block:
    """Whole documents: the distinct words, the number of each token, and each document's tokens."""

    words: list[bytes]
    ids: np.ndarray
    sizes: np.ndarray

    @property
    def first(self) -> np.ndarray:
        return np.concatenate([[0], np.cumsum(self.sizes)[:-1]]).astype(np.int64)

    def hashes(self) -> np.ndarray:
        return np.fromiter(map(xxhash.xxh64_intdigest, self.words), dtype=np.uint64, count=len(self.words))

    def pairs(self, hashes: np.ndarray) -> np.ndarray:
        """A hash of each token with the one before it."""
        own = hashes[self.ids]
        before = np.empty_like(own)
        before[1:] = own[:-1]
        before[self.first] = START
        return mixed(before * K1 + own * K3)


def read(texts: list[str]) -> Block:
    numbers = Numbers()
    parts, sizes = [], []
    for text in texts:
        found = text.encode("utf-8", "replace").translate(_LOWER).split()
        parts.append(np.fromiter(map(numbers.__getitem__, found), dtype=np.int32, count=len(found)))
        parts.append(np.zeros(1, np.int32))
        sizes.append(len(found) + 1)
    return Block(list(numbers), np.concatenate(parts), np.array(sizes, dtype=np.int64))


def mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(29))) * K2
    return h ^ (h >> np.uint64(32))


def planes(values: np.ndarray) -> bytes:
    """The values byte by byte: first all lowest bytes, and so on, which compress well."""
    return values.view(np.uint8).reshape(len(values), values.itemsize).T.tobytes()


def from_planes(data: bytes, kind: str) -> np.ndarray:
    size = np.dtype(kind).itemsize
    return np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(size, -1).T).reshape(-1).view(kind)


def tallied(keys: np.ndarray, trained: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct keys (below 2^63) and how often each occurs where ``trained``."""
    s = np.sort((keys << np.uint64(1)) | trained.astype(np.uint64))
    key = s >> np.uint64(1)
    at = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
    return key[at], np.add.reduceat((s & np.uint64(1)).astype(np.int64), at)


def pair_bits(page_bits: int) -> int:
    return 32 + page_bits


UNITS = "kind int, page int, unit long, n int, data binary"
_NAMES = ["kind", "page", "unit", "n", "data"]
#: Kinds of rows: a unit's texts, its tokens, its pairs.
TEXTS, TOKENS, PAIRS = 0, 1, 2


def _row(kind: int, page: int, unit: int, n: int, data: bytes) -> pa.RecordBatch:
    kinds = [pa.int32(), pa.int32(), pa.int64(), pa.int32(), pa.binary()]
    return pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip((kind, page, unit, n, data), kinds)], names=_NAMES)


def _paged(kind: int, keys: np.ndarray, counts: np.ndarray, bits: int, page_bits: int, unit: int) -> Iterator[pa.RecordBatch]:
    """One row for each page that holds some of the sorted keys of ``bits`` bits."""
    page = (keys >> np.uint64(bits - page_bits)).astype(np.int64)
    cuts = np.concatenate([[0], np.flatnonzero(page[1:] != page[:-1]) + 1, [len(page)]])
    out: list[list] = [[], [], [], [], []]
    for a, b in zip(cuts[:-1], cuts[1:]):
        gaps = np.diff(keys[a:b], prepend=np.uint64(0)) if kind == TOKENS else np.diff((keys[a:b] & np.uint64(0xFFFFFFFF)).astype("<u4"), prepend=np.uint32(0))
        for column, x in zip(out, (kind, int(page[a]), unit, int(b - a), planes(gaps) + planes(counts[a:b].astype("<u4")))):
            column.append(x)
    types = [pa.int32(), pa.int32(), pa.int64(), pa.int32(), pa.binary()]
    yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(out, types)], names=_NAMES)


def unit_rows(texts: list[str], rows: list, doc_ids: list, trained: list[bool], page_bits: int) -> Iterator[pa.RecordBatch]:
    """A unit's texts as numbers, and its distinct tokens and pairs, by page, with their training counts."""
    unit, block = rows[0], read(texts)
    learn = np.repeat(np.array(trained, bool), block.sizes)
    held = (
        b"\n".join(block.words[1:]),
        planes(block.ids),
        block.sizes,
        np.array(rows, dtype=np.int64),
        doc_ids,
        np.array(trained, bool),
        np.array([len(x) if x.isascii() else len(x.encode("utf-8", "replace")) for x in texts], dtype=np.int64),
    )
    yield _row(TEXTS, 0, unit, len(texts), pickle.dumps(held))
    hashes = block.hashes()
    keys, place = np.unique(hashes, return_inverse=True)
    counts = np.bincount(place, weights=np.bincount(block.ids[learn], minlength=len(hashes)), minlength=len(keys)).astype(np.int64)
    yield from _paged(TOKENS, keys, counts, 64, page_bits, unit)
    bits = pair_bits(page_bits)
    keys, counts = tallied(block.pairs(hashes) >> np.uint64(64 - bits), learn)
    yield from _paged(PAIRS, keys, counts, bits, page_bits, unit)


def _units(page_bits: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hold(__name__)
        held: list[list] = [[], [], [], []]
        size = 0
        for batch in batches:
            columns = [batch.column(i).to_pylist() for i in range(3)]
            for row, doc_id, learn, text in zip(*columns, batch.column(3)):
                text = text.as_py() or ""
                for column, x in zip(held, (text, row, doc_id, bool(learn))):
                    column.append(x)
                size += len(text)
                if size > UNIT:
                    yield from unit_rows(*held, page_bits)
                    held, size = [[], [], [], []], 0
        if held[0]:
            yield from unit_rows(*held, page_bits)
        release()

    return run


def _sum_pages(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows sorted by (kind, page): for each unit the sums of its keys, and a page's distinct keys, total and keys met once."""
    here, held = None, []

    def made() -> Iterator[pa.RecordBatch]:
        kind, page = here
        size = 8 if kind == TOKENS else 4
        keys = np.concatenate([np.cumsum(from_planes(d[: n * size], f"<u{size}"), dtype=f"<u{size}") for _, n, d in held])
        counts = np.concatenate([from_planes(d[n * size :], "<u4") for _, n, d in held])
        _, place = np.unique(keys, return_inverse=True)
        sums = np.bincount(place, weights=counts).astype("<u4")
        per_key = sums[place]
        cuts = np.cumsum([0, *(n for _, n, _ in held)])
        out = [[kind] * len(held), [page] * len(held), [u for u, _, _ in held], [n for _, n, _ in held], [planes(per_key[a:b]) for a, b in zip(cuts, cuts[1:])]]
        kinds = [pa.int32(), pa.int32(), pa.int64(), pa.int32(), pa.binary()]
        yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(out, kinds)], names=_NAMES)
        facts = np.array([np.count_nonzero(sums), sums.sum(dtype=np.int64), np.count_nonzero(sums == 1)], dtype=np.int64)
        yield _row(-kind, page, 0, 0, facts.tobytes())

    for batch in batches:
        columns = [batch.column(i).to_pylist() for i in range(4)]
        for kind, page, unit, n, data in zip(*columns, batch.column(4)):
            if (kind, page) != here:
                if held:
                    yield from made()
                here, held = (kind, page), []
            held.append((unit, n, data.as_py()))
    if held:
        yield from made()
    release()


@dataclass
class Known:
    """Documents with what training knows of them: n of each distinct word, of each token's pair, and of the ends."""

    block: Block
    rows: np.ndarray
    doc_ids: list
    trained: np.ndarray
    n_bytes: np.ndarray
    tokens: np.ndarray  # of each distinct word
    pairs: np.ndarray  # of each token with the one before it

    def parts(self) -> Iterator[Known]:
        """The same, some BLOCK characters at a time."""
        chars = np.cumsum(self.n_bytes)
        ends, at = np.cumsum(self.block.sizes), 0
        while at < len(self.rows):
            to = max(at + 1, int(np.searchsorted(chars, (chars[at - 1] if at else 0) + BLOCK)))
            low, high = (ends[at - 1] if at else 0), ends[to - 1]
            used, ids = np.unique(np.append(self.block.ids[low:high], 0), return_inverse=True)
            block = Block([self.block.words[i] for i in used], ids[:-1].astype(np.int32), self.block.sizes[at:to])
            cut = (x[at:to] for x in (self.rows, self.doc_ids, self.trained, self.n_bytes))
            yield Known(block, *cut, self.tokens[used], self.pairs[low:high])
            at = to


def _known(batches: Iterator[pa.RecordBatch], page_bits: int) -> Iterator[Known]:
    """Of rows sorted by (unit, kind, page): units with the sums that pages sent them."""
    here, held = None, []

    def made() -> Known:
        words, ids, sizes, *rest = pickle.loads(held[0][1])
        block = Block([END, *words.split(b"\n")] if words else [END], from_planes(ids, "<i4"), sizes)
        tokens, pairs = (np.concatenate([from_planes(d, "<u4") for k, d in held if k == kind]).astype(np.int64) for kind in (TOKENS, PAIRS))
        hashes = block.hashes()
        of_word = tokens[np.unique(hashes, return_inverse=True)[1]]
        keys = block.pairs(hashes) >> np.uint64(64 - pair_bits(page_bits))
        return Known(block, *rest, of_word, pairs[np.unique(keys, return_inverse=True)[1]])

    for batch in batches:
        for unit, kind, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)):
            if unit != here:
                if held:
                    yield made()
                here, held = unit, []
            held.append((kind, data.as_py()))
    if held:
        yield made()


# --- the spelling of new words -------------------------------------------------------------------------

#: Bytes of each context, and slots of its table as powers of two.
ORDERS, BITS = (4, 3, 2), (20, 19, 18)
STARTS = np.cumsum([0, *(1 << b for b in BITS)])
SLOTS = int(STARTS[-1])
#: Added to both counts of a slot; evidence bins: upper ends of n.
SMOOTH = 0.2
EVIDENCE = np.array([0, 1, 2, 4, 8, 32, 256])
#: A bin is the level of evidence, and beyond LEVELS the same where only one bit value was met.
LEVELS = len(EVIDENCE) + 1
BINS = 2 * LEVELS
#: The map's steps of a slot's share of ones and of its evidence; a prediction is none or one of each.
SHARES, AMOUNTS = np.array([0.02, 0.1, 0.3, 0.5, 0.7, 0.9, 0.98]), np.array([0, 1, 4, 32])
PREDICTIONS = 1 + (len(SHARES) + 1) * len(AMOUNTS)
MAP_CELLS = PREDICTIONS ** len(ORDERS)
#: Occurrences that the mixture counts for against a cell of the map.
TRUST = 2.0


class Bytes:
    """Words' bytes with their contexts' slots, two nibbles a byte."""

    def __init__(self, words: list[bytes]):
        ended = [w + b" " for w in words]
        self.data = np.frombuffer(b"".join(ended), dtype=np.uint8)
        self.lengths = np.fromiter(map(len, ended), dtype=np.int64, count=len(ended))
        self.starts = np.concatenate([[0], np.cumsum(self.lengths)[:-1]]).astype(np.int64)
        n = len(self.data)
        at = np.repeat(self.starts, self.lengths)
        place = np.arange(n) - at
        d = self.data.astype(np.uint64) + np.uint64(1)
        last, hashed = np.zeros(n, np.uint64), {}
        for k in range(1, max(ORDERS) + 1):
            shifted = np.zeros(n, np.uint64)
            shifted[k:] = d[:-k]
            shifted[place < k] = 0
            last = mixed(last * K1 + shifted + np.uint64(k))
            hashed[k] = last
        high = (self.data >> 4).astype(np.uint64) + np.uint64(1)
        self.bases = []  # per context: the 16-slot groups of both nibbles
        for h, bits, start in zip((hashed[k] for k in ORDERS), BITS, STARTS):
            shift = np.uint64(64 - bits + 4)
            pair = [(mixed(h) * K1 >> shift), (mixed(h + high * K3) * K1 >> shift)]
            self.bases.append([(x.astype(np.int32) << 4) + np.int32(start) for x in pair])

    def bits(self) -> Iterator[tuple[int, np.ndarray, list[np.ndarray]]]:
        """Place, bit values and each context's slots, for the eight bits of every byte."""
        data = self.data.astype(np.int32)
        for j in range(8):
            nibble = (data >> 4) if j < 4 else (data & 15)
            node = (1 << (j & 3)) | (nibble >> (4 - (j & 3)))
            yield j, (data >> (7 - j)) & 1, [pair[j >> 2] + node for pair in self.bases]


def spell_counts(words: list[bytes], n0: np.ndarray, n1: np.ndarray) -> None:
    """Adds the words' bits to the counts by slot."""
    for _, bit, slots in Bytes(words).bits():
        one = bit == 1
        for at in slots:
            np.add.at(n1, at[one], 1)
            np.add.at(n0, at[~one], 1)


def map_counts(words: list[bytes], n0: np.ndarray, n1: np.ndarray) -> np.ndarray:
    """Zeros and ones by cell of the map over words that are in the counts, each bit left out of its own prediction."""
    out = np.zeros((MAP_CELLS, 2), np.int64)
    for _, bit, slots in Bytes(words).bits():
        cell = cells_of([(n0[at] - (bit == 0), n1[at] - bit) for at in slots])
        out += np.bincount(cell * 2 + bit, minlength=2 * MAP_CELLS).reshape(-1, 2)
    return out


def cells_of(counts: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """The map's cell of the contexts' counts of zeros and ones."""
    cell = 0
    for a, b in counts:
        n = a + b
        kind = (np.searchsorted(AMOUNTS, n) - 1) * (len(SHARES) + 1) + np.searchsorted(SHARES, (b + 0.3) / (n + 0.6)) + 1
        cell = cell * PREDICTIONS + np.where(n == 0, 0, kind)
    return cell


def mixture(counts: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """Log-odds of a one: the contexts' own, by weights gated by the longest context's and the own evidence."""
    total, first = 0.0, None
    for w, (a, b) in zip(SPELLING_WEIGHTS, counts):
        level = np.searchsorted(EVIDENCE, a + b) + LEVELS * ((a == 0) != (b == 0))
        first = level if first is None else first
        total = total + w[first, level] * np.where(a + b > 0, np.log((b + SMOOTH) / (a + SMOOTH)), 0.0)
    return total


def spelling_weights() -> np.ndarray:
    """By context, the longest context's and the own evidence: trust grows with it; shorter contexts share what is left."""
    long = np.array([0, 0.4, 0.55, 0.7, 0.8, 0.85, 0.9, 0.95] * 2)
    next_ = np.array([0, 0.35, 0.45, 0.55, 0.65, 0.8, 0.9, 0.95] * 2)
    w = np.zeros((len(ORDERS), BINS, BINS))
    w[0] = long[:, None]
    w[1] = (1 - long)[:, None] * next_[None, :]
    w[2] = (1 - long)[:, None] * 0.35
    return w


SPELLING_WEIGHTS = spelling_weights()


# --- decisions -------------------------------------------------------------------------------------------

REPEAT, CACHE, PAIR, NEW = range(4)
#: Contexts of a decision: its own state with the way the token before came; the hashed token before; the last two ways with the age.
CONTEXTS, CONTEXT_BITS = 3, 12
CELLS = 1 << CONTEXT_BITS
#: Ways a token comes: spelled or by its count, by its pair, from the cache, as a repeat; before the first token none.
PLAIN, BY_PAIR, CACHED, REPEATED, NOTHING = range(5)
#: Weight of each context at the start, added to counts of a cell, step of the gradient, tokens of the first span.
WEIGHT, CELL_SMOOTH, RATE, SPAN = 0.4, 0.4, 0.3, 16


def log2_floor(n: np.ndarray) -> np.ndarray:
    """Whole part of log2 of counts, 0 for 0."""
    return np.frexp(np.maximum(n, 1).astype(np.float64))[1] - 1


@dataclass
class Tokens:
    """Per token: its age, the shares of the counts by each way (0: not by this), and what its contexts need."""

    doc: np.ndarray
    age: np.ndarray
    share: list[np.ndarray]  # by REPEAT, CACHE, PAIR
    open: list[np.ndarray]  # whether the way is there at all, by the same
    state: list[np.ndarray]  # bucket of the count that the share is of, by the same
    single: np.ndarray  # n of the token in training
    before: np.ndarray  # hash of the token before, CONTEXT_BITS bits

    def plain(self, total: int) -> np.ndarray:
        """Probability by the token's count where it is known; 0 for a new one."""
        return self.single / max(total, 1)


def earlier(keys: np.ndarray) -> np.ndarray:
    """How often each key occurred before, in order."""
    order = np.argsort(keys, kind="stable")
    fresh = np.append(True, keys[order][1:] != keys[order][:-1])
    at = np.flatnonzero(fresh)
    out = np.empty(len(keys), np.int64)
    out[order] = np.arange(len(keys)) - np.repeat(at, np.diff(np.append(at, len(keys))))
    return out


def observe(known: Known, left_out: bool) -> Tokens:
    """``left_out``: each occurrence is taken from its own training counts."""
    block, ids = known.block, known.block.ids.astype(np.int64)
    doc = np.repeat(np.arange(len(block.sizes)), block.sizes)
    age = np.arange(len(ids)) - block.first[doc]
    n_words = len(block.words)
    before_id = np.empty_like(ids)
    before_id[1:] = ids[:-1]
    before_id[block.first] = n_words  # no word's number
    own = earlier(doc * n_words + ids)
    pair_before = earlier((doc * (n_words + 1) + before_id) * n_words + ids)
    # The token before has been a predecessor as often as it occurred before its own last place.
    times = np.empty_like(own)
    times[1:] = own[:-1]
    times[block.first] = 0
    one = np.repeat(known.trained, block.sizes).astype(np.int64) if left_out else 0
    single = known.tokens[ids] - one
    # A text's start has been before a token as often as there are ends.
    n_before = np.where(age > 0, known.tokens[np.minimum(before_id, n_words - 1)], known.tokens[0]) - one
    n_pair = np.minimum(known.pairs - one, n_before)
    share = [a / np.maximum(b, 1) for a, b in ((pair_before, times), (own, age), (n_pair, n_before))]
    hashes = np.append(block.hashes(), START)
    return Tokens(
        doc,
        age,
        share,
        [times > 0, age > 0, n_before > 0],
        [np.minimum(log2_floor(x), 15) for x in (times, age, n_before)],
        single,
        (mixed(hashes * K3) >> np.uint64(64 - CONTEXT_BITS)).astype(np.int64)[before_id],
    )


def ways(t: Tokens, total: int) -> np.ndarray:
    """The likeliest way of each token by the shares of the counts alone."""
    p = np.stack([t.plain(total), *(np.where(o, s, 0.0) for s, o in zip(t.share[::-1], t.open[::-1]))])
    return np.argmax(p, axis=0)


def contexts(t: Tokens, way: np.ndarray) -> list[list[np.ndarray]]:
    """Cells of every decision's contexts."""
    n = len(way)
    last, further = np.full(n, NOTHING), np.full(n, NOTHING)
    last[1:], further[2:] = way[:-1], way[:-2]
    last[t.age < 1] = NOTHING
    further[t.age < 2] = NOTHING
    age = np.minimum(log2_floor(t.age), 15)
    new = (t.single <= 0).astype(np.int64)
    new_before = np.zeros(n, np.int64)
    new_before[1:] = new[:-1]
    new_before[t.age < 1] = 0
    two = ((last * 5 + further) * 16 + age) * 2 + new_before
    states = [*t.state, age]
    return [[s * 5 + last, t.before, two] for s in states]


def count_decisions(t: Tokens, total: int) -> np.ndarray:
    """How often each decision fell either way under each cell, by the likeliest ways."""
    way = ways(t, total)
    cells = contexts(t, way)
    out = np.zeros((4, CONTEXTS, CELLS, 2), np.int64)
    hits = [way == REPEATED, way == CACHED, way == BY_PAIR, t.single <= 0]
    asked = [t.open[0], t.open[1] & (way < REPEATED), t.open[2] & (way < CACHED), way == PLAIN]
    for d in range(4):
        for k in range(CONTEXTS):
            out[d, k] = np.bincount(cells[d][k][asked[d]] * 2 + hits[d][asked[d]], minlength=2 * CELLS).reshape(CELLS, 2)
    return out


@dataclass
class Model:
    """Totals, the decisions' predictions by cell, and the spelling's tables."""

    n_tokens: int = 0
    n_distinct: int = 0
    cells: np.ndarray = field(default_factory=lambda: np.zeros((4, CONTEXTS, CELLS), np.float32))
    n0: np.ndarray = field(default_factory=lambda: np.zeros(SLOTS, np.int32))
    n1: np.ndarray = field(default_factory=lambda: np.zeros(SLOTS, np.int32))
    became: np.ndarray = field(default_factory=lambda: np.zeros((MAP_CELLS, 2), np.float32))

    def spelled(self, words: list[bytes]) -> np.ndarray:
        """Natural log probability of each word's bits with its end."""
        if not words:
            return np.zeros(0)
        b = Bytes(words)
        logp = np.zeros(len(b.data))
        for _, bit, slots in b.bits():
            counts = [(self.n0[at], self.n1[at]) for at in slots]
            zeros, ones = self.became[cells_of(counts)].T
            p = (ones + TRUST / (1 + np.exp(-mixture(counts)))) / (zeros + ones + TRUST)
            logp += np.log(np.where(bit == 1, p, 1 - p))
        return np.add.reduceat(logp, b.starts)

    def texts(self, known: Known) -> np.ndarray:
        """log10 probability of each document."""
        t = observe(known, left_out=False)
        new_words = np.flatnonzero(known.tokens <= 0)
        spelling = np.zeros(len(known.tokens))
        # The end is never spelled; without training it is one more byte.
        spelling[new_words] = self.spelled([known.block.words[i] if i else b"" for i in new_words])
        plain = t.plain(self.n_tokens)
        spelt = np.where(t.single <= 0, np.exp(np.maximum(spelling, -700.0))[known.block.ids], 0.0)
        log_spelt = spelling[known.block.ids]
        cells = contexts(t, ways(t, self.n_tokens))
        x = [[self.cells[d, k][cells[d][k]] for k in range(CONTEXTS)] for d in range(4)]
        n_docs = len(known.block.sizes)
        weights = np.full((n_docs, 4, CONTEXTS + 1), WEIGHT)
        weights[:, :, CONTEXTS] = 0
        power = np.ones((n_docs, 4, CONTEXTS + 1))
        logp = np.zeros(len(t.doc))
        span = log2_floor((t.age + SPAN) // SPAN)
        order = np.argsort(span, kind="stable")
        cuts = np.searchsorted(span[order], np.arange(span.max() + 2))
        for a, b in zip(cuts[:-1], cuts[1:]):
            rows = order[a:b]
            doc = t.doc[rows]
            inputs = [[*(x[d][k][rows] for k in range(CONTEXTS)), np.float32(1)] for d in range(4)]
            gate = []
            for d in range(4):
                s = sum(weights[doc, d, k] * v for k, v in enumerate(inputs[d]))
                g = 1 / (1 + np.exp(-np.clip(s, -12, 12)))
                gate.append(np.where(t.open[d][rows], g, 0.0) if d < NEW else g)
            is_new = t.single[rows] <= 0
            base = np.where(is_new, gate[NEW] * spelt[rows], (1 - gate[NEW]) * plain[rows])
            p = [base]
            for d in (PAIR, CACHE, REPEAT):
                p.append((1 - gate[d]) * p[-1] + gate[d] * t.share[d][rows])
            with np.errstate(divide="ignore"):
                # So long a word that its probability is no number: only spelled.
                rest = np.log(gate[NEW]) + log_spelt[rows] + sum(np.log1p(-gate[d]) for d in (PAIR, CACHE, REPEAT))
                logp[rows] = np.where(p[-1] > 0, np.log(np.maximum(p[-1], 1e-300)), rest)
            # The gradient: how much likelier a way is, now that the token is known, than it was foreseen.
            through = np.ones(len(rows))
            for d, upto in ((REPEAT, 3), (CACHE, 2), (PAIR, 1)):
                whole = np.maximum(p[upto], 1e-300)
                off = through * np.where(p[upto] > 0, gate[d] * t.share[d][rows] / whole - gate[d], 0.0)
                through = through * np.where(p[upto] > 0, (1 - gate[d]) * p[upto - 1] / whole, 1.0)
                self.follow(weights, power, d, doc, off, inputs[d], n_docs)
            self.follow(weights, power, NEW, doc, through * (is_new - gate[NEW]), inputs[NEW], n_docs)
        return np.add.reduceat(logp, known.block.first) / np.log(10)

    @staticmethod
    def follow(weights, power, d, doc, off, inputs, n_docs) -> None:
        """One step of each document's weights along its own gradient over a span."""
        for k, v in enumerate(inputs):
            g = off * v
            power[:, d, k] += np.bincount(doc, weights=g * g, minlength=n_docs)
            weights[:, d, k] += RATE * np.bincount(doc, weights=g, minlength=n_docs) / np.sqrt(power[:, d, k])


# --- training and scoring ----------------------------------------------------------------------------------

ASSEMBLED = "kind int, page int, data binary"
#: Kinds of rows: documents with what is known of them, words met once, counts of decisions, of the spelling's slots and its map.
DOCUMENTS, ONCE, DECISIONS, SLOT_COUNTS, MAP_COUNTS = range(5)
#: Slots or cells of one shipped block of counts.
SLOT_PAGE = 1 << 14


def _shipped(kind: int, zeros: np.ndarray, ones: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Counts in blocks, without those of zeros only."""
    for low in range(0, len(zeros), SLOT_PAGE):
        a, b = zeros[low : low + SLOT_PAGE].astype("<u4"), ones[low : low + SLOT_PAGE].astype("<u4")
        if a.any() or b.any():
            yield _assembled(kind, low // SLOT_PAGE, planes(a) + planes(b))


def _assemble(page_bits: int, total: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decisions = np.zeros((4, CONTEXTS, CELLS, 2), np.int64)
        n0, n1 = np.zeros(SLOTS, np.int32), np.zeros(SLOTS, np.int32)
        any_unit = False
        for whole in _known(batches, page_bits):
            any_unit = True
            learn = np.repeat(whole.trained, whole.block.sizes)
            own = np.bincount(whole.block.ids[learn], minlength=len(whole.tokens))
            once = np.flatnonzero((whole.tokens == 1) & (own == 1))
            words = [whole.block.words[i] for i in once if i]
            if words:
                spell_counts(words, n0, n1)
                yield _assembled(ONCE, 0, b"\n".join(words))
            for part in whole.parts():
                if part.trained.any():
                    t = observe(part, left_out=True)
                    decisions += count_decisions(only(t, part), total)
                # Words are kept only where they have to be spelled.
                part.block.words = [w if n <= 0 else h for w, n, h in zip(part.block.words, part.tokens, map(_stand_in, part.block.hashes()))]
                held = (part.block.words, planes(part.block.ids), part.block.sizes, part.rows, part.doc_ids, part.trained, part.n_bytes)
                data = pickle.dumps((*held, planes(part.tokens.astype("<u4")), planes(part.pairs.astype("<u4"))))
                yield _assembled(DOCUMENTS, 0, data)
        if any_unit:
            yield _assembled(DECISIONS, 0, decisions.tobytes())
            yield from _shipped(SLOT_COUNTS, n0, n1)
        release()

    return run


def only(t: Tokens, known: Known) -> Tokens:
    """The tokens of training documents."""
    rows = np.repeat(known.trained, known.block.sizes)
    lists = ([x[rows] for x in some] for some in (t.share, t.open, t.state))
    return Tokens(t.doc[rows], t.age[rows], *lists, t.single[rows], t.before[rows])


def _stand_in(h: np.uint64) -> int:
    return int(h)


def _assembled(kind: int, page: int, data: bytes) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([kind], pa.int32()), pa.array([page], pa.int32()), pa.array([data], pa.binary())], names=["kind", "page", "data"])


class Kept(Block):
    """A block whose known words are given by their hashes."""

    def hashes(self) -> np.ndarray:
        return np.fromiter((w if isinstance(w, int) else xxhash.xxh64_intdigest(w) for w in self.words), dtype=np.uint64, count=len(self.words))


def _restored(data: bytes) -> Known:
    words, ids, sizes, *rest, tokens, pairs = pickle.loads(data)
    block = Kept(words, from_planes(ids, "<i4"), sizes)
    return Known(block, *rest, from_planes(tokens, "<u4").astype(np.int64), from_planes(pairs, "<u4").astype(np.int64))


def _add_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows sorted by (kind, page): the counts of each added."""
    here, total = None, None
    for batch in batches:
        for kind, page, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)):
            raw = data.as_py()
            if kind == DECISIONS:
                values = np.frombuffer(raw, np.int64)
            else:
                values = np.concatenate([from_planes(raw[: len(raw) // 2], "<u4"), from_planes(raw[len(raw) // 2 :], "<u4")]).astype(np.int64)
            if (kind, page) != here:
                if here is not None:
                    yield _assembled(*here, total.tobytes())
                here, total = (kind, page), values
            else:
                total = total + values
    if here is not None:
        yield _assembled(*here, total.tobytes())


def learn(df: DataFrame, allowed: Column, id_col: str = "doc_id", text_col: str = "text") -> tuple[Model, DataFrame]:
    """The model of the allowed rows' texts, and the table of all rows' documents with what is known of them."""
    spark = df.sparkSession
    size = df.agg(F.coalesce(F.sum(F.octet_length(F.col(text_col))), F.lit(0))).first()[0]
    page_bits = max(0, int(size // PAGE_TEXT).bit_length())
    trained = F.coalesce(allowed, F.lit(False)) & F.col(id_col).isNotNull()
    source = df.select(row_key().alias("row"), F.col(id_col).cast("long").alias("doc_id"), trained.alias("trained"), F.col(text_col).alias("text"))
    units = materialise(source.mapInArrow(_units(page_bits), UNITS), "mixing-units", partition_by="kind", batch=TEXT_ROWS)
    columns = _NAMES
    texts = split_off(units, "kind", TEXTS)
    keys = units.where(f"kind <> {TEXTS}").select(*columns)
    dealt = keys.repartition("kind", "page").sortWithinPartitions("kind", "page")
    sums = materialise(dealt.mapInArrow(_sum_pages, UNITS), "mixing-sums", batch=KEY_ROWS)
    # From here on the keys and their shuffle only take room.
    del keys, dealt
    discard(*(split_off(units, "kind", k) for k in (TOKENS, PAIRS)))
    facts = {TOKENS: np.zeros(3, np.int64)}
    for r in sums.where(f"kind = {-TOKENS}").groupBy("page").agg(F.first("data").alias("data")).select("data").toLocalIterator():
        facts[TOKENS] += np.frombuffer(r["data"], np.int64)  # three numbers a page
    distinct, total, _ = facts[TOKENS].tolist()
    back = texts.select(*columns).unionByName(sums.where("kind > 0").select(*columns)).select("unit", "kind", "data", "page")
    dealt = back.repartition("unit").sortWithinPartitions("unit", "kind", "page")
    assembled = materialise(dealt.mapInArrow(_assemble(page_bits, total), ASSEMBLED), "mixing-documents", partition_by="kind", batch=KEY_ROWS)
    del back, dealt
    discard(units, sums)
    model = Model(total, distinct)

    def added(counts: DataFrame) -> Iterator:
        """The sums of shipped counts; they are as many at any size of the input."""
        dealt = counts.select("kind", "page", "data").repartition("kind", "page").sortWithinPartitions("kind", "page")
        return ((r["kind"], r["page"], np.frombuffer(r["data"], np.int64)) for r in dealt.mapInArrow(_add_up, ASSEMBLED).toLocalIterator())

    with batches_of(spark, LARGE_ROWS):
        for kind, page, values in added(assembled.where(f"kind IN ({DECISIONS}, {SLOT_COUNTS})")):
            if kind == DECISIONS:
                c = values.reshape(4, CONTEXTS, CELLS, 2) + CELL_SMOOTH
                model.cells = np.log(c[..., 1] / c[..., 0]).astype(np.float32)
            else:
                half, at = len(values) // 2, slice(page * SLOT_PAGE, page * SLOT_PAGE + len(values) // 2)
                model.n0[at], model.n1[at] = values[:half], values[half:]
    shared = spark.sparkContext.broadcast((model.n0, model.n1))

    def refine(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        became = np.zeros((MAP_CELLS, 2), np.int64)
        for batch in batches:
            for data in batch.column(0):
                words = data.as_py().split(b"\n")
                for low in range(0, len(words), 100_000):
                    became += map_counts(words[low : low + 100_000], *shared.value)
        yield from _shipped(MAP_COUNTS, became[:, 0], became[:, 1])
        release()

    with batches_of(spark, LARGE_ROWS):
        for _, page, values in added(assembled.where(f"kind = {ONCE}").select("data").mapInArrow(refine, ASSEMBLED)):
            half = len(values) // 2
            model.became[page * SLOT_PAGE : page * SLOT_PAGE + half] = values.reshape(2, half).T
    return model, split_off(assembled, "kind", DOCUMENTS)


SCORED = "row long, doc_id long, n_tokens long, n_known long, train_tokens long, base_score double, score double, bits_per_byte double"


def score_known(model: Model, known: Known) -> pa.RecordBatch:
    """A row per document."""
    block, first = known.block, known.block.first
    n, v = model.n_tokens, model.n_distinct
    single = known.tokens[block.ids]
    base = np.add.reduceat(np.log10(single + 0.5), first) - block.sizes * np.log10(n + 0.5 * (v + 1))
    score = model.texts(known)
    columns = [
        pa.array(known.rows, pa.int64()),
        pa.array(known.doc_ids, pa.int64()),
        pa.array(block.sizes, pa.int64()),
        pa.array(np.add.reduceat((single > 0).astype(np.int64), first)),
        pa.array(np.full(len(known.rows), n, np.int64)),
        pa.array(base, pa.float64()),
        pa.array(score, pa.float64()),
        pa.array(-score / np.log10(2) / np.maximum(known.n_bytes, 1), pa.float64()),
    ]
    return pa.RecordBatch.from_arrays(columns, names=[c.strip().split()[0] for c in SCORED.split(",")])


def train_and_score(df: DataFrame, allowed: Column, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: row, doc_id, n_tokens, n_known, train_tokens, base_score, score, bits_per_byte."""
    model, documents = learn(df, allowed, id_col, text_col)
    shared = df.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for data in batch.column(0):
                yield score_known(shared.value, _restored(data.as_py()))
        release()

    scores = materialise(documents.select("data").mapInArrow(run, SCORED), "mixing-scores", batch=LARGE_ROWS)
    discard(documents)
    return scores
