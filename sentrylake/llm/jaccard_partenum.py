"""N-gram Jaccard self-join by PartEnum signatures, with linked components.

A document's set is its distinct word shingles. Sets fall into size bands; in
each band the shingle domain is hashed into first-level and second-level
partitions, and for every first-level partition the subsets of its second-level
ones that leave out ``k2`` are enumerated. Two sets within the band's largest
symmetric difference agree on at least one such subset, so they share a
signature: no link is lost. Signatures meet in buckets; candidates are pruned by
sizes and by parity sketches (whose distance never exceeds the sets'), and the
rest are verified on the shingles of their whole texts.

Equal sets are one class from the start. First each class is proposed with the
smallest class of its buckets only; buckets that still hold several components
afterwards are compared within themselves, block by block, and only pairs
across components that pass the pruning are verified. Links become components
by distributed label propagation.

Defined cases: null text, empty text and text without words have an empty set,
n_shingles 0, and are linked with nothing; a null doc_id takes part and never
names a component unless all ids of the component are null; repeated rows are
members of one class; an empty table gives no rows; other input columns are
ignored, whatever their names.
"""

from __future__ import annotations

import functools
import hashlib
import itertools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import discard, hold, materialise, row_key, scanned

#: Width of a size band, least shingles a signature should stand on, sketch words of 64 bits, rows of a compared block.
BAND, ELEMENTS, SKETCH, BLOCK = 1.25, 3.2, 8, 512
#: Most bits of a class's long sketch; rows and pairs that a comparing task handles at once, and bytes of sketches.
LONG_SKETCH, ROWS_AT_ONCE, PAIRS_AT_ONCE, BYTES_AT_ONCE = 1 << 17, 20_000, 250_000, 32 << 20
#: Largest buckets of a class by which pairs that meet in several are told, and pairs told at once.
LARGEST, TOLD_AT_ONCE = 32, 50_000
#: Texts and pairs of sets that a task gets at once.
TEXT_ROWS, SET_ROWS = 2000, 256
#: Rounds in which each class is proposed with its nearest one, before all remaining pairs are.
ROUNDS = 2
REMEMBERED = 500_000
_LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")
K = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93)]


class WordHashes(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) > REMEMBERED:
            self.clear()
        made = xxhash.xxh64_intdigest(word)
        if len(word) <= 64:
            self[word] = made
        return made


_HASHES = WordHashes()


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingles(text: str, size: int) -> np.ndarray:
    """Sorted 64-bit hashes of the distinct shingles of a whole text."""
    words = text.encode("utf-8", "replace").translate(_LOWER).split()
    n = len(words)
    if not n:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(_HASHES.__getitem__, words), dtype=np.uint64, count=n)
    width = min(size, n)
    out = np.full(n - width + 1, np.uint64(width))
    for i in range(width):
        out = mix(out * K[0] + h[i : n - width + 1 + i])
    return np.unique(out)


class Bands:
    """Size bands and the partitioning of each, for links at intersection >= percent of the union."""

    def __init__(self, percent: int):
        self.percent = percent

    def most(self, a: int, b: int) -> int:
        """Largest symmetric difference of linked sets of these sizes."""
        return (a + b) * (100 - self.percent) // (100 + self.percent)

    @functools.lru_cache(maxsize=None)
    def low(self, band: int) -> int:
        low = 1
        for _ in range(band):
            low = max(low + 1, int(low * BAND) + 1)
        return low

    @functools.lru_cache(maxsize=4096)
    def of(self, size: int) -> int:
        band = 0
        while self.low(band + 1) <= size:
            band += 1
        return band

    def instances(self, size: int) -> list[int]:
        """Bands whose partitioning a set of this size signs under: its own and those where a larger partner can be."""
        return list(range(self.of(size), self.of(size * 100 // self.percent) + 1))

    @functools.lru_cache(maxsize=None)
    def plan(self, band: int) -> tuple[int, int, np.ndarray, int] | None:
        """First-level and second-level partitions, the subsets as rows of 0 and 1, and the spare first-level ones.

        With ``spare`` more first-level partitions than the guarantee needs, a set
        in which at most so many hold an empty subset need not sign its empty
        subsets: one of the agreeing partitions has none. None if only equal sets link.
        """
        low, high = self.low(band), self.low(band + 1) - 1
        k = self.most(high, high)
        if k == 0:
            return None
        best = None
        for k2 in range(1, 3):
            for n2 in range(k2 + 1, k2 + 4):
                subsets = math.comb(n2, k2)
                n1 = math.ceil((k + 1) / (k2 + 1))
                stands_on = low / (n1 * n2) * (n2 - k2)
                spare = math.ceil(2.5 * n1 * min(1.0, subsets * math.exp(-stands_on))) + 1 if n1 > 3 else 0
                n1 += spare
                rank = (0, n1 * subsets, -stands_on) if stands_on >= ELEMENTS else (1, -stands_on, n1 * subsets)
                if best is None or rank < best[0]:
                    best = (rank, n1, n2, k2, spare)
        _, n1, n2, k2, spare = best
        chosen = [[0 if i in left else 1 for i in range(n2)] for left in itertools.combinations(range(n2), k2)]
        return n1, n2, np.array(chosen, dtype=np.uint64), spare


@functools.lru_cache(maxsize=8)
def bands(percent: int) -> Bands:
    return Bands(percent)


def signatures(found: np.ndarray, percent: int) -> np.ndarray:
    rules, out = bands(percent), []
    for band in rules.instances(len(found)):
        plan = rules.plan(band)
        if plan is None:
            continue
        n1, n2, subsets, spare = plan
        part = ((found * K[1]) >> np.uint64(33)) % np.uint64(n1 * n2)
        sums = np.zeros(n1 * n2, np.uint64)
        np.add.at(sums, part.astype(np.intp), mix(found ^ K[2]))
        each = sums.reshape(n1, n2) @ subsets.T  # first-level partition by subset
        place = np.arange(each.size, dtype=np.uint64).reshape(each.shape) + np.uint64(band << 32)
        signed = mix(each + mix(place * K[3] + K[0]))
        empty = np.bincount(part.astype(np.intp), minlength=n1 * n2).reshape(n1, n2) @ subsets.T.astype(np.int64) == 0
        out.append(signed[~empty] if empty.any(axis=1).sum() <= spare else signed.ravel())
    return np.concatenate(out) if out else np.empty(0, np.uint64)


def long_sketch(found: np.ndarray) -> np.ndarray:
    """Parities of the set's shingles by hash, packed, a bit for one to two shingles of a large set.

    Differing bits never outnumber differing shingles. Unlinked sets differ in
    about half the bits, which is more than linked sets of the size may.
    """
    bits = min(max(SKETCH * 64, 1 << (len(found) // 2).bit_length()), LONG_SKETCH)
    at = ((found * K[3]) >> np.uint64(20)) & np.uint64(bits - 1)
    return np.packbits((np.bincount(at.astype(np.intp), minlength=bits) & 1).astype(np.uint8), bitorder="little")


def sketch(found: np.ndarray) -> np.ndarray:
    """The parities as words of 64 bits, as many for every set: halves are folded until they are so few."""
    odd = long_sketch(found)
    while len(odd) > SKETCH * 8:
        odd = odd[: len(odd) // 2] ^ odd[len(odd) // 2 :]
    return odd.view(np.int64)


SETS = "row long, doc_id long, n long, key long, " + ", ".join(f"s{i} long" for i in range(SKETCH)) + ", odd binary, signs array<long>"


def sets_table(df: DataFrame, words: int, percent: int, id_col: str, text_col: str) -> DataFrame:
    """One row per input row; a task lists the signatures of a class only the first time it meets it."""
    source = df.select(row_key().alias("row"), F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    names = [c.strip().split()[0] for c in SETS.split(",")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hold(__name__, _HASHES)
        seen: set[int] = set()
        for batch in batches:
            yield described(batch, seen)

    def described(batch: pa.RecordBatch, seen: set[int]) -> pa.RecordBatch:
        n, keys, sketches, odd, signs = [], [], [], [], []
        for text in batch.column(2).to_pylist():
            found = shingles(text or "", words)
            n.append(len(found))
            if not len(found):
                keys.append(None)
                sketches.append(np.zeros(SKETCH, np.int64))
                odd.append(None)
                signs.append([])
                continue
            key = int.from_bytes(hashlib.blake2b(found.tobytes(), digest_size=8).digest(), "little", signed=True)
            keys.append(key)
            sketches.append(sketch(found))
            odd.append(long_sketch(found).tobytes())
            if key in seen:
                signs.append([])
            else:
                if len(seen) < 2_000_000:
                    seen.add(key)
                signs.append(signatures(found, percent).view(np.int64))
        s = np.stack(sketches) if sketches else np.zeros((0, SKETCH), np.int64)
        return pa.RecordBatch.from_arrays(
            [
                batch.column(0),
                batch.column(1),
                pa.array(n, pa.int64()),
                pa.array(keys, pa.int64()),
                *(pa.array(s[:, i], pa.int64()) for i in range(SKETCH)),
                pa.array(odd, pa.binary()),
                pa.array(signs, pa.list_(pa.int64())),
            ],
            names=names,
        )

    return source.mapInArrow(run, SETS)


def _whole_groups(batches: Iterator[pa.RecordBatch], by: int, least: int) -> Iterator[list[np.ndarray]]:
    """Column arrays of some ``least`` rows of sorted batches, never cut within equal values of the first ``by`` columns."""
    held: list[list[np.ndarray]] = []
    size = 0
    for batch in batches:
        if not batch.num_rows:
            continue
        held.append([batch.column(i).to_numpy(zero_copy_only=False) for i in range(batch.num_columns)])
        size += batch.num_rows
        if size < least:
            continue
        whole = [np.concatenate(x) for x in zip(*held)]
        last = np.ones(size, bool)
        for c in whole[:by]:
            last &= c == c[-1]
        cut = size - int(last.sum())
        if cut:
            yield [c[:cut] for c in whole]
        held, size = [[c[cut:] for c in whole]], size - cut
    if size:
        yield [np.concatenate(x) for x in zip(*held)]


def _buckets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows sorted by (sign, key): those of signatures with several classes, with the smallest class."""
    last_sign = last_key = first = None
    several = False
    for batch in batches:
        if not batch.num_rows:
            continue
        sign, key = (batch.column(i).to_numpy() for i in (0, 1))
        fresh = np.ones(len(sign), bool)
        fresh[1:] = sign[1:] != sign[:-1]
        fresh[0] = sign[0] != last_sign if last_sign is not None else True
        new = fresh.copy()
        new[1:] |= key[1:] != key[:-1]
        if not fresh[0]:
            new[0] = key[0] != last_key
        start = np.maximum.accumulate(np.where(fresh, np.arange(len(sign)), -1))
        pivot = np.where(start >= 0, key[np.maximum(start, 0)], first if first is not None else 0)
        other = new & (key != pivot)
        if other.any():
            yield pa.RecordBatch.from_arrays(
                [pa.array(sign[other]), pa.array(key[other]), pa.array(pivot[other])], names=["sign", "key", "pivot"]
            )
        last_sign, last_key, first = sign[-1], key[-1], pivot[-1]


def _near(a: str, b: str, percent: int) -> Column:
    """Whether two classes' sizes and sketches allow a link; columns are structs named a and b."""
    total = F.col(f"{a}.n") + F.col(f"{b}.n")
    apart = sum((F.bit_count(F.col(f"{a}.s{i}").bitwiseXOR(F.col(f"{b}.s{i}"))) for i in range(SKETCH)), F.lit(0))
    most = F.floor(total * (100 - percent) / (100 + percent))
    return (apart <= most) & (F.abs(F.col(f"{a}.n") - F.col(f"{b}.n")) <= most)


def _partners(by: list[np.ndarray], same_block: np.ndarray, side: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs to compare, some at once: within a block each row with those behind it, else side 0 with side 1.

    Rows are sorted by the columns ``by`` and then by side.
    """
    rows = len(side)
    change = np.zeros(rows, bool)
    for c in by:
        change[1:] |= c[1:] != c[:-1]
    starts = np.concatenate([[0], np.flatnonzero(change)])
    sizes = np.diff(np.append(starts, rows))
    end = np.repeat(starts + sizes, sizes)
    second = np.repeat(starts + np.add.reduceat((side == 0).astype(np.int64), starts), sizes)
    begin = np.where(same_block, np.arange(rows) + 1, second)
    left = np.flatnonzero((side == 0) & (end > begin))
    count = (end - begin)[left]
    upto = np.cumsum(count)
    at = 0
    while at < len(left):
        before = upto[at - 1] if at else 0
        to = max(at + 1, int(np.searchsorted(upto, before + PAIRS_AT_ONCE)))
        n = count[at:to]
        within = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        yield np.repeat(left[at:to], n), np.repeat(begin[left[at:to]], n) + within
        at = to


class Sketches:
    """Rows' long sketches, folded to every width that some row has."""

    def __init__(self, odd: np.ndarray):
        self.widths = np.fromiter(map(len, odd), dtype=np.int64, count=len(odd))
        held: dict[int, list] = {}
        for width in sorted(set(self.widths.tolist()), reverse=True):
            rows = np.flatnonzero(self.widths == width)
            folded = np.frombuffer(b"".join(odd[rows]), np.uint8).reshape(len(rows), width).view(np.uint64)
            while True:
                held.setdefault(width, []).append((rows, folded))
                if width == SKETCH * 8:
                    break
                width //= 2
                folded = folded[:, : width // 8] ^ folded[:, width // 8 :]
        self.by_width = {}
        for width, parts in held.items():
            place = np.full(len(odd), -1, np.int64)
            place[np.concatenate([r for r, _ in parts])] = np.arange(sum(len(r) for r, _ in parts))
            self.by_width[width] = place, np.concatenate([m for _, m in parts])

    def apart(self, x: np.ndarray, y: np.ndarray, width: int) -> np.ndarray:
        place, words = self.by_width[width]
        out = np.empty(len(x), np.int64)
        step = max(1, BYTES_AT_ONCE // width)
        for low in range(0, len(x), step):
            some = slice(low, low + step)
            out[some] = np.bitwise_count(words[place[x[some]]] ^ words[place[y[some]]]).sum(axis=1)
        return out

    def near(self, x: np.ndarray, y: np.ndarray, most: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Numbers of the pairs whose sketches differ by no more than ``most``, and by how much: first the short ones."""
        apart = self.apart(x, y, SKETCH * 8)
        left = np.flatnonzero(apart <= most)
        width = np.minimum(self.widths[x[left]], self.widths[y[left]])
        ok = np.ones(len(left), bool)
        for w in set(width.tolist()) - {SKETCH * 8}:
            some = np.flatnonzero(width == w)
            pairs = left[some]
            apart[pairs] = self.apart(x[pairs], y[pairs], w)
            ok[some] = apart[pairs] <= most[pairs]
        return left[ok], apart[left[ok]]


#: A bucket in a class's list of its largest ones: rows, signature.
RANK = np.dtype([("m", ">u4"), ("sign", ">i8")])


def _largest_buckets() -> Column:
    """A class's largest buckets by rows, then signature, as packed ``RANK`` entries; rows have m and sign."""
    hexed = lambda x, digits: F.lpad(F.hex(x), digits, "0")
    some = F.slice(F.sort_array(F.collect_list(F.struct("m", "sign")), asc=False), 1, LARGEST)
    return F.unhex(F.array_join(F.transform(some, lambda b: F.concat(hexed(b["m"], 8), hexed(b["sign"], 16))), ""))


def _met_before(ranks: np.ndarray, m: np.ndarray, sign: np.ndarray, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Whether pairs of a bucket's rows share a larger one of their largest buckets, where they are compared as well.

    The largest bucket that two classes share has none above it, so every pair is left in one bucket at least.
    """
    out = np.zeros(len(x), bool)
    for low in range(0, len(x), TOLD_AT_ONCE):
        a, b = x[low : low + TOLD_AT_ONCE], y[low : low + TOLD_AT_ONCE]
        used, at = np.unique(np.concatenate([a, b]), return_inverse=True)
        a_at, b_at = at[: len(a)], at[len(a) :]
        sizes = np.fromiter(map(len, ranks[used]), dtype=np.int64, count=len(used)) // RANK.itemsize
        listed = np.frombuffer(b"".join(ranks[used]), RANK)
        names, name = np.unique(listed["sign"].astype(np.int64), return_inverse=True)
        has = np.sort(np.repeat(np.arange(len(used)), sizes) * len(names) + name)
        begin = np.cumsum(sizes) - sizes
        n = sizes[a_at]
        pair = np.repeat(np.arange(len(a)), n)
        entry = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + begin[a_at][pair]
        rows, which = listed["m"][entry].astype(np.int64), listed["sign"][entry].astype(np.int64)
        own = a[pair]
        above = (rows > m[own]) | ((rows == m[own]) & (which > sign[own]))
        pair, entry = pair[above], entry[above]
        wanted = b_at[pair] * len(names) + name[entry]
        shared = has[np.minimum(np.searchsorted(has, wanted), len(has) - 1)] == wanted if len(has) else np.zeros(0, bool)
        out[low + pair[shared]] = True
    return out


def _compare(percent: int, nearest: bool):
    """Pairs across components of block pairs that sizes and sketches allow, all or each member's nearest.

    Columns: sign, i, j, side (0: of block i, 1: of block j), key, part, n, odd, m (rows of
    the bucket), ranks (the class's largest buckets). A pair is left to the largest bucket
    that both rank, so that what comes out does not grow with the buckets that a pair shares.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for columns in _whole_groups(batches, 3, ROWS_AT_ONCE):
            sign, i, j, side, key, part, n, odd, m, ranks = columns
            sketches = Sketches(odd)
            top = np.frombuffer(b"".join([r[: RANK.itemsize] for r in ranks]), RANK)["sign"].astype(np.int64)
            for x, y in _partners([sign, i, j], i == j, side):
                most = (n[x] + n[y]) * (100 - percent) // (100 + percent)
                open_ = (part[x] != part[y]) & (np.abs(n[x] - n[y]) <= most) & ((top[x] != top[y]) | (top[x] == sign[x]))
                x, y, most = x[open_], y[open_], most[open_]
                near, apart = sketches.near(x, y, most)
                x, y = x[near], y[near]
                left = ~_met_before(ranks, m, sign, x, y)
                x, y, apart = x[left], y[left], apart[left]
                if nearest and len(x):
                    order = np.lexsort((apart, x))
                    x, y, apart = x[order], y[order], apart[order]
                    first = np.append(True, x[1:] != x[:-1])
                    x, y, apart = x[first], y[first], apart[first]
                if len(x):
                    high, low = np.maximum(key[x], key[y]), np.minimum(key[x], key[y])
                    order = np.lexsort((apart, key[x], low, high))
                    made = [c[order] for c in (high, low, key[x], apart)]
                    new = np.append(True, (made[0][1:] != made[0][:-1]) | (made[1][1:] != made[1][:-1]) | (made[2][1:] != made[2][:-1]))
                    yield pa.RecordBatch.from_arrays([pa.array(c[new], pa.int64()) for c in made], names=["key", "pivot", "by", "apart"])

    return run


HASHES = "key long, hashes binary"


def _hashed(words: int):
    """key and text -> the class's sorted shingle hashes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hold(__name__, _HASHES)
        for batch in batches:
            sets = [shingles(text.as_py(), words).tobytes() for text in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sets, pa.binary())], names=["key", "hashes"])

    return run


def _chosen(test):
    """Those pairs (key, pivot) whose two sets pass the test."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, pivots = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            rest = [batch.column(i) for i in range(2, 4)]
            ok = [test(a.as_py(), b.as_py()) for a, b in zip(*rest)]
            a, b = ([v for v, k in zip(x, ok) if k] for x in (keys, pivots))
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    return run


def _linked(percent: int):
    def test(a: bytes, b: bytes) -> bool:
        x, y = np.frombuffer(a, np.uint64), np.frombuffer(b, np.uint64)
        if len(x) > len(y):
            x, y = y, x
        common = int(np.count_nonzero(y[np.minimum(np.searchsorted(y, x), len(y) - 1)] == x))
        return 100 * common >= percent * (len(x) + len(y) - common)

    return test


def components(links: DataFrame, tag: str = "components") -> DataFrame:
    """key, part: the smallest key reachable over links (a, b), by label propagation with jumps."""
    spare: list[DataFrame] = []
    both = materialise(links.select("a", "b").union(links.select("b", "a")).distinct(), f"{tag}-links")
    labels = both.groupBy(F.col("a").alias("key")).agg(F.least(F.col("key"), F.min("b")).alias("part"))
    labels = materialise(labels, f"{tag}-labels")
    while True:
        named = labels.select(F.col("key").alias("b"), "part")
        around = both.join(named, "b").groupBy(F.col("a").alias("key")).agg(F.min("part").alias("around"))
        step = labels.join(around, "key").select("key", F.col("part").alias("old"), F.least("part", "around").alias("part"))
        jump = step.join(labels.select(F.col("key").alias("part"), F.col("part").alias("further")), "part", "left")
        step = jump.select("key", "old", F.least("part", F.coalesce("further", "part")).alias("part"))
        step = materialise(step, f"{tag}-labels")
        spare.append(labels)
        labels = step.select("key", "part")
        labels._shared_path = step._shared_path
        if step.where("part <> old").isEmpty():
            discard(both, *spare)
            return labels


def near_duplicates(
    df: DataFrame,
    words: int = 5,
    percent: int = 80,
    id_col: str = "doc_id",
    text_col: str = "text",
    tables: list[DataFrame] | None = None,
) -> DataFrame:
    """One row per input row: row, doc_id, n_shingles, class_rows, component_id
    and component (a key of the component, null for an empty set).

    Documents link when 100 * intersection >= percent * union of their sets of
    ``words``-word shingles (the whole sequence where there are fewer words).
    The shared-folder tables the result reads are added to ``tables``.
    """
    df = scanned(df)
    sketch_columns = [f"s{i}" for i in range(SKETCH)]
    sets = materialise(sets_table(df, words, percent, id_col, text_col), "partenum-sets", batch=TEXT_ROWS)
    signs = sets.where(F.size("signs") > 0).select(F.explode("signs").alias("sign"), "key")
    buckets = materialise(
        signs.repartition("sign").sortWithinPartitions("sign", "key").mapInArrow(_buckets, "sign long, key long, pivot long"),
        "partenum-buckets",
    )
    base = materialise(sets.drop("signs"), "partenum-rows")
    discard(sets)
    members = base.where("key IS NOT NULL").groupBy("key").agg(
        F.min("doc_id").alias("first_id"),
        F.count(F.lit(1)).alias("class_rows"),
        F.min("row").alias("first_row"),
        F.first("n").alias("n"),
        *(F.first(s).alias(s) for s in [*sketch_columns, "odd"]),
    )
    members = materialise(members, "partenum-classes")
    info = F.struct("n", *sketch_columns)
    texts = df.select(row_key().alias("first_row"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))

    def verified(pairs: DataFrame, compared: bool = False) -> DataFrame:
        """Links (a, b) among candidate pairs (key, pivot); ``compared``: their sizes and short sketches allow them."""
        close = pairs
        if not compared:
            named = pairs.join(members.select("key", info.alias("x")), "key").join(
                members.select(F.col("key").alias("pivot"), info.alias("y")), "pivot"
            )
            close = materialise(named.where(_near("x", "y", percent)).select("key", "pivot"), "partenum-close")
        wanted = close.select("key").union(close.select("pivot")).distinct()
        rows = members.join(wanted, "key", "left_semi").select("key", "first_row")
        held = materialise(texts.join(rows, "first_row").select("key", "text").mapInArrow(_hashed(words), HASHES), "partenum-sets", "lz4", batch=TEXT_ROWS)
        other = held.select(F.col("key").alias("pivot"), F.col("hashes").alias("other"))
        both = close.select("key", "pivot").join(other, "pivot").join(held, "key").select("key", "pivot", "hashes", "other")
        found = materialise(both.mapInArrow(_chosen(_linked(percent)), "a long, b long"), "partenum-links", batch=SET_ROWS)
        discard(*([] if compared else [close]), held)
        return found

    # One proposal per class: with one smallest member in most of its buckets, a group of copies becomes a star.
    pairs = materialise(
        buckets.groupBy("key").agg(F.min("pivot").alias("low")).select(F.col("key"), F.col("low").alias("pivot")),
        "partenum-pairs",
    )
    links = verified(pairs)
    parts = components(links)
    all_rows = buckets.select("sign", "key").union(buckets.select("sign", F.col("pivot").alias("key")).distinct())

    def still_mixed(rows: DataFrame) -> tuple[DataFrame, int]:
        """Rows of buckets with several components, and at most how many pairs across components they hold.

        Of buckets with the same members one is kept: near copies share many signatures, and
        each of their buckets would give the same pairs again.
        """
        named = rows.join(parts, "key", "left").select("sign", "key", F.coalesce("part", "key").alias("part"))
        same = [F.bit_xor(F.xxhash64("key", F.lit(k))).alias(f"same{k}") for k in range(2)]
        m = named.groupBy("sign").agg(F.min("part").alias("low"), F.max("part").alias("high"), F.count(F.lit(1)).alias("m"), *same)
        m = m.where("low <> high").groupBy("m", "same0", "same1").agg(F.min("sign").alias("sign"))
        mixed = materialise(named.join(m.select("sign", "m"), "sign"), "partenum-mixed")
        return mixed, int(mixed.agg(F.coalesce(F.sum((F.col("m") - 1) / 2), F.lit(0))).first()[0])

    def proposals(mixed: DataFrame, nearest: bool) -> DataFrame:
        """Untested pairs across components within buckets that still hold several."""
        rows = mixed.withColumn("blocks", F.ceil(F.col("m") / BLOCK).cast("int"))
        rows = rows.withColumn("block", F.pmod(F.xxhash64("key"), F.col("blocks")).cast("int"))
        ranks = mixed.groupBy("key").agg(_largest_buckets().alias("ranks"))
        rows = rows.join(members.select("key", "n", "odd").join(ranks, "key"), "key")
        partner = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("partner")
        rows = rows.select("*", partner).select(
            "sign",
            F.least("block", "partner").alias("i"),
            F.greatest("block", "partner").alias("j"),
            (F.col("block") > F.col("partner")).cast("int").alias("side"),
            "key",
            "part",
            "n",
            "odd",
            "m",
            "ranks",
        )
        dealt = rows.repartition("sign", "i", "j").sortWithinPartitions("sign", "i", "j", "side")
        found = dealt.mapInArrow(_compare(percent, nearest), "key long, pivot long, by long, apart long")
        if nearest:
            best = F.min_by(F.struct("key", "pivot"), F.struct("apart", "pivot", "key")).alias("p")
            found = found.groupBy("by").agg(best).select("p.key", "p.pivot")
        tested = done[0].select("key", "pivot")
        for more in done[1:]:
            tested = tested.union(more.select("key", "pivot"))
        made = materialise(found.select("key", "pivot").distinct().join(tested, ["key", "pivot"], "left_anti"), "partenum-more", batch=TEXT_ROWS)
        return made

    # Each round joins every class to its nearest one of another component, so components merge in a
    # few rounds; what is left then is proposed whole, and at once where the buckets hold few pairs.
    done, found_links = [pairs], [links]
    few, rows, merged = 2 * members.count(), all_rows, True
    for turn in range(ROUNDS + 1):
        mixed, pairs_left = still_mixed(rows)
        if rows is not all_rows:
            discard(rows)
        rows = mixed.select("sign", "key")
        rows._shared_path = mixed._shared_path
        last = turn == ROUNDS or pairs_left <= few or not merged
        if pairs_left:
            more = proposals(mixed, nearest=not last)
            done.append(more)
            found = verified(more, compared=True)
            found_links.append(found)
            merged = not found.isEmpty()
            if merged:
                before, union = parts, found_links[0]
                for extra in found_links[1:]:
                    union = union.union(extra)
                parts = components(union)
                discard(before)
        if last:
            break
    discard(rows, buckets, *done, *found_links)
    # Names of components with several rows; the others keep their own.
    named = members.join(parts, "key", "left")
    label = F.coalesce("part", "key").alias("part")
    named = materialise(named.where("class_rows > 1 OR part IS NOT NULL").select("key", label, "first_id", "class_rows"), "partenum-names")
    ids = named.groupBy("part").agg(F.min("first_id").alias("component_id"))
    names = named
    named = materialise(named.join(ids, "part").select("key", "class_rows", "component_id", "part"), "partenum-ids")
    discard(members, parts, names)
    if tables is not None:
        tables += [base, named]
    # A class of at least one row in 2^16 is one of at most 2^16: that part may be broadcast.
    share = base.count() >> 16
    entry = lambda part, name: part.select("key", F.struct("class_rows", "component_id", "part").alias(name))
    rows = base.select("row", "doc_id", "n", "key")
    first = rows.where("key IS NOT NULL").join(F.broadcast(entry(named.where(F.col("class_rows") > share), "o")), "key", "left")
    columns = ["row", "doc_id", "n", "key", "o"]
    hot = first.where("o IS NOT NULL").select(*columns)
    cold = first.where("o IS NULL").drop("o").join(entry(named.where(F.col("class_rows") <= share), "o"), "key", "left")
    none = rows.where("key IS NULL").withColumn("o", F.lit(None).cast("struct<class_rows:bigint,component_id:bigint,part:bigint>"))
    joined = hot.unionByName(cold.select(*columns)).unionByName(none.select(*columns))
    return joined.select(
        "row",
        "doc_id",
        F.col("n").alias("n_shingles"),
        F.coalesce(F.col("o.class_rows"), F.lit(1)).cast("long").alias("class_rows"),
        F.when(F.col("o").isNull(), F.col("doc_id")).otherwise(F.col("o.component_id")).alias("component_id"),
        F.coalesce(F.col("o.part"), F.col("key")).alias("component"),
    )


def keep_one(df: DataFrame, words: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The input's rows and columns, one row per component (the smallest id, then row)."""
    df = scanned(df)
    tables: list[DataFrame] = []
    found = near_duplicates(df, words, percent, id_col, text_col, tables)
    first = F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "row")).alias("first")
    kept = found.where("component IS NOT NULL").groupBy("component").agg(first).select("first.row")
    kept = kept.union(found.where("component IS NULL").select("row"))
    kept = materialise(kept, "partenum-kept")
    discard(*tables)
    return df.withColumn("__row", row_key()).join(kept.select(F.col("row").alias("__row")), "__row", "left_semi").select(*df.columns)
