"""Exact duplicates through Patricia-trie owners.

Texts are dealt by length and content hash. Each map task first inserts its
full byte strings into compressed radix tries, one per length, whose terminal
nodes hold the owner so far; beyond the memory budget the largest trie spills
its largest subtree as finished terminals. Only those terminals are shuffled, so a group of copies
costs one row per map task however large it is. Reduce tasks insert the byte
strings of a (length, hash) run into a trie again and emit final owners.

Defined cases: null text equals the empty text; of equal texts the row with the
largest doc_id stays, null ids rank lowest, and of rows that tie on the id the
one with the smallest row key stays; an empty table gives no rows; other input
columns are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, fold_case, hold, materialise, row_key, scanned

#: Bytes of text a map-side trie may hold before it spills a subtree.
TRIE_BYTES = 64 << 20


class Node:
    __slots__ = ("children", "label", "owner")

    def __init__(self, label: bytes, owner: list | None = None):
        self.label, self.owner, self.children = label, owner, {}


def better(a, b):
    """The larger of two ids; None is smaller than any."""
    return b if a is None or (b is not None and b > a) else a


class PatriciaTrie:
    """Byte strings -> [largest id, rows with it, rows]; edges hold whole byte runs."""

    def __init__(self):
        self.root, self.size = Node(b""), 0

    def insert(self, key: bytes, doc_id, ties: int = 1, rows: int = 1) -> None:
        node, at = self.root, 0
        while True:
            rest = len(key) - at
            if not rest:
                break
            child = node.children.get(key[at])
            if child is None:
                fresh = Node(key[at:])
                node.children[key[at]] = fresh
                self.size += rest + 400
                node = fresh
                break
            if key.startswith(child.label, at):
                node, at = child, at + len(child.label)
                continue
            cut = shared_prefix(child.label, key[at : at + len(child.label)])
            upper = Node(child.label[:cut])
            child.label = child.label[cut:]
            upper.children[child.label[0]] = child
            node.children[key[at]] = upper
            self.size += 400
            node, at = upper, at + cut
        if node.owner is None:
            node.owner = [doc_id, ties, rows]
            return
        own = node.owner
        best = better(own[0], doc_id)
        own[1] = (own[1] if own[0] == best else 0) + (ties if doc_id == best else 0)
        own[0] = best
        own[2] += rows

    def terminals(self, start: Node | None = None, prefix: bytes = b"") -> Iterator[tuple[bytes, list]]:
        stack = [(start or self.root, prefix)]
        while stack:
            node, before = stack.pop()
            here = before + node.label
            if node.owner is not None:
                yield here, node.owner
            stack += [(c, here) for c in node.children.values()]

    def spill(self) -> Iterator[tuple[bytes, list]]:
        """Empties the largest subtree under the deepest shared prefix."""
        node, prefix = self.root, b""
        while len(node.children) == 1 and node.owner is None:
            node = next(iter(node.children.values()))
            prefix += node.label
        if node.owner is not None:
            yield prefix, node.owner
            node.owner = None
        if not node.children:
            self.__init__()
            return
        weigh = {k: weight(c) for k, c in node.children.items()}
        first = max(weigh, key=weigh.get)
        subtree = node.children.pop(first)
        yield from self.terminals(subtree, prefix)
        self.size -= min(self.size, weigh[first])


def weight(start: Node) -> int:
    total, stack = 0, [start]
    while stack:
        node = stack.pop()
        total += len(node.label) + 400
        stack += node.children.values()
    return total


def shared_prefix(a: bytes, b: bytes) -> int:
    """Length of the common prefix, by bisection on slices."""
    low, high = 0, min(len(a), len(b))
    while low < high:
        mid = (low + high + 1) // 2
        low, high = (mid, high) if a[:mid] == b[:mid] else (low, mid - 1)
    return low


PARTIAL = "n_bytes long, key long, body binary, best long, ties long, n_rows long"
OWNERS = "text_sha256 string, n_bytes long, keep_id long, ties long, group_size long"


def _content_hash(body: bytes) -> int:
    return int.from_bytes(hashlib.blake2b(body, digest_size=8).digest(), "little", signed=True)


def _partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    hold(__name__)
    tries: dict[int, PatriciaTrie] = {}  # by length: none of a trie's keys begins another
    held = 0
    for batch in batches:
        ids, bodies = batch.column(0).to_pylist(), batch.column(1)
        for doc_id, body in zip(ids, bodies):
            key = body.as_py()
            trie = tries.get(len(key))
            if trie is None:
                trie = tries[len(key)] = PatriciaTrie()
            held -= trie.size
            trie.insert(key, doc_id)
            held += trie.size
            while held > TRIE_BYTES:
                length, largest = max(tries.items(), key=lambda x: x[1].size)
                held -= largest.size
                yield from _rows(largest.spill())
                held += largest.size
                if not largest.size:
                    del tries[length]
    for trie in tries.values():
        yield from _rows(trie.terminals())


def _rows(found: Iterator[tuple[bytes, list]]) -> Iterator[pa.RecordBatch]:
    rows, held = [], 0
    for body, own in found:
        rows.append((len(body), _content_hash(body), body, *own))
        held += len(body)
        if held > 4 << 20:
            yield _batch(rows)
            rows, held = [], 0
    if rows:
        yield _batch(rows)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64()]
    return pa.RecordBatch.from_arrays(
        [pa.array(c, type=t) for c, t in zip(zip(*rows), kinds)], names=["n_bytes", "key", "body", "best", "ties", "n_rows"]
    )


def _final(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Input is sorted by (n_bytes, key), so one run's trie is alive at a time."""
    hold(__name__)
    trie, run, out = PatriciaTrie(), None, []

    def flush():
        out.extend(
            (hashlib.sha256(body).hexdigest(), len(body), own[0], own[1], own[2]) for body, own in trie.terminals()
        )

    def emit():
        kinds = [pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.int64()]
        names = ["text_sha256", "n_bytes", "keep_id", "ties", "group_size"]
        return pa.RecordBatch.from_arrays([pa.array(c, type=t) for c, t in zip(zip(*out), kinds)], names=names)

    for batch in batches:
        sizes, keys = batch.column(0).to_pylist(), batch.column(1).to_pylist()
        rest = [batch.column(i).to_pylist() for i in (3, 4, 5)]
        for i, (size, key, body) in enumerate(zip(sizes, keys, batch.column(2))):
            if (size, key) != run:
                flush()
                trie, run = PatriciaTrie(), (size, key)
                if len(out) >= 4096:
                    yield emit()
                    out.clear()
            trie.insert(body.as_py(), rest[0][i], rest[1][i], rest[2][i])
    flush()
    if out:
        yield emit()


def owners(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per distinct text: its owner, rows tied on that id, and group size."""
    source = df.select(F.col(id_col).cast("long").alias("id"), fold_case(F.col(text_col)).cast("binary").alias("body"))
    partial = source.mapInArrow(_partial, PARTIAL)
    dealt = partial.repartition("n_bytes", "key").sortWithinPartitions("n_bytes", "key")
    return dealt.mapInArrow(_final, OWNERS)


def assign(
    df: DataFrame, id_col: str = "doc_id", text_col: str = "text", tables: list[DataFrame] | None = None
) -> DataFrame:
    """One row per input row: row, doc_id, keep_id, group_size, kept, text_sha256.

    The shared-folder tables the result reads are added to ``tables``.
    """
    keys = materialise(
        df.select(
            row_key().alias("row"),
            F.col(id_col).cast("long").alias("doc_id"),
            F.sha2(fold_case(F.col(text_col)).cast("binary"), 256).alias("text_sha256"),
        ),
        "trie-keys",
    )
    own = materialise(owners(df, id_col, text_col).where("group_size > 1"), "trie-owners")
    if tables is not None:
        tables += [keys, own]
    # An owner of at least one row in 2^16 is one of at most 2^16 owners: that part may be broadcast.
    share = keys.count() >> 16
    hot, cold = own.where(F.col("group_size") > share), own.where(F.col("group_size") <= share)
    entry = lambda part, name: part.select("text_sha256", F.struct("keep_id", "ties", "group_size").alias(name))
    first = keys.join(F.broadcast(entry(hot, "h")), "text_sha256", "left")
    columns = ["row", "doc_id", "text_sha256", "o"]
    of_hot = first.where(F.col("h").isNotNull()).withColumnRenamed("h", "o").select(*columns)
    of_cold = first.where(F.col("h").isNull()).join(entry(cold, "o"), "text_sha256", "left").select(*columns)
    o, shared = F.col("o"), F.col("o").isNotNull()
    joined = of_hot.unionByName(of_cold).select(
        "row",
        "doc_id",
        F.when(shared, o["keep_id"]).otherwise(F.col("doc_id")).alias("keep_id"),
        F.coalesce(o["group_size"], F.lit(1)).cast("long").alias("group_size"),
        (~shared | F.col("doc_id").eqNullSafe(o["keep_id"])).alias("is_best"),
        (F.coalesce(o["ties"], F.lit(1)) > 1).alias("tied"),
        "text_sha256",
    )
    # Of rows tied on the owner's id the smallest row key stays; joined by row key, which no group shares.
    is_tied = F.col("is_best") & F.col("tied")
    chosen = joined.where(is_tied).groupBy("text_sha256").agg(F.min("row").alias("row")).select("row", F.lit(True).alias("chosen"))
    settled = joined.where(~is_tied).withColumn("kept", F.col("is_best"))
    ties = joined.where(is_tied).join(chosen, "row", "left").withColumn("kept", F.col("chosen").isNotNull())
    out = ["row", "doc_id", "keep_id", "group_size", "kept", "text_sha256"]
    return settled.select(*out).unionByName(ties.select(*out))


def drop_copies(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The input's rows and columns without the copies."""
    df = scanned(df)
    tables: list[DataFrame] = []
    assigned = assign(df, id_col, text_col, tables)
    dropped = materialise(assigned.where(~F.col("kept")).select(F.col("row").alias("__row")), "trie-dropped")
    discard(*tables)
    return df.withColumn("__row", row_key()).join(dropped, "__row", "left_anti").select(*df.columns)
