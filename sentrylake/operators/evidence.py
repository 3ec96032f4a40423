"""Evidence bundles: leaves, seals and a manifest checked as tables.

Leaf checks are computed for all leaves at once; the reported failure is the
first in leaf order, then in the order of the checks. Ed25519 signatures need a
library that is optional; without it signatures are reported as skipped.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from ..functions import fixed_values as V
from . import custody
from .asof import as_of
from .ledger import canonical

LEAF = "raw string, seq long, leaf_hash string, prev_leaf_hash string, signer_key_id string, recomputed string"
SEAL = "raw string, seal_id string, first_seq long, last_seq long, merkle_root string, prev_seal_hash string, seal_hash string, signer_key_id string, recomputed string"

#: Short keys that go into a condition at most.
FEW = 200


def as_int(x) -> int | None:
    """An integer of untrusted JSON: no booleans, no fractions lost to infinity or NaN."""
    if isinstance(x, bool) or x is None:
        return None
    try:
        n = int(x)
    except (TypeError, ValueError, OverflowError):
        return None
    return n if -(2**63) <= n < 2**63 else None


def _digest(record: dict, fields: list[str]) -> str:
    return hashlib.sha256(canonical({k: record.get(k) for k in fields})).hexdigest()


def _text(x) -> str | None:
    return None if x is None else str(x)


def _parsed(lines: DataFrame, line_col: str, kind: str, values, raw: bool) -> DataFrame:
    """Raw JSON lines as rows of ``kind``: the line, then the values of its object, null for lines that are none."""
    schema = T.StructType(T.StructType.fromDDL(kind).fields[not raw :])
    types = [to_arrow_type(f.dataType) for f in schema.fields]
    nothing = (None,) * (len(types) - raw)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for line in batch.column(0).to_pylist():
                try:
                    r = json.loads(line)
                except ValueError:
                    r = None
                rows.append(values(r) if isinstance(r, dict) else nothing)
            columns = list(zip(*rows)) if rows else [()] * len(nothing)
            arrays = [*([batch.column(0)] if raw else []), *(pa.array(c, type=t) for c, t in zip(columns, types[raw:]))]
            yield pa.RecordBatch.from_arrays(arrays, names=schema.names)

    return lines.where(F.trim(line_col) != "").select(F.col(line_col).cast("string").alias("raw")).mapInArrow(run, schema)


def parse_leaves(lines: DataFrame, line_col: str = "value", raw: bool = True) -> DataFrame:
    """Raw JSON lines as checked leaves; lines that are no objects get a null hash."""

    def values(r: dict) -> tuple:
        return (as_int(r.get("seq")), _text(r.get("leaf_hash")), _text(r.get("prev_leaf_hash")), _text(r.get("signer_key_id")), _digest(r, V.LEAF_FIELDS))

    return _parsed(lines, line_col, LEAF, values, raw)


def parse_seals(lines: DataFrame, line_col: str = "value", raw: bool = True) -> DataFrame:
    def values(r: dict) -> tuple:
        return (
            _text(r.get("seal_id")), as_int(r.get("first_seq")), as_int(r.get("last_seq")), _text(r.get("merkle_root")),
            _text(r.get("prev_seal_hash")), _text(r.get("seal_hash")), _text(r.get("signer_key_id")), _digest(r, V.SEAL_FIELDS),
        )

    return _parsed(lines, line_col, SEAL, values, raw)


def leaf_failures(leaves: DataFrame) -> DataFrame:
    """seq, check, message: every failing leaf check, numbered in the order in which they run."""
    seqless = leaves.where("seq IS NULL").select(F.lit(None).cast("long").alias("seq"), F.lit(1).alias("check"), F.lit("non-integer leaf seq (malformed record)").alias("message"))
    numbered = leaves.where("seq IS NOT NULL")
    at = F.col("seq").cast("string")
    twice = numbered.groupBy("seq").count().where("count > 1").select("seq", F.lit(2).alias("check"), F.concat(F.lit("duplicate leaf seq "), at).alias("message"))
    wrong = numbered.where(~F.col("leaf_hash").eqNullSafe(F.col("recomputed"))).select("seq", F.lit(3).alias("check"), F.concat(F.lit("leaf_hash mismatch at seq "), at).alias("message"))
    alike = _alike(numbered)
    copied = (
        alike.join(alike.groupBy("leaf_hash").agg(F.min("seq").alias("least")), "leaf_hash").where("seq > least")
        .groupBy("leaf_hash").agg(F.min("seq").alias("seq"))
        .select("seq", F.lit(4).alias("check"), F.concat(F.lit("duplicate leaf_hash at seq "), at).alias("message"))
    )
    before = numbered.select((F.col("seq") + 1).alias("seq"), F.col("leaf_hash").alias("tip"))
    broken = numbered.join(before, "seq").where(~F.col("prev_leaf_hash").eqNullSafe(F.col("tip"))).select("seq", F.lit(5).alias("check"), F.concat(F.lit("chain linkage broken at seq "), at).alias("message"))
    return seqless.unionByName(twice).unionByName(wrong).unionByName(copied).unionByName(broken.distinct())


def _alike(numbered: DataFrame) -> DataFrame:
    """seq and leaf_hash of the leaves whose hash may be another number's too: those that share a short key of it.

    Short keys are counted for all leaves, and as a rule none is shared, so the hashes themselves are not shuffled.
    """
    keyed = numbered.where("leaf_hash IS NOT NULL").select("seq", "leaf_hash", F.xxhash64("leaf_hash").alias("short"))
    shared = keyed.groupBy("short").agg(F.min("seq").alias("a"), F.max("seq").alias("b")).where("a < b").select("short")
    few = [r[0] for r in shared.limit(FEW + 1).collect()]
    if len(few) > FEW:
        return keyed.join(shared, "short", "left_semi").select("seq", "leaf_hash")
    return keyed.where(F.col("short").isin(few) if few else F.lit(False)).select("seq", "leaf_hash")


def _node(left: Column, right: Column) -> Column:
    return F.sha2(F.concat(F.unhex(F.lit("01")), F.unhex(left), F.unhex(right)), 256)


def leaf_node(digest: Column) -> Column:
    return F.sha2(F.concat(F.unhex(F.lit("00")), F.unhex(digest)), 256)


def merkle_roots(leaves: DataFrame, group_cols: list[str], order_col: str, hash_col: str, most: int, numbered: bool = False) -> DataFrame:
    """The Merkle root of each group's hashes in order, level by level over all groups.

    An odd node moves up as it is. ``most`` bounds the largest group: it sets the
    number of levels. Each level halves the rows; no group is gathered anywhere
    if ``order_col`` numbers it from 0 without holes (``numbered``).
    """
    place = F.col(order_col).cast("long") if numbered else F.row_number().over(Window.partitionBy(*group_cols).orderBy(order_col)) - 1
    level = leaves.select(*group_cols, place.alias("i"), leaf_node(F.col(hash_col)).alias("h"))
    width = max(1, most)
    while width > 1:
        pair = level.groupBy(*group_cols, F.floor(F.col("i") / 2).cast("long").alias("i"))
        sides = pair.agg(F.min_by("h", level["i"]).alias("l"), F.max_by("h", level["i"]).alias("r"), F.count(F.lit(1)).alias("n"))
        level = sides.select(*group_cols, "i", F.when(F.col("n") == 2, _node(F.col("l"), F.col("r"))).otherwise(F.col("l")).alias("h"))
        width = (width + 1) // 2
    return level.select(*group_cols, F.col("h").alias("root"))


def merkle_root(hashes: list[str]) -> str:
    """One root on the driver, for a short list."""
    if not hashes:
        return hashlib.sha256(b"").hexdigest()
    row = [hashlib.sha256(b"\0" + bytes.fromhex(h)).digest() for h in hashes]
    while len(row) > 1:
        row = [hashlib.sha256(b"\1" + b"".join(row[i : i + 2])).digest() if i + 1 < len(row) else row[i] for i in range(0, len(row), 2)]
    return row[0].hex()


def _ranked(leaves: DataFrame) -> DataFrame:
    """seq, rank (1 for the least) and island (equal for neighbours without a gap) of the distinct numbers."""
    width = 1 << 16
    present = leaves.select("seq").where("seq IS NOT NULL").distinct().withColumn("chunk", F.floor(F.col("seq") / width))
    chunks = present.groupBy("chunk").agg(F.count(F.lit(1)).alias("n"))
    before = chunks.select(F.col("chunk").alias("of"), (F.sum("n").over(Window.orderBy("chunk")) - F.col("n")).alias("before"))  # a row per 65,536 numbers
    within = Window.partitionBy("chunk").orderBy("seq")
    ranked = present.join(before, F.col("chunk") == F.col("of")).withColumn("rank", F.col("before") + F.row_number().over(within))
    return ranked.select("seq", "rank", (F.col("seq") - F.col("rank")).alias("island"))


def seal_coverage(leaves: DataFrame, seals: DataFrame) -> DataFrame:
    """Per seal the leaves present in its range and the first one that is missing.

    Never builds a seal's range: leaves are ranked, and both ends of a seal meet
    the last leaf at or before them. All joins are by equality.
    Columns of leaves: seq; of seals: seal_id, first_seq, last_seq.
    """
    named = seals.select("seal_id", "first_seq", "last_seq")
    ranked = _ranked(leaves)
    ends = F.explode(F.array(*(F.struct(F.lit(k).alias("end"), v.alias("at")) for k, v in enumerate((F.col("first_seq") - 1, F.col("first_seq"), F.col("last_seq"))))))
    points = named.select("seal_id", "first_seq", "last_seq", ends.alias("e")).select("seal_id", "first_seq", "last_seq", "e.end", "e.at")
    met = as_of(points, ranked.withColumn("at", F.col("seq")), [], "at", F.struct("seq", "rank", "island"), 1 << 16)
    rank = lambda end: F.coalesce(F.max(F.when(F.col("end") == end, F.col("mark.rank"))), F.lit(0))
    at_first = F.max(F.when((F.col("end") == 1) & (F.col("mark.seq") == F.col("first_seq")), F.col("mark.island")))
    found = met.groupBy("seal_id", "first_seq", "last_seq").agg(F.greatest(rank(2) - rank(0), F.lit(0)).alias("covered"), at_first.alias("island"))
    islands = ranked.groupBy("island").agg(F.max("seq").alias("upto"))
    expected = F.col("last_seq") - F.col("first_seq") + 1
    return found.join(islands, "island", "left").select(
        "seal_id", "first_seq", "last_seq", expected.alias("expected"), "covered",
        F.when(F.col("covered") < expected, F.coalesce(F.col("upto") + 1, "first_seq")).alias("missing_seq"),
    )


def sealed_leaves(leaves: DataFrame, full: DataFrame) -> DataFrame:
    """seal_id, i (from 0) and leaf_hash of seals whose leaves are all there.

    Seals and leaves meet by equality on short stretches of the sequence; a seal
    has as many as its leaves fill.
    """
    width = 256
    stretches = F.sequence(F.floor(F.col("first_seq") / width), F.floor(F.col("last_seq") / width))
    spread = full.select("seal_id", "first_seq", "last_seq", F.explode(stretches).alias("stretch"))
    placed = leaves.select("seq", "leaf_hash", F.floor(F.col("seq") / width).alias("stretch"))
    met = spread.join(placed, "stretch").where(F.col("seq").between(F.col("first_seq"), F.col("last_seq")))
    return met.select("seal_id", (F.col("seq") - F.col("first_seq")).alias("i"), "leaf_hash")


def leaves_digest(leaves: DataFrame) -> str:
    """SHA-256 of the sorted [seq, leaf_hash] list.

    One hash over one ordered list is sequential by definition: the sorted rows
    (16 bytes and a hash each) stream through one task, which holds none of them.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        h, first = hashlib.sha256(b"["), True
        for pdf in batches:
            rows = [canonical([int(seq), None if hash_ is None else hash_]) for seq, hash_ in zip(pdf["seq"], pdf["leaf_hash"])]
            h.update((b"" if first or not rows else b",") + b",".join(rows))
            first = first and not rows
        h.update(b"]")
        yield pd.DataFrame({"digest": [h.hexdigest()]})

    pairs = leaves.select(F.coalesce("seq", F.lit(0)).cast("long").alias("seq"), "leaf_hash")
    found = pairs.repartition(1).sortWithinPartitions("seq").mapInPandas(run, "digest string").first()
    return found["digest"] if found else hashlib.sha256(b"[]").hexdigest()


def unexplained_keys(leaves: DataFrame, seals: DataFrame, keys: DataFrame) -> DataFrame:
    """Signer keys of leaves and seals that the key table does not name."""
    used = leaves.select("signer_key_id").union(seals.select("signer_key_id")).where("signer_key_id IS NOT NULL").distinct()
    return used.join(keys.select(F.col("key_id").alias("signer_key_id")), "signer_key_id", "left_anti")


def certificate_cover(leaves: DataFrame, certificates: DataFrame) -> DataFrame:
    """Leaves whose signing time no certificate of their key covers. Certificates are few per key."""
    valid = F.col("created_at").between(F.col("not_before"), F.col("not_after"))
    return leaves.alias("l").join(certificates.alias("c"), (F.col("l.signer_key_id") == F.col("c.key_id")) & valid, "left_anti")


def covered_seals(leaves: DataFrame, seals: DataFrame) -> DataFrame:
    """What seal_coverage says of each seal, beside what the seal claims."""
    return seal_coverage(leaves, seals).join(seals.select("seal_id", "merkle_root", "seal_hash", "recomputed"), "seal_id")


def seal_failures(leaves: DataFrame, seals: DataFrame, binds_content: bool, most: int = 1 << 16, cover: DataFrame | None = None) -> DataFrame:
    """first_seq, check, message of failing seals; partial ones are warnings and not here.

    ``cover``: the covered_seals of both, which are read twice, for a caller that keeps them.
    """
    ends = leaves.agg(F.min("seq").alias("low"), F.max("seq").alias("high"), F.countDistinct("seq").alias("n")).first()
    low, high, n = (F.lit(ends[k]).cast("long") for k in ("low", "high", "n"))
    c = covered_seals(leaves, seals) if cover is None else cover
    full = c.where("covered = expected").select("seal_id", "first_seq", "last_seq")
    roots = merkle_roots(sealed_leaves(leaves, full), ["seal_id"], "i", "leaf_hash", most, numbered=True)
    text = lambda *parts: F.concat(*(F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts))
    seal, first, last = F.col("seal_id"), F.col("first_seq"), F.col("last_seq")
    part = F.col("covered") != F.col("expected")
    window = (first >= low) & (last <= high)
    found = [
        (~F.col("seal_hash").eqNullSafe(F.col("recomputed")), first, 1, text("seal_hash mismatch for seal ", seal)),
        ((F.col("covered") == F.col("expected")) & (F.col("root") != F.col("merkle_root")), first, 2, text("merkle root mismatch for seal ", seal)),
    ]
    if not binds_content:
        gone = text("deleted leaf — seal ", seal, " (missing seq ", F.col("missing_seq"), ")")
        cut = text("truncated log — seal ", seal, " but leaves end at ", high)
        found.append((part & window, F.col("missing_seq"), 3, gone))
        found.append((part & ~window & (n == high - low + 1) & first.between(low, high), high + 1, 3, cut))
    each = F.array(*(F.when(is_so, F.struct(at.alias("first_seq"), F.lit(k).alias("check"), said.alias("message"))) for is_so, at, k, said in found))
    return c.join(roots, "seal_id", "left").select(F.explode(F.filter(each, lambda x: x.isNotNull())).alias("f")).select("f.*")


def manifest_mismatches(leaves: DataFrame, n_seals: int, manifest: dict) -> list[str]:
    """Fields of a trusted manifest that the leaves and seals do not meet."""
    ends = leaves.agg(F.min("seq"), F.max("seq"), F.count(F.lit(1))).first()
    out = [f"{k} {manifest[k]}≠{v}" for k, v in (("first_seq", ends[0]), ("last_seq", ends[1])) if k in manifest and manifest[k] != v]
    out += [f"{k} {manifest[k]}≠{v}" for k, v in (("leaf_count", ends[2]), ("seal_count", n_seals)) if manifest.get(k) is not None and as_int(manifest[k]) != v]
    if manifest.get("leaves_digest") is not None and manifest["leaves_digest"] != leaves_digest(leaves):
        out.append("leaves_digest mismatch (exported leaf set altered)")
    return out


RESULT = (
    "ok boolean, leaves_checked long, seals_checked long, first_bad_seq long, error string, signatures_skipped boolean, "
    "warnings array<string>, rotations_checked int, unexplained_key_ids array<string>, attestation string, attestation_reasons array<string>"
)


def verify_bundle(
    leaf_lines: DataFrame,
    seal_lines: DataFrame,
    manifest: dict | None = None,
    manifest_trusted: bool = False,
    keys: list | None = None,
    rotations: list | None = None,
    certificates: dict | None = None,
    signed: custody.Signed | None = None,
    root: str | None = None,
) -> DataFrame:
    """One row: whether the bundle holds, how far it was checked, and the first failure in the order of the checks.

    Whoever can check the manifest's signature says so with ``manifest_trusted``;
    ``signed`` checks those of key handovers. Leaf and seal signatures and
    certificates are not checked, so a bundle is self-attested at best. Whatever
    hostile bytes raise on the way is a failure of the bundle.
    """
    spark = leaf_lines.sparkSession
    leaves, seals = parse_leaves(leaf_lines, raw=False).cache(), parse_seals(seal_lines, raw=False).cache()
    try:
        row = _verified(leaves, seals, manifest or {}, manifest_trusted, keys or [], rotations or [], certificates or {}, signed, root)
    except Exception as e:  # noqa: BLE001 - fails closed
        row = (False, 0, 0, None, f"malformed bundle ({type(e).__name__})", True, [], 0, [], None, [])
    leaves.unpersist()
    seals.unpersist()
    return spark.createDataFrame([row], RESULT)


def _verified(leaves, seals, manifest, trusted, keys, rotations, certificates, signed, root) -> tuple:
    n_seals = seals.count()
    failure = leaf_failures(leaves).orderBy(F.asc_nulls_first("seq"), "check").first()
    said = (failure["seq"], failure["message"]) if failure else None
    checked = leaves.count() if said is None else (leaves.where(F.col("seq") < said[0]).count() if said[0] is not None else 0)
    held = custody.Custody()
    unexplained: list[str] = []
    if said is None:
        held = custody.check_custody(manifest, trusted, keys, rotations, signed)
        said = (None, held.error) if held.error else None
        if held.rotations_checked and not held.error:
            used = leaves.select("signer_key_id").union(seals.select("signer_key_id")).where("signer_key_id IS NOT NULL").distinct()
            named = leaves.sparkSession.createDataFrame([(k,) for k in sorted(held.explained)], "signer_key_id string")
            unexplained = sorted(r[0] for r in used.join(named, "signer_key_id", "left_anti").toLocalIterator())  # keys of a bundle are few
    if said is None and seals.where("recomputed IS NULL").limit(1).count():
        said = (None, "malformed seal record")
    if said is None and seals.where("first_seq IS NULL OR last_seq IS NULL").limit(1).count():
        said = (None, "non-integer seal range (malformed record)")
    if said is None:
        binds = trusted and manifest.get("leaves_digest") is not None
        widest = seals.agg(F.max(F.col("last_seq") - F.col("first_seq") + 1)).first()[0] or 1
        cover = covered_seals(leaves, seals).cache()
        try:
            bad = seal_failures(leaves, seals, binds, min(int(widest), max(checked, 1)), cover).orderBy("first_seq", "check").first()
        finally:
            cover.unpersist()
        said = (bad["first_seq"], bad["message"]) if bad else None
    if said is None and trusted and (wrong := manifest_mismatches(leaves, n_seals, manifest)):
        said = (leaves.agg(F.min("seq")).first()[0], "signed manifest commits to records that are not present (" + ", ".join(wrong) + ")")
    if said:
        return (False, checked, 0, *said, True, held.warnings, held.rotations_checked, unexplained, None, [])
    reason = custody.claim(certificates, False, trusted, root)
    return (True, checked, n_seals, None, None, True, held.warnings, held.rotations_checked, unexplained, "SELF-ATTESTED", [reason])
