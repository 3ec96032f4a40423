"""Evidence bundles and event logs as tables; small JSON parts on the driver.

Log lines are read by Spark, so they may lie in any store it knows. Zip files
are unpacked by the driver into the shared folder first.
"""

from __future__ import annotations

import json
import os
import uuid
import zipfile
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """Non-blank lines of a text file as ``value``; no rows if it is missing."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    files = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not files.exists(where):
        return spark.createDataFrame([], "value string")
    return spark.read.text(path).where(F.trim("value") != "")


def numbered_lines(spark: SparkSession, path: str, chain: str = "log") -> DataFrame:
    """chain, pos, line of one log in file order; pos counts non-blank lines from 1.

    Lines are numbered by their place among partitions, so the whole log never
    meets in one task.
    """
    lines = read_lines(spark, path).withColumn("id", F.monotonically_increasing_id())
    lines = lines.withColumn("part", F.shiftright("id", 33)).withColumn("at", F.col("id").bitwiseAND(F.lit((1 << 33) - 1)))
    sizes = {r["part"]: r["n"] for r in lines.groupBy("part").agg(F.count(F.lit(1)).alias("n")).collect()}  # one row a partition
    before, total = {}, 0
    for part in sorted(sizes):
        before[part], total = total, total + sizes[part]
    offset = F.lit(0).cast("long")
    if before:
        offset = F.element_at(F.create_map(*(F.lit(x).cast("long") for kv in before.items() for x in kv)), F.col("part"))
    return lines.select(F.lit(chain).alias("chain"), (offset + F.col("at") + 1).alias("pos"), F.col("value").alias("line"))


def read_events(spark: SparkSession, path: str, schema: T.StructType | str, limit: int = 50, user_id=None) -> DataFrame:
    """The newest events of a JSONL log by file order, 1 to 200; lines that are no JSON are skipped."""
    lines = numbered_lines(spark, path)
    parsed = lines.select("pos", F.from_json("line", schema).alias("e"), F.try_parse_json("line").alias("v")).where("v IS NOT NULL").select("pos", "e.*")
    if user_id is not None:
        parsed = parsed.where(F.col("user_id") == F.lit(user_id))
    return parsed.orderBy(F.desc("pos")).limit(max(1, min(200, limit)))


@dataclass
class Bundle:
    leaves: DataFrame
    seals: DataFrame
    keys: list = field(default_factory=list)
    manifest: dict = field(default_factory=dict)
    certificates: dict = field(default_factory=dict)
    rotations: list = field(default_factory=list)


def _small(spark: SparkSession, path: str, kind: type):
    """A small JSON file; missing or malformed optional parts are empty."""
    text = "\n".join(r["value"] for r in read_lines(spark, path).collect())
    try:
        found = json.loads(text) if text else kind()
    except ValueError:
        return kind()
    return found if isinstance(found, kind) else kind()


def load_bundle(spark: SparkSession, path: str) -> Bundle:
    """A bundle directory in any store, or a zip file on the driver's disk."""
    if path.endswith(".zip"):
        path = unpack(spark, path)
    return Bundle(
        read_lines(spark, f"{path}/leaves.jsonl"),
        read_lines(spark, f"{path}/seals.jsonl"),
        _small(spark, f"{path}/keys.json", list),
        _small(spark, f"{path}/manifest.json", dict),
        _small(spark, f"{path}/certificates.json", dict),
        _small(spark, f"{path}/key-rotations.json", list),
    )


MEMBERS = {"leaves.jsonl", "seals.jsonl", "keys.json", "manifest.json", "certificates.json", "key-rotations.json"}


def unpack(spark: SparkSession, path: str) -> str:
    """A folder with the bundle's own members in the shared folder that spark.checkpoint.dir names.

    Beside the zip file only where none is set, as in a local session.
    """
    shared = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir() or os.path.dirname(os.path.abspath(path))
    folder = f"{shared}/bundle-{uuid.uuid4().hex}"
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    with zipfile.ZipFile(path) as z:
        for name in sorted(MEMBERS & set(z.namelist())):
            where = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/{name}")
            out = where.getFileSystem(conf).create(where)
            try:
                with z.open(name) as member:
                    while part := member.read(1 << 20):
                        out.write(bytearray(part))
            finally:
                out.close()
    return folder


def all_objects(lines: DataFrame) -> bool:
    """Whether every line is a JSON object: one that is not fails a bundle."""
    return lines.where(~F.coalesce(F.schema_of_variant(F.try_parse_json("value")).startswith("OBJECT"), F.lit(False))).isEmpty()
