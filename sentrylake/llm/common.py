"""Shared plumbing: table access, shared-folder tables and Arrow row mapping."""

from __future__ import annotations

import ctypes
import gc
import re
import tempfile
import time
import uuid
from collections.abc import Callable, Iterable, Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

#: ASCII upper and lower case, for the A-Z-only lower-casing the operators use.
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared folder; a folder of our own only where none is set."""
    where = spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        where = spark.sparkContext.getCheckpointDir()
    if not where:
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="sentrylake-"))
        where = spark.sparkContext.getCheckpointDir()
    return where


@contextmanager
def batches_of(spark: SparkSession, rows: int | None):
    """Python tasks that start within get so many rows at once at most: where rows are large, Spark's own
    number of rows is hundreds of MB, which the executor and its Python worker both hold."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    if rows:
        spark.conf.set(name, str(rows))
    try:
        yield
    finally:
        spark.conf.set(name, before)


def materialise(df: DataFrame, tag: str, codec: str = "zstd", partition_by: str | None = None, batch: int | None = None) -> DataFrame:
    """Writes ``df`` as a Parquet table in the shared folder and reads it back.

    This cuts the lineage: a lost executor costs only the tasks that read the
    table, and Python stages are not run a second time by later readers.
    ``batch``: rows that a Python task of it gets at once at most.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{tag}-{uuid.uuid4().hex}"
    writer = df.write.option("compression", codec)
    with batches_of(spark, batch):
        (writer.partitionBy(partition_by) if partition_by else writer).parquet(path)
    fields = [f for f in df.schema.fields if f.name != partition_by] + [f for f in df.schema.fields if f.name == partition_by]
    back = spark.read.schema(T.StructType(fields)).parquet(path)
    back._shared_path = path
    return back


def split_off(df: DataFrame, column: str, value: int) -> DataFrame:
    """The part of a table written with ``partition_by`` that holds one value, as a table that can be discarded alone."""
    fields = [f for f in df.schema.fields if f.name != column]
    path = f"{df._shared_path}/{column}={value}"
    where, files = _file_system(df.sparkSession, path)
    kind = T.StructType(fields)
    rows = df.sparkSession.read.schema(kind).parquet(path) if files.exists(where) else df.sparkSession.createDataFrame([], kind)
    part = rows.withColumn(column, F.lit(value))
    part._shared_path = path
    return part


def _file_system(spark: SparkSession, path: str):
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where, where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def discard(*tables: DataFrame) -> None:
    """Deletes tables that ``materialise`` wrote, once nothing reads them any more.

    The garbage of the driver and its Python is collected as well: Spark drops
    the shuffle files of plans that nobody holds only then.
    """
    gc.collect()
    for df in tables:
        path = getattr(df, "_shared_path", None)
        if path:
            where, files = _file_system(df.sparkSession, path)
            files.delete(where, True)
    session = SparkSession.getActiveSession()
    for pause in (0.2, 0.0) if session else ():
        # Python lets go of its plans a moment after it has collected them, and Spark sees that one collection later.
        session.sparkContext._jvm.System.gc()
        time.sleep(pause)


def row_key() -> Column:
    """A key per input row: the same whenever it is computed, as long as the input is ``scanned``."""
    return F.monotonically_increasing_id()


def scanned(df: DataFrame) -> DataFrame:
    """The rows as a table scan with at most projections and filters above it, whose row keys are stable; others are written first."""
    nodes = df._jdf.queryExecution().optimizedPlan().toString().splitlines()
    names = {re.sub(r"^[\s:+\-!]*", "", line).split(" ")[0].split("(")[0] for line in nodes if line.strip()}
    return df if names <= {"Relation", "Project", "Filter"} else materialise(df, "scanned")


#: Who remembers things in this Python worker, and what.
_HOLDER: dict = {"owner": None, "caches": ()}


def hold(owner: str, *caches) -> None:
    """Called as a task starts: an operator's caches stay from task to task, and go when another one's task begins.

    Workers are used again by all stages, so without this each operator's
    memory would come on top of those before.
    """
    if _HOLDER["owner"] != owner:
        release(*_HOLDER["caches"])
        _HOLDER["owner"] = owner
    _HOLDER["caches"] = caches


def release(*caches) -> None:
    """Empties caches and hands the memory back."""
    for x in caches:
        x.clear()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def remainder(doc_id: Column, k: int) -> Column:
    """crc32(doc_id as text) mod k; null for a null id."""
    return F.crc32(doc_id.cast("string").cast("binary")) % k


def fold_case(text: Column) -> Column:
    """Null as empty, A-Z lower-cased and nothing else."""
    return F.translate(F.coalesce(text.cast("string"), F.lit("")), UPPER, LOWER)


def texts_of(batch: pa.RecordBatch, at: int) -> list[str]:
    """A batch's text column with null as empty."""
    return [x or "" for x in batch.column(at).to_pylist()]


def extend(
    df: DataFrame,
    text_col: str,
    fn: Callable[[list[str]], dict[str, Iterable]],
    fields: list[T.StructField],
    keep: list[str] | None = None,
    caches: Callable[[], tuple] | None = None,
) -> DataFrame:
    """Adds columns computed from whole texts, batch by batch, without a shuffle.

    ``keep`` names the input columns to return (all by default). An input
    column whose name equals a new one's (ignoring case) is replaced. ``caches``
    names what ``fn`` remembers in a worker.
    """
    new = {f.name.lower() for f in fields}
    wanted = [c for c in (df.columns if keep is None else keep) if c.lower() not in new]
    source = df.select(*dict.fromkeys([*wanted, text_col]))
    at, n_kept = source.columns.index(text_col), len(wanted)
    types = [to_arrow_type(f.dataType) for f in fields]
    schema = T.StructType([*source.schema.fields[:n_kept], *fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hold(fn.__module__, *(caches() if caches else ()))
        for batch in batches:
            made = fn(texts_of(batch, at))
            arrays = [*batch.columns[:n_kept], *(pa.array(made[f.name], type=t) for f, t in zip(fields, types))]
            yield pa.RecordBatch.from_arrays(arrays, names=schema.names)

    return source.mapInArrow(run, schema)


def labelled_sample(
    df: DataFrame, labels: DataFrame, label_col: str, allowed: Column, bound: int, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """doc_id, text and y of about ``bound`` labelled rows at most, chosen by the id's hash.

    ``allowed`` is a condition on the label table's id. All labelled rows are
    taken while there are no more than the bound; null ids and labels never.
    The chosen ids are as many as the bound, so they may be broadcast and the
    texts are not shuffled.
    """
    usable = labels.where(F.col(id_col).isNotNull() & F.col(label_col).isNotNull() & allowed)
    one_each = usable.groupBy(F.col(id_col).cast("long").alias("doc_id")).agg(F.max(label_col).cast("int").alias("y"))
    n = one_each.count()
    if n > bound:
        share = int(bound / n * (1 << 30))
        one_each = one_each.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) < share)
    texts = df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return texts.join(F.broadcast(one_each), "doc_id")
