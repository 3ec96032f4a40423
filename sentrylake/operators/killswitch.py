"""Kill switch over event tables: trips, automatic panic, state look-ups.

The batch form works on the events' order; a run's later critical actions are
refused before they are screened, so only first trips count toward a panic.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

WINDOW_SECONDS, THRESHOLD, RING = 60, 5, 200


def micros(ts: Column) -> Column:
    return F.unix_micros(ts.cast("timestamp"))


def first_trips(events: DataFrame, run_col: str, ts_col: str, critical: Column, id_col: str) -> DataFrame:
    """Each run's first critical event: run, ts, event id. Runs without an id trip every time."""
    hits = events.where(critical)
    first = (
        hits.where(F.col(run_col).isNotNull())
        .groupBy(run_col)
        .agg(F.min(F.struct(F.col(ts_col).alias("ts"), F.col(id_col).alias("id"))).alias("f"))
        .select(F.col(run_col).alias("run"), "f.ts", "f.id")
    )
    loose = hits.where(F.col(run_col).isNull()).select(F.col(run_col).alias("run"), F.col(ts_col).alias("ts"), F.col(id_col).alias("id"))
    return first.unionByName(loose)


def latest_trips(trips: DataFrame, run_col: str, ts_col: str, *columns: str) -> DataFrame:
    """The latest record per run."""
    return trips.groupBy(run_col).agg(F.max_by(F.struct(*columns), ts_col).alias("r")).select(run_col, "r.*")


def rolling_counts(trips: DataFrame, seconds: int = WINDOW_SECONDS) -> DataFrame:
    """Adds n: trips in the trailing window, the ends included.

    The range frame runs within time buckets of one window each: a trip is
    copied into the next bucket as well, so no task sees the whole history.
    """
    width = seconds * 1_000_000
    at = trips.withColumn("us", micros(F.col("ts"))).withColumn("own", F.floor(F.col("us") / width))
    copies = at.withColumn("bucket", F.explode(F.array(F.col("own"), F.col("own") + 1)))
    trailing = Window.partitionBy("bucket").orderBy("us").rangeBetween(-width, 0)
    counted = copies.withColumn("n", F.count(F.lit(1)).over(trailing))
    return counted.where(F.col("bucket") == F.col("own")).drop("bucket", "own", "us")


def panic(trips: DataFrame, seconds: int = WINDOW_SECONDS, threshold: int = THRESHOLD) -> DataFrame:
    """The first automatic panic, or no row: panicked_at, run, n."""
    reached = rolling_counts(trips, seconds).where(F.col("n") >= threshold)
    first = reached.agg(F.min(F.struct("ts", "id", "run", "n")).alias("f"))
    return first.where(F.col("f").isNotNull()).select(F.col("f.ts").alias("panicked_at"), "f.run", "f.n")


#: Microseconds of a time bucket in which queries meet the flags of their run.
MINUTE = 60_000_000


def _state(queries: DataFrame, flags: DataFrame, by: list[str], name: str) -> DataFrame:
    """The queries with the last flag at or before their time, off without one.

    A bucket's flags are one array, met by equality; of a run only its buckets
    are ordered. Flags at the same time: on counts.
    """
    place = F.floor(micros(F.col("ts")) / MINUTE).alias("bucket")
    met = flags.groupBy(*by, place).agg(F.array_sort(F.collect_list(F.struct(micros(F.col("ts")).alias("us"), "on"))).alias("flags"))
    asked = queries.withColumn("bucket", place)
    buckets = asked.select(*by, "bucket").unionByName(met.select(*by, "bucket")).distinct()
    earlier = Window.partitionBy(*by or [F.lit(0)]).orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    last = F.last(F.element_at("flags", -1)["on"], ignorenulls=True)
    held = buckets.join(met, [*by, "bucket"], "left").withColumn("carried", last.over(earlier)).where("flags IS NOT NULL OR carried")
    here = F.get(F.reverse(F.filter("flags", lambda f: f["us"] <= micros(F.col("ts")))), F.lit(0))["on"]
    found = F.coalesce(F.when(F.col("flags").isNotNull(), here), "carried", F.lit(False)).alias(name)
    return asked.join(held, [*by, "bucket"], "left").select(*queries.columns, found)


def state_as_of(queries: DataFrame, log: DataFrame) -> DataFrame:
    """Whether a run is killed at a time: the global flag first, then the run's own.

    queries: query_id, run, ts. log: run (null: global), ts, on (trip or clear).
    The last log row at or before the query's time decides. A query without a
    run or a time has no state of its own.
    """
    asked = queries.select("query_id", "run", "ts")
    own = _state(asked.where("run IS NOT NULL"), log.where("run IS NOT NULL"), ["run"], "run_killed")
    both = own.unionByName(asked.where("run IS NULL").withColumn("run_killed", F.lit(False)))
    found = _state(both, log.where("run IS NULL"), [], "panic")
    return found.select("query_id", "run", "ts", "panic", "run_killed", (F.col("panic") | F.col("run_killed")).alias("killed"))


def recent(trips: DataFrame, limit: int = 50, ts_col: str = "ts", id_col: str = "id") -> DataFrame:
    """Newest activations first, 1 to 200 of them."""
    return trips.orderBy(F.desc(ts_col), F.desc(id_col)).limit(max(1, min(RING, limit)))
