"""Agent actions screened by the guard and held by the kill switch, over a table of actions.

The first critical action of a run trips it; later ones of the run are refused
until the run is cleared, and once five trips fall into a window a panic refuses
all that come after. Refused actions are not screened, so only first trips count.

Defined cases: actions without a run trip each time and are refused by a panic
alone; a null payload fails closed (critical); an action without a time is
screened and neither trips nor is refused; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import actions as guard
from . import killswitch
from .asof import as_of


def screen_actions(
    acts: DataFrame,
    clears: DataFrame | None = None,
    payload_col: str = "payload",
    config: guard.GuardConfig | None = None,
    seconds: int = killswitch.WINDOW_SECONDS,
    threshold: int = killswitch.THRESHOLD,
    excerpts: bool = False,
) -> DataFrame:
    """The actions with ``result`` of the guard and ``state``: refused, tripped, flagged or passed.

    Columns of acts: id, run, ts and the payload; of clears: run, ts. Acts at
    one time are ordered by id. A refused action has no result.
    """
    at = killswitch.micros(F.col("ts"))
    screened = acts.withColumn("at", at).withColumn("result", guard.screen_action(F.col(payload_col), config, excerpts))
    if clears is None:
        marked = screened.withColumn("mark", F.lit(None).cast("long"))
    else:
        marked = as_of(screened, clears.select("run", at.alias("at")), ["run"], "at", F.col("at"), width=3_600_000_000)
    place = F.struct(at.alias("at"), "id")
    critical = (F.col("result.severity") == "critical") & F.col("ts").isNotNull()
    first = marked.where(critical & F.col("run").isNotNull()).groupBy(F.col("run").alias("of"), F.col("mark").alias("since")).agg(F.min(place).alias("first"))
    same = F.col("run").eqNullSafe(F.col("of")) & F.col("mark").eqNullSafe(F.col("since"))
    met = marked.join(first, same, "left").drop("of", "since")
    trips = met.where(critical & (F.col("first").isNull() | (F.col("first") == place))).select("run", "ts", "id")
    reached = killswitch.rolling_counts(trips, seconds).where(F.col("n") >= threshold).agg(F.min(place).alias("p")).first()["p"]
    panicked: Column = F.lit(False)
    if reached:
        panicked = place > F.struct(F.lit(reached["at"]).alias("at"), F.lit(reached["id"]).cast(acts.schema["id"].dataType).alias("id"))
    refused = (panicked | F.coalesce(place > F.col("first"), F.lit(False))) & F.col("ts").isNotNull()
    state = F.when(refused, "refused").when(critical, "tripped").when(F.col("result.is_destructive"), "flagged").otherwise("passed")
    return met.withColumn("state", state).withColumn("result", F.when(~refused, F.col("result"))).drop("at", "mark", "first")


def tell(screened: DataFrame, on_kill, batch: int = 0) -> None:
    """Hands the tripped actions to a callback as a DataFrame; an error of the callback's is not raised."""
    try:
        on_kill(screened.where("state = 'tripped'"), batch)
    except Exception as e:  # noqa: BLE001 - a callback must not undo a kill
        import logging

        logging.getLogger(__name__).warning("on_kill failed: %s", type(e).__name__)
