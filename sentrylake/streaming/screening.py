"""Streaming forms of the stateless operators and of the kill switch."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators import decide, injection


def screen_stream(stream: DataFrame, text_col: str = "text", surface: str = "user_input") -> DataFrame:
    """The same projection as for a table; no state."""
    return injection.screen(stream, text_col, surface)


def decide_stream(stream: DataFrame, payload_col: str = "payload", kind_col: str = "kind") -> DataFrame:
    return decide.decide(stream, payload_col, kind_col)


def to_sink(stream: DataFrame, checkpoint: str, on_batch: Callable[[DataFrame, int], None]) -> StreamingQuery:
    """Hands each micro-batch to a callback; a failed batch is run again."""
    return stream.writeStream.foreachBatch(on_batch).option("checkpointLocation", checkpoint).start()


TRIPPED = "run string, ts timestamp, event string, state string"


def _step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    killed = state.exists and state.get[0]
    rows = pd.concat(list(batches)).sort_values("ts", kind="stable")
    out = []
    for ts, event in zip(rows["ts"], rows["event"]):
        if event == "clear":
            killed, said = False, "cleared"
        elif killed:
            said = "refused"
        elif event == "critical":
            killed, said = True, "tripped"
        else:
            said = "passed"
        out.append((key[0], ts, event, said))
    state.update((killed,))
    yield pd.DataFrame(out, columns=["run", "ts", "event", "state"])


def kill_stream(actions: DataFrame) -> DataFrame:
    """Per run: the first critical action trips, later ones are refused until a clear.

    Columns: run, ts, event (critical, clear or any other). A run's flag is its
    only state. A micro-batch of one run is ordered by time.
    """
    return actions.groupBy("run").applyInPandasWithState(_step, TRIPPED, "killed boolean", "append", GroupStateTimeout.NoTimeout)


def panic_counts(trips: DataFrame, seconds: int = 60, slide: int = 1, threshold: int = 5, watermark: str = "60 seconds") -> DataFrame:
    """Windows with at least ``threshold`` first trips: a sliding approximation of the trailing count.

    A panic reaches runs with the next micro-batch; trips later than the
    watermark kill their run but do not raise a panic.
    """
    counted = trips.withWatermark("ts", watermark).groupBy(F.window("ts", f"{seconds} seconds", f"{slide} seconds")).agg(F.count(F.lit(1)).alias("n"))
    return counted.where(F.col("n") >= threshold).select(F.col("window.end").alias("at"), "n")
