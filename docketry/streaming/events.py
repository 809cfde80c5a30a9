"""Event logs as streams: sequence numbers, replay, control messages, incremental upkeep."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

SEQUENCED = "run_id bigint, event_id bigint, seq bigint, event_type string, value double"
CONTROL = "run_id bigint, event_id bigint, state string, refinements int, consumed int"


def read_events(spark: SparkSession, folder: str, schema) -> DataFrame:
    """A folder of Parquet files as a stream, one file per batch."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(folder)


def sequenced(events: DataFrame) -> DataFrame:
    """Each event with its number within its run, without holes, in arrival order and by event_id in a batch."""

    def number(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        n = state.get[0] if state.exists else 0
        rows = pd.concat(list(frames)).sort_values("event_id", kind="stable")
        rows["seq"] = range(n + 1, n + 1 + len(rows))
        state.update((n + len(rows),))
        yield rows[["run_id", "event_id", "seq", "event_type", "value"]]

    return events.groupBy("run_id").applyInPandasWithState(number, SEQUENCED, "n bigint", "append", GroupStateTimeout.NoTimeout)


def controlled(events: DataFrame) -> DataFrame:
    """The state of each run after every event: running, paused or cancelled, and refinements consumed once.

    error pauses, signup resumes, purchase asks for a refinement, the next click
    consumes all that are open, view changes nothing; a cancelled run (value
    below 0) stays cancelled.
    """

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        name, waiting = state.get if state.exists else ("running", 0)
        out = []
        for e in pd.concat(list(frames)).sort_values("event_id", kind="stable").itertuples():
            used = 0
            if name != "cancelled":
                if e.value is not None and e.value < 0:
                    name = "cancelled"
                elif e.event_type == "error":
                    name = "paused"
                elif e.event_type == "signup":
                    name = "running"
                elif e.event_type == "purchase":
                    waiting += 1
                elif e.event_type == "click":
                    used, waiting = waiting, 0
            out.append((key[0], e.event_id, name, waiting, used))
        state.update((name, waiting))
        yield pd.DataFrame(out, columns=["run_id", "event_id", "state", "refinements", "consumed"])

    return events.groupBy("run_id").applyInPandasWithState(step, CONTROL, "name string, waiting int", "append", GroupStateTimeout.NoTimeout)


def windowed_counts(events: DataFrame, late: str = "1 day", width: str = "1 day") -> DataFrame:
    """Counts per event type and window of event time; later than ``late`` is dropped. An extension."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", width).alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").alias("start"), "event_type", "n")


def deduplicated(events: DataFrame, keys: list[str]) -> DataFrame:
    """The first event of each key."""
    return events.dropDuplicates(keys)


def run_to_end(stream: DataFrame, target: str, checkpoint: str, mode: str = "append") -> None:
    """Process all that is there and stop; target and checkpoint are folders all executors share."""
    q = stream.writeStream.outputMode(mode).format("parquet").option("path", target).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()


def upkeep(stream: DataFrame, handle: Callable[[DataFrame, int], None], checkpoint: str) -> None:
    """Hand every micro-batch to ``handle``, which must give the same result if a batch comes twice."""
    q = stream.writeStream.foreachBatch(handle).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()
