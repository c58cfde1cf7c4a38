"""Codes and lockouts as live state: the folds of operators/usage.py over a stream of events."""

from __future__ import annotations

from contextlib import contextmanager

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from quillspark.operators.usage import Fold
from quillspark.streaming.usage import run_to_table

PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


@contextmanager
def rocksdb_state(spark: SparkSession):
    """While it lasts, streams that start keep their state in RocksDB, which value states and timers need."""
    before = spark.conf.get(PROVIDER)
    spark.conf.set(PROVIDER, ROCKSDB)
    try:
        yield
    finally:
        spark.conf.set(PROVIDER, before)


class KeyedFold(StatefulProcessor):
    """One key's fold: its state, and a timer that removes it once the watermark has passed all that it can still decide.

    `due`, in milliseconds, is when the key's timer goes off; a key has one at most, which is set anew if the state
    then still matters. A state that decides nothing, like a fresh one, is not kept at all.
    """

    def __init__(self, fold: Fold, key: str):
        self.fold, self.key = fold, key

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("fold", f"{self.fold.fields}, due long")

    def _keep(self, state: list, due: int) -> None:
        until = self.fold.matters_until(state)
        if until == 0 and not due:
            if self.state.exists():
                self.state.clear()
            return
        if not due and until is not None:
            due = until * 1000
            self.handle.registerTimer(due)
        self.state.update((*state, due))

    def handleInputRows(self, key, rows, timerValues):
        *state, due = self.state.get() if self.state.exists() else (*self.fold.fresh, 0)
        frame = pd.concat(list(rows)).sort_values(["at", "event_id"], kind="stable")
        columns = [frame[c].astype(object).where(frame[c].notna(), None) for c in self.fold.columns]
        outcomes = [self.fold.step(state, *values) for values in zip(*columns, strict=True)]
        self._keep([int(v) if hasattr(v, "item") else v for v in state], due)
        yield pd.DataFrame({self.key: frame[self.key], "event_id": frame["event_id"], "outcome": outcomes})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        if self.state.exists():
            *state, _ = self.state.get()
            until = self.fold.matters_until(state)
            if until is not None and until * 1000 <= timerValues.getCurrentWatermarkInMs():
                self.state.clear()
            else:
                self._keep(state, 0)
        return iter(())

    def close(self) -> None:
        pass


def live_outcomes(events: DataFrame, key: str, fold: Fold, late: str = "1 hour") -> DataFrame:
    """(key, event_id, outcome) of a stream of events (key, event_id, at in seconds, and the fold's columns), as they come.

    Each micro-batch is folded by key in the order of at and event_id onto the state that the batches before left,
    so events that come in the order of time, batch by batch, have the outcomes of the fold over the whole table.
    An event that comes behind later ones of its key, by at most `late`, is judged by the state it meets; one that
    is later still, or has no time, is left out. State is kept for as long as it can change an outcome, and then
    goes with the watermark. Start the stream under rocksdb_state.
    """
    output = T.StructType([events.schema[key], events.schema["event_id"], T.StructField("outcome", T.StringType())])
    timed = events.where("at IS NOT NULL").select(key, "event_id", *fold.columns, F.timestamp_seconds("at").alias("_time")).withWatermark("_time", late)
    # Null is a key like any other, which state stores and Python's groups would not all take for one.
    keyed = timed.withColumn("_key", F.to_json(F.struct(key)))
    return keyed.groupBy("_key").transformWithStateInPandas(KeyedFold(fold, key), output, "Append", "EventTime")


def outcomes_to_table(spark: SparkSession, events: DataFrame, key: str, fold: Fold, folder: str, late: str = "1 hour") -> str:
    """Run live_outcomes over what is there now into a Parquet table under folder; a restart goes on from its state."""
    with rocksdb_state(spark):
        return run_to_table(live_outcomes(events, key, fold, late), folder)


def outcomes_of_slices(events: DataFrame, key: str, fold: Fold, folder: str, slices: int = 4) -> DataFrame:
    """The outcomes of a table of events by way of the stream: they arrive in slices of time, and the stream restarts for each."""
    spark = events.sparkSession
    cuts = sorted(set(events.agg(F.percentile_approx("at", [i / slices for i in range(1, slices)])).first()[0] or []))
    bounds = [None, *cuts, None]
    at = None
    for low, high in zip(bounds, bounds[1:], strict=False):
        part = events if low is None else events.where(F.col("at") > low)
        (part if high is None else part.where(F.col("at") <= high)).write.mode("append").parquet(f"{folder}/in")
        at = outcomes_to_table(spark, spark.readStream.schema(events.schema).parquet(f"{folder}/in"), key, fold, folder)
    return spark.read.schema(T.StructType([events.schema[key], events.schema["event_id"], T.StructField("outcome", T.StringType())])).parquet(at)
