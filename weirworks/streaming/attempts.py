"""First and second attempts settled on a stream, with state for the task that is waited for."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from .. import dims
from ..operators import gate

PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
FLAGS = ("answered", "accepted", "should_retry", "should_escalate")


def needs_second(first: str | None, allow_retry: bool) -> bool:
    """Whether a first verdict (JSON) leaves the task open: it failed softly and may be tried again."""
    v = dict.fromkeys(FLAGS, False) | json.loads(first or "{}")
    return bool(allow_retry and v["answered"] and not v["accepted"] and v["should_retry"] and not v["should_escalate"])


class Settle(StatefulProcessor):
    """Hold a task's verdicts until they decide it; a timer closes what no further attempt decides.

    The state of a task is its verdicts and whether it was given out. A decided task stays known until its timer, so that
    an attempt that is sent again changes nothing; then all of it goes. Of several verdicts of one attempt the largest
    counts, as in a batch, if it arrives before the task is decided.
    """
    def __init__(self, wait_ms: int, allow_retry: bool):
        self.wait_ms, self.allow_retry = wait_ms, allow_retry

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.held = handle.getValueState("held", "a1 string, a2 string, done boolean")

    def _row(self, key, a1, a2) -> pd.DataFrame:
        return pd.DataFrame({"key": [key[0]], "a1": [a1], "a2": [a2]}, dtype=object)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        a1, a2, done = self.held.get() if self.held.exists() else (None, None, False)
        fresh, latest = not self.held.exists(), 0
        for part in rows:
            for number, verdict, at in zip(part["attempt_no"], part["verdict"], part["at_ms"], strict=True):
                if number == 1:
                    a1 = verdict if a1 is None else max(a1, verdict)
                else:
                    a2 = verdict if a2 is None else max(a2, verdict)
                latest = max(latest, int(at))
        if fresh:
            self.handle.registerTimer(latest + self.wait_ms)
        if not done and a1 is not None and (a2 is not None or not needs_second(a1, self.allow_retry)):
            done = True
            yield self._row(key, a1, a2)
        self.held.update((a1, a2, done))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        a1, a2, done = self.held.get()
        self.held.clear()
        if not done:
            yield self._row(key, a1, a2)

    def close(self) -> None:
        pass


def use_rocksdb(spark: SparkSession) -> None:
    """State with timers needs the RocksDB store; the setting is taken over when a query starts."""
    spark.conf.set(PROVIDER, ROCKS)


def settle_stream(verdicts: DataFrame, ts: str = "ts", wait: int = 600, delay: str = "10 minutes", allow_retry: bool = True,
                  key: str = "task_id") -> DataFrame:
    """The streaming form of ``gate.settle_attempts``: verdicts (key, attempt_no, a, ts) to settled tasks.

    A first attempt that decides its task comes out at once; one that failed softly waits ``wait`` seconds of event time
    for the second, and a second one for its first. What is still open then is settled by what there is: a task without
    a second answer escalates. Attempts later than ``delay`` are left out.
    """
    shape = verdicts.schema["a"].dataType
    kind = verdicts.schema[key].dataType.simpleString()
    # options that keep nulls and order, so that equal verdicts are equal texts
    told = F.to_json("a", {"ignoreNullFields": "false"})
    slim = verdicts.where(F.col(key).isNotNull() & F.col("attempt_no").isin(1, 2)).withWatermark(ts, delay).select(
        F.col(key).alias("key"), F.col("attempt_no").cast("int").alias("attempt_no"), told.alias("verdict"), F.unix_millis(ts).alias("at_ms"), F.col(ts).alias("at"))
    pairs = slim.groupBy("key").transformWithStateInPandas(Settle(wait * 1000, allow_retry), f"key {kind}, a1 string, a2 string", "Append", "EventTime")
    pairs = pairs.select(F.col("key").alias(key), F.from_json("a1", shape).alias("a1"), F.from_json("a2", shape).alias("a2"))
    return gate.settle_pairs(pairs, key, allow_retry)


def stream_attempts(attempts: DataFrame, options: dims.GateOptions = dims.GateOptions(), ts: str = "ts", wait: int = 600, delay: str = "10 minutes",
                    allow_retry: bool = True, key: str = "task_id", **columns) -> DataFrame:
    """The streaming form of ``gate.resolve_attempts``: attempts are judged as they come, and only verdicts are held."""
    use_rocksdb(attempts.sparkSession)
    return settle_stream(gate.attempt_verdicts(attempts, options, key, keep=(ts,), **columns), ts, wait, delay, allow_retry, key)
