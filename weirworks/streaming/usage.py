"""Structured Streaming forms of the usage, routing and gating operators."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from .. import dims
from ..functions import cost as C
from ..operators import gate, routing, usage
from ..operators.learning import success_cells
from ..sources.logs import USAGE_FIELDS, parse_lines
from ..sources.workdir import new_path, remove_folder

KEPT_VERSIONS = 2


def stream_usage_log(spark: SparkSession, directory: str, files_per_trigger: int = 1000) -> DataFrame:
    """New JSON-lines files of a usage log, as they arrive."""
    lines = spark.readStream.option("maxFilesPerTrigger", files_per_trigger).text(directory, lineSep="\n")
    return parse_lines(lines, USAGE_FIELDS)


def _overhead() -> Column:
    return C.overhead_of(F.col("cloud_overhead_tokens"), F.col("tokens_used"))


def stream_daily_timeline(log: DataFrame, delay: str = "1 hour") -> DataFrame:
    """Tokens, overhead and tasks per UTC day; a day is final once the watermark has passed it."""
    # a window starts at UTC midnight; its text must not shift with the session's time zone
    days = usage.billable(log).withWatermark("ts", delay).groupBy(F.window("ts", "1 day")).agg(
        F.sum("tokens_used").alias("tokens"), F.sum(_overhead()).alias("overhead"), F.count(F.lit(1)).alias("tasks"))
    return days.select(usage.day_of(F.col("window.start")).alias("date"), "tokens", "overhead", "tasks")


def stream_sessions(log: DataFrame, gap: str = "30 minutes", delay: str = "1 hour") -> DataFrame:
    """Tokens, overhead, tasks and tools per session id, closed by a gap.

    Records that name no session (null or ``unknown``) belong to no session and are left out, so that they do not form
    one that never closes.
    """
    named = usage.billable(log).where("session_id <> 'unknown'")
    sessions = named.withWatermark("ts", delay).groupBy(F.session_window("ts", gap), "session_id").agg(
        F.sum("tokens_used").alias("tokens"), F.sum(_overhead()).alias("overhead"), F.count(F.lit(1)).alias("tasks"),
        F.array_sort(F.collect_set(F.coalesce("tool", F.lit("unknown")))).alias("tools"))
    return sessions.select("session_id", F.col("session_window.start").alias("start"),
                           F.col("session_window.end").alias("end"), "tokens", "overhead", "tasks", "tools")


def stream_route(prompts: DataFrame, level: int = dims.DEFAULT_LEVEL, **kwargs) -> DataFrame:
    return routing.route(prompts, level, **kwargs)


def stream_gate(completions: DataFrame, options: dims.GateOptions = dims.GateOptions()) -> DataFrame:
    return gate.quality_gate(completions, options)


def stream_learner(history: DataFrame) -> DataFrame:
    """Running samples and successes per (task type, level), for update mode."""
    return success_cells(history)


def stream_sliding_rates(log: DataFrame, span: str = "1 hour", slide: str = "10 minutes", delay: str = "1 hour") -> DataFrame:
    """Resolution and retry rate of delegations over sliding windows."""
    d = log.where(F.col("type") == "delegation").withWatermark("ts", delay)
    counted = d.groupBy(F.window("ts", span, slide)).agg(
        F.count(F.lit(1)).alias("total"), F.count(F.when(F.col("resolved_locally"), 1)).alias("resolved"),
        F.count(F.when(F.col("attempt_count") > 1, 1)).alias("retried"))
    return counted.select(F.col("window.start").alias("start"), F.col("window.end").alias("end"), "total",
                          (F.col("resolved") / F.col("total")).alias("resolution_rate"),
                          (F.col("retried") / F.col("total")).alias("retry_rate"))


def stream_dedup(log: DataFrame, key: list[str] | None = None, delay: str = "1 hour") -> DataFrame:
    """Each record once, however often an append was retried within the delay.

    Without a key, ``log_ord`` tells records apart, or a hash of all fields where the log has none.
    """
    watched = log.withWatermark("ts", delay)
    if key is None and "log_ord" not in log.columns:
        return watched.withColumn("record", usage.record_key(log)).dropDuplicatesWithinWatermark(["record"]).drop("record")
    return watched.dropDuplicatesWithinWatermark(list(key or ["log_ord"]))


# --- running a stream over what is there -------------------------------------------------

def run_append(stream: DataFrame, path: str, checkpoint: str) -> None:
    """Process what is available and append final rows to a parquet table."""
    query = (stream.writeStream.format("parquet").outputMode("append").option("path", path)
             .option("checkpointLocation", checkpoint).trigger(availableNow=True).start())
    query.awaitTermination()


def run_versions(stream: DataFrame, path: str, checkpoint: str, mode: str = "update",
                 combine: Callable[[DataFrame, DataFrame | None], DataFrame] | None = None) -> None:
    """Write one folder per micro-batch; a batch that is run again overwrites its own folder only.

    ``combine(batch, last version)`` builds the new version where versions depend on each other.
    """
    def write(batch: DataFrame, number: int) -> None:
        out = batch
        if combine is not None:
            spark = batch.sparkSession
            last = spark.read.schema(batch.schema).parquet(f"{path}/version={number - 1}") if number > 0 else None
            out = combine(batch, last)
        out.write.mode("overwrite").parquet(f"{path}/version={number}")
        # a batch that runs again reads the version before it; older ones are no longer needed once merged
        if combine is not None and number >= KEPT_VERSIONS:
            remove_folder(batch.sparkSession, f"{path}/version={number - KEPT_VERSIONS}")

    query: StreamingQuery = (stream.writeStream.outputMode(mode).foreachBatch(write)
                             .option("checkpointLocation", checkpoint).trigger(availableNow=True).start())
    query.awaitTermination()


def merge_latest(keys: list[str]) -> Callable[[DataFrame, DataFrame | None], DataFrame]:
    """Merge step that keeps the newest row of each key, so that the last version is the whole table."""
    def merge(batch: DataFrame, last: DataFrame | None) -> DataFrame:
        return batch if last is None else batch.unionByName(last.join(batch.select(*keys), keys, "left_anti"))
    return merge


def latest_by(versions: DataFrame, keys: list[str]) -> DataFrame:
    """Newest row per key over all versions of an update-mode table."""
    values = [c for c in versions.columns if c not in (*keys, "version")]
    newest = versions.groupBy(*keys).agg(F.max_by(F.struct(*values), "version").alias("_v"))
    return newest.select(*keys, "_v.*")


def newest_version(versions: DataFrame) -> DataFrame:
    return versions.where(F.col("version") == versions.agg(F.max("version")).scalar()).drop("version")


def keep_recent(n: int = 50) -> Callable[[DataFrame, DataFrame | None], DataFrame]:
    """Merge step that keeps the newest rows by log order."""
    def merge(batch: DataFrame, last: DataFrame | None) -> DataFrame:
        seen = batch if last is None else batch.unionByName(last)
        return usage.newest(seen, n)
    return merge


def stream_recent(log: DataFrame, path: str, checkpoint: str, n: int = 50) -> None:
    """Keep the newest billable rows in a small versioned table."""
    run_versions(usage.billable(log), path, checkpoint, "append", keep_recent(n))


def paths(spark: SparkSession, name: str) -> tuple[str, str]:
    """A fresh table folder and checkpoint folder in the shared work folder."""
    base = new_path(spark, name)
    return f"{base}/table", f"{base}/checkpoint"
