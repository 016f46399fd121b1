"""Read and append usage logs and outcome histories kept as JSON lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.cost import cloud_overhead
from ..functions.text import is_json

USAGE_FIELDS = [
    ("type", "string"), ("timestamp", "string"), ("agent", "string"), ("tools_used", "array<string>"),
    ("tokens_used", "bigint"), ("model", "string"), ("duration_ms", "bigint"), ("tool", "string"),
    ("session_id", "string"), ("cloud_overhead_tokens", "bigint"), ("output_tokens", "bigint"),
    ("quality_status", "string"), ("attempt_count", "int"), ("resolved_locally", "boolean"),
]
WHOLE = ("bigint", "int")      # numbers in logs may have a fraction; these fields are rounded, half toward plus infinity
HISTORY_FIELDS = [
    ("task_fingerprint", "string"), ("task_type", "string"), ("level_used", "int"), ("outcome", "string"),
    ("quality_signal", "double"), ("timestamp", "string"),
]
STRICT = {"mode": "PERMISSIVE", "allowSingleQuotes": "false", "allowNonNumericNumbers": "false"}
AGENT = "local-worker"


def ddl(fields: list[tuple[str, str]]) -> str:
    return ", ".join(f"{name} {kind}" for name, kind in fields)


def parse_lines(lines: DataFrame, fields: list[tuple[str, str]], line: str = "value") -> DataFrame:
    """JSON lines to rows: blank and malformed lines go, a field of the wrong kind becomes null.

    A line whose fields all parse and whose only closing brace ends it is one object; other lines are judged
    by a full JSON check.
    """
    given = [(name, "double" if kind in WHOLE else kind) for name, kind in fields]
    raw = lines.withColumn("_row", F.from_json(line, ddl(given) + ", _bad string",
                                               {**STRICT, "columnNameOfCorruptRecord": "_bad"}))
    closed = F.instr(line, "}") == F.length(F.rtrim(line))
    sound = (F.col("_row._bad").isNull() & closed) | is_json(F.col(line))
    kept = raw.where((F.trim(line) != "") & F.coalesce(sound, F.lit(False)))
    rest = [F.col(c) for c in lines.columns if c != line]
    value = lambda name, kind: F.floor(F.col(f"_row.{name}") + F.lit(0.5)).cast(kind) if kind in WHOLE else F.col(f"_row.{name}")
    out = kept.select(*rest, *[value(name, kind).alias(name) for name, kind in fields])
    return out.withColumn("ts", F.try_to_timestamp("timestamp"))


def read_usage_log(spark: SparkSession, path: str) -> DataFrame:
    return parse_lines(spark.read.text(path, lineSep="\n"), USAGE_FIELDS)


def read_history(spark: SparkSession, path: str) -> DataFrame:
    return parse_lines(spark.read.text(path, lineSep="\n"), HISTORY_FIELDS)


def delegations(log: DataFrame) -> DataFrame:
    return log.where(F.col("type") == "delegation")


def ingest_subagent_events(events: DataFrame) -> DataFrame:
    """Subagent records of the local worker, with defaults for what an event leaves out."""
    given = lambda name, default: F.coalesce(name, default) if name in events.columns else default
    return events.where(F.col("agent_name") == AGENT).select(
        F.col("agent_name").alias("agent"), given("duration_ms", F.lit(0)).alias("duration_ms"),
        given("tools_used", F.array().cast("array<string>")).alias("tools_used"),
        given("session_id", F.lit("unknown")).alias("session_id"), F.col("ts"))


def _utc_text(at: Column) -> Column:
    """An instant as text in UTC, whatever the session's time zone."""
    return F.date_format(F.to_utc_timestamp(at, F.current_timezone()), "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")


def _stamped(df: DataFrame, kind: str) -> DataFrame:
    at = F.coalesce("ts", F.current_timestamp()) if "ts" in df.columns else F.current_timestamp()
    session = F.coalesce("session_id", F.lit("unknown")) if "session_id" in df.columns else F.lit("unknown")
    return df.withColumns({"type": F.lit(kind), "session_id": session,
                           "timestamp": _utc_text(at)})


def _append(df: DataFrame, path: str, fields: list[tuple[str, str]], enabled: bool) -> None:
    if enabled:
        df.select(*[name for name, _ in fields if name in df.columns]).write.mode("append").json(path)


def append_completions(df: DataFrame, path: str, enabled: bool = True) -> None:
    """Append completions with their estimated overhead."""
    priced = df.withColumn("cloud_overhead_tokens", cloud_overhead(F.col("tokens_used")))
    _append(_stamped(priced, "completion"), path, USAGE_FIELDS, enabled)


def append_delegations(df: DataFrame, path: str, enabled: bool = True) -> None:
    _append(_stamped(df, "delegation"), path, USAGE_FIELDS, enabled)


def append_history(df: DataFrame, path: str) -> None:
    at = F.coalesce("ts", F.current_timestamp()) if "ts" in df.columns else F.current_timestamp()
    stamped = df.withColumn("timestamp", _utc_text(at))
    _append(stamped, path, HISTORY_FIELDS, True)


def history_rows(resolved: DataFrame, decisions: DataFrame, fingerprint: Column, task_type: Column,
                 key: str = "task_id") -> DataFrame:
    """History records of settled tasks: resolved here is a success, else an escalation."""
    joined = resolved.select(key, "resolved_locally").join(decisions, key)
    return joined.select(
        fingerprint.alias("task_fingerprint"), task_type.alias("task_type"),
        F.col("task_complexity").cast("int").alias("level_used"),
        F.when(F.col("resolved_locally"), "success").otherwise("escalated").alias("outcome"))


def truncate_log(spark: SparkSession, path: str, fields: list[tuple[str, str]] = tuple(USAGE_FIELDS)) -> None:
    spark.createDataFrame([], T.StructType.fromDDL(ddl(list(fields)))).write.mode("overwrite").json(path)
