"""Views that shape the supplied tables into a usage log, a history, prompts, completions and files.

The text is plain enough for Spark and for the SQL checker alike, so both sides read the same rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

VIEWS = {
    "usage_log": ("events", """
SELECT event_id AS log_ord,
  CASE WHEN event_type IN ('view','click') THEN 'completion' WHEN event_type IN ('purchase','signup') THEN 'delegation' ELSE 'subagent' END AS type,
  ts,
  'sess-' || CAST(user_id % 40 AS VARCHAR(20)) || '-' || CAST(extract(day FROM ts) AS VARCHAR(20)) AS session_id,
  CASE WHEN event_type = 'error' THEN NULL WHEN event_id % 3 = 0 THEN 'complete' WHEN event_id % 3 = 1 THEN 'generate_code' ELSE 'analyze_file' END AS tool,
  CASE WHEN event_type = 'error' THEN NULL WHEN event_id % 5 = 0 THEN 'local-1b' WHEN event_id % 5 = 1 THEN 'local-8b' ELSE 'local-32b' END AS model,
  CASE WHEN event_type = 'error' OR event_id % 97 = 0 THEN NULL ELSE CAST(floor(value * 10) AS BIGINT) END AS tokens_used,
  CASE WHEN event_type IN ('view','click') AND event_id % 2 = 0 THEN 80 + CAST(ceil(floor(value * 10) * CAST(1.3 AS DOUBLE)) AS BIGINT) END AS cloud_overhead_tokens,
  CASE WHEN event_type IN ('purchase','signup') THEN CAST(floor(value * 7) AS BIGINT) END AS output_tokens,
  CAST(200 + floor(value * 3) AS BIGINT) AS duration_ms,
  CASE WHEN event_type IN ('purchase','signup') THEN CASE WHEN event_id % 10 < 7 THEN 'accepted' WHEN event_id % 10 < 9 THEN 'retried_accepted' ELSE 'escalated' END END AS quality_status,
  CASE WHEN event_type IN ('purchase','signup') THEN CASE WHEN event_id % 10 < 7 THEN 1 WHEN event_id % 10 = 9 AND event_id % 4 = 1 THEN 1 ELSE 2 END END AS attempt_count,
  CASE WHEN event_type IN ('purchase','signup') THEN event_id % 10 < 9 END AS resolved_locally
FROM events"""),
    "history": ("events", """
SELECT 'fp' || CAST(event_id AS VARCHAR(20)) AS task_fingerprint,
  CASE user_id % 5 WHEN 0 THEN 'code_gen' WHEN 1 THEN 'code_mod' WHEN 2 THEN 'analysis' WHEN 3 THEN 'text' ELSE 'data_transform' END AS task_type,
  CAST(1 + event_id % 5 AS INT) AS level_used,
  CASE WHEN (event_id % 100) < 92 - 20 * (user_id % 3) THEN 'success' WHEN event_id % 2 = 0 THEN 'escalated' ELSE 'user_rejected' END AS outcome,
  ts
FROM events"""),
    "prompts": ("documents", """
SELECT doc_id AS task_id,
  CASE doc_id % 16
   WHEN 0 THEN 'list files in the project ' WHEN 1 THEN 'Write docstring for function parseRow in src/app/main.py '
   WHEN 2 THEN 'convert this JSON config to YAML ' WHEN 3 THEN 'crud endpoint for orders '
   WHEN 4 THEN 'debug this and then fix it until tests pass ' WHEN 5 THEN 'security audit of the login flow '
   WHEN 6 THEN 'refactor this file, then rename the helper and finally update `util.ts` '
   WHEN 7 THEN 'novel approach across the codebase; database migration, if needed '
   WHEN 8 THEN 'why does the cache miss and how should we ensure a hit ' WHEN 9 THEN 'summarize the report, for instance like this one '
   WHEN 10 THEN 'cs ask what is a mutex ' WHEN 11 THEN 'boilerplate for a rest api in go with a test suite '
   WHEN 12 THEN 'analyze the module then refactor all files everywhere, password handling '
   WHEN 13 THEN 'bash script, adapt the config of this package ' WHEN 14 THEN '' ELSE 'fix this ' END
  || text AS text
FROM documents"""),
    "completions": ("documents", """
SELECT doc_id AS task_id, CAST(1 AS INT) AS attempt_no,
  CASE doc_id % 3 WHEN 0 THEN 'python' WHEN 1 THEN 'typescript' END AS expected_language,
  CAST(40 + 15 * (doc_id % 30) AS BIGINT) AS expected_tokens,
  CASE doc_id % 14
   WHEN 0 THEN 'ok ' || text WHEN 1 THEN 'As an AI I cannot do that for you here. ' || text WHEN 2 THEN text || ' TODO finish'
   WHEN 3 THEN 'I think maybe it might work, perhaps. ' || text
   WHEN 4 THEN 'def f(a):' || chr(10) || '  return ((((a' || chr(10) || text
   WHEN 5 THEN 'function g(x) {' || chr(10) || ' const y = () => {' || chr(10) || ' if (y) {{{' || chr(10) || text
   WHEN 6 THEN text || '...' WHEN 7 THEN 'see src/app/main.py and lib/other.ts for more. ' || text
   WHEN 8 THEN 'it could be so; it seems, could be. ' || text
   WHEN 9 THEN 'HACK only. ' || text
   WHEN 10 THEN repeat('the same long sentence is printed over and over again here; ', 4) || text
   WHEN 11 THEN 'Here:' || chr(10) || '```python' || chr(10) || 'import os' || chr(10) || 'def h(a):' || chr(10) || '  return a' || chr(10) || '```' || chr(10) || text
   ELSE text END AS response
FROM documents"""),
    "retries": ("documents", """
SELECT doc_id AS task_id, CAST(2 AS INT) AS attempt_no,
  CASE doc_id % 3 WHEN 0 THEN 'python' WHEN 1 THEN 'typescript' END AS expected_language,
  CAST(40 + 15 * (doc_id % 30) AS BIGINT) AS expected_tokens,
  CASE (doc_id + 1) % 5 WHEN 0 THEN 'ok then: ' || text WHEN 1 THEN text || ' FIXME'
   WHEN 2 THEN 'maybe, perhaps, it could be so. ' || text ELSE text END AS response
FROM documents"""),
    "code_files": ("part", """
SELECT p_partkey AS file_id,
  'src/' || replace(lower(p_brand), '#', '') || '/f' || CAST(p_partkey AS VARCHAR(20))
   || CASE p_partkey % 6 WHEN 0 THEN '.ts' WHEN 1 THEN '.py' WHEN 2 THEN '.go' WHEN 3 THEN '.rs' WHEN 4 THEN '.md' ELSE '' END AS path,
  CASE p_partkey % 6
   WHEN 0 THEN 'import fs from "fs";' || chr(10) || 'export class C' || CAST(p_size AS VARCHAR(20)) || ' {' || chr(10) || 'export async function load(a) {' || chr(10) || 'export const pick = (x) => x;' || chr(10) || 'const q = require("q")'
   WHEN 1 THEN 'import os' || chr(10) || 'from sys import argv' || chr(10) || 'class K:' || chr(10) || '    async def run(self):' || chr(10) || 'def go(a):' || chr(10)
   WHEN 2 THEN 'package main' || chr(10) || 'func main() { x() }'
   WHEN 3 THEN 'use std::io;' || chr(10) || 'pub async fn serve(a: u8) {'
   WHEN 4 THEN '# ' || p_name || chr(10) || 'from here on' ELSE p_name END
  || repeat(chr(10) || p_type || ' filler line', CAST(p_size AS INT)) AS content
FROM part"""),
}

TASKS_PER_CORE = 4


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A supplied table."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One derived view; event times become UTC timestamps.

    Files are far larger than the rows that they are made of: a few row groups would leave all work on them to as many
    tasks, so the rows are dealt out first.
    """
    source = table(spark, sf_dir, VIEWS[name][0])
    if name == "code_files":
        source = source.repartition(TASKS_PER_CORE * spark.sparkContext.defaultParallelism, "p_partkey")
    return shape(source, name)


def shape(source: DataFrame, name: str) -> DataFrame:
    """Apply a view's text to its base table, batch or streaming."""
    base, text = VIEWS[name]
    source.createOrReplaceTempView(base)
    out = source.sparkSession.sql(text)
    return out.withColumn("ts", F.col("ts").cast("timestamp")) if "ts" in out.columns else out
