"""Text reports and conversation queries."""

from __future__ import annotations

import sys

from pyspark import cloudpickle
from pyspark.sql import functions as F

from weirworks.functions import text as X
from weirworks.operators import reports as P
from weirworks.plans import conversations as V
from weirworks.plans.tasks import task_rows
from weirworks.views import table, view

from weirworks.dims import NO_ANSWER

from .base import blended, costs, dbl, est_tokens, fixed, lit, on_view, overhead, query, round2, gross, spent
from .corpus import FILE_TASKS, file_tasks
from .gate import gated
from .routing import DECIDED, NO_LEARNER, NO_TRIAGE, OUT, RULED, SCORED, decided

cloudpickle.register_pickle_by_value(sys.modules[__name__])

# --- text reports -------------------------------------------------------------------------------

GUESS = "CAST(1 + n_chars / 5 + doc_id % 40 AS DOUBLE)"
on_view("token_report", "documents",
        lambda d: P.token_report(d.select(X.tokens_blended(F.col("text")).alias("tokens"), F.expr(
            "CAST(1 + n_chars / 5D + doc_id % 40 AS DOUBLE)").alias("estimate"))), f"""
WITH t AS (SELECT {blended('text')} AS tokens, CAST(1 + n_chars / {dbl(5.0)} + doc_id % 40 AS DOUBLE) AS estimate FROM documents),
r AS (SELECT *, tokens / estimate AS ratio, row_number() OVER (ORDER BY tokens) - 1 AS rn, count(*) OVER () AS c FROM t)
SELECT count(*) AS n, {fixed('avg(tokens)', 0)} AS avg_tokens, min(tokens) AS min_tokens, max(tokens) AS max_tokens,
  max(tokens) FILTER (rn = c // 2) AS median_tokens, {fixed('avg(ratio)', 2)} AS avg_ratio, {fixed('min(ratio)', 2)} AS min_ratio,
  {fixed('max(ratio)', 2)} AS max_ratio, count(*) FILTER (ratio >= 0.8 AND ratio <= {dbl(1.2)}) AS accurate,
  count(*) FILTER (ratio < {dbl(0.8)}) AS over_estimated, count(*) FILTER (ratio > {dbl(1.2)}) AS under_estimated FROM r""")
on_view("accuracy_status", "documents",
        lambda d: d.select("doc_id", P.accuracy_status(
            F.floor(F.try_divide(X.tokens_blended(F.col("text")), F.col("n_chars")) * F.lit(500.0)) / F.lit(100.0)).alias("status")), f"""
WITH t AS (SELECT doc_id, floor({blended('text')} / CAST(n_chars AS DOUBLE) * {dbl(500.0)}) / {dbl(100.0)} AS r FROM documents)
SELECT doc_id, CASE WHEN r >= {dbl(0.8)} AND r <= {dbl(1.2)} THEN 'ACCURATE' WHEN r < {dbl(0.8)} THEN 'OVER-ESTIMATED' ELSE 'UNDER-ESTIMATED' END AS status FROM t""")
AFTER = "replace(replace(text, ' the ', ' '), '.', '')"


@query("compression_report", f"""
WITH e AS (SELECT doc_id, {blended('text')} AS before, {blended(AFTER)} AS after FROM documents),
u AS (SELECT * FROM e UNION ALL SELECT NULL, CAST(sum(before) AS BIGINT), CAST(sum(after) AS BIGINT) FROM e)
SELECT doc_id, before, after, before - after AS saved, CAST(floor(CASE WHEN before > 0 THEN (before - after) / CAST(before AS DOUBLE) * {dbl(100.0)}
  ELSE 0 END + {dbl(0.5)}) AS BIGINT) AS pct FROM u""")
def _(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return P.compression_report(docs, docs.select("doc_id", F.expr(AFTER).alias("text")), "doc_id")


on_view("repeat_cost", "benchmark", lambda b: P.repeat_cost(b, "item_id", [10, 25, 50, 100, 200]), f"""
WITH t AS (SELECT item_id, {blended('text')} AS tokens, unnest([10, 25, 50, 100, 200]) AS turns FROM benchmark),
x AS (SELECT *, tokens * turns AS extra_tokens, tokens * turns / {dbl(1e6)} * {dbl(15.0)} AS extra_cost FROM t)
SELECT *, extra_cost * {dbl(22.0)} AS monthly_cost FROM x""")

# --- conversations ----------------------------------------------------------------------------------

PAIRS = """pairs AS (SELECT conv_id, turn, text AS prompt, response FROM (SELECT *, lead(role) OVER w AS next_role, lead(text) OVER w AS response
  FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)) WHERE role = 'user' AND next_role = 'assistant')"""
on_view("pair_turns", "conversations", V.pair_turns, f"WITH {PAIRS} SELECT * FROM pairs")
on_view("pair_turns_gaps", "conversations", lambda c: V.pair_turns(c.withColumn("turn", F.col("turn") * F.col("turn") * 7)),
        f"WITH {PAIRS.replace('FROM conversations', 'FROM (SELECT conv_id, turn * turn * 7 AS turn, role, text FROM conversations)')} SELECT * FROM pairs")
on_view("two_price_report", "conversations",
        lambda c: P.two_price_report(V.pair_turns(c).select("conv_id", "turn", X.tokens_blended(F.col("prompt")).alias("tokens_in"),
                                                            X.tokens_blended(F.col("response")).alias("tokens_out"))), f"""
WITH {PAIRS}, t AS (SELECT conv_id, turn, {blended('prompt')} AS tokens_in, {blended('response')} AS tokens_out FROM pairs),
c AS (SELECT *, ((tokens_in + 8800) * {dbl(3.0)} + tokens_out * {dbl(15.0)}) / {dbl(1e6)} AS dear_cost,
  ((tokens_in + 8800) * {dbl(0.25)} + tokens_out * {dbl(1.25)}) / {dbl(1e6)} AS cheap_cost FROM t)
SELECT *, ({dbl(1.0)} - cheap_cost / dear_cost) * {dbl(100.0)} AS saving_pct FROM c""")

JUDGED = f"""{PAIRS}, src AS (SELECT *, conv_id * 100000 + turn AS pair_key, CAST(NULL AS VARCHAR) AS expected_language, CAST(NULL AS BIGINT) AS expected_tokens FROM pairs),
low AS (SELECT *, lower(prompt) AS l FROM src), {RULED}, {SCORED}, plain AS (SELECT *, {NO_TRIAGE}, {NO_LEARNER} FROM scored), {decided('plain', '2')},
{gated('src', 'pair_key')},
judged AS (SELECT d.conv_id, d.turn, {', '.join('d.' + c for c in DECIDED)}, g.severity, g.accepted, g.should_retry, g.should_escalate, g.checks_passed,
  g.checks_total, {est_tokens('g.response')} AS tokens FROM decided d JOIN gate g ON g.pair_key = d.pair_key),
priced AS (SELECT *, {overhead('tokens')} AS overhead FROM judged)"""
on_view("judged_pairs", "conversations", V.judged_pairs, f"WITH {JUDGED} SELECT * FROM priced")
on_view("conversation_report", "conversations", V.conversation_report, f"""
WITH {JUDGED}, s AS (SELECT route, count(*) AS pairs, count(*) FILTER (accepted) AS accepted, count(*) FILTER (should_retry) AS to_retry,
  count(*) FILTER (should_escalate) AS to_escalate, CAST(sum(tokens) AS BIGINT) AS tokens, CAST(sum(overhead) AS BIGINT) AS overhead FROM priced GROUP BY 1)
SELECT *, {round2(gross('tokens', dbl(8.0)) + ' - ' + spent('overhead', dbl(8.0)))} AS net_cost FROM s""")
on_view("conversation_mix", "conversations", V.conversation_mix, f"""
WITH {JUDGED} SELECT delegation_level, count(*) AS n, count(*) FILTER (route = 'no_llm') AS no_llm, count(*) FILTER (route = 'local') AS local,
  count(*) FILTER (route = 'cloud') AS cloud, count(*) FILTER (route = 'local') / CAST(count(*) AS DOUBLE) * 100 AS local_share,
  count(*) FILTER (route = 'local') / CAST(count(*) FILTER (route IN ('local', 'cloud')) AS DOUBLE) * 100 AS delegation_rate FROM priced GROUP BY 1""")


@query("task_join", """
SELECT p.task_id, length(p.text) AS prompt_chars, length(c.response) AS response_chars, u.type, u.tokens_used
FROM prompts p JOIN completions c ON c.task_id = p.task_id LEFT JOIN usage_log u ON u.log_ord = p.task_id""", ["prompts", "completions", "usage_log"])
def _(spark, sf_dir):
    prompts, answers, log = (view(spark, sf_dir, v) for v in ("prompts", "completions", "usage_log"))
    return task_rows(prompts.select("task_id", F.length("text").alias("prompt_chars")), answers.select("task_id", F.length("response").alias("response_chars")),
                     log.select(F.col("log_ord").alias("task_id"), "type", "tokens_used"))


# --- running a completion function -----------------------------------------------------------------------

def echo(prompt: str, max_tokens: int | None) -> tuple[str, int]:
    """A stand-in for a model: answers with the prompt, fails on empty ones."""
    if not prompt.strip():
        raise ValueError("empty prompt")
    return f"{len(prompt)}: {prompt}", -(-len(prompt) // 4)


@query("batch_complete", f"""
SELECT task_id AS id, CASE WHEN trim(text) = '' THEN 'Error: empty prompt' ELSE CAST(length(text) AS VARCHAR) || ': ' || text END AS response,
  CASE WHEN trim(text) = '' THEN 0 ELSE {est_tokens('text')} END AS tokens_used, trim(text) <> '' AS ok FROM prompts""", ["prompts"])
def _(spark, sf_dir):
    from weirworks.operators.models import batch_complete
    asked = view(spark, sf_dir, "prompts").select(F.col("task_id").alias("id"), F.col("text").alias("prompt"))
    return batch_complete(asked, echo).drop("duration_ms")


# what the stand-in model of the light pass leads to, by its kind of answer
LIGHT_PASS = f"""WITH tasks AS ({FILE_TASKS}),
k AS (SELECT task_id, list_sum(list_transform(string_split(substr('Task: ' || text, 1, 60), ''), lambda c: ascii(c))) % 5 AS kind FROM tasks)"""
LIGHT_PASS_ROWS = f"""SELECT task_id, CASE kind WHEN 4 THEN 'accepted' WHEN 2 THEN 'retried_accepted' ELSE 'escalated' END AS quality_status,
  CASE WHEN kind IN (2, 3) THEN 2 ELSE 1 END AS attempt_count,
  CASE kind WHEN 1 THEN 900 WHEN 2 THEN 950 + 900 WHEN 3 THEN 950 + 950 WHEN 4 THEN 900 END AS tokens_used,
  CASE kind WHEN 1 THEN 900 WHEN 2 THEN 900 WHEN 3 THEN 950 WHEN 4 THEN 900 END AS output_tokens, kind IN (2, 4) AS resolved_locally,
  CASE WHEN kind IN (2, 4) THEN repeat('def run(a):' || chr(10) || '    return a' || chr(10), 60) END AS response,
  CASE kind WHEN 0 THEN '{NO_ANSWER}' WHEN 1 THEN 'Found placeholder marker: TODO' WHEN 3 THEN 'Excessive hedging: 3 instances' ELSE '' END AS reasons
FROM k"""


@query("light_pass", LIGHT_PASS + "\n" + LIGHT_PASS_ROWS, ["code_files"])
def _(spark, sf_dir):
    from weirworks.plans.light_pass import light_pass
    tasks, files = file_tasks(spark, sf_dir)
    tasks = tasks.withColumn("tool", F.lit("generate_code")).withColumn("expected_language", F.lit("python"))
    out = light_pass(tasks, files, view(spark, sf_dir, "usage_log"), hedging_model)
    return out["results"].select("task_id", "quality_status", "attempt_count", "tokens_used", "output_tokens", "resolved_locally", "response",
                                 F.array_join("failure_reasons", "; ").alias("reasons"))


@query("light_pass_escalations", f"""{LIGHT_PASS}, tries AS (SELECT *, CASE WHEN kind = 3 THEN 2 ELSE 1 END AS n, CASE kind WHEN 0 THEN '{NO_ANSWER}'
  WHEN 1 THEN 'Found placeholder marker: TODO' ELSE 'Excessive hedging: 3 instances' END AS why FROM k WHERE kind IN (0, 1, 3))
SELECT t.task_id, t.text AS task_intent, 'Local model failed after ' || n || CASE WHEN n > 1 THEN ' attempts. ' ELSE ' attempt. ' END || why || '.' AS escalation_message
FROM tries JOIN tasks t ON t.task_id = tries.task_id""", ["code_files"])
def _(spark, sf_dir):
    from weirworks.plans.light_pass import light_pass
    tasks, files = file_tasks(spark, sf_dir)
    tasks = tasks.withColumn("tool", F.lit("generate_code")).withColumn("expected_language", F.lit("python"))
    out = light_pass(tasks, files, view(spark, sf_dir, "usage_log"), hedging_model)["escalations"]
    return out.select("task_id", "task_intent", "escalation_message")


def hedging_model(prompt: str, max_tokens: int | None) -> tuple[str, int]:
    """A stand-in whose answer hedges on short budgets, leaves markers on some tasks and fails on others."""
    kind = sum(map(ord, prompt[:60])) % 5
    body = "def run(a):\n    return a\n" * 60
    if kind == 0:
        raise RuntimeError("no model")
    if kind == 1:
        return body + "# TODO", 900
    if kind == 2 and (max_tokens or 0) < 1200:
        return "maybe, perhaps, it could be this\n" + body, 950
    if kind == 3:
        return "maybe, perhaps, it could be that\n" + body, 950
    return body, 900
