"""Completion quality gate queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from weirworks import dims
from weirworks.functions import checks as K
from weirworks.functions import text as X
from weirworks.functions.repetition import repetition_loop
from weirworks.operators import corpus as O
from weirworks.operators import gate as G
from weirworks.views import table, view

from .base import (case_of, count, dbl, est_tokens, every, first, found, has_any, lit, on_view, query, trim, units)

# --- SQL of the pieces ---------------------------------------------------------------------


def repetition(source: str, key: str, text: str) -> str:
    """Keys whose text prints a unit of 50+ characters three times in a row within a line.

    Neighbouring equal blocks at multiples of each period are found first and then grown; the shortest periods
    of a line are tried first, since a long run repeats at every multiple of its period.
    """
    grown = "(SELECT *, unnest(range(greatest(0, i - p), i + 1)) AS a FROM rep_r WHERE {}) WHERE a + 3 * p <= n AND " \
            "substr(line, a + 1, 2 * p) = substr(line, a + p + 1, 2 * p)"
    return f"""rep_l AS (SELECT {key}, unnest(string_split_regex({text}, '[\\n\\r\\x{{2028}}\\x{{2029}}]')) AS line FROM {source}),
rep_n AS MATERIALIZED (SELECT row_number() OVER () AS line_id, {key}, line, length(line) AS n FROM rep_l WHERE length(line) >= 150),
rep_p AS (SELECT *, unnest(range(50, n // 3 + 1)) AS p FROM rep_n),
rep_k AS (SELECT *, unnest(range(0, n // p - 1)) * p AS i FROM rep_p),
rep_s AS MATERIALIZED (SELECT * FROM rep_k WHERE substr(line, i + 1, 25) = substr(line, i + p + 1, 25) AND substr(line, i + 1, p) = substr(line, i + p + 1, p)),
rep_r AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY line_id ORDER BY p, i) AS r FROM rep_s),
rep_1 AS MATERIALIZED (SELECT DISTINCT line_id, {key} FROM {grown.format('r <= 20')}),
rep_2 AS (SELECT DISTINCT line_id, {key} FROM {grown.format('r > 20 AND line_id NOT IN (SELECT line_id FROM rep_1)')}),
rep AS MATERIALIZED (SELECT DISTINCT {key} FROM (SELECT {key} FROM rep_1 UNION ALL SELECT {key} FROM rep_2))"""


CODE = f"CASE WHEN {found(X.FENCE, 'response')} THEN {first(X.FENCE, 'response', 1)} ELSE response END"


def balance(name: str, opener: str, closer: str, source: str, key: str) -> str:
    only = f"regexp_replace(code, '[^\\{opener}\\{closer}]', '', 'g')"
    return f"""{name} AS (SELECT {key}, min(depth) < -2 OR abs(sum(step)) > 2 AS bad FROM (
  SELECT {key}, step, sum(step) OVER (PARTITION BY {key} ORDER BY i) AS depth FROM (
    SELECT {key}, i, CASE WHEN substr(b, i, 1) = '{opener}' THEN 1 ELSE -1 END AS step FROM (
      SELECT {key}, b, unnest(range(1, length(b) + 1)) AS i FROM (SELECT {key}, {only} AS b FROM {source})))) GROUP BY 1)"""


def open_count(t: str, c: str) -> str:
    return f"(length({t}) - length(replace({t}, '{c}', '')))"


TRIMMED = trim("response")
SIGNS = "[" + ", ".join("(" + " + ".join(f"CAST({found(rx, 'response')} AS INT)" for rx in signs) + ")"
                        for signs in K.LANGUAGE_SIGNS.values()) + "]"
OWN = case_of([(f"expected = '{name}'", f"signs[{i + 1}]") for i, name in enumerate(K.LANGUAGES)], "NULL")
PARTS = {
    "refusal": has_any("lower(response)", dims.REFUSAL_PHRASES),
    "repetition_loop": "repeats",
    "incomplete": f"(ends_with(trimmed, '...') OR {open_count('trimmed', '{')} - {open_count('trimmed', '}')} > 2 "
                  f"OR {open_count('trimmed', '(')} - {open_count('trimmed', ')')} > 2)",
    "wrong_language": f"coalesce(list_max(signs) >= 2 AND list_max(signs) > {OWN}, false)",
    "confidence_caveat": f"{count(X.Rx(K.HEDGES.rx.source, True), 'response')} >= 3",
    "placeholder_markers": found(X.Rx("{<}(?:TODO|TBD|FIXME|PLACEHOLDER|XXX|HACK){>}"), "response"),
    "syntax_error": "CASE WHEN expected IS NULL THEN false WHEN expected = 'python' THEN brackets "
                    "WHEN expected = 'json' THEN NOT json_valid(code) ELSE brackets OR braces END",
}
LISTED = "list_filter([" + ", ".join(f"CASE WHEN {PARTS[s]} THEN '{s}' END" for s in dims.SIGNAL_ORDER if s in PARTS) + \
         "], lambda x: x IS NOT NULL)"


def signals(source: str, key: str = "task_id") -> str:
    """CTEs up to ``sig`` with the signal list and severity of every answered row of a source."""
    return f"""given AS MATERIALIZED (SELECT *, {TRIMMED} AS trimmed, {CODE} AS code, nullif(lower(expected_language), '') AS expected
  FROM {source} WHERE response IS NOT NULL),
{repetition('given', key, 'response')},
{balance('parens', '(', ')', 'given', key)}, {balance('squares', '[', ']', 'given', key)}, {balance('curly', '{', '}', 'given', key)},
parted AS (SELECT g.*, g.{key} IN (SELECT {key} FROM rep) AS repeats, coalesce(p.bad, false) OR coalesce(s.bad, false) AS brackets,
  coalesce(c.bad, false) AS braces, {SIGNS} AS signs
  FROM given g LEFT JOIN parens p ON p.{key} = g.{key} LEFT JOIN squares s ON s.{key} = g.{key} LEFT JOIN curly c ON c.{key} = g.{key}),
listed AS (SELECT *, CASE WHEN length(trimmed) < 10 THEN ['empty_output'] ELSE {LISTED} END AS failure_signals FROM parted),
sig AS (SELECT *, CASE WHEN len(failure_signals) = 0 THEN 'none' WHEN len(failure_signals) >= 2
  OR list_has_any(failure_signals, ['empty_output', 'refusal', 'repetition_loop']) THEN 'major' ELSE 'minor' END AS severity FROM listed)"""


# --- signals ---------------------------------------------------------------------------------

on_view("repetition_loop", "documents", lambda d: d.select("doc_id", repetition_loop(F.col("text")).alias("repeats")),
        f"WITH {repetition('documents', 'doc_id', 'text')} SELECT doc_id, doc_id IN (SELECT doc_id FROM rep) AS repeats FROM documents")
on_view("failure_signals", "completions",
        lambda c: G.failure_signals(c).select("task_id", F.array_join("failure_signals", ",").alias("signals"), "severity",
                                              "signals_accept"),
        f"WITH {signals('completions')} SELECT task_id, array_to_string(failure_signals, ',') AS signals, severity, "
        "severity <> 'major' AS signals_accept FROM sig")
LANG = "CASE task_id % 7 WHEN 0 THEN 'Python' WHEN 1 THEN 'javascript' WHEN 2 THEN 'java' WHEN 3 THEN 'go' WHEN 4 THEN 'rust' WHEN 5 THEN '' ELSE 'cobol' END"
SNIPPET = ("CASE task_id % 5 WHEN 0 THEN 'package main' || chr(10) || 'func go(a) {}' || chr(10) || 'fmt.Println(1)' || chr(10) "
           "WHEN 1 THEN 'fn main() {' || chr(10) || 'let mut x = 1;' || chr(10) || 'impl T for U {}' || chr(10) || '}' "
           "WHEN 2 THEN '# note' || chr(10) || 'import os' || chr(10) || 'def f(a):' || chr(10) "
           "WHEN 3 THEN 'public class A {' || chr(10) || 'System.out.print(1);}' || chr(10) "
           "ELSE 'const f = () => {' || chr(10) || 'require(x)};' || chr(10) || 'interface I {}' || chr(10) END")
POLYGLOT = f"SELECT task_id, {LANG} AS expected_language, {SNIPPET} || response AS response FROM completions"


@query("failure_signals_languages", f"WITH poly AS ({POLYGLOT}), {signals('poly')} SELECT task_id, "
       "array_to_string(failure_signals, ',') AS signals, severity FROM sig", ["completions"])
def _(spark, sf_dir):
    answers = view(spark, sf_dir, "completions").selectExpr("task_id", f"{LANG} AS expected_language", f"{SNIPPET} || response AS response")
    return G.failure_signals(answers).select("task_id", F.array_join("failure_signals", ",").alias("signals"), "severity")


PROPS = "CASE event_id % 4 WHEN 0 THEN props WHEN 1 THEN props || ' }' WHEN 2 THEN '{\"k\": [1, 2, ' || props ELSE '[' || props || ', null, 1.5e3]' END"


@query("json_syntax", f"SELECT event_id, NOT json_valid({PROPS}) AS broken FROM events")
def _(spark, sf_dir):
    answers = table(spark, sf_dir, "events").select("event_id", F.expr(PROPS).alias("response"), F.lit("JSON").alias("expected_language"))
    judged = G.failure_signals(answers.withColumn("response", F.concat("response", F.lit(" " * 4))), repetition=False)
    wide = F.array_contains("failure_signals", "syntax_error")
    # short texts stop at the first signal, so the plain expression is shown for them
    return judged.select("event_id", F.when(F.array_contains("failure_signals", "empty_output"),
                                            ~X.is_json(F.col("response"))).otherwise(wide).alias("broken"))


# --- the gate -----------------------------------------------------------------------------------

SECTIONS = ["over", "return a", "(a)"]
ALLOWED = ["app/main.py", "x\\lib\\other.ts"]
OPTIONED = "task_id % 3 <> 2"
SECTIONED = "task_id % 2 = 1"


def optioned(completions):
    listed = lambda values: F.array(*[F.lit(v) for v in values])
    return completions.withColumns({"allowed_files": F.when(F.expr(OPTIONED), listed(ALLOWED)),
                                    "required_sections": F.when(F.expr(SECTIONED), listed(SECTIONS))})


def section_pattern(section: str) -> X.Rx:
    import re
    return X.Rx("{b}" + re.escape(section).replace("\\ ", " ") + "{b}", True)


MARKER = first(K.MARKERS, "response")
REFS = every(X.BARE_PATH, "response")
NEAR = " OR ".join(f"ends_with(ref, {lit(a.replace(chr(92), '/'))}) OR ends_with({lit(a.replace(chr(92), '/'))}, ref)" for a in ALLOWED)
MISSING = "list_filter([" + ", ".join(f"CASE WHEN NOT {found(section_pattern(s), 'response')} THEN {lit(s)} END" for s in SECTIONS) + \
          "], lambda x: x IS NOT NULL)"
HEDGED = count(X.Rx(K.MORE_HEDGES.rx.source, True), "response")
RATIO = f"({est_tokens('response')} / CAST(expected_tokens AS DOUBLE))"


def reasons(with_options: bool) -> dict[str, str]:
    """Reason against each check, or NULL."""
    given = lambda cond, text: f"CASE WHEN {cond} THEN {text} END" if with_options else "NULL"
    return {
        "completeness": f"CASE WHEN {MARKER} <> '' THEN 'Found placeholder marker: ' || {MARKER} END",
        "code_parse": "CASE WHEN brackets THEN 'Unmatched brackets' WHEN braces THEN 'Unmatched braces' END",
        "scope_compliance": given(f"{OPTIONED} AND len(outside) > 0", "'Files outside scope: ' || array_to_string(outside, ', ')"),
        "required_sections": given(f"{SECTIONED} AND len(missing) > 0", "'Missing sections: ' || array_to_string(missing, ', ')"),
        "length": f"CASE WHEN {units('trimmed')} < 20 THEN 'Output too short: ' || {units('trimmed')} || ' chars (min 20)' "
                  f"WHEN {units('trimmed')} > 10000 THEN 'Output too long: ' || {units('trimmed')} || ' chars (max 10000)' END",
        "no_hedging": f"CASE WHEN {HEDGED} >= 3 THEN 'Excessive hedging: ' || {HEDGED} || ' instances' END",
        "proportionality": f"CASE WHEN expected_tokens > 0 THEN CASE WHEN {RATIO} < 0.2 THEN 'Output disproportionately short: ' || {est_tokens('response')} || ' tokens vs ' || expected_tokens || ' expected' "
                           f"WHEN {RATIO} > 5 THEN 'Output disproportionately long: ' || {est_tokens('response')} || ' tokens vs ' || expected_tokens || ' expected' END END",
    }


HARD = ["completeness", "code_parse", "scope_compliance", "required_sections", "length"]
SOFT = ["no_hedging", "proportionality"]


def gated(source: str, key: str = "task_id", with_options: bool = False) -> str:
    """CTEs up to ``gate`` with failures, counts and verdict of every answered row."""
    pieces = f"list_filter({REFS}, lambda ref: NOT ({NEAR})) AS outside, {MISSING} AS missing" if with_options else "NULL AS outside, NULL AS missing"
    why = ", ".join(f"{sql} AS why_{name}" for name, sql in reasons(with_options).items())
    kept = lambda names: "list_filter([" + ", ".join(f"why_{n}" for n in names) + "], lambda x: x IS NOT NULL)"
    major = "'Local model failed: ' || array_to_string(failure_signals, ', ')"
    return f"""{signals(source, key)}, opt AS (SELECT *, {pieces} FROM sig), why AS (SELECT *, {why} FROM opt),
failed AS (SELECT *, CASE WHEN severity = 'major' THEN [{major}] ELSE {kept(HARD)} END AS hard,
  CASE WHEN severity = 'major' THEN [] ELSE {kept(SOFT)} END AS soft FROM why),
gate AS (SELECT *, CASE WHEN severity = 'major' THEN 0 ELSE 7 - len(hard) - len(soft) END AS checks_passed,
  CASE WHEN severity = 'major' THEN 1 ELSE 7 END AS checks_total, len(hard) = 0 AND len(soft) = 0 AS accepted,
  len(hard) = 0 AND len(soft) > 0 AS should_retry, len(hard) > 0 AS should_escalate FROM failed)"""


VERDICT = "checks_passed, checks_total, accepted, should_retry, should_escalate"
GATED = f"SELECT task_id, severity, array_to_string(hard, '; ') AS hard, array_to_string(soft, '; ') AS soft, {VERDICT} FROM gate"


def flat(judged):
    why = lambda failures: F.array_join(F.transform(failures, lambda c: c["reason"]), "; ")
    return judged.select("task_id", "severity", why("hard_failures").alias("hard"), why("soft_failures").alias("soft"),
                         "checks_passed", "checks_total", "accepted", "should_retry", "should_escalate")


on_view("quality_gate", "completions", lambda c: flat(G.quality_gate(c)), f"WITH {gated('completions')} {GATED}")
on_view("quality_gate_with_options", "completions", lambda c: flat(G.quality_gate(optioned(c))),
        f"WITH {gated('completions', with_options=True)} {GATED}")
WHY_ROWS = ", ".join(f"{{'name': '{n}', 'ok': why_{n} IS NULL}}" for n in HARD + SOFT)
on_view("check_rates", "completions", lambda c: G.check_rates(G.quality_gate(c)), f"""
WITH {gated('completions')}, e AS (SELECT unnest(CASE WHEN severity = 'major' THEN [{{'name': 'escalation_signals', 'ok': false}}]
  ELSE [{WHY_ROWS}] END, recursive := true) FROM gate)
SELECT name, count(*) AS n, count(*) FILTER (ok) AS passed FROM e GROUP BY 1""")


@query("out_of_scope_refs", f"""
WITH files AS (SELECT doc_id AS task_id, unnest(['app/main.py', 'docs\\guide.md']) AS file FROM documents WHERE doc_id % 3 <> 2),
refs AS (SELECT DISTINCT task_id, unnest({REFS}) AS ref FROM completions)
SELECT r.task_id, r.ref FROM refs r WHERE r.task_id IN (SELECT task_id FROM files) AND NOT EXISTS (SELECT 1 FROM files f
  WHERE f.task_id = r.task_id AND (ends_with(r.ref, replace(f.file, '\\', '/')) OR ends_with(replace(f.file, '\\', '/'), r.ref)))""",
       ["completions"])
def _(spark, sf_dir):
    allowed = table(spark, sf_dir, "documents").where("doc_id % 3 <> 2").select(
        F.col("doc_id").alias("task_id"), F.explode(F.array(F.lit("app/main.py"), F.lit("docs\\guide.md"))).alias("file"))
    return G.out_of_scope_refs(view(spark, sf_dir, "completions"), allowed)


# --- attempts -------------------------------------------------------------------------------------

USED = "CAST(60 + 7 * (task_id % 50) + 13 * attempt_no AS BIGINT) AS tokens_used, CAST(300 + task_id % 90 + attempt_no AS BIGINT) AS duration_ms, " \
       "'local-' || CAST(attempt_no AS VARCHAR(20)) AS model, 'complete' AS tool"
FIRSTS = f"SELECT task_id, attempt_no, expected_language, expected_tokens, CASE WHEN task_id % 23 = 5 THEN NULL ELSE response END AS response, {USED} FROM completions"
SECONDS = f"SELECT task_id, attempt_no, expected_language, expected_tokens, response, {USED} FROM retries"
ALL_ATTEMPTS = f"att AS ({FIRSTS} UNION ALL {SECONDS}), keyed AS (SELECT *, task_id * 10 + attempt_no AS row_key FROM att)"
SETTLED = f"""{ALL_ATTEMPTS}, {gated('keyed', 'row_key')},
a AS (SELECT k.task_id, k.attempt_no, k.tokens_used, k.duration_ms, k.model, k.tool, g.row_key IS NOT NULL AS answered, g.accepted, g.should_retry,
  list_concat(g.hard, g.soft) AS reasons, g.checks_passed, g.checks_total FROM keyed k LEFT JOIN gate g ON g.row_key = k.row_key),
b AS (SELECT x.*, y.tokens_used AS t2, y.duration_ms AS d2, y.model AS m2, y.answered AS ok2, y.accepted AS acc2, y.reasons AS why2,
  y.checks_passed AS p2, y.checks_total AS n2 FROM (SELECT * FROM a WHERE attempt_no = 1) x
  LEFT JOIN (SELECT * FROM a WHERE attempt_no = 2) y ON y.task_id = x.task_id),
c AS (SELECT *, CASE WHEN NOT answered THEN 'none' WHEN accepted THEN 'first' WHEN NOT should_retry THEN 'once'
  WHEN NOT coalesce(ok2, false) THEN 'lost' WHEN acc2 THEN 'second' ELSE 'twice' END AS path FROM b),
settled AS (SELECT task_id, CASE path WHEN 'first' THEN 'accepted' WHEN 'second' THEN 'retried_accepted' ELSE 'escalated' END AS quality_status,
  CASE WHEN path IN ('second', 'twice', 'lost') THEN 2 ELSE 1 END AS attempt_count,
  CASE WHEN path IN ('none', 'lost') THEN NULL WHEN path IN ('second', 'twice') THEN tokens_used + t2 ELSE tokens_used END AS tokens_used,
  CASE WHEN path IN ('none', 'lost') THEN NULL WHEN path IN ('second', 'twice') THEN t2 ELSE tokens_used END AS output_tokens,
  CASE WHEN path IN ('none', 'lost') THEN NULL WHEN path IN ('second', 'twice') THEN duration_ms + d2 ELSE duration_ms END AS duration_ms,
  CASE WHEN path IN ('none', 'lost') THEN NULL WHEN path IN ('second', 'twice') THEN m2 ELSE model END AS model,
  path IN ('first', 'second') AS resolved_locally, path NOT IN ('none', 'lost') AS logged,
  CASE path WHEN 'none' THEN ['{dims.NO_ANSWER}'] WHEN 'lost' THEN ['{dims.NO_RETRY_ANSWER}'] WHEN 'once' THEN reasons
    WHEN 'twice' THEN list_concat(reasons, list_filter(why2, lambda r: NOT list_contains(reasons, r))) ELSE [] END AS why,
  CASE path WHEN 'first' THEN checks_passed WHEN 'second' THEN p2 END AS checks_passed FROM c)"""


def attempts(spark, sf_dir):
    view(spark, sf_dir, "completions").createOrReplaceTempView("completions")
    view(spark, sf_dir, "retries").createOrReplaceTempView("retries")
    return spark.sql(f"{FIRSTS} UNION ALL {SECONDS}")


SETTLED_COLUMNS = ["task_id", "quality_status", "attempt_count", "tokens_used", "output_tokens", "duration_ms", "model",
                   "resolved_locally", "logged", "checks_passed"]


@query("resolve_attempts", f"WITH {SETTLED} SELECT {', '.join(SETTLED_COLUMNS)}, array_to_string(why, '; ') AS reasons FROM settled",
       ["completions", "retries"])
def _(spark, sf_dir):
    return G.resolve_attempts(attempts(spark, sf_dir)).select(*SETTLED_COLUMNS, F.array_join("failure_reasons", "; ").alias("reasons"))


@query("escalation_payload", f"""WITH {SETTLED}, m AS (SELECT *, 'Local model failed after ' || attempt_count || ' attempt'
  || CASE WHEN attempt_count > 1 THEN 's' ELSE '' END || '. ' AS top FROM settled WHERE NOT resolved_locally)
SELECT task_id, top || 'Reasons: ' || array_to_string(why, '; ') AS message, top || array_to_string(why, '. ') || '.' AS escalation_message FROM m""",
       ["completions", "retries"])
def _(spark, sf_dir):
    return G.escalation_payload(G.resolve_attempts(attempts(spark, sf_dir))).select("task_id", "message", "escalation_message")
