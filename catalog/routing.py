"""Prompt routing queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from weirworks import dims
from weirworks.functions import signals as S
from weirworks.functions import text as X
from weirworks.operators import learning as L
from weirworks.operators import reports as P
from weirworks.operators import routing as R
from weirworks.operators import usage as U
from weirworks.views import table, view

from .base import (case_of, count, dbl, est_tokens, every, first, fixed, found, has_any, lit, on_view, query, trim)
from .usage import CELLS, advice_sql

# --- SQL of the pieces -------------------------------------------------------------------

LOWERED = "low AS (SELECT *, lower(text) AS l FROM prompts)"
AT = case_of([(f"contains(l, {lit(p)})", str(i + 1)) for i, (p, _) in enumerate(R.PHRASES)], "NULL")
RULE_ROWS = ", ".join(
    f"({i + 1}, {lit(p)}, {n}, {lit(dims.RULES[n][0])}, {dims.RULES[n][1]}, {dbl(dims.RULES[n][2])}, "
    f"{lit(dims.RULES[n][3])}, {lit(dims.RULES[n][4])})" for i, (p, n) in enumerate(R.PHRASES))
RULED = f"""rules AS (SELECT * FROM (VALUES {RULE_ROWS}) v(ph, matched_phrase, rule_ord, rule_route, rule_level, rule_confidence,
  rule_cost_of_wrong, rule_category)),
ruled AS (SELECT a.* EXCLUDE (ph), r.* EXCLUDE (ph) FROM (SELECT *, {AT} AS ph FROM low) a LEFT JOIN rules r ON r.ph = a.ph)"""


def labels(table, default):
    hit = lambda group: has_any("l", group) if isinstance(group, list) else found(group.rx, "l")
    return case_of([(hit(group), lit(name)) for name, group in table], lit(default))


def weights(column, table):
    return case_of([(f"{column} = {lit(k)}", dbl(v)) for k, v in table.items()], "NULL")


FILES = f"len(list_distinct(list_concat(list_concat({every(X.NAMED_FILE, 'l')}, {every(X.AT_MENTION, 'l')}), {every(X.TICKED_FILE, 'l')})))"
BONUS = " + ".join(f"CASE WHEN {found(getattr(rx, 'rx', rx), 'l')} THEN {dbl(b)} ELSE {dbl(0.0)} END" for rx, b in S.DEPTH_BONUS)
DEPTH = (f"least(least({count(S.STEPS.rx, 'l')} * {dbl(0.15)}, {dbl(0.45)}) + least({count(S.CONDITIONS.rx, 'l')} * {dbl(0.1)}, "
         f"{dbl(0.3)}) + {BONUS}, {dbl(1.0)})")
SUFFIX = first(S.FILE_SUFFIX, "l")
FAMILIAR = case_of([(f"contains(l, {lit(n)})", dbl(v)) for n, v in dims.LANGUAGE_FAMILIARITY.items()],
                   case_of([(f"{SUFFIX} = {lit(k)}", dbl(v)) for k, v in dims.FAMILIARITY_BY_EXTENSION.items()], dbl(0.5)))
FEATURES = f"""{FILES} AS files_referenced, {FILES} * 500 AS estimated_context_tokens, {labels(S.SCOPE, 'function')} AS scope,
  {DEPTH} AS reasoning_depth, {found(S.TOOL_CHAIN.rx, 'l')} AS requires_tool_chain, {labels(S.OUTPUT_TYPE, 'code_gen')} AS output_type,
  {labels(S.NOVELTY, 'known_pattern')} AS novelty, {labels(S.COST_OF_WRONG, 'low')} AS cost_of_wrong,
  {labels(S.REVERSIBILITY, 'easy_undo')} AS reversibility, {FAMILIAR} AS language_familiarity,
  ({found(S.EXAMPLES.rx, 'l')} OR {' OR '.join(found(rx, 'l') for rx in S.MARKED_EXAMPLES)}) AS has_examples, {found(S.TESTS.rx, 'l')} AS has_tests"""
SCORE = f"""greatest({dbl(0.0)}, least({dbl(1.0)}, {weights('scope', dims.SCOPE_WEIGHT)} + reasoning_depth
  + CASE WHEN requires_tool_chain THEN {dbl(0.3)} ELSE 0 END + {weights('novelty', dims.NOVELTY_WEIGHT)}
  + {weights('cost_of_wrong', dims.COST_WEIGHT)} + least(estimated_context_tokens / {dbl(32000.0)} * {dbl(0.5)}, {dbl(0.4)})
  - language_familiarity * {dbl(0.1)} - CASE WHEN has_examples THEN {dbl(0.1)} ELSE 0 END
  - CASE WHEN has_tests THEN {dbl(0.1)} ELSE 0 END))"""
LEVEL = case_of([(f"score < {dbl(c)}", str(n)) for c, n in dims.LEVEL_CUTOFFS], "6")
SCORED = f"""featured AS (SELECT *, {FEATURES} FROM ruled),
scored0 AS (SELECT *, {SCORE} AS score FROM featured), scored AS (SELECT *, {LEVEL} AS score_level FROM scored0)"""
CEILING = case_of([(f"lvl = {k}", str(v[0])) for k, v in dims.LEVELS.items()], "3")
POLICY = case_of([(f"lvl = {k}", lit(v[1])) for k, v in dims.LEVELS.items()], "'standard'")
SIZE = case_of([(f"complexity = {k}", lit(v)) for k, v in dims.LADDER.items()], "NULL")
NO_TRIAGE = "false AS triaged, NULL AS triage_level, NULL AS triage_confidence"
NO_LEARNER = "NULL AS adjusted_level, NULL AS confidence_adjustment, NULL AS learner_reason, 0 AS learner_samples"


def decided(source: str, level: str) -> str:
    """Decision columns over a scored source that also has triage and learner columns."""
    return f"""lv AS (SELECT *, {level} AS lvl FROM {source}),
ly AS (SELECT *, CASE WHEN lvl IN (0, 5) THEN 'level_gate' WHEN rule_ord IS NOT NULL THEN '1' WHEN triaged THEN '3' ELSE '2' END AS layer,
  {CEILING} AS ceiling FROM lv),
cx AS (SELECT *, CASE layer WHEN 'level_gate' THEN 0 WHEN '1' THEN rule_level WHEN '3' THEN triage_level
  ELSE coalesce(adjusted_level, score_level) END AS complexity FROM ly),
ov AS (SELECT *, layer <> 'level_gate' AND complexity > ceiling AS over FROM cx),
rt AS (SELECT *, CASE WHEN lvl = 0 THEN 'cloud' WHEN lvl = 5 THEN 'local' WHEN over THEN 'cloud'
  WHEN layer = '1' THEN CASE WHEN rule_route = 'cloud_recommended' THEN 'cloud' ELSE rule_route END
  WHEN complexity = 0 THEN 'no_llm' ELSE 'local' END AS route FROM ov),
decided AS (SELECT * EXCLUDE (cost_of_wrong, over, ceiling), lvl AS delegation_level, complexity AS task_complexity,
  CASE layer WHEN 'level_gate' THEN 1 WHEN '1' THEN rule_confidence WHEN '3' THEN triage_confidence
    ELSE least({dbl(1.0)}, greatest({dbl(0.1)}, {dbl(0.6)} + coalesce(confidence_adjustment, {dbl(0.0)}))) END AS confidence,
  CASE WHEN lvl = 0 THEN {lit('Level 0 (Off) — manual delegation only')} WHEN lvl = 5 THEN {lit('Level 5 (Offline) — all tasks routed local')}
    WHEN layer = '1' AND over THEN 'Pattern matched "' || matched_phrase || '" (Level ' || complexity || ') exceeds ceiling (' || ceiling || ')'
    WHEN layer = '1' THEN 'Pattern matched "' || matched_phrase || {lit('" → ')} || route
    WHEN layer = '3' AND over THEN 'Triage classified as Level ' || complexity || ', exceeds ceiling (' || ceiling || ')'
    WHEN layer = '3' THEN 'Triage classified as Level ' || complexity || {lit(' → local')}
    ELSE 'Heuristic score ' || {fixed('score', 2)} || {lit(' → Level ')} || score_level
      || CASE WHEN learner_samples > 0 THEN ', adjusted to ' || complexity || ' by learner (' || learner_reason || ')' ELSE '' END
      || CASE WHEN over THEN ', exceeds ceiling (' || ceiling || ')' ELSE {lit(' → local')} END END AS reason,
  layer AS classification_layer, CASE WHEN NOT over AND layer <> 'level_gate' THEN {SIZE} END AS suggested_model,
  CASE WHEN layer = '1' THEN rule_category END AS specialist_key,
  CASE WHEN layer = '1' THEN rule_cost_of_wrong WHEN layer <> 'level_gate' THEN cost_of_wrong END AS cost_of_wrong,
  {POLICY} AS escalation_policy FROM rt)"""


OUT = ("route, delegation_level, task_complexity, confidence, reason, classification_layer, suggested_model, specialist_key, "
       "cost_of_wrong, escalation_policy")


def route_sql(level: str, select: str = f"SELECT task_id, {OUT} FROM decided") -> str:
    return (f"WITH {LOWERED}, {RULED}, {SCORED}, plain AS (SELECT *, {NO_TRIAGE}, {NO_LEARNER} FROM scored), "
            f"{decided('plain', level)} {select}")


# --- rules and signals ---------------------------------------------------------------------

RULE_COLUMNS = ["matched_phrase", "rule_ord", *R.RULE_FIELDS]
on_view("match_rules", "prompts", lambda p: R.match_rules(p).select("task_id", *RULE_COLUMNS),
        f"WITH {LOWERED}, {RULED} SELECT task_id, {', '.join(RULE_COLUMNS)} FROM ruled")

USER_RULES = """SELECT item_id AS rule_ord, CAST(0 AS BIGINT) AS phrase_ord, lower(regexp_extract(text, '^[^ ]+ [^ ]+', 0)) AS phrase,
  'bench-' || CAST(item_id AS VARCHAR(20)) AS target FROM benchmark"""
USER_SQL = f"""WITH r AS ({USER_RULES}), h AS (SELECT d.doc_id, min(r.rule_ord) AS rule_ord FROM documents d JOIN r
  ON contains(lower(d.text), r.phrase) GROUP BY 1)
SELECT d.doc_id, r.phrase AS matched_phrase, r.rule_ord, r.phrase_ord, r.target FROM documents d
LEFT JOIN h ON h.doc_id = d.doc_id LEFT JOIN r ON r.rule_ord = h.rule_ord"""


def user_rules(spark, sf_dir, **options):
    table(spark, sf_dir, "benchmark").createOrReplaceTempView("benchmark")
    rules = spark.sql(USER_RULES)
    out = R.match_user_rules(table(spark, sf_dir, "documents").select("doc_id", "text"), rules, **options)
    return out.select("doc_id", "matched_phrase", "rule_ord", "phrase_ord", "target")


query("match_user_rules", USER_SQL)(user_rules)
query("match_user_rules_joined", USER_SQL)(lambda spark, sf_dir: user_rules(spark, sf_dir, block_chars=100))

RUNS = """SELECT item_id AS rule_ord, n * 1000 + i AS phrase_ord, substr(lower(text), i, n) AS phrase
  FROM (SELECT item_id, text, n, {0} AS i FROM (SELECT item_id, text, {1} AS n FROM benchmark)) WHERE i <= length(text) + 1 - n"""
RUN_SQL = f"""WITH r AS ({RUNS.format("unnest(range(1, length(text) + 1))", "unnest([12, 16, 20])")}),
f AS (SELECT phrase, arg_min(rule_ord, (rule_ord, phrase_ord)) AS rule_ord, arg_min(phrase_ord, (rule_ord, phrase_ord)) AS phrase_ord FROM r GROUP BY phrase),
w AS (SELECT doc_id, t, i, substr(t, i, 12) AS head FROM (SELECT doc_id, t, unnest(range(1, length(t) - 10)) AS i FROM (SELECT doc_id, lower(text) AS t FROM documents))),
h AS (SELECT doc_id, min((f.rule_ord, f.phrase_ord, f.phrase)) AS b FROM w JOIN f ON substr(f.phrase, 1, 12) = w.head
  WHERE substr(w.t, w.i, length(f.phrase)) = f.phrase GROUP BY 1)
SELECT d.doc_id, b[3] AS matched_phrase, b[1] AS rule_ord, b[2] AS phrase_ord FROM documents d LEFT JOIN h ON h.doc_id = d.doc_id"""


@query("match_many_rules", RUN_SQL)
def many_rules(spark, sf_dir):
    """Every run of 12, 16 and 20 characters of the benchmark is a phrase: some 25,000 rules at sf0.01, 125,000 at sf0.1."""
    table(spark, sf_dir, "benchmark").createOrReplaceTempView("benchmark")
    rules = spark.sql(RUNS.format("explode(sequence(1, greatest(length(text), 1)))", "explode(array(12, 16, 20))"))
    return R.match_user_rules(table(spark, sf_dir, "documents").select("doc_id", "text"), rules).select(
        "doc_id", "matched_phrase", "rule_ord", "phrase_ord")


SIGNALS = ", ".join(S.SIGNAL_NAMES)
on_view("extract_signals", "prompts", lambda p: R.extract_signals(p).select("task_id", *S.SIGNAL_NAMES, "score", "score_level"),
        f"WITH {LOWERED}, {RULED}, {SCORED} SELECT task_id, {SIGNALS}, score, score_level FROM scored")
on_view("extract_signals_documents", "documents",
        lambda d: R.extract_signals(d).select("doc_id", *S.SIGNAL_NAMES, "score", "score_level"),
        f"WITH low AS (SELECT *, lower(text) AS l FROM documents), ruled AS (SELECT * FROM low), {SCORED} "
        f"SELECT doc_id, {SIGNALS}, score, score_level FROM scored")
on_view("ambiguous_scores", "prompts",
        lambda p: R.extract_signals(p).where(S.ambiguous(F.col("score"))).select("task_id", "score"),
        f"WITH {LOWERED}, {RULED}, {SCORED} SELECT task_id, score FROM scored WHERE score >= 0.5 AND score <= {dbl(0.65)}")

# --- decisions --------------------------------------------------------------------------------

DECIDED = ["route", "delegation_level", "task_complexity", "confidence", "reason", "classification_layer", "suggested_model",
           "specialist_key", "cost_of_wrong", "escalation_policy"]
on_view("route", "prompts", lambda p: R.route(p).select("task_id", *DECIDED), route_sql("2"))
on_view("route_by_row_level", "prompts",
        lambda p: R.route(p.withColumn("lvl", (F.col("task_id") % 7).cast("int")), F.col("lvl")).select("task_id", *DECIDED),
        route_sql("CAST(task_id % 7 AS INT)"))
on_view("level_gate", "prompts",
        lambda p: p.select("task_id", R.level_gate((F.col("task_id") % 6).cast("int")).alias("g"))
        .select("task_id", "g.route", "g.escalation_policy", "g.reason"), f"""
SELECT task_id, CASE task_id % 6 WHEN 0 THEN 'cloud' WHEN 5 THEN 'local' END AS route,
  CASE task_id % 6 WHEN 0 THEN 'none' WHEN 5 THEN 'never' END AS escalation_policy,
  CASE task_id % 6 WHEN 0 THEN {lit('Level 0 (Off) — manual delegation only')} WHEN 5 THEN {lit('Level 5 (Offline) — all tasks routed local')} END AS reason
FROM prompts""")

ANSWER = ("""CASE task_id % 8 WHEN 0 THEN '{"category": "COMPLEX", "confidence": 0.99}' WHEN 1 THEN 'This one is Simple, I say' """
          """WHEN 2 THEN '{bad json moderate' WHEN 4 THEN '{"category": "weird", "confidence": 0.5}' """
          """WHEN 5 THEN '{"category": "expert"}' WHEN 6 THEN 'no idea' WHEN 7 THEN '{"confidence": 0.1, "category": "Trivial"}' END""")
TRIAGE = f"""ans AS (SELECT task_id, {ANSWER} AS response FROM prompts),
ans1 AS (SELECT *, CASE WHEN json_valid(response) THEN lower(coalesce(json_extract_string(response, '$.category'), '')) ELSE '' END AS cat,
  CASE WHEN json_valid(response) THEN TRY_CAST(json_extract_string(response, '$.confidence') AS DOUBLE) END AS conf,
  lower({trim('response')}) AS low_answer FROM ans),
ans2 AS (SELECT *, cat IN ('trivial','simple','moderate','complex','expert') AS known FROM ans1),
ans3 AS (SELECT *, CASE WHEN response IS NULL THEN 'moderate' WHEN known THEN cat WHEN contains(low_answer, 'trivial') THEN 'trivial'
  WHEN contains(low_answer, 'simple') THEN 'simple' WHEN contains(low_answer, 'moderate') THEN 'moderate'
  WHEN contains(low_answer, 'complex') THEN 'complex' WHEN contains(low_answer, 'expert') THEN 'expert' ELSE 'unknown' END AS triage_category FROM ans2),
triage AS (SELECT task_id, triage_category,
  CASE triage_category WHEN 'trivial' THEN 1 WHEN 'simple' THEN 2 WHEN 'complex' THEN 5 WHEN 'expert' THEN 6 ELSE 3 END AS triage_level,
  CASE WHEN response IS NULL THEN {dbl(0.3)} WHEN known THEN least({dbl(0.95)}, greatest({dbl(0.3)}, least({dbl(1.0)}, greatest({dbl(0.0)}, coalesce(conf, {dbl(0.7)})))))
    WHEN triage_category = 'unknown' THEN {dbl(0.3)} ELSE {dbl(0.7)} END AS triage_confidence FROM ans3)"""


def answers(prompts):
    return prompts.select("task_id", F.expr(ANSWER).alias("response"))


on_view("parse_triage", "prompts",
        lambda p: R.parse_triage(answers(p)).select("task_id", "triage_category", "triage_level", "triage_confidence"),
        f"WITH {TRIAGE} SELECT * FROM triage")
on_view("route_with_triage", "prompts", lambda p: R.route(p, 3, triage=answers(p)).select("task_id", *DECIDED), f"""
WITH {LOWERED}, {RULED}, {SCORED}, {TRIAGE},
full_set AS (SELECT s.*, s.rule_ord IS NULL AND s.score >= 0.5 AND s.score <= {dbl(0.65)} AS triaged, t.triage_level, t.triage_confidence,
  {NO_LEARNER} FROM scored s LEFT JOIN triage t ON t.task_id = s.task_id), {decided('full_set', '3')}
SELECT task_id, {OUT} FROM decided""")


@query("route_with_learner", f"""
WITH {LOWERED}, {RULED}, {SCORED}, {CELLS},
g AS (SELECT t.task_type, l.level_used, coalesce(n, 0) AS n, coalesce(s, 0) AS s
  FROM (SELECT unnest(['data_transform','analysis','code_mod','text','code_gen']) AS task_type) t
  CROSS JOIN (SELECT CAST(unnest(range(1, 7)) AS INT) AS level_used) l
  LEFT JOIN c ON c.task_type = t.task_type AND c.level_used = l.level_used),
advice AS (WITH {advice_sql('g')}),
full_set AS (SELECT s.*, {NO_TRIAGE}, a.adjusted_level, a.confidence_adjustment, a.reason AS learner_reason,
  a.sample_size AS learner_samples FROM scored s LEFT JOIN advice a ON a.task_type = s.output_type AND a.level_used = s.score_level),
{decided('full_set', '4')} SELECT task_id, {OUT} FROM decided""", ["prompts", "history"])
def _(spark, sf_dir):
    advice = L.routing_advice(view(spark, sf_dir, "history"))
    return R.route(view(spark, sf_dir, "prompts"), 4, learner=advice).select("task_id", *DECIDED)


MIX = """count(*) AS n, count(*) FILTER (route = 'no_llm') AS no_llm, count(*) FILTER (route = 'local') AS local,
  count(*) FILTER (route = 'cloud') AS cloud, count(*) FILTER (route = 'local') / CAST(count(*) AS DOUBLE) * 100 AS local_share,
  coalesce(count(*) FILTER (route = 'local') / CAST(nullif(count(*) FILTER (route IN ('local', 'cloud')), 0) AS DOUBLE) * 100, 0) AS delegation_rate"""
SESSION = "'s' || CAST(task_id % 5 AS VARCHAR(20)) AS session_id"
on_view("route_mix", "prompts", lambda p: U.route_mix(R.route(p.selectExpr("*", SESSION)), ["session_id"]),
        route_sql("2", f"SELECT {SESSION}, {MIX} FROM decided GROUP BY 1"))
SAVED = "CAST(sum(CASE WHEN route = 'local' THEN tokens ELSE 0 END) AS BIGINT) AS local_tokens, " \
        "count(*) FILTER (route = 'local') AS local_tasks, count(*) AS tasks"
on_view("savings_by_level", "prompts",
        lambda p: P.savings_by_level(p.withColumn("tokens", X.estimate_tokens(F.col("text")))), f"""
WITH {LOWERED}, {RULED}, {SCORED}, plain AS (SELECT *, {NO_TRIAGE}, {NO_LEARNER}, {est_tokens('text')} AS tokens,
  unnest([0, 1, 2, 3, 4]) AS each_level FROM scored), {decided('plain', 'each_level')}
SELECT lvl AS level, {SAVED} FROM decided GROUP BY 1""")

# --- small projections ---------------------------------------------------------------------------

CATEGORY = case_of([(has_any("lower(text)", words), lit(n)) for n, words in dims.CATEGORY_WORDS.items()], "NULL")
TOOL = case_of([(has_any("lower(text)", words), lit(n)) for n, words in dims.TOOL_WORDS], "'general'")
on_view("detect_category", "prompts", lambda p: p.select("task_id", R.detect_category(F.col("text")).alias("category")),
        f"SELECT task_id, {CATEGORY} AS category FROM prompts")
on_view("infer_tool", "prompts", lambda p: p.select("task_id", R.infer_tool(F.col("text")).alias("tool")),
        f"SELECT task_id, {TOOL} AS tool FROM prompts")
SPECIALISTS = {"docs": "doc-8b", "tests": "test-8b", "devops": ""}
on_view("select_model", "prompts",
        lambda p: R.select_model(p.select("task_id", R.detect_category(F.col("text")).alias("category"),
                                          (F.col("task_id") % 8).cast("int").alias("task_complexity")), SPECIALISTS), f"""
WITH c AS (SELECT task_id, {CATEGORY} AS category, CAST(task_id % 8 AS INT) AS task_complexity FROM prompts)
SELECT *, CASE category WHEN 'docs' THEN 'doc-8b' WHEN 'tests' THEN 'test-8b' END AS model,
  CASE WHEN category IN ('docs', 'tests') THEN 'specialist' WHEN task_complexity BETWEEN 1 AND 4 THEN 'ladder' ELSE 'default' END AS model_source FROM c""")

COMMAND = """CASE task_id % 6 WHEN 0 THEN '  CS ask ' || text WHEN 1 THEN 'ask local ' || text || ' ' WHEN 2 THEN '/desk:ask ' || text
  WHEN 3 THEN ' cs Status ' WHEN 4 THEN 'CS RESET' ELSE text END"""
on_view("parse_command", "prompts",
        lambda p: p.select("task_id", R.parse_command(F.expr(COMMAND), "desk").alias("c")).select("task_id", "c.command", "c.args"), f"""
WITH t AS (SELECT task_id, {trim(COMMAND)} AS t FROM prompts), u AS (SELECT *, lower(t) AS l FROM t)
SELECT task_id, CASE WHEN starts_with(l, 'cs ask ') OR starts_with(l, 'ask local ') OR starts_with(l, '/desk:ask ') THEN 'ask'
  WHEN l IN ('cs status', '/desk:status') THEN 'status' WHEN l = 'cs reset' THEN 'reset' END AS command,
  CASE WHEN starts_with(l, 'cs ask ') THEN {trim('substr(t, 8)')} WHEN starts_with(l, 'ask local ') THEN {trim('substr(t, 11)')}
  WHEN starts_with(l, '/desk:ask ') THEN {trim('substr(t, 11)')} WHEN l IN ('cs status', '/desk:status', 'cs reset') THEN '' END AS args FROM u""")

SPLIT = """CASE task_id % 5 WHEN 0 THEN 'Here you go: {"subtasks": [{"id": "a", "description": "first", "level": 9, "depends_on": []},
  {"description": "second"}, {"id": "z", "level": 2}, {"id": "c", "description": "third", "level": 0, "depends_on": ["a", "z"]}]} done'
  WHEN 1 THEN '{"subtasks": [{"id": "1", "description": "only one"}]}' WHEN 2 THEN 'nothing to split' WHEN 3 THEN '{"subtasks": []}'
  ELSE '{"subtasks": [{"description": "left", "level": 2.5}, {"id": "2", "description": "right", "level": 4}]' || '}' END"""


@query("parse_decomposition", f"""
WITH a AS (SELECT task_id, regexp_extract({SPLIT}, '(?s)\\{{.*\\}}') AS body FROM prompts),
t AS (SELECT task_id, unnest(from_json(body, '[{{"id":"VARCHAR","description":"VARCHAR","level":"DOUBLE","depends_on":["VARCHAR"]}}]')) AS s
  FROM (SELECT task_id, json_extract(body, '$.subtasks') AS body FROM a WHERE json_valid(body))),
n AS (SELECT task_id, s, count(*) OVER (PARTITION BY task_id) AS n,
  row_number() OVER (PARTITION BY task_id ORDER BY CASE s.description WHEN 'second' THEN 2 WHEN 'third' THEN 3 WHEN 'right' THEN 2 ELSE 1 END) - 1 AS pos
  FROM t WHERE coalesce(s.description, '') <> '')
SELECT task_id, pos, coalesce(s.id, CAST(pos + 1 AS VARCHAR)) AS id, s.description AS description,
  least(greatest(coalesce(s.level, 3), 1), 6) AS estimated_level, coalesce(array_to_string(s.depends_on, ','), '') AS depends_on,
  'Decomposed into ' || n || ' subtasks' AS reason FROM n WHERE n > 1""", ["prompts"])
def _(spark, sf_dir):
    replies = view(spark, sf_dir, "prompts").select("task_id", F.expr(SPLIT).alias("response"))
    split = R.parse_decomposition(replies)
    rows = R.subtask_rows(split, "task_id").withColumn("depends_on", F.array_join("depends_on", ","))
    return rows.join(split.select("task_id", "reason"), "task_id")


CONTENT = "CASE task_id % 4 WHEN 0 THEN text WHEN 1 THEN '  ' WHEN 2 THEN NULL ELSE '' END"
THINKING = ("CASE task_id % 5 WHEN 0 THEN 'so' || chr(10) || '```python' || chr(10) || 'x = 1' || chr(10) || '```' || chr(10) || text "
            "WHEN 1 THEN 'short' || chr(10) || chr(10) || text WHEN 2 THEN 'tiny' WHEN 3 THEN NULL ELSE text || chr(10) || chr(10) || 'the end' END")
LONG = f"list_filter(string_split(th, chr(10) || chr(10)), lambda p: length({trim('p')}) > 20)"
on_view("usable_response", "prompts",
        lambda p: p.select("task_id", R.usable_response(F.expr(CONTENT), F.expr(THINKING)).alias("response")), f"""
WITH t AS (SELECT task_id, {CONTENT} AS co, {THINKING} AS th FROM prompts)
SELECT task_id, CASE WHEN coalesce({trim('co')}, '') <> '' OR coalesce(th, '') = '' THEN coalesce(co, '')
  WHEN {found(X.FENCE, 'th')} THEN {first(X.FENCE, 'th')} WHEN len({LONG}) > 0 THEN {trim(LONG + '[-1]')}
  ELSE {lit('[Thinking model output — see thinking field]' + chr(10))} || th END AS response FROM t""")

HOSTS = "SELECT 'Brand#' || CAST(n_nationkey AS VARCHAR(20)) AS host, CASE WHEN n_nationkey % 2 = 0 THEN 'red widget:latest' ELSE 'absent' END AS configured FROM nation"
MODELS = "SELECT p_brand AS host, p_partkey AS pos, p_name || CASE WHEN p_partkey % 2 = 0 THEN ':latest' ELSE '' END AS name, p_size AS size FROM part"


@query("resolve_model", f"""
WITH h AS ({HOSTS}), m AS ({MODELS}), j AS (SELECT h.configured, m.* FROM h JOIN m ON m.host = h.host),
b AS (SELECT host, min_by(name, pos) FILTER (regexp_replace(name, ':latest$', '') = regexp_replace(configured, ':latest$', '')) AS f FROM j GROUP BY 1),
g AS (SELECT host, name AS big FROM (SELECT *, row_number() OVER (PARTITION BY host ORDER BY size DESC, pos) AS r FROM j) WHERE r = 1)
SELECT h.host, h.configured, coalesce(b.f, g.big, h.configured) AS model, b.f IS NULL AND g.big IS NOT NULL AS auto_detected
FROM h LEFT JOIN b ON b.host = h.host LEFT JOIN g ON g.host = h.host""")
def _(spark, sf_dir):
    table(spark, sf_dir, "nation").createOrReplaceTempView("nation")
    table(spark, sf_dir, "part").createOrReplaceTempView("part")
    return R.resolve_model(spark.sql(HOSTS), spark.sql(MODELS))


URL = ("CASE page_id % 9 WHEN 0 THEN 'http://localhost:11434/api?from=' || url WHEN 1 THEN 'https://127.0.0.1/' || url WHEN 2 THEN 'http://192.168.1.9:80/?u=' || url "
       "WHEN 3 THEN 'http://172.20.3.4/' || url WHEN 4 THEN 'http://172.32.0.1/' || url WHEN 5 THEN 'http://user@10.0.0.7/p?q=' || url WHEN 6 THEN 'not a url ' || url ELSE url END")
on_view("is_local_url", "pages", lambda p: p.select("page_id", X.is_local_url(F.expr(URL)).alias("local")), f"""
WITH u AS (SELECT page_id, lower(regexp_extract({URL}, {lit(X.URL_HOST)}, 1)) AS host FROM pages)
SELECT page_id, host IN ('localhost', '127.0.0.1') OR starts_with(host, '192.168.') OR starts_with(host, '10.')
  OR regexp_matches(host, '^172\\.(1[6-9]|2[0-9]|3[01])\\.') AS local FROM u""")

KEPT = f"regexp_replace(lower(text), '[^a-z0-9' || {lit(X.SPACE)} || ']', '', 'g')"
WORDS = f"array_to_string(list_sort(regexp_extract_all({KEPT}, {lit('[^' + X.SPACE + ']{3,}')})), ' ')"
on_view("fingerprint", "prompts", lambda p: p.select("task_id", X.fingerprint(F.col("text")).alias("fingerprint")), f"""
WITH w AS (SELECT task_id, {WORDS} AS w FROM prompts),
h AS (SELECT task_id, CASE WHEN w = '' THEN CAST(0 AS BIGINT) ELSE list_reduce(list_prepend(CAST(0 AS BIGINT),
  list_transform(string_split(w, ''), lambda c: CAST(ascii(c) AS BIGINT))), lambda a, c: (a * 31 + c) % 4294967296) END AS h FROM w)
SELECT task_id, lower(to_base(CASE WHEN h >= 2147483648 THEN 4294967296 - h ELSE h END, 36)) AS fingerprint FROM h""")
