"""Route prompts: level gate, ordered rules, signals, triage, learner, ceiling."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import dims
from ..functions import signals as S
from ..functions.text import FENCE, ahead, contains_any, is_json, one_of, strip, to_fixed
from .joins import fits_broadcast, lookup
from .phrases import BLOCK_CHARS, first_rule
from .staging import settle

RULE_FIELDS = ["rule_route", "rule_level", "rule_confidence", "rule_cost_of_wrong", "rule_category"]
PHRASES = [(phrase, number) for number, rule in enumerate(dims.RULES) for phrase in rule[5]]


# --- rules --------------------------------------------------------------------

def match_rules(prompts: DataFrame, text: str = "text") -> DataFrame:
    """Add the first matching built-in rule and phrase; null where none applies."""
    lowered = prompts.withColumn("_lower", F.lower(text))
    return _match_lowered(lowered).drop("_lower")


def _constants(values: list) -> str:
    """SQL array of built-in constants; one text is far quicker to hand over than hundreds of literals."""
    return "array(" + ", ".join(f"{v!r}D" if isinstance(v, float) else repr(v) for v in values) + ")"


BUILTIN_AT = (f"CASE WHEN rlike(_lower, r'{ahead([p for p, _ in PHRASES])}{one_of([p for p, _ in PHRASES])}') THEN CASE "
              + " ".join(f"WHEN contains(_lower, '{p}') THEN {at}" for at, (p, _) in enumerate(PHRASES, 1)) + " END END")


def _match_lowered(lowered: DataFrame) -> DataFrame:
    at = lambda column, values: F.expr(f"try_element_at({_constants(values)}, {column})")
    out = settle(lowered, {"_phrase_at": F.expr(BUILTIN_AT)})
    out = out.withColumns({"matched_phrase": at("_phrase_at", [p for p, _ in PHRASES]),
                           "rule_ord": at("_phrase_at", [n for _, n in PHRASES])})
    return out.withColumns({name: at("rule_ord + 1", [rule[i] for rule in dims.RULES])
                            for i, name in enumerate(RULE_FIELDS)}).drop("_phrase_at")


def match_user_rules(prompts: DataFrame, rules: DataFrame, text: str = "text", block_chars: int = BLOCK_CHARS) -> DataFrame:
    """Add the first match against a rules table (rule_ord, phrase_ord, phrase, ...), one row for each row of prompts.

    Any number of rules means the same: the phrase that comes first by (rule_ord, phrase_ord) of those that occur in
    the lower-cased text. An empty phrase occurs in every text; a null phrase or a null text matches nothing. Rows need
    no key, so null and repeated ones are matched like others. Columns of prompts with a rule column's name are replaced.
    """
    found = F.col("_rule")
    out = settle(prompts, {"_rule": first_rule(F.lower(text), rules, block_chars)})
    fields = [c for c in rules.columns if c not in ("rule_ord", "phrase_ord", "phrase")]
    return out.withColumns({"matched_phrase": found["phrase"], **{c: found[c] for c in ["rule_ord", "phrase_ord", *fields]}}).drop("_rule")


# --- signals and score ----------------------------------------------------------

def extract_signals(prompts: DataFrame, text: str = "text") -> DataFrame:
    """Add the twelve signals, the score and its level; each text feature is computed once."""
    return _signals_of_lowered(prompts.withColumn("_lower", F.lower(text)))


def _signals_of_lowered(lowered: DataFrame) -> DataFrame:
    worded = lowered.withColumn("_words", S.words_of(F.col("_lower")))
    featured = settle(worded, S.signal_columns(F.col("_lower"), F.col("_words"))).drop("_lower", "_words")
    context = (F.col("files_referenced") * dims.CONTEXT_TOKENS_PER_FILE).alias("estimated_context_tokens")
    scored = featured.withColumn("estimated_context_tokens", context).withColumn("score", S.complexity_score())
    return scored.withColumn("score_level", S.score_to_level(F.col("score")))


# --- triage and decomposition answers ---------------------------------------------

def _strict_json(text: Column, schema: str) -> Column:
    """Fields of a JSON text, null unless the text is well-formed JSON."""
    plain = F.from_json(text, schema, {"allowSingleQuotes": "false"})
    return F.when(is_json(text), plain)


def parse_triage(answers: DataFrame, response: str = "response") -> DataFrame:
    """Category, level and confidence of a triage answer: JSON first, then the first word contained."""
    out = answers.withColumn("_json", _strict_json(F.col(response), "category string, confidence double"))
    named = F.lower(F.coalesce(F.col("_json.category"), F.lit("")))
    known = named.isin(list(dims.TRIAGE_LEVELS))
    stated = F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.coalesce(F.col("_json.confidence"), F.lit(0.7))))
    lowered = F.lower(strip(F.col(response)))
    word = reduce(lambda acc, c: acc.when(F.contains(lowered, F.lit(c)), c), dims.TRIAGE_LEVELS,
                  F.when(F.col(response).isNull(), "moderate").when(known, named)).otherwise("unknown")
    out = out.withColumn("triage_category", word)
    confidence = (F.when(F.col(response).isNull(), 0.3)
                  .when(known, F.least(F.lit(0.95), F.greatest(F.lit(0.3), stated)))
                  .when(F.col("triage_category") == "unknown", 0.3).otherwise(0.7))
    level = S.weight(F.col("triage_category"), dims.TRIAGE_LEVELS, 3)
    return out.withColumn("triage_level", level).withColumn("triage_confidence", confidence).drop("_json")


def parse_decomposition(answers: DataFrame, response: str = "response") -> DataFrame:
    """Add ``decomposed``, ``reason`` and the described ``subtasks`` of a decomposition answer."""
    schema = "subtasks array<struct<id string, description string, level double, depends_on array<string>>>"
    body = F.regexp_extract(F.col(response), r"(?s)\{.*\}", 0)
    described = F.filter(F.coalesce(_strict_json(body, schema)["subtasks"], F.array()),
                         lambda s: F.coalesce(s["description"], F.lit("")) != "")
    task = lambda s, i: F.struct(
        F.coalesce(s["id"], (i + 1).cast("string")).alias("id"), s["description"].alias("description"),
        F.least(F.greatest(F.coalesce(s["level"], F.lit(3.0)), F.lit(1.0)), F.lit(6.0)).alias("estimated_level"),
        F.coalesce(s["depends_on"], F.array().cast("array<string>")).alias("depends_on"))
    out = answers.withColumn("_tasks", F.coalesce(F.transform(described, task), F.array()))
    n = F.size("_tasks")
    return (out.withColumn("decomposed", n > 1)
            .withColumn("reason", F.when(n == 0, "Could not decompose").when(n == 1, "Task is atomic")
                        .otherwise(F.format_string("Decomposed into %d subtasks", n)))
            .withColumn("subtasks", F.when(n > 1, F.col("_tasks")).otherwise(F.slice("_tasks", 1, 0)))
            .drop("_tasks"))


def subtask_rows(decomposed: DataFrame, key: str) -> DataFrame:
    return decomposed.select(key, F.posexplode("subtasks").alias("pos", "s")).select(key, "pos", "s.*")


# --- the decision -------------------------------------------------------------------

def level_gate(level: Column) -> Column:
    """Level 0 sends all to the cloud, level 5 all to the local model; null means go on."""
    return (F.when(level == 0, F.struct(F.lit("cloud").alias("route"), F.lit("none").alias("escalation_policy"),
                                        F.lit("Level 0 (Off) — manual delegation only").alias("reason")))
            .when(level == 5, F.struct(F.lit("local").alias("route"), F.lit("never").alias("escalation_policy"),
                                       F.lit("Level 5 (Offline) — all tasks routed local").alias("reason"))))


def _level_value(level: Column, field: int) -> Column:
    """A level's ceiling or policy; unknown levels use the default level's."""
    table = F.create_map(*[x for k, v in dims.LEVELS.items() for x in (F.lit(k), F.lit(v[field]))])
    return F.coalesce(F.try_element_at(table, level), F.lit(dims.LEVELS[dims.DEFAULT_LEVEL][field]))


def ladder_size(level: Column) -> Column:
    table = F.create_map(*[x for k, v in dims.LADDER.items() for x in (F.lit(k), F.lit(v))])
    return F.try_element_at(table, level.cast("int"))


def learned_adjustment(prompts: DataFrame, learner: DataFrame) -> DataFrame:
    """Attach the learner's advice for (output type, score level).

    Only output types and levels that scoring can produce are kept, so the broadcast side has at most
    5 x 6 rows whatever the history holds.
    """
    types = [name for name, _ in S.OUTPUT_TYPE] + ["code_gen"]
    advice = (learner.where(F.col("task_type").isin(types) & F.col("level_used").between(1, 6))
              .select(F.col("task_type").alias("output_type"), F.col("level_used").alias("score_level"),
                      "adjusted_level", "confidence_adjustment", F.col("reason").alias("learner_reason"),
                      F.col("sample_size").alias("learner_samples")))
    return prompts.join(F.broadcast(advice), ["output_type", "score_level"], "left")


def classify(prompts: DataFrame, text: str = "text", triage: DataFrame | None = None, key: str = "task_id",
             learner: DataFrame | None = None) -> DataFrame:
    """All that a decision needs and that does not depend on the delegation level."""
    out = _signals_of_lowered(_match_lowered(prompts.withColumn("_lower", F.lower(text))))
    if triage is not None:
        parsed = parse_triage(triage).select(key, "triage_level", "triage_confidence")
        # one pass over the prompts: an answer counts only where no rule matched and the score leaves it open
        asked = F.coalesce(F.col("rule_ord").isNull() & S.ambiguous(F.col("score")), F.lit(False))
        out = out.withColumn("_asked", F.when(asked, F.col(key)))
        told = parsed.withColumnRenamed(key, "_asked")
        out = out.join(F.broadcast(told), "_asked", "left") if fits_broadcast(told) else lookup(out, told, "_asked", spread_by=text)
        unheard = {"triage_level": 3, "triage_confidence": 0.3}
        out = out.withColumns({c: F.when(asked, F.coalesce(F.col(c), F.lit(v))) for c, v in unheard.items()}).drop("_asked")
    if learner is not None:
        out = learned_adjustment(out, learner)
    return out


DECISION = ["route", "delegation_level", "task_complexity", "confidence", "reason", "classification_layer",
            "suggested_model", "specialist_key", "decision_cost_of_wrong", "escalation_policy"]


def decide(classified: DataFrame, level: Column | int = dims.DEFAULT_LEVEL) -> DataFrame:
    """Turn classified prompts into routing decisions at a delegation level."""
    lvl = F.lit(level) if isinstance(level, int) else level
    has = set(classified.columns)
    use_triage = F.lit("triage_level" in has)
    null = lambda kind: F.lit(None).cast(kind)
    opt = lambda name, kind: F.col(name) if name in has else null(kind)
    ruled = F.col("rule_ord").isNotNull()
    triaged = ~ruled & use_triage & S.ambiguous(F.col("score"))
    staged = classified.withColumns({
        "_layer": F.when(lvl.isin(0, 5), "level_gate").when(ruled, "1").when(triaged, "3").otherwise("2"),
        "_ceiling": _level_value(lvl, 0),
        "_complexity": F.when(lvl.isin(0, 5), 0).when(ruled, F.col("rule_level"))
                        .when(triaged, opt("triage_level", "int"))
                        .otherwise(F.coalesce(opt("adjusted_level", "int"), F.col("score_level"))),
    })
    layer, ceiling, complexity = F.col("_layer"), F.col("_ceiling"), F.col("_complexity")
    staged = staged.withColumn("_over", (layer != "level_gate") & (complexity > ceiling))
    over = F.col("_over")
    adjusted = F.lit(0.6) + F.coalesce(opt("confidence_adjustment", "double"), F.lit(0.0))
    target = (F.when(layer == "level_gate", level_gate(lvl)["route"]).when(over, "cloud")
              .when(layer == "1", F.when(F.col("rule_route") == "cloud_recommended", "cloud")
                    .otherwise(F.col("rule_route")))
              .otherwise(F.when(complexity == 0, "no_llm").otherwise("local")))
    text_of = lambda n: n.cast("string")
    exceeds = F.concat(F.lit(dims.EXCEEDS), text_of(ceiling), F.lit(")"))
    pattern = F.concat(F.lit(dims.PATTERN_MATCHED), F.col("matched_phrase"), F.lit('"'))
    triage = F.concat(F.lit(dims.TRIAGED), text_of(complexity))
    scored = F.concat(F.lit(dims.SCORED), to_fixed(F.col("score"), 2), F.lit(dims.TO_LEVEL),
                      text_of(F.col("score_level")))
    advised = F.coalesce(opt("learner_samples", "bigint"), F.lit(0)) > 0
    learned = F.concat(F.lit(dims.ADJUSTED), text_of(complexity), F.lit(dims.BY_LEARNER),
                       opt("learner_reason", "string"), F.lit(")"))
    heuristic = F.concat(scored, F.when(advised, learned).otherwise(F.lit("")))
    reason = (F.when(layer == "level_gate", level_gate(lvl)["reason"])
              .when(layer == "1", F.when(over, F.concat(pattern, F.lit(" (Level "), text_of(complexity), F.lit(") "), exceeds))
                    .otherwise(F.concat(pattern, F.lit(" → "), target)))
              .when(layer == "3", F.when(over, F.concat(triage, F.lit(", "), exceeds))
                    .otherwise(F.concat(triage, F.lit(dims.STAYS_LOCAL))))
              .otherwise(F.when(over, F.concat(heuristic, F.lit(", "), exceeds))
                         .otherwise(F.concat(heuristic, F.lit(dims.STAYS_LOCAL)))))
    return staged.withColumns({
        "route": target,
        "delegation_level": lvl,
        "task_complexity": complexity,
        "confidence": F.when(layer == "level_gate", 1.0).when(layer == "1", F.col("rule_confidence"))
                       .when(layer == "3", opt("triage_confidence", "double"))
                       .otherwise(F.least(F.lit(1.0), F.greatest(F.lit(0.1), adjusted))),
        "reason": reason,
        "classification_layer": layer,
        "suggested_model": F.when(~over & (layer != "level_gate"), ladder_size(complexity)),
        "specialist_key": F.when(layer == "1", F.col("rule_category")),
        "decision_cost_of_wrong": F.when(layer == "1", F.col("rule_cost_of_wrong"))
                                   .when(layer != "level_gate", F.col("cost_of_wrong")),
        "escalation_policy": _level_value(lvl, 1),
    }).drop("_layer", "_ceiling", "_complexity", "_over")


def route(prompts: DataFrame, level: Column | int = dims.DEFAULT_LEVEL, text: str = "text",
          triage: DataFrame | None = None, key: str = "task_id", learner: DataFrame | None = None) -> DataFrame:
    """The full decision for each prompt: one pass, no shuffle unless triage answers are joined."""
    kept = prompts.columns
    decided = decide(classify(prompts, text, triage, key, learner), level)
    return decided.select(*kept, *[F.col(c).alias("cost_of_wrong") if c == "decision_cost_of_wrong" else F.col(c)
                                   for c in DECISION])


# --- small projections ----------------------------------------------------------------

def detect_category(text: Column) -> Column:
    lowered = F.lower(text)
    (name, words), *rest = dims.CATEGORY_WORDS.items()
    out = F.when(contains_any(lowered, words), name)
    for name, words in rest:
        out = out.when(contains_any(lowered, words), name)
    return out


def infer_tool(text: Column) -> Column:
    lowered = F.lower(text)
    (name, words), *rest = dims.TOOL_WORDS
    out = F.when(contains_any(lowered, words), name)
    for name, words in rest:
        out = out.when(contains_any(lowered, words), name)
    return out.otherwise("general")


def select_model(df: DataFrame, specialists: dict[str, str], complexity: str = "task_complexity",
                 category: str = "category") -> DataFrame:
    """Specialist model of the category, else the ladder, else the default."""
    pairs = [F.lit(x) for pair in specialists.items() for x in pair]
    table = F.create_map(*pairs) if pairs else F.create_map().cast("map<string,string>")
    own = F.try_element_at(table, F.col(category))
    size = ladder_size(F.col(complexity))
    on_ladder = size.isNotNull() & (size != "none") & ~F.startswith(size, F.lit("cloud"))
    return (df.withColumn("model", F.when(F.coalesce(own, F.lit("")) != "", own))
            .withColumn("model_source", F.when(F.col("model").isNotNull(), "specialist")
                        .when(on_ladder, "ladder").otherwise("default")))


def parse_command(text: Column, namespace: str | None = None) -> Column:
    """Chat command of a prompt as a struct (command, args), null for ordinary prompts.

    ``namespace`` adds the slash forms ``/namespace:ask`` and ``/namespace:status``.
    """
    trimmed = strip(text)
    lowered = F.lower(trimmed)
    asks = ["cs ask ", "ask local "] + ([f"/{namespace}:ask "] if namespace else [])
    statuses = ["cs status"] + ([f"/{namespace}:status"] if namespace else [])
    made = lambda name, args: F.struct(F.lit(name).alias("command"), args.alias("args"))
    out = None
    for prefix in asks:
        rest = made("ask", strip(F.substr(trimmed, F.lit(len(prefix) + 1))))
        hit = F.startswith(lowered, F.lit(prefix))
        out = F.when(hit, rest) if out is None else out.when(hit, rest)
    return out.when(lowered.isin(statuses), made("status", F.lit(""))).when(lowered == "cs reset", made("reset", F.lit("")))


def usable_response(content: Column, thinking: Column) -> Column:
    """The answer, else what can be saved from the thinking text."""
    blank = F.coalesce(strip(content), F.lit("")) == ""
    has_thought = F.coalesce(thinking, F.lit("")) != ""
    paragraphs = F.filter(F.split(thinking, "\n\n"), lambda p: F.length(strip(p)) > 20)
    marker = F.concat(F.lit("[Thinking model output — see thinking field]\n"), thinking)
    saved = (F.when(FENCE.found(thinking), FENCE.first(thinking))
             .when(F.size(paragraphs) > 0, strip(F.try_element_at(paragraphs, F.lit(-1)))).otherwise(marker))
    return F.when(blank & has_thought, saved).otherwise(F.coalesce(content, F.lit("")))


def resolve_model(hosts: DataFrame, models: DataFrame, host: str = "host", configured: str = "configured") -> DataFrame:
    """Model to use per host: the configured one when installed, else the largest, else the configured name.

    ``models`` has (host, pos, name, size).  The minimum and maximum keep one row per host in the partial
    aggregate, so a host with very many models is no hot spot.
    """
    bare = lambda c: F.regexp_replace(c, r":latest\z", "")
    wanted = hosts.select(host, configured)
    listed = models.join(F.broadcast(wanted) if fits_broadcast(wanted) else wanted, host)
    installed = (F.col("name") == F.col(configured)) | (bare(F.col("name")) == bare(F.col(configured)))
    best = listed.groupBy(host).agg(
        F.min_by("name", F.when(installed, F.col("pos"))).alias("_found"),
        F.max_by("name", F.struct(F.col("size"), -F.col("pos"))).alias("_largest"))
    out = hosts.join(best, host, "left")
    return (out.withColumn("model", F.coalesce("_found", "_largest", configured))
            .withColumn("auto_detected", F.col("_found").isNull() & F.col("_largest").isNotNull())
            .drop("_found", "_largest"))


def skip_short(df: DataFrame, tokens: str = "tokens_used", min_tokens: int = 200) -> DataFrame:
    """Tasks whose output is worth delegating."""
    return df.where(F.col(tokens) >= min_tokens)


def light_budget(estimate: Column, max_tokens: int) -> Column:
    return estimate <= max_tokens
