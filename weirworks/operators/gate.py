"""Gate completions for quality and resolve attempts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import dims
from ..dims import NO_ANSWER, NO_RETRY_ANSWER
from ..functions import checks as K
from ..functions.repetition import repetition_loop
from ..functions.text import BARE_PATH, code_of, strip
from .staging import settle

SIGNAL_PARTS = ["_trim", "_code", "_expected", "_lower", "_marker", "_repeats", "_words", "_empty", "_signs", "_brackets",
                "_braces"]


def failure_signals(completions: DataFrame, response: str = "response", language: str = "expected_language",
                    repetition: bool = True, keep_parts: bool = False) -> DataFrame:
    """Add ``failure_signals``, in fixed order, and the ``severity`` and ``signals_accept`` verdict.

    Trimmed text, code, bracket balance and language signs are each computed once in an inner projection.
    """
    text = F.col(response)
    expected = F.nullif(F.lower(language), F.lit("")) if language in completions.columns else F.lit(None).cast("string")
    staged = completions.withColumns({"_trim": strip(text), "_code": code_of(text), "_expected": expected,
                                      "_lower": F.lower(text), "_marker": K.first_marker(text),
                                      "_repeats": repetition_loop(text) if repetition else F.lit(False)})
    staged = staged.withColumn("_words", K.hedge_words(F.col("_lower")))
    staged = staged.withColumns({
        "_empty": F.length("_trim") < 10,
        "_signs": F.when(F.col("_expected").isin(K.LANGUAGES), K.sign_counts(text)),
        "_brackets": K.unmatched_brackets(F.col("_code")),
        "_braces": K.unmatched_braces(F.col("_code")),
    })
    found = {
        "refusal": K.refusal(F.col("_lower")),
        "repetition_loop": F.col("_repeats"),
        "incomplete": K.incomplete(F.col("_trim")),
        "wrong_language": K.wrong_language(F.col("_signs"), F.col("_expected")),
        "confidence_caveat": K.HEDGES.count(F.col("_lower"), F.col("_words")) >= 3,
        "placeholder_markers": (F.col("_marker") != "") | K.HACK.found(text),
        "syntax_error": K.syntax_error(F.col("_code"), F.col("_expected"), F.col("_brackets"), F.col("_braces")),
    }
    listed = F.array_compact(F.array(*[F.when(found[name], name) for name in dims.SIGNAL_ORDER if name in found]))
    signals = F.when(text.isNull(), F.lit(None)).when(F.col("_empty"), F.array(F.lit("empty_output"))).otherwise(listed)
    out = settle(staged, {"failure_signals": signals}).withColumn("severity", verdict(F.col("failure_signals")))
    out = out.withColumn("signals_accept", F.col("severity") != "major")
    return out if keep_parts else out.drop(*SIGNAL_PARTS)


def verdict(signals: Column) -> Column:
    """none, minor (accept with a warning) or major (reject)."""
    critical = F.arrays_overlap(signals, F.array(*[F.lit(s) for s in dims.CRITICAL_SIGNALS]))
    return F.when(F.size(signals) == 0, "none").when(critical | (F.size(signals) >= 2), "major").when(
        F.size(signals) == 1, "minor")


def quality_gate(completions: DataFrame, options: dims.GateOptions = dims.GateOptions(), response: str = "response",
                 language: str = "expected_language", expected_tokens: str = "expected_tokens",
                 allowed_files: str = "allowed_files", required_sections: str = "required_sections") -> DataFrame:
    """Add all checks, failures, counts and the accept / retry / escalate verdict.

    A major failure signal stands for one failed check; otherwise the enabled checks run in fixed order.
    Option columns that the input lacks count as not given.
    """
    has = set(completions.columns)
    given = lambda name, kind: F.col(name) if name in has else F.lit(None).cast(kind)
    text = F.col(response)
    allowed, sections = given(allowed_files, "array<string>"), given(required_sections, "array<string>")
    judged = failure_signals(completions, response, language, options.check_repetition, keep_parts=True)
    hedges = K.MORE_HEDGES.count(F.col("_lower"), F.col("_words"))
    planned = [
        (options.check_completeness, "completeness", K.completeness_reason(F.col("_marker")), True),
        (options.check_code_parse, "code_parse", K.code_parse_reason(F.col("_brackets"), F.col("_braces")), True),
        (options.check_scope, "scope_compliance", K.scope_reason(text, allowed), True),
        (True, "required_sections", K.sections_reason(text, sections, F.col("_lower")), True),
        (True, "length", K.length_reason(F.col("_trim"), options.min_length, options.max_length), True),
        (options.check_hedging, "no_hedging", K.hedging_reason(hedges), False),
        (options.check_proportionality, "proportionality",
         K.proportion_reason(text, given(expected_tokens, "bigint")), False),
    ]
    reasons = [(name, f"_why_{name}", reason, hard) for on, name, reason, hard in planned if on]
    # a major signal stands for all checks, so their reasons are never asked for
    judged = settle(judged, {column: F.when(F.col("severity") != "major", reason) for _, column, reason, _ in reasons})
    rejected = F.concat(F.lit("Local model failed: "), F.array_join("failure_signals", ", "))
    ran = F.array(*[K.check(name, F.col(column), hard) for name, column, _, hard in reasons])
    judged = judged.withColumn("checks", F.when(text.isNotNull(), F.when(
        F.col("severity") == "major", F.array(K.check("escalation_signals", rejected, True))).otherwise(ran)))
    judged = judged.withColumns({
        "hard_failures": F.filter("checks", lambda c: c["hard"] & ~c["passed"]),
        "soft_failures": F.filter("checks", lambda c: ~c["hard"] & ~c["passed"]),
        "checks_passed": F.size(F.filter("checks", lambda c: c["passed"])),
        "checks_total": F.size("checks"),
    })
    hard, soft = F.size("hard_failures") > 0, F.size("soft_failures") > 0
    return judged.withColumns({
        "accepted": ~hard & ~soft, "should_retry": ~hard & soft, "should_escalate": hard,
    }).drop(*SIGNAL_PARTS, *[column for _, column, _, _ in reasons])


CHECK_NAMES = ["escalation_signals", "completeness", "code_parse", "scope_compliance", "required_sections", "length",
               "no_hedging", "proportionality"]


def check_rates(gated: DataFrame) -> DataFrame:
    """How often each check ran and passed, in one aggregation over the check arrays."""
    ran = lambda name: F.size(F.filter("checks", lambda c: c["name"] == name))
    passed = lambda name: F.size(F.filter("checks", lambda c: (c["name"] == name) & c["passed"]))
    sums = gated.agg(*[
        F.struct(F.lit(n).alias("name"), F.coalesce(F.sum(ran(n)), F.lit(0)).alias("n"),
                 F.coalesce(F.sum(passed(n)), F.lit(0)).alias("passed")).alias(n) for n in CHECK_NAMES])
    return sums.select(F.inline(F.array(*CHECK_NAMES)))


def out_of_scope_refs(completions: DataFrame, allowed: DataFrame, key: str = "task_id",
                      response: str = "response") -> DataFrame:
    """References in answers that match none of the task's allowed files (task, file) by suffix either way.

    The suffix test runs within one task only: references and files meet on the task key, and a reference is
    out of scope when no file of its task matched.
    """
    refs = completions.select(key, F.explode(F.array_distinct(BARE_PATH.all(F.col(response)))).alias("ref"))
    files = allowed.select(key, F.replace("file", F.lit("\\"), F.lit("/")).alias("_file"))
    near = F.endswith("ref", F.col("_file")) | F.endswith("_file", F.col("ref"))
    limited = refs.join(files.select(key).distinct(), key, "left_semi")
    return limited.join(files.select(F.col(key).alias("_key"), "_file"),
                        (F.col(key) == F.col("_key")) & near, "left_anti")


# --- attempts --------------------------------------------------------------------------

CARRIED = ["tokens_used", "duration_ms", "model", "tool"]


def _reasons(failures: Column) -> Column:
    return F.transform(failures, lambda c: F.coalesce(c["reason"], c["name"]))


def attempt_verdicts(attempts: DataFrame, options: dims.GateOptions = dims.GateOptions(), key: str = "task_id",
                     enabled: bool = True, keep: tuple[str, ...] = (), **columns) -> DataFrame:
    """Gate attempts and keep one small struct per attempt, and the columns named in ``keep``; their text stays behind.

    With the gate off, every first attempt that answered is accepted, and no check counts.
    """
    gated = quality_gate(attempts, options, **columns)
    if not enabled:
        open_ = F.col("attempt_no") == 1
        none = F.array().cast(gated.schema["hard_failures"].dataType)
        gated = gated.withColumns({c: F.when(open_, v).otherwise(F.col(c)) for c, v in {
            "accepted": F.lit(True), "should_retry": F.lit(False), "should_escalate": F.lit(False), "hard_failures": none,
            "soft_failures": none, "checks_passed": F.lit(0), "checks_total": F.lit(0)}.items()})
    row = F.struct(
        F.col("response").isNotNull().alias("answered"), "accepted", "should_retry", "should_escalate",
        F.concat(_reasons(F.col("hard_failures")), _reasons(F.col("soft_failures"))).alias("reasons"),
        (F.size("soft_failures") > 0).alias("soft"), "checks_passed", "checks_total", *CARRIED)
    return gated.select(key, "attempt_no", row.alias("a"), *keep)


def settle_attempts(verdicts: DataFrame, allow_retry: bool = True, key: str = "task_id") -> DataFrame:
    """Settle each task from the verdicts of its first and second attempt."""
    pick = lambda n: F.max(F.when(F.col("attempt_no") == n, F.col("a"))).alias(f"a{n}")
    return settle_pairs(verdicts.groupBy(key).agg(pick(1), pick(2)), key, allow_retry)


def resolve_attempts(attempts: DataFrame, options: dims.GateOptions = dims.GateOptions(), allow_retry: bool = True,
                     key: str = "task_id", **columns) -> DataFrame:
    """Gate first and second attempts and settle each task.

    The second attempt counts only when the first failed softly and retry is on.
    """
    counted = attempts.where(F.col("attempt_no").isin(1, 2))
    return settle_attempts(attempt_verdicts(counted, options, key, **columns), allow_retry, key)


def settle_pairs(pairs: DataFrame, key: str, allow_retry: bool) -> DataFrame:
    """Settle tasks from rows with both verdicts, ``a1`` and ``a2``; null where there was no attempt."""
    a1, a2 = F.col("a1"), F.col("a2")
    answered = lambda a: F.coalesce(a["answered"], F.lit(False))
    retry = answered(a1) & ~a1["accepted"] & a1["should_retry"] & ~a1["should_escalate"] & F.lit(allow_retry)
    passed2 = a2["accepted"] | (~a2["should_escalate"] & ~a2["soft"])
    path = (F.when(~answered(a1), "no_answer").when(a1["accepted"], "first")
            .when(retry & ~answered(a2), "no_retry_answer").when(retry & passed2, "second")
            .when(retry, "failed_twice").otherwise("failed_once"))
    p = F.col("_path")
    out = pairs.withColumn("_path", path)
    both = p.isin("second", "failed_twice")
    last = lambda f: F.when(p.isin("no_answer", "no_retry_answer"), F.lit(None)).when(both, a2[f]).otherwise(a1[f])
    total = lambda f: F.when(p.isin("no_answer", "no_retry_answer"), F.lit(None)).when(both, a1[f] + a2[f]).otherwise(a1[f])
    none = F.array().cast("array<string>")
    reasons = (F.when(p == "no_answer", F.array(F.lit(NO_ANSWER)))
               .when(p == "no_retry_answer", F.array(F.lit(NO_RETRY_ANSWER)))
               .when(p == "failed_twice", F.array_distinct(F.concat(a1["reasons"], a2["reasons"])))
               .when(p == "failed_once", F.array_distinct(a1["reasons"])).otherwise(none))
    return out.select(
        key,
        F.when(p == "first", "accepted").when(p == "second", "retried_accepted").otherwise("escalated").alias("quality_status"),
        F.when(p.isin("second", "failed_twice", "no_retry_answer"), 2).otherwise(1).alias("attempt_count"),
        total("tokens_used").alias("tokens_used"), last("tokens_used").alias("output_tokens"),
        total("duration_ms").alias("duration_ms"), last("model").alias("model"), last("tool").alias("tool"),
        p.isin("first", "second").alias("resolved_locally"),
        (~p.isin("no_answer", "no_retry_answer")).alias("logged"),
        reasons.alias("failure_reasons"),
        F.when(p == "first", a1["checks_passed"]).when(p == "second", a2["checks_passed"]).alias("checks_passed"),
        F.when(p == "first", a1["checks_total"]).when(p == "second", a2["checks_total"]).alias("checks_total"))


def escalation_payload(resolved: DataFrame, tasks: DataFrame | None = None, key: str = "task_id", text: str = "text") -> DataFrame:
    """The two message forms of every escalated task.

    ``tasks`` with the task's text and, packed, its ``outlines`` add ``task_intent`` and ``file_context``.
    """
    plural = F.when(F.col("attempt_count") > 1, "s").otherwise("")
    top = F.concat(F.lit("Local model failed after "), F.col("attempt_count").cast("string"), F.lit(" attempt"),
                   plural, F.lit(". "))
    rows = resolved.where(~F.col("resolved_locally"))
    if tasks is not None:
        line = lambda f: F.struct(f["path"].alias("file"), file_context(f["language"], f["total_lines"], f["classes"], f["functions"]).alias("outline"))
        context = F.transform("outlines", line) if "outlines" in tasks.columns else F.array().cast("array<struct<file: string, outline: string>>")
        rows = rows.join(tasks.select(key, F.col(text).alias("task_intent"), context.alias("file_context")), key, "left")
    return rows.withColumns({
        "message": F.concat(top, F.lit("Reasons: "), F.array_join("failure_reasons", "; ")),
        "escalation_message": F.concat(top, F.array_join("failure_reasons", ". "), F.lit(".")),
    })


def file_context(language: Column, total_lines: Column, classes: Column, functions: Column) -> Column:
    """One-line outline of a file for an escalation."""
    return F.concat(language, F.lit(", "), total_lines.cast("string"), F.lit(" lines. Classes: ["),
                    F.array_join(classes, ", "), F.lit("]. Functions: ["), F.array_join(functions, ", "), F.lit("]"))
