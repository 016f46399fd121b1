"""The gated local attempt end to end: route, estimate, pack, complete, gate, retry, settle, log."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import dims
from ..operators.corpus import expand_context, pack_context, render_prompt
from ..operators.gate import attempt_verdicts, escalation_payload, settle_attempts
from ..operators.learning import output_estimate
from ..operators.models import Complete, batch_complete
from ..operators.routing import route
from ..sources.workdir import written


@dataclass(frozen=True)
class LightPassOptions:
    gate: dims.GateOptions = field(default_factory=dims.GateOptions)
    context: dims.ContextOptions = field(default_factory=dims.ContextOptions)
    level: int = dims.DEFAULT_LEVEL
    allow_retry: bool = True
    gate_enabled: bool = True
    retry_max_tokens: int = 1200
    model: str = "local"
    concurrency: int = 2


OPTIONAL = ("expected_language", "allowed_files", "required_sections")


def light_pass(tasks: DataFrame, files: DataFrame, log: DataFrame, fn: Complete,
               options: LightPassOptions = LightPassOptions(), learner: DataFrame | None = None) -> dict[str, DataFrame]:
    """Settle tasks (task_id, text, tool) with a caller's completion function.

    Tasks may also have expected_language, allowed_files, required_sections, and file_refs, which then stands for the
    references in the text.  ``results`` has the answer that was accepted; ``escalations`` says what was asked, why it
    failed, and outlines the files that were packed.

    Model calls are dear and may answer differently when repeated, so both rounds of answers are written to
    the shared folder and read back; so is whatever later steps read more than once.  Only softly failed first attempts are packed again and retried.
    Texts that repeat take next to nothing on disk, which says nothing of their size in memory: they meet by shuffle, never by broadcast.
    """
    routed = written(route(tasks, options.level, learner=learner), "routed")
    sized = output_estimate(routed, log)
    packed = written(render_prompt(pack_context(sized, files, options.context)), "packed")
    known = ["tool", "estimated_tokens", *[c for c in OPTIONAL if c in packed.columns]]
    first = written(batch_complete(packed, fn, "task_id", max_tokens="estimated_tokens",
                                   concurrency=options.concurrency, keep=known), "first-answers")
    judge = lambda answers, number: attempt_verdicts(_attempt(answers, packed, number, options), options.gate, enabled=options.gate_enabled)
    judged = written(judge(first, 1), "first-verdicts")
    again = judged.where(F.col("a.should_retry") & F.lit(options.allow_retry)).select("task_id")
    retried = packed.join(again, "task_id", "left_semi")
    wider = render_prompt(expand_context(retried, options.context)).withColumn("_cap", F.lit(options.retry_max_tokens))
    second = written(batch_complete(wider, fn, "task_id", max_tokens="_cap", concurrency=options.concurrency, keep=known),
                     "second-answers")
    settled = written(settle_attempts(judged.unionByName(judge(second, 2)), options.allow_retry), "settled")
    answers = first.withColumn("attempt_count", F.lit(1)).unionByName(second.withColumn("attempt_count", F.lit(2)))
    answers = answers.select("task_id", "attempt_count", "response")
    accepted = F.when(F.col("resolved_locally"), F.col("attempt_count")).alias("_attempt")
    results = settled.select("*", accepted).join(answers.withColumnRenamed("attempt_count", "_attempt").hint("merge"), ["task_id", "_attempt"], "left")
    return {
        "results": results.select(*settled.columns, "response"),
        "escalations": escalation_payload(settled, packed.hint("merge")),
        "log": settled.where("logged").drop("logged", "failure_reasons", "checks_passed", "checks_total"),
        "decisions": routed,
    }


def _attempt(answers: DataFrame, packed: DataFrame, number: int, options: LightPassOptions) -> DataFrame:
    """Attempt rows; a failed call has no response. Answers that hold what was asked need no join; tasks without an id count nowhere."""
    given = [c for c in OPTIONAL if c in packed.columns]
    asked = ["tool", "estimated_tokens", *given]
    if set(asked) <= set(answers.columns):
        told = answers.where(F.col("task_id").isNotNull())
    else:
        told = answers.hint("merge").join(packed.select("task_id", *asked), "task_id")
    return told.withColumnRenamed("estimated_tokens", "expected_tokens").select(
        "task_id", F.lit(number).alias("attempt_no"), F.when(F.col("ok"), F.col("response")).alias("response"),
        "tokens_used", "duration_ms", F.lit(options.model).alias("model"), "tool", "expected_tokens", *given)
