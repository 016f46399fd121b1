"""Features of a prompt and the complexity score built from them.

Functions take the lower-cased prompt and, where they look for whole words, its key words.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import dims
from .text import Rx, Words, contains_any, files_referenced, key_words

# --- fixed values: what each feature listens for, first hit wins --------------
SCOPE = [
    ("system", ["across the codebase", "across the project", "across the repo", "entire codebase", "entire project",
                "all files", "everywhere"]),
    ("module", ["this module", "this package", "this directory", "multiple files", "several files"]),
    ("file", ["this file", "single file", "in this file", "the file"]),
]
STEPS = Words("then", "next", "after that", "followed by", "finally", "first", "second", "third")
CONDITIONS = Words("if", "unless", "when", "while", "depending", "consider", "ensure", "make sure")
DEPTH_BONUS = [
    (Rx("analyze{.}*then{.}*refactor", needs=("analyze", "then", "refactor")), 0.2),
    (Rx("debug{.}*fix{.}*test", needs=("debug", "fix", "test")), 0.2),
    (Rx("understand{.}*implement", needs=("understand", "implement")), 0.15),
    (Words("why"), 0.1),
    (Words("how{.}*should"), 0.15),
]
TOOL_CHAIN = Words("make it work", "until", "iterate", "keep trying", "back and forth", "test{.}*fix",
                      "fix{.}*test", "debug{.}*fix", "try{.}*different")
OUTPUT_TYPE = [
    ("data_transform", Words("convert", "format", "transform", "parse", "serialize", "deserialize", "json",
                                "yaml", "csv")),
    ("analysis", Words("explain", "summarize", "analyze", "review", "describe", "what does")),
    ("code_mod", Words("refactor", "rename", "move", "extract", "inline", "modify", "update", "change", "fix")),
    ("text", Words("docstring", "comment", "readme", "documentation", "message", "note", "changelog")),
]
NOVELTY = [
    ("boilerplate", Words("boilerplate", "template", "scaffold", "skeleton", "stub", "placeholder")),
    ("known_pattern", Words("crud", "rest", "api endpoint", "config", "env", "setup", "init")),
    ("novel", Words("novel", "unique", "custom", "from scratch", "new approach", "innovative")),
    ("adaptation", Words("adapt", "modify", "extend", "customize", "adjust", "tweak")),
]
COST_OF_WRONG = [
    ("critical", Words("security", "auth", "password", "credential", "secret", "encrypt", "vulnerability",
                          "production deploy")),
    ("high", Words("database migration", "schema change", "deploy", "infrastructure", "payment", "billing")),
    ("medium", Words("refactor", "api change", "interface change", "breaking change", "public api")),
    ("trivial", Words("test", "doc", "comment", "format", "style", "lint", "readme")),
]
REVERSIBILITY = [
    ("hard_to_reverse", Words("migration", "deploy", "publish", "release", "delete", "drop",
                                 "remove{.}*permanently")),
    ("needs_review", Words("refactor", "rename across", "change api", "modify interface")),
]
FILE_SUFFIX = Rx(r"\.(?:py|js|ts|go|rs|java|rb|php|c|cpp|cs){>}", needs=(".",))
EXAMPLES = Words("example", "like this", "such as", "for instance", "similar to")
# these end in punctuation, so the word edge after them needs a word character next
MARKED_EXAMPLES = [Rx(r"{<}e\.g\.{b}", needs=("e.g.",)), Rx("{<}pattern:{b}", needs=("pattern:",))]
TESTS = Words("test exists", "has tests", "test file", "spec file", "test suite", "coverage")

SIGNAL_NAMES = ["files_referenced", "estimated_context_tokens", "scope", "reasoning_depth",
                "requires_tool_chain", "output_type", "novelty", "cost_of_wrong", "reversibility",
                "language_familiarity", "has_examples", "has_tests"]


GROUPS = [STEPS, CONDITIONS, TOOL_CHAIN, EXAMPLES, TESTS,
          *[b for b, _ in DEPTH_BONUS if isinstance(b, Words)],
          *[group for table in (OUTPUT_TYPE, NOVELTY, COST_OF_WRONG, REVERSIBILITY) for _, group in table]]


def words_of(lowered: Column) -> Column:
    """Key words of a prompt for all word features."""
    return key_words(lowered, *GROUPS)


def _label(table: list[tuple[str, Column]], default: str) -> Column:
    (name, hit), *rest = table
    out = F.when(hit, name)
    for name, hit in rest:
        out = out.when(hit, name)
    return out.otherwise(default)


def _by_words(table: list[tuple[str, Words]], lowered: Column, words: Column, default: str) -> Column:
    return _label([(name, group.found(lowered, words)) for name, group in table], default)


def scope(lowered: Column) -> Column:
    return _label([(name, contains_any(lowered, phrases)) for name, phrases in SCOPE], "function")


def reasoning_depth(lowered: Column, words: Column) -> Column:
    steps = F.least(STEPS.count(lowered, words) * F.lit(0.15), F.lit(0.45))
    conditions = F.least(CONDITIONS.count(lowered, words) * F.lit(0.1), F.lit(0.3))
    hit = lambda rx: rx.found(lowered, words) if isinstance(rx, Words) else rx.found(lowered)
    bonuses = [F.when(hit(rx), bonus).otherwise(0.0) for rx, bonus in DEPTH_BONUS]
    return F.least(reduce(lambda a, b: a + b, [steps, conditions, *bonuses]), F.lit(1.0))


def requires_tool_chain(lowered: Column, words: Column) -> Column:
    return TOOL_CHAIN.found(lowered, words)


def output_type(lowered: Column, words: Column) -> Column:
    return _by_words(OUTPUT_TYPE, lowered, words, "code_gen")


def novelty(lowered: Column, words: Column) -> Column:
    return _by_words(NOVELTY, lowered, words, "known_pattern")


def cost_of_wrong(lowered: Column, words: Column) -> Column:
    return _by_words(COST_OF_WRONG, lowered, words, "low")


def reversibility(lowered: Column, words: Column) -> Column:
    return _by_words(REVERSIBILITY, lowered, words, "easy_undo")


def language_familiarity(lowered: Column) -> Column:
    """Score of the first language name contained, else of the first file suffix, else the middle."""
    (name, score), *rest = dims.LANGUAGE_FAMILIARITY.items()
    named = F.when(F.contains(lowered, F.lit(name)), score)
    for name, score in rest:
        named = named.when(F.contains(lowered, F.lit(name)), score)
    suffix = FILE_SUFFIX.first(lowered)
    by_suffix = weight(suffix, dims.FAMILIARITY_BY_EXTENSION, dims.DEFAULT_FAMILIARITY)
    return named.otherwise(by_suffix)


def has_examples(lowered: Column, words: Column) -> Column:
    return reduce(lambda a, b: a | b, [EXAMPLES.found(lowered, words), *[rx.found(lowered) for rx in MARKED_EXAMPLES]])


def has_tests(lowered: Column, words: Column) -> Column:
    return TESTS.found(lowered, words)


def weight(key: Column, table: dict[str, float], default: float) -> Column:
    """Look a key up in a fixed weight table."""
    (name, value), *rest = table.items()
    out = F.when(key == name, value)
    for name, value in rest:
        out = out.when(key == name, value)
    return out.otherwise(default)


def signal_columns(lowered: Column, words: Column) -> dict[str, Column]:
    """All text features but the context size, which follows from the file count."""
    return {
        "files_referenced": files_referenced(lowered),
        "scope": scope(lowered),
        "reasoning_depth": reasoning_depth(lowered, words),
        "requires_tool_chain": requires_tool_chain(lowered, words),
        "output_type": output_type(lowered, words),
        "novelty": novelty(lowered, words),
        "cost_of_wrong": cost_of_wrong(lowered, words),
        "reversibility": reversibility(lowered, words),
        "language_familiarity": language_familiarity(lowered),
        "has_examples": has_examples(lowered, words),
        "has_tests": has_tests(lowered, words),
    }


def complexity_score(s=F.col) -> Column:
    """Weighted sum of the signals in a fixed order of double additions, clamped to 0..1."""
    context = s("estimated_context_tokens") / F.lit(float(dims.CONTEXT_WINDOW))
    terms = [
        weight(s("scope"), dims.SCOPE_WEIGHT, 0.0),
        s("reasoning_depth"),
        F.when(s("requires_tool_chain"), 0.3).otherwise(0.0),
        weight(s("novelty"), dims.NOVELTY_WEIGHT, 0.0),
        weight(s("cost_of_wrong"), dims.COST_WEIGHT, 0.0),
        F.least(context * F.lit(0.5), F.lit(0.4)),
        -(s("language_familiarity") * F.lit(0.1)),
        F.when(s("has_examples"), -0.1).otherwise(0.0),
        F.when(s("has_tests"), -0.1).otherwise(0.0),
    ]
    total = reduce(lambda a, b: a + b, terms)
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), total))


def score_to_level(score: Column) -> Column:
    (cut, level), *rest = dims.LEVEL_CUTOFFS
    out = F.when(score < cut, level)
    for cut, level in rest:
        out = out.when(score < cut, level)
    return out.otherwise(6)


def ambiguous(score: Column) -> Column:
    return score.between(*dims.AMBIGUOUS)
