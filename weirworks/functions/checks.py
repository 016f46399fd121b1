"""Failure signals and gate checks of a completion, as expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import dims
from .text import BARE_PATH, Rx, Words, contains_any, estimate_tokens, is_json, key_words, units

# --- fixed values: signs of a language ---------------------------------------
LANGUAGE_SIGNS = {
    "python": [Rx(r"{<}def{s}+\w+\(", needs=("def",)), Rx(r"{<}import{s}+\w+", needs=("import",)),
               Rx(r"{<}class{s}+\w+:", needs=("class",)), Rx(r"(?:\A|[\n\r\x{2028}\x{2029}]){s}*#", needs=("#",))],
    "javascript": [Rx(r"{<}function{s}+\w+\(", needs=("function",)), Rx(r"{<}const{s}+\w+{s}*=", needs=("const",)),
                   Rx(r"=>{s}*\{", needs=("=>",)), Rx(r"{<}require\(", needs=("require(",))],
    "typescript": [Rx(r":{s}*(?:string|number|boolean){>}", needs=(":",), one_of=("string", "number", "boolean")), Rx(r"{<}interface{s}+", needs=("interface",)),
                   Rx(r"{<}type{s}+\w+{s}*=", needs=("type", "="))],
    "java": [Rx(r"{<}public{s}+(?:class|static|void)", needs=("public",)),
             Rx(r"System\.out\.print", needs=("System.out.print",))],
    "go": [Rx(r"{<}func{s}+\w+\(", needs=("func",)), Rx(r"{<}package{s}+\w+", needs=("package",)),
           Rx(r"{<}fmt\.\w+", needs=("fmt.",))],
    "rust": [Rx(r"{<}fn{s}+\w+\(", needs=("fn",)), Rx(r"{<}let{s}+mut{s}+", needs=("let", "mut")),
             Rx(r"{<}impl{s}+", needs=("impl",))],
}
LANGUAGES = list(LANGUAGE_SIGNS)
HEDGES = Words(*dims.HEDGES)
MORE_HEDGES = Words(*dims.MORE_HEDGES)
MARKERS = Rx("{<}(?:" + "|".join(dims.MARKERS) + "){>}")
HACK = Rx("{<}HACK{>}", needs=("HACK",))


def refusal(lowered: Column) -> Column:
    return contains_any(lowered, dims.REFUSAL_PHRASES)


def hedge_words(lowered: Column) -> Column:
    return key_words(lowered, MORE_HEDGES)


def first_marker(text: Column) -> Column:
    """The first placeholder marker, the empty string when there is none."""
    return F.when(contains_any(text, dims.MARKERS), MARKERS.first(text)).otherwise("")


def count_of(text: Column, char: str) -> Column:
    """How often an ASCII character occurs."""
    return F.octet_length(text) - F.octet_length(F.replace(text, F.lit(char), F.lit("")))


def left_open(text: Column, opener: str, closer: str) -> Column:
    """More than two are left open; closers are counted only where there are more openers than that."""
    opened = count_of(text, opener)
    return (opened > 2) & (opened - count_of(text, closer) > 2)


def incomplete(trimmed: Column) -> Column:
    """Cut off: trailing dots, or more than two blocks or calls left open."""
    return F.endswith(trimmed, F.lit("...")) | left_open(trimmed, "{", "}") | left_open(trimmed, "(", ")")


def sign_counts(text: Column) -> Column:
    """How many signs of each known language appear, in the order of ``LANGUAGES``."""
    hits = lambda signs: sum((rx.found(text).cast("int") for rx in signs[1:]), signs[0].found(text).cast("int"))
    return F.array(*[hits(signs) for signs in LANGUAGE_SIGNS.values()])


def wrong_language(counts: Column, expected: Column) -> Column:
    """Another language shows two or more signs and more of them than the expected one."""
    at = F.array_position(F.array(*[F.lit(x) for x in LANGUAGES]), expected)
    own = F.try_element_at(counts, F.when(at > 0, at).cast("int"))
    return F.coalesce((F.array_max(counts) >= 2) & (F.array_max(counts) > own), F.lit(False))


NESTED = 4      # pairs nested up to this deep are taken out before the walk


def unbalanced(code: Column, opener: str, closer: str) -> Column:
    """The running depth falls below -2, or ends more than 2 away from zero.

    A pair with nothing between moves neither the lowest nor the last depth, so such pairs go first.
    """
    some = contains_any(code, [opener, closer])
    only = F.when(some, F.regexp_replace(code, f"[^\\{opener}\\{closer}]+", "")).otherwise("")
    for _ in range(NESTED):
        only = F.replace(only, F.lit(opener + closer), F.lit(""))
    start = F.struct(F.lit(0).alias("depth"), F.lit(0).alias("low"))

    def step(state, char):
        depth = state["depth"] + F.when(char == opener, 1).when(char == closer, -1).otherwise(0)
        return F.struct(depth.alias("depth"), F.least(state["low"], depth).alias("low"))

    # few brackets cannot be out of balance, so most rows skip the walk
    walked = F.aggregate(F.split(only, ""), start, step, lambda s: (s["low"] < -2) | (F.abs(s["depth"]) > 2))
    return F.when(F.length(only) > 2, walked).otherwise(False)


def unmatched_brackets(code: Column) -> Column:
    return unbalanced(code, "(", ")") | unbalanced(code, "[", "]")


def unmatched_braces(code: Column) -> Column:
    return unbalanced(code, "{", "}")


def syntax_error(code: Column, expected: Column, brackets: Column, braces: Column) -> Column:
    return (F.when(expected.isNull(), False)
            .when(expected == "python", brackets)
            .when(expected == "json", ~is_json(code))
            .otherwise(brackets | braces))


def check(name: str, reason: Column, hard: bool) -> Column:
    """One gate check; it passed when there is no reason against it."""
    return F.struct(F.lit(name).alias("name"), reason.isNull().alias("passed"),
                    reason.alias("reason"), F.lit(hard).alias("hard"))


def completeness_reason(marker: Column) -> Column:
    return F.when(marker != "", F.concat(F.lit("Found placeholder marker: "), marker))


def code_parse_reason(brackets: Column, braces: Column) -> Column:
    return F.when(brackets, "Unmatched brackets").when(braces, "Unmatched braces")


def out_of_scope(text: Column, allowed: Column) -> Column:
    """References in the answer that match no allowed file by suffix either way."""
    files = F.transform(allowed, lambda f: F.replace(f, F.lit("\\"), F.lit("/")))
    known = lambda ref: F.exists(files, lambda f: F.endswith(ref, f) | F.endswith(f, ref))
    return F.when(F.size(allowed) > 0, F.filter(BARE_PATH.all(text), lambda ref: ~known(ref)))


def scope_reason(text: Column, allowed: Column) -> Column:
    outside = out_of_scope(text, allowed)
    return F.when(F.size(outside) > 0, F.concat(F.lit("Files outside scope: "), F.array_join(outside, ", ")))


def missing_sections(text: Column, sections: Column, lowered: Column) -> Column:
    """Sections that the text does not name; only texts that hold a section's letters are searched for its edges."""
    quoted = lambda s: F.regexp_replace(s, r"([.*+?^${}()|\[\]\\])", r"\\$1")
    edge = Rx("{b}").java
    pattern = lambda s: F.concat(F.lit("(?i)" + edge), quoted(s), F.lit(edge))
    # the search ignores the case of A-Z alone, as lower-casing does for them; other letters may change in number
    worth = lambda s: F.contains(lowered, F.lower(s)) | (F.octet_length(s) > F.length(s))
    return F.filter(sections, lambda s: ~F.when(worth(s), F.rlike(text, pattern(s))).otherwise(s.isNull()))


def sections_reason(text: Column, sections: Column, lowered: Column) -> Column:
    missing = missing_sections(text, sections, lowered)
    return F.when(F.size(missing) > 0, F.concat(F.lit("Missing sections: "), F.array_join(missing, ", ")))


def length_reason(trimmed: Column, low: int, high: int) -> Column:
    n = units(trimmed)
    return (F.when(n < low, F.format_string(f"Output too short: %d chars (min {low})", n))
            .when(n > high, F.format_string(f"Output too long: %d chars (max {high})", n)))


def hedging_reason(n: Column) -> Column:
    return F.when(n >= 3, F.format_string("Excessive hedging: %d instances", n))


def proportion_reason(text: Column, expected: Column) -> Column:
    actual = estimate_tokens(text)
    ratio = actual / F.nullif(expected, F.lit(0))
    told = lambda word: F.format_string(f"Output disproportionately {word}: %d tokens vs %d expected", actual, expected)
    return F.when(expected > 0, F.when(ratio < 0.2, told("short")).when(ratio > 5, told("long")))
