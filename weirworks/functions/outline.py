"""Imports, exports, signatures and structure of source files, line by line."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import dims
from .text import Rx, base_name, contains_any, extension, strip

# --- fixed values: line forms -------------------------------------------------
IMPORT_STARTS = ["import ", "from ", "#include", "using ", "use "]
REQUIRE = Rx(r"^(?:const|let|var){s}+{.}*={s}*require\(", needs=("require(",))
EXPORT_STARTS = ["export ", "module.exports", "exports."]
SIGNATURES = [
    Rx(r"^(?:export{s}+)?(?:async{s}+)?function{s}+\w+"),
    Rx(r"^(?:export{s}+)?(?:const|let|var){s}+\w+{s}*={s}*(?:async{s}+)?\("),
    Rx(r"^(?:async{s}+)?def{s}+\w+"),
    Rx(r"^func{s}+"),
    Rx(r"^(?:pub{s}+)?(?:async{s}+)?fn{s}+"),
    Rx(r"^(?:public|private|protected|static){s}+{.}*\w+{s}*\("),
]
BODY = Rx(r"\{{.}*\z")
TAIL_COLON = Rx(r":{s}*\z")
CLASS = Rx(r"^(?:export{s}+)?(?:abstract{s}+)?class{s}+(\w+)", needs=("class",))
FUNCTION = Rx(r"^(?:export{s}+)?(?:async{s}+)?function{s}+(\w+)", needs=("function",))
ASSIGNED = Rx(r"^(?:export{s}+)?(?:const|let|var){s}+(\w+){s}*=", needs=("=",))
DEF = Rx(r"^(?:async{s}+)?def{s}+(\w+)", needs=("def",))
# plain strings of which every import, and every definition, holds one
IMPORT_PARTS = [*IMPORT_STARTS, "require("]
DEFINING_PARTS = ["class", "function", "def", "=>"]
EXPORT_WIDTH = 120
SIGNATURE_WIDTH = 150


def lines_of(content: Column) -> Column:
    return F.split(content, "\n")


def head(content: Column, n: int = 10) -> Column:
    return F.slice(lines_of(content), 1, n)


def starts_any(text: Column, starts: list[str]) -> Column:
    hit = F.startswith(text, F.lit(starts[0]))
    for start in starts[1:]:
        hit = hit | F.startswith(text, F.lit(start))
    return hit


def shorten(text: Column, width: int) -> Column:
    return F.when(F.length(text) > width, F.concat(F.substring(text, 1, width), F.lit("..."))).otherwise(text)


def is_import(trimmed: Column) -> Column:
    return starts_any(trimmed, IMPORT_STARTS) | REQUIRE.found(trimmed)


def is_export(trimmed: Column) -> Column:
    return starts_any(trimmed, EXPORT_STARTS)


def export_line(trimmed: Column) -> Column:
    return shorten(trimmed, EXPORT_WIDTH)


def is_signature(trimmed: Column) -> Column:
    hit = SIGNATURES[0].found(trimmed)
    for rx in SIGNATURES[1:]:
        hit = hit | rx.found(trimmed)
    return hit


def signature_line(trimmed: Column) -> Column:
    """The line without its body and without a closing colon."""
    bare = F.regexp_replace(F.regexp_replace(trimmed, BODY.java, "{...}"), TAIL_COLON.java, "")
    return shorten(bare, SIGNATURE_WIDTH)


def structure(trimmed: Column) -> Column:
    """Definitions on one line: a class or function ends the search, other forms may both apply."""
    entry = lambda name, kind: F.struct(name.alias("name"), F.lit(kind).alias("type"))
    cls, fun = CLASS.first(trimmed, 1), FUNCTION.first(trimmed, 1)
    bound, dfn = ASSIGNED.first(trimmed, 1), DEF.first(trimmed, 1)
    callable_text = F.contains(trimmed, F.lit("=>")) | F.contains(trimmed, F.lit("function"))
    other = F.array_compact(F.array(
        F.when((bound != "") & callable_text, entry(bound, "function")),
        F.when(dfn != "", entry(dfn, "function"))))
    return F.when(cls != "", F.array(entry(cls, "class"))).when(fun != "", F.array(entry(fun, "function"))).otherwise(other)


def sections(lines: Column) -> Column:
    """All definitions of a file with 1-based line numbers; only lines that may hold one are trimmed and matched."""
    line = lambda text, i: F.when(contains_any(text, DEFINING_PARTS), F.struct(strip(text).alias("text"), (i + 1).alias("line")))
    at = lambda l: F.transform(structure(l["text"]), lambda s: F.struct(
        s["name"].alias("name"), l["line"].alias("line"), s["type"].alias("type")))
    return F.flatten(F.transform(F.array_compact(F.transform(lines, line)), at))


def imports(lines: Column) -> Column:
    """The trimmed import lines of a file."""
    return F.filter(trim_all(F.filter(lines, lambda l: contains_any(l, IMPORT_PARTS))), is_import)


def names_of(found: Column, kind: str) -> Column:
    return F.transform(F.filter(found, lambda s: s["type"] == kind), lambda s: s["name"])


def trim_all(lines: Column) -> Column:
    return F.transform(lines, strip)


def language(path: Column) -> Column:
    """Language of a path's extension; case-sensitive."""
    table = F.create_map(*[F.lit(x) for pair in dims.LANGUAGE_BY_EXTENSION.items() for x in pair])
    return F.coalesce(F.try_element_at(table, extension(path)), F.lit("unknown"))


def outline_text(path: Column, lang: Column, total: Column, imports: Column, classes: Column,
                 functions: Column) -> Column:
    listed = lambda label, names: F.when(F.size(names) > 0, F.concat(F.lit(label), F.array_join(names, ", ")))
    top = F.concat(F.lit("File: "), path, F.lit(" ("), lang, F.lit(", "), total.cast("string"), F.lit(" lines)"))
    return F.concat_ws("\n", top, listed("Imports: ", imports), listed("Classes: ", classes),
                       listed("Functions: ", functions))


def file_name(path: Column) -> Column:
    return base_name(path)
