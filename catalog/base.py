"""Registry of queries and helpers for the checking SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from weirworks.functions.text import SPACE_CHARS, Rx
from weirworks.views import VIEWS, table, view

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None, views: tuple[str, ...] | list[str] = ()):
    """Register a query; its SQL sees the named views as common table expressions."""
    def add(fn):
        assert name not in QUERIES, name
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = with_views(views, sql)
        return fn
    return add


def on_view(name: str, source: str, op: Callable[[DataFrame], DataFrame], sql: str | None = None, views=()):
    """Register an operator applied to one view or table."""
    read = view if source in VIEWS else table
    needed = ([source] if source in VIEWS else []) + [v for v in views if v != source]
    query(name, sql, needed)(lambda spark, sf_dir: op(read(spark, sf_dir, source)))


def with_views(views, sql: str) -> str:
    """Put the views in front; ``sql`` may start with further ``name AS (...)`` parts after ``WITH``."""
    parts = [f"{v} AS ({VIEWS[v][1]})" for v in views]
    body = sql.strip()
    if body.upper().startswith("WITH "):
        parts, body = parts + [body[5:]], ""
        return "WITH " + ",\n".join(parts)
    return ("WITH " + ",\n".join(parts) + "\n" if parts else "") + body


# --- SQL fragments ---------------------------------------------------------------------

def lit(text: str) -> str:
    """A SQL string; control and special characters go through chr()."""
    out, plain = [], ""
    for c in text:
        if ord(c) < 32 or ord(c) > 126:
            out += [f"'{plain}'"] if plain else []
            out.append(f"chr({ord(c)})")
            plain = ""
        else:
            plain += "''" if c == "'" else c
    out += [f"'{plain}'"] if plain or not out else []
    return out[0] if len(out) == 1 else "(" + " || ".join(out) + ")"


def dbl(x: float) -> str:
    return f"CAST({x!r} AS DOUBLE)"


def found(rx: Rx, text: str) -> str:
    return f"regexp_matches({text}, {lit(rx.ascii)})"


def every(rx: Rx, text: str, group: int = 0) -> str:
    return f"regexp_extract_all({text}, {lit(rx.ascii)}, {group})"


def count(rx: Rx, text: str) -> str:
    return f"len(regexp_extract_all({text}, {lit(rx.ascii)}))"


def first(rx: Rx, text: str, group: int = 0) -> str:
    return f"regexp_extract({text}, {lit(rx.ascii)}, {group})"


def trim(text: str) -> str:
    return f"trim({text}, {lit(SPACE_CHARS)})"


def overhead(tokens: str) -> str:
    return f"(80 + CAST(ceil({tokens} * {dbl(1.3)}) AS BIGINT))"


def recorded(tokens: str = "tokens_used") -> str:
    return f"coalesce(cloud_overhead_tokens, {overhead(tokens)})"


def round2(x: str) -> str:
    return f"(floor(({x}) * {dbl(100.0)} + {dbl(0.5)}) / {dbl(100.0)})"


def gross(tokens: str, rate: str) -> str:
    return f"({tokens} / {dbl(1e6)} * {rate})"


def spent(over: str, rate: str) -> str:
    return f"({over} / {dbl(1e6)} * ({rate} / {dbl(5.0)}))"


def costs(tokens: str, over: str, rate: str, rounded: bool = True) -> str:
    r = round2 if rounded else (lambda x: x)
    return (f"{r(gross(tokens, rate))} AS gross_cost, {r(spent(over, rate))} AS overhead_cost, "
            f"{r(gross(tokens, rate) + ' - ' + spent(over, rate))} AS net_cost")


def fixed(x: str, digits: int) -> str:
    """Decimal text rounded half up on the exact value; printf rounds exact ties to even."""
    if digits == 0:
        return f"printf('%.0f', CASE WHEN {x} * 2 = floor({x} * 2) THEN {x} + {dbl(1e-9)} ELSE {x} END)"
    return f"printf('%.{digits}f', CASE WHEN {x} * 8 = floor({x} * 8) THEN {x} + {dbl(1e-9)} ELSE {x} END)"


def units(text: str) -> str:
    """Length in UTF-16 units: one more for every character outside the basic plane."""
    return f"(length({text}) + len(regexp_extract_all({text}, '[\\x{{10000}}-\\x{{10FFFF}}]')))"


def est_tokens(text: str) -> str:
    return f"CAST(ceil({units(text)} / {dbl(4.0)}) AS BIGINT)"


NONSPACE = Rx("{S}+")


def blended(text: str) -> str:
    w = f"ceil({count(NONSPACE, text)} * {dbl(1.3)})"
    c = f"ceil({units(text)} / {dbl(3.5)})"
    return f"CAST(ceil({w} * {dbl(0.4)} + {c} * {dbl(0.6)}) AS BIGINT)"


def case_of(pairs, default: str) -> str:
    """CASE from (condition, value) SQL pairs."""
    return "CASE " + " ".join(f"WHEN {c} THEN {v}" for c, v in pairs) + f" ELSE {default} END"


def has_any(text: str, words) -> str:
    return "(" + " OR ".join(f"contains({text}, {lit(w)})" for w in words) + ")"
