"""Table functions for Spark SQL users."""

from __future__ import annotations

from pyspark.sql import SparkSession

from . import outline as O
from .text import SPACE_CHARS


def register(spark: SparkSession) -> None:
    """Create ``outline_sections(content)``: the classes and functions of a file as rows.

    It is a SQL function, so a lateral use of it plans as a generator inside the scan's stage.
    """
    spaces = "".join(f"\\u{ord(c):04x}" for c in SPACE_CHARS)
    # most lines hold none of these parts; the others are trimmed once
    worth = " OR ".join(f"contains(l, '{part}')" for part in O.DEFINING_PARTS)
    name = lambda rx: f"regexp_extract(c.l, r'{rx.java}', 1)"
    entry = lambda value, kind: f"named_struct('name', {value}, 'line', c.line, 'type', '{kind}')"
    bound, dfn = name(O.ASSIGNED), name(O.DEF)
    found = f"""CASE WHEN {name(O.CLASS)} <> '' THEN array({entry(name(O.CLASS), 'class')})
      WHEN {name(O.FUNCTION)} <> '' THEN array({entry(name(O.FUNCTION), 'function')})
      ELSE array_compact(array(
        CASE WHEN (contains(c.l, '=>') OR contains(c.l, 'function')) AND {bound} <> '' THEN {entry(bound, 'function')} END,
        CASE WHEN {dfn} <> '' THEN {entry(dfn, 'function')} END)) END"""
    spark.sql(f"""CREATE OR REPLACE TEMPORARY FUNCTION outline_sections(content STRING)
      RETURNS TABLE(name STRING, line INT, type STRING)
      RETURN SELECT d.name, d.line, d.type FROM LATERAL (
        SELECT inline(flatten(transform(array_compact(transform(split(content, '\\n'), (l, i) ->
          CASE WHEN {worth} THEN named_struct('l', trim(BOTH '{spaces}' FROM l), 'line', i + 1) END)), c -> {found})))) d""")
