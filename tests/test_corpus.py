"""Outlines and greedy packing against a plain Python fold."""

import math

import pytest

from weirworks import dims
from weirworks.operators import corpus as O
from weirworks.operators.joins import lookup


def test_structure_of_each_line_form(spark):
    text = "\n".join(["export abstract class A {", "async function f(x) {", "export const g = async (x) => x", "let h = function() {}",
                      "const plain = 3", "  async def run(self):", "class B:", "def go():", "klass = 1"])
    row = O.outline(spark.createDataFrame([("m.py", text)], "path string, content string")).first()
    assert row.classes == ["A", "B"] and row.functions == ["f", "g", "h", "run", "go"]
    assert [(s.name, s.line) for s in row.sections] == [("A", 1), ("f", 2), ("g", 3), ("h", 4), ("run", 6), ("B", 7), ("go", 8)]
    assert row.language == "python" and row.total_lines == 9


def test_signatures_and_exports(spark):
    text = "\n".join(["export function f(a) { return a }", "def g(x):", "func h() {", "pub async fn k(a: u8) {", "public static int m(int x) {",
                      "exports.z = 1", "module.exports = f", "export " + "y" * 200, "x = 1"])
    row = O.previews(spark.createDataFrame([("m.ts", text)], "path string, content string"), n=2).first()
    assert row.signatures == ["export function f(a) {...}", "def g(x)", "func h() {...}", "pub async fn k(a: u8) {...}", "public static int m(int x) {...}"]
    assert row.exports == ["export function f(a) { return a }", "exports.z = 1", "module.exports = f", "export " + "y" * 113 + "..."]
    assert row.head == text.split("\n")[:2]


FILES = {"a/x.ts": 30, "a/y.ts": 4, "a/z.ts": 60, "a/w.ts": 11}


def content(name, n):
    return "\n".join(f"const {name[2]}{i} = () => {i}" if i % 9 == 0 else f"line {i} of {name}" for i in range(n))


def tokens(text):
    return math.ceil(len(text) / 4)


def plain_pack(task, refs, outlines, options):
    left, kept = options.budget - tokens(task), []
    for ref in refs[:options.max_files]:
        if left <= 0:
            break
        if ref in outlines and tokens(outlines[ref]) <= left:
            kept.append(ref)
            left -= tokens(outlines[ref])
    slices = {}
    for ref in kept:
        if left <= options.slice_floor:
            break
        lines = content(ref, FILES[ref]).split("\n")
        part = "\n".join(lines[:options.max_lines])
        if tokens(part) <= left:
            slices[ref] = (min(options.max_lines, len(lines)), part)
            left -= tokens(part)
    return kept, slices, options.budget - left


def plain_expand(kept, slices, total, options):
    left, out = options.retry_budget - total, dict(slices)
    for ref in kept:
        if left <= options.slice_floor:
            break
        lines = content(ref, FILES[ref]).split("\n")
        until = min(2 * options.max_lines, len(lines))
        if ref in slices:
            end, part = slices[ref]
            more = "\n".join(lines[end:until])
            if tokens(more) <= left:
                out[ref] = (until, part + "\n" + more)
                left -= tokens(more)
        else:
            part = "\n".join(lines[:2 * options.max_lines])
            if tokens(part) <= left:
                out[ref] = (until, part)
                left -= tokens(part)
    return out, options.retry_budget - left


@pytest.mark.parametrize("budget", [40, 90, 160, 230, 300, 420, 900])
def test_pack_and_expand(spark, budget):
    options = dims.ContextOptions(budget=budget, retry_budget=budget + 260, max_lines=12)
    files = spark.createDataFrame([(k, content(k, n)) for k, n in FILES.items()], "path string, content string")
    texts = {0: "fix a/x.ts and a/y.ts then a/z.ts and a/w.ts", 1: "see a/z.ts, a/none.ts and ./a/w.ts", 2: "no file here", 3: "only `a/y.ts`"}
    refs = {0: ["a/x.ts", "a/y.ts", "a/z.ts"], 1: ["a/z.ts", "a/none.ts", "a/w.ts"], 2: [], 3: ["a/y.ts"]}
    tasks = spark.createDataFrame(list(texts.items()), "task_id int, text string")
    outlines = {}
    for r in O.outline(files).collect():
        parts = [f"File: {r.path} ({r.language}, {r.total_lines} lines)"]
        parts += [f"{label}: {', '.join(names)}" for label, names in (("Imports", r.imports), ("Classes", r.classes), ("Functions", r.functions)) if names]
        outlines[r.path] = "\n".join(parts)
    packed = O.pack_context(tasks, files, options).cache()
    wider = {r.task_id: r for r in O.expand_context(packed, options).collect()}
    for r in packed.collect():
        kept, slices, total = plain_pack(texts[r.task_id], refs[r.task_id], outlines, options)
        assert [o.path for o in r.outlines] == kept and r.total_tokens == total and r.files_included == len(kept)
        assert {s.path: (s.end_line, s.content) for s in r.slices} == slices
        more, total = plain_expand(kept, slices, total, options)
        assert {s.path: (s.end_line, s.content) for s in wider[r.task_id].slices} == more
        assert wider[r.task_id].total_tokens == total


def test_lookup_keeps_rows_without_a_key(spark):
    left = spark.range(2000).selectExpr("id", "CASE WHEN id % 3 = 0 THEN 'hot' WHEN id % 7 = 0 THEN NULL ELSE 'k' || id % 50 END AS k")
    right = spark.createDataFrame([("hot", 1), ("k1", 2), ("k2", 3), ("unused", 4)], "k string, v int")
    want = sorted(map(tuple, left.join(right, "k", "left").select("id", "k", "v").collect()), key=str)
    got = sorted(map(tuple, lookup(left, right, "k", "id").select("id", "k", "v").collect()), key=str)
    assert got == want


def test_bare_paths_equal_the_plain_pattern(spark):
    import random
    import re

    from pyspark.sql import functions as F

    from weirworks.functions.text import BARE_PATH
    rx = re.compile(BARE_PATH.ascii, re.A)
    rng = random.Random(3)
    texts = ["".join(rng.choice("aab1///..-é ") for _ in range(rng.randint(0, 60))) for _ in range(4000)]
    texts += ["a/b.tsxabcdef/g.h", "a./b.c", "x/" * 30000 + "y.ts", "w" * 60000 + "/z.py", "./../a/b.c"]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    got = {r.i: r.p for r in df.select("i", BARE_PATH.all(F.col("t")).alias("p")).collect()}
    want = {i: rx.findall(t) for i, t in enumerate(texts)}
    assert sum(map(len, want.values())) > 1000
    assert got == want


def test_quick_classes_hold_the_same_characters(spark):
    from pyspark.sql import functions as F

    from weirworks.functions.text import QUICK
    chars = spark.range(1, 0x110000).where("id NOT BETWEEN 55296 AND 57343").select(
        F.decode(F.unhex(F.lpad(F.hex("id"), 8, "0")), "UTF-32").alias("c"))
    for plain, quick in QUICK.items():
        both = chars.groupBy(F.rlike("c", F.lit(f"^{plain}$")).alias("a"), F.rlike("c", F.lit(f"^{quick}$")).alias("b")).count().collect()
        assert {(r.a, r.b) for r in both} == {(True, True), (False, False)}


def test_lines_that_only_look_like_definitions(spark):
    lines = ["  def a():", "　import os", "class", "declass X", " class Y", "let f = 1", "let g = () => 2", "x => y", "\tconst q = require('q')",
             "definition of a thing", "async def h():", "  use strict", "useless", "var k = function() {}", "", "plain"]
    text = "\n".join(lines)
    row = O.outline(spark.createDataFrame([("m.py", text)], "path string, content string")).first()
    assert [(s.name, s.line, s.type) for s in row.sections] == [("a", 1, "function"), ("Y", 5, "class"), ("g", 7, "function"), ("h", 11, "function"), ("k", 14, "function")]
    assert row.imports == ["import os", "const q = require('q')", "use strict"]


def test_a_path_that_very_many_tasks_name_is_spread(spark, monkeypatch):
    files = spark.createDataFrame([(k, content(k, n)) for k, n in FILES.items()], "path string, content string")
    tasks = spark.range(500).selectExpr("id AS task_id", "'see a/x.ts and a/none.ts then a/' || element_at(array('y', 'z', 'w'), CAST(id % 3 + 1 AS INT)) || '.ts' AS text")
    options = dims.ContextOptions(budget=230, retry_budget=490, max_lines=12)
    want = O.expand_context(O.pack_context(tasks, files, options), options).orderBy("task_id").collect()
    monkeypatch.setattr(O, "TASKS_OF_COPY", 7)
    packed = O.pack_context(tasks, files, options)
    assert O.expand_context(packed, options).orderBy("task_id").collect() == want
    # references to one path meet its copies, and tasks are read from the work folder, not made again
    plan = packed._jdf.queryExecution().optimizedPlan().toString()
    assert "_copy#" in plan and "Range" not in plan


def test_files_are_dealt_out_before_the_work_on_them(spark, sf_dir, tmp_path):
    from weirworks.views import table, view
    table(spark, sf_dir, "part").coalesce(1).write.parquet(f"{tmp_path}/part.parquet")        # one row group: one task
    files = view(spark, str(tmp_path), "code_files")
    assert files.rdd.getNumPartitions() > 1
    assert sum(1 for n in files.rdd.mapPartitions(lambda rows: [sum(1 for _ in rows)]).collect() if n) > 1
