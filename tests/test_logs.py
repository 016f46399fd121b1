"""Logs on disk: malformed lines, appends, truncation; files on disk."""

import os

from pyspark.sql import functions as F

from weirworks.sources import files as S
from weirworks.sources import logs
from weirworks.operators.corpus import line_counts, path_rollup


def test_malformed_lines(spark, tmp_path):
    lines = ['{"type":"completion","tokens_used":5}', "", "{ broken json !!!", "not json at all", '{"type":"delegation","tokens_used":7} ',
             '{"type":"completion"} trailing', '{"type":"completion"},{"type":"x"}', "   ", '{"type":"completion","tokens_used":"12"}',
             '{"type":"completion","agent":"a}b"}', "{'type':'completion'}"]
    (tmp_path / "log.jsonl").write_text("\n".join(lines))
    rows = logs.read_usage_log(spark, str(tmp_path / "log.jsonl")).collect()
    assert sorted((r.type, r.tokens_used, r.agent) for r in rows if r.tokens_used) == [("completion", 5, None), ("delegation", 7, None)]
    assert len(rows) == 4 and sum(r.tokens_used is None for r in rows) == 2


def test_append_read_truncate(spark, tmp_path):
    path = str(tmp_path / "log")
    df = spark.createDataFrame([(100, "m", 50, "complete", "s1")], "tokens_used bigint, model string, duration_ms bigint, tool string, session_id string")
    logs.append_completions(df, path)
    logs.append_completions(df, path, enabled=False)
    logs.append_delegations(df.withColumns({"quality_status": F.lit("accepted"), "attempt_count": F.lit(1)}), path)
    rows = logs.read_usage_log(spark, path).orderBy("type").collect()
    assert [(r.type, r.cloud_overhead_tokens) for r in rows] == [("completion", 210), ("delegation", None)]
    assert all(r.ts is not None for r in rows)
    assert logs.delegations(logs.read_usage_log(spark, path)).count() == 1
    logs.truncate_log(spark, path)
    assert logs.read_usage_log(spark, path).count() == 0


def test_history(spark, tmp_path):
    path = str(tmp_path / "history")
    resolved = spark.createDataFrame([(1, True), (2, False)], "task_id int, resolved_locally boolean")
    decisions = spark.createDataFrame([(1, "a", 2), (2, "b", 3)], "task_id int, text string, task_complexity int")
    logs.append_history(logs.history_rows(resolved, decisions, F.col("text"), F.lit("code_gen")), path)
    got = sorted((r.task_fingerprint, r.level_used, r.outcome) for r in logs.read_history(spark, path).collect())
    assert got == [("a", 2, "success"), ("b", 3, "escalated")]


def test_file_tree(spark, tmp_path):
    made = {"src/a.ts": "one\ntwo", "src/sub/b.PY": "x", "node_modules/c.ts": "n", "README": "r\n"}
    for name, text in made.items():
        os.makedirs(tmp_path / os.path.dirname(name), exist_ok=True)
        (tmp_path / name).write_text(text)
    listed = S.relative(S.list_files(spark, str(tmp_path)), str(tmp_path))
    assert {r.path: r["size"] for r in listed.collect()} == {k: len(v) for k, v in made.items()}
    assert [r.path for r in S.find_files(listed, "*").collect()] == ["README", "src/a.ts", "src/sub/b.PY"]
    assert [r.path for r in S.find_files(listed, "?.py").collect()] == ["src/sub/b.PY"]
    corpus = S.relative(S.read_small_corpus(spark, str(tmp_path)), str(tmp_path))
    assert {r.ext: r.lines for r in line_counts(corpus).collect()} == {".ts": 2, ".PY": 1, "(no ext)": 2, None: 5}
    nodes = {r.node: (r["size"], r.files) for r in path_rollup(listed).collect()}
    assert nodes["src"] == (8, 2) and nodes["src/sub"] == (1, 1)


def test_hidden_names(spark):
    files = spark.createDataFrame([(p,) for p in ("a/.env", ".gitignore", "a/.git/x", "node_modules/y", "a/b.c", "a/.gitignore")], "path string")
    assert [r.path for r in S.find_files(files, "*").collect()] == [".gitignore", "a/.gitignore", "a/b.c"]
    assert [r.path for r in S.find_files(files, "*", max_depth=0).collect()] == [".gitignore"]
    assert S.find_files(files, "*", cap=2).count() == 2


def test_work_folder_must_be_named(monkeypatch, spark):
    import pytest

    from weirworks.sources import workdir
    monkeypatch.setattr(workdir, "SETTING", "spark.checkpoint.dir.of.nobody")
    with pytest.raises(ValueError, match="executors share"):
        workdir.new_path(spark, "x")


def test_discarded_tables_are_gone(spark):
    from weirworks.sources.workdir import discard, written
    table = written(spark.range(3), "gone")
    assert table.count() == 3
    discard(table)
    assert not os.path.exists(table.written_path.removeprefix("file:").replace("///", "/"))


def test_scratch_tables_go_at_the_end(spark, tmp_path):
    from weirworks.sources.workdir import scratch, written
    with scratch(spark):
        table = written(spark.range(3), "inside")
        table.write.parquet(str(tmp_path / "kept"))
    assert not os.path.exists(table.written_path.removeprefix("file:").replace("///", "/")) and spark.read.parquet(str(tmp_path / "kept")).count() == 3


def test_large_files_are_read_by_line(spark, tmp_path):
    from catalog.corpus import lines_of_small_and_large
    (tmp_path / "a.txt").write_text("one\ntwo\n")
    (tmp_path / "b.txt").write_text("one\n" * 300_000 + "\nlast")
    got = {r.line: (r.n, r.files) for r in lines_of_small_and_large(spark, str(tmp_path)).collect()}
    assert got == {"one": (300_001, 2), "two": (1, 2), "": (1, 2), "last": (1, 2)}
