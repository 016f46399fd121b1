"""Outline files and pack them into token-budgeted context."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import dims
from ..functions import outline as O
from ..functions import text as X
from ..sources.workdir import written

SMALL_FILE = 1_000_000
TASKS_OF_COPY = 50_000     # references that meet one copy of a file's outline


def file_lines(files: DataFrame, content: str = "content") -> DataFrame:
    """One row per line, numbered from 1."""
    return files.select("path", F.posexplode(O.lines_of(F.col(content))).alias("_i", "line")).select(
        "path", (F.col("_i") + 1).alias("line_no"), "line")


def outline(files: DataFrame, content: str = "content") -> DataFrame:
    """Language, line count, classes, functions, sections and imports per file.

    Works on the split array of each row, so files are never exploded or shuffled.
    """
    keep = [c for c in files.columns if c != content]
    raw = files.withColumn("_lines", O.lines_of(F.col(content))).withColumn("sections", O.sections(F.col("_lines")))
    return raw.select(
        *keep, content, O.language(F.col("path")).alias("language"), F.size("_lines").alias("total_lines"),
        O.names_of(F.col("sections"), "class").alias("classes"),
        O.names_of(F.col("sections"), "function").alias("functions"), "sections",
        O.imports(F.col("_lines")).alias("imports"))


def section_rows(files: DataFrame, content: str = "content") -> DataFrame:
    """One row per class or function of a file: the outline as a table."""
    return outline(files, content).select("path", F.inline("sections"))


def previews(files: DataFrame, content: str = "content", n: int = 10) -> DataFrame:
    """First lines, exports and signatures per file."""
    trimmed = files.withColumn("_trimmed", O.trim_all(O.lines_of(F.col(content))))
    return trimmed.select(
        *[c for c in files.columns if c != content],
        O.head(F.col(content), n).alias("head"), F.size("_trimmed").alias("total_lines"),
        F.transform(F.filter("_trimmed", O.is_export), O.export_line).alias("exports"),
        F.transform(F.filter("_trimmed", O.is_signature), O.signature_line).alias("signatures"))


def slice_text(lines: Column, start: int, stop: int) -> Column:
    """Lines [start, stop) as text."""
    return F.array_join(F.slice(lines, start + 1, stop - start), "\n")


def slice_file(files: DataFrame, start: int, n: int, content: str = "content") -> DataFrame:
    """Lines from ``start`` (0-based), at most ``n``, with their end and token count."""
    cut = files.withColumn("_lines", O.lines_of(F.col(content)))
    cut = cut.withColumns({"start_line": F.lit(start), "end_line": F.least(F.lit(start + n), F.size("_lines")),
                           "slice": slice_text(F.col("_lines"), start, start + n)})
    return cut.withColumn("tokens", X.estimate_tokens(F.col("slice"))).drop("_lines", content)


def _named(tasks: DataFrame, text: str, max_files: int | None) -> Column:
    """The distinct references of a task as written; ``max_files`` keeps the first ones."""
    refs = X.file_refs(F.col(text))
    if "file_refs" in tasks.columns:
        refs = F.coalesce("file_refs", refs)
    return refs if max_files is None else F.slice(refs, 1, max_files)


def _clean(ref: Column) -> Column:
    """A reference without leading ``./``; few have it."""
    return F.when(F.startswith(ref, F.lit("./")), F.regexp_replace(ref, r"^(?:\./)+", "")).otherwise(ref)


def task_refs(tasks: DataFrame, key: str = "task_id", text: str = "text", max_files: int | None = None) -> DataFrame:
    """The distinct file references of each task, with their position; ``max_files`` keeps the first ones.

    A column ``file_refs`` of paths, where the tasks have one, takes the place of what the text names.
    """
    refs = tasks.select(key, F.posexplode(_named(tasks, text, max_files)).alias("pos", "ref"))
    return refs.select(key, "pos", _clean(F.col("ref")).alias("path"))


def known_files(tasks: DataFrame, files: DataFrame, key: str = "task_id", text: str = "text") -> DataFrame:
    """Task to file pairs for references that exist; the skew join splits a file that many tasks name."""
    return task_refs(tasks, key, text).join(files.select("path", "file_id"), "path")


def pack_context(tasks: DataFrame, files: DataFrame, options: dims.ContextOptions = dims.ContextOptions(),
                 key: str = "task_id", text: str = "text") -> DataFrame:
    """Greedy context per task (``key`` is unique): outlines that fit, then slices that fit, skipping what does not.

    Only files that some task names are outlined, once each. The budget is filled from token counts alone; the text of
    an outline or a slice meets a task only where it was kept. A task gathers at most ``max_files`` files (None: all).
    The tasks with their references, the outlines and what each task keeps are stored once in the work folder, as each
    is used twice. References to one path meet its outline in one copy for each ``TASKS_OF_COPY`` of them, so a path that
    very many tasks name, known or not, is spread; the broadcast list of such paths has at most one row for that many.
    """
    n = options.max_lines
    left = F.lit(options.budget) - X.estimate_tokens(F.col(text))
    named = written(tasks.withColumns({"_refs": _named(tasks, text, options.max_files), "_left": left}), "tasks")
    refs = named.select(key, "_left", F.posexplode("_refs").alias("pos", "_ref")).select(
        key, "_left", "pos", _clean(F.col("_ref")).alias("path"))
    uses = refs.groupBy("path").agg(F.ceil(F.count(F.lit(1)) / F.lit(TASKS_OF_COPY)).cast("int").alias("_copies"))
    uses = written(uses, "uses")
    copy = F.pmod(F.xxhash64(key), F.coalesce("_copies", F.lit(1))).cast("int")
    refs = refs.join(F.broadcast(uses.where("_copies > 1")), "path", "left").withColumn("_copy", copy).drop("_copies")
    cut = outline(files.join(uses, "path")).withColumn("_lines", O.lines_of(F.col("content")))
    cut = cut.withColumns({
        "outline": O.outline_text(F.col("path"), F.col("language"), F.col("total_lines"), F.col("imports"),
                                  F.col("classes"), F.col("functions")),
        "first": slice_text(F.col("_lines"), 0, n), "rest": slice_text(F.col("_lines"), n, 2 * n),
    })
    texts = cut.select("path", "_copies", "language", "total_lines", "classes", "functions", "outline", "first", "rest",
                       X.estimate_tokens(F.col("outline")).alias("outline_tokens"),
                       X.estimate_tokens(F.col("first")).alias("first_tokens"))
    copies = written(texts, "outlines").withColumn("_copy", F.explode(F.sequence(F.lit(0), F.col("_copies") - 1)))
    costs = copies.select("path", "_copy", "outline_tokens", "first_tokens")
    sizes = refs.join(costs, ["path", "_copy"]).groupBy(key).agg(
        F.max("_left").alias("_left"),
        F.array_sort(F.collect_list(F.struct("pos", "path", "_copy", "outline_tokens", "first_tokens"))).alias("_items"))
    sizes = sizes.withColumn("_o", _fit(F.col("_items"), F.col("_left"), "outline_tokens", F.lit(0)))
    sizes = sizes.withColumn("_kept", F.filter("_items", lambda f: F.array_contains(F.col("_o.kept"), f["pos"])))
    sizes = sizes.withColumn("_s", _fit(F.col("_kept"), F.col("_o.left"), "first_tokens", F.lit(options.slice_floor)))
    sizes = written(sizes.select(key, "_kept", "_s"), "kept-files")
    wanted = sizes.select(key, "_s", F.explode("_kept").alias("_f")).select(
        key, "_f.pos", "_f.path", "_f._copy", F.col("_s.left").alias("_after"),
        F.array_contains("_s.kept", F.col("_f.pos")).alias("_cut"))
    item = F.struct("pos", "path", "language", "total_lines", "classes", "functions", "outline", "outline_tokens",
                    "first", "first_tokens", "rest")
    kept = wanted.join(copies, ["path", "_copy"]).groupBy(key).agg(
        F.max("_after").alias("_after"), F.array_sort(F.collect_list(item)).alias("outlines"),
        F.collect_list(F.when(F.col("_cut"), F.col("pos"))).alias("_sliced"))
    out = named.join(kept, key, "left").withColumn("outlines", F.coalesce("outlines", F.array()))
    sliced = F.filter("outlines", lambda f: F.array_contains(F.col("_sliced"), f["pos"]))
    return out.withColumns({
        "slices": F.transform(sliced, lambda f: F.struct(
            f["pos"].alias("pos"), f["path"].alias("path"), F.lit(0).alias("start_line"),
            F.least(F.lit(n), f["total_lines"]).alias("end_line"), f["first"].alias("content"),
            f["first_tokens"].alias("tokens"))),
        "total_tokens": F.lit(options.budget) - F.coalesce("_after", "_left"), "budget": F.lit(options.budget),
        "files_included": F.size("outlines"),
    }).drop("_refs", "_left", "_after", "_sliced")


def _fit(items: Column, left: Column, cost: str, floor: Column) -> Column:
    """Fold over ordered items: keep what fits the budget left, stop once the budget is at the floor."""
    start = F.struct(left.cast("bigint").alias("left"), F.array().cast("array<int>").alias("kept"))

    def step(state, item):
        fits = (state["left"] > floor) & (item[cost] <= state["left"])
        return F.struct(F.when(fits, state["left"] - item[cost]).otherwise(state["left"]).alias("left"),
                        F.when(fits, F.array_append(state["kept"], item["pos"])).otherwise(state["kept"]).alias("kept"))

    return F.aggregate(items, start, step)


def expand_context(packed: DataFrame, options: dims.ContextOptions = dims.ContextOptions()) -> DataFrame:
    """Grow each slice toward twice the line cap, or add a slice for outlined files that have none."""
    n, budget = options.max_lines, options.retry_budget
    wide = lambda f: F.when(f["total_lines"] > n, F.concat(f["first"], F.lit("\n"), f["rest"])).otherwise(f["first"])
    # each step is bound to a lambda's variable, so that it runs once for each file
    told = F.transform("outlines", lambda f: F.struct(f.alias("f"), F.exists("slices", lambda s: s["pos"] == f["pos"]).alias("had")))
    grown = F.transform(told, lambda x: F.struct(
        x["f"]["pos"].alias("pos"), x["f"]["path"].alias("path"), x["had"].alias("had"),
        F.least(F.lit(2 * n), x["f"]["total_lines"]).alias("end_line"),
        F.when(x["had"], x["f"]["rest"]).otherwise(wide(x["f"])).alias("more")))
    out = packed.withColumn("_more", F.transform(grown, lambda f: f.withField("more_tokens", X.estimate_tokens(f["more"]))))
    out = out.withColumn("_fit", _fit(F.col("_more"), F.lit(budget) - F.col("total_tokens"), "more_tokens",
                                      F.lit(options.slice_floor)))
    out = out.withColumn("_more", F.filter("_more", lambda f: F.array_contains(F.col("_fit.kept"), f["pos"])))
    row = lambda s, end, content, tokens: F.struct(
        s["pos"].alias("pos"), s["path"].alias("path"), F.lit(0).alias("start_line"), end.alias("end_line"),
        content.alias("content"), tokens.alias("tokens"))
    paired = F.transform("slices", lambda s: F.struct(
        s.alias("s"), F.try_element_at(F.filter("_more", lambda f: f["pos"] == s["pos"]), F.lit(1)).alias("x")))
    # a file that was read in full still gains the joining line break
    longer = F.transform(paired, lambda p: F.when(p["x"].isNotNull(), row(
        p["s"], p["x"]["end_line"], F.concat(p["s"]["content"], F.lit("\n"), p["x"]["more"]),
        p["s"]["tokens"] + p["x"]["more_tokens"])).otherwise(p["s"]))
    added = F.transform(F.filter("_more", lambda f: ~f["had"]), lambda f: row(f, f["end_line"], f["more"], f["more_tokens"]))
    return out.withColumns({"slices": F.concat(longer, added), "total_tokens": F.lit(budget) - F.col("_fit.left"),
                            "budget": F.lit(budget)}).drop("_more", "_fit")


def render_prompt(packed: DataFrame, text: str = "text") -> DataFrame:
    """The prompt with outlines and snippets, as one text."""
    snippet = lambda s: F.concat(F.lit("\n// "), X.base_name(s["path"]), F.lit(" (lines "),
                                 (s["start_line"] + 1).cast("string"), F.lit("-"), s["end_line"].cast("string"),
                                 F.lit(")\n"), s["content"])
    part = lambda items, title, each: F.when(F.size(items) > 0, F.concat(
        F.lit(f"\n--- {title} ---\n"), F.array_join(F.transform(items, each), "\n")))
    return packed.withColumn("prompt", F.concat_ws(
        "\n", F.concat(F.lit(dims.TASK), F.col(text)), part("outlines", dims.FILE_CONTEXT, lambda f: f["outline"]),
        part("slices", dims.CODE_SNIPPETS, snippet)))


def task_prompt(kind: Column, language: Column, description: Column, context: Column, path: Column) -> Column:
    """Prompt of a code task, or of one of the file analysis tasks."""
    code = F.concat(F.lit(dims.GENERATE), language, F.lit(dims.CODE_OF), description,
                    F.when(F.coalesce(context, F.lit("")) != "",
                           F.concat(F.lit(dims.SURROUNDING), context)).otherwise(""))
    table = F.create_map(*[F.lit(x) for pair in dims.ANALYSIS_PROMPTS.items() for x in pair])
    return F.when(kind == "code", code).otherwise(F.concat(F.try_element_at(table, kind), F.lit(dims.FILE_NAMED), path))


# --- counts over a tree of files ----------------------------------------------------------

def visible(path: Column, allow_gitignore: bool = True, skip: tuple[str, ...] = ()) -> Column:
    """No path part is hidden, and none is in the skip list."""
    parts = F.split(path, "/")
    shown = lambda p: F.when(p == ".gitignore", F.lit(allow_gitignore)).otherwise(~F.startswith(p, F.lit(".")))
    return F.forall(parts, lambda p: shown(p) & ~p.isin("", *skip) if skip else shown(p))


def line_counts(files: DataFrame, content: str = "content", max_depth: int | None = None, max_bytes: int | None = None) -> DataFrame:
    """Lines per extension and in total (extension null), over visible files; all sizes and depths unless limited."""
    small = files.where(visible(F.col("path"), allow_gitignore=False, skip=("node_modules",)))
    if max_bytes is not None:
        small = small.where(F.octet_length(content) < max_bytes)
    if max_depth is not None:
        small = small.where(F.size(F.split("path", "/")) <= max_depth + 1)
    ext = F.coalesce(F.nullif(X.extension(F.col("path")), F.lit("")), F.lit("(no ext)"))
    counted = small.select(ext.alias("ext"), (F.length(content) - F.length(F.replace(content, F.lit("\n"), F.lit(""))) + 1)
                           .alias("lines"))
    return counted.rollup("ext").agg(F.sum("lines").alias("lines"))


def path_rollup(files: DataFrame, max_depth: int | None = None, max_children: int | None = None, size: str = "size") -> DataFrame:
    """Size and file count of every directory and file.

    ``max_depth`` keeps the upper levels. ``max_children`` keeps the first children of a node, in name order, and
    cuts what lies below the others; it needs ``max_depth``.
    """
    parts = F.split("path", "/")
    node = files.where(visible(F.col("path"))).select(F.col(size).alias("_size"), parts.alias("_p"), F.size(parts).alias("_d"))
    deepest = F.col("_d") if max_depth is None else F.least(F.col("_d"), F.lit(max_depth))
    node = node.withColumn("depth", F.explode(F.sequence(F.lit(1), deepest)))
    totals = node.select(
        F.array_join(F.slice("_p", F.lit(1), F.col("depth")), "/").alias("node"), "depth",
        F.array_join(F.slice("_p", F.lit(1), F.col("depth") - 1), "/").alias("parent"),
        (F.col("depth") == F.col("_d")).alias("is_file"), "_size",
    ).groupBy("depth", "parent", "node").agg(
        F.max("is_file").alias("is_file"), F.sum("_size").alias("size"), F.count(F.lit(1)).alias("files"))
    if max_children is None:
        return totals
    rank = F.row_number().over(Window.partitionBy("depth", "parent").orderBy("node"))
    ranked = totals.withColumn("_r", rank).where(F.col("_r") <= max_children).drop("_r")
    kept = out = ranked.where("depth = 1")
    for depth in range(2, max_depth + 1):
        above = kept.where(~F.col("is_file")).select(F.col("node").alias("parent"))
        kept = ranked.where(F.col("depth") == depth).join(above, "parent", "left_semi")
        out = out.unionByName(kept)
    return out


def first_per_group(df: DataFrame, group: list[str], order: list[Column], k: int) -> DataFrame:
    """First k rows per group; Spark trims each partition to k rows per group before the shuffle."""
    rank = F.row_number().over(Window.partitionBy(*group).orderBy(*order))
    return df.withColumn("_rank", rank).where(F.col("_rank") <= k).drop("_rank")
