"""List, find and read files of a tree.

Spark's file sources leave out names that begin with a dot or an underscore; trees in which those matter are
to be read from a table of (path, content) instead, which every operator here accepts.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import base_name, fmt_size, glob_to_regex
from ..operators.corpus import SMALL_FILE, visible


def _tree(spark: SparkSession, root: str) -> DataFrame:
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)


def list_files(spark: SparkSession, root: str) -> DataFrame:
    """Name, path, size and time of each file; contents are never read."""
    return _tree(spark, root).select(
        base_name(F.col("path")).alias("name"), "path", F.lit("file").alias("type"), F.col("length").alias("size"),
        fmt_size(F.col("length")).alias("size_text"), F.col("modificationTime").alias("modified"))


def find_files(files: DataFrame, glob: str = "*", max_depth: int | None = None, cap: int | None = None) -> DataFrame:
    """Paths whose base name fits a glob, in path order, hidden and dependency folders left out.

    All of them unless the caller sets a depth or, for a report of the first paths, a cap.
    """
    hit = F.rlike(base_name(F.col("path")), F.lit(glob_to_regex(glob))) & visible(F.col("path"), skip=("node_modules",))
    if max_depth is not None:
        hit = hit & (F.size(F.split("path", "/")) - 1 <= max_depth)
    found = files.where(hit).select("path").orderBy("path")
    return found if cap is None else found.limit(cap)


def relative(files: DataFrame, root: str) -> DataFrame:
    """Paths relative to a root, so that rules on path parts see only what lies below it."""
    at = F.instr("path", F.lit(root.rstrip("/") + "/"))
    start = at + len(root.rstrip("/")) + 1
    return files.withColumn("path", F.when(at > 0, F.substr("path", start)).otherwise(F.col("path")))


def read_corpus(spark: SparkSession, root: str, max_bytes: int | None = None) -> DataFrame:
    """Whole files as text; with ``max_bytes``, larger ones are dropped by length before they are opened."""
    tree = _tree(spark, root)
    return (tree if max_bytes is None else tree.where(F.col("length") <= max_bytes)).select(
        "path", F.col("length").alias("size"), F.col("modificationTime").alias("modified"),
        F.make_valid_utf8(F.col("content").cast("string")).alias("content"))


def read_small_corpus(spark: SparkSession, root: str) -> DataFrame:
    """Whole files below 1 MB; ``read_large_lines`` gives the lines of all others."""
    return read_corpus(spark, root, SMALL_FILE - 1)


def read_large_lines(spark: SparkSession, root: str) -> DataFrame:
    """Path and line of every file of 1 MB and more: what ``read_small_corpus`` leaves out, read in splits of a file.

    The empty piece after a file's last line break is no line.
    """
    lines = spark.read.option("recursiveFileLookup", "true").text(root, lineSep="\n")
    return lines.where(F.col("_metadata.file_size") >= SMALL_FILE).select(
        F.col("_metadata.file_path").alias("path"), F.make_valid_utf8("value").alias("line"))
