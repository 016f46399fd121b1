"""The corpus pipeline: stages that each apply one operator of ``weirworks.llm`` to all documents the last one kept.

A stage is a function of (spark, docs, sf_dir); its result is written as Parquet and read again as the next one's docs.
All but the last return the columns of documents. A stage keeps what its decision does not reject: rows with a null or
empty text are never dropped; repeated rows and rows with a null doc_id are documents like others, so that of rows with
the same text of at least five words one is left; decontamination, which drops by doc_id, keeps rows with a null one.
Extra columns are left out of what the stages return.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weirworks.llm import jaccard, packing, surrogates, tiling, toxicity
from weirworks.llm.sampling import fold
from weirworks.sources.workdir import new_path, remove_folder, scratch, written

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score below their language's threshold, by a classifier fitted on labels outside the held fold."""
    docs = docs.select(*COLUMNS)
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    model = toxicity.train(docs, labels.where(fold(F.col("doc_id"), 5) != 0))
    return toxicity.with_rejection(docs, model).where("NOT toxicity_rejected").select(*COLUMNS)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group that links of similarity 0.8 on five-word shingles connect, the row with the smallest id, nulls last;
    of several such rows the first one stored."""
    # stored with its keys, so that a row has the same one in every pass
    rows = written(docs.select(*COLUMNS).withColumn("row", F.monotonically_increasing_id()), "rows")
    groups = jaccard.jaccard_components(rows.select(F.col("row").alias("doc_id"), "text"), width=5, percent=80)
    groups = groups.select(F.col("doc_id").alias("row"), F.col("component_id").alias("component"))
    groups = written(groups.join(rows.select("row", "doc_id"), "row"), "groups")
    order = F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "row")
    keep = groups.groupBy("component").agg(F.min(order)["row"].alias("row")).select("row")
    copies = groups.select("row").join(keep, "row", "left_anti")
    return rows.join(copies, "row", "left_anti").select(*COLUMNS)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a benchmark item of which tiles cover half of the words."""
    docs = docs.select(*COLUMNS)
    found = tiling.contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return docs.join(found.select("doc_id").distinct(), "doc_id", "left_anti").select(*COLUMNS)


def replace_private(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, personal data replaced by surrogates; n_chars counts the new text."""
    out = surrogates.replace_entities(docs.select(*COLUMNS))
    return out.withColumn("n_chars", F.when(F.col("text").isNull(), F.col("n_chars")).otherwise(F.length("text")).cast("long")).select(*COLUMNS)


def pack_windows(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents in windows of 2048 tokens."""
    return packing.pack(docs.select(*COLUMNS))


STAGES = [("toxicity", drop_toxic), ("near_copies", drop_near_copies), ("decontamination", drop_contaminated),
          ("private_data", replace_private), ("packing", pack_windows)]
ORACLE_SQL = None      # a trained classifier, tilings and a tokenizer are not SQL; tests hold the stages against brute force


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each one's intermediate tables, and the result before, go once its own is written."""
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, stage in STAGES:
        path = new_path(spark, f"pipeline-{name}")
        with scratch(spark):
            stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
        if before:
            remove_folder(spark, before)
        before = path
    return docs
