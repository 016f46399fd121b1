"""The learner's counts as a maintained table: each batch of changes moves them, and nothing is counted again.

A change adds a history record or takes one back. What is known of a record is a row of flags that merges in any order: it
counts while it was added and not taken back, however often and in whatever order either is said. A batch reads what was
known of its own records only, finds which of them begin or cease to count, and adds these differences to the counts.

The table is a folder. ``records/version=N`` holds what batch N learned about records, in ``BUCKETS`` buckets by record, so
that a batch opens only the buckets it touches; every ``COMPACT`` versions they are merged into one. ``cells/version=N``
holds the counts after batch N. A batch that runs again overwrites its own version, and reads those before it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .. import dims
from ..operators.learning import advise
from ..sources.workdir import remove_folder

BUCKETS = 64
COMPACT = 8
TOUCHED = 32           # up to so many buckets are named in the filter that skips the others
KEPT_CELLS = 2
CELL = ["task_type", "level_used"]
ROW = "record string, task_type string, level_used int, outcome string, added boolean, taken boolean, bucket int, version long"
COUNTS = "task_type string, level_used int, n long, successes long, version long"


def _merged(rows: DataFrame) -> DataFrame:
    """One row per record: the flags of all, and of several additions the smallest."""
    said = F.struct("task_type", "level_used", "outcome")
    out = rows.groupBy("record", "bucket").agg(F.min(F.when(F.col("added"), said)).alias("said"), F.bool_or("added").alias("added"), F.bool_or("taken").alias("taken"))
    return out.select("record", "said.*", "added", "taken", "bucket")


def as_changes(changes: DataFrame) -> DataFrame:
    """(record, task_type, level_used, outcome, op) to rows of flags; ``op`` is ``add`` or ``retract``, others are left out."""
    rows = changes.where(F.col("record").isNotNull() & F.col("op").isin("add", "retract"))
    add = F.col("op") == "add"
    bucket = F.pmod(F.xxhash64("record"), F.lit(BUCKETS)).cast("int")
    return _merged(rows.select(F.col("record").cast("string").alias("record"), "task_type", F.col("level_used").cast("int").alias("level_used"), "outcome",
                               add.alias("added"), (~add).alias("taken"), bucket.alias("bucket")))


def _read(spark: SparkSession, path: str, shape: str, before: int) -> DataFrame | None:
    """The versions before a number, if there are any."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not target.getFileSystem(spark._jsc.hadoopConfiguration()).exists(target):
        return None
    return spark.read.schema(shape).parquet(path).where(F.col("version") < before)


def differences(fresh: DataFrame, known: DataFrame | None) -> DataFrame:
    """(task_type, level_used, n, successes): how a batch's flags change the counts, given what was known of its records."""
    both = fresh.withColumn("new", F.lit(True))
    if known is not None:
        both = both.unionByName(known.withColumn("new", F.lit(False)))
    said = F.struct("task_type", "level_used", "outcome")

    def at(part):
        added = F.coalesce(F.bool_or(F.when(part, F.col("added"))), F.lit(False))
        taken = F.coalesce(F.bool_or(F.when(part, F.col("taken"))), F.lit(False))
        return F.struct(F.min(F.when(part & F.col("added"), said)).alias("said"), (added & ~taken).alias("live"))

    turned = both.groupBy("record").agg(at(~F.col("new")).alias("old"), at(F.lit(True)).alias("now"))
    one = lambda side, sign: F.when(F.col(f"{side}.live"), F.struct(f"{side}.said", F.lit(sign).alias("sign")))
    parts = turned.where("NOT (old.live <=> now.live) OR NOT (old.said <=> now.said)").select(F.explode(F.array(one("old", -1), one("now", 1))).alias("d")).where("d IS NOT NULL")
    return parts.groupBy(F.col("d.said.task_type").alias("task_type"), F.col("d.said.level_used").alias("level_used")).agg(
        F.sum("d.sign").cast("long").alias("n"), F.sum(F.when(F.col("d.said.outcome") == "success", F.col("d.sign")).otherwise(0)).cast("long").alias("successes"))


def apply_batch(spark: SparkSession, changes: DataFrame, path: str, number: int) -> None:
    """Take one batch of changes into the table as version ``number``."""
    records, cells = f"{path}/records", f"{path}/cells"
    as_changes(changes).repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{records}/version={number}")
    written = spark.read.schema(ROW).parquet(records).where(F.col("version") == number).drop("version")
    known = _read(spark, records, ROW, number)
    if known is not None:
        touched = [r[0] for r in written.select("bucket").distinct().collect()]
        known = known.drop("version")
        if len(touched) <= TOUCHED:
            known = known.where(F.col("bucket").isin(touched))
        known = known.join(written.select("record"), "record", "left_semi").select(written.columns)
    moved = differences(written, known)
    last = _read(spark, cells, COUNTS, number)
    if last is not None:
        last = last.where(F.col("version") == number - 1).drop("version")
        moved = last.unionByName(moved).groupBy(*CELL).agg(F.sum("n").alias("n"), F.sum("successes").alias("successes"))
    # few rows by construction: one for each task type and level, also where nothing is left
    moved.coalesce(1).write.mode("overwrite").parquet(f"{cells}/version={number}")
    if number >= KEPT_CELLS:
        remove_folder(spark, f"{cells}/version={number - KEPT_CELLS}")
    if number % COMPACT == 0 and number:
        compact(spark, path, number)


def compact(spark: SparkSession, path: str, number: int) -> None:
    """Merge the record versions before ``number`` into one.

    The merged version takes the next lower number. Flags merge in any order and as often as one likes, so a run that
    stops between writing and removing leaves a table that says the same.
    """
    records = f"{path}/records"
    old = _read(spark, records, ROW, number)
    if old is None:
        return
    versions = sorted(r[0] for r in old.select("version").distinct().collect())
    if len(versions) < 2:
        return
    _merged(old).repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{records}/version={versions[0] - 1}")
    for version in versions:
        remove_folder(spark, f"{records}/version={version}")


def maintain(changes: DataFrame, path: str, checkpoint: str) -> None:
    """Run a stream of changes (record, task_type, level_used, outcome, op) into the table, one version a batch."""
    query = (changes.writeStream.foreachBatch(lambda batch, number: apply_batch(batch.sparkSession, batch, path, number))
             .option("checkpointLocation", checkpoint).trigger(availableNow=True).start())
    query.awaitTermination()


def cells(spark: SparkSession, path: str) -> DataFrame:
    """Samples and successes per task type and level, as of the last batch."""
    versions = spark.read.schema(COUNTS).parquet(f"{path}/cells")
    newest = Window.orderBy(F.desc("version"))
    # the counts are few rows by construction
    return versions.withColumn("_r", F.rank().over(newest)).where("_r = 1 AND n > 0").drop("_r", "version")


def maintained_learner(spark: SparkSession, path: str, options: dims.LearnerOptions = dims.LearnerOptions()) -> DataFrame:
    """The advice of ``learning.learner``, from the table alone."""
    now = cells(spark, path)
    return advise(now, now.agg(F.coalesce(F.sum("n"), F.lit(0))).scalar(), options)
