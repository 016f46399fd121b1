"""Session defaults for local runs; a cluster brings its own."""

from __future__ import annotations

from pyspark.sql import SparkSession

from .sources.workdir import SETTING


def local_session(cores: str = "8", name: str = "weirworks", work: str | None = None) -> SparkSession:
    """``work``: the folder for intermediate tables, used only where the settings name none."""
    builder = (SparkSession.builder.master(f"local[{cores}]").appName(name)
               .config("spark.sql.shuffle.partitions", "8").config("spark.ui.enabled", "false")
               .config("spark.driver.memory", "12g").config("spark.sql.session.timeZone", "UTC")
               .config("spark.sql.adaptive.enabled", "true"))
    spark = builder.getOrCreate()
    if work and spark.conf.get(SETTING, None) is None:
        spark.stop()
        spark = builder.config(SETTING, work).getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark
