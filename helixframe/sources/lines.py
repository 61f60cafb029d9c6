"""Numbered lines of text files, without a task that reads a whole file."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """``file, block, n, value``: lines count from 0 within their file.

    Blocks are numbered on their own; the lines of the blocks before are added
    from one row per block.
    """
    meta = F.col("_metadata")
    raw = spark.read.text(path).select(meta["file_path"].alias("file"), meta["file_block_start"].alias("block"), F.monotonically_increasing_id().alias("i"), F.regexp_replace("value", "\r$", "").alias("value"))
    sizes = raw.groupBy("file", "block").agg(F.count(F.lit(1)).alias("c"))
    before = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.select("file", "block", F.coalesce(F.sum("c").over(before), F.lit(0)).alias("before"))
    own = F.row_number().over(Window.partitionBy("file", "block").orderBy("i")) - 1
    return raw.withColumn("own", own).join(sizes, ["file", "block"]).select("file", "block", (F.col("before") + F.col("own")).alias("n"), "value")
