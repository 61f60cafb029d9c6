"""Reads with qualities: records of four lines."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from helixframe.sources.lines import numbered_lines


def read_fastq(spark: SparkSession, path: str) -> DataFrame:
    """``id, info, seq, qual`` of four-line records; compressed files are read as Spark reads them. Other groups of four lines go."""
    lines = numbered_lines(spark, path)
    four = lines.groupBy("file", F.floor(F.col("n") / 4).alias("r")).agg(*[F.max(F.when(F.col("n") % 4 == i, F.col("value"))).alias(f"l{i}") for i in range(4)])
    good = four.where(F.col("l0").startswith("@") & F.col("l2").startswith("+"))
    name = F.regexp_replace("l0", "^@", "")
    return good.select(F.regexp_extract(name, r"^(\S+)", 1).alias("id"), F.trim(F.regexp_extract(name, r"^\S+\s*(.*)$", 1)).alias("info"), F.col("l1").alias("seq"), F.col("l3").alias("qual"))


def write_fastq(df: DataFrame, path: str, **options) -> None:
    head = F.concat(F.lit("@"), "id", F.when(F.coalesce("info", F.lit("")) != "", F.concat(F.lit(" "), "info")).otherwise(""))
    df.select(F.concat_ws("\n", head, "seq", F.lit("+"), "qual").alias("value")).write.options(**options).text(path)
