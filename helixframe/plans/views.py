"""The driver tables as the records of the domain."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from helixframe.storage import ship


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return ship(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def intervals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events as intervals: chrom = user, start = seconds, length = value minutes, strand = type."""
    start = F.expr("timestampdiff(SECOND, TIMESTAMP_NTZ '1970-01-01 00:00:00', ts)")
    e = table(spark, sf_dir, "events").select(F.col("event_id").alias("id"), F.col("user_id").alias("chrom"), start.alias("start"), F.col("event_type").alias("strand"), "value")
    return e.withColumn("end", F.col("start") + F.floor(F.col("value") * 60))


#: The same in DuckDB.
IV = """iv AS (SELECT event_id AS id, user_id AS chrom, CAST(floor(epoch(ts)) AS BIGINT) AS "start", CAST(floor(epoch(ts)) AS BIGINT) + CAST(floor(value * 60) AS BIGINT) AS "end", event_type AS strand, value FROM events)"""


def hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """lineitem as similarity hits: query = order, subject = part, score = price, pid and lengths from the other numbers."""
    li = table(spark, sf_dir, "lineitem")
    return li.select(F.col("l_orderkey").alias("q"), F.col("l_partkey").alias("h"), F.col("l_suppkey").alias("s"), F.col("l_linenumber").alias("line"), F.col("l_extendedprice").alias("score"), (100 - 100 * F.col("l_discount")).alias("pid"), F.col("l_quantity").alias("overlap"), F.when(F.col("l_returnflag") == "R", "-").otherwise("+").alias("strand"))


HITS = """hits AS (SELECT l_orderkey AS q, l_partkey AS h, l_suppkey AS s, l_linenumber AS line, l_extendedprice AS score, 100 - 100 * l_discount AS pid, l_quantity AS overlap, CASE WHEN l_returnflag = 'R' THEN '-' ELSE '+' END AS strand FROM lineitem)"""
