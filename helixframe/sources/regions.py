"""Tables clustered by position, with one row of extents for each file and chromosome: region queries open only the files that they need."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from helixframe.operators.intervals import overlap_join


def write_clustered(df: DataFrame, path: str, files: int | None = None) -> None:
    """Rows ``chrom, start, end, ...`` sorted by place into files of like size under ``path``/data, their extents under ``path``/extents.

    Files are ranges of (chrom, start), whose borders Spark samples; a
    chromosome that holds most rows covers many files.
    """
    spark = df.sparkSession
    by = ["chrom", "start"]
    dealt = df.repartitionByRange(files, *by) if files else df.repartitionByRange(*by)
    dealt.sortWithinPartitions(*by).write.parquet(f"{path}/data")
    stored = spark.read.parquet(f"{path}/data")
    extents = stored.groupBy(F.element_at(F.split(F.input_file_name(), "/"), -1).alias("file"), "chrom").agg(F.min("start").alias("start2"), F.max("end").alias("end2"), F.count(F.lit(1)).alias("n"))
    extents.write.parquet(f"{path}/extents")


def files_of(spark: SparkSession, path: str, regions: DataFrame) -> list[str]:
    """Names of the files whose extents any region (``chrom, start, end``) overlaps: at most as many as there are files."""
    extents = spark.read.parquet(f"{path}/extents")
    return sorted(r.file for r in overlap_join(regions.select("chrom", "start", "end"), extents).select("file").distinct().collect())


def read_regions(spark: SparkSession, path: str, regions: DataFrame) -> DataFrame:
    """The rows that overlap any of the regions (``chrom, start, end``), each once. Only the files that hold such rows are opened."""
    stored = spark.read.parquet(f"{path}/data")
    files = files_of(spark, path, regions)
    rows = spark.read.schema(stored.schema).parquet(*[f"{path}/data/{f}" for f in files]) if files else stored.limit(0)
    kept = regions.select("chrom", F.col("start").alias("start2"), F.col("end").alias("end2"))
    named = rows.withColumn("_row", F.struct(F.input_file_name(), F.monotonically_increasing_id()))
    return overlap_join(named, kept).dropDuplicates(["_row"]).select(stored.columns)
