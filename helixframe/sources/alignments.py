"""Alignment text, intervals, coverage tracks, hits, alignments in blocks, layouts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from helixframe.sources.lines import numbered_lines

SAM = (("qname", "string"), ("flag", "int"), ("rname", "string"), ("pos", "long"), ("mapq", "int"), ("cigar", "string"), ("rnext", "string"), ("pnext", "long"), ("tlen", "long"), ("seq", "string"), ("qual", "string"))


def parse_sam(lines: DataFrame) -> DataFrame:
    """Alignment lines with their optional fields as a map ``tags``; header lines go."""
    t = F.split("value", "\t")
    rows = lines.where(~F.col("value").rlike("^@[A-Z]{2}(\t|$)")).select(t.alias("t")).where("size(t) >= 11")
    tags = F.map_from_entries(F.transform(F.filter(F.slice("t", 12, 1000), lambda x: x.rlike("^[A-Za-z][A-Za-z0-9]:.:")), lambda x: F.struct(F.substring(x, 1, 2), F.regexp_extract(x, "^.....(.*)$", 1))))
    return rows.select(*[F.get("t", F.lit(i)).try_cast(k).alias(n) for i, (n, k) in enumerate(SAM)], tags.alias("tags"))


def read_sam(spark: SparkSession, path: str) -> DataFrame:
    return parse_sam(spark.read.text(path))


def parse_bed(lines: DataFrame) -> DataFrame:
    """``chrom, start, end, name, score, strand`` with closed coordinates from 1."""
    t = F.split("value", "\t")
    rows = lines.where(~F.col("value").rlike("^(#|track|browser)")).select(t.alias("t")).where("size(t) >= 3")
    return rows.select(F.get("t", F.lit(0)).alias("chrom"), (F.get("t", F.lit(1)).try_cast("long") + 1).alias("start"), F.get("t", F.lit(2)).try_cast("long").alias("end"), F.get("t", F.lit(3)).alias("name"), F.get("t", F.lit(4)).try_cast("double").alias("score"), F.get("t", F.lit(5)).alias("strand"))


def read_bed(spark: SparkSession, path: str) -> DataFrame:
    return parse_bed(spark.read.text(path))


def parse_wiggle(lines: DataFrame) -> DataFrame:
    """``chrom, pos, value`` of fixedStep tracks from ``file, block, n, value`` lines: each header counts for the lines down to the next.

    Headers are carried within a block of a file, and from block to block by one row for each.
    """
    header = F.when(F.col("value").startswith("fixedStep"), F.struct("n", "value"))
    marked = lines.withColumn("h", header)
    last = marked.groupBy("file", "block").agg(F.max("h").alias("last"))
    before = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    last = last.select("file", "block", F.last("last", ignorenulls=True).over(before).alias("open"))
    w = Window.partitionBy("file", "block").orderBy("n").rowsBetween(Window.unboundedPreceding, 0)
    rows = marked.withColumn("own", F.last("h", ignorenulls=True).over(w)).join(last, ["file", "block"]).withColumn("top", F.coalesce("own", "open")).where("h is null and top is not null")
    field = lambda k, d: F.coalesce(F.nullif(F.regexp_extract(F.col("top.value"), rf"{k}=(\S+)", 1), F.lit("")), F.lit(d))
    return rows.select(field("chrom", "").alias("chrom"), (field("start", "1").cast("long") + (F.col("n") - F.col("top.n") - 1) * field("step", "1").cast("long")).alias("pos"), F.col("value").cast("double").alias("value"))


def read_wiggle(spark: SparkSession, path: str) -> DataFrame:
    return parse_wiggle(numbered_lines(spark, path).where("trim(value) <> ''"))


HITS = (("q_name", "string"), ("q_len", "long"), ("q5", "long"), ("q3", "long"), ("h_name", "string"), ("h_len", "long"), ("h5", "long"), ("h3", "long"), ("pid", "double"), ("score", "double"), ("score2", "double"), ("strand", "string"))


def parse_hits(lines: DataFrame) -> DataFrame:
    """Similarity hits of twelve columns, with gap lists as arrays of (pos, len) where they follow."""
    t = F.split("value", "\t")
    rows = lines.select(t.alias("t")).where("size(t) >= 12")
    gaps = lambda i: F.transform(F.filter(F.split(F.coalesce(F.get("t", F.lit(i)), F.lit("")), ","), lambda x: x != ""), lambda x: F.struct(F.regexp_extract(x, r"^(\d+)", 1).cast("long").alias("pos"), F.coalesce(F.nullif(F.regexp_extract(x, r"\+(\d+)$", 1), F.lit("")), F.lit("1")).cast("long").alias("len")))
    return rows.select(*[F.get("t", F.lit(i)).try_cast(k).alias(n) for i, (n, k) in enumerate(HITS)], gaps(12).alias("q_gaps"), gaps(13).alias("h_gaps"))


def read_hits(spark: SparkSession, path: str) -> DataFrame:
    return parse_hits(spark.read.text(path))


def read_layout(spark: SparkSession, path: str) -> DataFrame:
    return parse_layout(spark.read.option("lineSep", "\n>").text(path))


def parse_layout(contigs: DataFrame) -> DataFrame:
    """``contig, name, orient, len, start, clip_l, clip_r`` of layouts, a contig's text in each row."""
    raw = contigs.select(F.split(F.regexp_replace("value", "^>", ""), "\n").alias("l"))
    rows = raw.select(F.regexp_extract(F.col("l")[0], r"^(\S+)", 1).alias("contig"), F.explode(F.slice("l", 2, 1 << 30)).alias("r")).where("trim(r) <> ''")
    f = F.split(F.trim("r"), r"\s+")
    return rows.select("contig", f[0].alias("name"), f[1].alias("orient"), f[2].cast("long").alias("len"), f[3].cast("long").alias("start"), F.get(f, F.lit(4)).cast("long").alias("clip_l"), F.get(f, F.lit(5)).cast("long").alias("clip_r"))


def read_table(spark: SparkSession, url: str, query: str, **options) -> DataFrame:
    """Rows of a query on a database server."""
    return spark.read.format("jdbc").options(url=url, query=query, **options).load()


def write_table(df: DataFrame, url: str, name: str, **options) -> None:
    """Replaces a database table's rows, keeping the table."""
    df.write.format("jdbc").options(url=url, dbtable=name, truncate="true", **options).mode("overwrite").save()
