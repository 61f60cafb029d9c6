"""Sequence files: records that start with ``>``."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def read_fasta(spark: SparkSession, path: str) -> DataFrame:
    """``id, description, seq``: one row per record; folded lines are joined."""
    raw = spark.read.option("lineSep", "\n>").text(path)
    record = F.regexp_replace(F.regexp_replace("value", "^>", ""), "\r", "")
    head, rest = F.regexp_extract(record, r"^([^\n]*)", 1), F.regexp_extract(record, r"(?s)^[^\n]*\n(.*)$", 1)
    rows = raw.select(head.alias("head"), F.regexp_replace(rest, r"\s", "").alias("seq")).where("head <> ''")
    return rows.select(F.regexp_extract("head", r"^(\S+)", 1).alias("id"), F.trim(F.regexp_extract("head", r"^\S+\s*(.*)$", 1)).alias("description"), "seq")


def to_fasta(name: Column, description: Column, seq: Column, width: int = 0) -> Column:
    """A record's text; lines of ``width`` characters if it is positive."""
    head = F.concat(F.lit(">"), name, F.when(F.coalesce(description, F.lit("")) != "", F.concat(F.lit(" "), description)).otherwise(""))
    body = seq if width <= 0 else F.regexp_replace(seq, f"(.{{{width}}})(?=.)", "$1\n")
    return F.concat(head, F.lit("\n"), body)


def write_fasta(df: DataFrame, path: str, width: int = 60, **options) -> None:
    """``id, description, seq`` as text files; ``maxRecordsPerFile`` and ``compression`` are options of the writer."""
    df.select(to_fasta(F.col("id"), F.col("description"), F.col("seq"), width).alias("value")).write.options(**options).text(path)


#: Bases of a piece of a stored sequence.
PIECE = 1 << 16


def pieces(df: DataFrame, size: int = PIECE) -> DataFrame:
    """``id, piece, seq``: sequences in pieces of so many bases, numbered from 0, as a table from which regions are fetched."""
    n = F.greatest(F.ceil(F.length("seq") / size), F.lit(1))
    cut = df.select("id", "seq", F.explode(F.sequence(F.lit(0).cast("long"), n - 1)).alias("piece"))
    return cut.select("id", "piece", F.substring(F.col("seq"), (F.col("piece") * size + 1).cast("int"), F.lit(size)).alias("seq"))


def fetch(df: DataFrame, regions: DataFrame, size: int = PIECE) -> DataFrame:
    """Regions (``id, start, end`` from 1) cut out of the sequences; ends are held within them. Regions of unknown sequences go."""
    return fetch_pieces(pieces(df, size), regions, size)


def fetch_pieces(stored: DataFrame, regions: DataFrame, size: int = PIECE) -> DataFrame:
    """The same from ``pieces``: a region meets only the pieces that it reaches, so no row carries a whole chromosome."""
    asked = regions.select("id", "start", "end").distinct()
    low = F.greatest(F.lit(1).cast("long"), F.col("start"))
    # pieces behind the sequence's end are not asked for
    met = asked.join(stored.groupBy("id").agg(F.max("piece").alias("last")), "id")
    first, last = F.floor((low - 1) / size), F.least(F.floor((F.col("end") - 1) / size), F.col("last"))
    cut = met.select("id", "start", "end", F.explode_outer(F.when((F.col("end") >= low) & (last >= first), F.sequence(first, last))).alias("piece")).join(stored, ["id", "piece"], "left")
    at = F.greatest(low - F.col("piece") * size, F.lit(1))
    part = F.coalesce(F.substring(F.col("seq"), at.cast("int"), (F.least(F.col("end") - F.col("piece") * size, F.lit(size)) - at + 1).cast("int")), F.lit(""))
    whole = cut.groupBy("id", "start", "end").agg(F.sort_array(F.collect_list(F.struct("piece", part.alias("part")))).alias("p"))
    return regions.join(whole, ["id", "start", "end"]).select("id", "start", "end", F.array_join(F.transform("p", lambda x: x["part"]), "").alias("part"))


def sequence_lengths(df: DataFrame) -> DataFrame:
    """``id, n``: what an index of sequences holds."""
    return df.select("id", F.length("seq").cast("long").alias("n"))
