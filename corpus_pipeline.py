"""From raw documents to packed training sequences: five stages, each written and read again.

Every stage takes ``(spark, docs, sf_dir)``, works on all rows that its
predecessor kept, and returns the columns of ``documents``; the last returns
pieces of sequences.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from helixframe.llm.decontaminate import contaminated
from helixframe.llm.neardup import near_duplicates
from helixframe.llm.packing import pack
from helixframe.llm.quality import keep_good
from helixframe.llm.secrets import redact
from helixframe.storage import materialize, ship


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows whose text the Bradley-Terry ranking rejects go. Null and empty texts are scored like others, repeated rows alike."""
    return keep_good(docs, ship(spark).read.parquet(f"{sf_dir}/labels.parquet"))


def _free(docs: DataFrame, name: str) -> str:
    """A column name that ``docs`` does not have."""
    while name in map(str.lower, docs.columns):
        name += "_"
    return name


def near_duplicate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group stays: the one with the smallest doc_id (null last), the first of such rows.

    Rows are compared by a name of their own, written with them, so those
    without doc_id are told apart and texts that share a doc_id but are no
    duplicates stay. Null, empty and blank texts are like nothing and stay; of
    those that share a doc_id, the first.
    """
    ship(spark)
    row = _free(docs, "_row")
    named = materialize(docs.withColumn(row, F.monotonically_increasing_id()), "named")
    groups = near_duplicates(named.select(F.col(row).alias("doc_id"), "text")).select(F.col("doc_id").alias("row"), F.col("component_id").alias("group"), "kept", "n_shingles")
    # groups of several rows: all members but the first by doc_id go
    several = groups.where("not kept").select("group").distinct()
    members = groups.join(several, "group", "left_semi").join(named.select(F.col(row).alias("row"), "doc_id"), "row")
    blank = groups.where("n_shingles = 0").join(named.select(F.col(row).alias("row"), "doc_id").where("doc_id is not null"), "row")
    blank = blank.join(blank.groupBy("doc_id").agg(F.min("row").alias("first")), "doc_id").where("row <> first").select("row")
    first = members.groupBy("group").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row")).alias("first")).select("first.row")
    gone = materialize(members.select("row").join(first, "row", "left_anti").unionAll(blank), "gone")
    return named.join(gone.withColumnRenamed("row", row), row, "left_anti").select(docs.columns)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a passage of the benchmark go, each by its own text, with or without doc_id. Null and empty texts stay."""
    text = _free(docs, "_text")
    named = docs.withColumn(text, F.xxhash64("text"))
    found = contaminated(named.select(F.col(text).alias("doc_id"), "text"), ship(spark).read.parquet(f"{sf_dir}/benchmark.parquet"))
    return named.join(found.select(F.col("doc_id").alias(text)).distinct(), text, "left_anti").select(docs.columns)


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All rows stay, null and empty texts as they are; each secret is replaced by its kind in brackets, and n_chars follows."""
    ship(spark)
    return redact(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of sequences of at most 1024 tokens. Null and empty texts give the piece of their closing id; repeated rows are packed each."""
    ship(spark)
    return pack(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [("quality", quality), ("near_duplicate", near_duplicate), ("decontamination", decontamination), ("secrets", secrets), ("packing", packing)]

#: No stage but the last joins can be said in SQL: the ranking, the sketches and the automata are learnt or hashed.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = ship(spark).read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = materialize(docs, name)
    return docs
