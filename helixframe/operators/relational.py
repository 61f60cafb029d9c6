"""Keyed record operators: joins with explicit duplicates, lookups, summaries, top rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from helixframe.operators.order import running_sums


def last_wins(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """One row per key: the last in ``order``. An aggregate, so hot keys are combined before the shuffle."""
    rest = [c for c in df.columns if c not in keys]
    top = df.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("_r"))
    return top.select(*keys, *[F.col(f"_r.{c}").alias(c) for c in rest])


def first_wins(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    rest = [c for c in df.columns if c not in keys]
    top = df.groupBy(*keys).agg(F.min_by(F.struct(*rest), F.struct(*order)).alias("_r"))
    return top.select(*keys, *[F.col(f"_r.{c}").alias(c) for c in rest])


def keyed_join(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "inner", order: Sequence[str] | None = None, filler: dict | None = None) -> DataFrame:
    """Join in which, of right rows with one key, only the last in ``order`` counts (all of them without an order)."""
    out = left.join(right if order is None else last_wins(right, keys, order), list(keys), how)
    return out.na.fill(filler) if filler else out


def without_version(name: Column) -> Column:
    """A name without its ``.N`` ending."""
    return F.regexp_replace(name, r"\.[0-9]+$", "")


def semi(left: DataFrame, names: DataFrame, key: str, ignore_version: bool = False) -> DataFrame:
    if not ignore_version:
        return left.join(names.select(key).distinct(), key, "left_semi")
    plain = names.select(without_version(F.col(key)).alias("_k")).distinct()
    return left.withColumn("_k", without_version(F.col(key))).join(plain, "_k", "left_semi").drop("_k")


def anti(left: DataFrame, names: DataFrame, key: str) -> DataFrame:
    return left.join(names.select(key).distinct(), key, "left_anti")


def translate_column(df: DataFrame, column: str, table: DataFrame, source: str, target: str) -> DataFrame:
    """Values found in ``table`` are replaced, others stay."""
    named = table.select(F.col(source).alias("_from"), F.col(target).alias("_to"))
    return df.join(named, df[column] == named["_from"], "left").withColumn(column, F.coalesce("_to", column)).drop("_from", "_to")


def column_stats(df: DataFrame, column: str) -> DataFrame:
    """Sum, mean, count and extremes of the numeric values of a text or number column; others are counted as skipped."""
    text = F.col(column).cast("string")
    number = F.when(text.rlike(r"^\s*[-+]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][-+]?[0-9]+)?\s*$"), F.trim(text).cast("double"))
    return df.select(number.alias("v"), text.alias("t")).agg(F.sum("v").alias("total"), F.avg("v").alias("mean"), F.count("v").alias("n"), F.min("v").alias("low"), F.max("v").alias("high"), F.sum(F.when(F.col("v").isNull() & F.col("t").isNotNull(), 1).otherwise(0)).alias("skipped"))


def count_by_key(df: DataFrame, keys: Sequence[str], least: int = 1, most: int | None = None) -> DataFrame:
    """Rows per key with their share of all rows; keys outside [least, most] are left out."""
    counts = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
    total = counts.agg(F.sum("n").alias("_total"))
    out = counts.crossJoin(F.broadcast(total)).withColumn("share", F.col("n") / F.col("_total")).drop("_total").where(F.col("n") >= least)
    return out if most is None else out.where(F.col("n") <= most)


def sum_by_key(df: DataFrame, keys: Sequence[str], value: str, least: float | None = None) -> DataFrame:
    out = df.groupBy(*keys).agg(F.sum(value).alias("total"))
    return out if least is None else out.where(F.col("total") >= least)


def argmax(df: DataFrame, keys: Sequence[str], value: Column, ties: Sequence[Column]) -> DataFrame:
    """The row of each key with the largest value; ties go to the largest of ``ties``."""
    rest = [c for c in df.columns if c not in keys]
    top = df.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(value.alias("_v"), *[t.alias(f"_t{i}") for i, t in enumerate(ties)])).alias("_r"))
    return top.select(*keys, *[F.col(f"_r.{c}").alias(c) for c in rest])


def top_n(df: DataFrame, keys: Sequence[str], order: Sequence[Column], n: int) -> DataFrame:
    """The first ``n`` rows of each key, with their place."""
    return df.withColumn("place", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("place") <= n)


def best_stratum(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """All rows that share the least value of their key."""
    least = df.groupBy(*keys).agg(F.min(value).alias("_least"))
    return df.join(least, list(keys)).where(F.col(value) == F.col("_least")).drop("_least")


def value_counts(df: DataFrame, value: Column, weight: Column | None = None) -> DataFrame:
    """``v, w`` with the weight before each value: the base of weighted quantiles and of N50.

    Values are summed up first. The running sum goes over ranges of values and
    then within each, so no task sees all values.
    """
    w = F.lit(1) if weight is None else weight
    sums = df.select(value.alias("v"), w.alias("w")).where("v is not null and w is not null").groupBy("v").agg(F.sum("w").alias("w"))
    rows = running_sums(sums.withColumn("_m", F.col("v") * F.col("w")), [], ["v"], {"before": "w", "_below": "_m"})
    return rows.select("v", "w", "before", (F.col("_below") + F.col("_m")).alias("mass"))


def weighted_summary(df: DataFrame, value: Column, weight: Column | None = None) -> DataFrame:
    """One row: count, extremes, quartiles, mean, sum, N50 and fences.

    A quartile is the last value before which at most q of the weight lies.
    N50 is the largest value such that it and all larger ones hold at least
    half of the mass.
    """
    counts = value_counts(df, value, weight)
    total = counts.agg(F.sum("w").alias("n"), F.sum(F.col("v") * F.col("w")).alias("total"))
    rows = counts.crossJoin(F.broadcast(total))
    quartile = lambda q: F.max(F.when(F.col("before") <= q * F.col("n"), F.col("v")))
    # mass of this and all larger values
    above = F.col("total") - F.col("mass") + F.col("v") * F.col("w")
    out = rows.agg(F.max("n").alias("n"), F.min("v").alias("low"), quartile(0.25).alias("q1"), quartile(0.5).alias("q2"), quartile(0.75).alias("q3"), F.max("v").alias("high"), F.max("total").alias("total"), F.max(F.when(above >= F.col("total") / 2, F.col("v"))).alias("n50"))
    return out.withColumn("mean", F.col("total") / F.col("n")).withColumn("fence_low", F.col("q1") - 1.5 * (F.col("q3") - F.col("q1"))).withColumn("fence_high", F.col("q3") + 1.5 * (F.col("q3") - F.col("q1")))


def n50(df: DataFrame, length: Column) -> DataFrame:
    """One row: number and sum of lengths, N50 and L50 (how many of the longest it takes to hold half)."""
    counts = value_counts(df, length)
    total = counts.agg(F.sum("w").alias("n"), F.sum(F.col("v") * F.col("w")).alias("total"))
    rows = counts.crossJoin(F.broadcast(total))
    above = F.col("total") - F.col("mass")
    crossing = rows.where((above + F.col("v") * F.col("w") >= F.col("total") / 2) & (above < F.col("total") / 2))
    larger = F.col("n") - F.col("before") - F.col("w")
    return crossing.select("n", "total", F.col("v").alias("n50"), (larger + F.ceil((F.col("total") / 2 - above) / F.col("v"))).cast("long").alias("l50"))


def sort_dedupe(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """One row per key pair, the last in ``order``, in key order."""
    return last_wins(df, keys, order).orderBy(*keys)
