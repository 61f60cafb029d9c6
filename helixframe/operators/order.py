"""Places and running sums in an order, without a task that holds a whole key.

Rows are dealt to partitions by ranges of key and order, so a key with a third
of all rows covers many partitions; one row per key and partition carries what
stands before it.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from helixframe.storage import materialize

#: Rows of a key that are windowed together by ``in_blocks``.
BLOCK = 4096


def _sorted(df: DataFrame, keys: Sequence[str], order: Sequence[Column | str]) -> DataFrame:
    """The rows in order, written with ``_at``: partition in the upper bits, place within it in the lower 33."""
    by = [*keys, *order]
    return materialize(df.repartitionByRange(*by).sortWithinPartitions(*by).withColumn("_at", F.monotonically_increasing_id()), "sorted").withColumn("_part", F.shiftright("_at", 33))


def number_rows(df: DataFrame, keys: Sequence[str], order: Sequence[Column | str], name: str = "place") -> DataFrame:
    """Adds the place (from 1) of each row among those of its key. Rows that are equal in order have any of their places."""
    rows = _sorted(df, keys, order)
    before = Window.partitionBy(*keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    parts = rows.groupBy(*keys, "_part").agg(F.min("_at").alias("_first"), F.count(F.lit(1)).alias("_n")).withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0)))
    return _beside(rows, parts.drop("_n"), keys).withColumn(name, (F.col("_at") - F.col("_first") + F.col("_before") + 1).cast("long")).drop("_at", "_part", "_first", "_before")


def _beside(rows: DataFrame, parts: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows with what belongs to their key and partition; a null key is a key."""
    rest = [c for c in parts.columns if c != "_part" and c not in keys]
    own = parts.select(F.col("_part").alias("_p"), *[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], *[F.col(c).alias(c) for c in rest])
    on = F.col("_part") == F.col("_p")
    for i, k in enumerate(keys):
        on &= F.col(k).eqNullSafe(F.col(f"_k{i}"))
    return rows.join(own, on).drop("_p", *[f"_k{i}" for i in range(len(keys))])


def running_sum(df: DataFrame, keys: Sequence[str], order: Sequence[Column | str], value: str, name: str) -> DataFrame:
    """Adds the sum of ``value`` over the rows of the key before each row (0 for the first)."""
    return running_sums(df, keys, order, {name: value})


def running_sums(df: DataFrame, keys: Sequence[str], order: Sequence[Column | str], values: dict[str, str]) -> DataFrame:
    """Adds, under each name, the sum of a column over the rows of the key before each row."""
    rows = _sorted(df, keys, order)
    before = Window.partitionBy(*keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    parts = rows.groupBy(*keys, "_part").agg(*[F.sum(v).alias(f"_s{i}") for i, v in enumerate(values.values())])
    parts = parts.select(*keys, "_part", *[F.coalesce(F.sum(f"_s{i}").over(before), F.lit(0)).alias(f"_before{i}") for i in range(len(values))])
    within = Window.partitionBy(*keys, "_part").orderBy("_at").rowsBetween(Window.unboundedPreceding, -1)
    own = rows.select("*", *[F.coalesce(F.sum(v).over(within), F.lit(0)).alias(f"_own{i}") for i, v in enumerate(values.values())])
    out = _beside(own, parts, keys)
    for i, name in enumerate(values):
        out = out.withColumn(name, F.col(f"_before{i}") + F.col(f"_own{i}")).drop(f"_before{i}", f"_own{i}")
    return out.drop("_at", "_part")


def in_blocks(df: DataFrame, behind: int = 0, ahead: int = 0, place: str = "place", block: int = BLOCK) -> DataFrame:
    """Adds ``_block`` and ``_copy``: numbered rows in blocks that also hold copies of the rows ``behind`` and ``ahead`` of them.

    A frame of so many rows over key and block is then that over the key; drop
    the copies afterwards.
    """
    at = F.col(place) - 1
    own = F.floor(at / block)
    none = F.array().cast("array<bigint>")
    later = F.when(at % block >= block - behind, F.array(own + 1)).otherwise(none) if behind else none
    earlier = F.when((at % block < ahead) & (own > 0), F.array(own - 1)).otherwise(none) if ahead else none
    blocks = F.concat(F.array(own), later, earlier)
    return df.withColumn("_own", own).withColumn("_block", F.explode(blocks)).withColumn("_copy", F.col("_own") != F.col("_block")).drop("_own")


def tiles(df: DataFrame, keys: Sequence[str], order: Sequence[Column | str], n: int, name: str = "part") -> DataFrame:
    """Adds the number (1 to n) of the part of equal count that each row of a key is in; the first parts take what is over."""
    numbered = number_rows(df, keys, order, "_place")
    total = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_total")) if keys else df.agg(F.count(F.lit(1)).alias("_total"))
    own = total.withColumn("_part", F.lit(0))
    rows = _beside(numbered.withColumn("_part", F.lit(0)), own, keys)
    size, over = F.floor(F.col("_total") / n), F.col("_total") % n
    full = over * (size + 1)
    place = F.col("_place") - 1
    part = F.when(place < full, F.floor(place / (size + 1))).otherwise(F.floor((place - full) / F.greatest(size, F.lit(1))) + over)
    return rows.withColumn(name, (part + 1).cast("int")).drop("_place", "_total", "_part")


def first_of_runs(df: DataFrame, keys: Sequence[str], order: Sequence[Column | str], value: str, n: int = 1) -> DataFrame:
    """The first ``n`` rows of each unbroken run of a value in the order of a key: those with another value (or none) among the ``n`` rows before."""
    rows = in_blocks(number_rows(df, keys, order, "_place"), behind=n, place="_place")
    w = Window.partitionBy(*keys, "_block").orderBy("_place")
    before = [F.lag(F.struct(F.col(value).alias("v")), k).over(w) for k in range(1, n + 1)]
    new = F.lit(False)
    for b in before:
        new |= b.isNull() | ~b["v"].eqNullSafe(F.col(value))
    return rows.withColumn("_new", new).where("_new and not _copy").select(df.columns)
