"""Interval operators over ``chrom, start, end`` (closed coordinates).

Anything sequential along a chromosome is computed in two levels: rows within a
bin of positions, and one row per bin. So one chromosome that holds a third of
all rows is still spread over many tasks.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from helixframe.operators.order import running_sums

#: Positions per bin of the sequential operators, and of the overlap join.
BIN, JOIN_BIN = 1 << 16, 1 << 14


def overlaps(start: Column, end: Column, other_start: Column, other_end: Column) -> Column:
    return (start <= other_end) & (other_start <= end)


def overlap_length(start: Column, end: Column, other_start: Column, other_end: Column) -> Column:
    return F.greatest(F.lit(0), F.least(end, other_end) - F.greatest(start, other_start) + 1)


def range_filter(df: DataFrame, low: int, high: int, contained: bool = False, chrom=None, strand=None) -> DataFrame:
    """Rows that overlap [low, high], or lie within it."""
    keep = (F.col("start") >= low) & (F.col("end") <= high) if contained else overlaps(F.col("start"), F.col("end"), F.lit(low), F.lit(high))
    if chrom is not None:
        keep &= F.col("chrom") == chrom
    if strand is not None:
        keep &= F.col("strand") == strand
    return df.where(keep)


def starts(df: DataFrame, keys: Sequence[str], bin_size: int = BIN) -> DataFrame:
    """One row per key and start: ``start, top`` (largest end there), ``reach`` (largest end of all smaller starts, null for the first), ``_bin``.

    Windows hold the distinct starts of a bin, however many rows begin at them.
    """
    own = df.groupBy(*keys, "start").agg(F.max("end").alias("top")).withColumn("_bin", F.floor(F.col("start") / bin_size))
    before = Window.partitionBy(*keys).orderBy("_bin").rowsBetween(Window.unboundedPreceding, -1)
    bins = own.groupBy(*keys, "_bin").agg(F.max("top").alias("_top")).withColumn("_before", F.max("_top").over(before)).drop("_top")
    within = Window.partitionBy(*keys, "_bin").orderBy("start").rowsBetween(Window.unboundedPreceding, -1)
    return own.join(bins, [*keys, "_bin"]).withColumn("reach", F.greatest(F.max("top").over(within), F.col("_before"))).drop("_before")


def number_islands(df: DataFrame, gap: int, keys: Sequence[str] = ("chrom",), bin_size: int = BIN) -> DataFrame:
    """Adds ``island``: its number along the key. A row opens one if it starts over ``gap`` behind all ends before it."""
    keys = list(keys)
    flagged = starts(df, keys, bin_size).withColumn("_new", F.when(F.col("reach").isNull() | (F.col("start") > F.col("reach") + gap), 1).otherwise(0))
    before = Window.partitionBy(*keys).orderBy("_bin").rowsBetween(Window.unboundedPreceding, -1)
    bins = flagged.groupBy(*keys, "_bin").agg(F.sum("_new").alias("_n")).withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n")
    within = Window.partitionBy(*keys, "_bin").orderBy("start").rowsBetween(Window.unboundedPreceding, 0)
    numbered = flagged.join(bins, [*keys, "_bin"]).select(*keys, "start", (F.col("_before") + F.sum("_new").over(within)).cast("long").alias("island"))
    # a start that many rows share is a skewed partition, which the planner splits
    return df.join(numbered, [*keys, "start"]).select(*df.columns, "island")


def islands(df: DataFrame, gap: int, keys: Sequence[str] = ("chrom",)) -> DataFrame:
    """One row per island: its range and number of rows."""
    return number_islands(df, gap, keys).groupBy(*keys, "island").agg(F.min("start").alias("start"), F.max("end").alias("end"), F.count(F.lit(1)).alias("n"))


def containment(df: DataFrame, slop: int = 0, keys: Sequence[str] = ("chrom",)) -> DataFrame:
    """Adds ``contained``: the row ends within an earlier, longer-reaching one (``slop`` positions may stick out). Of one start the longest row is first, then the smallest id."""
    keys = list(keys)
    first = df.groupBy(*keys, "start").agg(F.min(F.struct(F.negative("end").alias("e"), "id"))["id"].alias("_first"))
    met = df.join(starts(df, keys).select(*keys, "start", "top", "reach"), [*keys, "start"]).join(first, [*keys, "start"])
    reach = F.when(F.col("id") == F.col("_first"), F.col("reach")).otherwise(F.greatest("reach", "top"))
    return met.select(*df.columns, F.coalesce(F.col("end") <= reach + slop, F.lit(False)).alias("contained"))


def depth(df: DataFrame, keys: Sequence[str] = ("chrom",), weight: Column | None = None, bin_size: int = BIN) -> DataFrame:
    """Runs of equal depth: ``start, end, depth`` for each key. Weights give weighted depth. Stretches without rows are left out."""
    keys = list(keys)
    w = F.lit(1) if weight is None else weight
    steps = df.select(*keys, F.explode(F.array(F.struct(F.col("start").alias("pos"), w.alias("d")), F.struct((F.col("end") + 1).alias("pos"), (-w).alias("d")))).alias("e"))
    steps = steps.groupBy(*keys, F.col("e.pos").alias("start")).agg(F.sum("e.d").alias("d"), F.sum(F.when(F.col("e.d") >= 0, 1).otherwise(-1)).alias("c")).withColumn("_bin", F.floor(F.col("start") / bin_size))
    before = Window.partitionBy(*keys).orderBy("_bin").rowsBetween(Window.unboundedPreceding, -1)
    after = Window.partitionBy(*keys).orderBy("_bin")
    bins = steps.groupBy(*keys, "_bin").agg(F.sum("d").alias("s"), F.sum("c").alias("k"), F.min("start").alias("first"))
    bins = bins.select(*keys, "_bin", F.coalesce(F.sum("s").over(before), F.lit(0)).alias("_s"), F.coalesce(F.sum("k").over(before), F.lit(0)).alias("_k"), F.lead("first").over(after).alias("_next"))
    upto = Window.partitionBy(*keys, "_bin").orderBy("start").rowsBetween(Window.unboundedPreceding, 0)
    along = Window.partitionBy(*keys, "_bin").orderBy("start")
    rows = steps.join(bins, [*keys, "_bin"])
    rows = rows.select(*keys, "start", (F.coalesce(F.lead("start").over(along), F.col("_next")) - 1).alias("end"), (F.col("_s") + F.sum("d").over(upto)).alias("depth"), (F.col("_k") + F.sum("c").over(upto)).alias("_open"))
    return rows.where("_open > 0").drop("_open")


def deal(left: DataFrame, right: DataFrame, bin_size: int = JOIN_BIN, long_bins: int = 64) -> tuple[DataFrame, DataFrame]:
    """Both sides of ``overlap_join`` with ``_kind, _bin``, in which every pair that overlaps meets at least once."""
    wide = bin_size * long_bins * long_bins

    def cut(df: DataFrame, s: str, e: str, long_kinds: tuple[int, ...], short_kind: int) -> DataFrame:
        def bins(kind: int, width: int) -> Column:
            return F.transform(F.sequence(F.floor(F.col(s) / width), F.floor(F.col(e) / width)), lambda b: F.struct(F.lit(kind).alias("kind"), b.alias("bin")))

        long = F.concat(*[bins(k, wide) for k in long_kinds])
        short = F.concat(bins(0, bin_size), bins(short_kind, wide))
        keyed = df.where(F.col(s) <= F.col(e)).withColumn("_cut", F.explode(F.when(F.col(e) - F.col(s) >= bin_size * long_bins, long).otherwise(short)))
        return keyed.withColumn("_kind", F.col("_cut.kind")).withColumn("_bin", F.col("_cut.bin")).drop("_cut")

    return cut(left, "start", "end", (1,), 2), cut(right, "start2", "end2", (1, 2), 1)


def overlap_join(left: DataFrame, right: DataFrame, keys: Sequence[str] = ("chrom",), bin_size: int = JOIN_BIN, how: Column | None = None, long_bins: int = 64) -> DataFrame:
    """Pairs of overlapping rows: an equi-join on key and bin of positions.

    ``left`` has ``start, end`` and ``right`` has ``start2, end2``. A pair is
    kept in the first bin that both reach, so none comes twice. ``how``
    replaces the overlap test by a stricter one. A bin that many rows share is
    a skewed partition, which the planner splits. Rows over more than
    ``long_bins`` bins meet others in bins ``long_bins`` ** 2 times as wide, so
    that none is copied more than a few times: the bins of two short rows, of a
    long left row and any right one, and of a short left row and a long right
    one are of three kinds.
    """
    a, b = deal(left, right, bin_size, long_bins)
    size = F.when(F.col("_kind") == 0, bin_size).otherwise(bin_size * long_bins * long_bins)
    test = overlaps(F.col("start"), F.col("end"), F.col("start2"), F.col("end2")) if how is None else how
    first = F.floor(F.greatest(F.col("start"), F.col("start2")) / size)
    return a.join(b, [*keys, "_kind", "_bin"]).where(F.col("_bin") == first).where(test).drop("_kind", "_bin")


def overlap_count(left: DataFrame, right: DataFrame, keys: Sequence[str] = ("chrom",)) -> DataFrame:
    """``id, n``: how many rows of ``right`` overlap each row of ``left`` (0 too), without making the pairs.

    Those that start at or before my end, less those that end before my start:
    two running sums over one order of positions. Ties are dealt by id, so a
    position that many rows share covers many partitions.
    """
    keys = list(keys)
    fit = right.where("start2 <= end2")
    event = lambda pos, rank, column: fit.groupBy(*keys, F.col(pos).cast("long").alias("_pos")).agg(F.count(F.lit(1)).alias("_n")).select(*keys, "_pos", F.lit(rank).alias("_rank"), F.lit(None).cast(dict(left.dtypes)["id"]).alias("id"), *[(F.col("_n") if c == column else F.lit(0).cast("long")).alias(c) for c in ("_open", "_shut")], F.lit(0).alias("_sign"))
    probe = lambda pos, sign: left.select(*keys, F.col(pos).cast("long").alias("_pos"), F.lit(1).alias("_rank"), "id", F.lit(0).cast("long").alias("_open"), F.lit(0).cast("long").alias("_shut"), F.lit(sign).alias("_sign"))
    rows = event("start2", 0, "_open").unionByName(probe("end", 1)).unionByName(probe("start", -1)).unionByName(event("end2", 2, "_shut"))
    summed = running_sums(rows, keys, ["_pos", "_rank", "id"], {"_opened": "_open", "_closed": "_shut"}).where("_sign <> 0")
    n = F.sum(F.when(F.col("_sign") > 0, F.col("_opened")).otherwise(-F.col("_closed")))
    return summed.groupBy("id").agg(n.cast("long").alias("n"))


def overlapping(left: DataFrame, right: DataFrame, keys: Sequence[str] = ("chrom",)) -> DataFrame:
    """``id`` of the rows of ``left`` that any row of ``right`` overlaps."""
    return overlap_count(left, right, keys).where("n > 0").select("id")


def nearest_upstream(left: DataFrame, right: DataFrame, distance: int, keys: Sequence[str] = ("chrom",), bin_size: int = JOIN_BIN) -> DataFrame:
    """For each left row the right row that ends last before it, at most ``distance`` away (smallest id of ties)."""
    reach = right.withColumn("_end", F.col("end2")).withColumn("start2", F.col("end2") + 1).withColumn("end2", F.col("end2") + distance)
    met = overlap_join(left.withColumn("_end1", F.col("end")).withColumn("end", F.col("start")), reach, keys, bin_size)
    best = met.groupBy("id").agg(F.max(F.struct(F.col("_end").alias("e"), (-F.col("id2")).alias("i"), F.col("start"))).alias("b"))
    return best.select("id", (-F.col("b.i")).alias("id2"), (F.col("b.start") - F.col("b.e")).alias("distance"))


def window_depth(df: DataFrame, window: int, keys: Sequence[str] = ("chrom",)) -> DataFrame:
    """``window, depth``: mean depth of each window of positions that rows reach."""
    cut = df.select(*keys, "start", "end", F.explode(F.sequence(F.floor(F.col("start") / window), F.floor(F.col("end") / window))).alias("window"))
    own = F.least(F.col("end"), (F.col("window") + 1) * window - 1) - F.greatest(F.col("start"), F.col("window") * window) + 1
    return cut.groupBy(*keys, "window").agg((F.sum(own) / F.lit(float(window))).alias("depth"))


def largest_drop(df: DataFrame, window: int, least: float, keys: Sequence[str] = ("chrom",)) -> DataFrame:
    """``pos, drop``: of each key the border of two adjacent windows at which the mean depth changes most, if by ``least`` (the first of ties)."""
    d = window_depth(df, window, keys)
    # each window meets itself and the one before; a window without rows has depth 0
    sides = d.select(*keys, F.explode(F.array(F.struct(F.col("window").alias("at"), F.col("depth").alias("left"), F.lit(0.0).alias("right")), F.struct((F.col("window") - 1).alias("at"), F.lit(0.0).alias("left"), F.col("depth").alias("right")))).alias("s"))
    steps = sides.groupBy(*keys, "s.at").agg(F.abs(F.sum("s.left") - F.sum("s.right")).alias("drop"))
    best = steps.where(F.col("drop") >= least).groupBy(*keys).agg(F.max(F.struct("drop", F.negative("at").alias("a"))).alias("b"))
    return best.select(*keys, ((1 - F.col("b.a")) * window).alias("pos"), F.col("b.drop").alias("drop"))
