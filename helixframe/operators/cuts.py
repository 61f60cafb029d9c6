"""Places where coverage drops or rises: two neighbouring windows that slide along each stretch, compared by their order statistics."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Positions of a window, the statistic from which on two windows differ, and positions that are worked on together.
WINDOW, THRESHOLD, BLOCK = 100, 50.0, 8192


def window_statistic(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """For sorted windows (n, w): the sum of relative deviations of both windows' order statistics from what their sums let expect. Places that are empty in both count 0."""
    a, b = left.sum(axis=1, keepdims=True), right.sum(axis=1, keepdims=True)
    with np.errstate(all="ignore"):
        both = (left + right) / (a + b)
        x, y = left / (both * a) - 1, right / (both * b) - 1
    return (np.where(np.isfinite(x), x, 0) + np.where(np.isfinite(y), y, 0)).sum(axis=1)


def block_cuts(cov: np.ndarray, first: int, window: int = WINDOW, threshold: float = THRESHOLD) -> tuple[tuple[float, int] | None, tuple[float, int] | None]:
    """The largest drop (mean difference, last position before it) and rise (mean difference, first position of it) of coverage that begins at ``first``; the first of ties."""
    n = len(cov) - 2 * window + 1
    if n <= 0:
        return None, None
    view = np.lib.stride_tricks.sliding_window_view(np.asarray(cov, np.float64), window)
    left, right = np.sort(view[:n], axis=1), np.sort(view[window : window + n], axis=1)
    differ = (left.sum(axis=1) - right.sum(axis=1)) / window
    sure = np.flatnonzero((differ != 0) & (window_statistic(left, right) > threshold))
    out = []
    for sign, shift in ((1, window - 1), (-1, window)):
        own = sure[differ[sure] * sign > 0]
        k = own[np.argmax(differ[own] * sign)] if len(own) else None
        out.append(None if k is None else (float(differ[k] * sign), int(first + k + shift)))
    return out[0], out[1]


def coverage_cuts(coverage: DataFrame, window: int = WINDOW, threshold: float = THRESHOLD, block: int = BLOCK) -> DataFrame:
    """``key, sink_end, sink_drop, source_start, source_rise``: where a stretch ends or begins within its coverage.

    ``coverage``: ``key, pos, cov``; a stretch goes from its key's first to its
    last position, and positions without a row have coverage 0. At each border
    of two windows the statistic of ``window_statistic`` must exceed
    ``threshold``; of those borders the largest mean drop is the sink, the
    largest mean rise the source (the first of ties; null if there is none).
    Stretches shorter than two windows have no row. Positions are dealt into
    blocks that also hold the two windows before them, so a long stretch is
    many tasks.
    """
    own = coverage.where("key is not null and pos is not null").groupBy("key", "pos").agg(F.max("cov").cast("double").alias("cov"))
    ends = own.groupBy("key").agg(F.min("pos").alias("first"), F.max("pos").alias("last")).where(F.col("last") - F.col("first") + 1 >= 2 * window)
    # a block takes the borders whose right window ends in it
    blocks = ends.select("key", "first", "last", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("last") - F.col("first")) / block))).alias("block"))
    at = F.col("pos") - F.col("first")
    copies = F.sequence(F.floor(at / block), F.floor((at + 2 * window - 1) / block))
    placed = own.join(ends, "key").select("key", "pos", "cov", F.explode(copies).alias("block"))
    rows = blocks.join(placed, ["key", "block"], "left")
    kind = dict(coverage.dtypes)["key"]

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        low, k = int(pdf["first"].iloc[0]), int(pdf["block"].iloc[0])
        start, end = max(low, low + k * block - 2 * window + 1), min(int(pdf["last"].iloc[0]), low + (k + 1) * block - 1)
        cov = np.zeros(end - start + 1)
        there = pdf["pos"].notna().to_numpy()
        pos = pdf["pos"].to_numpy()[there].astype(np.int64)
        inside = (pos >= start) & (pos <= end)
        cov[pos[inside] - start] = pdf["cov"].to_numpy()[there][inside]
        found = [(s, *x) for s, x in zip(("sink", "source"), block_cuts(cov, start, window, threshold), strict=True) if x is not None]
        return pd.DataFrame([(pdf["key"].iloc[0], s, d, p) for s, d, p in found], columns=["key", "side", "by", "pos"])

    found = rows.groupBy("key", "block").applyInPandas(one, f"key {kind}, side string, by double, pos long")
    best = lambda side: F.max(F.when(F.col("side") == side, F.struct("by", F.negative("pos").alias("p"))))
    cuts = found.groupBy("key").agg(best("sink").alias("a"), best("source").alias("b"))
    return ends.select("key").join(cuts, "key", "left").select("key", F.negative("a.p").alias("sink_end"), F.col("a.by").alias("sink_drop"), F.negative("b.p").alias("source_start"), F.col("b.by").alias("source_rise"))
