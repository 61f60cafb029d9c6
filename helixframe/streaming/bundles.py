"""Bundling of point events, in batches or on streams."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def point_bundles(df: DataFrame, gap: int, lateness: int | None = None) -> DataFrame:
    """``chrom, start, last, n`` of events ``chrom, pos`` that lie less than ``gap`` apart: session windows over positions as time.

    Session windows that only touch are one, so theirs end a microsecond, the
    least step of time, short of ``gap``.
    On a stream, ``lateness`` positions late events are waited for; a bundle
    comes out once the watermark has passed its end.
    """
    timed = df.withColumn("at", F.timestamp_seconds("pos"))
    if lateness is not None:
        timed = timed.withWatermark("at", f"{lateness} seconds")
    g = timed.groupBy("chrom", F.session_window("at", f"{gap * 1_000_000 - 1} microseconds")).agg(F.min("pos").alias("start"), F.max("pos").alias("last"), F.count(F.lit(1)).alias("n"))
    return g.select("chrom", "start", "last", "n")


def saturating(df: DataFrame, limit: int) -> DataFrame:
    """Events of a stream until their key has had ``limit`` of them: state is one count per key."""
    from pyspark.sql.streaming.state import GroupStateTimeout

    names = df.columns

    def keep(key, batches, state):
        (seen,) = state.get if state.exists else (0,)
        for b in batches:
            room = max(0, limit - seen)
            seen += len(b)
            if room:
                yield b.iloc[:room][names]
        state.update((min(seen, limit),))

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema)
    return df.groupBy("chrom").applyInPandasWithState(keep, schema, "seen long", "append", GroupStateTimeout.NoTimeout)
