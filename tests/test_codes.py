"""Closest relations, found for a cell of places at once, beside the relation of each pair by itself."""

import random

from helixframe.operators import codes, transcripts
from pyspark.sql import functions as F

MODEL = "tid long, chrom string, strand string, exons array<struct<start:long,end:long>>"


def some(rng, n, first):
    out = []
    for tid in range(first, first + n):
        at, exons = rng.choice((0, 16300, 100000, 400000)) + rng.randrange(0, 3000, 20), []
        for _ in range(rng.choice((1, 1, 2, 3, 4))):
            end = at + rng.choice((40, 60, 80, 200))
            exons.append((at, end))
            at = end + rng.choice((20, 60, 300, 900))
        if rng.random() < 0.05:
            exons.append((at + 2_000_000, at + 2_000_050))
        out.append((tid, rng.choice("cd"), rng.choice("++--."), exons))
    return out


def test_cells_agree_with_pairs(spark, monkeypatch):
    # small parts, so that a cell is a grid of groups
    monkeypatch.setattr(codes, "GROUP", 40)
    rng = random.Random(5)
    q, r = (transcripts.with_range(spark.createDataFrame(some(rng, 120, k), MODEL)) for k in (0, 1000))
    other = r.toDF("ref", "chrom", "strand2", "exons2", "start2", "end2")
    met = q.join(other, "chrom").where("start <= end2 and start2 <= end").withColumn("ov", transcripts.exon_overlap(F.col("exons"), F.col("exons2")))
    crossing = F.exists(transcripts.introns(F.col("exons")), lambda x: F.exists(transcripts.introns(F.col("exons2")), lambda y: (x["start"] <= y["end"]) & (y["start"] <= x["end"])))
    own = F.when(F.col("strand") == F.col("strand2"), transcripts.class_code(F.col("exons"), F.col("exons2"), F.col("ov"))).otherwise(F.when(crossing, "s").when(F.col("ov") > 0, "x"))
    behind = F.when(F.col("strand") == "-", F.col("start2") - F.col("end")).otherwise(F.col("start") - F.col("end2"))
    run_on = q.join(other, "chrom").where(F.col("strand") == F.col("strand2")).where(behind.between(1, transcripts.RUN_ON)).select("tid", "ref", F.lit("p").alias("code"), F.lit(0).cast("long").alias("ov"))
    best: dict = {}
    for x in met.select("tid", "ref", own.alias("code"), "ov").where("code is not null").unionByName(run_on).collect():
        best[x.tid] = min(best.get(x.tid, (99,)), (transcripts.RANK.index(x.code), -x.ov, x.ref))
    want = {t: (transcripts.RANK[best[t][0]], best[t][2]) if t in best else ("u", None) for t in range(120)}
    found = transcripts.best_codes(q, r)
    got = {x.tid: (x.code, x.ref) for x in found.collect()}
    assert {t: (got[t], want[t]) for t in want if got[t] != want[t]} == {}
    assert len({code for code, _ in want.values()}) >= 7


def test_no_row_is_made_for_a_pair(spark):
    n = 6000
    t = spark.range(n).select(F.col("id").alias("tid"), F.lit("c").alias("chrom"), F.lit("+").alias("strand"), F.array(F.struct(F.lit(1).cast("long").alias("start"), (F.col("id") % 90 + 100).alias("end"))).alias("exons"))
    t = transcripts.with_range(t)
    # all of one place: 9,000,000 pairs, each read where its group is
    found = transcripts.best_codes(t.where("tid % 2 = 0"), t.where("tid % 2 = 1"))
    assert "FlatMapCoGroupsInArrow" in found._jdf.queryExecution().executedPlan().toString()
    got = found.groupBy("code").count().collect()
    assert [(x.code, x["count"]) for x in got] == [("=", n // 2)]
