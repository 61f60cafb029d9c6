"""Hubs, dense stretches and long rows: right results, and no task with most of the rows."""

import random

import pytest
from helixframe.operators import graph, intervals
from pyspark.sql import functions as F


def plain_components(edges):
    top = {}

    def find(x):
        top.setdefault(x, x)
        while top[x] != x:
            x = top[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        top[max(a, b)] = min(a, b)
    return {x: find(x) for x in list(top)}


@pytest.mark.parametrize("hub", [2, 50, 10_000])
def test_components_with_hubs(spark, hub):
    rnd = random.Random(hub)
    edges = [(rnd.choice([0, 999, 500]), rnd.randrange(1000)) for _ in range(700)] + [(rnd.randrange(2000, 2100), rnd.randrange(2000, 2100)) for _ in range(60)] + [(k, k + 1) for k in range(3000, 3070)]
    df = spark.createDataFrame(edges, "src long, dst long")
    assert {r.node: r.component for r in graph.connected_components(df, hub=hub).collect()} == plain_components(edges)


def rows_of_largest_task(df, keys):
    """Largest and mean number of rows that meet under one key."""
    n = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).agg(F.max("n"), F.avg("n")).first()
    return n[0], n[1]


def test_a_node_of_degree_50000(spark):
    """The star's links are joined by a broadcast table: the hub is no key of the shuffled join."""
    star = spark.range(1, 50_001).select(F.lit(0).cast("long").alias("src"), F.col("id").alias("dst"))
    found = graph.connected_components(star)
    assert found.agg(F.count(F.lit(1)), F.max("component")).first() == (50_001, 0)
    both = star.select(F.col("dst").alias("a"), F.col("src").alias("b")).unionAll(star.select(F.col("src").alias("a"), F.col("dst").alias("b")))
    low = both.groupBy("a").agg(F.min("b").alias("m"), F.count(F.lit(1)).alias("n"))
    met = graph._below(both, low, 10_000)
    assert met.count() == 100_000 and "BroadcastHashJoin" in met._jdf.queryExecution().toString()
    most, mean = rows_of_largest_task(both.join(low.where("n <= 10000"), "a"), ["a"])
    assert most <= 2 * mean


def lines(rnd, n, span, chroms=2):
    out = []
    for k in range(n):
        s = rnd.randrange(span)
        out.append((k, str(rnd.randrange(chroms)), s, s + rnd.choice([0, 3, 40, 40, 900, 200_000])))
    return out


@pytest.mark.parametrize("bins", [{"bin_size": 16, "long_bins": 2}, {"bin_size": 64, "long_bins": 8}, {}])
def test_overlaps_of_short_and_long_rows(spark, bins):
    rnd = random.Random(5)
    left, right = lines(rnd, 80, 3000), lines(rnd, 80, 3000)
    a = spark.createDataFrame(left, "id long, chrom string, start long, end long")
    b = spark.createDataFrame(right, "id2 long, chrom string, start2 long, end2 long")
    want = sorted((i, j) for i, c, s, e in left for j, d, t, f in right if c == d and s <= f and t <= e)
    assert sorted((r.id, r.id2) for r in intervals.overlap_join(a, b, **bins).collect()) == want
    assert {r.id: r.n for r in intervals.overlap_count(a, b).collect()} == {i: sum(x == i for x, _ in want) for i, *_ in left}
    assert sorted(r.id for r in intervals.overlapping(a, b).collect()) == sorted({i for i, _ in want})


def test_20000_rows_in_one_bin(spark):
    """Rows that begin at few positions of one bin: windows see the distinct positions, counts cover many partitions."""
    dense = spark.range(20_000).select("id", F.lit("c").alias("chrom"), (F.col("id") % 10).alias("start"), (F.col("id") % 10 + F.col("id") % 7).alias("end"))
    assert intervals.starts(dense, ["chrom"]).count() == 10
    assert intervals.number_islands(dense, 0).agg(F.max("island"), F.count(F.lit(1))).first() == (1, 20_000)
    counted = intervals.overlap_count(dense, dense.select("chrom", F.col("start").alias("start2"), F.col("end").alias("end2")))
    assert counted.count() == 20_000 and counted.agg(F.min("n"), F.max("n")).first()[0] == 2000
    rows = dense.withColumn("_at", F.lit(0)).repartitionByRange(8, "chrom", "start", "id")
    sizes = [r[1] for r in rows.groupBy(F.spark_partition_id()).count().collect()]
    assert max(sizes) <= 2 * sorted(sizes)[len(sizes) // 2]
    held = intervals.containment(dense)
    got = {r.id: r.contained for r in held.where("id < 70").collect()}
    first = {}
    for k in range(20_000):
        s, e = k % 10, k % 10 + k % 7
        first[s] = min(first.get(s, (0, 0)), (-e, k))
    for k in range(70):
        s, e = k % 10, k % 10 + k % 7
        before = max((-first[t][0] for t in first if t < s), default=-1)
        assert got[k] == (e <= (before if first[s][1] == k else max(before, -first[s][0]))), k


def test_regions_of_sequences_in_pieces(spark):
    from helixframe.sources import fasta

    rnd = random.Random(3)
    seqs = {"a": "".join(rnd.choices("ACGT", k=100)), "b": "AC", "e": ""}
    df = spark.createDataFrame(list(seqs.items()), "id string, seq string")
    asked = [(i, rnd.randrange(-5, 120), rnd.randrange(-5, 130)) for i in "aaaaaaaabbbe" for _ in range(4)] + [("z", 1, 5), ("a", 1, 100), ("a", 1, 100), ("a", 101, 105)]
    regions = spark.createDataFrame(asked, "id string, start long, end long")
    want = sorted((i, s, e, seqs[i][max(1, s) - 1 : max(0, e)] if e >= max(1, s) else "") for i, s, e in asked if i in seqs)
    for size in (7, 50, 1000):
        assert sorted((r.id, r.start, r.end, r.part) for r in fasta.fetch(df, regions, size).collect()) == want
