"""Gapped extension beside full dynamic programming, adapters, coverage cuts beside a plain loop, region queries that skip files."""

import random

import numpy as np
import pytest
from helixframe.operators import cuts, extend
from helixframe.sources import regions
from pyspark.sql import functions as F


def altered(rnd, s, rate):
    out = []
    for c in s:
        x = rnd.random()
        if x < rate / 3:
            out.append(rnd.choice("ACGT".replace(c, "")))
        elif x < 2 * rate / 3:
            out += [c, rnd.choice("ACGT")]
        elif x >= rate:
            out.append(c)
    return "".join(out)


def full(a, b, match=2, mismatch=-3, gap=-4):
    """The best score of prefixes of both."""
    row = [gap * j for j in range(len(b) + 1)]
    best = max(row)
    for i in range(1, len(a) + 1):
        new = [gap * i]
        for j in range(1, len(b) + 1):
            new.append(max(row[j - 1] + (match if a[i - 1] == b[j - 1] else mismatch), row[j] + gap, new[-1] + gap))
        row = new
        best = max(best, *row)
    return best


@pytest.mark.parametrize("seed", range(30))
def test_extension_is_full_dynamic_programming(seed):
    rnd = random.Random(seed)
    a = "".join(rnd.choices("ACGT", k=rnd.randrange(0, 60)))
    b = altered(rnd, a, rnd.choice([0, 0.1, 0.5, 1.0])) + "".join(rnd.choices("ACGT", k=rnd.randrange(5)))
    assert extend.greedy_extension(a, b, 10**6)[0] == full(a, b)
    long = "".join(rnd.choices("ACGT", k=150))
    copy = altered(rnd, long, 0.1)
    score, i, j, d = extend.greedy_extension(long, copy)
    assert score == full(long, copy) == (i + j) - 5 * d


def test_similar(spark):
    rnd = random.Random(2)
    base = {k: "".join(rnd.choices("ACGT", k=200)) for k in range(12)}
    queries = {k: "".join(rnd.choices("ACGT", k=15)) + altered(rnd, base[k], 0.06) for k in range(0, 12, 2)}
    q = spark.createDataFrame([*queries.items(), (99, None), (98, "ACG"), (97, "N" * 80)], "id long, seq string")
    t = spark.createDataFrame(list(base.items()), "id long, seq string")
    got = {(r.query, r.target): r for r in extend.similar(q, t).collect()}
    assert set(got) == {(k, k) for k in queries}
    for (k, _), r in got.items():
        a, b = queries[k][r.q_start : r.q_end], base[k][r.t_start : r.t_end]
        assert r.score == len(a) + len(b) - 5 * r.differences and r.t_end - r.t_start > 180
    assert extend.similar(q.limit(0), t).collect() == []


def plain_adapter(read, adapter, match=1, mismatch=-2, gap=-2):
    best = 0
    row = [0] * (len(read) + 1)
    for c in adapter:
        new = [row[0] + gap]
        for j in range(1, len(read) + 1):
            new.append(max(row[j - 1] + (match if read[j - 1] == c else mismatch), row[j] + gap, new[-1] + gap))
        row = new
        best = max(best, row[-1])
    return max(best, *row)


def test_adapters(spark):
    rnd = random.Random(6)
    adapter = "AGATCGGAAGAGC"
    reads = ["", "A", adapter, adapter[:5], "ACGTNACGT" + adapter[:9], "TTTTGGGG" + adapter[:6] + adapter[7:] + "CC", "TTTTGGGG" + adapter[:6] + "T" + adapter[6:] + "CC", "CCCCCCCC" + "AGATCGGTAGAGC"]
    reads += ["".join(rnd.choices("ACGTN", k=rnd.randrange(40))) + altered(rnd, adapter, 0.2)[: rnd.randrange(3, 14)] for _ in range(60)]
    place, score = extend.adapter_places(reads, adapter)
    assert score.tolist() == [plain_adapter(r, adapter) for r in reads]
    assert place[:8].tolist() == [0, 0, 0, 0, 9, 8, 8, 8]
    df = spark.createDataFrame([("TTTTGGGG" + adapter,), ("TTTTCCCC",), (None,), ("",)], "s string")
    assert [r.p for r in df.select(extend.adapter_start(F.col("s"), adapter).alias("p")).collect()] == [8, 8, None, 0]


def plain_cuts(cov, first, w, threshold):
    sink = source = None
    for i in range(len(cov) - 2 * w + 1):
        a, b = sorted(cov[i : i + w]), sorted(cov[i + w : i + 2 * w])
        x, y = sum(a), sum(b)
        chi = 0.0
        for p, q in zip(a, b, strict=True):
            if p + q:
                chi += p / ((p + q) / (x + y) * x) - 1 if x else 0
                chi += q / ((p + q) / (x + y) * y) - 1 if y else 0
        if chi <= threshold or x == y:
            continue
        if x > y and (sink is None or (x - y) / w > sink[0]):
            sink = ((x - y) / w, first + i + w - 1)
        if y > x and (source is None or (y - x) / w > source[0]):
            source = ((y - x) / w, first + i + w)
    return sink, source


@pytest.mark.parametrize(("window", "block"), [(5, 7), (10, 64), (10, 8192)])
def test_cuts_beside_a_plain_loop(spark, window, block):
    rnd = random.Random(window)
    rows, want = [], {}
    for key in range(25):
        level, cov = rnd.randrange(1, 30), []
        for _ in range(rnd.randrange(2 * window - 2, 150)):
            if rnd.random() < 0.04:
                level = rnd.randrange(0, 60)
            cov.append(max(0, level + rnd.randrange(-3, 4)))
        cov[0], cov[-1] = 1, 1
        first = rnd.randrange(-50, 1000)
        rows += [(key, first + k, float(c)) for k, c in enumerate(cov) if c]
        if len(cov) >= 2 * window:
            want[key] = plain_cuts(cov, first, window, 1.0)
    df = spark.createDataFrame([*rows, (None, 3, 1.0), (3, None, 1.0)], "key long, pos long, cov double")
    got = {r.key: (None if r.sink_end is None else (r.sink_drop, r.sink_end), None if r.source_start is None else (r.source_rise, r.source_start)) for r in cuts.coverage_cuts(df, window, 1.0, block).collect()}
    assert set(got) == set(want)
    for k in want:
        for g, w in zip(got[k], want[k], strict=True):
            assert (g is None) == (w is None) and (g is None or (abs(g[0] - w[0]) < 1e-9 and g[1] == w[1])), (k, got[k], want[k])


def test_regions_open_only_their_files(spark, tmp_path):
    rnd = random.Random(1)
    rows = [(k, rnd.choice("aab"), s := rnd.randrange(10**6), s + rnd.choice([5, 50, 3000])) for k in range(5000)]
    df = spark.createDataFrame([*rows, (7, "a", 10, 20), (7, "a", 10, 20)], "id long, chrom string, start long, end long")
    path = str(tmp_path / "t")
    regions.write_clustered(df, path, 20)
    asked = spark.createDataFrame([("a", 1000, 9000), ("a", 5000, 12000), ("b", 500_000, 500_100), ("z", 1, 10**9)], "chrom string, start long, end long")
    opened = regions.files_of(spark, path, asked)
    assert 2 <= len(opened) <= 4
    got = regions.read_regions(spark, path, asked)
    assert len(got.inputFiles()) == len(opened)
    want = sorted((i, c, s, e) for i, c, s, e in [*rows, (7, "a", 10, 20), (7, "a", 10, 20)] if any(c == d and s <= f and t <= e for d, t, f in [("a", 1000, 9000), ("a", 5000, 12000), ("b", 500_000, 500_100)]))
    assert sorted(tuple(r) for r in got.collect()) == want
    assert regions.read_regions(spark, path, asked.where("chrom = 'z'")).collect() == []
