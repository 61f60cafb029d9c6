import math
import random

import numpy as np
import pytest
from helixframe.llm.negatives import bit_planes, from_planes, mine_negatives, scores, subset_sums
from helixframe.llm.queries import ORACLES, QUERIES
from hypothesis import given, settings
from hypothesis import strategies as st
from oracle import rows_of, rows_of_sql
from pyspark.sql import functions as F

SCHEMA = "vec_id long, embedding array<float>, label int, rank int, row string"


def brute(rows, keep=5):
    own = [(k, i, lab, [math.floor(256 * x) for x in v]) for k, (i, v, lab) in enumerate(rows) if lab is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    order = lambda e: (-e[0], e[1] is None, e[1] or 0)
    out = []
    for k, i, lab, v in own:
        if i is None or i % 100:
            continue
        scored = [(sum(a * b for a, b in zip(v, w, strict=False)), j, lb) for q, j, lb, w in own if q != k]
        for p, pid, _ in sorted((e for e in scored if e[2] == lab), key=order)[:keep]:
            fit = sorted((e for e in scored if e[2] != lab and 80 * p <= 100 * e[0] <= 100 * p), key=order)[:keep]
            out += [(i, pid, r, nid, p, n) for r, (n, nid, _) in enumerate(fit, 1)]
    return sorted(out, key=repr)


def mined(df, **more):
    got = mine_negatives(df, F.col("vec_id") % 100 == 0, **more)
    return sorted((tuple(r) for r in got.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score").collect()), key=repr)


@settings(max_examples=60, deadline=None)
@given(st.integers(1, 30), st.integers(1, 40), st.integers(1, 27), st.integers(0, 10**6))
def test_lookups_equal_products(n, d, bits, seed):
    rnd = np.random.default_rng(seed)
    v = rnd.integers(-(1 << bits), (1 << bits) + 1, (n, d))
    code = bit_planes(v)
    back = from_planes(code)
    assert (back[:, :d] == v).all() and not back[:, d:].any()
    assert (scores(code, subset_sums(back, np.int64)) == v @ v.T).all()


def test_against_brute_force(spark):
    rnd = random.Random(5)
    rows = [(i, [rnd.choice([-1.5, -0.25, 0.001, 0.5, 2.0]) for _ in range(6)], rnd.randrange(3)) for i in range(0, 1200, 4)]
    rows += [(100, [0.5] * 6, 1), (100, [0.5] * 6, 1), (7, [2.0] * 6, 2), (7, [2.0] * 6, 2), (None, [2.0] * 6, 1), (900, [3.0, 1.0], 0), (9, [], 1), (600, [], 2)]
    rows += [(200, None, 1), (300, [1.0, None], 1), (400, [float("nan")] * 6, 1), (500, [float("inf")] * 6, 1), (700, [1.0] * 6, None), (1300, [1.0] * 6, 77)]
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], SCHEMA)
    assert mined(df) == brute(rows)
    assert mined(df, cell_anchors=3, cell_rows=50) == brute(rows)
    assert mined(df.repartition(7), cell_anchors=5, cell_rows=20) == brute(rows)


def test_large_components(spark):
    rnd = random.Random(2)
    rows = [(i * 50, [float(rnd.randrange(-30000, 30000)) for _ in range(9)], rnd.randrange(2)) for i in range(60)]
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], SCHEMA)
    assert mined(df) == brute(rows)
    beyond = spark.createDataFrame([(0, [1e30], 1, 1, "x"), (1, [1.0], 1, 1, "x"), (2, [1.0], 2, 1, "x")], SCHEMA)
    assert mined(beyond) == []


def test_empty_and_without_anchors(spark):
    df = spark.createDataFrame([(1, [1.0], 1, 1, "x"), (2, [1.0], 2, 1, "x")], SCHEMA)
    assert mined(df) == [] and mined(df.limit(0)) == []


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_query(spark, sf):
    q = "op13_four_russians_negatives"
    got = rows_of(QUERIES[q](spark, f"/root/testdata/{sf}"))
    assert got == rows_of_sql(ORACLES[q], f"/root/testdata/{sf}") and got[0]
