import math
import random
import re
from collections import Counter

import numpy as np
import pytest
from helixframe.llm import lexical
from helixframe.llm.lexical import RangeMaxima, _Queries, _Top, best_first, rank_documents
from helixframe.llm.queries import ORACLES, QUERIES
from oracle import rows_of, rows_of_sql

TERM = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")


def terms_of(text):
    return TERM.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def brute(docs, items, keep=20):
    own = [(d, Counter(t)) for d, x in docs if (t := terms_of(x))]
    total = sum(sum(c.values()) for _, c in own)
    df = Counter(t for _, c in own for t in c)
    out = []
    for i, x in items:
        q = Counter(terms_of(x))
        found = []
        for d, c in own:
            m = 75 + (25 * sum(c.values()) * len(own)) // total
            s = sum(k * math.floor(1000 * math.log((2 * len(own) + 2) / (2 * df[t] + 1))) * ((10**9 * c[t]) // (1000 * c[t] + 12 * m)) for t, k in q.items() if t in c)
            if s:
                found.append((-s, d is None, d or 0))
        out += [(i, k, None if none else d, -s) for k, (s, none, d) in enumerate(sorted(found)[:keep], 1)]
    return sorted(out, key=repr)


def run(docs, items, **more):
    return sorted((tuple(r) for r in rank_documents(docs, items, **more).select("item_id", "rank", "doc_id", "score").collect()), key=repr)


def test_range_maxima():
    rnd = np.random.default_rng(1)
    term, place = np.nonzero(rnd.random((6, 200)) < np.array([0.9, 0.5, 0.1, 0.01, 0, 1.0])[:, None])
    impact = rnd.integers(0, 9, len(term))
    lists = RangeMaxima(200, 6, term, place, impact)
    for t in range(6):
        low, high = np.triu_indices(201, 1)
        got = lists.over(np.full(len(low), t), low, high)
        for a, b, g in list(zip(low, high, got, strict=True))[::37]:
            own = [(v, -p) for v, p in zip(impact[term == t], place[term == t], strict=True) if a <= p < b]
            assert g == (max(own)[0] << lexical.PLACE | ((1 << lexical.PLACE) - 1 + max(own)[1]) if own else 0)


def test_best_first_looks_at_few():
    """The first places are right although most documents are never scored."""
    rnd = np.random.default_rng(2)
    term, place = np.nonzero(rnd.random((10, 4000)) < 0.2)
    impact = (rnd.pareto(1.2, len(term)) * 1000).astype(np.int64)
    item = np.repeat(np.arange(3), 5)
    q = _Queries(item, np.r_[0:5, 3:8, 5:10], np.ones(15, np.int64))
    top, order = _Top(3, 20), rnd.permutation(4000)
    looked = best_first(RangeMaxima(4000, 10, term, place, impact), q, 4000, order, top)
    dense = np.zeros((10, 4000), np.int64)
    dense[term, place] = impact
    for k, own in enumerate((range(5), range(3, 8), range(5, 10))):
        score = dense[list(own)].sum(axis=0)
        want = np.lexsort((order, -score))[:20]
        assert (top.found[1][top.found[0] == k] == score[want]).all() and (top.found[2][top.found[0] == k] == order[want]).all()
    assert looked < 3 * 4000 / 3


@pytest.mark.parametrize("cells", [{}, {"cell_items": 2, "cell_docs": 30}])
def test_against_brute_force(spark, cells):
    rnd = random.Random(3)
    words = ["alpha", "Beta", "gamma", "é1", "ÉX", "q", "7", "zz", "漢字"]
    docs = [(k, " ".join(rnd.choices(words, [30, 10, 5, 3, 2, 2, 1, 1, 1], k=rnd.randrange(1, 40)))) for k in range(150)]
    docs += [(k, "alpha alpha zz") for k in range(500, 560)] + [(500, "alpha alpha zz"), (None, "alpha alpha zz"), (None, "漢字"), (700, None), (701, ""), (702, " -_- "), (703, "zz " * 100_000), (704, "a\x00b-zz")]
    items = [(1, "Alpha BETA gamma"), (2, "zz zz 漢字 zz"), (3, None), (4, ""), (5, "unseen words"), (1, "q 7"), (None, "ÉX é1"), (8, "a b"), (9, "alpha")]
    rnd.shuffle(docs)
    one = spark.createDataFrame([(d, t, 1, "x") for d, t in docs], "doc_id long, text string, item int, terms string").repartition(3)
    two = spark.createDataFrame([(i, t, 1) for i, t in items], "item_id long, text string, n int")
    assert run(one, two, **cells) == brute(docs, items)
    assert run(one.limit(0), two) == [] and run(one, two.limit(0)) == []


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_query(spark, sf):
    q = "op11_range_maximum_search"
    got = rows_of(QUERIES[q](spark, f"/root/testdata/{sf}"))
    assert got == rows_of_sql(ORACLES[q], f"/root/testdata/{sf}") and got[0]
