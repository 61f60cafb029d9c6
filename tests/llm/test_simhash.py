import random
import re

import numpy as np
import pytest
import xxhash
from helixframe.llm import simhash
from helixframe.llm.queries import QUERIES
from helixframe.llm.simhash import near_duplicates_by_fingerprint, spanning_links, vertical, within

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def print_of(text):
    w = WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    if not w:
        return 0
    h = [xxhash.xxh64_intdigest(" ".join(w[i : i + 3]).encode(), 42) for i in range(max(1, len(w) - 2))]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def parts_of(nodes, pairs):
    top = {n: n for n in nodes}

    def find(x):
        while top[x] != x:
            x = top[x]
        return x

    for a, b in pairs:
        a, b = find(a), find(b)
        top[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def brute(rows, radius=3):
    """One (doc_id, fingerprint, component) for each row."""
    own = [(d, print_of(t)) for d, t in rows]
    prints = sorted({f for d, f in own if d is not None})
    by = {f: min(d for d, g in own if d is not None and g == f) for f in prints}
    arr = np.array(prints, np.uint64)
    pairs = [(by[f], by[prints[j]]) for i, f in enumerate(prints) for j in np.flatnonzero(np.bitwise_count(arr ^ arr[i]) <= radius)]
    pairs += [(d, by[f]) for d, f in own if d is not None]
    found = parts_of({d for d, _ in own if d is not None}, pairs)
    return sorted(((d, f"{f:016x}", found.get(d)) for d, f in own), key=repr)


def run(df, **more):
    return sorted((tuple(r) for r in near_duplicates_by_fingerprint(df, **more).select("doc_id", "fingerprint", "component_id").collect()), key=repr)


@pytest.mark.parametrize("radius", [0, 1, 2, 3, 5, 8])
def test_bit_sliced_distances(radius):
    rnd = np.random.default_rng(radius)
    a = rnd.integers(0, 1 << 63, 300, dtype=np.uint64)
    a[100:200] = a[5] ^ (np.uint64(1) << rnd.integers(0, 64, 100).astype(np.uint64))
    q = a[::7]
    alive, mask = within(q, vertical(a), radius)
    got = np.zeros((len(q), 300), bool)
    got[alive] = np.unpackbits(mask.view(np.uint8), axis=1, bitorder="little")[:, :300]
    assert (got == (np.bitwise_count(q[:, None] ^ a) <= radius)).all()


@pytest.mark.parametrize("sides", [False, True])
def test_spanning_links_join_what_all_pairs_join(sides):
    rnd = np.random.default_rng(4)
    seeds = rnd.integers(0, 1 << 63, 12, dtype=np.uint64)
    a = np.unique(np.concatenate([s ^ np.bitwise_or.reduce(np.uint64(1) << rnd.integers(0, 64, (n, 3)).astype(np.uint64), axis=1) for s, n in zip(seeds, [700, 300, *[5] * 10], strict=True)]))
    rnd.shuffle(a)
    n = len(a)
    side = rnd.integers(0, 2, n) if sides else None
    close = np.bitwise_count(a[:, None] ^ a) <= 3
    if sides:
        close &= side[:, None] != side
    pairs = spanning_links(a, 3, None, side)
    assert close[pairs[:, 0], pairs[:, 1]].all() and len(pairs) < n
    assert parts_of(range(n), pairs.tolist()) == parts_of(range(n), np.argwhere(close).tolist())


def test_edges(spark):
    rows = [(5, None), (6, ""), (7, " \t\n"), (8, "one two"), (9, "ONE  two"), (10, "É a"), (11, "é a"), (12, "w " * 9), (13, "w " * 200_000), (None, "one two"), (None, None), (8, "p q r s t u"), (20, "P q r s t u"), (20, "P q r s t u"), (21, "zero\x1cone two")]
    df = spark.createDataFrame([(d, t, 1, "x") for d, t in rows], "doc_id long, text string, component_id int, fp string")
    assert run(df) == brute(rows)
    assert run(df.limit(0)) == []


def family(rnd, n, words):
    base = [f"w{rnd.randrange(10**6)}" for _ in range(words)]
    out = []
    for _ in range(n):
        w = list(base)
        for _ in range(rnd.randrange(0, 6)):
            w[rnd.randrange(len(w))] = f"x{rnd.randrange(10**6)}"
        out.append(" ".join(w))
    return out


@pytest.mark.parametrize("small", [{}, {"part": 16, "divide": 10**6}, {"part": 16, "divide": 32}])
def test_families(spark, small, monkeypatch):
    """Large families of near copies, in one part, in many parts, and divided by further bits."""
    rnd = random.Random(8)
    texts = [*family(rnd, 250, 300), *family(rnd, 80, 40), *(" ".join(f"v{rnd.randrange(10**6)}" for _ in range(30)) for _ in range(100)), *["same text here"] * 50]
    rnd.shuffle(texts)
    rows = [(3 * k + 1, t) for k, t in enumerate(texts)]
    assert run(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), **small) == brute(rows)


def test_whole_table(spark):
    sf = "/root/testdata/sf0.01"
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    got = QUERIES["op12_bit_sliced_simhash"](spark, sf)
    assert sorted((tuple(r) for r in got.select("doc_id", "fingerprint", "component_id").collect()), key=repr) == brute(rows)
    assert simhash.fingerprint("a b c d") == print_of("a b c d")
