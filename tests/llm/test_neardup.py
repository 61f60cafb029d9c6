import random
import re

import pytest
from helixframe.llm.neardup import near_duplicates

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(docs):
    """Components over exact shingle sets of words; {doc_id: (size, component)}."""
    sets = {}
    for d, t in docs.items():
        w = WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))
        sets[d] = {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()
    top = {d: d for d in docs}

    def find(x):
        while top[x] != x:
            x = top[x]
        return x

    holds = {}
    for d, s in sets.items():
        for g in s:
            holds.setdefault(g, []).append(d)
    for d, s in sets.items():
        shared = {}
        for g in s:
            for e in holds[g]:
                if e < d:
                    shared[e] = shared.get(e, 0) + 1
        for e, n in shared.items():
            if 100 * n >= 75 * (len(s) + len(sets[e]) - n):
                a, b = find(d), find(e)
                top[max(a, b)] = min(a, b)
    return {d: (len(sets[d]), find(d)) for d in docs}


def test_edges(spark):
    docs = {5: None, 6: "", 7: " \t\n", 8: "one two", 9: "ONE  two", 10: "one two three", 11: "É a b c d", 12: "é a b c d", 13: "w " * 9, 14: "w " * 5000, 15: "a b c d e f g h i j", 16: "a b c d e f g h i j k", 17: "zero\x1cone two"}
    df = spark.createDataFrame([(k, v, 1, "x") for k, v in docs.items()], "doc_id long, text string, component_id int, half string")
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in near_duplicates(df).collect()}
    assert got == brute(docs)
    assert near_duplicates(df.limit(0)).collect() == []
    odd = spark.createDataFrame([(None, "a b c d e f"), (None, "a b c d e f"), (3, "a b c d e f"), (3, "a b c d e f"), (1, "a b c d e f"), (7, "q r s")], "doc_id long, text string")
    got = sorted(((r.doc_id or -1), r.component_id or -1, r.kept) for r in near_duplicates(odd).collect())
    assert got == [(-1, -1, True), (-1, -1, True), (1, 1, True), (3, 1, False), (3, 1, False), (7, 7, True)]


@pytest.mark.parametrize("sizes", [False, True])
def test_family_without_a_middle(spark, sizes):
    """Copies of one text with many edits each: chains, outliers, and partners below no common leader."""
    rnd = random.Random(3)
    base = [f"w{rnd.randrange(10**6)}" for _ in range(150)]
    docs, kept = {}, [base]
    for d in range(300):
        w = list(rnd.choice(kept if rnd.random() < 0.3 else [base]))
        for _ in range(rnd.randrange(1, 12)):
            at = rnd.randrange(len(w))
            if sizes and rnd.random() < 0.5:
                del w[at : at + rnd.randrange(1, 3)]
            else:
                w[at] = f"x{rnd.randrange(10**6)}"
        kept.append(w)
        docs[d] = " ".join(w)
    df = spark.createDataFrame(list(docs.items()), "doc_id long, text string")
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in near_duplicates(df).collect()} == brute(docs)


def test_whole_table(spark):
    df = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    docs = {r.doc_id: r.text for r in df.collect()}
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in near_duplicates(df).collect()}
    assert got == brute(docs)


@pytest.mark.parametrize("turn", [False, True])
def test_rows_that_share_an_id(spark, turn):
    """All texts of a doc_id count, in whatever order the rows come."""
    a, b = " ".join(f"a{i}" for i in range(40)), " ".join(f"b{i}" for i in range(40))
    rows = [(5, a), (5, b), (7, a + " x"), (9, b + " y"), (5, b.upper())]
    df = spark.createDataFrame(rows[::-1] if turn else rows, "doc_id long, text string").coalesce(1)
    assert sorted({(r.doc_id, r.component_id) for r in near_duplicates(df).collect()}) == [(5, 5), (7, 5), (9, 5)]


def test_family_with_a_common_private_line(spark):
    """Documents of one template, half of them with a line of their own kind: few pairs, right components."""
    rnd = random.Random(9)
    body, line = [f"t{i}" for i in range(60)], [f"l{i}" for i in range(12)]
    docs = {d: " ".join([*body, *(line if d % 2 else []), *(f"u{rnd.randrange(10**9)}" for _ in range(rnd.choice([6, 12, 30])))]) for d in range(300)}
    df = spark.createDataFrame(list(docs.items()), "doc_id long, text string")
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in near_duplicates(df).collect()} == brute(docs)
