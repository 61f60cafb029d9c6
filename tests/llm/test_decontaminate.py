import random

import numpy as np
from helixframe.llm.decontaminate import Lookup, contaminated, embed, item_words, table_keys


def test_edges(spark):
    item = "Alpha beta, gamma delta epsilon zeta eta theta iota kappa"
    low = "alpha beta gamma delta epsilon zeta eta theta iota kappa"
    docs = [(1, f"x y z {low} q r"), (2, None), (3, ""), (4, low.upper()), (5, low.replace("gamma", "other")), (6, "a b c " * 3000 + low), (None, low), (7, " ".join(low.split()[:9])), (8, "nothing to see here at all, honest, no"), (1, low), (9, low.replace("gamma", "x").replace("eta ", "y ").replace("iota", "q"))]
    df = spark.createDataFrame([(d, t, 1) for d, t in docs], "doc_id long, text string, item_id int")
    bench = spark.createDataFrame([(1, item, "k"), (2, None, "k"), (3, "too short", "k"), (None, item, "k")], "item_id long, text string, doc_id string")
    got = {(r.doc_id, r.item_id): (r.distance, r.start_word) for r in contaminated(df, bench).collect()}
    assert got == {(1, 1): (0, 0), (4, 1): (0, 0), (5, 1): (1, 0), (6, 1): (0, 9000), (7, 1): (1, 0)}
    assert contaminated(df.limit(0), bench).collect() == [] and contaminated(df, bench.limit(0)).collect() == []


def test_recall():
    """Items of 14 to 60 words with as many word edits as are allowed: a sampled key is shared."""
    rnd = random.Random(1)
    met = total = 0
    for _ in range(300):
        n = rnd.randrange(14, 61)
        item = [rnd.randrange(7000) for _ in range(n)]
        seq = list(item)
        for _ in range(int(0.15 * n)):
            at = rnd.randrange(len(seq))
            kind = rnd.randrange(4)
            if kind == 0:
                del seq[at]
            elif kind == 1:
                seq.insert(at, -1)
            else:
                seq[at] = -1
        seq = (seq + [-1] * n)[:n]
        total += 1
        met += any(a[0] == a[1] for a in table_keys(np.array([item, seq], np.int64)))
    assert met / total >= 0.95
    same = embed(np.array([[1, 2, 3], [1, 2, 3]], np.int64), 2, 5)
    assert (same[:, :, 0] == same[:, :, 1]).all()


def test_words_by_hash():
    """The vectorised words are those of ``item_words``, over all kinds of characters."""
    rnd = random.Random(3)
    pool = ["Alpha", "beta,", "(gamma)", "_x_", "--", "...", "l'été", "ΟΔΟΣ", "İstanbul", "x\u00a0y", "日本", "\ud800", "a_b", "²", "\x1c", "İ", "ǅ", "a-b", "\u2028"]
    texts = ["", " ", "...", *("".join(rnd.choice(pool) + rnd.choice([" ", "  ", "\n", "\t", "", "\u3000"]) for _ in range(rnd.randrange(1, 60))) for _ in range(200))]
    known = {w: k for k, w in enumerate(sorted({w for t in texts[::2] for w in item_words(t)}))}
    for got, text in zip(Lookup(known).ids(texts), texts, strict=True):
        assert got.tolist() == [known.get(w, -1) for w in item_words(text)], repr(text)
    long = " ".join(texts) * 1500
    assert len(long) > 1 << 22
    assert Lookup(known).ids([long])[0].tolist() == [known.get(w, -1) for w in item_words(long)]


def test_whole_table(spark):
    sf = "/root/testdata/sf0.01"
    docs, bench = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/benchmark.parquet")
    got = {(r.doc_id, r.item_id): r.distance for r in contaminated(docs, bench).collect()}

    def distance(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            last, row[0] = row[0], i
            for j, y in enumerate(b, 1):
                last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
        return row[-1]

    items = {r.item_id: item_words(r.text) for r in bench.collect()}
    want = {}
    for r in docs.collect():
        w = item_words(r.text)
        for i, item in items.items():
            n, own = len(item), set(item)
            odd = np.cumsum([0] + [x not in own for x in w])
            for at in range(max(0, len(w) - n + 1)):
                if odd[at + n] - odd[at] <= int(0.15 * n):
                    d = distance(w[at : at + n], item)
                    if d <= int(0.15 * n):
                        want[r.doc_id, i] = min(d, want.get((r.doc_id, i), 99))
    assert {k for k, d in want.items() if d == 0} <= set(got)
    assert len(set(want) & set(got)) >= 0.95 * len(want) and all(want.get(k, got[k]) == got[k] for k in got)
    assert len(want) > 5


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def edited(rnd, n):
    """An item of n words, and a window of it after as many edits as are allowed."""
    item = [rnd.randrange(7000) for _ in range(n)]
    seq = list(item)
    for _ in range(int(0.15 * n)):
        at = rnd.randrange(len(seq))
        kind = rnd.randrange(4)
        if kind == 0:
            del seq[at]
        elif kind == 1:
            seq.insert(at, -1)
        else:
            seq[at] = -1
    return item, (seq + [-1] * n)[:n]


def test_recall_of_long_items():
    rnd = random.Random(4)
    for n in (61, 100, 200, 400, 800, 1000):
        pairs = np.array([x for _ in range(100) for x in edited(rnd, n)], np.int64)
        met = np.zeros(100, bool)
        for key in table_keys(pairs):
            met |= key[::2] == key[1::2]
        assert met.mean() >= 0.95, n


def test_long_and_short_items(spark):
    rnd = random.Random(6)
    word = lambda k: f"w{k}" if k >= 0 else "odd"
    pairs = [edited(rnd, 700) for _ in range(20)]
    docs = [(i, " ".join(map(word, seq))) for i, (_, seq) in enumerate(pairs)]
    docs += [(100, "see: Who wrote the Odyssey? and who wrote the odyssey"), (101, "who wrote an odyssey"), (102, "the"), (103, "who wrote the")]
    items = [(i, " ".join(map(word, item))) for i, (item, _) in enumerate(pairs)] + [(50, "Who wrote the Odyssey?"), (51, "who wrote the odyssey"), (52, "!?")]
    got = {(r.doc_id, r.item_id): (r.distance, r.start_word) for r in contaminated(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()}
    short = {k: v for k, v in got.items() if k[0] >= 100}
    assert short == {(100, 50): (0, 1), (100, 51): (0, 1)}
    # a window that lost its end to insertions may be farther than allowed
    want = {(i, i) for i, (item, seq) in enumerate(pairs) if distance(item, seq) <= 105}
    found = {k for k in got if k[0] < 100}
    assert found <= want and len(found) >= 0.95 * len(want) and len(want) >= 10
