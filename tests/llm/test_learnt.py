"""Quality ranking and language identification: held-out results, and odd inputs."""

import math
import random
import zlib

import numpy as np
from helixframe.llm.langid import Classifier, fit as fit_lang, grams, identify_languages, presence
from helixframe.llm.quality import FEATURES, features, fit, keep_good, score_quality, train as train_quality

SF = "/root/testdata/sf0.1"


def out(d):
    return zlib.crc32(str(d).encode()) % 4 == 2


def test_ranking():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(600, len(FEATURES)))
    good = x[:, 2] + 0.1 * rng.normal(size=600) > -0.5
    r = fit(x, good)
    assert ((r.score(x) >= 0.7) == good).mean() > 0.93
    assert (fit(x, np.ones(600, bool)).score(x) >= 0.7 - 1e-12).all()


def test_quality_held_out(spark):
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    truth = {r.doc_id: r.quality for r in labels.collect()}
    rows = score_quality(docs, labels).collect()
    assert len(rows) == docs.count() and all(r.held_out == out(r.doc_id) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in rows)
    held = [(r.predicted, truth[r.doc_id]) for r in rows if r.held_out and r.doc_id in truth]
    assert np.mean([p == t for p, t in held]) > 0.97
    assert np.mean([p for p, t in held if t == 1]) > 0.98


def test_quality_edges(spark):
    docs = spark.createDataFrame([(1, None, "a"), (2, "", "b"), (3, "x", "c"), (None, "y " * 50_000, "d"), (3, "x", "c"), (4, "日本😀 ﷽", "e")], "doc_id long, text string, score string")
    labels = spark.createDataFrame([(1, 0), (3, 1), (None, 1), (4, None)], "doc_id long, quality int")
    assert score_quality(docs, labels).count() == 6 and score_quality(docs.limit(0), labels).collect() == []
    none = score_quality(docs, labels.limit(0)).collect()
    assert all(abs(r.score - 0.7) < 1e-9 for r in none)
    assert keep_good(docs, labels).columns == docs.columns
    assert features("a a a b")[7] == 0.5 and len(features("\n")) == len(FEATURES)


def test_languages_held_out(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    truth = {r.doc_id: r.lang for r in docs.select("doc_id", "lang").collect()}
    rows = identify_languages(docs).collect()
    assert len(rows) == len(truth) and all(r.held_out == out(r.doc_id) for r in rows)
    assert np.mean([r.lang_pred == truth[r.doc_id] for r in rows if r.held_out]) > 0.98


def test_language_edges(spark):
    docs = spark.createDataFrame([(1, "the cat sat", "en"), (4, "le chat noir", "fr"), (5, None, "fr"), (6, "", None), (7, "123 !!", "en"), (None, "the dog", "en"), (8, "le chien", None), (8, "le chien", None), (9, "x", "en")], "doc_id long, text string, lang string")
    got = [(r.doc_id, r.lang_pred) for r in identify_languages(docs).collect()]
    assert len(got) == 9 and (5, "und") in got and (6, "und") in got and (7, "und") in got and got.count((8, "fr")) == 2
    assert identify_languages(docs.limit(0)).collect() == []
    assert {r.lang_pred for r in identify_languages(docs.withColumn("lang", docs.lang.substr(9, 1)).na.replace("", None)).collect()} == {"und"}


def test_kernel_by_definition():
    """Scores equal those of presence kernels over explicit n-gram sets, Nystroem and ridge, computed step by step."""
    rnd = random.Random(1)
    words = {"en": ["the", "cat", "and", "dog", "sat"], "fr": ["le", "chat", "est", "noir", "dans"], "de": ["der", "hund", "ist", "grau", "und"]}
    rows = [(lang, i % 2 == 0, " ".join(rnd.choice(w) for _ in range(6))) for lang, w in words.items() for i in range(8)]
    asked = ["the dog sat", "der chat", "le noir hund", "x"]
    model = fit_lang([(lang, mark, presence(t)) for lang, mark, t in rows], ridge=1e-2)

    def sets(t):
        return {int(x) for g in grams(t) for x in g}

    def k(a, b):
        a, b = sets(a), sets(b)
        return len(a & b) / np.sqrt(max(1, len(a)) * max(1, len(b)))

    marks = [t for _, mark, t in rows if mark]
    k_mm = np.array([[k(a, b) for b in marks] for a in marks])
    value, vector = np.linalg.eigh(k_mm)
    root = vector[:, value > 1e-8 * value.max()] / np.sqrt(value[value > 1e-8 * value.max()])
    phi = np.array([[k(t, m) for m in marks] for _, _, t in rows]) @ root
    langs = sorted(words)
    y = np.array([[1.0 if lang == x else -1.0 for x in langs] for lang, _, _ in rows])
    a = np.linalg.solve(phi.T @ phi + 1e-2 * len(rows) * np.eye(phi.shape[1]), phi.T @ y)
    f = np.array([[k(t, m) for m in marks] for t in asked]) @ root @ a
    e = np.exp(4 * (f - f.max(1, keepdims=True)))
    pred, score = model.predict(asked)
    assert pred == [langs[i] for i in f.argmax(1)]
    assert np.allclose(score, e.max(1) / e.sum(1), atol=1e-4)


def test_letters_and_long_texts(spark):
    docs = spark.createDataFrame([(1, "the cat sat", "en"), (4, "le chat noir", "fr"), (2, "\u00b2 \u00bd \u2460 \u2167", "en"), (3, "\u01c5", None), (5, "the cat " * 200_000, None), (6, "7" * 500_000, None)], "doc_id long, text string, lang string")
    got = {r.doc_id: (r.lang_pred, r.score) for r in identify_languages(docs).collect()}
    assert got[2] == ("und", 0.0) and got[6][0] == "und" and got[3][0] != "und" and got[5][0] == "en"


def test_ranking_by_definition(spark):
    """The ranking is where the gradient of the logistic loss vanishes, and the query's scores follow from it."""
    rng = np.random.default_rng(3)
    x = rng.normal(size=(40, len(FEATURES)))
    good = x[:, 1] + 0.3 * rng.normal(size=40) > 0
    r = fit(x, good, ridge=1e-3)
    up, down = np.flatnonzero(good), np.flatnonzero(~good)
    m = 8 * max(len(up), len(down))
    z = np.clip((x - x.mean(0)) / x.std(0), -8, 8)
    total = np.zeros(len(FEATURES))
    for i in range(m):
        d = z[up[i % len(up)]] - z[down[(i + i // len(up) + i // len(down)) % len(down)]]
        total += d * (1 - 1 / (1 + math.exp(-float(d @ r.weight))))
    assert np.abs(total / m - 1e-3 * r.weight).max() < 1e-6
    assert sum(float(u) <= r.cut for u in z @ r.weight) == len(down)
    sf = "/root/testdata/sf0.001"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    own = train_quality(docs, labels)
    texts = {d.doc_id: d.text for d in docs.collect()}
    for row in score_quality(docs, labels).collect():
        u = sum(w * min(8, max(-8, (f - c) / s)) for w, f, c, s in zip(own.weight, features(texts[row.doc_id]), own.centre, own.spread, strict=True))
        want = 1 / (1 + math.exp(-(u - own.cut + math.log(0.7 / 0.3))))
        assert abs(row.score - want) < 1e-9 and row.predicted == (row.score >= 0.7)


def test_ranking_does_not_depend_on_layout(spark):
    sf = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    a = train_quality(docs, labels, sample=50)
    b = train_quality(docs.repartition(7, "lang"), labels.repartition(5), sample=50)
    assert np.allclose(a.weight, b.weight) and a.cut == b.cut


def test_keep_good_with_clashing_names(spark):
    docs = spark.createDataFrame([(1, "some plain words here", 0.5, "q"), (2, "!!! ### $$$", 0.1, None)], "doc_id long, TEXT string, _score double, _score_ string")
    labels = spark.createDataFrame([(1, 1), (2, 0)], "doc_id long, quality int")
    kept = keep_good(docs, labels)
    assert kept.columns == docs.columns and kept.dtypes == docs.dtypes and all(r._score in (0.5, 0.1) for r in kept.collect())


def test_kernel():
    # the folded weights give what the kernel against each landmark gives
    texts = ["the cat sat on the mat", "a dog in the fog", "le chat est noir", "un chien dans la brume"]
    rows = [(l, True, presence(t)) for l, t in zip(["en", "en", "fr", "fr"], texts, strict=True)]
    model = fit_lang(rows, ridge=1e-6)
    assert model.predict(texts)[0] == ["en", "en", "fr", "fr"] and isinstance(model, Classifier)
    assert sum(len(g) for g in grams("abcd")) == 4 + 3 + 2 + 1


def test_grams_stand_for_substrings():
    """Every n-gram of the lower-case text, repeats included, has a bucket of its own kind: the same wherever it stands, and hardly ever another's."""
    bucket = {}
    for text in ["The cat sat on the mat", "le chat noir était là", "日本語の文章 です", "aaaa bbbb", "THE CAT!"]:
        low = text.lower()
        for n, found in enumerate(grams(text), 1):
            own = [low[i : i + n] for i in range(len(low) - n + 1)]
            assert len(own) == len(found)
            for g, x in zip(own, found.tolist(), strict=True):
                assert bucket.setdefault(g, x) == x
    assert len(set(bucket.values())) > 0.98 * len(bucket)
    assert [len(g) for g in grams("ab")] == [2, 1] and list(grams("")) == []


def test_features_by_definition():
    """Plain loops over an ASCII text."""
    for text in ["The CAT sat,  sat on 12 mats.\n\nThe end!! -- --\nThe end!! -- --\n", "a", "x y x y x y\n", "!!!"]:
        words, lines = text.split(), [x for x in text.split("\n") if x]
        letters = max(1, sum(c.isalpha() for c in text))
        symbol = [not c.isalnum() and not c.isspace() for c in text]
        total = max(1, len(words))
        often = {w: words.count(w) for w in words}
        ends = {w[-1]: sum(v[-1] == w[-1] for v in words) for w in words if not w[-1].isalnum()}
        want = [
            math.log(1 + len(text)), sum(not c.isspace() for c in text) / total, sum(c.isupper() for c in text) / letters, sum(symbol) / len(text), sum(c.isdigit() for c in text) / len(text), sum(c.isspace() for c in text) / len(text),
            sum(a and b for a, b in zip(symbol, symbol[1:], strict=False)) / total, sum(a == b for a, b in zip(words, words[1:], strict=False)) / total, math.log(max(1, len(often))) / math.log(total + 1), max(often.values(), default=0) / (total + 10),
            1 - len(set(lines)) / max(1, len(lines)), math.log(1 + total / max(1, len(lines))), sum(not any(c.isalnum() for c in w) for w in words) / total, sum(len(w) <= 3 for w in words) / total, max(ends.values(), default=0) / (total + 5), sum(w[0].isupper() for w in words) / (total + 5),
        ]
        assert np.allclose(features(text), want), text
