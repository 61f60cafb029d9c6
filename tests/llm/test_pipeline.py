import re

import corpus_pipeline as P
from pyspark.sql import functions as F

SF = "/root/testdata/sf0.01"


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    columns = docs.columns
    good = P.quality(spark, docs, SF).cache()
    ids = {r.doc_id for r in good.select("doc_id").collect()}
    assert good.columns == columns
    assert sum(q == 1 for d, q in labels.items() if d in ids) >= 0.98 * sum(labels.values())
    assert sum(q == 0 for d, q in labels.items() if d in ids) <= 0.1 * sum(q == 0 for q in labels.values())

    import sys, os

    sys.path.insert(0, os.path.dirname(__file__))
    from test_neardup import brute

    groups = brute({r.doc_id: r.text for r in good.collect()})
    one = P.near_duplicate(spark, good, SF).cache()
    assert one.columns == columns
    assert {r.doc_id for r in one.collect()} == {d for d, (_, top) in groups.items() if d == top}

    from helixframe.llm.decontaminate import item_words

    clean = P.decontamination(spark, one, SF).cache()
    items = [" ".join(item_words(r.text)) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    left = {r.doc_id: f" {' '.join(item_words(r.text))} " for r in clean.collect()}
    gone = {r.doc_id: f" {' '.join(item_words(r.text))} " for r in one.collect() if r.doc_id not in left}
    assert clean.columns == columns and gone
    assert not any(f" {i} " in t for t in left.values() for i in items)
    # what goes holds nearly all words of an item
    assert all(any(len(set(i.split()) & set(t.split())) >= 0.8 * len(set(i.split())) for i in items) for t in gone.values())

    masked = P.secrets(spark, clean, SF).cache()
    assert masked.columns == columns and masked.count() == clean.count()
    for r in masked.collect():
        assert r.n_chars == len(r.text) and not re.search("AKIA[A-Z0-9]{12,}|[0-9a-f]{32,}", r.text)

    rows = P.packing(spark, masked, SF).groupBy("sequence_id").agg(F.sum("length").alias("n")).collect()
    assert all(r.n <= 1024 for r in rows) and sum(r.n for r in rows) > 0.95 * 1024 * len(rows)


def test_run_and_empty(spark, tmp_path):
    assert P.run(spark, "/root/testdata/sf0.001").count() > 0
    schema = spark.read.parquet(f"{SF}/documents.parquet").schema
    for name in ("labels", "benchmark"):
        spark.read.parquet(f"{SF}/{name}.parquet").write.parquet(f"{tmp_path}/{name}.parquet")
    spark.createDataFrame([], schema).write.parquet(f"{tmp_path}/documents.parquet")
    assert P.run(spark, str(tmp_path)).collect() == []
    odd = spark.createDataFrame([(None, "a b c d e f", None, None, None), (1, None, "en", "s", 0), (1, None, "en", "s", 0)], schema)
    kept = P.near_duplicate(spark, odd, SF)
    assert sorted(str(r.doc_id) for r in kept.collect()) == ["1", "None"]
    twice = spark.createDataFrame([(1, "b b b", "en", "s", 5), (1, "a a a", "en", "s", 5), (1, "a a a", "en", "s", 5), (2, "a a a", "en", "s", 5)], schema)
    assert sorted(r.text for r in P.near_duplicate(spark, twice, SF).collect()) == ["a a a", "b b b"]


def test_rows_without_doc_id(spark):
    """They are told apart, deduplicated and decontaminated like others."""
    schema = spark.read.parquet(f"{SF}/documents.parquet").schema
    passage = max((r.text for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()), key=len)
    rows = [(None, "p q r s t u v w"), (None, "p q r s t u v w"), (None, "quite another text of six words"), (7, "P q r s t u v w"), (None, None), (None, None), (8, "one text of five words here"), (8, "none of those words in it")]
    docs = spark.createDataFrame([(d, t, "en", "s", 1) for d, t in rows], schema).withColumn("_row", F.lit(1))
    kept = P.near_duplicate(spark, docs, SF)
    assert kept.columns == docs.columns
    assert sorted((str(r.doc_id), r.text) for r in kept.collect() if r.text) == sorted([("7", rows[3][1]), ("None", rows[2][1]), ("8", rows[6][1]), ("8", rows[7][1])])
    assert kept.where("text is null").count() == 2
    leaks = spark.createDataFrame([(d, t, "en", "s", 1) for d, t in [(None, f"before {passage} after"), (5, f"x {passage}"), (5, "clean text"), (None, "clean as well"), (None, None), (None, "")]], schema).withColumn("_text", F.lit(1))
    clean = P.decontamination(spark, leaks, SF)
    assert clean.columns == leaks.columns
    assert sorted((str(r.doc_id), str(r.text)) for r in clean.collect()) == sorted([("5", "clean text"), ("None", "clean as well"), ("None", "None"), ("None", "")])
