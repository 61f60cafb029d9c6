"""Cases that tell rules apart which agree on most rows."""

import pytest
from helixframe.functions import seq
from helixframe.operators import models, reads, transcripts
from helixframe.sources import gff
from pyspark.sql import functions as F

MODEL = "tid string, chrom string, strand string, exons array<struct<start:long,end:long>>"


@pytest.mark.parametrize(("query", "reference", "code"), [
    ([(98, 112)], [(1, 100), (201, 300)], "o"),
    ([(85, 112)], [(1, 100), (201, 300)], "e"),
    ([(50, 200), (300, 380)], [(100, 200), (300, 400), (500, 600)], "c"),
    ([(100, 200), (300, 404)], [(100, 200), (300, 400), (500, 600)], "j"),
    ([(100, 200), (300, 403)], [(100, 200), (300, 400), (500, 600)], "c"),
    ([(296, 400), (500, 560)], [(100, 200), (300, 400), (500, 600)], "j"),
    ([(297, 400), (500, 560)], [(100, 200), (300, 400), (500, 600)], "c"),
    ([(1, 100)], [(11, 400)], "c"),
    ([(92, 150)], [(100, 200), (301, 400)], "o"),
    ([(93, 150)], [(100, 200), (301, 400)], "c"),
    ([(210, 230), (240, 290)], [(100, 200), (300, 400)], "i"),
    ([(150, 220), (260, 310)], [(100, 200), (300, 400)], "o"),
    ([(1, 80)], [(41, 120)], "o"),
])
def test_class_codes_at_their_borders(spark, query, reference, code):
    r = transcripts.with_range(spark.createDataFrame([("R", "c", "+", reference)], MODEL))
    q = transcripts.with_range(spark.createDataFrame([("Q", "c", "+", query)], MODEL))
    assert transcripts.best_codes(q, r).first().code == code


def kept(spark, rows, **more):
    t = transcripts.with_range(spark.createDataFrame([(k, "c", "+", e) for k, e in rows.items()], "tid long, chrom string, strand string, exons array<struct<start:long,end:long>>"))
    return {(r.tid, r.keeper) for r in models.redundant(t, **more).collect()}


def test_redundant_models(spark):
    big = [(100, 200), (300, 420), (500, 900)]
    # runs through the other's first intron; one exon within an exon; one that reaches into an intron; more exons win over more bases
    rows = {1: big, 2: [(150, 420), (500, 600)], 3: [(310, 400)], 4: [(310, 430)], 5: [(300, 420), (500, 9000)]}
    assert kept(spark, rows) == {(3, 1)}
    assert kept(spark, {1: big, 2: [(310, 420), (500, 900)], 3: [(150, 200), (300, 400)]}) == {(2, 1), (3, 1)}
    assert kept(spark, {1: big, 2: [(90, 200), (300, 420)]}) == set()
    assert kept(spark, {1: big, 2: [(90, 200), (300, 420)]}, fuzzy=True) == {(2, 1)}
    assert kept(spark, {1: big, 2: [(290, 420), (500, 900)]}, fuzzy=True) == set()
    assert kept(spark, {1: [(1, 100)], 2: [(20, 110)]}) == set() and kept(spark, {1: [(1, 100)], 2: [(20, 110)]}, fuzzy=True) == {(2, 1)}
    assert kept(spark, {1: [(1, 100)], 2: [(20, 90)]}) == {(2, 1)}
    assert kept(spark, {1: big, 2: [(120, 200), (300, 420), (500, 800)], 3: [(310, 420), (500, 900)]}, all_introns=True) == {(2, 1)}
    assert kept(spark, {1: big, 2: big}) == {(2, 1)}


def test_flags_of_unpaired_rows(spark):
    df = spark.createDataFrame([(64, "a", "a", 9), (2, "a", "a", 9), (1 + 64, "a", "b", 5), (1 + 128, "a", "b", 4), (1 + 4, None, "b", 9), (0, "a", None, 0)], "flag int, hit string, mate_hit string, mapq int")
    r = reads.flagstat(df).first()
    assert (r.total, r.paired, r.read1, r.read2, r.proper, r.both_mapped, r.singletons, r.elsewhere, r.elsewhere_sure) == (6, 3, 1, 1, 0, 2, 0, 2, 1)


def test_escapes(spark):
    texts = {"a%zzb": "a%zzb", "100%": "100%", "a%20b": "a%20b", "a%3Bb": "a.b", "%41%2c%0a": "A,%0a", "%e9x": "%e9x", "": "", "%%41": "%A", "a+b": "a+b", "l\n%41": "l\nA"}
    df = spark.createDataFrame([(t,) for t in [*texts, None]], "t string")
    assert {r.t: r.d for r in df.select("t", seq.percent_decode(F.col("t")).alias("d")).collect()} == {**texts, None: None}


def test_gaps_and_masked_bases(spark):
    df = spark.createDataFrame([("AC-G*TX",), ("acQ.u",)], "s string")
    assert [r.r for r in df.select(seq.reverse_complement(F.col("s")).alias("r")).collect()] == ["XA*C-GT", "aNNgt"]


def test_lines_of_more_columns(spark):
    lines = spark.createDataFrame([("c\ts\texon\t5\t1\t.\t+\t.\tParent=t1;\tmore\tyet",), ("c\ts\texon\t5\t9\t.\t+\t.",)], "value string")
    assert [(r.start, r.end, r.attributes) for r in gff.parse_gff(lines).collect()] == [(1, 5, "Parent=t1;\tmore\tyet")]
    assert [(r.tid, r.start) for r in gff.exons(gff.parse_gff(lines)).collect()] == [("t1", 1)]


def x31(name):
    h = ord(name[0])
    for c in name[1:]:
        h = (h * 31 + ord(c)) % 2**32
    return h


def test_subsample(spark):
    names = [f"read{i}" for i in range(400)]
    df = spark.createDataFrame([(n,) for n in names], "n string")
    for seed in (0, 7):
        assert {r.n for r in reads.subsample(df, "n", 0.25, seed).collect()} == {n for n in names if (x31(n) + seed) % 1024 / 1024 < 0.25}
