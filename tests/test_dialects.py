from helixframe.sources import dialects as D
from pyspark.sql import functions as F


def lines(spark, text):
    return spark.createDataFrame([(x,) for x in text], "value string")


def test_psl(spark):
    row = "\t".join(["90", "5", "5", "0", "0", "0", "1", "800", "+", "q1", "110", "5", "105", "chr1", "5000", "100", "1000", "2", "50,50,", "5,55,", "100,950,"])
    p = D.psl_cigar(D.parse_psl(lines(spark, ["psLayout", row]))).first()
    assert [(e.start, e.end) for e in p.exons] == [(101, 150), (951, 1000)] and p.cigar == "5S50M800N50M5S" and abs(p.pid - 95) < 1e-9 and abs(p.cov - 100 * 100 / 110) < 1e-9


def test_btab(spark):
    f = ["q", "d", "100", "p", "db", "hit"] + [""] * 11 + ["+", "", "1e-9", "", "1-40:100-140|98.0~30-60:900-930|95.0~61-70:940-950|50"]
    b = D.parse_btab(lines(spark, ["\t".join(f)]))
    assert D.btab_filter(b, 60, 90).first().qcov == 60 and D.btab_filter(b, 61, 90).count() == 0
    assert D.btab_filter(b, 50, 90, max_intron=700).count() == 0 and D.btab_filter(b, 50, 90, max_intron=800).count() == 1


def test_agp(spark):
    a = D.parse_agp(lines(spark, ["# c", "o\t1\t4\t1\tW\ts1\t1\t4\t-", "o\t5\t6\t2\tN\t2\tscaffold\tyes\t", "o\t7\t9\t3\tW\ts2\t2\t4\t+"]))
    s = spark.createDataFrame([("s1", "AACC"), ("s2", "TGGGT")], "id string, seq string")
    assert D.build_objects(a, s).first().seq == "GGTTNNGGG"


def test_ontology_and_taxa(spark, tmp_path):
    (tmp_path / "a.obo").write_text("format-version: 1.2\n\n[Term]\nid: X:1\nname: one thing\nnamespace: n\nis_a: X:0 ! root\nis_a: X:9\n\n[Typedef]\nid: y\n\n[Term]\nid: X:2\nname: old\nis_obsolete: true\n")
    got = {r.id: r for r in D.read_obo(spark, str(tmp_path / "a.obo")).collect()}
    assert set(got) == {"X:1", "X:2"} and got["X:1"].name == "one thing" and got["X:1"].parents == ["X:0", "X:9"] and got["X:2"].obsolete
    t = D.parse_taxonomy(lines(spark, ["1\t|\t1\t|\tno rank\t|", "2\t|\t1\t|\tkingdom\t|", "3\t|\t2\t|\tgenus\t|", "4\t|\t1\t|\tkingdom\t|"]))
    assert sorted(tuple(r) for r in D.subtree(t, 2).collect()) == [(2, 0), (3, 1)]


def test_reads(spark):
    q = D.parse_qseq(lines(spark, ["M\t1\t2\t3\t4\t5\t0\t1\tACG..\tIIIBB\t1", "M\t1\t2\t3\t4\t5\t0\t1\tACG\tIII\t0"])).collect()
    assert [(r.id, r.seq, r.qual) for r in q] == [("M:1:2:3:4:5/1", "ACG", "III")]
    c = D.trim_soft_clips(spark.createDataFrame([("2H3S4M2S", "AAACCCCGG", "123456789"), ("4M", "ACGT", "*")], "cigar string, seq string, qual string")).collect()
    assert [(r.cigar, r.seq, r.qual) for r in c] == [("2H4M", "CCCC", "4567"), ("4M", "ACGT", "*")]
    g = D.gap_list(spark.createDataFrame([("s", "ACNNGTNNN")], "id string, seq string")).collect()
    assert [(r.start, r.length) for r in g] == [(3, 2), (7, 3)]
