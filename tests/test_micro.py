"""Hand-written cases, file formats and properties."""

import os
import random

import pytest
from helixframe.functions import seq
from helixframe.operators import hits, intervals, reads, relational, stats, transcripts
from helixframe.operators.graph import connected_components
from helixframe.sources import alignments, fasta, fastq, gff
from helixframe.streaming.bundles import point_bundles, saturating
from pyspark.sql import functions as F

IV = [("c1", 10, 20, "a"), ("c1", 15, 30, "b"), ("c1", 100, 120, "c"), ("c1", 125, 130, "d"), ("c2", 5, 9, "e")]


def iv(spark, rows=IV):
    return spark.createDataFrame(rows, "chrom string, start long, end long, id string")


def test_bundles_and_depth(spark):
    got = {(r.chrom, r.start, r.end, r.n) for r in intervals.islands(iv(spark), 50).collect()}
    assert got == {("c1", 10, 30, 2), ("c1", 100, 130, 2), ("c2", 5, 9, 1)}
    d = {(r.chrom, r.start, r.end): r.depth for r in intervals.depth(iv(spark)).collect()}
    assert d == {("c1", 10, 14): 1, ("c1", 15, 20): 2, ("c1", 21, 30): 1, ("c1", 100, 120): 1, ("c1", 125, 130): 1, ("c2", 5, 9): 1}
    assert sum((e - s + 1) * n for (_, s, e), n in d.items()) == 59


@pytest.mark.parametrize("bin_size", [7, 1 << 16])
def test_random_intervals(spark, bin_size):
    rnd = random.Random(7)
    rows = [(f"c{rnd.randrange(3)}", s := rnd.randrange(400), s + rnd.randrange(60), f"{i:03}") for i in range(150)]
    df = iv(spark, rows)
    want = []
    for chrom in sorted({r[0] for r in rows}):
        top, k = None, 0
        for _, s, e, i in sorted((r for r in rows if r[0] == chrom), key=lambda r: (r[1], r[2], r[3])):
            k += top is None or s > top + 3
            top = e if top is None else max(top, e)
            want.append((i, k))
    assert sorted((r.id, r.island) for r in intervals.number_islands(df, 3, bin_size=bin_size).collect()) == sorted(want)
    b = df.select("chrom", F.col("start").alias("start2"), F.col("end").alias("end2"), F.col("id").alias("id2"))
    pairs = sorted((r.id, r.id2) for r in intervals.overlap_join(df, b, bin_size=bin_size).collect())
    assert pairs == sorted((x[3], y[3]) for x in rows for y in rows if x[0] == y[0] and x[1] <= y[2] and y[1] <= x[2])
    depth = sum((r.end - r.start + 1) * r.depth for r in intervals.depth(df, bin_size=bin_size).collect())
    assert depth == sum(e - s + 1 for _, s, e, _ in rows)


def test_components(spark):
    rnd = random.Random(1)
    edges = [(rnd.randrange(300), rnd.randrange(300)) for _ in range(200)] + [(i, i + 1) for i in range(1000, 1080)] + [(None, 3), (7, 7)]
    top = {}

    def find(x):
        while top.setdefault(x, x) != x:
            x = top[x]
        return x

    for a, b in edges:
        if a is not None:
            a, b = find(a), find(b)
            top[max(a, b)] = min(a, b)
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(edges, "src long, dst long")).collect()}
    assert got == {x: find(x) for x in top}


def test_annotation(spark, tmp_path):
    text = "\n".join([
        "# comment", "c1\ts\tgene\t1\t900\t.\t+\t.\tID=g", 'c1\ts\tmRNA\t1\t900\t5.5\t+\t.\tID=t1;Parent=g;note="a;b"', "c1\ts\texon\t400\t300\t.\t+\t.\tParent=t1,t2", "c1\ts\texon\t100\t200\t.\t+\t.\tParent=t1",
        'c1\ts\texon\t10\t20\t.\t-\t.\ttranscript_id "x1"; gene_id "g1";', "c1\ts\texon\t1\t2\t.\t?\t.\tParent=t1", "c1\ts\texon\t1\t2\t.\t+\t.", "c1\ts\tintron\t201\t299\t.\t+\t.\tParent=t1",
    ])
    (tmp_path / "a.gff").write_text(text)
    g = gff.read_gff(spark, str(tmp_path / "a.gff"))
    assert g.count() == 6 and g.where("type = 'mRNA'").first().score == 5.5
    notes = g.where("type = 'mRNA'").select(gff.attribute_map(F.col("attributes")).alias("m")).first().m
    assert notes == {"ID": "t1", "Parent": "g", "note": "a;b"}
    t = transcripts.assemble(gff.exons(g))
    got = {r.tid: [(e.start, e.end) for e in r.exons] for r in t.collect()}
    assert got == {"t1": [(100, 200), (300, 400)], "t2": [(300, 400)], "x1": [(10, 20)]}
    lines = [r.value for r in gff.to_gff(t.where("tid = 't1'")).collect()]
    assert lines == ["c1\thelixframe\ttranscript\t100\t400\t.\t+\t.\tID=t1", "c1\thelixframe\texon\t100\t200\t.\t+\t.\tParent=t1", "c1\thelixframe\texon\t300\t400\t.\t+\t.\tParent=t1"]
    assert gff.to_bed12(t.where("tid = 't1'")).first().value == "c1\t99\t400\tt1\t0\t+\t99\t99\t0\t2\t101,101,\t0,200,"


@pytest.mark.parametrize(("exons", "code"), [
    ([(120, 200), (300, 400), (500, 580)], "="), ([(150, 200), (300, 380)], "c"), ([(150, 200), (310, 400)], "j"), ([(210, 290)], "i"), ([(110, 190)], "c"), ([(180, 260)], "e"), ([(590, 650)], "o"), ([(700, 800)], "p"), ([(5000, 5100)], "u"),
])
def test_class_codes(spark, exons, code):
    schema = "tid string, chrom string, strand string, exons array<struct<start:long,end:long>>"
    r = transcripts.with_range(spark.createDataFrame([("R", "c", "+", [(100, 200), (300, 400), (500, 600)])], schema))
    q = transcripts.with_range(spark.createDataFrame([("Q", "c", "+", exons)], schema))
    assert transcripts.best_codes(q, r).first().code == code


def test_codes_of_the_other_strand_and_of_repeats(spark):
    schema = "tid string, chrom string, strand string, exons array<struct<start:long,end:long>>"
    r = transcripts.with_range(spark.createDataFrame([("R", "c", "-", [(100, 200), (300, 400)])], schema))
    q = transcripts.with_range(spark.createDataFrame([("s", "c", "+", [(50, 120), (250, 290)]), ("x", "c", "+", [(350, 420)]), ("r", "c", "+", [(9000, 9100)]), ("p", "c", "-", [(10, 60)]), ("u", "d", "-", [(10, 60)])], schema))
    masked = spark.createDataFrame([("r", 0.6), ("u", 0.4), ("x", 0.9)], "tid string, share double")
    assert {x.tid: x.code for x in transcripts.best_codes(q, r, masked).collect()} == {"s": "s", "x": "x", "r": "r", "p": "p", "u": "u"}


def test_hits(spark):
    h = spark.createDataFrame([("q", 100, 1, 90, "h", 120, 11, 100, 95.0, 80.0), ("s", 100, 1, 90, "s", 100, 1, 90, 99.0, 90.0), ("m", 50, 45, 6, "h", 120, 1, 40, 90.0, 70.0)], "q_name string, q_len long, q5 long, q3 long, h_name string, h_len long, h5 long, h3 long, pid double, score double")
    m = {r.q_name: r for r in hits.with_metrics(h).collect()}
    assert (m["q"].overlap, m["q"].scov, m["q"].lcov, m["q"].ovh_l, m["q"].ovh_r) == (90, 89, 74, 0, 10) and m["m"].strand == "-"
    assert {r.q_name for r in hits.hit_filter(h, scov=89, pid=95, overlap=90, score=80, overhang=10).collect()} == {"q"}
    names = spark.createDataFrame([("q",), ("h",)], "name string")
    assert {r.q_name for r in hits.name_lists(h, names).collect()} == {"q"} and {r.q_name for r in hits.name_lists(h, names, "any").collect()} == {"q", "m"} and {r.q_name for r in hits.name_lists(h, names, "none").collect()} == {"s"}
    lay = {r.name: (r.cluster, r.offset, r.strand) for r in hits.layout_clusters(h).collect()}
    assert lay["h"][0] == lay["q"][0] == lay["m"][0] == "h" and lay["q"][1] - lay["h"][1] == 10


def test_alignments(spark, tmp_path):
    flags = [99, 147, 73, 133, 1123, 516]
    df = spark.createDataFrame([(f, "a", "b" if f == 147 else "a", 4) for f in flags], "flag int, hit string, mate_hit string, mapq int")
    s = {r.failed: r for r in reads.flagstat(df).collect()}
    ok = s[False]
    assert (ok.total, ok.duplicates, ok.mapped, ok.paired, ok.read1, ok.read2, ok.proper, ok.singletons, ok.both_mapped, ok.elsewhere, ok.elsewhere_sure) == (5, 1, 4, 5, 3, 2, 3, 1, 3, 1, 0) and s[True].total == 1 and s[True].mapped == 0
    sam = "@HD\tVN:1\nr1\t0\tc1\t10\t60\t5S10M5N10M3S\t*\t0\t0\tAAAAACCCCCCCCCCGGGGGGGGGGTTT\t*\tNH:i:2\tXS:A:+\nr2\t4\t*\t0\t0\t*\t*\t0\t0\tA\tI\n"
    (tmp_path / "a.sam").write_text(sam)
    a = alignments.read_sam(spark, str(tmp_path / "a.sam"))
    r = a.where("qname = 'r1'").select("*", seq.cigar_blocks(F.col("pos"), F.col("cigar")).alias("b"), seq.cigar_query_length(F.col("cigar")).alias("q"), seq.cigar_reference_length(F.col("cigar")).alias("r")).first()
    assert [(x.start, x.end) for x in r.b] == [(10, 19), (25, 34)] and (r.q, r.r) == (28, 25) and r.tags == {"NH": "2", "XS": "+"}
    p = {(x.pos, x.base): x.n for x in reads.pileup(a.where("flag = 0").select(F.col("rname").alias("chrom"), "pos", "cigar", "seq")).collect()}
    assert len(p) == 20 and p[(10, "C")] == 1 and p[(34, "G")] == 1
    c = spark.createDataFrame([("c", 1, "-", 2), ("c", 1, "T", 2), ("c", 2, "C", 3), ("c", 2, "A", 1)], "chrom string, pos int, base string, n long")
    assert sorted((x.pos, x.base, x.depth) for x in reads.consensus(c).collect()) == [(1, "T", 4), (2, "C", 4)]
    back = {x.id: x for x in reads.to_fastq(spark.createDataFrame([("r", 16 + 64, "ACGTN", "12345")], "qname string, flag int, seq string, qual string")).collect()}
    assert back["r/1"].seq == "NACGT" and back["r/1"].qual == "54321"


def test_trimming(spark):
    assert reads.quality_cut([30] * 8 + [10] * 6, 20) == 8 and reads.quality_cut([], 20) == 0 and reads.quality_cut([30] * 20, 20) == 20
    assert reads.n_trim("NNACGTACGTNN") == (2, 10) and reads.n_trim("ACGT") == (0, 4) and reads.n_trim("NNNN")[0] == reads.n_trim("NNNN")[1]
    assert reads.poly_tail("CGTCGTCG" + "A" * 12) == 8 and reads.poly_tail("ACGTACGT") == 8
    assert reads.adapter_start("CCCCCCCCCC" + "AGATCGGAAGAGC", "AGATCGGAAGAGC") == 10 and reads.adapter_start("CCCC", "AGATCGGAAGAGC") == 4
    assert "N" * 20 in reads.mask("ACGTTGCA" + "AT" * 40, reads.dust_windows("ACGTTGCA" + "AT" * 40)) and reads.dust_windows("ACGTAGCTTGACCTGATCGA") == []
    df = spark.createDataFrame([("a", "ACGTACGTCAGTCAGTCAGT" + "A" * 15, "I" * 35), ("b", "ACGT", "IIII"), ("c", None, None), ("d", "ACGTACGTCAGTCAGTCAGTGG", "I" * 18 + "#" * 4)], "id string, seq string, qual string")
    got = {r.id: r for r in reads.trim_reads(df).collect()}
    assert got["a"].trimmed.startswith("ACGTACGTCAGTCAGTCAGT") and got["a"].trash == "" and got["b"].trash == "s" and got["c"].trash == "s" and got["d"].trimmed == "ACGTACGTCAGTCAGTCA"
    dup = spark.createDataFrame([("r2", "AC", "II"), ("r1", "AC", "GG"), ("r3", "GT", "II")], "id string, seq string, qual string")
    assert {(r.id, r.seq, r.n, r.qual) for r in reads.collapse_reads(dup).collect()} == {("r1_x2", "AC", 2, "HH"), ("r3_x1", "GT", 1, "II")}


def test_sequences(spark, tmp_path):
    df = spark.createDataFrame([("ACGTNR",), ("ATGGCNTAA",), ("acgtx",)], "s string")
    got = [(r.a, r.b) for r in df.select(seq.reverse_complement(F.col("s")).alias("a"), seq.translate(F.col("s")).alias("b")).collect()]
    assert got[0][0] == "YNACGT" and got[1][1] == "MA." and got[2][0] == "xacgt"
    k = df.select(seq.kmers(F.lit("ACGTAC"), 3).alias("k"), seq.longest_orf(F.lit("XMAB.MABCD")).alias("o"), seq.phred_shift(F.lit("!I"), 31).alias("p"), seq.runs(F.lit("TTTTATTTTT"), "T", 4).alias("r"), seq.percent_decode(F.lit("a%20b+c")).alias("d"), seq.canonical_splice(F.lit("gt"), F.lit("AG")).alias("c")).first()
    assert k.k == ["ACG", "CGT", "GTA", "TAC"] and k.o == "MABCD" and k.p == "@h" and [(x.start, x.length) for x in k.r] == [(1, 4), (6, 5)] and k.d == "a%20b+c" and k.c
    sp = spark.createDataFrame([("AACCGGTTAA", [(1, 2), (5, 6)], "-")], "g string, e array<struct<start:int,end:int>>, s string")
    assert sp.select(seq.splice(F.col("g"), F.col("e"), F.col("s")).alias("x")).first().x == "CCTT"
    (tmp_path / "a.fa").write_text(">s1 first one\nACGT\nAC\n>s2\nGG\n")
    f = fasta.read_fasta(spark, str(tmp_path / "a.fa"))
    assert sorted((r.id, r.description, r.seq) for r in f.collect()) == [("s1", "first one", "ACGTAC"), ("s2", "", "GG")]
    regions = spark.createDataFrame([("s1", 3, 99)], "id string, start long, end long")
    assert fasta.fetch(f, regions).first().part == "GTAC"
    fasta.write_fasta(f, str(tmp_path / "out"), width=4)
    assert sorted((r.id, r.seq) for r in fasta.read_fasta(spark, str(tmp_path / "out")).collect()) == [("s1", "ACGTAC"), ("s2", "GG")]
    (tmp_path / "a.fq").write_text("@r1 x\nAC\n+\n@I\n@r2\nG\n+\nI\n")
    assert sorted((r.id, r.info, r.seq, r.qual) for r in fastq.read_fastq(spark, str(tmp_path / "a.fq")).collect()) == [("r1", "x", "AC", "@I"), ("r2", "", "G", "I")]
    (tmp_path / "a.bed").write_text("track x\nc1\t9\t20\tn\t5\t+\nc1\t30\t40\n")
    assert [(r.start, r.end, r.name) for r in alignments.read_bed(spark, str(tmp_path / "a.bed")).collect()] == [(10, 20, "n"), (31, 40, None)]
    (tmp_path / "a.wig").write_text("fixedStep chrom=c1 start=5 step=2\n1.5\n2\nfixedStep chrom=c2 start=1\n3\n")
    assert sorted((r.chrom, r.pos, r.value) for r in alignments.read_wiggle(spark, str(tmp_path / "a.wig")).collect()) == [("c1", 5, 1.5), ("c1", 7, 2.0), ("c2", 1, 3.0)]
    (tmp_path / "a.lyt").write_text(">ctg1 2 1 50\nr1 + 30 1 0 0\nr2 - 25 20 2 3\n>ctg2 1 1 9\nr3 + 9 1\n")
    assert sorted((r.contig, r.name, r.start, r.clip_r) for r in alignments.read_layout(spark, str(tmp_path / "a.lyt")).collect()) == [("ctg1", "r1", 1, 0), ("ctg1", "r2", 20, 3), ("ctg2", "r3", 1, None)]


def test_tables(spark):
    v = spark.createDataFrame([(i,) for i in range(1, 9)], "v long")
    s = relational.weighted_summary(v, F.col("v")).first()
    assert (s.q1, s.q2, s.q3, s.low, s.high, s.n50) == (3, 5, 7, 1, 8, 6)
    n = relational.n50(spark.createDataFrame([(x,) for x in (10, 8, 6, 4, 2)], "v long"), F.col("v")).first()
    assert (n.n50, n.l50) == (8, 2)
    left, right = spark.createDataFrame([("a",), ("b",)], "k string"), spark.createDataFrame([("a", 1), ("a", 2)], "k string, v int")
    assert relational.keyed_join(left, right, ["k"], order=["v"]).collect() == [("a", 2)]
    assert relational.semi(left, right, "k").collect() == [("a",)] and relational.anti(left, right, "k").collect() == [("b",)]
    assert abs(stats.fisher(1, 9, 11, 3, two_sided=False) - 0.0013797) < 1e-7
    assert 0 < stats.audic_claverie(5, 9, 1000, 1200) < 1


def test_streams(spark, tmp_path):
    rows = [("a", 10), ("a", 20), ("a", 200), ("b", 5), ("a", 100000), ("b", 100000)]
    df = spark.createDataFrame(rows, "chrom string, pos long")
    df.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    q = point_bundles(stream, 50, lateness=10).writeStream.format("memory").queryName("bundles").outputMode("append").start()
    q.processAllAvailable()
    q.stop()
    got = {tuple(r) for r in spark.sql("select chrom, start, last, n from bundles").collect()}
    assert got == {("a", 10, 20, 2), ("a", 200, 200, 1), ("b", 5, 5, 1)}
    q = saturating(stream, 2).writeStream.format("memory").queryName("kept").outputMode("append").start()
    q.processAllAvailable()
    q.stop()
    assert {r.chrom: r.n for r in spark.sql("select chrom, count(*) n from kept group by chrom").collect()} == {"a": 2, "b": 2}


def test_events_just_a_gap_apart(spark):
    df = spark.createDataFrame([("a", 0), ("a", 49), ("a", 99), ("a", 149), ("b", 5), ("b", 5), ("b", 54), ("b", 105)], "chrom string, pos long")
    assert {tuple(r) for r in point_bundles(df, 50).collect()} == {("a", 0, 49, 2), ("a", 99, 99, 1), ("a", 149, 149, 1), ("b", 5, 54, 3), ("b", 105, 105, 1)}


def test_assembly(spark):
    from helixframe.operators.assembly import assemble, paths

    two = [(((1, 100), (201, 300)), 10.0), (((1, 100), (401, 500)), 4.0)]
    got = paths(two, 1.0, 50)
    assert [e for _, e in got] == [[(1, 100), (201, 300)], [(1, 100), (401, 500)]] and got[0][0] > got[1][0] > 3
    schema = "id long, chrom string, strand string, blocks array<struct<start:long,end:long>>, weight double"
    rows = [(i, "c", "+", [(1, 100), (201, 300)], 1.0) for i in range(6)] + [(10, "c", "+", [(1, 100), (900, 990)], 0.5)]
    t = assemble(spark.createDataFrame(rows, schema), least_cov=1.0, least_len=50).collect()
    assert len(t) == 1 and [(e.start, e.end) for e in t[0].exons] == [(1, 100), (201, 300)] and abs(t[0].cov - 6) < 1e-6


def test_linked_components_take_every_order_line(spark, tmp_path):
    from helixframe.plans.catalogue import QUERIES

    rnd = random.Random(11)
    orders = [(k, rnd.randrange(1, 40), 100.0) for k in range(1, 31)]
    # supplier 1 is a hub; most others stand in one or two cheap lines
    lines = [(k, 1 if k <= 10 else rnd.randrange(2, 60), 5.0) for k, _, _ in orders for _ in range(1 + k % 2)]
    spark.createDataFrame(orders, "o_orderkey long, o_custkey long, o_totalprice double").write.parquet(f"{tmp_path}/orders.parquet")
    spark.createDataFrame(lines, "l_orderkey long, l_suppkey long, l_quantity double").write.parquet(f"{tmp_path}/lineitem.parquet")
    home = {}

    def root(x):
        while home.setdefault(x, x) != x:
            x = home[x]
        return x

    customer = {k: c for k, c, _ in orders}
    for k, s, _ in lines:
        a, b = sorted((root(customer[k] * 2), root(s * 2 + 1)))
        home[b] = a
    want = {}
    for x in list(home):
        want[root(x)] = want.get(root(x), 0) + 1
    got = {r.component: r.n for r in QUERIES["linked_components"](spark, str(tmp_path)).collect()}
    assert got == want and len(want) > 3


def test_longest_orf_of_long_records(spark, tmp_path):
    from helixframe.plans.catalogue import QUERIES

    # a c g t stand for themselves: ATG, then 3,000 codons GCT without a stop in any frame before TAA
    texts = {1: "atg" + "gct" * 3000 + "taa" + "c" * 30, 2: "atggcttaa", 3: "ac"}
    spark.createDataFrame(list(texts.items()), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    code = seq.codon_table()
    want = {}
    for k, t in texts.items():
        s = t.upper()
        if len(s) < 3:
            continue
        best = 0
        for x in (s, s[::-1].translate(str.maketrans("ACGT", "TGCA"))):
            for f in range(3):
                protein = "".join(code[x[i : i + 3]] for i in range(f, len(x) - 2, 3))
                best = max([best, *(len(p) - p.index("M") for p in protein.split(".") if "M" in p)])
        want[k] = best
    assert {r.doc_id: r.longest for r in QUERIES["longest_orf"](spark, str(tmp_path)).collect()} == want
    assert want[1] >= 3001


def test_order(spark):
    """Places, running sums, frames over blocks and parts of equal count, with null keys and a hot key."""
    from pyspark.sql import Window

    from helixframe.operators import order

    rows = [("a" if i % 3 else None, i * 7 % 1000, i) for i in range(1000)] + [("b", 1, 5000), ("b", 1, 5001)]
    df = spark.createDataFrame(rows, "k string, v int, id int")
    want = {}
    for key in {r[0] for r in rows}:
        total = 0
        own = sorted((r for r in rows if r[0] == key), key=lambda r: (-r[1], r[2]))
        for place, (_, v, i) in enumerate(own, 1):
            want[i] = (place, total, [r[1] for r in own[max(0, place - 3) : place + 1]], min(4, len(own)) and (place - 1 < (len(own) % 4) * (len(own) // 4 + 1)))
            total += v
    by = [F.desc("v"), F.col("id")]
    numbered = order.number_rows(df, ["k"], by)
    assert {r.id: r.place for r in numbered.collect()} == {i: w[0] for i, w in want.items()}
    assert {r.id: r.s for r in order.running_sum(df, ["k"], by, "v", "s").collect()} == {i: w[1] for i, w in want.items()}
    w = Window.partitionBy("k", "_block").orderBy("place").rowsBetween(-2, 1)
    blocks = order.in_blocks(numbered, behind=2, ahead=1, block=16).withColumn("f", F.collect_list("v").over(w)).where("not _copy")
    assert {r.id: r.f for r in blocks.collect()} == {i: w[2] for i, w in want.items()}
    ntile = Window.partitionBy("k").orderBy(*by)
    assert {(r.id, r.part) for r in order.tiles(df, ["k"], by, 7).collect()} == {(r.id, r.p) for r in df.withColumn("p", F.ntile(7).over(ntile)).collect()}
    assert [r.place for r in order.number_rows(df, [], ["id"]).orderBy("id").collect()] == list(range(1, 1003))
    assert order.number_rows(df.limit(0), ["k"], ["id"]).collect() == []


def test_more_sequences(spark):
    """Codes of sequences beyond SQL: masks, packed bases with odd letters, hashes, regions."""
    df = spark.createDataFrame([("ACGTNNAAAAAAACACACACACACGT", "chr1:1,000-2,000"), ("acg", "x"), (None, None)], "s string, r string")
    got = df.select(seq.mask_repeats(F.col("s")).alias("m"), F.hex(seq.pack_bases(F.col("s"))).alias("p"), seq.x31(F.lit("ab")).alias("h"), seq.region(F.col("r")).alias("r"), seq.end_difference(F.lit("MABCK"), F.lit("MXK")).alias("d")).collect()
    assert "NNNNNNN" in got[0].m and len(got[0].m) == 26 and got[1].m == "acg" and got[2].m is None
    assert got[1].p == "18" and got[0].h == 97 * 31 + 98 and got[0].d == 3
    assert (got[0].r.chrom, got[0].r.start, got[0].r.end) == ("chr1", 1000, 2000) and (got[1].r.chrom, got[1].r.start) == ("x", None)
    k = {r.kmer: r.n for r in seq.kmer_counts(spark.createDataFrame([("ACGTAC",), ("nACGx",), ("AC",), (None,)], "s string"), "s", 3).collect()}
    assert k == {"ACG": 2, "CGT": 1, "GTA": 1, "TAC": 1}


def test_materialized_tables_go(spark):
    from helixframe import storage

    storage.discard(spark)
    kept = storage.materialize(spark.range(10), "micro")
    files = kept.inputFiles()
    assert kept.count() == 10 and storage.discard(spark) == 1 and not any(os.path.exists(f.removeprefix("file://")) for f in files)


def test_overlaps_of_long_rows(spark):
    rnd = random.Random(7)
    rows = [(i, rnd.choice("ab"), s, s + rnd.choice([5, 900, 40_000, 3_000_000])) for i in range(120) for s in [rnd.randrange(4_000_000)]]
    a = spark.createDataFrame(rows, "id int, chrom string, start long, end long")
    b = a.toDF("id2", "chrom", "start2", "end2")
    want = sorted((x[0], y[0]) for x in rows for y in rows if x[1] == y[1] and x[2] <= y[3] and y[2] <= x[3])
    assert sorted((r.id, r.id2) for r in intervals.overlap_join(a, b, bin_size=1000, long_bins=16).collect()) == want
