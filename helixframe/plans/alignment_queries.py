"""Alignment filters, pairs, junctions and pile-ups over order lines as alignments."""

from pyspark.sql import functions as F

from helixframe.functions import seq
from helixframe.operators import alignments as aln
from helixframe.operators import intervals as iv
from helixframe.operators import reads
from helixframe.operators.order import number_rows
from helixframe.plans.catalogue import register
from helixframe.plans.views import table
from helixframe.sources.alignments import parse_sam

TEMPLATES = ("'12M'", "'3S9M'", "concat('5M', 50 + l_partkey % 40, 'N7M')", "'6M1I5M'", "'4M2D8M'", "'10M2S'")
_CIGAR = "CASE l_partkey % 6 " + " ".join(f"WHEN {k} THEN {t}" for k, t in enumerate(TEMPLATES)) + " END"
_COLUMNS = f"""l_orderkey AS qname, l_linenumber AS line, (l_orderkey * 37 + l_linenumber * 101 + l_partkey) % 2048 AS flag, concat('c', l_suppkey % 20) AS rname,
(l_partkey * 13 + l_linenumber * 7) % 5000 + 1 AS pos, CAST(l_quantity AS INT) AS mapq, {_CIGAR} AS cigar, concat('c', (l_suppkey + l_partkey % 2) % 20) AS rnext, (l_partkey * 29) % 5000 + 1 AS pnext,
(l_partkey * 29) % 5000 - (l_partkey * 13 + l_linenumber * 7) % 5000 AS tlen, translate(lpad(CAST(l_partkey * 7919 + l_orderkey AS VARCHAR(20)), 12, '0'), '0123456789', 'ACGTACGTAC') AS seq,
translate(lpad(CAST(l_partkey * 104729 + l_linenumber AS VARCHAR(20)), 12, '0'), '0123456789', 'IHGFEDCBA@') AS qual, l_partkey % 4 AS nm, l_partkey"""


def sam(spark, d):
    """Order lines as alignments of reads of twelve bases; the same expressions are SQL for DuckDB."""
    return table(spark, d, "lineitem").selectExpr(*_split(_COLUMNS))


def _split(columns: str) -> list[str]:
    """The top-level items of a select list."""
    out, depth, own = [], 0, ""
    for c in columns.replace("\n", " "):
        depth += (c == "(") - (c == ")")
        if c == "," and depth == 0:
            out.append(own.strip())
            own = ""
        else:
            own += c
    return [*out, own.strip()]


SAM = f"sam AS (SELECT {_COLUMNS} FROM lineitem)"
#: (reference offset, read offset from 1, length) of the aligned blocks of each template.
BLOCKS = """bt(k, r, q, len) AS (VALUES (0, 0, 1, 12), (1, 0, 4, 9), (2, 0, 1, 5), (2, -1, 6, 7), (3, 0, 1, 6), (3, 6, 8, 5), (4, 0, 1, 4), (4, 6, 5, 8), (5, 0, 1, 10)),
blocks AS (SELECT sam.*, pos + CASE WHEN r < 0 THEN 5 + 50 + l_partkey % 40 ELSE r END AS b, q, len FROM sam JOIN bt ON l_partkey % 6 = k)"""
TOTAL = lambda ops, c="cigar": f"coalesce(list_sum(list_transform(regexp_extract_all({c}, '([0-9]+)[{ops}]', 1), lambda x: CAST(x AS BIGINT))), 0)"
METRICS = f"m AS (SELECT *, {TOTAL('MI=X')} AS overlap, {TOTAL('SH')} AS clipped, 100.0::DOUBLE - 100.0::DOUBLE * nm / {TOTAL('MI=X')} AS pid, pos + {TOTAL('MDN=X')} - 1 AS ref_end FROM sam)"


@register("sam_lines", f"WITH {SAM} SELECT 'r' || qname || '.' || line AS qname, CAST(flag AS INTEGER) AS flag, rname, CAST(pos AS BIGINT) AS pos, CAST(mapq AS INTEGER) AS mapq, cigar, rnext, CAST(pnext AS BIGINT) AS pnext, CAST(tlen AS BIGINT) AS tlen, seq, qual, CAST(nm AS VARCHAR) AS nm FROM sam")
def sam_lines(spark, d):
    """Alignment lines written as text and parsed again, with an optional field."""
    s = sam(spark, d)
    name = F.concat(F.lit("r"), "qname", F.lit("."), "line")
    line = F.concat_ws("\t", name, *[F.col(c).cast("string") for c in ("flag", "rname", "pos", "mapq", "cigar", "rnext", "pnext", "tlen", "seq", "qual")], F.lit("XT:A:U"), F.concat(F.lit("NM:i:"), "nm"))
    header = spark.range(1).select(F.lit("@SQ\tSN:c1\tLN:5000").alias("value"))
    return parse_sam(header.unionByName(s.select(line.alias("value")))).select("qname", "flag", "rname", "pos", "mapq", "cigar", "rnext", "pnext", "tlen", "seq", "qual", F.col("tags")["NM"].alias("nm"))


@register("cigar_lengths", f"WITH {SAM} SELECT qname, line, CAST({TOTAL('MIS=X')} AS INTEGER) AS query_length, CAST({TOTAL('MDN=X')} AS INTEGER) AS reference_length FROM sam")
def cigar_lengths(spark, d):
    c = F.col("cigar")
    return sam(spark, d).select("qname", "line", seq.cigar_query_length(c).alias("query_length"), seq.cigar_reference_length(c).alias("reference_length"))


@register("exon_blocks", f"""WITH {SAM} SELECT qname, line, CAST(pos AS BIGINT) AS "start", CAST(pos + CASE l_partkey % 6 WHEN 0 THEN 12 WHEN 1 THEN 9 WHEN 2 THEN 5 WHEN 3 THEN 11 WHEN 4 THEN 14 ELSE 10 END - 1 AS BIGINT) AS "end" FROM sam
UNION ALL SELECT qname, line, CAST(pos + 55 + l_partkey % 40 AS BIGINT), CAST(pos + 61 + l_partkey % 40 AS BIGINT) FROM sam WHERE l_partkey % 6 = 2""")
def exon_blocks(spark, d):
    """Blocks of alignments, parted at introns only."""
    b = sam(spark, d).select("qname", "line", F.explode(seq.cigar_blocks(F.col("pos"), F.col("cigar"))).alias("b"))
    return b.select("qname", "line", "b.start", "b.end")


@register("alignment_filter", f"""WITH {SAM}, {METRICS}, g AS (SELECT * FROM m WHERE flag & 4 = 0 AND pid >= 75 AND overlap >= 10 AND clipped <= 2 AND abs(tlen) BETWEEN 1 AND 4000)
SELECT qname, line, CAST(overlap AS INTEGER) AS overlap, CAST(clipped AS INTEGER) AS clipped, pid, CAST(ref_end AS BIGINT) AS ref_end FROM g QUALIFY mapq = max(mapq) OVER (PARTITION BY qname, flag & 64)""")
def alignment_filter(spark, d):
    """Identity, length, clips, fragment size, and the best of each read with its ties."""
    rows = aln.alignment_filter(sam(spark, d), least_pid=75, least_overlap=10, most_clip=2, fragment=(1, 4000), best=True)
    return rows.select("qname", "line", "overlap", "clipped", "pid", F.col("ref_end").cast("long").alias("ref_end"))


@register("clip_limit", f"WITH {SAM}, c AS (SELECT qname, line, cigar, {TOTAL('SH')} AS clipped, {TOTAL('MISH=X')} AS whole FROM sam) SELECT qname, line, cigar FROM c WHERE clipped <= 20.0 * whole / 100 AND whole - clipped >= 0.25 * whole")
def clip_limit(spark, d):
    return aln.clip_limit(sam(spark, d), 20.0, percent=True).select("qname", "line", "cigar")


@register("gap_filter", f"WITH {SAM} SELECT qname, line, cigar FROM sam WHERE {TOTAL('SH')} <= 2 AND len(regexp_extract_all(cigar, '[0-9]+N')) <= 0 AND {TOTAL('ID')} <= 1")
def gap_filter(spark, d):
    return aln.gap_filter(sam(spark, d), 2, 0, 1).select("qname", "line", "cigar")


_FR = "CASE WHEN ((flag & 16 <> 0) = (flag & 32 <> 0)) THEN 'FF' WHEN CASE WHEN pos <= pnext THEN flag & 16 = 0 ELSE flag & 32 = 0 END THEN 'FR' ELSE 'RF' END"


@register("pair_stats", f"""WITH {SAM}, p AS (SELECT *, flag & 4 = 0 AND flag & 8 = 0 AS both_ends, flag & 4 = 0 AND flag & 8 = 0 AND rname = rnext AS same, {_FR} AS way FROM sam WHERE flag & 1 <> 0 AND flag & 64 <> 0)
SELECT rname, count(*) AS pairs, count(*) FILTER (both_ends) AS both_mapped, count(*) FILTER (same) AS same_reference, count(*) FILTER (same AND flag & 2 <> 0) AS proper, count(*) FILTER (same AND way = 'FR') AS fr, count(*) FILTER (same AND way = 'RF') AS rf, count(*) FILTER (same AND way = 'FF') AS ff, avg(abs(tlen)) FILTER (same) AS insert FROM p GROUP BY rname""")
def pair_stats(spark, d):
    return aln.pair_stats(sam(spark, d))


@register("end_stats", f"WITH {SAM}, {METRICS} SELECT rname, count(*) AS alignments, count(DISTINCT qname) AS reads, avg(pid) AS pid, avg(overlap) AS overlap FROM m WHERE flag & 4 = 0 AND pid >= 80 AND clipped <= 2 GROUP BY rname")
def end_stats(spark, d):
    return aln.end_stats(sam(spark, d), 80, 2)


@register("different_references", f"WITH {SAM} SELECT qname, line, rname, rnext FROM sam WHERE flag & 1 <> 0 AND flag & 12 = 0 AND rname <> rnext AND substr(rname, 1, 2) = substr(rnext, 1, 2)")
def different_references(spark, d):
    """Mates on other references of the same first digit."""
    return aln.different_references(sam(spark, d), "^(c.)").select("qname", "line", "rname", "rnext")


@register("near_ends", f"""WITH {SAM}, l AS (SELECT rname, max(pos) + 100 AS n FROM sam GROUP BY rname), x AS (SELECT qname, line, rname, CAST(CASE WHEN flag & 16 <> 0 THEN pos + {TOTAL('MDN=X')} - 1 ELSE n - pos + 1 END AS BIGINT) AS distance FROM sam JOIN l USING (rname) WHERE flag & 4 = 0) SELECT * FROM x WHERE distance <= 500""")
def near_ends(spark, d):
    s = sam(spark, d)
    return aln.near_ends(s, s.groupBy("rname").agg((F.max("pos") + 100).alias("n")), 500).select("qname", "line", "rname", "distance")


@register("sam_to_reads", f"""WITH {SAM} SELECT 'r' || qname || CASE WHEN flag & 64 <> 0 THEN '/1' WHEN flag & 128 <> 0 THEN '/2' ELSE '' END AS id, CASE WHEN flag & 16 <> 0 THEN reverse(translate(seq, 'ACGT', 'TGCA')) ELSE seq END AS seq, CASE WHEN flag & 16 <> 0 THEN reverse(qual) ELSE qual END AS qual FROM sam""")
def sam_to_reads(spark, d):
    return reads.to_fastq(sam(spark, d).withColumn("qname", F.concat(F.lit("r"), "qname")))


@register("junction_support", f"""WITH {SAM}, j AS (SELECT rname, CAST(pos + 5 AS BIGINT) AS "start", CAST(pos + 54 + l_partkey % 40 AS BIGINT) AS "end", 1.0::DOUBLE / (l_partkey % 2 + 1) AS w, mapq FROM sam WHERE l_partkey % 6 = 2)
SELECT rname, "start", "end", sum(w) AS reads, sum(w) AS good FROM j GROUP BY ALL HAVING sum(w) >= 1""")
def junction_support(spark, d):
    """Weighted reads per intron, and those anchored by five bases on both sides; introns without a good read go."""
    s = sam(spark, d)
    return aln.junctions(s, 5, 1.0 / (F.col("l_partkey") % 2 + 1)).where("good >= 1")


@register("pileup_bases", f"""WITH {SAM}, {BLOCKS}, f AS (SELECT * FROM blocks WHERE flag & 260 = 0 AND mapq >= 20 AND (flag & 1 = 0 OR flag & 2 <> 0)),
p AS (SELECT rname, b, q, len, seq, unnest(range(len)) AS i FROM f) SELECT rname AS chrom, CAST(b + i AS BIGINT) AS pos, substr(seq, CAST(q + i AS BIGINT), 1) AS base, count(*) AS n FROM p GROUP BY ALL""")
def pileup_bases(spark, d):
    """Bases by position of the reads that count: mapped, primary, of quality 20, no orphans."""
    f = aln.pileup_filter(sam(spark, d), least_mapq=20)
    return reads.pileup(f.withColumnRenamed("rname", "chrom"))


@register("consensus_bases", f"""WITH {SAM}, {BLOCKS}, p AS (SELECT rname, b, q, seq, unnest(range(len)) AS i FROM blocks), c AS (SELECT rname AS chrom, CAST(b + i AS BIGINT) AS pos, substr(seq, CAST(q + i AS BIGINT), 1) AS base, count(*) AS n FROM p GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY chrom, pos ORDER BY n DESC, base) AS k, sum(n) OVER (PARTITION BY chrom, pos) AS depth FROM c) SELECT chrom, pos, base, CAST(depth AS BIGINT) AS depth FROM r WHERE k = 1""")
def consensus_bases(spark, d):
    """The commonest base of each column of a stack of reads."""
    return reads.consensus(reads.pileup(sam(spark, d).withColumnRenamed("rname", "chrom")))


@register("indel_counts", f"""WITH {SAM} SELECT rname, CAST(pos + 5 AS BIGINT) AS pos, 'I' AS op, 1 AS length, count(*) AS n FROM sam WHERE l_partkey % 6 = 3 GROUP BY ALL
UNION ALL SELECT rname, CAST(pos + 3 AS BIGINT), 'D', 2, count(*) FROM sam WHERE l_partkey % 6 = 4 GROUP BY ALL""")
def indel_counts(spark, d):
    return aln.indels(sam(spark, d))


@register("filtered_depth", f"""WITH {SAM}, {BLOCKS}, e AS (SELECT rname AS chrom, line % 2 AS sample, b AS pos, 1 AS d FROM blocks WHERE mapq >= 20 AND q <> 8 UNION ALL SELECT rname, line % 2, b + CASE WHEN l_partkey % 6 = 3 THEN 11 ELSE len END, -1 FROM blocks WHERE mapq >= 20 AND q <> 8),
g AS (SELECT chrom, sample, pos, sum(d) AS d FROM e GROUP BY ALL), s AS (SELECT chrom, sample, CAST(pos AS BIGINT) AS "start", CAST(lead(pos) OVER w - 1 AS BIGINT) AS "end", CAST(sum(d) OVER w AS BIGINT) AS depth FROM g WINDOW w AS (PARTITION BY chrom, sample ORDER BY pos)) SELECT * FROM s WHERE depth > 0""")
def filtered_depth(spark, d):
    """Depth per sample over the aligned blocks of reads of quality 20 (inserted and skipped bases do not count)."""
    s = sam(spark, d).where("mapq >= 20")
    ops = F.regexp_replace("cigar", "([0-9]+)D", "$1N")
    b = s.select(F.col("rname").alias("chrom"), (F.col("line") % 2).alias("sample"), F.explode(seq.cigar_blocks(F.col("pos"), ops)).alias("b")).select("chrom", "sample", "b.start", "b.end")
    return iv.depth(b, ["chrom", "sample"]).withColumn("depth", F.col("depth").cast("long"))


@register("natural_name_order", f"""WITH {SAM}, n AS (SELECT 'r' || qname || '.x' || line AS name, qname, line, l_partkey FROM sam) SELECT name, row_number() OVER (ORDER BY qname, line, l_partkey) AS place FROM n""")
def natural_name_order(spark, d):
    """Names in natural order: r9 before r10."""
    n = sam(spark, d).select(F.concat(F.lit("r"), "qname", F.lit(".x"), "line").alias("name"), "l_partkey")
    return number_rows(n, [], [aln.natural_key(F.col("name")), F.col("l_partkey")]).select("name", "place")


@register("sam_view_regions", f"""WITH {SAM}, {BLOCKS}, b AS (SELECT DISTINCT qname, line, l_partkey, rname, b AS s, b + len - 1 AS e FROM blocks WHERE flag & 4 = 0 AND mapq >= 10 AND line % 3 <> 1),
r AS (SELECT DISTINCT concat('c', s_suppkey % 20) AS chrom, (s_suppkey * 31) % 5000 AS s2, (s_suppkey * 31) % 5000 + 20 AS e2 FROM supplier)
SELECT DISTINCT qname, line, l_partkey FROM b JOIN r ON rname = chrom AND s <= e2 AND s2 <= e""")
def sam_view_regions(spark, d):
    """Mapped reads of some read groups with an aligned block in one of the regions."""
    s = sam(spark, d).withColumn("id", F.struct("qname", "line", "l_partkey")).withColumn("read_group", F.concat(F.lit("g"), F.col("line") % 3))
    s = s.withColumn("cigar", F.regexp_replace("cigar", "([0-9]+)D", "$1N")).where("mapq >= 10 and (flag & 4) = 0 and read_group <> 'g1'")
    r = table(spark, d, "supplier").selectExpr("concat('c', s_suppkey % 20) AS chrom", "(s_suppkey * 31) % 5000 AS start2", "(s_suppkey * 31) % 5000 + 20 AS end2").distinct()
    return aln.in_regions(s, r).select("qname", "line", "l_partkey").distinct()


@register("mate_pairs", f"""WITH {SAM}, a AS (SELECT qname, l_partkey AS hit, pos, flag FROM sam) SELECT a.qname, a.hit, a.pos AS pos1, b.pos AS pos2 FROM a JOIN a b ON a.qname = b.qname AND a.hit = b.hit AND a.flag & 64 <> 0 AND b.flag & 128 <> 0""")
def mate_pairs(spark, d):
    """First and second reads of one name and hit in one row."""
    s = sam(spark, d).select("qname", F.col("l_partkey").alias("hit"), "pos", "flag")
    return reads.mate_pairs(s).select("qname", "hit", "pos1", "pos2")


@register("interleaved_mates", f"""WITH {SAM}, r AS (SELECT qname * 10 + line AS id, 1 AS mate, seq FROM sam WHERE mapq >= 10 UNION ALL SELECT qname * 10 + line, 2, qual FROM sam WHERE mapq <= 40),
k AS (SELECT id FROM r GROUP BY id HAVING count(DISTINCT mate) = 2) SELECT id, mate, seq, row_number() OVER (ORDER BY id, mate, seq) AS place FROM r WHERE id IN (SELECT id FROM k)""")
def interleaved_mates(spark, d):
    """Two files of mates as one, mate by mate; reads without a mate go."""
    s = sam(spark, d).withColumn("id", F.col("qname") * 10 + F.col("line"))
    both = aln.interleave(s.where("mapq >= 10").select("id", "seq"), s.where("mapq <= 40").select("id", F.col("qual").alias("seq")))
    return number_rows(both, [], ["id", "mate", "seq"]).select("id", "mate", "seq", "place")


@register("subsampled_reads", f"""WITH {SAM}, n AS (SELECT qname, line, 'read' || qname AS name FROM sam), h AS (SELECT qname, line, list_reduce(list_prepend(CAST(0 AS BIGINT), list_transform(string_split(name, ''), lambda c: CAST(ascii(c) AS BIGINT))), lambda h, c: (h * 31 + c) % 4294967296) AS h FROM n) SELECT qname, line FROM h WHERE ((h + 11) % 1024) / 1024.0::DOUBLE < 0.3""")
def subsampled_reads(spark, d):
    """A share of the reads by name, mates together (a sampling operator)."""
    s = sam(spark, d).withColumn("name", F.concat(F.lit("read"), "qname"))
    return reads.subsample(s, "name", 0.3, 11).select("qname", "line")


@register("collapsed_reads", f"""WITH {SAM}, q AS (SELECT seq, count(*) AS n, min(qname * 10 + line) AS id FROM sam GROUP BY seq), b AS (SELECT seq, i, sum(ascii(substr(qual, i, 1))) // count(*) AS m FROM (SELECT seq, qual, unnest(range(1, 13)) AS i FROM sam) GROUP BY seq, i),
s AS (SELECT seq, string_agg(chr(CAST(m AS INTEGER)), '' ORDER BY i) AS qual FROM b GROUP BY seq) SELECT seq, n, id || '_x' || n AS id, qual FROM q JOIN s USING (seq)""")
def collapsed_reads(spark, d):
    """One row per sequence with the number of its reads and their mean qualities."""
    return reads.collapse_reads(sam(spark, d).select((F.col("qname") * 10 + F.col("line")).alias("id"), "seq", "qual"))


@register("clean_alignment_ends", f"""WITH {SAM} SELECT qname, line, CASE l_partkey % 6 WHEN 1 THEN '9M' WHEN 5 THEN '10M' ELSE cigar END AS cigar, CASE l_partkey % 6 WHEN 1 THEN substr(seq, 4) WHEN 5 THEN substr(seq, 1, 10) ELSE seq END AS seq, CASE l_partkey % 6 WHEN 1 THEN substr(qual, 4) WHEN 5 THEN substr(qual, 1, 10) ELSE qual END AS qual FROM sam""")
def clean_alignment_ends(spark, d):
    """Alignments without their soft-clipped ends."""
    from helixframe.sources.dialects import trim_soft_clips

    return trim_soft_clips(sam(spark, d)).select("qname", "line", "cigar", "seq", "qual")
