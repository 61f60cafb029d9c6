"""Transcript models over orders, and their SQL."""

from pyspark.sql import functions as F

from helixframe.functions import seq
from helixframe.operators import intervals as iv
from helixframe.operators import models, stats
from helixframe.operators import transcripts as tx
from helixframe.operators.order import number_rows
from helixframe.plans.catalogue import register
from helixframe.plans.transcript_queries import LOCI, TX, _transcripts
from helixframe.plans.views import IV, intervals, table
from helixframe.sources import gff

#: Per transcript: range, exonic length, chain of introns, number of exons.
MODEL = f"""{TX}, nx AS (SELECT *, lead("start") OVER (PARTITION BY tid ORDER BY "start") AS nxt FROM exons),
model AS (SELECT tid, chrom, strand, min("start") AS s, max("end") AS e, CAST(sum("end" - "start" + 1) AS BIGINT) AS len, count(*) AS n, coalesce(string_agg(CASE WHEN nxt IS NOT NULL THEN ("end" + 1) || '-' || (nxt - 1) END, ',' ORDER BY "start"), '') AS chain, max(nxt - "end" - 1) AS gap FROM nx GROUP BY tid, chrom, strand)"""


@register("model_predicates", f"WITH {MODEL} SELECT tid, n AS exons FROM model WHERE n > 1 AND gap <= 1200 AND len >= 500")
def model_predicates(spark, d):
    """Models of several exons, without long introns, of enough length."""
    t = models.keep(_transcripts(spark, d), multi_exon=True, max_intron=1200, least_length=500)
    return t.select("tid", F.size("exons").cast("long").alias("exons"))


@register("annotation_order", f"""WITH {MODEL}, r AS (SELECT chrom, s AS lo, tid, 0 AS rank, 'transcript' AS kind, s AS "start", e AS "end" FROM model UNION ALL SELECT x.chrom, m.s, x.tid, 1, 'exon', x."start", x."end" FROM exons x JOIN model m USING (tid))
SELECT row_number() OVER (ORDER BY chrom, lo, tid, rank, "start") AS place, tid, kind, "start", "end" FROM r""")
def annotation_order(spark, d):
    return models.hierarchical_order(_transcripts(spark, d))


@register("better_duplicates", f"WITH {MODEL}, r AS (SELECT *, row_number() OVER (PARTITION BY chrom, strand, s, e, chain ORDER BY len DESC, tid) AS k, count(*) OVER (PARTITION BY chrom, strand, s, e, chain) AS c FROM model) SELECT tid, c AS n FROM r WHERE k = 1")
def better_duplicates(spark, d):
    return models.better_of_duplicates(_transcripts(spark, d))


@register("redundant_models", f"""WITH {MODEL}, x AS (SELECT tid, min("end") OVER (PARTITION BY tid) AS first_end, max("start") OVER (PARTITION BY tid) AS last_start FROM exons), m AS (SELECT model.*, first_end, last_start FROM model JOIN (SELECT DISTINCT tid, first_end, last_start FROM x) USING (tid)),
p AS (SELECT a.tid, b.tid AS tid2, b.n AS n2, b.len AS len2, a.n, a.s, a.e, a.chain, b.chain AS chain2, b.s AS s2, b.e AS e2, a.first_end, a.last_start FROM m a JOIN m b ON a.chrom = b.chrom AND a.strand = b.strand AND a.s < b.e AND b.s < a.e AND a.tid <> b.tid AND (b.n > a.n OR b.n = a.n AND (b.len > a.len OR b.len = a.len AND b.tid < a.tid)) AND b.s <= a.s AND b.e >= a.e),
k AS (SELECT p.tid, tid2, n2, len2 FROM p JOIN exons y ON y.tid = tid2 GROUP BY ALL HAVING CASE WHEN any_value(n) = 1 THEN bool_or(y."start" <= s AND y."end" >= e) ELSE any_value(contains(',' || chain2 || ',', ',' || chain || ',')) AND bool_or(y."end" = first_end AND y."start" <= s) AND bool_or(y."start" = last_start AND y."end" >= e) END)
SELECT tid, tid2 AS keeper FROM k QUALIFY row_number() OVER (PARTITION BY tid ORDER BY n2 DESC, len2 DESC, tid2) = 1""")
def redundant_models(spark, d):
    """Models that lie in a bigger one without reaching into its introns."""
    return models.redundant(_transcripts(spark, d))


@register("equivalence_sets", f"""WITH RECURSIVE {MODEL}, o AS (SELECT * FROM model WHERE chain = ''), p AS (SELECT a.tid AS a, b.tid AS b FROM o a JOIN o b ON a.chrom = b.chrom AND a.strand = b.strand AND a.s <= b.e AND b.s <= a.e AND least(a.e, b.e) - greatest(a.s, b.s) + 1 >= 0.8::DOUBLE * (greatest(a.e - a.s, b.e - b.s) + 1)),
t(node, low) AS (SELECT tid, tid FROM o UNION SELECT p.b, t.low FROM t JOIN p ON p.a = t.node WHERE t.low <= p.b), g AS (SELECT node AS tid, min(low) AS c FROM t GROUP BY node)
SELECT tid, first_value(tid) OVER (PARTITION BY chrom, strand, chain ORDER BY tid % 3, tid) AS head FROM model WHERE chain <> '' UNION ALL SELECT tid, first_value(tid) OVER (PARTITION BY c ORDER BY tid % 3, tid) FROM g""")
def equivalence_sets(spark, d):
    """Models of three samples that are one, by chain or by overlap of single exons."""
    return models.equivalent(_transcripts(spark, d).withColumn("sample", F.col("tid") % 3))


@register("joint_loci", f"""WITH {TX}, xr AS (SELECT *, max("end") OVER (PARTITION BY chrom, strand ORDER BY "start", "end" ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM exons),
xn AS (SELECT *, sum(CASE WHEN reach IS NULL OR "start" > reach THEN 1 ELSE 0 END) OVER (PARTITION BY chrom, strand ORDER BY "start", "end" ROWS UNBOUNDED PRECEDING) AS g FROM xr), l AS ({LOCI}) SELECT locus, tid % 3 AS sample, count(*) AS n FROM l GROUP BY ALL""")
def joint_loci(spark, d):
    return models.joint_loci(_transcripts(spark, d).withColumn("sample", F.col("tid") % 3))


_ISLANDS = """i AS (SELECT DISTINCT l_suppkey % 25 AS chrom, (l_partkey % 400) * 5000 AS s2, (l_partkey % 400) * 5000 + 2000 AS e2 FROM lineitem WHERE l_quantity >= 40)"""


def _islands(spark, d):
    li = table(spark, d, "lineitem").where("l_quantity >= 40")
    return li.selectExpr("l_suppkey % 25 AS chrom", "(l_partkey % 400) * 5000 AS start2", "(l_partkey % 400) * 5000 + 2000 AS end2").distinct()


@register("models_on_islands", f"""WITH {TX}, {_ISLANDS} SELECT tid, count(DISTINCT k) AS hit FROM exons JOIN i ON exons.chrom = i.chrom AND "start" <= e2 AND s2 <= "end" GROUP BY tid""")
def models_on_islands(spark, d):
    """Models with an exon on a coverage island."""
    return models.on_islands(_transcripts(spark, d), _islands(spark, d))


@register("models_all_on_islands", f"""WITH {TX}, {_ISLANDS}, c AS (SELECT tid, count(*) AS n FROM exons GROUP BY tid) SELECT tid, count(DISTINCT k) AS hit FROM exons JOIN i ON exons.chrom = i.chrom AND "start" <= e2 AND s2 <= "end" JOIN c USING (tid) GROUP BY tid, n HAVING count(DISTINCT k) = n""")
def models_all_on_islands(spark, d):
    """Models with all exons on coverage islands."""
    return models.on_islands(_transcripts(spark, d), _islands(spark, d), every=True)


@register("transcript_positions", f"""WITH {MODEL}, q AS (SELECT tid, strand, len, s + (e - s) // 3 AS pos FROM model), h AS (SELECT q.tid, q.strand, q.len, pos, sum(greatest(0, least(x."end", pos) - x."start" + 1)) AS before, bool_or(x."start" <= pos AND pos <= x."end") AS inside FROM q JOIN exons x USING (tid) GROUP BY ALL)
SELECT tid, CAST(pos AS BIGINT) AS pos, CAST(CASE WHEN NOT inside THEN NULL WHEN strand = '-' THEN len - before + 1 ELSE before END AS BIGINT) AS place FROM h""")
def transcript_positions(spark, d):
    """Genomic positions as places on the transcript, null within introns."""
    pos = F.col("start") + F.floor((F.col("end") - F.col("start")) / 3)
    return _transcripts(spark, d).select("tid", pos.alias("pos"), models.transcript_position(F.col("exons"), F.col("strand"), pos).alias("place"))


@register("exon_overlaps", f"""WITH {TX}, p AS (SELECT a.tid, b.tid AS tid2, sum(greatest(0, least(a."end", b."end") - greatest(a."start", b."start") + 1)) AS overlap FROM exons a JOIN exons b ON a.tid + 32 = b.tid GROUP BY ALL) SELECT tid, tid2, CAST(overlap AS BIGINT) AS overlap FROM p""")
def exon_overlaps(spark, d):
    """Bases that the exons of two models share."""
    t = _transcripts(spark, d).select("tid", "exons")
    b = t.select((F.col("tid") - 32).alias("tid"), F.col("tid").alias("tid2"), F.col("exons").alias("exons2"))
    return models.overlap_of_pairs(t.join(b, "tid")).select("tid", "tid2", "overlap")


@register("matching_ranges", f"""WITH {IV} SELECT a.id, b.id AS id2 FROM iv a JOIN iv b ON a.chrom = b.chrom AND a.id < b.id AND abs(a."start" - b."start") <= 600 AND abs(a."end" - b."end") <= 600""")
def matching_ranges(spark, d):
    """Ranges of one chromosome whose ends agree within a slack."""
    a = intervals(spark, d).select("id", "chrom", "start", "end")
    return models.match_join(a, a.toDF("id2", "chrom", "start2", "end2"), 600, ["chrom"]).where("id < id2").select("id", "id2")


@register("common_within_one", """WITH a AS (SELECT DISTINCT p_size AS k, p_partkey % 5000 AS pos FROM part WHERE p_partkey % 2 = 0), b AS (SELECT DISTINCT p_size AS k, p_partkey % 5000 AS pos FROM part WHERE p_partkey % 2 = 1) SELECT a.k, a.pos, b.pos AS pos2 FROM a JOIN b ON a.k = b.k AND abs(a.pos - b.pos) <= 1""")
def common_within_one(spark, d):
    """Sites that two outputs have in common, one position apart at most."""
    p = table(spark, d, "part").select(F.col("p_size").alias("k"), (F.col("p_partkey") % 5000).alias("pos"), (F.col("p_partkey") % 2).alias("set")).distinct()
    a = p.where("set = 0").select("k", "pos", F.col("pos").alias("start"), F.col("pos").alias("end"))
    b = p.where("set = 1").select("k", F.col("pos").alias("pos2"), F.col("pos").alias("start2"), F.col("pos").alias("end2"))
    return models.match_join(a, b, 1, ["k"]).select("k", "pos", "pos2")


#: A model on each record of 90 bases or more: three exons, the last one to the record's end; n is its length.
_GENOME = """g AS (SELECT doc_id, doc_id % 2 AS side, regexp_replace(translate(text, 'acgtnoiesr', 'ACGTNACGTA'), '[^ACGTN]', '', 'g') AS s FROM documents),
gm AS (SELECT doc_id, CASE WHEN side = 0 THEN '+' ELSE '-' END AS strand, s, length(s) AS n, length(s) // 3 AS a, length(s) // 2 AS b, 2 * length(s) // 3 AS c, 2 * length(s) // 3 + 5 + doc_id % 7 AS z FROM g WHERE length(s) >= 90)"""


def _genes(spark, d):
    """Three exons over the whole of each record of 90 bases or more: to a third, from the half to two thirds, and from 5 to 11 bases behind to the end."""
    s = F.regexp_replace(F.translate(F.col("text"), "acgtnoiesr", "ACGTNACGTA"), "[^ACGTN]", "")
    rows = table(spark, d, "documents").select("doc_id", F.when(F.col("doc_id") % 2 == 0, "+").otherwise("-").alias("strand"), s.alias("genome")).where("length(genome) >= 90")
    n = F.length("genome")
    block = lambda a, b: F.struct(a.cast("long").alias("start"), b.cast("long").alias("end"))
    third = F.floor(2 * n / 3)
    return rows.withColumn("exons", F.array(block(F.lit(1), F.floor(n / 3)), block(F.floor(n / 2), third), block(third + 5 + F.col("doc_id") % 7, n)))


@register("canonical_splice_only", f"""WITH {_GENOME}, i AS (SELECT doc_id, strand, unnest([substr(s, a + 1, 2) || substr(s, b - 2, 2), substr(s, c + 1, 2) || substr(s, z - 2, 2)]) AS p FROM gm),
t AS (SELECT doc_id, CASE WHEN strand = '+' THEN p ELSE reverse(translate(p, 'ACGTN', 'TGCAN')) END AS p FROM i) SELECT doc_id, count(*) FILTER (p IN ('GTAG', 'GCAG', 'ATAC')) AS canonical, bool_and(p IN ('GTAG', 'GCAG', 'ATAC')) AS every FROM t GROUP BY doc_id""")
def canonical_splice_only(spark, d):
    """How many introns of each model have canonical ends, and whether all have."""
    genes = _genes(spark, d)
    pairs = models.splice_pairs(F.col("genome"), F.col("exons"), F.col("strand"))
    every = models.canonical_only(genes).select("doc_id", F.lit(True).alias("every"))
    counted = genes.select("doc_id", F.size(F.filter(pairs, lambda p: seq.canonical_splice(p["donor"], p["acceptor"]))).cast("long").alias("canonical"))
    return counted.join(every, "doc_id", "left").select("doc_id", "canonical", F.coalesce("every", F.lit(False)).alias("every"))


@register("spliced_sequences", f"WITH {_GENOME}, j AS (SELECT doc_id, strand, substr(s, 1, a) || substr(s, b, c - b + 1) || substr(s, z) AS p FROM gm) SELECT doc_id, CASE WHEN strand = '+' THEN p ELSE reverse(translate(p, 'ACGTN', 'TGCAN')) END AS spliced FROM j")
def spliced_sequences(spark, d):
    return _genes(spark, d).select("doc_id", seq.splice(F.col("genome"), F.col("exons"), F.col("strand")).alias("spliced"))


@register("annotation_round_trip", f'WITH {TX} SELECT CAST(tid AS VARCHAR) AS tid, CAST(chrom AS VARCHAR) AS chrom, strand, "start", "end" FROM exons')
def annotation_round_trip(spark, d):
    """Models written as annotation lines, parsed, and their exon rows taken back."""
    return gff.exons(gff.parse_gff(gff.to_gff(_transcripts(spark, d))))


@register("annotation_attributes", f"""WITH {TX}, t AS (SELECT DISTINCT tid FROM exons) SELECT CAST(tid AS VARCHAR) AS id, 'g' || (tid % 100) AS gene, CAST(tid % 7 AS VARCHAR) AS level FROM t""")
def annotation_attributes(spark, d):
    """Attributes of either style, by name and as a map."""
    t = _transcripts(spark, d).select("tid")
    plain = F.concat(F.lit("ID="), "tid", F.lit(";gene=g"), F.col("tid") % 100, F.lit(";level="), F.col("tid") % 7)
    quoted = F.concat(F.lit('transcript_id "'), "tid", F.lit('"; gene_id "g'), F.col("tid") % 100, F.lit('"; level '), F.col("tid") % 7, F.lit(";"))
    a = F.when(F.col("tid") % 2 == 0, plain).otherwise(quoted)
    rows = t.select(a.alias("a"))
    either = lambda x, y: F.coalesce(gff.attribute(F.col("a"), x), gff.attribute(F.col("a"), y))
    return rows.select(either("ID", "transcript_id").alias("id"), either("gene", "gene_id").alias("gene"), gff.attribute_map(F.col("a"))["level"].alias("level"))


@register("bed12_lines", f"""WITH {MODEL} SELECT concat_ws(chr(9), m.chrom, m.s - 1, m.e, m.tid, '0', m.strand, m.s - 1, m.s - 1, '0', m.n, string_agg(CAST(x."end" - x."start" + 1 AS VARCHAR), ',' ORDER BY x."start") || ',', string_agg(CAST(x."start" - m.s AS VARCHAR), ',' ORDER BY x."start") || ',') AS value FROM model m JOIN exons x USING (tid) GROUP BY m.chrom, m.s, m.e, m.tid, m.strand, m.n""")
def bed12_lines(spark, d):
    return gff.to_bed12(_transcripts(spark, d))


@register("interval_index_lines", f"WITH {MODEL} SELECT '>' || tid || ' ' || chrom || ':' || CASE WHEN strand = '-' THEN e || '..' || s ELSE s || '..' || e END || ' ' || n || ' exons' AS value FROM model")
def interval_index_lines(spark, d):
    return gff.to_iit(_transcripts(spark, d))


@register("primary_models", f"WITH {MODEL} SELECT min(tid) AS tid, chrom, s AS \"start\" FROM model GROUP BY chrom, s")
def primary_models(spark, d):
    """One model per location: the smallest name."""
    return _transcripts(spark, d).groupBy("chrom", "start").agg(F.min("tid").alias("tid"))


@register("shifted_models", f'WITH {MODEL} SELECT tid, s + 1000 * CAST(chrom AS BIGINT) AS "start", e + 1000 * CAST(chrom AS BIGINT) AS "end" FROM model')
def shifted_models(spark, d):
    """Coordinates moved by the offset of their piece, looked up by name."""
    offsets = spark.range(25).select(F.col("id").alias("chrom"), (F.col("id") * 1000).alias("offset"))
    t = _transcripts(spark, d).join(offsets, "chrom")
    return t.select("tid", (F.col("start") + F.col("offset")).alias("start"), (F.col("end") + F.col("offset")).alias("end"))


@register("attached_cds", f"""WITH {MODEL}, c AS (SELECT tid, min("start") + 30 AS lo, max("end") - 30 AS hi FROM exons WHERE k % 2 = 1 GROUP BY tid) SELECT tid, CASE WHEN lo < hi THEN lo END AS cds_start, CASE WHEN lo < hi THEN hi END AS cds_end FROM model LEFT JOIN c USING (tid)""")
def attached_cds(spark, d):
    """Coding ranges from another set of rows, by parent."""
    t = _transcripts(spark, d)
    odd = t.select("tid", F.posexplode("exons").alias("k", "e")).where("k % 2 = 0").groupBy("tid").agg((F.min("e.start") + 30).alias("lo"), (F.max("e.end") - 30).alias("hi"))
    both = t.select("tid").join(odd, "tid", "left")
    return both.select("tid", F.when(F.col("lo") < F.col("hi"), F.col("lo")).alias("cds_start"), F.when(F.col("lo") < F.col("hi"), F.col("hi")).alias("cds_end"))


@register("domain_positions", f"""WITH {MODEL}, q AS (SELECT tid, chrom, strand, s, e, 3 * (tid % 20) + 1 AS a, 3 * (tid % 20) + 30 AS b FROM model WHERE len >= 100) SELECT tid, CAST(CASE WHEN strand = '-' THEN e - b + 1 ELSE s + a - 1 END AS BIGINT) AS "start", CAST(CASE WHEN strand = '-' THEN e - a + 1 ELSE s + b - 1 END AS BIGINT) AS "end" FROM q""")
def domain_positions(spark, d):
    """Domains of proteins as genomic ranges of their first exon's strand."""
    t = _transcripts(spark, d).where(tx.length(F.col("exons")) >= 100)
    a, b = 3 * (F.col("tid") % 20) + 1, 3 * (F.col("tid") % 20) + 30
    minus = F.col("strand") == "-"
    return t.select("tid", F.when(minus, F.col("end") - b + 1).otherwise(F.col("start") + a - 1).alias("start"), F.when(minus, F.col("end") - a + 1).otherwise(F.col("start") + b - 1).alias("end"))


@register("log_factorials", "WITH q AS (SELECT l_linenumber AS k, CAST(l_quantity AS BIGINT) AS n FROM lineitem) SELECT k, round(max(lgamma(n + 1)), 6) AS highest, round(avg(lgamma(n + 1)), 6) AS mean FROM q GROUP BY k")
def log_factorials(spark, d):
    q = table(spark, d, "lineitem").select(F.col("l_linenumber").alias("k"), stats.log_factorial(F.col("l_quantity").cast("long")).alias("f"))
    return q.groupBy("k").agg(F.round(F.max("f"), 6).alias("highest"), F.round(F.avg("f"), 6).alias("mean"))


@register("records_by_length", "SELECT doc_id, row_number() OVER (ORDER BY length(text) DESC, doc_id) AS place FROM documents")
def records_by_length(spark, d):
    r = table(spark, d, "documents").select("doc_id", F.length("text").alias("n"))
    return number_rows(r, [], [F.desc_nulls_last("n"), F.col("doc_id")]).select("doc_id", "place")


@register("reads_by_name", "SELECT conv_id, turn, row_number() OVER (ORDER BY 'c' || conv_id, turn) AS place FROM conversations")
def reads_by_name(spark, d):
    r = table(spark, d, "conversations").select("conv_id", "turn", F.concat(F.lit("c"), "conv_id").alias("name"))
    return number_rows(r, [], ["name", "turn"]).select("conv_id", "turn", "place")


@register("single_hit_probes", """WITH h AS (SELECT DISTINCT l_orderkey AS probe, l_suppkey % 50 AS hit FROM lineitem) SELECT probe, min(hit) AS hit FROM h GROUP BY probe HAVING count(*) = 1""")
def single_hit_probes(spark, d):
    """Probes all of whose hits are one sequence."""
    h = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("probe"), (F.col("l_suppkey") % 50).alias("hit"))
    return h.groupBy("probe").agg(F.min("hit").alias("hit"), F.max("hit").alias("last")).where("hit = last").drop("last")


@register("signal_islands", f"""WITH {IV}, r AS (SELECT *, max("end") OVER (PARTITION BY chrom ORDER BY "start", "end", id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM iv WHERE value >= 5), n AS (SELECT *, sum(CASE WHEN reach IS NULL OR "start" > reach + 600 THEN 1 ELSE 0 END) OVER (PARTITION BY chrom ORDER BY "start", "end", id ROWS UNBOUNDED PRECEDING) AS k FROM r)
SELECT chrom, min("start") AS "start", max("end") AS "end", count(*) AS n FROM n GROUP BY chrom, k""")
def signal_islands(spark, d):
    """Sorted mappings of enough signal as loci."""
    return iv.islands(intervals(spark, d).where("value >= 5"), 600).select("chrom", "start", "end", "n")
