"""Transcripts, hits, reads and statistics over records derived from the star tables."""

from pyspark.sql import functions as F

from helixframe.operators import hits as hit_ops
from helixframe.operators import reads, stats
from helixframe.operators import transcripts as tx
from helixframe.operators.order import tiles
from helixframe.operators.relational import top_n
from helixframe.plans.catalogue import register
from helixframe.plans.views import IV, hits, intervals, table
from helixframe.storage import materialize
from helixframe.streaming.bundles import point_bundles


def _transcripts(spark, d):
    """A transcript per order: exons from its lines, on a chromosome of the customer's nation."""
    o = table(spark, d, "orders").select("o_orderkey", (F.col("o_custkey") % 25).alias("chrom"), F.when(F.col("o_orderstatus") == "O", "-").otherwise("+").alias("strand"))
    base = (F.col("l_orderkey") % 400) * 5000 + F.col("l_linenumber") * 600
    li = table(spark, d, "lineitem").select("l_orderkey", (base + F.col("l_partkey") % 3 * 20).alias("start"), (base + 200 + F.col("l_quantity").cast("long")).alias("end"))
    e = li.join(o, F.col("l_orderkey") == F.col("o_orderkey")).select(F.col("o_orderkey").alias("tid"), "chrom", "strand", "start", "end")
    return tx.assemble(e)


TX = """ex AS (SELECT l_orderkey AS tid, o_custkey % 25 AS chrom, CASE WHEN o_orderstatus = 'O' THEN '-' ELSE '+' END AS strand, (l_orderkey % 400) * 5000 + l_linenumber * 600 + l_partkey % 3 * 20 AS "start", (l_orderkey % 400) * 5000 + l_linenumber * 600 + 200 + CAST(l_quantity AS BIGINT) AS "end" FROM lineitem JOIN orders ON l_orderkey = o_orderkey),
er AS (SELECT *, max("end") OVER (PARTITION BY tid ORDER BY "start", "end" ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM ex),
en AS (SELECT *, sum(CASE WHEN reach IS NULL OR "start" > reach + 1 THEN 1 ELSE 0 END) OVER (PARTITION BY tid ORDER BY "start", "end" ROWS UNBOUNDED PRECEDING) AS k FROM er),
exons AS (SELECT tid, chrom, strand, k, min("start") AS "start", max("end") AS "end" FROM en GROUP BY ALL)"""


@register("assemble_exons", f'WITH {TX} SELECT tid, chrom, strand, min("start") AS "start", max("end") AS "end", count(*) AS exons, CAST(sum("end" - "start" + 1) AS BIGINT) AS covlen FROM exons GROUP BY tid, chrom, strand')
def assemble_exons(spark, d):
    t = _transcripts(spark, d)
    return t.select("tid", "chrom", "strand", "start", "end", F.size("exons").cast("long").alias("exons"), tx.length(F.col("exons")).alias("covlen"))


@register("intron_list", f'WITH {TX}, n AS (SELECT tid, "end" + 1 AS "start", lead("start") OVER (PARTITION BY tid ORDER BY "start") - 1 AS "end" FROM exons) SELECT tid, "start", "end" FROM n WHERE "end" IS NOT NULL AND "end" - "start" + 1 >= 100')
def intron_list(spark, d):
    i = _transcripts(spark, d).select("tid", F.explode(tx.introns(F.col("exons"))).alias("i"))
    return i.select("tid", "i.start", "i.end").where("end - start + 1 >= 100")


@register("redundancy_collapse", f"""WITH {TX}, i AS (SELECT tid, chrom, strand, "start", "end", lead("start") OVER (PARTITION BY tid ORDER BY "start") AS nxt FROM exons),
c AS (SELECT tid, chrom, strand, coalesce(string_agg(CASE WHEN nxt IS NOT NULL THEN ("end" + 1) || '-' || (nxt - 1) END, ',' ORDER BY "start"), '') AS chain, sum("end" - "start" + 1) AS len FROM i GROUP BY ALL),
m AS (SELECT max({{'l': len, 't': -tid}}).t * -1 AS tid, count(*) AS n FROM c WHERE chain <> '' GROUP BY chrom, strand, chain)
SELECT tid, n FROM m UNION ALL SELECT tid, 1 FROM c WHERE chain = ''""")
def redundancy_collapse(spark, d):
    return tx.collapse(_transcripts(spark, d))


#: Components of transcripts and islands of exons ("xn"), by passing the least name along.
LOCI = """WITH RECURSIVE e AS (SELECT DISTINCT tid, chrom || strand || g AS g FROM xn), p AS (SELECT DISTINCT a.tid AS a, b.tid AS b FROM e a JOIN e b USING (g)),
t(node, low) AS (SELECT tid, tid FROM e UNION SELECT p.b, t.low FROM t JOIN p ON p.a = t.node WHERE t.low <= p.b) SELECT node AS tid, min(low) AS locus FROM t GROUP BY node"""


@register("exon_loci", f"""WITH {TX}, xr AS (SELECT *, max("end") OVER (PARTITION BY chrom, strand ORDER BY "start", "end" ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM exons),
xn AS (SELECT *, sum(CASE WHEN reach IS NULL OR "start" > reach THEN 1 ELSE 0 END) OVER (PARTITION BY chrom, strand ORDER BY "start", "end" ROWS UNBOUNDED PRECEDING) AS g FROM xr), l AS ({LOCI}) SELECT tid, locus FROM l""")
def exon_loci(spark, d):
    return tx.loci(_transcripts(spark, d))


def _halves(spark, d):
    t = materialize(_transcripts(spark, d), "models")
    return t.where("tid div 400 % 2 = 0"), t.where("tid div 400 % 2 = 1")


#: Relations of even to odd transcripts ("codes": tid, ref, code, ov), one row per pair and code.
CODES = f"""{TX}, nx AS (SELECT *, lead("start") OVER (PARTITION BY tid ORDER BY "start") AS nxt FROM exons),
introns AS (SELECT tid, "end" + 1 AS a, nxt - 1 AS b FROM nx WHERE nxt IS NOT NULL),
model AS (SELECT tid, chrom, strand, min("start") AS s, max("end") AS e, sum("end" - "start" + 1) AS len, count(*) AS n, min("end") AS first_end, max("start") AS last_start, coalesce(string_agg(CASE WHEN nxt IS NOT NULL THEN ("end" + 1) || '-' || (nxt - 1) END, ',' ORDER BY "start"), '') AS chain FROM nx GROUP BY tid, chrom, strand),
q AS (SELECT * FROM model WHERE tid // 400 % 2 = 0), r AS (SELECT * FROM model WHERE tid // 400 % 2 = 1),
pair AS (SELECT q.tid, r.tid AS ref, q.strand = r.strand AS same, q.s, q.e, q.len, q.n, q.chain, q.first_end, q.last_start, r.s AS s2, r.e AS e2, r.len AS len2, r.n AS n2, r.chain AS chain2 FROM q JOIN r ON q.chrom = r.chrom AND q.s <= r.e AND r.s <= q.e),
o AS (SELECT pair.tid, ref, sum(greatest(0, least(x."end", y."end") - greatest(x."start", y."start") + 1)) AS ov FROM pair JOIN exons x ON x.tid = pair.tid JOIN exons y ON y.tid = ref GROUP BY ALL),
ii AS (SELECT pair.tid, ref, bool_or(x.a = y.a OR x.b = y.b) AS shared, bool_or(x.a <= y.b AND y.a <= x.b) AS crossing FROM pair JOIN introns x ON x.tid = pair.tid JOIN introns y ON y.tid = ref GROUP BY ALL),
ri AS (SELECT pair.tid, ref, bool_or(s >= y.a AND e <= y.b) AS in_intron, bool_or(least(e, y.b) - greatest(s, y.a) + 1 >= 10 AND e - s + 1 > least(e, y.b) - greatest(s, y.a) + 1 + 10) AS reaches FROM pair JOIN introns y ON y.tid = ref GROUP BY ALL),
re AS (SELECT pair.tid, ref, bool_or(s > y."start" - 8 AND e < y."end" + 8) AS in_exon, bool_or(y."end" = first_end AND (y."start" = s2 OR y."start" - s < 4)) AS head, bool_or(y."start" = last_start AND (y."end" = e2 OR e - y."end" < 4)) AS tail FROM pair JOIN exons y ON y.tid = ref GROUP BY ALL),
codes AS (SELECT pair.tid, pair.ref, CAST(ov AS BIGINT) AS ov, CASE WHEN NOT same THEN CASE WHEN coalesce(crossing, false) THEN 's' WHEN ov > 0 THEN 'x' END
 WHEN n = 1 AND n2 = 1 THEN CASE WHEN ov >= 0.8::DOUBLE * greatest(len, len2) THEN '=' WHEN len < len2 AND ov >= 0.8::DOUBLE * len THEN 'c' ELSE 'o' END
 WHEN n = 1 THEN CASE WHEN in_exon THEN 'c' WHEN in_intron THEN 'i' WHEN reaches THEN 'e' ELSE 'o' END
 WHEN coalesce(in_intron, false) THEN 'i' WHEN chain = chain2 THEN '=' WHEN contains(',' || chain2 || ',', ',' || chain || ',') AND head AND tail THEN 'c' WHEN coalesce(shared, false) THEN 'j' ELSE 'o' END AS code
 FROM pair JOIN o USING (tid, ref) JOIN re USING (tid, ref) LEFT JOIN ri USING (tid, ref) LEFT JOIN ii USING (tid, ref)
 UNION ALL SELECT q.tid, r.tid, 0, 'p' FROM q JOIN r ON q.chrom = r.chrom AND q.strand = r.strand AND CASE WHEN q.strand = '-' THEN r.s - q.e ELSE q.s - r.e END BETWEEN 1 AND 2000
 UNION ALL SELECT tid, NULL, 0, 'r' FROM q WHERE tid % 11 >= 5),
best AS (SELECT tid, ref, code FROM codes WHERE code IS NOT NULL QUALIFY row_number() OVER (PARTITION BY tid ORDER BY instr('=cjeosxipr', code), ov DESC, ref) = 1),
coded AS (SELECT q.tid, coalesce(code, 'u') AS code, ref FROM q LEFT JOIN best USING (tid))"""


def _coded(spark, d):
    q, r = _halves(spark, d)
    share = q.select("tid", ((F.col("tid") % 11) / 10).alias("share"))
    return tx.best_codes(q, r, share)


@register("class_codes", f"WITH {CODES} SELECT tid, code, ref FROM coded")
def class_codes(spark, d):
    return _coded(spark, d)


@register("class_code_counts", f"WITH {CODES} SELECT code, count(*) AS n, count(DISTINCT ref) AS refs FROM coded GROUP BY code")
def class_code_counts(spark, d):
    """How often each relation is the closest, and to how many references."""
    return _coded(spark, d).groupBy("code").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("ref").alias("refs"))


@register("sn_sp", f"""WITH {TX}, i AS (SELECT tid, chrom, strand, "start", "end", lead("start") OVER (PARTITION BY tid ORDER BY "start") AS nxt FROM exons),
c AS (SELECT tid, chrom, strand, string_agg(CASE WHEN nxt IS NOT NULL THEN ("end" + 1) || '-' || (nxt - 1) END, ',' ORDER BY "start") AS x FROM i GROUP BY ALL),
u AS (SELECT 'exon' AS level, tid, chrom, strand, "start" || '-' || "end" AS x FROM exons UNION ALL SELECT 'intron', tid, chrom, strand, ("end" + 1) || '-' || (nxt - 1) FROM i WHERE nxt IS NOT NULL UNION ALL SELECT 'chain', tid, chrom, strand, x FROM c WHERE x IS NOT NULL),
b AS (SELECT level, chrom, strand, x, max(CASE WHEN tid // 400 % 2 = 0 THEN 1 ELSE 0 END) AS q, max(CASE WHEN tid // 400 % 2 = 1 THEN 1 ELSE 0 END) AS r FROM u GROUP BY ALL),
s AS (SELECT level, CAST(sum(q * r) AS BIGINT) AS matched, CAST(sum(r) AS BIGINT) AS reference, CAST(sum(q) AS BIGINT) AS query FROM b GROUP BY level)
SELECT *, least(100.0::DOUBLE, 100.0::DOUBLE * matched / reference) AS sensitivity, least(100.0::DOUBLE, 100.0::DOUBLE * matched / query) AS precision FROM s""")
def sn_sp(spark, d):
    """Sensitivity and precision at exon, intron and chain level; the base level is in ``sn_sp_base``."""
    return tx.sensitivity(*_halves(spark, d), levels=("exon", "intron", "chain"))


@register("sn_sp_base", f"""WITH {TX}, x AS (SELECT *, tid // 400 % 2 AS side FROM exons),
xr AS (SELECT *, max("end") OVER (PARTITION BY side, chrom, strand ORDER BY "start", "end" ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM x),
xn AS (SELECT *, sum(CASE WHEN reach IS NULL OR "start" > reach THEN 1 ELSE 0 END) OVER (PARTITION BY side, chrom, strand ORDER BY "start", "end" ROWS UNBOUNDED PRECEDING) AS g FROM xr),
f AS (SELECT side, chrom, strand, min("start") AS "start", max("end") AS "end" FROM xn GROUP BY side, chrom, strand, g),
m AS (SELECT CAST(coalesce(sum(least(a."end", b."end") - greatest(a."start", b."start") + 1), 0) AS BIGINT) AS matched FROM f a JOIN f b ON a.side = 0 AND b.side = 1 AND a.chrom = b.chrom AND a.strand = b.strand AND a."start" <= b."end" AND b."start" <= a."end"),
t AS (SELECT CAST(sum(CASE WHEN side = 1 THEN "end" - "start" + 1 ELSE 0 END) AS BIGINT) AS reference, CAST(sum(CASE WHEN side = 0 THEN "end" - "start" + 1 ELSE 0 END) AS BIGINT) AS query FROM f)
SELECT 'base' AS level, matched, reference, query, least(100.0::DOUBLE, 100.0::DOUBLE * matched / reference) AS sensitivity, least(100.0::DOUBLE, 100.0::DOUBLE * matched / query) AS precision FROM m, t""")
def sn_sp_base(spark, d):
    return tx.sensitivity(*_halves(spark, d), levels=("base",))


@register("sn_sp_transcript", f"""WITH {TX}, c AS (SELECT tid, chrom, strand, string_agg("start" || '-' || "end", ',' ORDER BY "start") AS x FROM exons GROUP BY ALL),
b AS (SELECT chrom, strand, x, max(CASE WHEN tid // 400 % 2 = 0 THEN 1 ELSE 0 END) AS q, max(CASE WHEN tid // 400 % 2 = 1 THEN 1 ELSE 0 END) AS r FROM c GROUP BY ALL),
s AS (SELECT 'transcript' AS level, CAST(sum(q * r) AS BIGINT) AS matched, CAST(sum(r) AS BIGINT) AS reference, CAST(sum(q) AS BIGINT) AS query FROM b)
SELECT *, least(100.0::DOUBLE, 100.0::DOUBLE * matched / reference) AS sensitivity, least(100.0::DOUBLE, 100.0::DOUBLE * matched / query) AS precision FROM s""")
def sn_sp_transcript(spark, d):
    """Transcripts that are equal exon by exon."""
    return tx.sensitivity(*_halves(spark, d), levels=("transcript",))


@register("sn_sp_locus", f"""WITH {TX}, xr AS (SELECT *, max("end") OVER (PARTITION BY chrom, strand ORDER BY "start", "end" ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM exons),
xn AS (SELECT *, sum(CASE WHEN reach IS NULL OR "start" > reach THEN 1 ELSE 0 END) OVER (PARTITION BY chrom, strand ORDER BY "start", "end" ROWS UNBOUNDED PRECEDING) AS g FROM xr),
l AS ({LOCI}),
i AS (SELECT tid, "start", "end", lead("start") OVER (PARTITION BY tid ORDER BY "start") AS nxt FROM exons),
c AS (SELECT tid, CASE WHEN count(*) > 1 THEN string_agg(CASE WHEN nxt IS NOT NULL THEN ("end" + 1) || '-' || (nxt - 1) END, ',' ORDER BY "start") ELSE min("start") || ':' || min("end") END AS x FROM i GROUP BY tid),
b AS (SELECT locus, x, max(CASE WHEN tid // 400 % 2 = 0 THEN 1 ELSE 0 END) AS q, max(CASE WHEN tid // 400 % 2 = 1 THEN 1 ELSE 0 END) AS r FROM c JOIN l USING (tid) GROUP BY ALL),
p AS (SELECT locus, max(q * r) AS m, max(q) AS q, max(r) AS r FROM b GROUP BY locus),
s AS (SELECT 'locus' AS level, CAST(sum(m) AS BIGINT) AS matched, CAST(sum(r) AS BIGINT) AS reference, CAST(sum(q) AS BIGINT) AS query FROM p)
SELECT *, least(100.0::DOUBLE, 100.0::DOUBLE * matched / reference) AS sensitivity, least(100.0::DOUBLE, 100.0::DOUBLE * matched / query) AS precision FROM s""")
def sn_sp_locus(spark, d):
    """Loci in which the two sets have a chain in common."""
    return tx.sensitivity(*_halves(spark, d), levels=("locus",))


@register("containment_parents", """WITH h AS (SELECT l_partkey AS kid, l_suppkey + 1000000 AS parent, CAST(sum(l_quantity) AS BIGINT) AS weight FROM lineitem GROUP BY ALL)
SELECT kid, max({'w': weight, 'p': -parent}).p * -1 AS parent FROM h GROUP BY kid""")
def containment_parents(spark, d):
    h = table(spark, d, "lineitem").groupBy(F.col("l_partkey").alias("kid"), (F.col("l_suppkey") + 1000000).alias("parent")).agg(F.sum("l_quantity").cast("long").alias("weight"))
    return hit_ops.best_parents(h)


@register("hit_coverage", f"""WITH {IV}, r AS (SELECT *, max("end") OVER (PARTITION BY chrom ORDER BY "start", "end", id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM iv)
SELECT chrom AS query, CAST(sum(greatest(0, "end" - greatest("start", coalesce(reach + 1, "start")) + 1)) AS BIGINT) AS covered, count(*) AS hits FROM r GROUP BY chrom""")
def hit_coverage(spark, d):
    """Bases of each query that its hits cover together."""
    return hit_ops.coverage(intervals(spark, d))


@register("top_hits", "SELECT l_orderkey AS q, list_sort(list(l_partkey), 'DESC')[1:5] AS best FROM lineitem GROUP BY l_orderkey")
def top_hits(spark, d):
    h = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("q"), F.col("l_partkey").alias("h"))
    # five rows of each query are left before any list is made
    return top_n(h, ["q"], [F.desc("h")], 5).groupBy("q").agg(F.sort_array(F.collect_list("h"), asc=False).alias("best"))


@register("transitive_clusters", f"""WITH {IV}, e AS (SELECT id, chrom, strand, "start" // 7200 AS k FROM iv), l AS (SELECT DISTINCT a.id AS a, b.id AS b FROM e a JOIN e b ON a.chrom = b.chrom AND a.strand = b.strand AND b.k = a.k + 1),
s AS (SELECT a, b FROM l UNION SELECT b, a FROM l), r AS (WITH RECURSIVE t(node, low) AS (SELECT DISTINCT a, a FROM s UNION SELECT s.b, t.low FROM t JOIN s ON s.a = t.node) SELECT node, min(low) AS cluster FROM t GROUP BY node)
SELECT node AS id, cluster FROM r""")
def transitive_clusters(spark, d):
    """Transitive closure of hits between all rows of neighbouring windows.

    Every row of a window meets every row of the next, so a hit from each to
    one row of the other closes to the same clusters.
    """
    e = intervals(spark, d).select("id", "chrom", "strand", F.floor(F.col("start") / 7200).alias("k"))
    head = e.groupBy("chrom", "strand", "k").agg(F.min("id").alias("h"))
    beside = head.select("h", "chrom", "strand", F.explode(F.array(F.col("k") - 1, F.col("k") + 1)).alias("k"))
    return hit_ops.transitive(e.join(beside, ["chrom", "strand", "k"]).select(F.col("id").alias("q"), "h")).select("id", "cluster")


@register("fold_change_fisher", """WITH n AS (SELECT l_partkey AS k, count(*) FILTER (l_returnflag = 'R') AS n1, count(*) FILTER (l_returnflag = 'A') AS n2 FROM lineitem WHERE l_returnflag IN ('R', 'A') GROUP BY l_partkey),
t AS (SELECT CAST(sum(n1) AS BIGINT) AS t1, CAST(sum(n2) AS BIGINT) AS t2, count(*) AS tests FROM n), m AS (SELECT DISTINCT n1, n2, t1, t2 FROM n, t),
x AS (SELECT *, unnest(range(greatest(0, n1 + n2 - t2), least(n1 + n2, t1) + 1)) AS i FROM m),
l AS (SELECT *, lgamma(n1 + n2 + 1) - lgamma(i + 1) - lgamma(n1 + n2 - i + 1) + lgamma(t1 + t2 - n1 - n2 + 1) - lgamma(t1 - i + 1) - lgamma(t2 - n1 - n2 + i + 1) - lgamma(t1 + t2 + 1) + lgamma(t1 + 1) + lgamma(t2 + 1) AS lp FROM x),
p AS (SELECT n1, n2, least(1.0::DOUBLE, sum(exp(lp)) FILTER (lp <= own + 1e-9)) AS p FROM (SELECT *, max(lp) FILTER (i = n1) OVER (PARTITION BY n1, n2) AS own FROM l) GROUP BY n1, n2)
SELECT k, n.n1, n.n2, round(log2((n.n2 + 0.5) / (t2 + 0.5)) - log2((n.n1 + 0.5) / (t1 + 0.5)), 6) AS fold, round(p, 4) AS p, round(least(1.0::DOUBLE, p * tests), 4) AS p_bonferroni FROM n JOIN p USING (n1, n2), t""")
def fold_change_fisher(spark, d):
    """Counts of two samples per part: fold change and two-sided Fisher probability against the totals."""
    flag = F.col("l_returnflag")
    n = table(spark, d, "lineitem").where(flag.isin("R", "A")).groupBy(F.col("l_partkey").alias("k")).agg(F.sum(F.when(flag == "R", 1).otherwise(0)).alias("n1"), F.sum(F.when(flag == "A", 1).otherwise(0)).alias("n2"))
    return stats.compare_counts(n).select("k", "n1", "n2", F.round("fold", 6).alias("fold"), F.round("p", 4).alias("p"), F.round("p_bonferroni", 4).alias("p_bonferroni"))


@register("dust_masked")
def dust_masked(spark, d):
    """How many letters of each text's first field of letters are of low complexity."""
    t = F.regexp_replace(F.translate(F.lower("text"), "oiesr", "acgta"), "[^acgtn]", "")
    b = table(spark, d, "benchmark").select("item_id", t.alias("s"))
    return b.select("item_id", F.size(reads.dust_ranges("s")).alias("ranges"), F.length(F.regexp_replace(reads.dust_mask("s"), "[^N]", "")).alias("masked"))


@register("trim_report")
def trim_report(spark, d):
    """Conversation turns as reads: what trimming takes off and what it drops."""
    s = F.regexp_replace(F.translate(F.upper("text"), "OIESR", "ACGTA"), "[^ACGTN]", "")
    q = F.regexp_replace("s", ".", "I")
    r = table(spark, d, "conversations").select("conv_id", "turn", s.alias("seq")).withColumn("s", F.col("seq")).select("conv_id", "turn", "seq", q.alias("qual"))
    return reads.trim_reads(r, adapters=("AGATCGGAAGAGC",)).groupBy("trash").agg(F.count(F.lit(1)).alias("n"), F.sum(F.length("trimmed")).alias("bases"))


@register("point_bundles", """WITH e AS (SELECT event_id, user_id, CAST(floor(epoch(ts)) AS BIGINT) AS t FROM events), g AS (SELECT *, t - lag(t) OVER (PARTITION BY user_id ORDER BY t, event_id) AS gap FROM e),
n AS (SELECT *, sum(CASE WHEN gap IS NULL OR gap >= 3600 THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY t, event_id) AS k FROM g) SELECT user_id AS chrom, min(t) AS "start", max(t) AS "last", count(*) AS n FROM n GROUP BY user_id, k""")
def point_bundles_query(spark, d):
    """Bundles of point events as session windows; the same transformation runs on a stream."""
    e = table(spark, d, "events").select(F.col("user_id").alias("chrom"), F.expr("timestampdiff(SECOND, TIMESTAMP_NTZ '1970-01-01 00:00:00', ts)").alias("pos"))
    return point_bundles(e, 3600)


@register("length_sorted_split", "SELECT doc_id, CAST(ntile(8) OVER (PARTITION BY lang ORDER BY n_chars DESC, doc_id) AS INTEGER) AS part FROM documents")
def length_sorted_split(spark, d):
    """Records of a set in parts of equal count by length."""
    return tiles(table(spark, d, "documents").select("doc_id", "lang", "n_chars"), ["lang"], [F.desc("n_chars"), F.col("doc_id")], 8).select("doc_id", "part")
