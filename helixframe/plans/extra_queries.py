"""Queries over the smaller operators."""

from pyspark.sql import functions as F

from helixframe.functions import seq
from helixframe.operators import extras, genotypes, models, reads
from helixframe.operators import intervals as iv
from helixframe.operators import transcripts as tx
from helixframe.plans.alignment_queries import BLOCKS, SAM, sam
from helixframe.plans.catalogue import register
from helixframe.plans.format_queries import BASES, PART
from helixframe.plans.model_queries import MODEL
from helixframe.plans.sequence_queries import DNA, _codon_map, _dna
from helixframe.plans.transcript_queries import CODES, TX, _coded, _halves, _transcripts
from helixframe.plans.views import IV, intervals, table


@register("search_hits", """WITH h AS (SELECT l_orderkey % 500 AS q, l_partkey % 50 AS h, 100 - 100 * l_discount AS pid, l_extendedprice AS score, l_tax AS e_value, CASE WHEN l_returnflag = 'R' THEN '-' ELSE '+' END AS strand, l_orderkey, l_linenumber FROM lineitem)
SELECT q, h, score, l_orderkey, l_linenumber FROM h WHERE pid >= 93 AND score >= 1000 AND e_value <= 0.06 AND strand = '+' QUALIFY row_number() OVER (PARTITION BY q, h ORDER BY score DESC, pid, e_value, strand, l_orderkey, l_linenumber) <= 2""")
def search_hits(spark, d):
    """Identity, score, e-value and strand bounds, and two segments a pair at most."""
    h = table(spark, d, "lineitem").selectExpr("l_orderkey % 500 AS q", "l_partkey % 50 AS h", "100 - 100 * l_discount AS pid", "l_extendedprice AS score", "l_tax AS e_value", "IF(l_returnflag = 'R', '-', '+') AS strand", "l_orderkey", "l_linenumber")
    return extras.search_filter(h, 93, 1000, 0.06, "+", 2).select("q", "h", "score", "l_orderkey", "l_linenumber")


@register("included_models", f"""WITH {MODEL}, a AS (SELECT tid, chrom, strand, s, e, tid % 10 AS cov FROM model WHERE n = 1), p AS (SELECT a.tid, x.tid AS tid2, m.len FROM a JOIN exons x ON a.chrom = x.chrom AND a.strand = x.strand AND a.s >= x."start" AND a.e <= x."end" AND a.tid <> x.tid JOIN model m ON m.tid = x.tid WHERE x.tid % 10 >= a.cov AND m.len > a.e - a.s + 1)
SELECT tid, tid2 AS within FROM p QUALIFY row_number() OVER (PARTITION BY tid ORDER BY len DESC, tid2) = 1""")
def included_models(spark, d):
    """Single-exon predictions inside exons of longer ones that are covered as well."""
    return extras.included(_transcripts(spark, d).withColumn("cov", F.col("tid") % 10))


@register("called_genotypes", f"""WITH {SAM}, {BLOCKS}, p AS (SELECT rname, b, q, seq, unnest(range(len)) AS i FROM blocks), c AS (SELECT rname AS chrom, CAST(b + i AS BIGINT) AS pos, substr(seq, CAST(q + i AS BIGINT), 1) AS base, count(*) AS n FROM p GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY chrom, pos ORDER BY n DESC, base) AS k FROM c), g AS (SELECT chrom, pos, max(base) FILTER (k = 1) AS x, max(base) FILTER (k = 2) AS y, max(n) FILTER (k = 1) AS n, coalesce(max(n) FILTER (k = 2), 0) AS m FROM r WHERE k <= 2 GROUP BY chrom, pos),
l AS (SELECT chrom, pos, x, y, n * log10(0.99::DOUBLE) + m * log10(0.01::DOUBLE) AS a, CASE WHEN y IS NULL THEN -1e300::DOUBLE ELSE (n + m) * log10(0.5::DOUBLE) END AS b, CASE WHEN y IS NULL THEN -1e300::DOUBLE ELSE m * log10(0.99::DOUBLE) + n * log10(0.01::DOUBLE) END AS c FROM g)
SELECT chrom, pos, CASE WHEN b > a THEN x || y ELSE x || x END AS genotype, round(least(99.0::DOUBLE, 10 * (greatest(a, b) - greatest(least(a, b), c))), 6) AS quality FROM l WHERE a <> b""")
def called_genotypes(spark, d):
    """Likeliest genotype of each position and by how much."""
    g = extras.genotypes(reads.pileup(sam(spark, d).withColumnRenamed("rname", "chrom")))
    return g.select("chrom", "pos", "genotype", F.round("quality", 6).alias("quality")).where("quality > 0")


#: What the rows of a position tell of each base (s) and how many there are (c), then the cost of each genotype.
_COSTS = " UNION ALL ".join(f"SELECT chrom, pos, depth, '{g}' AS genotype, {k} AS k, greatest(0, {' + '.join(f's{b}' for b in 'ACGT' if b not in g)}{'' if g[0] == g[1] else f' - 4.343::DOUBLE * (lgamma(c{g[0]} + c{g[1]} + 1) - lgamma(c{g[1]} + 1) - lgamma(c{g[0]} + 1) - ln(2) * (c{g[0]} + c{g[1]}))'}) AS cost FROM b" for k, g in enumerate(genotypes.GENOTYPES))


@register("quality_genotypes", f"""WITH {SAM}, {BLOCKS}, p AS (SELECT rname, flag, mapq, b, q, seq, qual, unnest(range(len)) AS i FROM blocks),
r AS (SELECT rname AS chrom, CAST(b + i AS BIGINT) AS pos, substr(seq, CAST(q + i AS BIGINT), 1) AS base, greatest(4, least(ascii(substr(qual, CAST(q + i AS BIGINT), 1)) - 33, mapq, 63)) AS e, (flag & 16) > 0 AS rev, row_number() OVER () AS id FROM p WHERE ascii(substr(qual, CAST(q + i AS BIGINT), 1)) - 33 >= 13),
o AS (SELECT chrom, pos, base, e, count(*) OVER (PARTITION BY chrom, pos) AS n, row_number() OVER (PARTITION BY chrom, pos, base, rev ORDER BY e DESC, id) - 1 AS w, row_number() OVER (PARTITION BY chrom, pos, base ORDER BY e DESC, rev DESC, id) - 1 AS c FROM r WHERE base IN ('A', 'C', 'G', 'T')),
x AS (SELECT *, list_transform(range(0, n + 1), lambda j: exp(lgamma(n + 1) - lgamma(j + 1) - lgamma(n - j + 1) + j * ln(pow(10.0::DOUBLE, -e / 10.0::DOUBLE)) + (n - j) * ln(1 - pow(10.0::DOUBLE, -e / 10.0::DOUBLE)))) AS t FROM o),
y AS (SELECT chrom, pos, n, base, (pow(0.83::DOUBLE, w) * 0.97::DOUBLE + 0.03::DOUBLE) * -10 * log10(list_sum(t[c + 2:]) / list_sum(t[c + 1:])) AS v FROM x),
b AS (SELECT chrom, pos, any_value(n) AS depth, {", ".join(f"coalesce(sum(v) FILTER (base = '{z}'), 0) AS s{z}, count(*) FILTER (base = '{z}') AS c{z}" for z in "ACGT")} FROM y GROUP BY chrom, pos),
l AS ({_COSTS}), k AS (SELECT chrom, pos, depth, genotype, cost, lead(cost) OVER o AS second, row_number() OVER o AS place FROM l WINDOW o AS (PARTITION BY chrom, pos ORDER BY round(cost, 7), k))
SELECT chrom, pos, depth, genotype, round(second - cost, 4) AS quality FROM k WHERE place = 1""")
def quality_genotypes(spark, d):
    """Likeliest genotype of each position from base qualities and strands, with errors that depend on one another."""
    rows = genotypes.quality_bases(sam(spark, d).withColumnRenamed("rname", "chrom"))
    return genotypes.call_genotypes(rows).select("chrom", "pos", "depth", "genotype", F.round("quality", 4).alias("quality"))


@register("edit_counts", f"""WITH p AS (SELECT p_partkey, {BASES} AS a, translate({BASES}, 'G', CASE WHEN p_size % 2 = 0 THEN 'T' ELSE 'G' END) AS b FROM part) SELECT p_partkey, CAST(len(list_filter(range(1, 25), lambda i: a[i] <> b[i])) AS BIGINT) AS edits FROM p""")
def edit_counts(spark, d):
    """Edits of reads against their reference, counted anew."""
    p = table(spark, d, "part").selectExpr("p_partkey", f"{BASES} AS a", f"translate({BASES}, 'G', IF(p_size % 2 = 0, 'T', 'G')) AS b")
    return p.select("p_partkey", extras.edit_count(F.col("a"), F.col("b")).cast("long").alias("edits"))


@register("mismatch_strings", f"""WITH p AS (SELECT p_partkey, {BASES} AS a, translate({BASES}, 'G', CASE WHEN p_size % 2 = 0 THEN 'T' ELSE 'G' END) AS b FROM part), x AS (SELECT p_partkey, b, unnest(list_append(list_filter(range(1, 25), lambda i: a[i] <> b[i]), 25)) AS i FROM p),
y AS (SELECT p_partkey, i, b[i] AS base, i - coalesce(lag(i) OVER (PARTITION BY p_partkey ORDER BY i), 0) - 1 AS run FROM x) SELECT p_partkey, string_agg(run || base, '' ORDER BY i) AS md FROM y GROUP BY p_partkey""")
def mismatch_strings(spark, d):
    p = table(spark, d, "part").selectExpr("p_partkey", f"{BASES} AS a", f"translate({BASES}, 'G', IF(p_size % 2 = 0, 'T', 'G')) AS b")
    return p.select("p_partkey", extras.mismatch_string(F.col("a"), F.col("b")).alias("md"))


@register("vector_trimmed", f"""WITH r AS (SELECT p_partkey AS id, {BASES} AS s, CASE WHEN p_size % 3 = 0 THEN 4 + p_size % 7 ELSE 0 END AS l, CASE WHEN p_size % 5 = 0 THEN 20 - p_size % 4 ELSE 25 END AS r FROM part) SELECT id, substr(s, l + 1, r - l - 1) AS seq FROM r WHERE r - l - 1 >= 12""")
def vector_trimmed(spark, d):
    """Reads without the vector at their ends."""
    p = table(spark, d, "part")
    left = p.where("p_size % 3 = 0").selectExpr("p_partkey AS id", "2 AS lo", "4 + p_size % 7 AS hi")
    right = p.where("p_size % 5 = 0").selectExpr("p_partkey AS id", "20 - p_size % 4 AS lo", "24 AS hi")
    return extras.vector_trim(p.selectExpr("p_partkey AS id", f"{BASES} AS seq"), left.unionByName(right), within=4, least=12)


@register("component_overlaps", """WITH p AS (SELECT l_suppkey AS contig, l_orderkey * 10 + l_linenumber AS name, (l_partkey * 37) % 20000 AS s, (l_partkey * 37) % 20000 + 60 + l_linenumber AS e FROM lineitem) SELECT a.contig, a.name, b.name AS name2, greatest(a.s, b.s) AS lo, least(a.e, b.e) AS hi FROM p a JOIN p b ON a.contig = b.contig AND a.name < b.name AND a.s <= b.e AND b.s <= a.e WHERE least(a.e, b.e) - greatest(a.s, b.s) + 1 >= 40""")
def component_overlaps(spark, d):
    """Stretches of a contig in which two components overlap."""
    p = table(spark, d, "lineitem").selectExpr("l_suppkey AS contig", "l_orderkey * 10 + l_linenumber AS name", "(l_partkey * 37) % 20000 AS start", "(l_partkey * 37) % 20000 + 60 + l_linenumber AS end")
    return extras.component_overlaps(p, 40)


@register("laid_out_scaffolds", f"""WITH p AS (SELECT p_partkey // 6 AS scaffold, (p_partkey % 6) * (20 + p_size % 2 * 10) + p_partkey % 3 AS s, p_partkey, CASE WHEN p_size % 2 = 0 THEN {BASES} ELSE reverse(translate({BASES}, 'ACGT', 'TGCA')) END AS seq FROM part), g AS (SELECT *, s - (lag(s + 23) OVER (PARTITION BY scaffold ORDER BY s, s + 23, p_partkey)) - 1 AS gap FROM p)
SELECT scaffold, string_agg(repeat('N', CAST(CASE WHEN gap < 0 THEN 20 ELSE coalesce(gap, 0) END AS BIGINT)) || seq, '' ORDER BY s, p_partkey) AS seq FROM g WHERE scaffold IN (SELECT scaffold FROM p GROUP BY scaffold HAVING count(DISTINCT s) = count(*)) GROUP BY scaffold""")
def laid_out_scaffolds(spark, d):
    """Scaffolds from a layout of contigs: gaps by position, twenty N where contigs overlap."""
    p = table(spark, d, "part").selectExpr("p_partkey DIV 6 AS scaffold", "(p_partkey % 6) * (20 + p_size % 2 * 10) + p_partkey % 3 AS start", "IF(p_size % 2 = 0, '+', '-') AS strand", f"{BASES} AS seq").withColumn("end", F.col("start") + 23)
    clear = p.groupBy("scaffold").agg((F.count_distinct("start") == F.count(F.lit(1))).alias("ok")).where("ok")
    return extras.layout_sequence(p.join(clear.select("scaffold"), "scaffold", "left_semi"))


@register("header_records", "SELECT 'SQ' AS kind, 'c' || s_suppkey AS name, CAST(1000 + s_nationkey AS VARCHAR) AS length FROM supplier")
def header_records(spark, d):
    """Reference records of an alignment header."""
    lines = table(spark, d, "supplier").selectExpr("concat('@SQ\tSN:c', s_suppkey, '\tLN:', 1000 + s_nationkey) AS value").unionByName(spark.range(1).selectExpr("'read\t0' AS value"))
    h = extras.sam_header(lines)
    return h.select("kind", F.col("tags")["SN"].alias("name"), F.col("tags")["LN"].alias("length"))


@register("merged_stop_codons", f"""WITH {MODEL} SELECT tid, chrom, strand, CASE WHEN strand = '-' THEN s + 7 ELSE s + 10 END AS cds_start, CASE WHEN strand = '-' THEN e - 10 ELSE e - 7 END AS cds_end FROM model""")
def merged_stop_codons(spark, d):
    """Coding ranges that take their stop codons in."""
    t = _transcripts(spark, d)
    minus = F.col("strand") == "-"
    cds = t.select("tid", "chrom", "strand", F.lit("cds").alias("kind"), (F.col("start") + 10).alias("start"), (F.col("end") - 10).alias("end"))
    stop = t.select("tid", "chrom", "strand", F.lit("stop").alias("kind"), F.when(minus, F.col("start") + 7).otherwise(F.col("end") - 9).alias("start"), F.when(minus, F.col("start") + 9).otherwise(F.col("end") - 7).alias("end"))
    start = stop.withColumn("kind", F.lit("start")).withColumn("start", F.lit(0).cast("long"))
    return extras.merge_stop_codons(cds.unionByName(stop).unionByName(start))


@register("reads_with_qualities", f"WITH s AS (SELECT p_partkey AS id, {BASES} AS seq FROM part WHERE p_size > 10), q AS (SELECT p_partkey AS id, repeat(chr(33 + p_size), 24) AS qual FROM part WHERE p_size < 40) SELECT id, '@' || id || chr(10) || seq || chr(10) || '+' || chr(10) || qual AS record FROM s JOIN q USING (id)")
def reads_with_qualities(spark, d):
    """Sequences and qualities of two files joined by name into records of four lines."""
    p = table(spark, d, "part")
    s = p.where("p_size > 10").selectExpr("p_partkey AS id", f"{BASES} AS seq")
    q = p.where("p_size < 40").selectExpr("p_partkey AS id", "repeat(char(33 + p_size), 24) AS qual")
    return s.join(q, "id").select("id", F.concat(F.lit("@"), "id", F.lit("\n"), "seq", F.lit("\n+\n"), "qual").alias("record"))


@register("gene_locations", """SELECT 'g' || o_orderkey AS id, CAST(o_custkey % 100 AS DOUBLE) AS cov, CAST(o_orderkey % 50 + 50 AS DOUBLE) AS pid FROM orders""")
def gene_locations(spark, d):
    """Name, coverage and identity out of model lines."""
    line = F.concat(F.lit("ID=g"), "o_orderkey", F.lit(";Cov="), F.col("o_custkey") % 100, F.lit(";PID="), F.col("o_orderkey") % 50 + 50)
    a = table(spark, d, "orders").select(line.alias("a"))
    part = lambda k: F.regexp_extract("a", rf"{k}=([^;]+)", 1)
    return a.select(part("ID").alias("id"), part("Cov").cast("double").alias("cov"), part("PID").cast("double").alias("pid"))


@register("distinct_mappings", f"WITH {MODEL} SELECT chrom, strand, s AS \"start\", e AS \"end\", min(tid) AS tid FROM model WHERE coalesce(gap, 0) <= 1200 GROUP BY ALL")
def distinct_mappings(spark, d):
    """Mappings once each, without those that have long introns."""
    t = models.keep(_transcripts(spark, d), max_intron=1200)
    return t.groupBy("chrom", "strand", "start", "end").agg(F.min("tid").alias("tid"))


@register("locus_report", f"""WITH {CODES} SELECT ref, count(*) AS models, count(*) FILTER (code = '=') AS equal, CAST(max(len) AS BIGINT) AS longest FROM coded JOIN q USING (tid) WHERE ref IS NOT NULL GROUP BY ref""")
def locus_report(spark, d):
    """Per reference: its closest models, those that are equal, and the longest."""
    c = _coded(spark, d).where("ref is not null").join(_transcripts(spark, d).select("tid", tx.length(F.col("exons")).alias("len")), "tid")
    return c.groupBy("ref").agg(F.count(F.lit(1)).alias("models"), F.sum(F.when(F.col("code") == "=", 1).otherwise(0)).alias("equal"), F.max("len").alias("longest"))


@register("dumped_rows", "SELECT p_partkey AS id, p_name AS name, CAST(p_size AS BIGINT) AS size FROM part")
def dumped_rows(spark, d):
    """Rows out of the insert statements of a dump, eight to a statement."""
    p = table(spark, d, "part").selectExpr("p_partkey DIV 8 AS k", "concat('(', p_partkey, ',\\'', p_name, '\\',', p_size, ')') AS r")
    s = p.groupBy("k").agg(F.concat(F.lit("INSERT INTO `term` VALUES "), F.array_join(F.collect_list("r"), ","), F.lit(";")).alias("value"))
    r = s.select(F.explode(F.regexp_extract_all("value", F.lit(r"\((\d+,'(?:[^'\\]|\\.)*',\d+)\)"), 1)).alias("r"))
    part = lambda i: F.regexp_extract("r", r"^(\d+),'((?:[^'\\]|\\.)*)',(\d+)$", i)
    return r.select(part(1).cast("long").alias("id"), part(2).alias("name"), part(3).cast("long").alias("size"))


@register("references_by_database", f"SELECT split_part(k, ':', 1) AS db, count(*) AS n, count(DISTINCT id) AS ids FROM (SELECT {PART} AS id, unnest(['EMBL:' || p_partkey, 'GO:' || p_size]) AS k FROM part) GROUP BY 1")
def references_by_database(spark, d):
    """Cross references split by their tag."""
    k = F.explode(F.array(F.concat(F.lit("EMBL:"), "p_partkey"), F.concat(F.lit("GO:"), "p_size")))
    r = table(spark, d, "part").select(F.expr(PART).alias("id"), k.alias("k"))
    return r.groupBy(F.split_part("k", F.lit(":"), F.lit(1)).alias("db")).agg(F.count(F.lit(1)).alias("n"), F.count_distinct("id").alias("ids"))


@register("largest_drops", f"""WITH {IV}, w AS (SELECT chrom, "start", "end", unnest(range("start" // 3600, "end" // 3600 + 1)) AS w FROM iv), d AS (SELECT chrom, w, sum(least("end", (w + 1) * 3600 - 1) - greatest("start", w * 3600) + 1) / 3600.0::DOUBLE AS depth FROM w GROUP BY chrom, w),
s AS (SELECT chrom, w AS lo, depth AS a, 0.0::DOUBLE AS b FROM d UNION ALL SELECT chrom, w - 1, 0, depth FROM d), x AS (SELECT chrom, lo, abs(sum(a) - sum(b)) AS drop FROM s GROUP BY chrom, lo) SELECT chrom, CAST((lo + 1) * 3600 AS BIGINT) AS pos, round(drop, 6) AS drop FROM x WHERE drop >= 0.5 QUALIFY row_number() OVER (PARTITION BY chrom ORDER BY drop DESC, lo) = 1""")
def largest_drops(spark, d):
    """Where the depth of each chromosome changes most between adjacent windows."""
    return iv.largest_drop(intervals(spark, d), 3600, 0.5).select("chrom", "pos", F.round("drop", 6).alias("drop"))


@register("fuzzy_exon_matches", f"""WITH {TX}, q AS (SELECT DISTINCT chrom, strand, "start" AS s, "end" AS e FROM exons WHERE tid // 400 % 2 = 0), r AS (SELECT DISTINCT chrom, strand, "start" AS s, "end" AS e FROM exons WHERE tid // 400 % 2 = 1), m AS (SELECT q.chrom, q.strand, q.s, q.e, r.s AS s2, r.e AS e2 FROM q JOIN r ON q.chrom = r.chrom AND q.strand = r.strand AND abs(q.s - r.s) <= 5 AND abs(q.e - r.e) <= 5)
SELECT (SELECT count(*) FROM q) AS query, (SELECT count(*) FROM r) AS reference, (SELECT count(*) FROM (SELECT DISTINCT chrom, strand, s, e FROM m)) AS query_matched, (SELECT count(*) FROM (SELECT DISTINCT chrom, strand, s2, e2 FROM m)) AS reference_matched""")
def fuzzy_exon_matches(spark, d):
    """Exons that agree with one of the other set but for five positions."""
    return models.fuzzy_exons(*_halves(spark, d), 5)


@register("open_frames", f"""WITH {DNA}, codes AS (SELECT {_codon_map()} AS code), both_strands AS (SELECT doc_id, s, reverse(translate(s, 'ACGTN', 'TGCAN')) AS r FROM dna WHERE length(s) >= 6),
f AS ({" UNION ALL ".join(f"SELECT doc_id, array_to_string(list_transform(range({1 + k}, length({x}) - 1, 3), lambda i: coalesce(code[substr({x}, i, 3)], 'X')), '') AS p FROM both_strands, codes" for x in "sr" for k in range(3))})
SELECT doc_id, count(*) FILTER (instr(substr(p, 1, greatest(0, length(p) - 1)), '.') = 0) AS frames FROM f GROUP BY doc_id""")
def open_frames(spark, d):
    """How many of the six frames have no stop before their last codon."""
    frames = F.filter(seq.six_frames(F.col("s")), lambda p: ~F.rtrim(F.regexp_replace(p, ".$", "")).contains("."))
    return _dna(spark, d).where("length(s) >= 6").select("doc_id", F.size(frames).cast("long").alias("frames"))
