"""Filters and clusters of annotation, pairs, k-mer dictionaries, assembly."""

from pyspark.sql import functions as F

from helixframe.functions.seq import codons_of
from helixframe.operators import assembly, intervals as iv
from helixframe.operators.graph import connected_components
from helixframe.operators.order import running_sum
from helixframe.plans.catalogue import register
from helixframe.plans.views import IV, intervals, table
from helixframe.storage import materialize


@register("tss_clusters", f"""WITH {IV}, t AS (SELECT DISTINCT chrom, strand, CASE WHEN strand = 'click' THEN "end" ELSE "start" END AS tss FROM iv),
g AS (SELECT *, tss - lag(tss) OVER (PARTITION BY chrom, strand ORDER BY tss) AS d FROM t), c AS (SELECT *, sum(CASE WHEN d IS NULL OR d > 900 THEN 1 ELSE 0 END) OVER (PARTITION BY chrom, strand ORDER BY tss) AS k FROM g)
SELECT chrom, strand, min(tss) AS first, max(tss) AS last, count(*) AS sites FROM c GROUP BY chrom, strand, k""")
def tss_clusters(spark, d):
    """5' ends of one strand that lie within 900 positions of the next, transitively."""
    tss = F.when(F.col("strand") == "click", F.col("end")).otherwise(F.col("start"))
    t = intervals(spark, d).select("chrom", "strand", tss.alias("start")).distinct().withColumn("end", F.col("start")).withColumn("id", F.col("start"))
    return iv.islands(t, 900, ["chrom", "strand"]).select("chrom", "strand", F.col("start").alias("first"), F.col("end").alias("last"), F.col("n").alias("sites"))


@register("isoform_fraction", f"""WITH {IV}, m AS (SELECT a.id, a.value, max(b.value) AS top FROM iv a JOIN iv b ON a.chrom = b.chrom AND a."start" <= b."end" AND b."start" <= a."end" GROUP BY a.id, a.value) SELECT id FROM m WHERE value >= 0.3 * top""")
def isoform_fraction(spark, d):
    """Predictions with at least 30 % of the largest coverage that overlaps them."""
    a = intervals(spark, d)
    b = a.select("chrom", F.col("start").alias("start2"), F.col("end").alias("end2"), F.col("value").alias("other"))
    m = iv.overlap_join(a, b).groupBy("id", "value").agg(F.max("other").alias("top"))
    return m.where(F.col("value") >= 0.3 * F.col("top")).select("id")


@register("pair_filter", f"""WITH {IV}, m AS (SELECT a.id, b.id AS id2, b."start" - a."end" AS insert FROM (SELECT * FROM iv WHERE strand = 'view') a JOIN (SELECT * FROM iv WHERE strand = 'click') b ON a.chrom = b.chrom)
SELECT id, id2, insert FROM m WHERE insert BETWEEN 0 AND 200000""")
def pair_filter(spark, d):
    """Mates on one reference, in facing orientation, within a distance window."""
    a = intervals(spark, d)
    b = a.where("strand = 'click'").select("chrom", F.col("id").alias("id2"), F.col("start").alias("start2"), (F.col("start") + 0).alias("end2"))
    # a mate begins at most 200,000 positions behind the end
    reach = a.where("strand = 'view'").select("chrom", "id", F.col("end").alias("start"), (F.col("end") + 200000).alias("end"))
    return iv.overlap_join(reach, b).select("id", "id2", (F.col("start2") - F.col("start")).alias("insert"))


@register("reduce_references", f"""WITH {IV} SELECT count(*) AS n FROM iv r WHERE strand = 'signup' AND EXISTS (SELECT 1 FROM iv q WHERE q.strand <> 'signup' AND q.chrom = r.chrom AND q."start" <= r."end" AND r."start" <= q."end")""")
def reduce_references(spark, d):
    """References that any query overlaps: the denominator of a reduced sensitivity."""
    a = intervals(spark, d)
    q = a.where("strand <> 'signup'").select("chrom", F.col("start").alias("start2"), F.col("end").alias("end2"))
    return iv.overlapping(a.where("strand = 'signup'"), q).agg(F.count(F.lit(1)).alias("n"))


@register("cds_validity", """WITH d AS (SELECT doc_id, regexp_replace(translate(text, 'acgtnoiesr', 'ACGTNACGTA'), '[^ACGTN]', '', 'g') AS s FROM documents), c AS (SELECT doc_id, s, list_transform(range(1, length(s) - 1, 3), lambda i: substr(s, i, 3)) AS codons FROM d WHERE length(s) >= 6)
SELECT doc_id, codons[1] = 'ATG' AS start_codon, list_has_any(['TAA', 'TAG', 'TGA'], codons[-1:]) AS stop_codon, len(list_filter(codons[:-2], lambda x: x IN ('TAA', 'TAG', 'TGA'))) > 0 AS inner_stop FROM c""")
def cds_validity(spark, d):
    """Whether reading frame 1 starts, stops and is free of stops within."""
    s = F.regexp_replace(F.translate("text", "acgtnoiesr", "ACGTNACGTA"), "[^ACGTN]", "")
    c = table(spark, d, "documents").select("doc_id", s.alias("s")).where("length(s) >= 6")
    c = c.select("doc_id", codons_of(F.col("s")).alias("c"))
    stop = lambda x: x.isin("TAA", "TAG", "TGA")
    return c.select("doc_id", (F.col("c")[0] == "ATG").alias("start_codon"), stop(F.element_at("c", -1)).alias("stop_codon"), F.exists(F.slice("c", 1, F.size("c") - 1), stop).alias("inner_stop"))


@register("kmer_dictionary_filter", """WITH w AS (SELECT conv_id, turn, regexp_replace(lower(text), '[^a-z]', '', 'g') AS s FROM conversations), k AS (SELECT DISTINCT substr(s, 1, 6) AS k FROM w WHERE turn = 1 AND length(s) >= 6)
SELECT conv_id, turn FROM w WHERE turn > 1 AND length(s) >= 12 AND (substr(s, 1, 6) IN (SELECT k FROM k) OR substr(s, length(s) - 5, 6) IN (SELECT k FROM k))""")
def kmer_dictionary_filter(spark, d):
    """Reads whose first or last 6-mer stands in a dictionary: candidates exploded and joined."""
    w = table(spark, d, "conversations").select("conv_id", "turn", F.regexp_replace(F.lower("text"), "[^a-z]", "").alias("s"))
    k = w.where("turn = 1 and length(s) >= 6").select(F.substring("s", 1, 6).alias("k")).distinct()
    ends = F.explode(F.array(F.substring("s", 1, 6), F.substring(F.col("s"), F.length("s") - 5, F.lit(6)))).alias("k")
    return w.where("turn > 1 and length(s) >= 12").select("conv_id", "turn", ends).join(k, "k", "left_semi").select("conv_id", "turn").distinct()


@register("interval_signal", f"""WITH {IV} SELECT a.id, count(*) AS n, avg(b.value) AS mean, coalesce(stddev_samp(b.value), 0) AS sd FROM (SELECT * FROM iv WHERE strand = 'purchase') a JOIN iv b ON a.chrom = b.chrom AND a."start" <= b."start" AND b."start" <= a."end" GROUP BY a.id""")
def interval_signal(spark, d):
    """Mean and deviation of a signal's points within intervals."""
    a = intervals(spark, d)
    p = a.select("chrom", F.col("start").alias("start2"), F.col("start").alias("end2"), F.col("value").alias("v"))
    m = iv.overlap_join(a.where("strand = 'purchase'"), p)
    return m.groupBy("id").agg(F.count(F.lit(1)).alias("n"), F.avg("v").alias("mean"), F.coalesce(F.stddev_samp("v"), F.lit(0.0)).alias("sd"))


@register("precursor_windows", f"""WITH {IV}, w AS (SELECT id, "start" AS s, "end" AS e FROM iv) SELECT id, 1 AS k, greatest(1, s - (136 - (e - s + 1)) // 2) AS lo, e + (136 - (e - s + 1)) // 2 AS hi FROM w WHERE e - s + 1 > 60 AND e - s + 1 <= 136
UNION ALL SELECT id, 1, greatest(1, s - 22), e + 84 FROM w WHERE e - s + 1 <= 60 UNION ALL SELECT id, 2, greatest(1, s - 84), e + 22 FROM w WHERE e - s + 1 <= 60""")
def precursor_windows(spark, d):
    """Windows around short regions: one padded to 136 positions, or two to either side."""
    w = intervals(spark, d).withColumn("n", F.col("end") - F.col("start") + 1).where("n <= 136")
    pad = F.floor((136 - F.col("n")) / 2)
    at = lambda k, lo, hi: F.struct(F.lit(k).alias("k"), F.greatest(F.lit(1), lo).alias("lo"), hi.alias("hi"))
    s, e = F.col("start"), F.col("end")
    both = F.when(F.col("n") > 60, F.array(at(1, s - pad, e + pad))).otherwise(F.array(at(1, s - 22, e + 84), at(2, s - 84, e + 22)))
    return w.select("id", F.explode(both).alias("x")).select("id", "x.k", "x.lo", "x.hi")


@register("extend_terminal", f"""WITH {IV}, m AS (SELECT a.id, least(a."start", min(b."start")) AS lo, greatest(a."end", max(b."end")) AS hi FROM (SELECT * FROM iv WHERE strand = 'purchase') a JOIN (SELECT * FROM iv WHERE strand = 'view') b ON a.chrom = b.chrom AND a."start" <= b."end" AND b."start" <= a."end" GROUP BY a.id, a."start", a."end") SELECT * FROM m""")
def extend_terminal(spark, d):
    """Ends of models moved out to the mappings that overlap them."""
    a = intervals(spark, d)
    b = a.where("strand = 'view'").select("chrom", F.col("start").alias("start2"), F.col("end").alias("end2"))
    m = iv.overlap_join(a.where("strand = 'purchase'"), b)
    return m.groupBy("id", "start", "end").agg(F.min("start2").alias("s2"), F.max("end2").alias("e2")).select("id", F.least("start", "s2").alias("lo"), F.greatest("end", "e2").alias("hi"))


@register("priority_merge", f"""WITH {IV}, p AS (SELECT * FROM iv WHERE strand = 'purchase'), v AS (SELECT * FROM iv WHERE strand = 'view')
SELECT id FROM p UNION ALL SELECT id FROM v WHERE NOT EXISTS (SELECT 1 FROM p WHERE p.chrom = v.chrom AND p."start" <= v."end" AND v."start" <= p."end")""")
def priority_merge(spark, d):
    """Two prediction sets: the second counts only where the first has nothing."""
    a = intervals(spark, d)
    p, v = a.where("strand = 'purchase'"), a.where("strand = 'view'")
    free = iv.overlap_count(v, p.select("chrom", F.col("start").alias("start2"), F.col("end").alias("end2"))).where("n = 0")
    return p.select("id").unionByName(free.select("id"))


@register("split_contigs", """WITH p AS (SELECT page_id, length(html) AS n FROM pages), o AS (SELECT page_id, n, sum(n + 100) OVER (PARTITION BY page_id % 5 ORDER BY page_id) - n - 100 AS before FROM p) SELECT page_id, page_id % 5 AS scaffold, CAST(before + 1 AS BIGINT) AS "start", CAST(before + n AS BIGINT) AS "end" FROM o""")
def split_contigs(spark, d):
    """Contigs laid out along scaffolds, 100 positions apart: offsets from a running sum."""
    p = table(spark, d, "pages").select("page_id", (F.col("page_id") % 5).alias("scaffold"), F.length("html").cast("long").alias("n"))
    p = running_sum(p.withColumn("step", F.col("n") + 100), ["scaffold"], ["page_id"], "step", "before")
    return p.select("page_id", "scaffold", (F.col("before") + 1).alias("start"), (F.col("before") + F.col("n")).alias("end"))


@register("assemble_bundles")
def assemble_bundles(spark, d):
    """Transcripts from two-block reads derived from lineitem: splice graphs and heaviest paths per bundle."""
    li = table(spark, d, "lineitem")
    start = (F.col("l_suppkey") % 50) * 20000 + (F.col("l_linenumber") % 3) * 40
    block = lambda s, n: F.struct(s.cast("long").alias("start"), (s + n - 1).cast("long").alias("end"))
    second = start + 1000 + (F.col("l_partkey") % 2) * 300
    blocks = F.array(block(start, 300), block(second, 250))
    key = F.xxhash64(*[F.col(c) for c in ("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice")])
    r = li.select(key.alias("id"), (F.col("l_suppkey") % 7).cast("string").alias("chrom"), F.when(F.col("l_returnflag") == "R", "-").otherwise("+").alias("strand"), blocks.alias("blocks"), F.lit(1.0).alias("weight"))
    return assembly.assemble(r, least_cov=1.0).select("chrom", "bundle", "strand", "tx", F.round("cov", 6).alias("cov"), F.to_json("exons").alias("exons"))


@register("reading_frames", """WITH d AS (SELECT doc_id, regexp_replace(translate(text, 'acgtnoiesr', 'ACGTNACGTA'), '[^ACGTN]', '', 'g') AS s FROM documents) SELECT doc_id, CAST(len(regexp_extract_all(s, 'ATG')) AS BIGINT) AS starts, CAST(len(regexp_extract_all(s, 'TAA|TAG|TGA')) AS BIGINT) AS stops FROM d""")
def reading_frames(spark, d):
    s = F.regexp_replace(F.translate("text", "acgtnoiesr", "ACGTNACGTA"), "[^ACGTN]", "")
    n = lambda p: F.size(F.regexp_extract_all("s", F.lit(f"({p})"), 1)).cast("long")
    return table(spark, d, "documents").select("doc_id", s.alias("s")).select("doc_id", n("ATG").alias("starts"), n("TAA|TAG|TGA").alias("stops"))


@register("linked_components", """WITH RECURSIVE e AS (SELECT DISTINCT o_custkey * 2 AS a, l_suppkey * 2 + 1 AS b FROM orders JOIN lineitem ON o_orderkey = l_orderkey), n AS (SELECT a, b FROM e UNION ALL SELECT b, a FROM e),
t(node, low, i) AS (SELECT DISTINCT a, a, 0 FROM n UNION ALL SELECT n.b, min(t.low), min(t.i) + 1 FROM t JOIN n ON n.a = t.node WHERE t.i < 12 GROUP BY n.b), c AS (SELECT node, min(low) AS component FROM t GROUP BY node) SELECT component, count(*) AS n FROM c GROUP BY component""")
def linked_components(spark, d):
    """Customers and suppliers linked by orders: components of a bipartite graph over all order lines, smallest name first."""
    o = table(spark, d, "orders").join(table(spark, d, "lineitem"), F.col("o_orderkey") == F.col("l_orderkey"))
    edges = o.select((F.col("o_custkey") * 2).alias("src"), (F.col("l_suppkey") * 2 + 1).alias("dst")).distinct()
    return connected_components(materialize(edges, "bipartite")).groupBy("component").agg(F.count(F.lit(1)).alias("n"))
