"""Interval operators over the event intervals."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from helixframe.operators import intervals as iv
from helixframe.operators.graph import connected_components
from helixframe.operators.order import in_blocks, number_rows
from helixframe.plans.catalogue import register
from helixframe.plans.views import IV, intervals
from helixframe.storage import materialize

BUNDLE = """, r AS (SELECT *, max("end") OVER (PARTITION BY {keys} ORDER BY "start", "end", id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM iv),
n AS (SELECT *, CAST(sum(CASE WHEN reach IS NULL OR "start" > reach + {gap} THEN 1 ELSE 0 END) OVER (PARTITION BY {keys} ORDER BY "start", "end", id) AS BIGINT) AS island FROM r)"""


@register("bundle_islands", f'WITH {IV}{BUNDLE.format(keys="chrom", gap=50)} SELECT chrom, island, min("start") AS "start", max("end") AS "end", count(*) AS n FROM n GROUP BY chrom, island')
def bundle_islands(spark, d):
    return iv.islands(intervals(spark, d), 50)


@register("coverage_islands", f'WITH {IV}{BUNDLE.format(keys="chrom, strand", gap=3600)} SELECT chrom, strand, island, min("start") AS "start", max("end") AS "end", count(*) AS n FROM n GROUP BY chrom, strand, island')
def coverage_islands(spark, d):
    return iv.islands(intervals(spark, d), 3600, ["chrom", "strand"])


@register("containment_clusters", f"""WITH {IV}, c AS (SELECT id, "end", max("end") OVER (PARTITION BY chrom ORDER BY "start", "end" DESC, id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM iv)
SELECT id, coalesce("end" <= reach + 3, false) AS contained FROM c""")
def containment_clusters(spark, d):
    return iv.containment(intervals(spark, d), 3).select("id", "contained")


DEPTH = """, e AS (SELECT chrom, "start" AS pos, {w} AS d, 1 AS c FROM iv UNION ALL SELECT chrom, "end" + 1, -({w}), -1 FROM iv),
g AS (SELECT chrom, pos, sum(d) AS d, sum(c) AS c FROM e GROUP BY chrom, pos),
s AS (SELECT chrom, pos, lead(pos) OVER (PARTITION BY chrom ORDER BY pos) - 1 AS e, sum(d) OVER (PARTITION BY chrom ORDER BY pos) AS depth, sum(c) OVER (PARTITION BY chrom ORDER BY pos) AS o FROM g)"""


@register("depth_per_base", f'WITH {IV}{DEPTH.format(w=1)} SELECT chrom, pos AS "start", e AS "end", CAST(depth AS BIGINT) AS depth FROM s WHERE o > 0')
def depth_per_base(spark, d):
    return iv.depth(intervals(spark, d)).withColumn("depth", F.col("depth").cast("long"))


@register("weighted_depth", f'WITH {IV}{DEPTH.format(w="(id % 4 + 1)")} SELECT chrom, pos AS "start", e AS "end", CAST(depth AS DOUBLE) / 12 AS depth FROM s WHERE o > 0')
def weighted_depth(spark, d):
    # multiplicities 1 to 4 in twelfths, so that sums are exact
    return iv.depth(intervals(spark, d), weight=(F.col("id") % 4 + 1)).withColumn("depth", F.col("depth").cast("double") / 12)


def _pairs(spark, d):
    a = intervals(spark, d)
    return a, a.select("chrom", F.col("start").alias("start2"), F.col("end").alias("end2"), F.col("id").alias("id2"), F.col("strand").alias("strand2"))


@register("interval_overlap_join", f"""WITH {IV} SELECT a.id, b.id AS id2, least(a."end", b."end") - greatest(a."start", b."start") + 1 AS overlap
FROM iv a JOIN iv b ON a.chrom = b.chrom AND a."start" <= b."end" AND b."start" <= a."end" AND a.id < b.id""")
def interval_overlap_join(spark, d):
    a, b = _pairs(spark, d)
    return iv.overlap_join(a, b).where("id < id2").select("id", "id2", iv.overlap_length(F.col("start"), F.col("end"), F.col("start2"), F.col("end2")).alias("overlap"))


@register("overlap_within", f'WITH {IV} SELECT a.id, b.id AS id2 FROM iv a JOIN iv b ON a.chrom = b.chrom AND a."start" >= b."start" AND a."end" <= b."end" AND a.id <> b.id')
def overlap_within(spark, d):
    a, b = _pairs(spark, d)
    within = (F.col("start") >= F.col("start2")) & (F.col("end") <= F.col("end2"))
    return iv.overlap_join(a, b, how=within).where("id <> id2").select("id", "id2")


@register("opposite_strand_overlap", f"""WITH {IV} SELECT a.id, count(*) AS n FROM iv a JOIN iv b ON a.chrom = b.chrom AND a.strand <> b.strand AND a."start" <= b."end" AND b."start" <= a."end" GROUP BY a.id""")
def opposite_strand_overlap(spark, d):
    """How many rows of another strand overlap each: all that do, less those of its own."""
    a, b = _pairs(spark, d)
    own = iv.overlap_count(a, b.withColumnRenamed("strand2", "strand"), ["chrom", "strand"]).withColumnRenamed("n", "own")
    return iv.overlap_count(a, b).join(own, "id").select("id", (F.col("n") - F.col("own")).alias("n")).where("n > 0")


@register("overlap_count_per_feature", f"""WITH {IV} SELECT a.id, count(b.id) AS n FROM iv a LEFT JOIN (SELECT * FROM iv WHERE strand = 'purchase') b ON a.chrom = b.chrom AND a."start" <= b."end" AND b."start" <= a."end" GROUP BY a.id""")
def overlap_count_per_feature(spark, d):
    a, b = _pairs(spark, d)
    return iv.overlap_count(a, b.where("strand2 = 'purchase'"))


@register("overlap_semi_join", f"""WITH {IV} SELECT DISTINCT a.id FROM iv a WHERE strand <> 'click' AND EXISTS (SELECT 1 FROM iv b WHERE b.strand = 'click' AND a.chrom = b.chrom AND a."start" <= b."end" AND b."start" <= a."end")""")
def overlap_semi_join(spark, d):
    a, b = _pairs(spark, d)
    return iv.overlapping(a.where("strand <> 'click'"), b.where("strand2 = 'click'"))


@register("overlap_anti_join", f"""WITH {IV} SELECT a.id FROM iv a WHERE strand <> 'click' AND NOT EXISTS (SELECT 1 FROM iv b WHERE b.strand = 'click' AND a.chrom = b.chrom AND a."start" <= b."end" AND b."start" <= a."end")""")
def overlap_anti_join(spark, d):
    a, b = _pairs(spark, d)
    return iv.overlap_count(a.where("strand <> 'click'"), b.where("strand2 = 'click'")).where("n = 0").select("id")


@register("nearest_upstream", f"""WITH {IV} SELECT id, id2, distance FROM (
  SELECT a.id, b.id AS id2, a."start" - b."end" AS distance, row_number() OVER (PARTITION BY a.id ORDER BY b."end" DESC, b.id) AS k
  FROM iv a JOIN iv b ON a.chrom = b.chrom AND b."end" < a."start" AND a."start" - b."end" <= 86400) WHERE k = 1""")
def nearest_upstream(spark, d):
    a, b = _pairs(spark, d)
    return iv.nearest_upstream(a, b, 86400)


RANGE = (1704500000, 1705500000)


@register("range_filter_overlap", f'WITH {IV} SELECT id, chrom, "start", "end" FROM iv WHERE "start" <= {RANGE[1]} AND "end" >= {RANGE[0]}')
def range_filter_overlap(spark, d):
    return iv.range_filter(intervals(spark, d), *RANGE).select("id", "chrom", "start", "end")


@register("range_filter_contained", f'WITH {IV} SELECT id, chrom, "start", "end" FROM iv WHERE "start" >= {RANGE[0]} AND "end" <= {RANGE[1]} AND strand = \'click\'')
def range_filter_contained(spark, d):
    return iv.range_filter(intervals(spark, d), *RANGE, contained=True, strand="click").select("id", "chrom", "start", "end")


@register("bundle_noise_filter", f"""WITH {IV}{BUNDLE.format(keys="chrom", gap=3600)}, b AS (SELECT chrom, island, min("start") AS "start", max("end") AS "end", count(*) AS n, CAST(sum("end" - "start" + 1) AS BIGINT) AS bases FROM n GROUP BY chrom, island)
SELECT *, CAST(bases AS DOUBLE) / ("end" - "start" + 1) AS cov FROM b WHERE "end" - "start" + 1 >= 200 AND CAST(bases AS DOUBLE) / ("end" - "start" + 1) >= 1.05""")
def bundle_noise_filter(spark, d):
    n = iv.number_islands(intervals(spark, d), 3600)
    b = n.groupBy("chrom", "island").agg(F.min("start").alias("start"), F.max("end").alias("end"), F.count(F.lit(1)).alias("n"), F.sum(F.col("end") - F.col("start") + 1).alias("bases"))
    cov = F.col("bases").cast("double") / (F.col("end") - F.col("start") + 1)
    return b.withColumn("cov", cov).where((F.col("end") - F.col("start") + 1 >= 200) & (F.col("cov") >= 1.05))


@register("locus_clusters", f'WITH {IV}{BUNDLE.format(keys="chrom, strand", gap=0)} SELECT id, min(id) OVER (PARTITION BY chrom, strand, island) AS locus FROM n')
def locus_clusters(spark, d):
    """Loci: components of the overlap graph on one strand, which are its islands."""
    n = iv.number_islands(intervals(spark, d), 0, ["chrom", "strand"])
    head = n.groupBy("chrom", "strand", "island").agg(F.min("id").alias("locus"))
    return n.join(head, ["chrom", "strand", "island"]).select("id", "locus")


@register("super_loci", f"""WITH {IV}, o AS (SELECT DISTINCT a.id AS a, b.id AS b FROM iv a JOIN iv b ON a.chrom = b.chrom AND a.strand = 'view' AND b.strand = 'click' AND a."start" <= b."end" AND b."start" <= a."end"),
e AS (SELECT a, b FROM o UNION ALL SELECT b, a FROM o),
w AS (SELECT DISTINCT a AS node, a AS low FROM e), 
r AS (WITH RECURSIVE t(node, low) AS (SELECT node, low FROM w UNION SELECT e.b, t.low FROM t JOIN e ON e.a = t.node) SELECT node, min(low) AS locus FROM t GROUP BY node)
SELECT node AS id, locus FROM r""")
def super_loci(spark, d):
    """Components of the overlaps between two sets."""
    a, b = _pairs(spark, d)
    edges = iv.overlap_join(a.where("strand = 'view'"), b.where("strand2 = 'click'")).select(F.col("id").alias("src"), F.col("id2").alias("dst"))
    return connected_components(materialize(edges, "edges")).select(F.col("node").alias("id"), F.col("component").alias("locus"))


@register("pair_distance_previous", f"""WITH {IV}, p AS (SELECT id, strand, "start", lag(id) OVER w AS id0, lag(strand) OVER w AS strand0, lag("end") OVER w AS end0 FROM iv WINDOW w AS (PARTITION BY chrom ORDER BY "start", id))
SELECT id, id0, "start" - end0 AS distance FROM p WHERE strand0 <> strand AND "start" - end0 BETWEEN 0 AND 7200""")
def pair_distance_previous(spark, d):
    """Adjacent rows of different orientation within a distance window."""
    w = Window.partitionBy("chrom", "_block").orderBy("place")
    rows = in_blocks(number_rows(intervals(spark, d).select("id", "chrom", "strand", "start", "end"), ["chrom"], ["start", "id"]), behind=1)
    p = rows.select("id", "strand", "start", "_copy", F.lag("id").over(w).alias("id0"), F.lag("strand").over(w).alias("strand0"), F.lag("end").over(w).alias("end0"))
    return p.where("not _copy and strand0 <> strand").select("id", "id0", (F.col("start") - F.col("end0")).alias("distance")).where("distance between 0 and 7200")


@register("sliding_quality_window", f"""WITH {IV}, q AS (SELECT id, chrom, "start", CAST(round(value) AS BIGINT) AS q FROM iv)
SELECT id, CAST(sum(q) OVER w AS BIGINT) AS total, count(*) OVER w AS n FROM q WINDOW w AS (PARTITION BY chrom ORDER BY "start", id ROWS BETWEEN CURRENT ROW AND 5 FOLLOWING)""")
def sliding_quality_window(spark, d):
    """Sum and number of the qualities in the window of six that each row opens."""
    w = Window.partitionBy("chrom", "_block").orderBy("place").rowsBetween(0, 5)
    q = intervals(spark, d).select("id", "chrom", "start", F.round("value").cast("long").alias("q"))
    rows = in_blocks(number_rows(q, ["chrom"], ["start", "id"]), ahead=5)
    return rows.select("id", "_copy", F.sum("q").over(w).alias("total"), F.count(F.lit(1)).over(w).alias("n")).where("not _copy").drop("_copy")
