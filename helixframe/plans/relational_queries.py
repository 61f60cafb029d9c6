"""Keyed record operators over the star tables."""

import re

from pyspark.sql import functions as F

from helixframe.operators import relational as rel
from helixframe.operators.order import first_of_runs, number_rows
from helixframe.plans.catalogue import register
from helixframe.plans.views import HITS, hits, table


def _sides(spark, d):
    left = table(spark, d, "customer").select(F.col("c_custkey").alias("k"), F.col("c_name").alias("name"))
    right = table(spark, d, "orders").select(F.col("o_custkey").alias("k"), F.col("o_orderkey").alias("o"), F.col("o_totalprice").alias("price"))
    return left, right


LAST = """l AS (SELECT c_custkey AS k, c_name AS name FROM customer), r AS (SELECT o_custkey AS k, max(o_orderkey) AS o, arg_max(o_totalprice, o_orderkey) AS price FROM orders GROUP BY o_custkey)"""

for _how in ("inner", "left", "right", "full"):

    @register(f"keyed_join_{_how}", f"WITH {LAST} SELECT coalesce(l.k, r.k) AS k, name, o, price FROM l {_how} JOIN r ON l.k = r.k")
    def keyed_join(spark, d, how=_how):
        left, right = _sides(spark, d)
        return rel.keyed_join(left, right, ["k"], how, ["o"]).select("k", "name", "o", "price")


@register("keyed_join_filled", "SELECT s_suppkey AS k, coalesce(n_name, '-') AS nation FROM supplier LEFT JOIN (SELECT * FROM nation WHERE n_regionkey > 1) ON s_nationkey = n_nationkey")
def keyed_join_filled(spark, d):
    s = table(spark, d, "supplier").select(F.col("s_suppkey").alias("k"), F.col("s_nationkey").alias("n"))
    n = table(spark, d, "nation").where("n_regionkey > 1").select(F.col("n_nationkey").alias("n"), F.col("n_name").alias("nation"))
    return rel.keyed_join(s, n, ["n"], "left", filler={"nation": "-"}).select("k", "nation")


@register("semi_join", "SELECT c_custkey AS k FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_totalprice > 300000)")
def semi_join(spark, d):
    left, right = _sides(spark, d)
    return rel.semi(left, right.where("price > 300000"), "k").select("k")


@register("semi_join_versions", "SELECT event_id FROM events WHERE regexp_replace(event_type || '.' || (event_id % 7), '\\.[0-9]+$', '') IN ('click', 'purchase')")
def semi_join_versions(spark, d):
    e = table(spark, d, "events").select("event_id", F.concat_ws(".", "event_type", (F.col("event_id") % 7).cast("string")).alias("name"))
    names = table(spark, d, "events").where("event_type in ('click', 'purchase')").select(F.concat("event_type", F.lit(".99")).alias("name"))
    return rel.semi(e, names, "name", ignore_version=True).select("event_id")


@register("anti_join", "SELECT c_custkey AS k FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_custkey IS NOT NULL AND o_totalprice > 400000)")
def anti_join(spark, d):
    """Customers without a large order."""
    left, right = _sides(spark, d)
    return rel.anti(left, right.where("price > 400000"), "k").select("k")


@register("lookup_first", "SELECT c_custkey AS k, min(o_orderkey) AS o FROM customer JOIN orders ON o_custkey = c_custkey WHERE c_acctbal < 0 GROUP BY c_custkey")
def lookup_first(spark, d):
    asked = table(spark, d, "customer").where("c_acctbal < 0").select(F.col("c_custkey").alias("k"))
    _, right = _sides(spark, d)
    return asked.join(rel.first_wins(right, ["k"], ["o"]), "k").select("k", "o")


@register("lookup_all", "SELECT c_custkey AS k, o_orderkey AS o FROM customer JOIN orders ON o_custkey = c_custkey WHERE c_acctbal < 0")
def lookup_all(spark, d):
    asked = table(spark, d, "customer").where("c_acctbal < 0").select(F.col("c_custkey").alias("k"))
    return asked.join(_sides(spark, d)[1], "k").select("k", "o")


@register("lookup_range", "SELECT doc_id, substr(text, 11, 40) AS part FROM documents WHERE doc_id IN (SELECT doc_id FROM labels WHERE quality = 0)")
def lookup_range(spark, d):
    """Keyed records, cut to a range of positions."""
    names = table(spark, d, "labels").where("quality = 0").select("doc_id")
    return table(spark, d, "documents").join(names, "doc_id", "left_semi").select("doc_id", F.substring("text", 11, 40).alias("part"))


@register("translate_column", "SELECT c_custkey AS k, coalesce(n_name, CAST(c_nationkey AS VARCHAR)) AS nation FROM customer LEFT JOIN (SELECT * FROM nation WHERE n_nationkey % 2 = 0) ON c_nationkey = n_nationkey")
def translate_column(spark, d):
    c = table(spark, d, "customer").select(F.col("c_custkey").alias("k"), F.col("c_nationkey").cast("string").alias("nation"))
    n = table(spark, d, "nation").where("n_nationkey % 2 = 0").select(F.col("n_nationkey").cast("string").alias("i"), "n_name")
    return rel.translate_column(c, "nation", n, "i", "n_name").select("k", "nation")


@register("col_sum_avg", """WITH v AS (SELECT CASE WHEN doc_id % 3 = 0 THEN CAST(n_chars AS VARCHAR) ELSE lang END AS t FROM documents), x AS (SELECT t, TRY_CAST(t AS DOUBLE) AS v FROM v)
SELECT sum(v) AS total, avg(v) AS mean, count(v) AS n, min(v) AS low, max(v) AS high, CAST(sum(CASE WHEN v IS NULL AND t IS NOT NULL THEN 1 ELSE 0 END) AS BIGINT) AS skipped FROM x""")
def col_sum_avg(spark, d):
    v = table(spark, d, "documents").select(F.when(F.col("doc_id") % 3 == 0, F.col("n_chars").cast("string")).otherwise(F.col("lang")).alias("t"))
    return rel.column_stats(v, "t")


@register("count_by_key", "SELECT l_partkey AS k, count(*) AS n, count(*) / CAST(sum(count(*)) OVER () AS DOUBLE) AS share FROM lineitem GROUP BY l_partkey QUALIFY count(*) BETWEEN 20 AND 40")
def count_by_key(spark, d):
    return rel.count_by_key(table(spark, d, "lineitem").select(F.col("l_partkey").alias("k")), ["k"], 20, 40)


@register("sum_by_key_having", "SELECT l_suppkey AS k, sum(l_quantity) AS total FROM lineitem GROUP BY l_suppkey HAVING sum(l_quantity) >= 15000")
def sum_by_key_having(spark, d):
    return rel.sum_by_key(table(spark, d, "lineitem").select(F.col("l_suppkey").alias("k"), "l_quantity"), ["k"], "l_quantity", 15000)


@register("argmax_by_key", f"WITH {HITS} SELECT q, max({{'v': score, 'a': h, 'b': s, 'c': line}}).a AS h, max(score) AS score FROM hits GROUP BY q")
def argmax_by_key(spark, d):
    h = hits(spark, d).select("q", "h", "s", "line", "score")
    return rel.argmax(h, ["q"], F.col("score"), [F.col("h"), F.col("s"), F.col("line")]).select("q", "h", "score")


@register("argmax_abs_by_key", "SELECT c_nationkey AS k, max({'v': abs(c_acctbal), 'a': c_custkey}).a AS c FROM customer GROUP BY c_nationkey")
def argmax_abs_by_key(spark, d):
    c = table(spark, d, "customer").select(F.col("c_nationkey").alias("k"), F.col("c_custkey").alias("c"), "c_acctbal")
    return rel.argmax(c, ["k"], F.abs("c_acctbal"), [F.col("c")]).select("k", "c")


@register("summary_weighted", """WITH g AS (SELECT p_size AS v, CAST(sum(p_partkey % 5 + 1) AS BIGINT) AS w FROM part GROUP BY p_size),
c AS (SELECT v, w, sum(w) OVER (ORDER BY v) - w AS before, sum(v * w) OVER (ORDER BY v) AS mass, sum(w) OVER () AS n, sum(v * w) OVER () AS total FROM g),
s AS (SELECT CAST(max(n) AS BIGINT) AS n, min(v) AS low, max(CASE WHEN before <= 0.25 * n THEN v END) AS q1, max(CASE WHEN before <= 0.5 * n THEN v END) AS q2, max(CASE WHEN before <= 0.75 * n THEN v END) AS q3, max(v) AS high, CAST(max(total) AS BIGINT) AS total, max(CASE WHEN total - mass + v * w >= total / 2 THEN v END) AS n50 FROM c)
SELECT *, CAST(total AS DOUBLE) / n AS mean, CAST(q1 - 1.5 * (q3 - q1) AS DOUBLE) AS fence_low, CAST(q3 + 1.5 * (q3 - q1) AS DOUBLE) AS fence_high FROM s""")
def summary_weighted(spark, d):
    s = rel.weighted_summary(table(spark, d, "part"), F.col("p_size"), F.col("p_partkey") % 5 + 1)
    return s.withColumn("fence_low", F.col("fence_low").cast("double")).withColumn("fence_high", F.col("fence_high").cast("double"))


@register("n50_l50", """WITH o AS (SELECT n_chars AS v, row_number() OVER (ORDER BY n_chars DESC, doc_id) AS k, sum(n_chars) OVER (ORDER BY n_chars DESC, doc_id) AS c, sum(n_chars) OVER () AS t, count(*) OVER () AS n FROM documents WHERE n_chars > 0)
SELECT n, CAST(t AS BIGINT) AS total, v AS n50, k AS l50 FROM o WHERE c >= t / 2 AND c - v < t / 2""")
def n50_l50(spark, d):
    return rel.n50(table(spark, d, "documents").where("n_chars > 0"), F.col("n_chars"))


@register("seq_lengths", "SELECT lang, count(*) AS n, min(length(text)) AS low, max(length(text)) AS high, CAST(sum(length(text)) AS BIGINT) AS total, CAST(sum(length(text)) AS DOUBLE) / count(*) AS mean FROM documents GROUP BY lang")
def seq_lengths(spark, d):
    n = F.length("text").cast("long")
    return table(spark, d, "documents").groupBy("lang").agg(F.count(F.lit(1)).alias("n"), F.min(n).alias("low"), F.max(n).alias("high"), F.sum(n).alias("total"), (F.sum(n).cast("double") / F.count(F.lit(1))).alias("mean"))


@register("line_lengths", "WITH l AS (SELECT length(unnest(string_split(text, chr(10)))) AS n FROM documents) SELECT count(*) AS lines, min(n) AS low, max(n) AS high, CAST(sum(n) AS BIGINT) AS total FROM l")
def line_lengths(spark, d):
    n = table(spark, d, "documents").select(F.explode(F.split("text", "\n")).alias("line")).select(F.length("line").cast("long").alias("n"))
    return n.agg(F.count(F.lit(1)).alias("lines"), F.min("n").alias("low"), F.max("n").alias("high"), F.sum("n").alias("total"))


@register("distinct_counts", "SELECT event_type, count(*) AS n, count(DISTINCT user_id) AS users, count(DISTINCT CAST(ts AS DATE)) AS days FROM events GROUP BY event_type")
def distinct_counts(spark, d):
    return table(spark, d, "events").groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("user_id").alias("users"), F.count_distinct(F.to_date("ts")).alias("days"))


@register("feature_counts", "SELECT source, count(*) AS n, CAST(sum(CASE WHEN lang = 'en' THEN n_chars ELSE 0 END) AS BIGINT) AS covered FROM documents GROUP BY source")
def feature_counts(spark, d):
    return table(spark, d, "documents").groupBy("source").agg(F.count(F.lit(1)).alias("n"), F.sum(F.when(F.col("lang") == "en", F.col("n_chars")).otherwise(0)).alias("covered"))


@register("contig_rollup", "SELECT event_type, user_id % 10 AS part, count(*) AS n, sum(CAST(floor(value) AS BIGINT))::BIGINT AS bases FROM events GROUP BY ROLLUP (event_type, user_id % 10)")
def contig_rollup(spark, d):
    """Statistics per part, per set and in total from one pass."""
    e = table(spark, d, "events").withColumn("part", F.col("user_id") % 10)
    return e.rollup("event_type", "part").agg(F.count(F.lit(1)).alias("n"), F.sum(F.floor("value")).alias("bases"))


#: Counters of alignments and when each counts.
FLAGS = {
    "duplicates": "flag & 1024 > 0", "mapped": "flag & 4 = 0", "paired": "flag & 1 > 0", "read1": "flag & 65 = 65", "read2": "flag & 129 = 129", "proper": "flag & 3 = 3", "both_mapped": "flag & 13 = 1", "singletons": "flag & 13 = 9",
    "elsewhere": "flag & 13 = 1 AND hit <> mate_hit", "elsewhere_sure": "flag & 13 = 1 AND hit <> mate_hit AND mapq >= 5",
}


@register("flagstat_like", "WITH f AS (SELECT (l_orderkey * 37 + l_linenumber * 101 + l_partkey) % 4096 AS flag, l_suppkey % 5 AS hit, l_partkey % 5 AS mate_hit, CAST(l_quantity AS INTEGER) % 10 AS mapq FROM lineitem) SELECT (flag & 512) > 0 AS failed, count(*) AS total, " + ", ".join(f"count(*) FILTER ({re.sub(r'flag & ([0-9]+)', r'(flag & \1)', c)}) AS {n}" for n, c in FLAGS.items()) + " FROM f GROUP BY 1")
def flagstat_like(spark, d):
    """Alignments by flag, pairs by where both mates lie."""
    from helixframe.operators.reads import flagstat

    flag = (F.col("l_orderkey") * 37 + F.col("l_linenumber") * 101 + F.col("l_partkey")) % 4096
    return flagstat(table(spark, d, "lineitem").select(flag.alias("flag"), (F.col("l_suppkey") % 5).alias("hit"), (F.col("l_partkey") % 5).alias("mate_hit"), (F.col("l_quantity").cast("int") % 10).alias("mapq")))


@register("flag_filter", "WITH f AS (SELECT l_orderkey AS q, (l_orderkey * 37 + l_linenumber * 101 + l_partkey) % 4096 AS flag, CAST(l_quantity AS INTEGER) AS mapq FROM lineitem) SELECT q, flag, mapq FROM f WHERE mapq >= 20 AND (flag & 3) = 3 AND (flag & 1796) = 0")
def flag_filter(spark, d):
    from helixframe.operators.reads import sam_filter

    f = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("q"), ((F.col("l_orderkey") * 37 + F.col("l_linenumber") * 101 + F.col("l_partkey")) % 4096).alias("flag"), F.col("l_quantity").cast("int").alias("mapq"))
    return sam_filter(f, 20, 3, 1796)


@register("name_class_filter", "SELECT p_partkey, p_name FROM part WHERE regexp_matches(p_type, '^(STANDARD|SMALL)') AND NOT regexp_matches(p_name, '^(lace|a)')")
def name_class_filter(spark, d):
    return table(spark, d, "part").where(F.col("p_type").rlike("^(STANDARD|SMALL)") & ~F.col("p_name").rlike("^(lace|a)")).select("p_partkey", "p_name")


@register("name_lists_filter", f"WITH {HITS} SELECT q, h, line FROM hits WHERE q IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F') AND h NOT IN (SELECT p_partkey FROM part WHERE p_size > 25)")
def name_lists_filter(spark, d):
    """Hits whose query is listed and whose subject is not excluded."""
    listed = table(spark, d, "orders").where("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("q"))
    out = table(spark, d, "part").where("p_size > 25").select(F.col("p_partkey").alias("h"))
    return rel.anti(rel.semi(hits(spark, d), listed, "q"), out, "h").select("q", "h", "line")


@register("multiplicity", "WITH m AS (SELECT l_partkey AS read, count(*) AS hits FROM lineitem GROUP BY l_partkey) SELECT hits, count(*) AS reads FROM m GROUP BY hits")
def multiplicity(spark, d):
    m = table(spark, d, "lineitem").groupBy("l_partkey").agg(F.count(F.lit(1)).alias("hits"))
    return m.groupBy("hits").agg(F.count(F.lit(1)).alias("reads"))


@register("mapped_and_unique", "WITH m AS (SELECT l_partkey AS read, count(*) AS hits FROM lineitem GROUP BY l_partkey) SELECT count(*) AS mapped, CAST(sum(CASE WHEN hits = 1 THEN 1 ELSE 0 END) AS BIGINT) AS single, CAST(2 * count(*) - sum(hits) AS BIGINT) AS less_extra FROM m")
def mapped_and_unique(spark, d):
    """Reads, reads with one hit, and reads less the hits beyond the first."""
    m = table(spark, d, "lineitem").groupBy("l_partkey").agg(F.count(F.lit(1)).alias("hits"))
    return m.agg(F.count(F.lit(1)).alias("mapped"), F.sum(F.when(F.col("hits") == 1, 1).otherwise(0)).alias("single"), (2 * F.count(F.lit(1)) - F.sum("hits")).alias("less_extra"))


ORDER = "score DESC, h, s, line"


@register("top_n_per_key", f"WITH {HITS} SELECT q, h, s, line, score, CAST(place AS INTEGER) AS place FROM (SELECT *, row_number() OVER (PARTITION BY q ORDER BY {ORDER}, overlap, pid, strand) AS place FROM hits) WHERE place <= 2")
def top_n_per_key(spark, d):
    order = [F.desc("score"), F.col("h"), F.col("s"), F.col("line"), F.col("overlap"), F.col("pid"), F.col("strand")]
    return rel.top_n(hits(spark, d), ["q"], order, 2).select("q", "h", "s", "line", "score", "place")


@register("top_n_consecutive", """WITH e AS (SELECT event_id, user_id // 50 AS k, event_type, row_number() OVER (PARTITION BY user_id // 50 ORDER BY event_id) AS i FROM events),
r AS (SELECT *, i - row_number() OVER (PARTITION BY k, event_type ORDER BY i) AS run FROM e), n AS (SELECT *, row_number() OVER (PARTITION BY k, event_type, run ORDER BY i) AS place FROM r)
SELECT event_id FROM n WHERE place <= 2""")
def top_n_consecutive(spark, d):
    """The first two rows of each unbroken run of a key, in a declared order."""
    e = table(spark, d, "events").select("event_id", F.floor(F.col("user_id") / 50).alias("k"), "event_type")
    return first_of_runs(e, ["k"], ["event_id"], "event_type", 2).select("event_id")


@register("best_stratum", f"WITH {HITS} SELECT q, h, s, line, overlap FROM hits QUALIFY overlap = min(overlap) OVER (PARTITION BY q)")
def best_stratum(spark, d):
    return rel.best_stratum(hits(spark, d), ["q"], "overlap").select("q", "h", "s", "line", "overlap")


@register("kway_merge_order", f"WITH {HITS}, p AS (SELECT * FROM hits WHERE strand = '+' UNION ALL SELECT * FROM hits WHERE strand = '-') SELECT q, h, s, line, row_number() OVER (ORDER BY overlap, score DESC, pid DESC, q, h, s, line) AS place FROM p")
def kway_merge_order(spark, d):
    """Sorted hit files merged: E-value up, score down, identity down; with the place of each hit in the whole."""
    h = hits(spark, d)
    p = h.where("strand = '+'").unionByName(h.where("strand = '-'"))
    order = [F.col("overlap"), F.desc("score"), F.desc("pid"), *map(F.col, ("q", "h", "s", "line"))]
    return number_rows(p, [], order).select("q", "h", "s", "line", "place")


@register("two_key_sort_dedupe", "SELECT l_orderkey AS i, l_linenumber AS j, max({'p': l_extendedprice, 'k': l_partkey}).k AS k FROM lineitem GROUP BY ALL")
def two_key_sort_dedupe(spark, d):
    li = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("i"), F.col("l_linenumber").alias("j"), F.col("l_extendedprice").alias("p"), F.col("l_partkey").alias("k"))
    return rel.sort_dedupe(li, ["i", "j"], ["p", "k"]).select("i", "j", "k")


@register("rmdup_best", """WITH r AS (SELECT event_id, user_id AS chrom, CAST(floor(epoch(ts) / 3600) AS BIGINT) AS pos, event_type AS strand, CAST(floor(value * 100) AS BIGINT) AS q FROM events)
SELECT chrom, pos, strand, max({'q': q, 'i': -event_id}).i * -1 AS id, count(*) AS n FROM r GROUP BY chrom, pos, strand""")
def rmdup_best(spark, d):
    """One alignment per position, strand and library: the one with the largest sum of qualities."""
    from helixframe.operators.reads import remove_duplicates

    pos = F.floor(F.expr("timestampdiff(SECOND, TIMESTAMP_NTZ '1970-01-01 00:00:00', ts)") / 3600)
    r = table(spark, d, "events").select(F.col("event_id").alias("id"), F.col("user_id").alias("chrom"), pos.alias("pos"), F.col("event_type").alias("strand"), F.floor(F.col("value") * 100).alias("quality"))
    return remove_duplicates(r, ["chrom", "pos", "strand"])


@register("collapse_duplicates", "SELECT min(doc_id) AS id, count(*) AS n, min(doc_id) || '_x' || count(*) AS name FROM documents GROUP BY text")
def collapse_duplicates(spark, d):
    g = table(spark, d, "documents").groupBy("text").agg(F.min("doc_id").alias("id"), F.count(F.lit(1)).alias("n"))
    return g.select("id", "n", F.concat("id", F.lit("_x"), "n").alias("name"))


@register("union_all", "SELECT n_nationkey AS k, n_name AS name FROM nation UNION ALL SELECT r_regionkey, r_name FROM region UNION ALL SELECT n_nationkey, n_name FROM nation")
def union_all(spark, d):
    n = table(spark, d, "nation").select(F.col("n_nationkey").alias("k"), F.col("n_name").alias("name"))
    return n.unionByName(table(spark, d, "region").select(F.col("r_regionkey").alias("k"), F.col("r_name").alias("name"))).unionByName(n)


@register("distinct_rows", "SELECT DISTINCT c_nationkey AS k, c_mktsegment AS segment FROM customer")
def distinct_rows(spark, d):
    return table(spark, d, "customer").select(F.col("c_nationkey").alias("k"), F.col("c_mktsegment").alias("segment")).distinct()


@register("full_count_merge", "WITH a AS (SELECT l_partkey AS k, count(*) AS n FROM lineitem WHERE l_returnflag = 'R' GROUP BY 1), b AS (SELECT l_partkey AS k, count(*) AS n FROM lineitem WHERE l_returnflag = 'A' GROUP BY 1) SELECT coalesce(a.k, b.k) AS k, coalesce(a.n, 0) AS n1, coalesce(b.n, 0) AS n2 FROM a FULL JOIN b ON a.k = b.k")
def full_count_merge(spark, d):
    """Counts of two samples side by side, zero where one has none: one conditional aggregate instead of two and a join."""
    flag = F.col("l_returnflag")
    both = table(spark, d, "lineitem").where(flag.isin("R", "A")).groupBy(F.col("l_partkey").alias("k"))
    return both.agg(F.sum(F.when(flag == "R", 1).otherwise(0)).alias("n1"), F.sum(F.when(flag == "A", 1).otherwise(0)).alias("n2"))


@register("compare_records", "SELECT a.doc_id AS id, b.doc_id AS id2 FROM documents a JOIN documents b ON b.doc_id = a.doc_id + 1 WHERE a.text <> b.text AND a.lang = b.lang")
def compare_records(spark, d):
    """Records of one key that differ between two sets (here a set and the one shifted by a key)."""
    a = table(spark, d, "documents").select(F.col("doc_id").alias("id"), "text", "lang")
    b = a.select((F.col("id") - 1).alias("id"), F.col("id").alias("id2"), F.col("text").alias("text2"), F.col("lang").alias("lang2"))
    return a.join(b, "id").where("text <> text2 and lang = lang2").select("id", "id2")


@register("attach_best_annotation", f"WITH {HITS}, b AS (SELECT h, max({{'v': score, 'q': q}}).q AS best FROM hits GROUP BY h) SELECT p_partkey AS id, p_name AS name, best FROM part LEFT JOIN b ON h = p_partkey")
def attach_best_annotation(spark, d):
    b = hits(spark, d).groupBy("h").agg(F.max(F.struct("score", "q")).alias("b")).select(F.col("h").alias("id"), F.col("b.q").alias("best"))
    return table(spark, d, "part").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("name")).join(b, "id", "left")


@register("idxstats", "SELECT user_id AS ref, CAST(sum(CASE WHEN event_type <> 'view' THEN 1 ELSE 0 END) AS BIGINT) AS mapped, CAST(sum(CASE WHEN event_type = 'view' THEN 1 ELSE 0 END) AS BIGINT) AS unmapped FROM events GROUP BY user_id")
def idxstats(spark, d):
    view = F.col("event_type") == "view"
    return table(spark, d, "events").groupBy(F.col("user_id").alias("ref")).agg(F.sum(F.when(~view, 1).otherwise(0)).alias("mapped"), F.sum(F.when(view, 1).otherwise(0)).alias("unmapped"))


@register("fpkm", "WITH g AS (SELECT l_partkey AS tx, CAST(count(*) AS DOUBLE) AS cov, CAST(sum(CAST(l_quantity AS BIGINT)) AS BIGINT) AS frag FROM lineitem GROUP BY 1) SELECT tx, cov * 1e9 / CAST((SELECT sum(frag) FROM g) AS DOUBLE) AS fpkm FROM g")
def fpkm(spark, d):
    g = table(spark, d, "lineitem").groupBy(F.col("l_partkey").alias("tx")).agg(F.count(F.lit(1)).cast("double").alias("cov"), F.sum(F.col("l_quantity").cast("long")).alias("frag"))
    total = g.agg(F.sum("frag").cast("double").alias("total"))
    return g.crossJoin(F.broadcast(total)).select("tx", (F.col("cov") * 1e9 / F.col("total")).alias("fpkm"))


@register("locus_names", "WITH n AS (SELECT c_nationkey AS locus, upper(c_mktsegment) AS name, count(*) AS n FROM customer GROUP BY ALL) SELECT locus, string_agg(name || ':' || n, ',' ORDER BY n DESC, name) AS names FROM n GROUP BY locus")
def locus_names(spark, d):
    """Names of a locus with how often each occurs, most frequent first."""
    n = table(spark, d, "customer").groupBy(F.col("c_nationkey").alias("locus"), F.upper("c_mktsegment").alias("name")).agg(F.count(F.lit(1)).alias("n"))
    names = F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("m"), "name")))
    return n.groupBy("locus").agg(F.array_join(F.transform(names, lambda x: F.concat(x["name"], F.lit(":"), (-x["m"]).cast("string"))), ",").alias("names"))


@register("tree_walk", """WITH RECURSIVE t(id, parent) AS (SELECT 'r' || r_regionkey, 'root' FROM region UNION ALL SELECT 'n' || n_nationkey, 'r' || n_regionkey FROM nation UNION ALL SELECT 's' || s_suppkey, 'n' || s_nationkey FROM supplier),
w(id, depth, path) AS (SELECT id, 1, id FROM t WHERE parent = 'root' UNION ALL SELECT t.id, w.depth + 1, w.path || '/' || t.id FROM t JOIN w ON t.parent = w.id)
SELECT id, depth, path FROM w""")
def tree_walk(spark, d):
    """Every node below the root with its depth and path: one join per level."""
    r = table(spark, d, "region").select(F.concat(F.lit("r"), "r_regionkey").alias("id"), F.lit("root").alias("parent"))
    n = table(spark, d, "nation").select(F.concat(F.lit("n"), "n_nationkey").alias("id"), F.concat(F.lit("r"), "n_regionkey").alias("parent"))
    s = table(spark, d, "supplier").select(F.concat(F.lit("s"), "s_suppkey").alias("id"), F.concat(F.lit("n"), "s_nationkey").alias("parent"))
    name = "tree_walk_edges"
    r.unionByName(n).unionByName(s).createOrReplaceTempView(name)
    return spark.sql(f"""WITH RECURSIVE w(id, depth, path) AS (SELECT id, 1, id FROM {name} WHERE parent = 'root'
        UNION ALL SELECT t.id, w.depth + 1, concat(w.path, '/', t.id) FROM {name} t JOIN w ON t.parent = w.id) SELECT id, depth, path FROM w""")


@register("running_names", "SELECT doc_id, 'rd_' || printf('%08d', row_number() OVER (PARTITION BY source ORDER BY doc_id)) AS name FROM documents")
def running_names(spark, d):
    rows = number_rows(table(spark, d, "documents").select("doc_id", "source"), ["source"], ["doc_id"])
    return rows.select("doc_id", F.format_string("rd_%08d", "place").alias("name"))
