"""Sequence functions over document texts."""

from pyspark.sql import functions as F

from helixframe.functions import seq
from helixframe.operators.intervals import number_islands
from helixframe.plans.catalogue import register
from helixframe.plans.views import table
from helixframe.storage import materialize


def _dna(spark, d):
    """A DNA-like record per document: its letters a c g t n in upper case."""
    t = F.regexp_replace(F.translate(F.col("text"), "acgtnoiesr", "ACGTNACGTA"), "[^ACGTN]", "")
    return table(spark, d, "documents").select("doc_id", t.alias("s"))


DNA = "dna AS (SELECT doc_id, regexp_replace(translate(text, 'acgtnoiesr', 'ACGTNACGTA'), '[^ACGTN]', '', 'g') AS s FROM documents)"


@register("revcomp", f"WITH {DNA} SELECT doc_id, reverse(translate(s || 'AC-G*TXxRn', 'ACGTR', 'TGCAY')) AS rc FROM dna")
def revcomp(spark, d):
    """Records with a tail of gaps, masked and ambiguous bases, turned."""
    return _dna(spark, d).select("doc_id", seq.reverse_complement(F.concat("s", F.lit("AC-G*TXxRn"))).alias("rc"))


@register("kmers_top", f"WITH {DNA}, k AS (SELECT substr(s, i, 8) AS kmer FROM (SELECT s, unnest(range(1, length(s) - 6)) AS i FROM dna)), c AS (SELECT kmer, count(*) AS n FROM k WHERE kmer NOT LIKE '%N%' GROUP BY kmer) SELECT kmer, n FROM c ORDER BY n DESC, kmer LIMIT 50")
def kmers_top(spark, d):
    """The 50 commonest 8-mers without N (a top-k report)."""
    return seq.kmer_counts(_dna(spark, d), "s", 8).orderBy(F.desc("n"), "kmer").limit(50)


@register("mono_runs", "SELECT doc_id, len(regexp_extract_all(text, '(e{2,}|n{2,}|o{2,})')) AS runs FROM documents WHERE regexp_matches(text, '(e{2,}|n{2,}|o{2,})')")
def mono_runs(spark, d):
    """How many runs of a repeated base each record has."""
    n = F.size(F.regexp_extract_all("text", F.lit("(e{2,}|n{2,}|o{2,})"), 1)).cast("long")
    return table(spark, d, "documents").select("doc_id", n.alias("runs")).where("runs > 0")


@register("base_run_positions", f"""WITH {DNA}, p AS (SELECT doc_id, unnest(range(1, length(s) + 1)) AS i, s FROM dna), b AS (SELECT doc_id, i, i - row_number() OVER (PARTITION BY doc_id ORDER BY i) AS g FROM p WHERE substr(s, i, 1) = 'T')
SELECT doc_id, min(i) AS "start", count(*) AS length FROM b GROUP BY doc_id, g HAVING count(*) >= 4""")
def base_run_positions(spark, d):
    found = _dna(spark, d).select("doc_id", F.explode(seq.runs(F.col("s"), "T", 4)).alias("r"))
    return found.select("doc_id", F.col("r.start").cast("long").alias("start"), F.col("r.length").cast("long").alias("length"))


@register("split_by_ns", f"WITH {DNA}, p AS (SELECT doc_id, unnest(string_split_regex(s, 'N+')) AS part FROM dna) SELECT doc_id, count(*) AS parts, CAST(max(length(part)) AS BIGINT) AS longest FROM p WHERE length(part) >= 1 GROUP BY doc_id")
def split_by_ns(spark, d):
    p = _dna(spark, d).select("doc_id", F.explode(F.split("s", "N+")).alias("part")).where("length(part) >= 1")
    return p.groupBy("doc_id").agg(F.count(F.lit(1)).alias("parts"), F.max(F.length("part")).cast("long").alias("longest"))


@register("token_keys", "WITH t AS (SELECT doc_id, unnest(list_distinct(list_filter(string_split_regex(lower(text), '[^a-z]+'), lambda x: length(x) > 3 AND x NOT IN ('that', 'with', 'from')))) AS key FROM documents) SELECT key, count(*) AS n, min(doc_id) AS first FROM t GROUP BY key HAVING count(*) > 1")
def token_keys(spark, d):
    """Records indexed by every token but stop words: keys with more than one record."""
    words = F.array_distinct(F.filter(F.split(F.lower("text"), "[^a-z]+"), lambda x: (F.length(x) > 3) & ~x.isin("that", "with", "from")))
    t = table(spark, d, "documents").select("doc_id", F.explode(words).alias("key"))
    return t.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.min("doc_id").alias("first")).where("n > 1")


@register("compound_keys", "WITH k AS (SELECT page_id, unnest(string_split(regexp_extract(url, '://([^/]*)', 1), '.')) AS key FROM pages) SELECT key, count(*) AS n FROM k GROUP BY key")
def compound_keys(spark, d):
    """Keys of several parts, each part a key of its own."""
    host = F.regexp_extract("url", "://([^/]*)", 1)
    return table(spark, d, "pages").select(F.explode(F.split(host, r"\.")).alias("key")).groupBy("key").agg(F.count(F.lit(1)).alias("n"))


@register("edit_distance", "SELECT a.p_partkey AS id, levenshtein(a.p_name, b.p_name) AS distance FROM part a JOIN part b ON b.p_partkey = a.p_partkey + 1")
def edit_distance(spark, d):
    a = table(spark, d, "part").select(F.col("p_partkey").alias("id"), "p_name")
    b = a.select((F.col("id") - 1).alias("id"), F.col("p_name").alias("other"))
    return a.join(b, "id").select("id", F.levenshtein("p_name", "other").cast("long").alias("distance"))


def _codon_values():
    return ", ".join(f"('{c}', '{a}')" for c, a in seq.codon_table().items() if set(c) <= set("ACGTN"))


@register("translate_protein", f"""WITH {DNA}, code(codon, acid) AS (VALUES {_codon_values()}), c AS (SELECT doc_id, i, substr(s, i, 3) AS codon FROM (SELECT doc_id, s, unnest(range(1, length(s) - 1, 3)) AS i FROM dna WHERE length(s) >= 3))
SELECT doc_id, string_agg(coalesce(acid, 'X'), '' ORDER BY i) AS protein FROM c LEFT JOIN code USING (codon) GROUP BY doc_id""")
def translate_protein(spark, d):
    """Protein of each record; codons that N leaves open are X."""
    s = _dna(spark, d).where("length(s) >= 3")
    return s.select("doc_id", seq.translate(F.col("s")).alias("protein"))


def _frame_sql(strand: str, frame: int) -> str:
    return f"SELECT doc_id, list_max(list_transform(string_split(array_to_string(list_transform(range({1 + frame}, length({strand}) - 1, 3), lambda i: coalesce(code[substr({strand}, i, 3)], 'X')), ''), '.'), lambda p: CASE WHEN instr(p, 'M') > 0 THEN length(p) - instr(p, 'M') + 1 ELSE 0 END)) AS n FROM both_strands, codes"


def _codon_map() -> str:
    return "MAP {" + ", ".join(f"'{c}': '{a}'" for c, a in seq.codon_table().items() if set(c) <= set("ACGTN")) + "}"


@register("longest_orf", f"""WITH {DNA}, codes AS (SELECT {_codon_map()} AS code), both_strands AS (SELECT doc_id, s, reverse(translate(s, 'ACGTN', 'TGCAN')) AS r FROM dna WHERE length(s) >= 3),
f AS ({" UNION ALL ".join(_frame_sql(x, k) for x in "sr" for k in range(3))}) SELECT doc_id, CAST(max(coalesce(n, 0)) AS INTEGER) AS longest FROM f GROUP BY doc_id""")
def longest_orf(spark, d):
    """The longest open reading frame of six."""
    s = _dna(spark, d).where("length(s) >= 3")
    frames = F.transform(seq.six_frames(F.col("s")), lambda p: F.length(seq.longest_orf(p)))
    return s.select("doc_id", F.array_max(frames).alias("longest"))


@register("composition", f"WITH {DNA} SELECT doc_id, length(s) AS n, length(s) - length(replace(replace(s, 'G', ''), 'C', '')) AS gc, length(s) - length(replace(s, 'N', '')) AS ns FROM dna WHERE (length(s) - length(replace(s, 'N', ''))) * 100 <= 60 * length(s) AND length(s) >= 20")
def composition(spark, d):
    """Length, GC and N counts of records that are long enough and not too full of N."""
    n, count = F.length("s").cast("long"), lambda c: (F.length("s") - F.length(F.regexp_replace("s", c, ""))).cast("long")
    return _dna(spark, d).select("doc_id", n.alias("n"), count("[GC]").alias("gc"), count("N").alias("ns")).where("ns * 100 <= 60 * n and n >= 20")


@register("record_table", "SELECT doc_id, '>' || doc_id || ' ' || lang || chr(10) || text AS fasta FROM documents")
def record_table(spark, d):
    """Records in sequence-file form."""
    from helixframe.sources.fasta import to_fasta

    return table(spark, d, "documents").select("doc_id", to_fasta(F.col("doc_id").cast("string"), F.col("lang"), F.col("text")).alias("fasta"))


@register("percent_decode", """WITH t AS (SELECT page_id, unnest(regexp_extract_all(url || '%20a+b%3Bc%41%zz%e9100%', '(%[0-9A-Fa-f]{2}|[^%]+|%)')) AS x, unnest(range(1, 1 + len(regexp_extract_all(url || '%20a+b%3Bc%41%zz%e9100%', '(%[0-9A-Fa-f]{2}|[^%]+|%)')))) AS i FROM pages),
c AS (SELECT page_id, i, x, CASE WHEN regexp_full_match(x, '%[0-9A-Fa-f]{2}') THEN CAST('0x' || substr(x, 2, 2) AS INTEGER) END AS code FROM t)
SELECT page_id, string_agg(CASE WHEN code = 59 THEN '.' WHEN code BETWEEN 33 AND 127 THEN chr(code) ELSE x END, '' ORDER BY i) AS plain FROM c GROUP BY page_id""")
def percent_decode(spark, d):
    return table(spark, d, "pages").select("page_id", seq.percent_decode(F.concat("url", F.lit("%20a+b%3Bc%41%zz%e9100%"))).alias("plain"))


@register("query_fields", "WITH f AS (SELECT page_id, unnest(string_split(regexp_extract(url, '\\?([^#]*)', 1), '&')) AS f FROM pages WHERE url LIKE '%?%') SELECT page_id, split_part(f, '=', 1) AS name, split_part(f, '=', 2) AS value FROM f")
def query_fields(spark, d):
    """Attribute lists as rows of name and value."""
    f = table(spark, d, "pages").where("url like '%?%'").select("page_id", F.explode(F.split(F.regexp_extract("url", r"\?([^#]*)", 1), "&")).alias("f"))
    return f.select("page_id", F.split_part("f", F.lit("="), F.lit(1)).alias("name"), F.split_part("f", F.lit("="), F.lit(2)).alias("value"))


@register("shared_kmer_join", """WITH w AS (SELECT item_id, string_split_regex(lower(text), '\\s+') AS w FROM benchmark), k AS (SELECT DISTINCT item_id, array_to_string(w[i:i + 3], ' ') AS k FROM (SELECT item_id, w, unnest(range(1, len(w) - 2)) AS i FROM w)),
dw AS (SELECT doc_id, string_split_regex(lower(text), '\\s+') AS w FROM documents), dk AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + 3], ' ') AS k FROM (SELECT doc_id, w, unnest(range(1, len(w) - 2)) AS i FROM dw))
SELECT doc_id, item_id, count(*) AS shared FROM dk JOIN k USING (k) GROUP BY ALL HAVING count(*) >= 5""")
def shared_kmer_join(spark, d):
    """Probes and records that share seeds: an equi-join on word 4-mers, counted per pair.

    The probes' seeds are written first, so that their size is known: small
    ones filter the records' seeds before anything is shuffled.
    """

    def kmers(df, key):
        w = df.select(key, F.split(F.lower("text"), r"\s+").alias("w"))
        at = F.sequence(F.lit(1), F.size("w") - 3)
        k = F.transform(F.when(F.size("w") >= 4, at).otherwise(F.array().cast("array<int>")), lambda i: F.array_join(F.slice(F.col("w"), i, F.lit(4)), " "))
        return w.select(key, F.explode(F.array_distinct(k)).alias("k"))

    probes, records = materialize(kmers(table(spark, d, "benchmark"), "item_id"), "seeds"), kmers(table(spark, d, "documents"), "doc_id")
    return records.join(probes, "k").groupBy("doc_id", "item_id").agg(F.count(F.lit(1)).alias("shared")).where("shared >= 5")


@register("protein_clusters", f"""WITH {DNA}, code(codon, acid) AS (VALUES {_codon_values()}), c AS (SELECT doc_id, i, substr(s, i, 3) AS codon FROM (SELECT doc_id, s, unnest(range(1, length(s) - 1, 3)) AS i FROM dna WHERE length(s) >= 3)),
p AS (SELECT doc_id, md5(string_agg(coalesce(acid, 'X'), '' ORDER BY i)) AS aa FROM c LEFT JOIN code USING (codon) GROUP BY doc_id),
t AS (SELECT doc_id, source AS chrom, doc_id * 60 + n_chars % 97 AS pos FROM documents), w AS (SELECT *, lag(pos) OVER (PARTITION BY chrom ORDER BY pos, doc_id) AS prev FROM t),
k AS (SELECT doc_id, chrom, sum(CASE WHEN prev IS NULL OR pos > prev + 100 THEN 1 ELSE 0 END) OVER (PARTITION BY chrom ORDER BY pos, doc_id ROWS UNBOUNDED PRECEDING) AS cluster FROM w)
SELECT chrom, cluster::BIGINT AS cluster, aa, count(*) AS n, min(doc_id) AS head FROM p JOIN k USING (doc_id) GROUP BY chrom, cluster, aa""")
def protein_clusters(spark, d):
    """Records whose starts lie within 100 positions of one another, by their protein's digest."""
    s = _dna(spark, d).where("length(s) >= 3").select("doc_id", F.md5(seq.translate(F.col("s"))).alias("aa"))
    start = F.col("doc_id") * 60 + F.col("n_chars") % 97
    t = table(spark, d, "documents").select(F.col("doc_id").alias("id"), F.col("source").alias("chrom"), start.alias("start"), start.alias("end"))
    k = number_islands(t, 100, ["chrom"]).select(F.col("id").alias("doc_id"), "chrom", F.col("island").alias("cluster"))
    return s.join(k, "doc_id").groupBy("chrom", "cluster", "aa").agg(F.count(F.lit(1)).alias("n"), F.min("doc_id").alias("head"))
