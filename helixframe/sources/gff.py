"""Annotation lines: nine tab-separated columns, attributes in either style."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

COLUMNS = ("seqid", "source", "type", "start", "end", "score", "strand", "phase", "attributes")


def attribute(attrs: Column, key: str) -> Column:
    """An attribute of either style: ``key=value`` or ``key "value"``; null if it is absent."""
    quoted = F.regexp_extract(attrs, rf'(?:^|;)\s*{key}\s+"([^"]*)"', 1)
    plain = F.regexp_extract(attrs, rf"(?:^|;)\s*{key}=\"?([^;\"]*)", 1)
    return F.nullif(F.when(quoted != "", quoted).otherwise(plain), F.lit(""))


def attribute_map(attrs: Column) -> Column:
    """All attributes as a map; semicolons within quotes do not part them."""
    parts = F.regexp_extract_all(attrs, F.lit(r'((?:[^;"]|"[^"]*")+)'), 1)
    pair = F.transform(F.filter(parts, lambda x: F.trim(x) != ""), lambda x: F.struct(F.regexp_extract(F.trim(x), r"^([^=\s]+)", 1).alias("k"), F.regexp_replace(F.regexp_extract(F.trim(x), r"^[^=\s]+[=\s]\s*(.*)$", 1), '^"|"$', "").alias("v")))
    return F.aggregate(pair, F.create_map().cast("map<string,string>"), lambda m, p: F.when(F.map_contains_key(m, p["k"]), m).otherwise(F.map_concat(m, F.create_map(p["k"], p["v"]))))


def parse_gff(lines: DataFrame) -> DataFrame:
    """Text lines as rows. Comments and lines of fewer than nine columns or with a bad strand go, what follows a further tab is of the attributes; reversed coordinates are swapped; score ``.`` is 0."""
    t = F.split("value", "\t", 9)
    rows = lines.where(~F.col("value").startswith("#")).select(t.alias("t")).where("size(t) = 9")
    a, b = F.col("t")[3].try_cast("long"), F.col("t")[4].try_cast("long")
    rows = rows.select(
        F.col("t")[0].alias("seqid"), F.col("t")[1].alias("source"), F.col("t")[2].alias("type"), F.least(a, b).alias("start"), F.greatest(a, b).alias("end"),
        F.when(F.col("t")[5] == ".", F.lit(0.0)).otherwise(F.col("t")[5].try_cast("double")).alias("score"), F.col("t")[6].alias("strand"), F.col("t")[7].alias("phase"), F.col("t")[8].alias("attributes"),
    )
    return rows.where("start is not null and end is not null and strand in ('+', '-', '.')")


def read_gff(spark: SparkSession, path: str) -> DataFrame:
    return parse_gff(spark.read.text(path))


def feature_kind(kind: Column) -> Column:
    """exon, cds, utr, start, stop, intron, gene or rna by the type's name; null for others."""
    k = F.lower(kind)
    return (
        F.when(k.contains("utr"), "utr").when(k.contains("start") & k.contains("codon"), "start").when(k.contains("stop") & k.contains("codon"), "stop")
        .when(k.endswith("exon"), "exon").when(k == "cds", "cds").when(k.contains("intron"), "intron").when(k.endswith("gene"), "gene").when(k.contains("rna") | k.contains("transcript"), "rna")
    )


def exons(gff: DataFrame) -> DataFrame:
    """``tid, chrom, strand, start, end`` of all exon rows: one for each parent, or for the transcript id."""
    parent = F.coalesce(attribute(F.col("attributes"), "Parent"), attribute(F.col("attributes"), "transcript_id"))
    rows = gff.where(feature_kind(F.col("type")).isin("exon", "cds", "utr")).where(parent.isNotNull())
    return rows.select(F.explode(F.split(parent, ",")).alias("tid"), F.col("seqid").alias("chrom"), "strand", "start", "end")


def to_gff(t: DataFrame, source: str = "helixframe", gtf: bool = False) -> DataFrame:
    """Transcripts (``tid, chrom, strand, exons, start, end``) as text lines: the transcript, then its exons."""
    name = F.concat(F.lit('transcript_id "'), "tid", F.lit('";')) if gtf else None
    line = lambda kind, s, e, attrs: F.concat_ws("\t", "chrom", F.lit(source), F.lit(kind), s.cast("string"), e.cast("string"), F.lit("."), "strand", F.lit("."), attrs)
    head = t.select("tid", F.lit(0).alias("k"), line("transcript", F.col("start"), F.col("end"), name if gtf else F.concat(F.lit("ID="), "tid")).alias("value"))
    e = t.select("tid", "chrom", "strand", F.posexplode("exons").alias("k", "e"))
    body = e.select("tid", (F.col("k") + 1).alias("k"), line("exon", F.col("e.start"), F.col("e.end"), name if gtf else F.concat(F.lit("Parent="), "tid")).alias("value"))
    return head.unionByName(body).orderBy("tid", "k").select("value")


def to_bed12(t: DataFrame) -> DataFrame:
    """Transcripts as twelve-column rows, starts from 0."""
    each = lambda f: F.concat(F.array_join(F.transform("exons", f), ","), F.lit(","))
    low = (F.col("start") - 1).cast("string")
    return t.select(F.concat_ws("\t", "chrom", low, F.col("end").cast("string"), "tid", F.lit("0"), "strand", low, low, F.lit("0"), F.size("exons").cast("string"), each(lambda e: (e["end"] - e["start"] + 1).cast("string")), each(lambda e: (e["start"] - F.col("start")).cast("string"))).alias("value"))


def to_iit(t: DataFrame) -> DataFrame:
    """Transcripts as lines of an interval index: name, range in the direction of the strand, number of exons."""
    low, high = F.col("start").cast("string"), F.col("end").cast("string")
    place = F.when(F.col("strand") == "-", F.concat(high, F.lit(".."), low)).otherwise(F.concat(low, F.lit(".."), high))
    return t.select(F.concat(F.lit(">"), "tid", F.lit(" "), "chrom", F.lit(":"), place, F.lit(" "), F.size("exons"), F.lit(" exons")).alias("value"))
