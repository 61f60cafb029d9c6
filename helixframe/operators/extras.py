"""Smaller operators over hits, annotation, alignments and assemblies."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from helixframe.functions import seq
from helixframe.operators.intervals import overlap_join


def search_filter(hits: DataFrame, least_pid: float = 0, least_score: float = 0, most_e: float | None = None, strand: str | None = None, most_segments: int | None = None) -> DataFrame:
    """Hits ``q, h, pid, score, e_value, strand`` within all bounds; of each pair of sequences at most ``most_segments``, best score first (then as the columns sort)."""
    rows = hits.where((F.col("pid") >= least_pid) & (F.col("score") >= least_score))
    if most_e is not None:
        rows = rows.where(F.col("e_value") <= most_e)
    if strand is not None:
        rows = rows.where(F.col("strand") == strand)
    if most_segments is None:
        return rows
    rest = [c for c in hits.columns if c not in ("q", "h", "score")]
    place = F.row_number().over(Window.partitionBy("q", "h").orderBy(F.desc("score"), *rest))
    return rows.withColumn("_place", place).where(F.col("_place") <= most_segments).drop("_place")


def included(t: DataFrame) -> DataFrame:
    """``tid, within``: single-exon models that lie in an exon of a longer model of their strand with at least their coverage (``cov``); the longest such, then the smallest tid."""
    one = t.where(F.size("exons") == 1).select("tid", "chrom", "strand", "start", "end", "cov")
    e = t.select(F.col("tid").alias("tid2"), "chrom", "strand", F.col("cov").alias("cov2"), F.aggregate("exons", F.lit(0).cast("long"), lambda a, x: a + x["end"] - x["start"] + 1).alias("len2"), F.explode("exons").alias("e"))
    e = e.select("tid2", "chrom", "strand", "cov2", "len2", F.col("e.start").alias("start2"), F.col("e.end").alias("end2"))
    met = overlap_join(one, e, ["chrom", "strand"]).where("tid <> tid2 and start >= start2 and end <= end2 and cov2 >= cov").where("len2 > end - start + 1")
    best = met.groupBy("tid").agg(F.max(F.struct("len2", F.negative("tid2").alias("t"))).alias("b"))
    return best.select("tid", F.negative("b.t").alias("within"))


def genotypes(counts: DataFrame, error: float = 0.01) -> DataFrame:
    """``chrom, pos, genotype, quality`` of two alleles from base counts (``chrom, pos, base, n``).

    The two commonest bases of a position are its alleles (the first in order
    on ties). Each base is right with 1 - ``error``; the likelihoods of both
    homozygous and the heterozygous genotype follow, and the quality is ten
    times the distance (log10) of the best to the second.
    """
    order = Window.partitionBy("chrom", "pos").orderBy(F.desc("n"), "base")
    two = counts.where(F.col("base").isin("A", "C", "G", "T")).withColumn("k", F.row_number().over(order)).where("k <= 2")
    a, b = F.max(F.when(F.col("k") == 1, F.struct("base", "n"))), F.max(F.when(F.col("k") == 2, F.struct("base", "n")))
    rows = two.groupBy("chrom", "pos").agg(a.alias("a"), b.alias("b")).select("chrom", "pos", F.col("a.base").alias("x"), F.col("b.base").alias("y"), F.col("a.n").alias("n"), F.coalesce("b.n", F.lit(0)).alias("m"))
    right, wrong, half = F.log10(F.lit(1 - error)), F.log10(F.lit(error)), F.log10(F.lit(0.5))
    gl = F.array(
        F.struct((F.col("n") * right + F.col("m") * wrong).alias("l"), F.concat("x", "x").alias("g")),
        F.struct(F.when(F.col("y").isNull(), F.lit(-1e300)).otherwise((F.col("n") + F.col("m")) * half).alias("l"), F.coalesce(F.concat("x", "y"), F.lit("")).alias("g")),
        F.struct(F.when(F.col("y").isNull(), F.lit(-1e300)).otherwise(F.col("m") * right + F.col("n") * wrong).alias("l"), F.coalesce(F.concat("y", "y"), F.lit("")).alias("g")),
    )
    ranked = rows.withColumn("gl", F.sort_array(gl, asc=False))
    return ranked.select("chrom", "pos", F.col("gl")[0]["g"].alias("genotype"), F.least(F.lit(99.0), 10 * (F.col("gl")[0]["l"] - F.col("gl")[1]["l"])).alias("quality"))


def edit_count(read: Column, reference: Column) -> Column:
    """How many bases differ between two aligned strings of one length (N against anything counts)."""
    return F.length(read) - F.size(F.filter(F.zip_with(F.split(F.upper(read), ""), F.split(F.upper(reference), ""), lambda a, b: (a == b) & (a != "N") & (a != "")), lambda x: x))


def mismatch_string(read: Column, reference: Column) -> Column:
    """The text that restores the reference from a gapless alignment: lengths of equal stretches with reference bases between them."""
    pairs = F.zip_with(F.filter(F.split(F.upper(read), ""), lambda c: c != ""), F.filter(F.split(F.upper(reference), ""), lambda c: c != ""), lambda a, b: F.when(a == b, "=").otherwise(b))
    marks = F.array_join(pairs, "")
    parts = F.regexp_extract_all(marks, F.lit("(=+|[^=])"), 1)
    text = F.array_join(F.transform(parts, lambda x: F.when(x.startswith("="), F.length(x).cast("string")).otherwise(x)), "|")
    # a zero stands where two differing bases or an end leave no equal stretch
    text = F.regexp_replace(F.regexp_replace(text, r"(?<=[A-Z])\|(?=[A-Z])", "0"), r"\|", "")
    return F.concat(F.when(text.rlike("^[A-Z]"), "0").otherwise(""), text, F.when(text.rlike("[A-Z]$"), "0").otherwise(""))


def vector_trim(reads: DataFrame, hits: DataFrame, within: int = 10, least: int = 15) -> DataFrame:
    """Reads ``id, seq`` without what vector hits (``id, lo, hi``, from 1) cover near an end; what is shorter than ``least`` goes."""
    n = F.length("seq")
    ends = reads.join(hits, "id", "left").groupBy("id", "seq").agg(F.max(F.when(F.col("lo") <= within, F.col("hi"))).alias("l"), F.min(F.when(F.col("hi") > n - within, F.col("lo"))).alias("r"))
    first, last = F.coalesce(F.col("l"), F.lit(0)) + 1, F.coalesce(F.col("r") - 1, n)
    return ends.select("id", F.when(last >= first, F.substring("seq", first.cast("int"), (last - first + 1).cast("int"))).otherwise("").alias("seq")).where(F.length("seq") >= least)


def component_overlaps(parts: DataFrame, least: int = 1) -> DataFrame:
    """``contig, name, name2, start, end`` of the stretches in which two components of a contig overlap by at least ``least``."""
    a = parts.select("contig", "name", "start", "end")
    b = a.toDF("contig", "name2", "start2", "end2")
    met = overlap_join(a, b, ["contig"]).where("name < name2")
    return met.select("contig", "name", "name2", F.greatest("start", "start2").alias("lo"), F.least("end", "end2").alias("hi")).where(F.col("hi") - F.col("lo") + 1 >= least)


def layout_sequence(parts: DataFrame, gap: int = 20) -> DataFrame:
    """``scaffold, seq``: contigs ``scaffold, start, end, strand, seq`` joined in order; the positions between two are N, ``gap`` of them where they overlap."""
    w = Window.partitionBy("scaffold").orderBy("start", "end")
    between = F.col("start") - F.lag("end").over(w) - 1
    rows = parts.withColumn("n", F.when(between < 0, gap).otherwise(F.coalesce(between, F.lit(0))))
    own = F.when(F.col("strand") == "-", seq.reverse_complement(F.col("seq"))).otherwise(F.col("seq"))
    piece = F.concat(F.expr("repeat('N', cast(n as int))"), own)
    joined = rows.groupBy("scaffold").agg(F.array_sort(F.collect_list(F.struct("start", "end", piece.alias("p")))).alias("p"))
    return joined.select("scaffold", F.array_join(F.transform("p", lambda x: x["p"]), "").alias("seq"))


def sam_header(lines: DataFrame) -> DataFrame:
    """``kind, tags`` of header lines: the record type and its fields as a map."""
    rows = lines.where(F.col("value").rlike("^@[A-Z]{2}\t"))
    fields = F.slice(F.split("value", "\t"), 2, 1 << 20)
    return rows.select(F.substring("value", 2, 2).alias("kind"), F.map_from_entries(F.transform(fields, lambda x: F.struct(F.substring(x, 1, 2), F.substring(x, 4, 1 << 20)))).alias("tags"))


def merge_stop_codons(rows: DataFrame) -> DataFrame:
    """``tid, chrom, strand, cds_start, cds_end``: coding ranges with the stop codon rows (``kind`` stop) taken in."""
    return rows.where(F.col("kind").isin("cds", "stop")).groupBy("tid", "chrom", "strand").agg(F.min("start").alias("cds_start"), F.max("end").alias("cds_end"))
