"""Other text forms of the domain, each as a function from lines (``value``) to rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def _numbers(c: Column) -> Column:
    return F.transform(F.filter(F.split(c, ","), lambda x: x != ""), lambda x: x.cast("long"))


def parse_psl(lines: DataFrame) -> DataFrame:
    """Spliced alignments of 21 columns: one row each, blocks as exons (closed, from 1), identity in percent, coverage of the query."""
    t = F.split("value", "\t")
    rows = lines.select(t.alias("t")).where("size(t) >= 21").where(F.col("t")[0].rlike("^[0-9]+$"))
    n = lambda i: F.col("t")[i].cast("long")
    sizes, starts, q_starts = _numbers(F.col("t")[18]), _numbers(F.col("t")[20]), _numbers(F.col("t")[19])
    exons = F.zip_with(sizes, starts, lambda s, b: F.struct((b + 1).alias("start"), (b + s).alias("end")))
    aligned = n(0) + n(1) + n(2)
    return rows.select(F.col("t")[9].alias("query"), n(10).alias("q_len"), F.col("t")[13].alias("chrom"), F.col("t")[8].substr(1, 1).alias("strand"), (n(15) + 1).alias("start"), n(16).alias("end"), exons.alias("exons"), q_starts.alias("q_starts"), sizes.alias("sizes"), (100.0 * (n(0) + n(2)) / aligned).alias("pid"), (100.0 * aligned / n(10)).alias("cov"))


def psl_cigar(psl: DataFrame) -> DataFrame:
    """Adds the alignment as a CIGAR: clips at both ends, blocks, and between them insertions and deletions (long ones are introns)."""
    steps = F.transform(
        F.sequence(F.lit(0), F.size("sizes") - 1),
        lambda i: F.concat(
            F.when(i > 0, F.concat(
                F.when(F.col("q_starts")[i] > F.col("q_starts")[i - 1] + F.col("sizes")[i - 1], F.concat((F.col("q_starts")[i] - F.col("q_starts")[i - 1] - F.col("sizes")[i - 1]).cast("string"), F.lit("I"))).otherwise(""),
                F.when(F.col("exons")[i]["start"] > F.col("exons")[i - 1]["end"] + 1, F.concat((F.col("exons")[i]["start"] - F.col("exons")[i - 1]["end"] - 1).cast("string"), F.when(F.col("exons")[i]["start"] - F.col("exons")[i - 1]["end"] > 10, "N").otherwise("D"))).otherwise(""),
            )).otherwise(""),
            F.col("sizes")[i].cast("string"), F.lit("M"),
        ),
    )
    left, right = F.col("q_starts")[0], F.col("q_len") - F.element_at("q_starts", -1) - F.element_at("sizes", -1)
    clip = lambda n: F.when(n > 0, F.concat(n.cast("string"), F.lit("S"))).otherwise("")
    return psl.withColumn("cigar", F.concat(clip(left), F.array_join(steps, ""), clip(right)))


def parse_btab(lines: DataFrame) -> DataFrame:
    """Hits of 22 columns with their segments, ``~`` between them: array of (q5, q3, h5, h3, pid)."""
    t = F.split("value", "\t")
    rows = lines.select(t.alias("t")).where("size(t) >= 22")
    part = lambda x, i: F.regexp_extract(x, r"(\d+)-(\d+):(\d+)-(\d+)\|([\d.]+)", i)
    hsps = F.transform(F.filter(F.split(F.col("t")[21], "~"), lambda x: x != ""), lambda x: F.struct(*[part(x, i + 1).try_cast("long").alias(n) for i, n in enumerate(("q5", "q3", "h5", "h3"))], part(x, 5).try_cast("double").alias("pid")))
    return rows.select(F.col("t")[0].alias("query"), F.col("t")[2].try_cast("long").alias("q_len"), F.col("t")[5].alias("hit"), F.col("t")[17].alias("strand"), F.col("t")[19].try_cast("double").alias("e_value"), hsps.alias("hsps"))


def btab_filter(btab: DataFrame, least_cov: float, least_pid: float = 0, max_intron: int | None = None) -> DataFrame:
    """Hits whose segments together cover enough of the query; weak segments do not count, far ones drop the hit."""
    good = F.array_sort(F.transform(F.filter("hsps", lambda h: h["pid"] >= least_pid), lambda h: F.struct(F.least(h["q5"], h["q3"]).alias("s"), F.greatest(h["q5"], h["q3"]).alias("e"))))
    merged = F.aggregate(good, F.struct(F.lit(0).cast("long").alias("upto"), F.lit(0).cast("long").alias("n")), lambda a, x: F.struct(F.greatest(a["upto"], x["e"]).alias("upto"), (a["n"] + F.greatest(F.lit(0).cast("long"), x["e"] - F.greatest(x["s"], a["upto"] + 1) + 1)).alias("n")))
    out = btab.withColumn("qcov", 100.0 * merged["n"] / F.col("q_len")).where(F.col("qcov") >= least_cov)
    if max_intron is None:
        return out
    place = F.array_sort(F.transform("hsps", lambda h: F.struct(F.least(h["h5"], h["h3"]).alias("s"), F.greatest(h["h5"], h["h3"]).alias("e"))))
    apart = F.exists(F.sequence(F.lit(1), F.greatest(F.size("hsps") - 1, F.lit(1))), lambda i: F.coalesce(F.get(place, i)["s"] - F.get(place, i - 1)["e"] > max_intron, F.lit(False)))
    return out.where(~apart)


def parse_agp(lines: DataFrame) -> DataFrame:
    """Parts of assembled objects: sequence parts with their range and orientation, gaps with their length."""
    t = F.split("value", "\t")
    rows = lines.where(~F.col("value").startswith("#")).select(t.alias("t")).where("size(t) >= 8")
    gap = F.col("t")[4].isin("N", "U")
    return rows.select(F.col("t")[0].alias("object"), F.col("t")[1].cast("long").alias("start"), F.col("t")[2].cast("long").alias("end"), F.col("t")[3].cast("int").alias("part"), F.when(~gap, F.col("t")[5]).alias("component"), F.when(~gap, F.col("t")[6].try_cast("long")).alias("from"), F.when(~gap, F.col("t")[7].try_cast("long")).alias("to"), F.when(~gap, F.get("t", F.lit(8))).alias("orient"), F.when(gap, F.col("t")[5].try_cast("long")).alias("gap"))


def build_objects(agp: DataFrame, sequences: DataFrame) -> DataFrame:
    """``object, seq``: the parts cut, turned and joined in order, gaps as N."""
    from helixframe.functions.seq import reverse_complement

    cut = F.expr("substring(seq, cast(`from` as int), cast(`to` - `from` + 1 as int))")
    met = agp.join(sequences.select(F.col("id").alias("component"), "seq"), "component", "left")
    piece = F.when(F.col("gap").isNotNull(), F.expr("repeat('N', cast(gap as int))")).when(F.col("orient") == "-", reverse_complement(cut)).otherwise(cut)
    parts = met.groupBy("object").agg(F.array_sort(F.collect_list(F.struct("part", F.coalesce(piece, F.lit("")).alias("s")))).alias("p"))
    return parts.select("object", F.array_join(F.transform("p", lambda x: x["s"]), "").alias("seq"))


def read_obo(spark: SparkSession, path: str) -> DataFrame:
    return parse_obo(spark.read.option("lineSep", "\n[").text(path))


def parse_obo(stanzas: DataFrame) -> DataFrame:
    """``id, name, namespace, parents, obsolete`` of ontology terms, a stanza's text in each row."""
    raw = stanzas.where(F.col("value").rlike(r"^\[?Term\]"))
    field = lambda k: F.nullif(F.regexp_extract("value", rf"(?m)^{k}: *([^\n!]*?) *(?:!.*)?$", 1), F.lit(""))
    return raw.select(field("id").alias("id"), field("name").alias("name"), field("namespace").alias("namespace"), F.regexp_extract_all("value", F.lit(r"(?m)^is_a: *(\S+)"), 1).alias("parents"), F.coalesce(field("is_obsolete") == "true", F.lit(False)).alias("obsolete"))


def parse_taxonomy(lines: DataFrame) -> DataFrame:
    """``id, parent, rank`` of dump lines with bars between fields."""
    t = F.split("value", r"\t\|\t?")
    return lines.select(t[0].cast("long").alias("id"), t[1].cast("long").alias("parent"), t[2].alias("rank")).where("id is not null")


def subtree(taxa: DataFrame, root: int, name: str = "helixframe_taxa") -> DataFrame:
    """``id, depth`` of a node and all below it: one join per level."""
    taxa.where("id <> parent").createOrReplaceTempView(name)
    return taxa.sparkSession.sql(f"WITH RECURSIVE w(id, depth) AS (SELECT CAST({int(root)} AS BIGINT), 0 UNION ALL SELECT t.id, w.depth + 1 FROM {name} t JOIN w ON t.parent = w.id) SELECT id, depth FROM w")


def parse_qseq(lines: DataFrame, keep_failed: bool = False) -> DataFrame:
    """``id, seq, qual`` of instrument rows of eleven columns: dots are N, trailing Ns go with their qualities, failed reads go."""
    t = F.split("value", "\t")
    rows = lines.select(t.alias("t")).where("size(t) = 11")
    rows = rows if keep_failed else rows.where(F.col("t")[10] == "1")
    s = F.regexp_replace(F.translate(F.col("t")[8], ".", "N"), "N+$", "")
    name = F.concat(F.array_join(F.slice("t", 1, 6), ":"), F.lit("/"), F.col("t")[7])
    return rows.select(name.alias("id"), s.alias("seq"), F.expr("substring(t[9], 1, length(regexp_replace(translate(t[8], '.', 'N'), 'N+$', '')))").alias("qual"))


def trim_soft_clips(df: DataFrame) -> DataFrame:
    """Alignments without their soft-clipped ends (``seq, qual, cigar``)."""
    left, right = F.coalesce(F.regexp_extract("cigar", r"^(?:\d+H)?(\d+)S", 1).try_cast("int"), F.lit(0)), F.coalesce(F.regexp_extract("cigar", r"(\d+)S(?:\d+H)?$", 1).try_cast("int"), F.lit(0))
    kept = lambda c: F.substring(F.col(c), left + 1, F.length(c) - left - right)
    return df.withColumn("_q", F.when(F.col("qual") == "*", "*").otherwise(kept("qual"))).withColumn("_s", kept("seq")).withColumn("cigar", F.regexp_replace("cigar", r"^((?:\d+H)?)\d+S|\d+S((?:\d+H)?)$", "$1$2")).drop("seq", "qual").withColumnsRenamed({"_s": "seq", "_q": "qual"})


def gap_list(df: DataFrame, least: int = 1) -> DataFrame:
    """``id, start, length`` of the stretches of N."""
    from helixframe.functions.seq import runs

    return df.select("id", F.explode(runs(F.upper("seq"), "N", least)).alias("g")).select("id", F.col("g.start").alias("start"), F.col("g.length").alias("length"))
