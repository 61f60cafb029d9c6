"""Flat-file records (``value`` holds one record's text) and alignment reports as rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _field(pattern: str, group: int = 1) -> Column:
    return F.nullif(F.regexp_extract("value", pattern, group), F.lit(""))


def parse_genbank(records: DataFrame) -> DataFrame:
    """``accession, definition, organism, kind, strand, parts, gene, product``: a row per feature; parts are its ranges (closed, from 1)."""
    head = records.select(_field(r"(?m)^ACCESSION +(\S+)").alias("accession"), F.regexp_replace(_field(r"(?s)\nDEFINITION +(.*?)\n[A-Z]"), r"\s+", " ").alias("definition"), _field(r"(?m)^ +ORGANISM +(.+)$").alias("organism"), F.regexp_extract("value", r"(?s)\nFEATURES[^\n]*\n(.*?)\n(?:ORIGIN|//|[A-Z])", 1).alias("table"))
    features = F.regexp_extract_all("table", F.lit(r"(?s)(?:^|\n)( {5}\S.*?)(?=\n {5}\S|$)"), 1)
    rows = head.withColumn("f", F.explode(features))
    place = F.regexp_replace(F.regexp_extract("f", r"(?s)^ {5}\S+\s+([^/]*)", 1), r"\s", "")
    ranges = F.transform(F.regexp_extract_all(place, F.lit(r"(<?\d+(?:\.\.>?\d+)?)"), 1), lambda x: F.struct(F.regexp_extract(x, r"(\d+)", 1).cast("long").alias("start"), F.regexp_extract(x, r"(\d+)$", 1).cast("long").alias("end")))
    quoted = lambda k: F.nullif(F.regexp_replace(F.regexp_extract("f", rf'(?s)/{k}="([^"]*)"', 1), r"\s+", " "), F.lit(""))
    return rows.select("accession", "definition", "organism", F.regexp_extract("f", r"^ {5}(\S+)", 1).alias("kind"), F.when(place.contains("complement"), "-").otherwise("+").alias("strand"), ranges.alias("parts"), quoted("gene").alias("gene"), quoted("product").alias("product"))


def genbank_sequence(records: DataFrame) -> DataFrame:
    """``accession, definition, seq`` in upper case."""
    body = F.regexp_extract("value", r"(?s)\nORIGIN[^\n]*\n(.*?)(?://|$)", 1)
    return records.select(_field(r"(?m)^ACCESSION +(\S+)").alias("accession"), F.regexp_replace(_field(r"(?s)\nDEFINITION +(.*?)\n[A-Z]"), r"\s+", " ").alias("definition"), F.upper(F.regexp_replace(body, r"[^A-Za-z]", "")).alias("seq"))


def parse_uniprot(records: DataFrame) -> DataFrame:
    """``id, reviewed, accessions, name, gene, taxon, xrefs, seq`` of protein entries; xrefs are (database, key)."""
    joined = lambda code: F.array_join(F.regexp_extract_all("value", F.lit(rf"(?m)^{code}   (.*)$"), 1), " ")
    xrefs = F.transform(F.regexp_extract_all("value", F.lit(r"(?m)^DR   ([^;]+; [^;]+);"), 1), lambda x: F.struct(F.split(x, "; ")[0].alias("db"), F.split(x, "; ")[1].alias("key")))
    return records.select(
        _field(r"(?m)^ID   (\S+)").alias("id"), F.col("value").rlike(r"(?m)^ID   \S+ +Reviewed;").alias("reviewed"), F.regexp_extract_all(joined("AC"), F.lit(r"([A-Z0-9]+);"), 1).alias("accessions"),
        F.nullif(F.regexp_extract(joined("DE"), r"RecName: Full=([^;{]+?) *[;{]", 1), F.lit("")).alias("name"), F.nullif(F.regexp_extract(joined("GN"), r"Name=([^;{]+?) *[;{]", 1), F.lit("")).alias("gene"),
        F.regexp_extract(joined("OX"), r"NCBI_TaxID=(\d+)", 1).try_cast("long").alias("taxon"), xrefs.alias("xrefs"), F.regexp_replace(F.regexp_extract("value", r"(?s)\nSQ [^\n]*\n(.*?)(?://|$)", 1), r"\s", "").alias("seq"),
    )


def parse_uniref(entries: DataFrame) -> DataFrame:
    """``cluster, members, declared, complete`` of cluster entries in XML: the members' names and whether there are as many as declared."""
    members = F.regexp_extract_all("value", F.lit(r'<dbReference type="UniProtKB ID" id="([^"]+)"'), 1)
    declared = F.regexp_extract("value", r'type="member count" value="(\d+)"', 1).try_cast("long")
    return entries.select(_field(r'<entry id="([^"]+)"').alias("cluster"), members.alias("members"), declared.alias("declared")).withColumn("complete", F.size("members") == F.col("declared"))


def parse_ace(contigs: DataFrame) -> DataFrame:
    """``contig, bases, reads, seq, name, orient, start`` of assemblies, a contig's text (from ``CO``) in each row; a row per read."""
    seq = F.regexp_replace(F.regexp_extract("value", r"(?s)^CO [^\n]*\n(.*?)\n(?:\n|BQ|AF)", 1), r"[\s*]", "")
    reads = F.regexp_extract_all("value", F.lit(r"(?m)^(AF \S+ [UC] -?\d+)"), 1)
    rows = contigs.select(_field(r"^CO (\S+)").alias("contig"), _field(r"^CO \S+ (\d+)").cast("long").alias("bases"), _field(r"^CO \S+ \d+ (\d+)").cast("long").alias("reads"), seq.alias("seq"), F.explode(reads).alias("r"))
    f = F.split("r", " ")
    return rows.select("contig", "bases", "reads", "seq", f[1].alias("name"), F.when(f[2] == "C", "-").otherwise("+").alias("orient"), f[3].cast("long").alias("start"))


def parse_clustal(lines: DataFrame) -> DataFrame:
    """``name, seq`` of an alignment in blocks: numbered lines (``n, value``), the parts of each name joined in order."""
    rows = lines.where(F.col("value").rlike(r"^\S+\s+[A-Za-z*.-]+(\s+\d+)?\s*$") & ~F.col("value").startswith("CLUSTAL"))
    f = rows.select("n", *[c for c in lines.columns if c not in ("n", "value")], F.regexp_extract("value", r"^(\S+)", 1).alias("name"), F.regexp_extract("value", r"^\S+\s+([A-Za-z*.-]+)", 1).alias("part"))
    keys = [c for c in f.columns if c not in ("n", "part")]
    return f.groupBy(*keys).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n", "part"))), lambda x: x["part"]), "").alias("seq"))


def parse_feature_table(blocks: DataFrame) -> DataFrame:
    """``seqid, kind, strand, parts, gene, product`` of feature tables, a sequence's text (from ``>Feature``) in each row; a range that runs backwards is on the minus strand."""
    rows = blocks.select(_field(r"^>Feature (\S+)").alias("seqid"), F.explode(F.regexp_extract_all("value", F.lit(r"(?s)(?:^|\n)([<\d]+\t[>\d]+\t\S+.*?)(?=\n[<\d]+\t[>\d]+\t\S|$)"), 1)).alias("f"))
    pair = lambda x, i: F.regexp_extract(x, r"^<?(\d+)\t>?(\d+)", i).cast("long")
    parts = F.transform(F.regexp_extract_all("f", F.lit(r"(?m)^(<?\d+\t>?\d+)"), 1), lambda x: F.struct(F.least(pair(x, 1), pair(x, 2)).alias("start"), F.greatest(pair(x, 1), pair(x, 2)).alias("end")))
    note = lambda k: F.nullif(F.regexp_extract("f", rf"\t\t\t{k}\t([^\n]+)", 1), F.lit(""))
    return rows.select("seqid", F.regexp_extract("f", r"^\S+\t\S+\t(\S+)", 1).alias("kind"), F.when(pair(F.col("f"), 1) > pair(F.col("f"), 2), "-").otherwise("+").alias("strand"), F.array_sort(parts).alias("parts"), note("gene").alias("gene"), note("product").alias("product"))


def parse_vulgar(lines: DataFrame) -> DataFrame:
    """``query, q_start, q_end, target, t_start, t_end, strand, score, exons, matched`` of spliced protein or read alignments in one line; exons are closed and from 1."""
    t = F.split("value", r"\s+")
    rows = lines.where(F.col("value").startswith("vulgar:")).select(t.alias("t"))
    n = lambda i: F.get("t", F.lit(i)).cast("long")
    steps = F.transform(F.sequence(F.lit(0), F.floor((F.size("t") - 10) / 3).cast("int") - 1), lambda i: F.struct(F.get("t", 10 + i * 3).alias("op"), F.get("t", 11 + i * 3).cast("long").alias("q"), F.get("t", 12 + i * 3).cast("long").alias("t")))
    rows = rows.select(F.get("t", F.lit(1)).alias("query"), n(2).alias("q_start"), n(3).alias("q_end"), F.get("t", F.lit(5)).alias("target"), F.least(n(6), n(7)).alias("t_start"), F.greatest(n(6), n(7)).alias("t_end"), F.get("t", F.lit(8)).alias("strand"), n(9).alias("score"), steps.alias("s"))
    none = F.array().cast("array<struct<start:bigint,end:bigint>>")
    # along the target from the left; on the minus strand the steps are turned
    along = F.when(F.col("strand") == "-", F.reverse("s")).otherwise(F.col("s"))
    walked = F.aggregate(
        along,
        F.struct(F.col("t_start").alias("at"), F.col("t_start").alias("from"), none.alias("out")),
        lambda a, x: F.when(x["op"].isin("5", "3", "I"), F.struct((a["at"] + x["t"]).alias("at"), (a["at"] + x["t"]).alias("from"), F.when(a["at"] > a["from"], F.concat(a["out"], F.array(F.struct((a["from"] + 1).alias("start"), a["at"].alias("end"))))).otherwise(a["out"]).alias("out"))).otherwise(F.struct((a["at"] + x["t"]).alias("at"), a["from"].alias("from"), a["out"].alias("out"))),
        lambda a: F.concat(a["out"], F.when(a["at"] > a["from"], F.array(F.struct((a["from"] + 1).alias("start"), a["at"].alias("end")))).otherwise(none)),
    )
    matched = F.aggregate("s", F.lit(0).cast("long"), lambda a, x: a + F.when(x["op"] == "M", x["q"]).otherwise(0))
    return rows.select("query", "q_start", "q_end", "target", "t_start", "t_end", "strand", "score", walked.alias("exons"), matched.alias("matched"))


def defline_order(name: Column, reviewed: str = "^sp\\|", plain: str = "(?i)unknown|hypothetical|uncharacterized|predicted protein") -> list[Column]:
    """The order of a sequence's names (``order.number_rows``): the uninformative last, the reviewed first, else by name."""
    return [name.rlike(plain).cast("int"), (~name.rlike(reviewed)).cast("int"), name]
