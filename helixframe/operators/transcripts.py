"""Transcripts as ``tid, chrom, strand, exons array<struct<start,end>>`` (exons sorted)."""

from __future__ import annotations

from collections.abc import Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from helixframe.operators import codes
from helixframe.operators.graph import connected_components
from helixframe.operators.intervals import deal, islands, number_islands, overlap_join
from helixframe.storage import materialize

#: A single exon sticks out of the exon that contains it by less than this; bases of an intron that count; a contained model's ends lie in introns by less than this.
EDGE, INTO_INTRON, OVERHANG = 8, 10, 4


def assemble(exons: DataFrame) -> DataFrame:
    """Exon rows (tid, chrom, strand, start, end) as transcripts; overlapping or touching exons are merged. A transcript's exons are one row's array."""
    own = exons.groupBy("tid", "chrom", "strand").agg(F.array_sort(F.collect_list(F.struct(F.col("start").cast("long").alias("start"), F.col("end").cast("long").alias("end")))).alias("e"))
    first = F.array(F.col("e")[0])
    merged = F.aggregate(
        F.slice("e", 2, F.greatest(F.size("e") - 1, F.lit(0))),
        first,
        lambda out, x: F.when(
            x["start"] <= F.element_at(out, -1)["end"] + 1,
            F.concat(F.slice(out, 1, F.size(out) - 1), F.array(F.struct(F.element_at(out, -1)["start"].alias("start"), F.greatest(F.element_at(out, -1)["end"], x["end"]).alias("end")))),
        ).otherwise(F.concat(out, F.array(x))),
    )
    return with_range(own.select("tid", "chrom", "strand", merged.alias("exons")))


def with_range(t: DataFrame) -> DataFrame:
    return t.withColumn("start", F.col("exons")[0]["start"]).withColumn("end", F.element_at("exons", -1)["end"])


def introns(exons: Column) -> Column:
    """array of (start, end) between neighbouring exons."""
    return F.when(F.size(exons) > 1, F.transform(F.sequence(F.lit(0), F.size(exons) - 2), lambda i: F.struct((exons[i]["end"] + 1).alias("start"), (exons[i + 1]["start"] - 1).alias("end")))).otherwise(F.array().cast("array<struct<start:bigint,end:bigint>>"))


def chain(exons: Column) -> Column:
    """The intron chain as text; empty for a single exon."""
    return F.array_join(F.transform(introns(exons), lambda x: F.concat_ws("-", x["start"].cast("string"), x["end"].cast("string"))), ",")


def length(exons: Column) -> Column:
    return F.aggregate(exons, F.lit(0).cast("long"), lambda a, e: a + e["end"] - e["start"] + 1)


def exon_overlap(a: Column, b: Column) -> Column:
    """Bases that the exons of two transcripts share."""
    return F.aggregate(a, F.lit(0).cast("long"), lambda s, x: s + F.aggregate(b, F.lit(0).cast("long"), lambda t, y: t + F.greatest(F.lit(0).cast("long"), F.least(x["end"], y["end"]) - F.greatest(x["start"], y["start"]) + 1)))


def class_code(q: Column, r: Column, overlap: Column) -> Column:
    """How a query lies to a reference on one strand (null if they do not overlap). ``overlap``: exonic bases that they share.

    Single exons: = if they share 80 % of the longer, c if they share 80 % of
    a shorter query, else o. A single exon beside a model: c within an exon
    (fewer than ``EDGE`` positions may stick out), i within an intron, e if it
    has ``INTO_INTRON`` bases of an intron and over as many outside of it, else
    o. A model: i within an intron; = the same introns; c a run of the
    reference's introns, with fewer than ``OVERHANG`` positions beyond the
    exons beside them into introns; j shares a splice site; else o.
    """
    qi, ri = introns(q), introns(r)
    q_start, q_end = q[0]["start"], F.element_at(q, -1)["end"]
    r_start, r_end = r[0]["start"], F.element_at(r, -1)["end"]
    q_len, r_len = length(q), length(r)
    single_q, single_r = F.size(q) == 1, F.size(r) == 1
    q_chain, r_chain = chain(q), chain(r)
    shared = F.exists(qi, lambda x: F.exists(ri, lambda y: (x["start"] == y["start"]) | (x["end"] == y["end"])))
    part = F.concat(F.lit(","), r_chain, F.lit(",")).contains(F.concat(F.lit(","), q_chain, F.lit(",")))
    first_exon = F.filter(r, lambda y: y["end"] == q[0]["end"])[0]
    last_exon = F.filter(r, lambda y: y["start"] == F.element_at(q, -1)["start"])[0]
    left = (first_exon["start"] == r_start) | (first_exon["start"] - q_start < OVERHANG)
    right = (last_exon["end"] == r_end) | (q_end - last_exon["end"] < OVERHANG)
    in_intron = F.exists(ri, lambda y: (q_start >= y["start"]) & (q_end <= y["end"]))
    in_exon = F.exists(r, lambda y: (q_start > y["start"] - EDGE) & (q_end < y["end"] + EDGE))
    inside = lambda y: F.least(q_end, y["end"]) - F.greatest(q_start, y["start"]) + 1
    into = F.exists(ri, lambda y: (inside(y) >= INTO_INTRON) & (q_end - q_start + 1 > inside(y) + INTO_INTRON))
    return (
        F.when((q_start > r_end) | (q_end < r_start), F.lit(None))
        .when(single_q & single_r, F.when(overlap >= 0.8 * F.greatest(q_len, r_len), "=").when((q_len < r_len) & (overlap >= 0.8 * q_len), "c").otherwise("o"))
        .when(single_q, F.when(in_exon, "c").when(in_intron, "i").when(into, "e").otherwise("o"))
        .when(in_intron, "i")
        .when(q_chain == r_chain, "=")
        .when(part & left & right, "c")
        .when(shared, "j")
        .otherwise("o")
    )


#: Codes from the closest on; how far behind a reference its run-ons may start, and the share of masked bases of a repeat.
RANK, RUN_ON, MASKED = "=cjeosxipr", 2000, 0.5


def best_codes(query: DataFrame, reference: DataFrame, masked: DataFrame | None = None) -> DataFrame:
    """``tid, code, ref``: the closest relation of each query (``class_code``).

    Beside those: s an intron overlaps one on the other strand; x exons overlap
    on the other strand; p it starts at most ``RUN_ON`` positions behind the
    reference on its strand; r at least ``MASKED`` of it is masked (``masked``:
    ``tid, share``); u none. Ties go to the larger overlap, then the smallest ref.
    """
    lists = [F.transform("exons", lambda e: e["start"]).alias("starts"), F.transform("exons", lambda e: e["end"]).alias("ends")]
    q = query.select("tid", "chrom", "strand", *lists, "start", "end")
    r = reference.select(F.col("tid").alias("ref"), "chrom", "strand", *lists, F.col("start").alias("start2"), F.col("end").alias("end2"))
    # where a query on the strand would have to reach back to meet what it runs on from: places and edges once each
    minus = F.col("strand") == "-"
    placed = q.select("tid", "chrom", "strand", F.when(minus, F.col("end")).otherwise(F.col("start")).alias("_at"))
    back = placed.select("chrom", "strand", "_at").distinct().select("*", F.when(minus, F.col("_at") + 1).otherwise(F.col("_at") - RUN_ON).alias("start"), F.when(minus, F.col("_at") + RUN_ON).otherwise(F.col("_at") - 1).alias("end"))
    ends = r.groupBy("chrom", "strand", F.when(minus, F.col("start2")).otherwise(F.col("end2")).alias("start2")).agg(F.min("ref").alias("ref")).withColumn("end2", F.col("start2"))
    behind = overlap_join(back, ends, ["chrom", "strand"]).groupBy("chrom", "strand", "_at").agg(F.min("ref").alias("ref"))
    rank = lambda code: F.lit(RANK.index(code) + 1).cast("long").alias("rank")
    none = F.lit(0).cast("long").alias("ov")
    pairs = _closest(q, r).unionByName(placed.join(behind, ["chrom", "strand", "_at"]).select("tid", rank("p"), none, "ref"))
    if masked is not None:
        pairs = pairs.unionByName(masked.where(F.col("share") >= MASKED).select("tid", rank("r"), none, F.lit(None).cast(r.schema["ref"].dataType).alias("ref")))
    best = pairs.groupBy("tid").agg(F.min(F.struct("rank", F.negative("ov").alias("o"), "ref")).alias("b"))
    code = F.substring(F.lit(RANK), F.col("b.rank").cast("int"), F.lit(1))
    return query.select("tid").join(best, "tid", "left").select("tid", F.coalesce(code, F.lit("u")).alias("code"), F.col("b.ref").alias("ref"))


def _closest(q: DataFrame, r: DataFrame) -> DataFrame:
    """``tid, rank, ov, ref``: the closest reference that each query overlaps, of each cell of places that it reaches.

    Transcripts of a cell are dealt to parts of at most some ``codes.GROUP`` a
    side, and a group is a part of the queries with one of the references, so a
    place that many share is a grid of groups. No row is made for a pair.
    """
    cell = ["chrom", "_kind", "_bin"]
    a, b = deal(q, r)
    parts = lambda df, name: df.groupBy(*cell).agg(F.ceil(F.count(F.lit(1)) / codes.GROUP).alias(name))
    sizes = materialize(parts(a, "_q").join(parts(b, "_r"), cell), "cells")
    every = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
    a = a.join(sizes, cell).select(*cell, F.pmod(F.xxhash64("tid"), "_q").alias("_i"), every("_r").alias("_j"), "tid", "strand", "starts", "ends")
    b = b.join(sizes, cell).select(*cell, every("_q").alias("_i"), F.pmod(F.xxhash64("ref"), "_r").alias("_j"), "ref", "strand", "starts", "ends")

    def one(left: pa.Table, right: pa.Table) -> pa.Table:
        if not (left.num_rows and right.num_rows):
            return pa.table({"tid": left["tid"][:0], "rank": pa.array([], pa.int64()), "ov": pa.array([], pa.int64()), "ref": right["ref"][:0]})
        tid, rank, ov, ref = codes.closest(left, right.rename_columns([c.removesuffix("2") for c in right.column_names]), RANK, EDGE, INTO_INTRON, OVERHANG)
        return pa.table({"tid": tid, "rank": rank, "ov": ov, "ref": ref})

    keys = [*cell, "_i", "_j"]
    # both may come from one table: their columns are told apart by name
    b = b.toDF(*[c if c == "ref" else f"{c}2" for c in b.columns])
    return a.groupBy(*keys).cogroup(b.groupBy(*[f"{k}2" for k in keys])).applyInArrow(one, f"tid {dict(q.dtypes)['tid']}, rank long, ov long, ref {dict(r.dtypes)['ref']}")


def loci(t: DataFrame) -> DataFrame:
    """``tid, locus``: transcripts on one strand whose exons overlap, transitively; the locus is the smallest tid."""
    e = t.select("tid", "chrom", "strand", F.explode("exons").alias("e")).select(F.col("tid").alias("id"), "chrom", "strand", F.col("e.start").alias("start"), F.col("e.end").alias("end"))
    # exons that overlap are islands; each transcript hangs below the first of every island that it touches
    n = number_islands(e, 0, ["chrom", "strand"]).select("id", "chrom", "strand", "island").distinct()
    head = n.groupBy("chrom", "strand", "island").agg(F.min("id").alias("head"))
    edges = n.join(head, ["chrom", "strand", "island"]).where("id <> head").select(F.col("id").alias("src"), F.col("head").alias("dst")).distinct()
    found = connected_components(materialize(edges, "loci"))
    return t.select("tid").join(found.withColumnRenamed("node", "tid"), "tid", "left").select("tid", F.coalesce("component", "tid").alias("locus"))


def collapse(t: DataFrame) -> DataFrame:
    """Transcripts with equal intron chains on one strand: the longest stays (smallest tid of ties). Single exons stay."""
    c = t.withColumn("chain", chain(F.col("exons"))).withColumn("len", length(F.col("exons")))
    many = c.where("chain <> ''").groupBy("chrom", "strand", "chain").agg(F.max(F.struct("len", (-F.col("tid")).alias("t"))).alias("b"), F.count(F.lit(1)).alias("n"))
    return many.select((-F.col("b.t")).alias("tid"), "n").unionByName(c.where("chain = ''").select("tid", F.lit(1).cast("long").alias("n")))


#: Levels of ``sensitivity``.
LEVELS = ("base", "exon", "intron", "chain", "transcript", "locus")


def _items(t: DataFrame, levels: Sequence[str]) -> DataFrame:
    """``level, chrom, strand, x``: what each transcript shows at the levels that compare by equality."""
    c = t.withColumn("_chain", chain(F.col("exons")))
    text = lambda x: F.concat_ws("-", x["start"].cast("string"), x["end"].cast("string"))
    pair = lambda level, x: F.struct(F.lit(level).alias("level"), x.alias("x"))
    multi = F.col("_chain") != ""
    none = F.array().cast("array<struct<level:string,x:string>>")
    parts = {
        "exon": F.transform("exons", lambda e: pair("exon", text(e))),
        "intron": F.transform(introns(F.col("exons")), lambda e: pair("intron", text(e))),
        "chain": F.when(multi, F.array(pair("chain", F.col("_chain")))).otherwise(none),
        "transcript": F.array(pair("transcript", F.array_join(F.transform("exons", text), ","))),
    }
    return c.select("chrom", "strand", F.explode(F.concat(*[parts[x] for x in levels])).alias("i")).select("i.level", "chrom", "strand", "i.x")


def sensitivity(query: DataFrame, reference: DataFrame, levels: Sequence[str] = LEVELS) -> DataFrame:
    """One row per level: matched, of the reference, of the query, and both rates in percent.

    Bases; distinct exons, introns, intron chains and whole transcripts that are
    equal; and loci (of both sets together) in which a chain or a single-exon
    transcript is equal. Levels without anything have no row.
    """
    rows = None
    equal = [x for x in levels if x in ("exon", "intron", "chain", "transcript")]
    if equal:
        side = lambda t, q: _items(t, equal).withColumn("q", F.lit(q)).withColumn("r", F.lit(1 - q))
        both = side(query, 1).unionByName(side(reference, 0)).groupBy("level", "chrom", "strand", "x").agg(F.max("q").alias("q"), F.max("r").alias("r"))
        rows = both.groupBy("level").agg(F.sum(F.col("q") * F.col("r")).alias("matched"), F.sum("r").alias("reference"), F.sum("q").alias("query"))
    if "locus" in levels:
        side = lambda t, q: t.select("tid", "chrom", "strand", "exons", F.lit(q).alias("q"))
        every = side(query, 1).unionByName(side(reference, 0))
        found = loci(every.select("tid", "chrom", "strand", "exons")).distinct()
        what = F.when(F.size("exons") > 1, chain(F.col("exons"))).otherwise(F.to_json("exons"))
        met = every.join(found, "tid").groupBy("locus", what.alias("x")).agg(F.max("q").alias("q"), F.max(1 - F.col("q")).alias("r"))
        met = met.groupBy("locus").agg(F.max(F.col("q") * F.col("r")).alias("m"), F.max("q").alias("q"), F.max("r").alias("r"))
        row = met.agg(F.sum("m").alias("matched"), F.sum("r").alias("reference"), F.sum("q").alias("query")).select(F.lit("locus").alias("level"), "matched", "reference", "query").where("matched is not null")
        rows = row if rows is None else rows.unionByName(row)
    if "base" in levels:
        flat = lambda t: materialize(islands(t.select("tid", "chrom", "strand", F.explode("exons").alias("e")).select(F.col("tid").alias("id"), "chrom", "strand", F.col("e.start").alias("start"), F.col("e.end").alias("end")), 0, ["chrom", "strand"]), "flat")
        a, b = flat(query), flat(reference)
        size = lambda x: x.agg(F.coalesce(F.sum(F.col("end") - F.col("start") + 1), F.lit(0)).alias("n"))
        met = overlap_join(a, b.select("chrom", "strand", F.col("start").alias("start2"), F.col("end").alias("end2")), ["chrom", "strand"])
        shared = met.agg(F.coalesce(F.sum(F.least("end", "end2") - F.greatest("start", "start2") + 1), F.lit(0)).alias("matched"))
        base = shared.crossJoin(size(b).withColumnRenamed("n", "reference")).crossJoin(size(a).withColumnRenamed("n", "query")).select(F.lit("base").alias("level"), "matched", "reference", "query")
        rows = base if rows is None else rows.unionByName(base)
    rate = lambda of: F.least(F.lit(100.0), F.when(F.col(of) > 0, 100.0 * F.col("matched") / F.col(of)).otherwise(0.0))
    return rows.select("level", "matched", "reference", "query", rate("reference").alias("sensitivity"), rate("query").alias("precision"))
