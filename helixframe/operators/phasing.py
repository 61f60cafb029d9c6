"""Haplotypes from reads over heterozygous sites: local patterns counted by Spark, dynamic programming along each block."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from helixframe.operators.intervals import number_islands
from helixframe.operators.order import number_rows


def site_alleles(calls: DataFrame) -> DataFrame:
    """``chrom, pos, site, block, read, allele`` of calls ``read, chrom, pos, allele`` (0 or 1).

    ``site`` numbers a chromosome's positions in order; a block is a run of
    sites that reads join. Calls that are null or neither 0 nor 1 go, and of a
    read that disagrees with itself at a site all its calls there.
    """
    own = calls.where("read is not null and chrom is not null and pos is not null and allele in (0, 1)")
    own = own.groupBy("read", "chrom", "pos").agg(F.min("allele").alias("allele"), F.max("allele").alias("other")).where("allele = other").drop("other")
    sites = number_rows(own.select("chrom", "pos").distinct(), ["chrom"], ["pos"], "site")
    own = own.join(sites, ["chrom", "pos"])
    spans = own.groupBy("chrom", "read").agg(F.min("site").alias("start"), F.max("site").alias("end"))
    blocks = number_islands(spans.withColumn("id", F.xxhash64("read")), 0, ["chrom"]).select("chrom", "read", F.col("island").alias("block"))
    return own.join(blocks, ["chrom", "read"])


def local_patterns(alleles: DataFrame, width: int) -> DataFrame:
    """``chrom, block, site, mask, bits, n``: how many reads have a pattern over the ``width`` sites that end at a site.

    Bit i stands for the site i before the last; ``mask`` has the sites that
    the read shows, two at least. Counted before anything is gathered.
    """
    reads = alleles.groupBy("chrom", "block", "read").agg(F.sort_array(F.collect_list(F.struct("site", "allele"))).alias("own")).where("size(own) > 1")
    ends = reads.select("chrom", "block", "own", F.explode(F.slice("own", 2, F.size("own") - 1)).alias("last"))
    window = F.filter("own", lambda x: (x["site"] <= F.col("last.site")) & (x["site"] > F.col("last.site") - width))
    place = lambda x: F.pow(F.lit(2.0), F.col("last.site") - x["site"]).cast("long")
    total = lambda of: F.aggregate("window", F.lit(0).cast("long"), lambda a, x: a + place(x) * of(x))
    rows = ends.withColumn("window", window).where("size(window) > 1").select("chrom", "block", F.col("last.site").alias("site"), total(lambda x: F.lit(1)).alias("mask"), total(lambda x: x["allele"]).alias("bits"))
    return rows.groupBy("chrom", "block", "site", "mask", "bits").agg(F.count(F.lit(1)).alias("n"))


def pattern_counts(mask: np.ndarray, bits: np.ndarray, n: np.ndarray, width: int) -> np.ndarray:
    """Reads that agree with each pattern of ``width`` sites; sites that a read does not show agree with either allele."""
    x = np.arange(1 << width)
    out = np.zeros(1 << width, np.int64)
    for m, b, k in zip(mask, bits, n, strict=True):
        out[(x & m) == b] += k
    return out


def best_haplotype(counts: list[np.ndarray], width: int) -> list[int]:
    """One allele for each site of a block, the first 0: the haplotype that, with its complement, most reads agree with locally.

    A state is the last ``width`` - 1 alleles; of ties the site before a state
    has the allele of the state's first site.
    """
    half = 1 << (width - 1)
    full = 2 * half - 1
    score = np.zeros(half, np.int64)
    from_: list[np.ndarray] = []
    x = np.arange(2 * half)
    for k, w in enumerate(counts):
        both = w + w[full - x]
        if k == 0:
            score, back = np.where(np.arange(half) < 2, both[:half], np.iinfo(np.int64).min // 4), np.zeros(half, np.int64)
        else:
            # a state comes from the one that has one more allele before it and one less at its end
            low, high = score[np.arange(half) >> 1], score[(np.arange(half) >> 1) | (half >> 1)]
            a, b = low + both[:half], high + both[half:]
            back = np.where(a == b, np.arange(half) >> (width - 2), b > a).astype(np.int64)
            score = np.maximum(a, b)
        from_.append(back)
    state, out = int(score.argmax()), []
    for back in reversed(from_):
        out.append(state & 1)
        state = (state >> 1) | (int(back[state]) * (half >> 1))
    out.reverse()
    return [h ^ out[0] for h in out] if out else out


def phase(alleles: DataFrame, width: int = 8) -> DataFrame:
    """``chrom, block, site, haplotype``: the allele at each site of one of two haplotypes; the first site of a block has 0.

    A group is the counted patterns of one block.
    """
    if width < 2:
        raise ValueError("patterns take two sites at least")
    patterns = local_patterns(alleles, width)
    sites = alleles.select("chrom", "block", "site").distinct()
    rows = sites.join(patterns, ["chrom", "block", "site"], "left")
    kind = dict(alleles.dtypes)["chrom"]

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        counts, order = [], []
        for site, own in pdf.sort_values("site").groupby("site"):
            own = own.dropna(subset=["n"])
            counts.append(pattern_counts(own["mask"].to_numpy(np.int64), own["bits"].to_numpy(np.int64), own["n"].to_numpy(np.int64), width))
            order.append(site)
        return pd.DataFrame({"chrom": [pdf["chrom"].iloc[0]] * len(order), "block": int(pdf["block"].iloc[0]), "site": order, "haplotype": best_haplotype(counts, width)})

    return rows.groupBy("chrom", "block").applyInPandas(one, f"chrom {kind}, block long, site long, haplotype int")


def assign_reads(alleles: DataFrame, haplotypes: DataFrame) -> DataFrame:
    """``chrom, block, read, phase, agree, differ``: the haplotype (0 or 1) that a read agrees with at more sites; null if at as many."""
    met = alleles.join(haplotypes, ["chrom", "block", "site"])
    same = met.groupBy("chrom", "block", "read").agg(F.sum((F.col("allele") == F.col("haplotype")).cast("int")).alias("zero"), F.sum((F.col("allele") != F.col("haplotype")).cast("int")).alias("one"))
    phase_ = F.when(F.col("zero") > F.col("one"), 0).when(F.col("one") > F.col("zero"), 1)
    return same.select("chrom", "block", "read", phase_.alias("phase"), F.greatest("zero", "one").alias("agree"), F.least("zero", "one").alias("differ"))
