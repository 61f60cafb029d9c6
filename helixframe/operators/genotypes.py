"""Genotypes from base qualities: errors at one position depend on one another, so each further one of a kind tells less."""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from helixframe.functions import seq
from helixframe.operators.reads import REVERSE, has

BASES = "ACGT"
GENOTYPES = [a + b for i, a in enumerate(BASES) for b in BASES[i:]]
#: Dependency of errors of one strand and base, what the least of them still tells, and the range of qualities.
THETA, ETA, LOW, HIGH = 0.83, 0.03, 4, 63
#: Fixed value: ten by the logarithm of ten, as it is used for the heterozygous likelihoods.
PHRED = 4.343


def quality_bases(df: DataFrame, least_quality: int = 13) -> DataFrame:
    """``chrom, pos, base, q, reverse, n``: aligned bases by position, quality and strand, counted.

    ``df``: ``chrom, pos, cigar, seq, qual`` (Phred 33), ``mapq, flag``. The
    quality is the lower one of base and mapping, held within ``LOW`` and
    ``HIGH``; bases under ``least_quality`` or other than A, C, G, T go. A
    position has at most 480 rows, however deep it is.
    """
    blocks = seq.aligned_blocks(F.col("pos"), F.col("cigar"))
    block = df.select("chrom", "seq", "qual", "mapq", has(F.col("flag"), REVERSE).alias("reverse"), F.explode(blocks).alias("b"))
    at = block.select("chrom", "seq", "qual", "mapq", "reverse", "b", F.explode(F.sequence(F.lit(0), F.col("b.n") - 1)).alias("i"))
    place = F.col("b.q") + F.col("i")
    own = F.ascii(F.substring(F.col("qual"), place, F.lit(1))) - 33
    rows = at.select("chrom", (F.col("b.r") + F.col("i")).alias("pos"), F.upper(F.substring(F.col("seq"), place, F.lit(1))).alias("base"), own.alias("own"), "mapq", "reverse").where((F.col("own") >= least_quality) & F.col("base").isin(*BASES))
    q = F.greatest(F.lit(LOW), F.least("own", "mapq", F.lit(HIGH))).cast("int")
    return rows.groupBy("chrom", "pos", "base", q.alias("q"), "reverse").agg(F.count(F.lit(1)).alias("n"))


@lru_cache(maxsize=4096)
def tail_scores(q: int, n: int) -> np.ndarray:
    """For k = 0 to n - 1: what a further error tells, in Phred, if k of n bases with error rate 10^(-q/10) are errors already: P(more than k) to P(k or more)."""
    e = 10.0 ** (-q / 10)
    k = np.arange(n + 1)
    log_factorial = np.concatenate([[0.0], np.cumsum(np.log(np.arange(1, n + 1)))])
    term = log_factorial[n] - log_factorial - log_factorial[::-1] + k * math.log(e) + (n - k) * math.log1p(-e)
    tail = np.logaddexp.accumulate(term[::-1])[::-1]
    return -10 / math.log(10) * (tail[1:] - tail[:-1])


def likelihoods(rows: list[tuple[int, bool, str, int]]) -> list[float]:
    """Of the ten genotypes, in Phred (0: likeliest), from counted bases (quality, reverse, base, n) of one position.

    Bases count from the best quality down; of one strand and base the k-th one
    weighs (THETA^k) (1 - ETA) + ETA.
    """
    depth = sum(n for *_, n in rows)
    seen, strand = dict.fromkeys(BASES, 0), {}
    told = dict.fromkeys(BASES, 0.0)
    for q, reverse, base, n in sorted(rows, key=lambda r: (-r[0], not r[1], -BASES.index(r[2]))):
        w, c = strand.get((reverse, base), 0), seen[base]
        weight = THETA ** np.arange(w, w + n) * (1 - ETA) + ETA
        told[base] += float(weight @ tail_scores(q, depth)[c : c + n])
        strand[reverse, base], seen[base] = w + n, c + n
    out = []
    for g in GENOTYPES:
        rest = sum(v for b, v in told.items() if b not in g)
        if g[0] != g[1]:
            n, k = seen[g[0]] + seen[g[1]], seen[g[1]]
            rest -= PHRED * (math.lgamma(n + 1) - math.lgamma(k + 1) - math.lgamma(n - k + 1) - math.log(2) * n)
        out.append(max(0.0, rest))
    return out


def call_genotypes(bases: DataFrame) -> DataFrame:
    """``chrom, pos, depth, genotype, quality, likelihoods``: the likeliest genotype (first of ties in order), its distance to the second, and all ten (``GENOTYPES``).

    ``bases``: ``quality_bases``. A position's rows come together in one array of bounded size.
    """
    at = bases.groupBy("chrom", "pos").agg(F.collect_list(F.struct("q", "reverse", "base", "n")).alias("rows"), F.sum("n").alias("depth"))
    kinds = dict(at.dtypes)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            found = [likelihoods([(int(r["q"]), bool(r["reverse"]), r["base"], int(r["n"])) for r in rows]) for rows in pdf["rows"]]
            best = [int(np.argmin(np.round(x, 7))) for x in found]  # the first of ties
            second = [min(v for i, v in enumerate(x) if i != b) for x, b in zip(found, best, strict=True)]
            yield pd.DataFrame({"chrom": pdf["chrom"], "pos": pdf["pos"], "depth": pdf["depth"], "genotype": [GENOTYPES[b] for b in best], "quality": [s - x[b] for s, x, b in zip(second, found, best, strict=True)], "likelihoods": found})

    return at.mapInPandas(run, f"chrom {kinds['chrom']}, pos {kinds['pos']}, depth long, genotype string, quality double, likelihoods array<double>")
