"""Likelihoods from base qualities beside plain loops over single bases."""

import math
import random

import pytest
from helixframe.operators import genotypes


def tail(q, n, k):
    e = 10 ** (-q / 10)
    p = [math.comb(n, j) * e**j * (1 - e) ** (n - j) for j in range(n + 1)]
    return -10 * math.log10(math.fsum(p[k + 1 :]) / math.fsum(p[k:]))


def plain(bases):
    """bases: (quality, reverse, letter), one each."""
    n = len(bases)
    seen, strand, told = dict.fromkeys("ACGT", 0), {}, dict.fromkeys("ACGT", 0.0)
    for q, rev, b in sorted(bases, key=lambda x: (-x[0], not x[1], -"ACGT".index(x[2]))):
        w = strand.get((rev, b), 0)
        told[b] += (0.83**w * 0.97 + 0.03) * tail(q, n, seen[b])
        seen[b] += 1
        strand[rev, b] = w + 1
    out = []
    for g in genotypes.GENOTYPES:
        v = sum(x for b, x in told.items() if b not in g)
        if g[0] != g[1]:
            m = seen[g[0]] + seen[g[1]]
            v -= 4.343 * (math.log(math.comb(m, seen[g[1]])) - m * math.log(2))
        out.append(max(0.0, v))
    return out


@pytest.mark.parametrize("seed", range(20))
def test_likelihoods(seed):
    rnd = random.Random(seed)
    bases = [(rnd.randrange(4, 42), rnd.random() < 0.5, rnd.choice("AAAAC" if seed % 2 else "ACGT")) for _ in range(rnd.randrange(1, 40))]
    counted = {}
    for x in bases:
        counted[x] = counted.get(x, 0) + 1
    got = genotypes.likelihoods([(*x, n) for x, n in counted.items()])
    assert all(abs(a - b) < 1e-6 for a, b in zip(got, plain(bases), strict=True))


def test_calls(spark):
    """A planted heterozygous site among homozygous ones; low qualities, other letters and gaps take no part."""
    reads = [("c", 101, "10M", "ACGTACGTAC" if k % 2 else "ACGTGCGTAC", "I" * 10, 60, 16 * (k % 3 == 0)) for k in range(20)]
    reads += [("c", 101, "2S4M1D2M1I1M", "NNACGTCGTAC"[:10], "II#IIIIIII", 60, 0), ("c", 101, "10M", "NNNNNNNNNN", "I" * 10, 60, 0), ("c", 101, "10M", "TTTTTTTTTT", "#" * 10, 60, 0), ("d", 5, "3M", "GGG", "III", 2, 0)]
    df = spark.createDataFrame(reads, "chrom string, pos long, cigar string, seq string, qual string, mapq int, flag int")
    rows = genotypes.quality_bases(df)
    assert rows.where("chrom = 'd'").select("q", "n").distinct().collect() == [(4, 1)]
    got = {(r.chrom, r.pos): r for r in genotypes.call_genotypes(rows).collect()}
    assert got["c", 105].genotype == "AG" and got["c", 105].quality > 20
    assert [got["c", p].genotype for p in (101, 102, 103, 104, 106)] == ["AA", "CC", "GG", "TT", "CC"]
    assert got["c", 101].depth == 20 and len(got["c", 101].likelihoods) == 10
    assert genotypes.call_genotypes(rows.limit(0)).collect() == []
