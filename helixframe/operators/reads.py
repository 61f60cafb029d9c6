"""Reads and alignments: flags, duplicates, trimming, collapse, masking."""

from __future__ import annotations

from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from helixframe.functions import seq

# The flag bits of alignments.
PAIRED, PROPER, UNMAPPED, MATE_UNMAPPED, REVERSE, MATE_REVERSE, READ1, READ2, SECONDARY, FAILED, DUPLICATE = (1 << k for k in range(11))


def has(flag: Column, bit: int) -> Column:
    return flag.bitwiseAND(F.lit(bit)) != 0


def flagstat(df: DataFrame) -> DataFrame:
    """Counts of alignments ``flag, hit, mate_hit, mapq``, one row for those that passed quality control and one for those that failed.

    All counts of mates are of paired alignments only. ``elsewhere``: both
    mapped, to different references; ``elsewhere_sure``: those of mapping
    quality 5 or more.
    """
    f = F.col("flag")
    n = lambda c: F.sum(F.when(c, 1).otherwise(0))
    paired, mapped = has(f, PAIRED), ~has(f, UNMAPPED)
    both = paired & mapped & ~has(f, MATE_UNMAPPED)
    elsewhere = both & ~F.col("hit").eqNullSafe(F.col("mate_hit"))
    return df.groupBy(has(f, FAILED).alias("failed")).agg(
        F.count(F.lit(1)).alias("total"), n(has(f, DUPLICATE)).alias("duplicates"), n(mapped).alias("mapped"), n(paired).alias("paired"), n(paired & has(f, READ1)).alias("read1"), n(paired & has(f, READ2)).alias("read2"),
        n(paired & has(f, PROPER)).alias("proper"), n(both).alias("both_mapped"), n(paired & mapped & has(f, MATE_UNMAPPED)).alias("singletons"), n(elsewhere).alias("elsewhere"), n(elsewhere & (F.col("mapq") >= 5)).alias("elsewhere_sure"),
    )


def sam_filter(df: DataFrame, least_mapq: int = 0, required: int = 0, excluded: int = 0) -> DataFrame:
    f = F.col("flag")
    return df.where((F.col("mapq") >= least_mapq) & (f.bitwiseAND(F.lit(required)) == required) & (f.bitwiseAND(F.lit(excluded)) == 0))


def subsample(df: DataFrame, name: str, fraction: float, seed: int = 0) -> DataFrame:
    """The same reads of a name every time: its hash (``seq.x31``) and the seed, modulo 1024, against the fraction."""
    return df.where(F.pmod(seq.x31(F.col(name)) + F.lit(seed), F.lit(1024)) / 1024.0 < fraction)


def remove_duplicates(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The alignment with the largest quality of each position key (smallest id of ties), and how many there were."""
    best = df.groupBy(*keys).agg(F.max(F.struct("quality", (-F.col("id")).alias("i"))).alias("b"), F.count(F.lit(1)).alias("n"))
    return best.select(*keys, (-F.col("b.i")).alias("id"), "n")


def mate_pairs(df: DataFrame) -> DataFrame:
    """``qname`` with both mates' rows in one: an equi-join of first and second reads on name and hit."""
    first, second = df.where(has(F.col("flag"), READ1)), df.where(has(F.col("flag"), READ2))
    rest = [c for c in df.columns if c not in ("qname", "hit")]
    return first.select("qname", "hit", *[F.col(c).alias(f"{c}1") for c in rest]).join(second.select("qname", "hit", *[F.col(c).alias(f"{c}2") for c in rest]), ["qname", "hit"])


def to_fastq(df: DataFrame) -> DataFrame:
    """Alignments as reads again: /1 and /2 from the flag, reverse strand turned back."""
    f = F.col("flag")
    end = F.when(has(f, READ1), "/1").when(has(f, READ2), "/2").otherwise("")
    turned = has(f, REVERSE)
    return df.select(F.concat("qname", end).alias("id"), F.when(turned, seq.reverse_complement(F.col("seq"))).otherwise(F.col("seq")).alias("seq"), F.when(turned, F.reverse("qual")).otherwise(F.col("qual")).alias("qual"))


# ---------------------------------------------------------------- trimming, one read at a time


def quality_cut(quals: Sequence[int], least: float, window: int = 6) -> int:
    """Bases to keep at the 3' end: up to the first window whose mean is too low, and there up to its first low base."""
    n = len(quals)
    if n == 0:
        return 0
    w = min(window, n)
    total = sum(quals[:w])
    for i in range(n - w + 1):
        if i:
            total += quals[i + w - 1] - quals[i - 1]
        if total < least * w:
            at = i
            while at < n and quals[at] >= least:
                at += 1
            return at
    return n


def n_trim(s: str, percent: float = 10.0) -> tuple[int, int]:
    """Ends to keep: an N near an end, within percent of what is left (1 to 20 bases), takes the bases beyond it along, again and again."""
    lo, hi = 0, len(s)
    while lo < hi:
        reach = max(1, min(20, round(percent * (hi - lo) / 100)))
        left = next((k for k in range(min(hi, lo + reach) - 1, lo - 1, -1) if s[k] in "Nn"), -1)
        right = next((k for k in range(max(lo, hi - reach), hi) if s[k] in "Nn"), -1)
        if left < 0 and right < 0:
            break
        if left >= 0:
            lo = left + 1
        if right >= lo:
            hi = right
    return lo, max(lo, hi)


def poly_tail(s: str, base: str = "A", seed: int = 4, within: int = 16, match: int = 2, mismatch: int = -3, drop: int = 7, least: int = 12) -> int:
    """Where a tail of ``base`` starts at the 3' end (the length if there is none): a seed near the end, extended to both sides."""
    n = len(s)
    at = s.upper().rfind(base * seed, max(0, n - within), n)
    if at < 0:
        return n
    up = s.upper()

    def extend(positions):
        best = score = reach = 0
        for k, p in enumerate(positions, 1):
            score += match if up[p] == base else mismatch
            if score > best:
                best, reach = score, k
            elif best - score > drop:
                break
        return best, reach

    left, back = extend(range(at - 1, -1, -1))
    right, _ = extend(range(at + seed, n))
    return at - back if seed * match + left + right >= least else n


def adapter_start(s: str, adapter: str, seed: int = 6, least: int = 8, match: int = 2, mismatch: int = -3) -> int:
    """Where the adapter starts (the length if it is not found): seeds vote for a diagonal, the best one's ungapped score decides."""
    s, adapter = s.upper(), adapter.upper()
    n, m = len(s), len(adapter)
    if m < seed:
        return n
    place: dict[str, list[int]] = {}
    for j in range(m - seed + 1):
        place.setdefault(adapter[j : j + seed], []).append(j)
    best, found = 0, n
    for d in sorted({i - j for i in range(n - seed + 1) for j in place.get(s[i : i + seed], ())}):
        lo, hi = max(0, d), min(n, d + m)
        score = sum(match if s[k] == adapter[k - d] else mismatch for k in range(lo, hi))
        if score > best:
            best, found = score, lo
    return found if best >= least * match else n


def dust_windows(s: str, level: int = 28, size: int = 64, step: int = 32) -> list[tuple[int, int]]:
    """Low-complexity stretches [start, end): in each window the part whose triplet score 10 * sum / length is highest, if above the level."""
    up, out = s.upper(), []
    n = len(up)
    triplets = [up[i : i + 3] for i in range(max(0, n - 2))]
    for lo in range(0, max(1, n - 2), step):
        own = triplets[lo : min(lo + size - 2, len(triplets))]
        best, where = 0.0, None
        for a in range(len(own)):
            seen: dict[str, int] = {}
            total = 0
            for b in range(a, len(own)):
                t = own[b]
                k = seen.get(t, 0)
                total += k
                seen[t] = k + 1
                if b > a and 10 * total / (b - a) > best:
                    best, where = 10 * total / (b - a), (lo + a, lo + b + 3)
            if len(own) - a < 4:
                break
        if where and best > level:
            out.append(where)
        if lo + size >= n:
            break
    return out


def mask(s: str, stretches: Sequence[tuple[int, int]], to: str | None = "N") -> str:
    """The stretches as N, or in lower case."""
    c = list(s)
    for lo, hi in stretches:
        for k in range(lo, min(hi, len(c))):
            c[k] = to or c[k].lower()
    return "".join(c)


@F.pandas_udf(T.StringType())
def dust_mask(s: pd.Series) -> pd.Series:
    return s.map(lambda x: None if x is None else mask(x, dust_windows(x)))


@F.pandas_udf(T.ArrayType(T.StructType([T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType())])))
def dust_ranges(s: pd.Series) -> pd.Series:
    """Masked ranges (1-based, closed), merged."""

    def ranges(x):
        out: list[list[int]] = []
        for lo, hi in sorted(dust_windows(x or "")):
            if out and lo <= out[-1][1]:
                out[-1][1] = max(out[-1][1], hi)
            else:
                out.append([lo, hi])
        return [{"start": lo + 1, "end": hi} for lo, hi in out]

    return s.map(ranges)


TRIMMED = "start int, end int, ops string, trash string"


def trim_reads(df: DataFrame, least_quality: float = 20, base: int = 33, least_length: int = 16, most_n: float = 5.0, adapters: Sequence[str] = (), dust: bool = False) -> DataFrame:
    """Adds the kept part of each read (``trimmed, trimmed_qual``), what was done (``ops``) and why it is dropped (``trash``).

    In order: Ns at the ends, adapters, poly-A or poly-T, quality from the 3'
    end. Trash codes: s too short, N too many Ns, D low complexity; empty for
    kept reads. A null sequence is too short.
    """

    @F.pandas_udf(TRIMMED)
    def trim(s: pd.Series, q: pd.Series) -> pd.DataFrame:
        rows = []
        for x, y in zip(s, q, strict=True):
            x, y = x or "", y or ""
            ops = []
            lo, hi = n_trim(x)
            if lo:
                ops.append(f"5N{lo}")
            if hi < len(x):
                ops.append(f"3N{len(x) - hi}")
            for a in adapters:
                at = lo + adapter_start(x[lo:hi], a)
                if at < hi:
                    ops.append(f"3V{hi - at}")
                    hi = at
            tails = [lo + poly_tail(x[lo:hi], b) for b in "AT"]
            if min(tails) < hi:
                ops.append(f"3A{hi - min(tails)}")
                hi = min(tails)
            if y:
                keep = lo + quality_cut([ord(c) - base for c in y[lo:hi]], least_quality)
                if keep < hi:
                    ops.append(f"3Q{hi - keep}")
                    hi = keep
            own = x[lo:hi]
            trash = "s" if len(own) < least_length else "N" if own.upper().count("N") * 100 > most_n * len(own) else ""
            if not trash and dust and sum(b - a for a, b in dust_windows(own, 16, 32, 16)) * 2 > len(own):
                trash = "D"
            rows.append((lo, hi, ",".join(ops), trash))
        return pd.DataFrame(rows, columns=["start", "end", "ops", "trash"])

    out = df.withColumn("_t", trim("seq", "qual"))
    part = lambda c: F.substring(c, F.col("_t.start") + 1, F.col("_t.end") - F.col("_t.start"))
    return out.select(*df.columns, part(F.col("seq")).alias("trimmed"), part(F.col("qual")).alias("trimmed_qual"), F.col("_t.ops").alias("ops"), F.col("_t.trash").alias("trash"))


def collapse_reads(df: DataFrame) -> DataFrame:
    """One row per sequence: ``n``, ``id`` of the first read with ``_x<N>``, and the mean quality at each place, rounded down.

    Sums per sequence and place are added up before the shuffle, so a sequence
    with a third of all reads is no task of its own.
    """
    key = F.md5(F.col("seq").cast("binary"))
    rows = df.where("seq is not null").select(key.alias("k"), "seq", "id", "qual")
    one = rows.groupBy("k").agg(F.min("seq").alias("seq"), F.count(F.lit(1)).alias("n"), F.min("id").alias("id"))
    codes = F.transform(F.filter(F.split("qual", ""), lambda c: c != ""), lambda c: F.ascii(c))
    places = rows.select("k", F.posexplode(codes).alias("i", "q")).groupBy("k", "i").agg(F.sum("q").alias("q"), F.count(F.lit(1)).alias("m"))
    mean = places.groupBy("k").agg(F.array_sort(F.collect_list(F.struct("i", F.floor(F.col("q") / F.col("m")).alias("c")))).alias("c"))
    qual = F.array_join(F.transform("c", lambda x: F.char(x["c"])), "")
    return one.join(mean, "k", "left").select("seq", "n", F.concat("id", F.lit("_x"), "n").alias("id"), F.coalesce(qual, F.lit("")).alias("qual"))


def pileup(df: DataFrame) -> DataFrame:
    """Bases by position from ``chrom, pos, cigar, seq``: ``chrom, pos, base, n``."""
    walked = seq.aligned_blocks(F.col("pos"), F.col("cigar"))
    block = df.select("chrom", "seq", F.explode(walked).alias("b"))
    at = block.select("chrom", "seq", "b", F.explode(F.sequence(F.lit(0), F.col("b.n") - 1)).alias("i"))
    base = F.substring(F.col("seq"), F.col("b.q") + F.col("i"), F.lit(1))
    return at.select("chrom", (F.col("b.r") + F.col("i")).alias("pos"), base.alias("base")).groupBy("chrom", "pos", "base").agg(F.count(F.lit(1)).alias("n"))


def consensus(counts: DataFrame) -> DataFrame:
    """The commonest base of each position; on a tie, what is no gap and no N, then the first in order A C G T."""
    order = F.when(F.col("base").isin("-", "N"), 1).otherwise(0)
    top = counts.groupBy("chrom", "pos").agg(F.min(F.struct((-F.col("n")).alias("m"), order.alias("o"), "base")).alias("t"), F.sum("n").alias("depth"))
    return top.select("chrom", "pos", F.col("t.base").alias("base"), "depth")
