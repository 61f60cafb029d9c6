"""Sequence functions on string columns, in whole-stage code where Spark has the parts.

``substring`` walks from the start of a string, so what goes along a whole
sequence uses one regular expression or one pass in Arrow batches instead.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The IUPAC codes, masked bases (X), gaps, and their complements.
IUPAC = "ACGTUMRWSYKVHDBNXacgtumrwsykvhdbnx*-"
COMPLEMENT = "TGCAAKYWSRMBDHVNXtgcaakywsrmbdhvnx*-"

BASES = "TCAG"
# The standard genetic code in TCAG order; a stop is a dot.
AMINO = "FFLLSSSSYY..CC.WLLLLPPPPHHQQRRRRIIIMTTTTNNKKSSRRVVVVAAAADDEEGGGG"
# The bases that each IUPAC code stands for.
AMBIGUOUS = {"A": "A", "C": "C", "G": "G", "T": "T", "U": "T", "M": "AC", "R": "AG", "W": "AT", "S": "CG", "Y": "CT", "K": "GT", "V": "ACG", "H": "ACT", "D": "AGT", "B": "CGT", "N": "ACGT"}


def codon_table() -> dict[str, str]:
    """All IUPAC codons that stand for one amino acid."""
    plain = {a + b + c: AMINO[16 * i + 4 * j + k] for i, a in enumerate(BASES) for j, b in enumerate(BASES) for k, c in enumerate(BASES)}
    out = {}
    for x, xs in AMBIGUOUS.items():
        for y, ys in AMBIGUOUS.items():
            for z, zs in AMBIGUOUS.items():
                acids = {plain[a + b + c] for a in xs for b in ys for c in zs}
                if len(acids) == 1:
                    out[x + y + z] = acids.pop()
    return out


def complement(s: Column) -> Column:
    """Base by base; masked bases and gaps stay, and what is no IUPAC code becomes N."""
    return F.translate(F.regexp_replace(s, f"[^{IUPAC}]", "N"), IUPAC, COMPLEMENT)


def reverse_complement(s: Column) -> Column:
    return F.reverse(complement(s))


def kmers(s: Column, k: int) -> Column:
    """All substrings of length k, in order; none for shorter strings."""
    return F.regexp_extract_all(s, F.lit(f"(?s)(?=(.{{{k}}}))"), 1)


#: Longest k-mers that are counted as numbers, and codes that are counted at once.
LONGEST_KMER, KMER_BLOCK = 15, 1 << 22


def _kmer_codes(joined: str, k: int) -> np.ndarray:
    """Base-4 numbers of the k-mers over A C G T; those with other characters are left out."""
    table = np.full(256, 4, np.uint8)
    for i, c in enumerate("ACGT"):
        table[ord(c)] = table[ord(c.lower())] = i
    base = table[np.frombuffer(joined.encode("ascii", "replace"), np.uint8)]
    n = len(base) - k + 1
    if n <= 0:
        return np.empty(0, np.int64)
    code = np.zeros(n, np.int64)
    for i in range(k):
        code = code * 4 + base[i : i + n]
    bad = np.cumsum(np.concatenate([[0], base == 4]))
    return code[bad[k:] == bad[:-k]]


def kmer_counts(df: DataFrame, column: str, k: int) -> DataFrame:
    """``kmer, n`` over all sequences of a column, k-mers of A C G T in upper case only.

    Workers count the base-4 numbers of their k-mers, so what is shuffled is a
    row per distinct k-mer and batch. k is at most ``LONGEST_KMER``.
    """
    if not 1 <= k <= LONGEST_KMER:
        raise ValueError(f"k must be 1 to {LONGEST_KMER}")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out(parts: list[np.ndarray]) -> pa.RecordBatch:
            code, n = np.unique(np.concatenate(parts), return_counts=True)
            return pa.RecordBatch.from_arrays([pa.array(code), pa.array(n.astype(np.int64))], ["code", "n"])

        parts, size = [], 0
        for b in batches:
            for s in b.column(0):
                own = s.as_py() or ""
                # neighbouring parts of a long sequence share k - 1 bases
                for lo in range(0, max(1, len(own) - k + 1), KMER_BLOCK):
                    parts.append(_kmer_codes(own[lo : lo + KMER_BLOCK + k - 1], k))
                    size += len(parts[-1])
                    if size >= KMER_BLOCK:
                        yield out(parts)
                        parts, size = [], 0
        if parts:
            yield out(parts)

    coded = df.select(F.col(column).cast("string").alias("s")).mapInArrow(count, "code long, n long").groupBy("code").agg(F.sum("n").alias("n"))
    kmer = F.translate(F.lpad(F.conv(F.col("code").cast("string"), 10, 4), k, "0"), "0123", "ACGT")
    return coded.select(kmer.alias("kmer"), "n")


def codons_of(s: Column) -> Column:
    """The triplets of a string from its start; an incomplete last one is left out."""
    return F.regexp_extract_all(s, F.lit("(?s)(...)"), 1)


@lru_cache(maxsize=1)
def _acids() -> tuple[np.ndarray, np.ndarray]:
    """Number of each byte among the IUPAC codes (others are the last), and the acid of each triple of numbers."""
    codes = sorted(AMBIGUOUS)
    number = np.full(256, len(codes), np.int64)
    for i, c in enumerate(codes):
        number[ord(c)] = number[ord(c.lower())] = i
    acid = np.full((len(codes) + 1,) * 3, ord("X"), np.uint8)
    for codon, a in codon_table().items():
        acid[tuple(codes.index(c) for c in codon)] = ord(a)
    return number, acid.ravel()


def protein_of(s: str, frame: int = 0) -> str:
    number, acid = _acids()
    base = number[np.frombuffer(s.encode("latin-1", "replace"), np.uint8)[frame:]]
    n, size = len(base) // 3, len(AMBIGUOUS) + 1
    triple = base[: 3 * n].reshape(n, 3)
    return acid[(triple[:, 0] * size + triple[:, 1]) * size + triple[:, 2]].tobytes().decode("latin-1")


def translate(s: Column, frame: int = 0) -> Column:
    """Protein of a frame (0 to 2); unknown codons are X, stops are dots, an incomplete last codon is left out."""

    @F.pandas_udf("string")
    def protein(own: pd.Series) -> pd.Series:
        return own.map(lambda x: None if x is None else protein_of(x, frame))

    return protein(s)


def six_frames(s: Column) -> Column:
    """The proteins of frames +1 +2 +3 -1 -2 -3."""
    return F.array(*[translate(x, f) for x in (s, reverse_complement(s)) for f in range(3)])


def longest_orf(protein: Column) -> Column:
    """The longest stretch from an M to a stop or the end."""
    found = F.regexp_extract_all(protein, F.lit(r"(M[^.]*)"), 1)
    return F.coalesce(F.aggregate(found, F.lit(""), lambda a, x: F.when(F.length(x) > F.length(a), x).otherwise(a)), F.lit(""))


def runs(s: Column, base: str, least: int) -> Column:
    """(start, length) of the runs of at least so many of a character, starts from 1."""
    pattern = re.compile(f"{re.escape(base)}{{{least},}}")

    @F.pandas_udf("array<struct<start:int,length:int>>")
    def found(own: pd.Series) -> pd.Series:
        return own.map(lambda x: [{"start": m.start() + 1, "length": m.end() - m.start()} for m in pattern.finditer(x or "")])

    return found(s)


def splice(genome: Column, exons: Column, strand: Column, offset: Column | None = None) -> Column:
    """The exons' bases joined in order, reverse-complemented on the minus strand."""
    from_ = F.lit(0) if offset is None else offset
    joined = F.array_join(F.transform(F.array_sort(exons), lambda e: F.substring(genome, (e["start"] - from_).cast("int"), (e["end"] - e["start"] + 1).cast("int"))), "")
    return F.when(strand == "-", reverse_complement(joined)).otherwise(joined)


def canonical_splice(donor: Column, acceptor: Column) -> Column:
    """GT-AG, GC-AG or AT-AC, given in the direction of the transcript."""
    pair = F.concat_ws("-", F.upper(donor), F.upper(acceptor))
    return pair.isin("GT-AG", "GC-AG", "AT-AC")


def clean(s: Column) -> Column:
    """U to T, upper case, letters only, no N at the ends."""
    t = F.regexp_replace(F.upper(F.translate(s, "Uu", "Tt")), "[^A-Z]", "")
    return F.regexp_replace(t, "^N+|N+$", "")


def phred_shift(qual: Column, by: int) -> Column:
    """Every quality character moved (31 or -31 between the two encodings)."""
    return F.array_join(F.transform(F.split(qual, ""), lambda c: F.when(c == "", "").otherwise(F.char(F.ascii(c) + by))), "")


def phred_base(low: Column, high: Column) -> Column:
    """33 or 64 from the smallest and largest code; null if neither fits."""
    return F.when(low < 64, 33).when(high > 95, 64)


def percent_decode(s: Column) -> Column:
    """%xx of printable ASCII characters decoded, a semicolon as a dot, since it would part attributes.

    Blanks, control characters, bytes beyond ASCII and bad escapes stay as they are.
    """
    parts = F.regexp_extract_all(s, F.lit("(%[0-9A-Fa-f]{2}|[^%]+|%)"), 1)

    def plain(x: Column) -> Column:
        code = F.conv(F.substring(x, 2, 2), 16, 10).cast("int")
        return F.when(x.rlike("^%[0-9A-Fa-f]{2}$") & code.between(33, 127), F.when(code == 59, ".").otherwise(F.char(code))).otherwise(x)

    return F.array_join(F.transform(parts, plain), "")


def cigar_ops(cigar: Column) -> Column:
    """array of (length, op)."""
    return F.transform(F.regexp_extract_all(cigar, F.lit(r"([0-9]+[MIDNSHP=X])"), 1), lambda x: F.struct(F.regexp_extract(x, "^[0-9]+", 0).cast("int").alias("n"), F.substring(x, -1, 1).alias("op")))


def cigar_query_length(cigar: Column) -> Column:
    return F.aggregate(cigar_ops(cigar), F.lit(0), lambda a, x: a + F.when(x["op"].isin("M", "I", "S", "=", "X"), x["n"]).otherwise(0))


def cigar_reference_length(cigar: Column) -> Column:
    return F.aggregate(cigar_ops(cigar), F.lit(0), lambda a, x: a + F.when(x["op"].isin("M", "D", "N", "=", "X"), x["n"]).otherwise(0))


def cigar_blocks(pos: Column, cigar: Column) -> Column:
    """Exon blocks (start, end) of an alignment: cut at N; insertions and clips take no reference."""
    start = F.struct(pos.cast("long").alias("at"), pos.cast("long").alias("from"), F.array().cast("array<struct<start:bigint,end:bigint>>").alias("out"))
    closed = lambda a: F.concat(a["out"], F.when(a["at"] > a["from"], F.array(F.struct(a["from"].alias("start"), (a["at"] - 1).alias("end")))).otherwise(F.array().cast("array<struct<start:bigint,end:bigint>>")))
    walked = F.aggregate(
        cigar_ops(cigar),
        start,
        lambda a, x: F.when(x["op"] == "N", F.struct((a["at"] + x["n"]).alias("at"), (a["at"] + x["n"]).alias("from"), closed(a).alias("out")))
        .when(x["op"].isin("M", "D", "=", "X"), F.struct((a["at"] + x["n"]).alias("at"), a["from"].alias("from"), a["out"].alias("out")))
        .otherwise(a),
        lambda a: closed(a),
    )
    return walked


def aligned_blocks(pos: Column, cigar: Column) -> Column:
    """Stretches without gaps: array of (r, q, n), first position, first base of the read from 1, and length."""
    start = F.struct(pos.cast("long").alias("r"), F.lit(1).alias("q"), F.array().cast("array<struct<r:bigint,q:int,n:int>>").alias("out"))
    return F.aggregate(
        cigar_ops(cigar),
        start,
        lambda a, x: F.when(x["op"].isin("M", "=", "X"), F.struct((a["r"] + x["n"]).alias("r"), (a["q"] + x["n"]).alias("q"), F.concat(a["out"], F.array(F.struct(a["r"].alias("r"), a["q"].alias("q"), x["n"].alias("n")))).alias("out")))
        .when(x["op"].isin("I", "S"), F.struct(a["r"].alias("r"), (a["q"] + x["n"]).alias("q"), a["out"].alias("out")))
        .when(x["op"].isin("D", "N"), F.struct((a["r"] + x["n"]).alias("r"), a["q"].alias("q"), a["out"].alias("out")))
        .otherwise(a),
        lambda a: a["out"],
    )


def x31(s: Column) -> Column:
    """The hash h = 31 h + c over the code points, modulo 2^32."""
    return F.aggregate(F.filter(F.split(s, ""), lambda c: c != ""), F.lit(0).cast("long"), lambda h, c: (h * 31 + F.ascii(c)) % F.lit(1 << 32))


def pack_bases(s: Column) -> Column:
    """Four bases a byte, two bits each (A 0, C 1, G 2, T 3; others count as A), zero bits at the end; as binary."""
    digits = F.translate(F.regexp_replace(F.upper(s), "[^ACGT]", "A"), "ACGT", "0123")
    fours = F.regexp_extract_all(digits, F.lit("(.{1,4})"), 1)
    return F.unhex(F.array_join(F.transform(fours, lambda x: F.lpad(F.conv(F.rpad(x, 4, "0"), 4, 16), 2, "0")), ""))


def end_difference(a: Column, b: Column) -> Column:
    """How much of the longer string is left between the ends that both have in common."""
    least = F.least(F.length(a), F.length(b))

    def same(x: Column, y: Column) -> Column:
        pairs = F.zip_with(F.filter(F.split(x, ""), lambda c: c != ""), F.filter(F.split(y, ""), lambda c: c != ""), lambda p, q: p.eqNullSafe(q))
        return F.when(F.array_position(pairs, False) > 0, F.array_position(pairs, False) - 1).otherwise(F.size(pairs))

    head = same(a, b)
    tail = F.least(same(F.reverse(a), F.reverse(b)), least - F.least(head, least))
    return F.greatest(F.length(a), F.length(b)) - F.least(head, least) - tail


def region(text: Column) -> Column:
    """``chrom:start-end`` (thousands separators allowed, end or both may be missing) as a struct."""
    plain = F.replace(text, F.lit(","), F.lit(""))
    part = lambda i: F.regexp_extract(plain, r"^(.*?)(?::(\d+)(?:-(\d+))?)?$", i)
    return F.struct(part(1).alias("chrom"), part(2).try_cast("long").alias("start"), part(3).try_cast("long").alias("end"))


def mask_repeats(s: Column, mono: int = 6, unit: int = 2, times: int = 4) -> Column:
    """Runs of at least ``mono`` equal letters, and of a unit of ``unit`` or more repeated over ``times`` times, as N."""
    pattern = re.compile(rf"(?i)([a-z])\1{{{mono - 1},}}|([a-z]{{{unit},12}}?)\2{{{times},}}")

    @F.pandas_udf("string")
    def masked(own: pd.Series) -> pd.Series:
        return own.map(lambda x: None if x is None else pattern.sub(lambda m: "N" * len(m[0]), x))

    return masked(s)
