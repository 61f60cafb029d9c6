"""Stretches of a chromosome in a target: a hidden Markov model of two states, cut into bins of positions that are worked on side by side."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from helixframe.operators.intervals import number_islands
from helixframe.storage import materialize

#: Score of each state (outside, inside) at a position that is uncovered, covered, or covered with a sure consensus.
EMISSION = ((0, 0, 0), (-4, 1, 6))
#: Score of going from a state to the next position's.
TRANSITION = ((0, -14000), (0, 0))
BIN = 1 << 16


#: Cells of bins by positions that are worked on at once.
CELLS = 1 << 22


def _steps(kind: np.ndarray, size: np.ndarray, emission: Sequence[Sequence[int]], transition: Sequence[Sequence[int]], f0: np.ndarray, f1: np.ndarray) -> np.ndarray:
    """Moves the scores of both states (``f0, f1``: starts by bins) past the positions of many bins, a position of all of them at a time.

    ``kind``: positions by bins; ``size``: how many of them each bin has, the
    largest first. Returns where each state of a position came from (bit 0:
    state 0, bit 1: state 1). Ties come from 1.
    """
    (p00, p01), (p10, p11) = transition
    e0, e1 = (np.array(e, np.int64) for e in emission)
    back = np.zeros((len(kind), *f0.shape), np.int8)
    there = np.searchsorted(-size, -np.arange(1, len(kind) + 1), side="right")
    for i, n in enumerate(there.tolist()):
        u, v, c = f0[:, :n], f1[:, :n], kind[i, :n]
        a, b, x, y = u + p00, v + p10, u + p01, v + p11
        back[i, :, :n] = (a <= b) | ((x <= y).astype(np.int8) << 1)
        f0[:, :n], f1[:, :n] = np.maximum(a, b) + e0[c], np.maximum(x, y) + e1[c]
    return back


_NEVER = -(1 << 50)


def target_regions(sites: DataFrame, emission: Sequence[Sequence[int]] = EMISSION, transition: Sequence[Sequence[int]] = TRANSITION, bin_size: int = BIN) -> DataFrame:
    """``chrom, start, end``: runs of positions in the target by the best path of states over positions 1 to a chromosome's last row.

    ``sites``: ``chrom, pos, kind``, kind 1 covered, 2 covered with a sure
    consensus; positions without a row are uncovered (0), and of several rows
    the highest kind counts. A path begins in either state, and both ends of a
    tie lie inside.

    1. Each bin of positions gives four scores: the best from either state
       before it to either state at its end. Bins are worked on in batches.
    2. Along a chromosome, one row per bin: the scores of both states before it.
    3. Each bin follows the paths back from both of its last states.
    4. Along a chromosome, backwards, one row per bin and state: which of the
       two holds. Its runs are joined where they touch.
    """
    own = sites.where("chrom is not null and pos >= 1").groupBy("chrom", "pos").agg(F.max("kind").cast("int").alias("kind"))
    own = own.withColumn("bin", F.floor((F.col("pos") - 1) / bin_size))
    last = own.groupBy("chrom").agg(F.max("pos").alias("last"))
    bins = last.select("chrom", "last", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("last") - 1) / bin_size))).alias("bin"))
    held = own.groupBy("chrom", "bin").agg(F.collect_list(F.struct((F.col("pos") - 1 - F.col("bin") * bin_size).cast("int").alias("at"), "kind")).alias("s"))
    size = F.least(F.lit(bin_size).cast("long"), F.col("last") - F.col("bin") * bin_size)
    rows = materialize(bins.join(held, ["chrom", "bin"], "left").select("chrom", "bin", size.alias("size"), "s.at", "s.kind"), "bins")
    name = dict(own.dtypes)["chrom"]

    def dense(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
        """Bins, the largest first, the kinds of their positions (positions by bins), and how many each has."""
        for whole in batches:
            order = np.argsort(-whole["size"].to_numpy(), kind="stable")
            step = max(1, CELLS // max(1, int(whole["size"].to_numpy().max(initial=1))))
            for lo in range(0, len(order), step):
                batch = whole.take(pa.array(order[lo : lo + step]))
                n = batch["size"].to_numpy()
                kind = np.zeros((int(n[0]), len(n)), np.int8)
                count = batch["at"].value_lengths().fill_null(0).to_numpy()
                kind[batch["at"].flatten().to_numpy(), np.repeat(np.arange(len(n)), count)] = batch["kind"].flatten().to_numpy()
                yield batch, kind, n

    def product(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, kind, n in dense(batches):
            # from state 0, and from state 1
            f0, f1 = np.full((2, len(n)), _NEVER), np.full((2, len(n)), _NEVER)
            f0[0], f1[1] = 0, 0
            _steps(kind, n, emission, transition, f0, f1)
            yield pa.RecordBatch.from_arrays([batch["chrom"], batch["bin"], *(pa.array(x) for x in (f0[0], f1[0], f0[1], f1[1]))], ["chrom", "bin", "m00", "m01", "m10", "m11"])

    def lines(df: DataFrame, *columns: str) -> DataFrame:
        """One row per chromosome: its bins in order."""
        return df.groupBy("chrom").agg(F.array_sort(F.collect_list(F.struct(*columns))).alias("s")).select("chrom", *[F.col(f"s.{c}").alias(c) for c in columns])

    def forward(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            count = batch["bin"].value_lengths().to_numpy()
            f0, f1, final = [], [], []
            steps = zip(*(batch[c].flatten().to_pylist() for c in ("m00", "m01", "m10", "m11")), strict=True)
            for n in count.tolist():
                f = (0, 0)
                for a, b, c, d in islice(steps, n):
                    f0.append(f[0])
                    f1.append(f[1])
                    f = (max(f[0] + a, f[1] + c), max(f[0] + b, f[1] + d))
                final += [0 if f[0] > f[1] else 1] * n
            yield pa.RecordBatch.from_arrays([batch["chrom"].take(pa.array(np.repeat(np.arange(len(count)), count))), batch["bin"].flatten(), pa.array(f0, pa.int64()), pa.array(f1, pa.int64()), pa.array(final, pa.int32())], ["chrom", "bin", "f0", "f1", "final"])

    def follow(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, kind, n in dense(batches):
            f0, f1 = (batch[c].to_numpy().astype(np.int64)[None].copy() for c in ("f0", "f1"))
            back = _steps(kind, n, emission, transition, f0, f1)[:, 0]
            there = np.searchsorted(-n, -np.arange(1, len(kind) + 1), side="right")
            first = batch["bin"].to_numpy() * bin_size + 1
            for end in (0, 1):
                state, inside = np.full(len(n), end, np.int8), np.zeros((len(n), len(kind) + 2), np.int8)
                for i in range(len(kind) - 1, -1, -1):
                    k = there[i]
                    inside[:k, i + 1] = state[:k]
                    state[:k] = back[i, :k] >> state[:k] & 1
                row, edge = np.nonzero(np.diff(inside, axis=1))
                edge = edge + first[row]
                runs = pa.StructArray.from_arrays([pa.array(edge[::2]), pa.array(edge[1::2] - 1)], ["start", "end"])
                offsets = np.r_[0, np.cumsum(np.bincount(row[::2], minlength=len(n)))].astype(np.int32)
                same = lambda x: pa.array(np.asarray(x, np.int32))
                yield pa.RecordBatch.from_arrays([batch["chrom"], batch["bin"], same(np.full(len(n), end)), same(state), batch["final"], pa.ListArray.from_arrays(pa.array(offsets), runs)], ["chrom", "bin", "ends", "before", "final", "runs"])

    def backward(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            # two rows a bin, one for each state at its end
            count = batch["bin"].value_lengths().to_numpy()
            before, final, ends, at = batch["before"].flatten().to_pylist(), batch["final"].flatten().to_pylist(), [], 0
            for n in count.tolist():
                state, own = final[at], []
                for k in range(at + n - 2, at - 1, -2):
                    own.append(state)
                    state = before[k + state]
                ends += own[::-1]
                at += n
            yield pa.RecordBatch.from_arrays([batch["chrom"].take(pa.array(np.repeat(np.arange(len(count)), count // 2))), pa.array(batch["bin"].flatten().to_numpy()[::2]), pa.array(ends, pa.int32())], ["chrom", "bin", "ends"])

    matrix = rows.mapInArrow(product, f"chrom {name}, bin long, m00 long, m01 long, m10 long, m11 long")
    scores = lines(matrix, "bin", "m00", "m01", "m10", "m11").mapInArrow(forward, f"chrom {name}, bin long, f0 long, f1 long, final int")
    both = rows.join(scores, ["chrom", "bin"]).mapInArrow(follow, f"chrom {name}, bin long, ends int, before int, final int, runs array<struct<start:long,end:long>>")
    both = materialize(both, "paths")
    path = lines(both, "bin", "ends", "before", "final").mapInArrow(backward, f"chrom {name}, bin long, ends int")
    runs = both.join(path, ["chrom", "bin", "ends"]).select("chrom", F.explode("runs").alias("r")).select("chrom", "r.start", "r.end", F.col("r.start").alias("id"))
    return number_islands(runs, 1, ["chrom"]).groupBy("chrom", "island").agg(F.min("start").alias("start"), F.max("end").alias("end")).drop("island")
