"""Hard negatives by Four-Russians scoring: table look-ups in place of products, exact to the last bit."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from helixframe.storage import materialize

#: A cell of the grid of anchors and rows holds about so many of each, so that a task's memory has a bound.
CELL_ANCHORS, CELL_ROWS = 16_384, 131_072
#: Anchors whose tables are in use at once, and rows scored at once: both fit a core's cache.
_ANCHORS, _ROWS = 64, 1024
#: Squared length of the longest integer vector that takes part: a hundred times an inner product stays within 64 bits.
LONGEST = 2.0**56


def bit_planes(v: np.ndarray) -> np.ndarray:
    """Integer rows (n, d) as (n, planes, ceil(d / 8)) bytes: byte g of plane p has bit p of the dimensions 8g to 8g + 7.

    Two's complement: the last plane counts negatively.
    """
    n, d = v.shape
    planes = max(int(v.max(initial=0)), -int(v.min(initial=0)) - 1).bit_length() + 1
    wide = np.zeros((n, -(-d // 8) * 8), np.int64)
    wide[:, :d] = v
    return np.stack([np.packbits(((wide >> p) & 1).astype(np.uint8), axis=1, bitorder="little") for p in range(planes)], axis=1)


def from_planes(code: np.ndarray) -> np.ndarray:
    """The integer rows again, as wide as the planes' bytes."""
    planes = code.shape[1]
    out = np.zeros((len(code), code.shape[2] * 8), np.int64)
    for p in range(planes):
        out += np.unpackbits(code[:, p], axis=1, bitorder="little").astype(np.int64) * (-(1 << p) if p == planes - 1 else 1 << p)
    return out


def subset_sums(anchors: np.ndarray, dtype: type) -> np.ndarray:
    """(d / 8, 256, n): for each group of eight dimensions the sum of every subset of an anchor's components."""
    n, d = anchors.shape
    out = np.zeros((d // 8, 256, n), dtype)
    part = anchors.T.reshape(d // 8, 8, n).astype(dtype)
    for j in range(8):
        out[:, 1 << j : 2 << j] = out[:, : 1 << j] + part[:, j : j + 1]
    return out


def scores(code: np.ndarray, tables: np.ndarray) -> np.ndarray:
    """(rows, anchors): inner products from the packed planes of rows and the tables of anchors."""
    planes, groups = code.shape[1:]
    total = np.zeros((len(code), tables.shape[2]), tables.dtype)
    found = np.empty_like(total)
    for p in reversed(range(planes)):
        np.left_shift(total, 1, out=total)
        for g in range(groups):
            np.take(tables[g], code[:, p, g], axis=0, out=found, mode="clip")
            (np.subtract if p == planes - 1 else np.add)(total, found, out=total)
    return total


class _Best:
    """The first ``keep`` entries of each column, highest score first, then smallest place. Places must come in ascending order."""

    def __init__(self, columns: int, keep: int):
        self.keep, self.floor = keep, np.full(columns, np.iinfo(np.int64).min)
        self.col, self.score, self.place = (np.empty(0, np.int64) for _ in range(3))

    def offer(self, col: np.ndarray, score: np.ndarray, place: np.ndarray) -> None:
        new = score > self.floor[col]
        if not new.any():
            return
        col, score, place = (np.concatenate([old, x[new]]) for old, x in ((self.col, col), (self.score, score), (self.place, place)))
        by = np.lexsort((place, -score, col))
        col = col[by]
        start = np.r_[0, np.flatnonzero(col[1:] != col[:-1]) + 1]
        rank = np.arange(len(col)) - np.repeat(start, np.diff(np.r_[start, len(col)]))
        first = rank < self.keep
        self.col, self.score, self.place = col[first], score[by][first], place[by][first]
        last = rank[first] == self.keep - 1
        self.floor[self.col[last]] = self.score[last]


def _encode(scale: int):
    """(row, id, label, planes, groups, code, anchor) of the rows whose vectors take part; ``row`` names a row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        row = TaskContext.get().partitionId() << 33
        for b in batches:
            vectors = b.column(2)
            length = np.diff(np.asarray(vectors.offsets))
            value = np.floor(np.asarray(vectors.flatten().fill_null(np.nan)).astype(np.float64) * scale)
            start = np.cumsum(length) - length
            for d in np.unique(length):
                own = np.flatnonzero(length == d)
                v = value[start[own, None] + np.arange(d)]
                with np.errstate(all="ignore"):
                    fits = (v * v).sum(axis=1) <= LONGEST  # not so for nan and inf
                own = own[fits]
                if not len(own):
                    continue
                code = bit_planes(v[fits].astype(np.int64))
                planes, groups = (pa.array(np.full(len(own), k, np.int32)) for k in code.shape[1:])
                packed = pa.array([c.tobytes() for c in code], pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(own + row), b.column(0).take(pa.array(own)), b.column(1).take(pa.array(own)), planes, groups, packed, b.column(3).take(pa.array(own))], ["row", "id", "label", "planes", "groups", "code", "anchor"])
            row += b.num_rows

    return run


def _codes(t: pa.Table, groups: int) -> np.ndarray:
    """The planes of all rows of a table, widened to the most planes among them (by the sign) and to ``groups`` (by zeros)."""
    planes, own_groups = np.asarray(t["planes"]), np.asarray(t["groups"])
    out = np.zeros((t.num_rows, planes.max(initial=1), groups), np.uint8)
    for p, g in {*zip(planes.tolist(), own_groups.tolist(), strict=True)}:
        own = np.flatnonzero((planes == p) & (own_groups == g))
        code = np.frombuffer(b"".join(t["code"].take(pa.array(own)).to_pylist()), np.uint8).reshape(len(own), p, g)
        out[own, :p, :g] = code
        out[own, p:, :g] = code[:, -1:]
    return out


def _scored(rows: pa.Table, anchors: pa.Table, same: bool) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(anchors, rows, scores of rows by anchors) for pairs of one label, or of two; an anchor's rows come in ascending order."""
    groups = int(max(np.asarray(t["groups"]).max(initial=0) for t in (rows, anchors)))
    code, vector = _codes(rows, groups), from_planes(_codes(anchors, groups))
    label, own = np.asarray(rows["label"]), np.asarray(anchors["label"])
    for kind in np.unique(own):
        at, among = np.flatnonzero(own == kind), np.flatnonzero((label == kind) == same)
        for a in range(0, len(at), _ANCHORS):
            some = at[a : a + _ANCHORS]
            most = int(np.abs(vector[some]).sum(axis=1).max()) << (code.shape[1] - 1)
            tables = subset_sums(vector[some], np.int32 if most < 1 << 31 else np.int64)
            for r in range(0, len(among), _ROWS):
                part = among[r : r + _ROWS]
                yield some, part, scores(code[part], tables)


def _in_order(t: pa.Table) -> pa.Table:
    return t.sort_by([("id", "ascending"), ("row", "ascending")])  # nulls come last


def _positives(keep: int):
    def run(rows: pa.Table, anchors: pa.Table) -> pa.Table:
        rows = _in_order(rows)
        name, own = np.asarray(rows["row"]), np.asarray(anchors["row"])
        best = _Best(len(own), keep)
        for some, part, s in _scored(rows, anchors, True):
            col, place = np.nonzero(((s > best.floor[some]) & (name[part, None] != own[some])).T)
            best.offer(some[col], s[place, col].astype(np.int64), part[place])
        return pa.table({"row": own[best.col], "positive_id": rows["id"].take(pa.array(best.place)), "positive_score": best.score})

    return run


def _negatives(keep: int, low: int, high: int):
    def run(rows: pa.Table, anchors: pa.Table) -> pa.Table:
        rows = _in_order(rows)
        lists = anchors["positives"].combine_chunks()
        first, count = np.asarray(lists.offsets)[:-1] - np.asarray(lists.offsets)[0], np.diff(np.asarray(lists.offsets))
        positive = lists.flatten()
        score = np.asarray(positive.field("positive_score"))
        # what a row must reach to be let through by any positive of an anchor
        least = np.minimum.reduceat(low * score, first) if len(score) else score
        best = _Best(len(score), keep)
        for some, part, s in _scored(rows, anchors, False):
            place, col = np.nonzero(100 * s.astype(np.int64) >= least[some])
            found, place, col = s[place, col].astype(np.int64), part[place], some[col]
            for j in range(int(count[some].max())):
                has = count[col] > j
                pair, n = first[col[has]] + j, 100 * found[has]
                fit = (low * score[pair] <= n) & (n <= high * score[pair])
                best.offer(pair[fit], found[has][fit], place[has][fit])
        of = pa.array(best.col)
        anchor = pa.array(np.repeat(np.arange(len(count)), count)[best.col])
        return pa.table({
            "row": anchors["row"].take(anchor), "anchor_id": anchors["id"].take(anchor), "place": positive.field("place").take(of), "positive_id": positive.field("positive_id").take(of),
            "positive_score": positive.field("positive_score").take(of), "negative_id": rows["id"].take(pa.array(best.place)), "negative_score": best.score,
        })

    return run


def mine_negatives(vectors: DataFrame, anchor: Column, id: str = "vec_id", vector: str = "embedding", label: str = "label", scale: int = 256, positives: int = 5, negatives: int = 5, low: int = 80, high: int = 100, cell_anchors: int = CELL_ANCHORS, cell_rows: int = CELL_ROWS) -> DataFrame:
    """``anchor_id, positive_id, rank, negative_id, positive_score, negative_score``: hard negatives of each anchor and positive.

    Anchors are the rows that satisfy ``anchor``.
    Components become floor(scale * x); a score is the inner product of two
    such vectors. An anchor's positives are its first ``positives`` other rows
    of the same label, and a positive's negatives the first ``negatives`` rows
    of other labels with low * positive <= 100 * negative <= high * positive;
    higher scores come first, then smaller ids, null ids last.

    1. Rows are written once as bit planes, eight dimensions to a byte.
    2. Anchors and rows meet in the cells of a grid: every anchor and every row
       is dealt to one line of it by a hash, whatever its label, so no cell
       grows with a label or with copies.
    3. A cell builds the subset-sum tables of some anchors and looks the bytes
       of all its rows up in them, plane by plane, with a shift between planes:
       full exact scores, of which only an anchor's first few leave the cell.

    Null label or vector, a component that is null, nan or infinite: the row
    takes no part; nor does one whose integer vector is longer than the root of
    ``LONGEST``. Vectors of unlike length: the shorter one ends in zeros; empty
    vectors score 0. Rows that share an id are rows of their own. No
    anchor, no positive or an empty table: no rows. Other
    columns are ignored.
    """
    spark = vectors.sparkSession
    taking = vectors.select(F.col(id).cast("long").alias("id"), F.col(label).cast("long").alias("label"), F.col(vector).cast("array<double>").alias("vector"), F.coalesce(anchor, F.lit(False)).alias("anchor")).where("label is not null and vector is not null")
    index = materialize(taking.mapInArrow(_encode(scale), "row long, id long, label long, planes int, groups int, code binary, anchor boolean"), "planes")
    rows, asked = index.agg(F.count(F.lit(1)), F.count(F.when(F.col("anchor"), 1))).first()
    lines = -(-asked // cell_anchors) or 1
    columns = max(-(-rows // cell_rows), int(spark.conf.get("spark.sql.shuffle.partitions")) // lines, 1)

    def every(n: int, name: str) -> Column:
        return F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias(name)

    dealt = index.withColumn("c", F.pmod(F.xxhash64("row"), F.lit(columns)).cast("int")).select("*", every(lines, "r")).groupBy("r", "c")

    def meet(anchors: DataFrame, fn, schema: str) -> DataFrame:
        spread = anchors.withColumn("r", F.pmod(F.xxhash64("row"), F.lit(lines)).cast("int")).select("*", every(columns, "c"))
        return dealt.cogroup(spread.groupBy("r", "c")).applyInArrow(fn, schema)

    anchors = index.where("anchor")
    near = meet(anchors, _positives(positives), "row long, positive_id long, positive_score long")
    place = F.row_number().over(Window.partitionBy("row").orderBy(F.desc("positive_score"), F.asc_nulls_last("positive_id")))
    near = near.withColumn("place", place).where(F.col("place") <= positives)
    with_positives = anchors.join(near.groupBy("row").agg(F.sort_array(F.collect_list(F.struct("place", "positive_id", "positive_score"))).alias("positives")), "row")
    with_positives = materialize(with_positives, "positives")
    hard = meet(with_positives, _negatives(negatives, low, high), "row long, anchor_id long, place int, positive_id long, positive_score long, negative_id long, negative_score long")
    rank = F.row_number().over(Window.partitionBy("row", "place").orderBy(F.desc("negative_score"), F.asc_nulls_last("negative_id")))
    return hard.withColumn("rank", rank).where(F.col("rank") <= negatives).select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
