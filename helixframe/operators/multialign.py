"""Multiple alignments from pairwise ones: a spanning forest of the best, gaps handed on through shared members, consensus, refined clips."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from helixframe.operators.graph import connected_components
from helixframe.storage import materialize

#: Scores of the walk that refines clips, and the score at which it ends.
MATCH, MISMATCH, DROP = 1, -3, -16


def best_forest(alignments: DataFrame, max_rounds: int = 40) -> DataFrame:
    """The alignments ``id, a, b, score, ...`` of a maximal spanning forest, with ``cluster``, the smallest member.

    In each round every cluster takes its best alignment to another one (ties:
    smallest id), so the rounds are logarithmic in the largest cluster and the
    forest is the one that taking alignments in order of score would give.
    """
    ends = alignments.where("a <> b").select("id", "a", "b", "score")
    taken, groups = None, None
    for _ in range(max_rounds):
        if groups is None:
            apart = ends.select("id", F.col("a").alias("g"), F.col("b").alias("h"), "score")
        else:
            own = lambda end, name: groups.select(F.col("node").alias(end), F.col("component").alias(name))
            apart = ends.join(own("a", "g"), "a").join(own("b", "h"), "b").where("g <> h").select("id", "g", "h", "score")
        best = apart.select("id", "score", F.explode(F.array("g", "h")).alias("g")).groupBy("g").agg(F.max(F.struct("score", F.negative("id").alias("n"))).alias("top"))
        new = materialize(best.select(F.negative("top.n").alias("id")).distinct(), "taken")
        if taken is not None and new.isEmpty():
            break
        taken = new if taken is None else taken.unionAll(new)
        groups = materialize(connected_components(materialize(ends.join(taken, "id", "left_semi").select("a", "b"), "tree"), "a", "b"), "clusters")
    else:
        raise RuntimeError(f"clusters did not settle in {max_rounds} rounds")
    return alignments.join(taken, "id", "left_semi").join(groups.select(F.col("node").alias("a"), F.col("component").alias("cluster")), "a")


class Layout:
    """Sequences by name: whether turned, and the column of each of their bases."""

    def __init__(self, columns: dict, turned: dict):
        self.columns, self.turned = columns, turned

    @classmethod
    def pair(cls, a, b, a_len: int, b_len: int, reverse: bool, blocks: Sequence[tuple[int, int, int]]) -> Layout:
        """Two sequences of which the runs (start in a, start in b as turned, length) share columns.

        What lies between runs has columns of its own, a's first; what lies
        outside of the first and last run hangs over.
        """
        x, y = np.zeros(a_len, np.int64), np.zeros(b_len, np.int64)
        (at, bt, _), col = blocks[0], 0
        x[:at], y[:bt] = np.arange(-at, 0), np.arange(-bt, 0)
        for s, t, n in blocks:
            x[at:s] = np.arange(col, col + s - at)
            col += s - at
            y[bt:t] = np.arange(col, col + t - bt)
            col += t - bt
            x[s : s + n] = y[t : t + n] = np.arange(col, col + n)
            col, at, bt = col + n, s + n, t + n
        x[at:], y[bt:] = np.arange(col, col + a_len - at), np.arange(col, col + b_len - bt)
        return cls({a: x, b: y}, {a: False, b: reverse})

    def turn(self) -> None:
        self.columns = {k: -c[::-1] for k, c in self.columns.items()}
        self.turned = {k: not t for k, t in self.turned.items()}

    def _widen(self, marks: np.ndarray, extra: np.ndarray) -> None:
        """Inserts ``extra`` columns before each of the columns ``marks``."""
        if extra.any():
            shift = np.r_[0, np.cumsum(extra)]
            self.columns = {k: c + shift[np.searchsorted(marks, c, side="right")] for k, c in self.columns.items()}

    def merge(self, other: Layout, shared) -> None:
        """Takes in another layout through a sequence that both have: of its gaps the larger ones hold in both."""
        if self.turned[shared] != other.turned[shared]:
            other.turn()
        x, y = self.columns[shared], other.columns[shared]
        gap = np.r_[0, np.diff(y)] - np.r_[0, np.diff(x)]
        self._widen(x, np.maximum(gap, 0))
        other._widen(y, np.maximum(-gap, 0))
        by = self.columns[shared][0] - other.columns[shared][0]
        for k, c in other.columns.items():
            if k != shared:
                self.columns[k], self.turned[k] = c + by, other.turned[k]


def build(alignments: Sequence[tuple]) -> Layout:
    """The layout of a tree of alignments (a, b, a_len, b_len, reverse, blocks), in their order; the first member is not turned."""
    at: dict = {}
    first = alignments[0][0]
    for a, b, a_len, b_len, reverse, blocks in alignments:
        pair = Layout.pair(a, b, a_len, b_len, reverse, blocks)
        for k in (a, b):
            held = at.get(k)
            if held is None or held is pair:
                continue
            small, large = sorted((pair, held), key=lambda x: len(x.columns))
            large.merge(small, k)
            pair = large
        for k in pair.columns:
            at[k] = pair
    whole = at[first]
    if whole.turned[min(whole.columns)]:
        whole.turn()
    return whole


def merged_layouts(forest: DataFrame) -> DataFrame:
    """``cluster, seq, turned, columns``: the column (from 0) of each base of each sequence, a cluster's smallest member as it is.

    ``forest``: ``cluster, id, a, b, a_len, b_len, reverse, score, blocks
    array<struct<a,b,length>>`` with one tree for each cluster
    (``best_forest``). Alignments are merged from the best on. A group is the
    tree of one cluster.
    """
    kind = dict(forest.dtypes)["a"]

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        rows = pdf.assign(_neg=-pdf["score"]).sort_values(["_neg", "id"])
        tree = [(r.a, r.b, int(r.a_len), int(r.b_len), bool(r.reverse), [(int(x["a"]), int(x["b"]), int(x["length"])) for x in r.blocks]) for r in rows.itertuples()]
        whole = build(tree)
        low = min(int(c[0]) for c in whole.columns.values() if len(c))
        names = list(whole.columns)
        return pd.DataFrame({"cluster": [pdf["cluster"].iloc[0]] * len(names), "seq": names, "turned": [whole.turned[k] for k in names], "columns": [(whole.columns[k] - low).tolist() for k in names]})

    return forest.groupBy("cluster").applyInPandas(one, f"cluster {kind}, seq {kind}, turned boolean, columns array<long>")


def gapped(layouts: DataFrame, sequences: DataFrame) -> DataFrame:
    """``cluster, seq, first, gapped``: each sequence (``seq, bases``, already turned) from its first column on, with - for its gaps."""
    rows = layouts.join(sequences, "seq").where("size(columns) > 0")
    wide = F.transform(
        F.sequence(F.lit(0), F.size("columns") - 1),
        lambda i: F.concat(F.repeat(F.lit("-"), F.when(i > 0, (F.element_at("columns", i + 1) - F.element_at("columns", F.greatest(i, F.lit(1))) - 1).cast("int")).otherwise(0)), F.substring(F.col("bases"), i + 1, F.lit(1))),
    )
    return rows.select("cluster", "seq", F.element_at("columns", 1).alias("first"), F.array_join(wide, "").alias("gapped"))


def consensus(rows: DataFrame, left: str = "clip_left", right: str = "clip_right") -> DataFrame:
    """``cluster, col, base, n, depth``: the most frequent character of each column, ties in the order of letters, gaps last.

    ``rows``: ``cluster, seq, first, gapped``, and, if there, the characters of
    each that are clipped at its ends and have no say.
    """
    cut = [F.col(c) if c in rows.columns else F.lit(0) for c in (left, right)]
    own = F.substring(F.col("gapped"), cut[0] + 1, F.length("gapped") - cut[0] - cut[1])
    chars = rows.select("cluster", (F.col("first") + cut[0]).alias("at"), F.posexplode(F.split(own, "(?!$)")).alias("k", "c")).where("c <> ''")
    counts = chars.groupBy("cluster", (F.col("at") + F.col("k")).alias("col"), F.upper("c").alias("c")).agg(F.count(F.lit(1)).alias("n"))
    best = counts.groupBy("cluster", "col").agg(F.min(F.struct(F.negative("n").alias("m"), (F.col("c") == "-").alias("gap"), "c")).alias("b"), F.sum("n").alias("depth"))
    return best.select("cluster", "col", F.col("b.c").alias("base"), F.negative("b.m").alias("n"), "depth")


def refine_clips(rows: DataFrame, columns: DataFrame) -> DataFrame:
    """``cluster, seq, clip_left, clip_right``: clips (in characters of ``gapped``) as far as the consensus bears them out.

    A clipped end is walked outwards from the last match inside of it: a match
    counts ``MATCH``, another base ``MISMATCH``, gaps nothing; the walk ends at
    a score of ``DROP``, and the clip begins behind the place of the highest
    score (the first of ties). Ends that are not clipped stay; a sequence
    without any match keeps its clips. ``columns``: ``cluster, col, base``.
    """
    seen = rows.select("cluster", "seq", "first", "clip_left", "clip_right", F.posexplode(F.split("gapped", "(?!$)")).alias("k", "c")).where("c <> ''")
    met = seen.withColumn("col", F.col("first") + F.col("k")).join(columns.select("cluster", "col", "base"), ["cluster", "col"], "left")
    score = F.when(F.col("c") == "-", 0).when(F.upper("c") == F.col("base"), MATCH).otherwise(MISMATCH)
    line = met.groupBy("cluster", "seq", "clip_left", "clip_right").agg(F.sort_array(F.collect_list(F.struct("k", score.alias("s")))).alias("line"))

    def walk(line, clip):
        """Characters that stay clipped at the end of ``line``."""
        n = F.size(line)
        inside = F.filter(F.sequence(F.lit(0), n - 1), lambda i: (i < n - clip) & (line[i]["s"] == MATCH))
        last = F.array_max(inside)
        start = F.struct(F.lit(MATCH).alias("score"), F.lit(MATCH).alias("most"), last.alias("best"), F.lit(False).alias("over"))
        step = lambda a, i: F.when(a["over"], a).otherwise(
            F.struct(
                (a["score"] + line[i]["s"]).alias("score"), F.greatest(a["most"], a["score"] + line[i]["s"]).alias("most"), F.when(a["score"] + line[i]["s"] > a["most"], i).otherwise(a["best"]).alias("best"), (a["score"] + line[i]["s"] <= DROP).alias("over")
            )
        )
        outward = F.when(last < n - 1, F.sequence(last + 1, n - 1)).otherwise(F.array().cast("array<int>"))
        return F.when((clip > 0) & last.isNotNull(), n - 1 - F.aggregate(outward, start, step)["best"]).otherwise(clip)

    return line.select("cluster", "seq", walk(F.reverse("line"), F.col("clip_left")).cast("int").alias("clip_left"), walk(F.col("line"), F.col("clip_right")).cast("int").alias("clip_right"))
