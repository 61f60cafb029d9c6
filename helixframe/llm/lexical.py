"""Ranked lexical search: best-first over document intervals, bounded by range-maximum tables of posting lists."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from helixframe.storage import materialize

#: Letters, digits and all bytes of characters beyond ASCII are of terms; A-Z in lower case; all else parts them.
TERM_BYTES = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))
#: Slots of the filter of query terms: its size has this bound, however many queries there are.
SLOTS = 1 << 21
#: A cell of the grid of queries and documents holds about so many of each, so that a task's memory has a bound.
CELL_ITEMS, CELL_DOCS = 1024, 65_536
#: Documents of one set of posting lists (their places take PLACE bits), and entries of its table of ranks.
PLACE, RANKS = 12, 1 << 25
#: Intervals of a query that are split in one step.
AT_ONCE = 8


def terms(text: str | None) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").translate(TERM_BYTES).split() if text else []


def _slot(term: bytes) -> int:
    return xxhash.xxh3_64_intdigest(term) & (SLOTS - 1)


def _item_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(item, item_id, term, times, slot): a row for each distinct term of a query; ``item`` names a row."""
    from pyspark import TaskContext

    row = TaskContext.get().partitionId() << 33
    for b in batches:
        out = [(row + k, i, t.decode("utf-8", "surrogatepass"), n, _slot(t)) for k, (i, x) in enumerate(zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True)) for t, n in Counter(terms(x)).items()]
        row += b.num_rows
        columns = zip(*out, strict=True) if out else [[]] * 5
        yield pa.RecordBatch.from_arrays([pa.array(c, kind) for c, kind in zip(columns, (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64()), strict=True)], ["item", "item_id", "term", "times", "slot"])


def _postings(wanted: Broadcast):
    """(row, doc_id, n, terms, tf): number of terms of a document, those that queries may have in one string, and how often each occurs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        row, slots, digest, mask = TaskContext.get().partitionId() << 33, wanted.value, xxhash.xxh3_64_intdigest, SLOTS - 1
        for b in batches:
            n, found, times = [], [], []
            for text in b.column(1):
                own = terms(text.as_py())
                n.append(len(own))
                met = {t: k for t, k in Counter(own).items() if slots[digest(t) & mask]}
                found.append(b" ".join(met))
                times.append(np.fromiter(met.values(), np.int64, len(met)))
            rows = pa.array(range(row, row + b.num_rows), pa.int64())
            row += b.num_rows
            yield pa.RecordBatch.from_arrays([rows, b.column(0), pa.array(n, pa.int64()), pa.array(found, pa.binary()).cast(pa.string()), pa.array(times, pa.list_(pa.int64()))], ["row", "doc_id", "n", "terms", "tf"])

    return run


class RangeMaxima:
    """Posting lists over the places 0 to ``docs`` - 1 with a sparse table of range maxima each.

    An entry is impact << PLACE | (last place - place), so a maximum also tells
    its document, the first one of equals.
    """

    def __init__(self, docs: int, lists: int, term: np.ndarray, place: np.ndarray, impact: np.ndarray):
        by = np.lexsort((place, term))
        term, place = term[by], place[by]
        self.rank = np.zeros((lists, docs + 1), np.int16)
        self.rank[term, place + 1] = 1
        np.cumsum(self.rank, axis=1, out=self.rank)
        self.start = np.searchsorted(term, np.arange(lists))
        self.levels = [(impact[by] << PLACE) | ((1 << PLACE) - 1 - place)]
        longest = int(self.rank[:, -1].max(initial=0))
        while 2 << (len(self.levels) - 1) <= longest:
            last, half = self.levels[-1], 1 << (len(self.levels) - 1)
            self.levels.append(np.r_[np.maximum(last[:-half], last[half:]), last[-half:]])
        self.table = np.stack(self.levels)
        self.log = np.zeros(longest + 1, np.int64)
        for k in range(2, longest + 1):
            self.log[k] = self.log[k >> 1] + 1

    def over(self, term: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """Greatest entry of each list between places ``low`` and ``high`` (exclusive); 0 if there is none."""
        a, b = self.rank[term, low].astype(np.int64), self.rank[term, high].astype(np.int64)
        out = np.zeros(len(term), np.int64)
        has = np.flatnonzero(b > a)
        a, b, at = a[has], b[has], self.start[term[has]]
        k = self.log[b - a]
        out[has] = np.maximum(self.table[k, at + a], self.table[k, at + b - (1 << k)])
        return out

    def at(self, term: np.ndarray, place: np.ndarray) -> np.ndarray:
        """Impact of each list at a place; 0 if the place is not in it."""
        a = self.rank[term, place].astype(np.int64)
        has = np.flatnonzero(self.rank[term, place + 1] > a)
        out = np.zeros(len(term), np.int64)
        out[has] = self.table[0, self.start[term[has]] + a[has]] >> PLACE
        return out


class _Top:
    """The first ``keep`` (score, order) of each query: highest score, then smallest order. Scores of 0 have no place."""

    def __init__(self, items: int, keep: int):
        self.keep = keep
        self.score, self.order = np.ones(items, np.int64), np.full(items, np.iinfo(np.int64).max)  # what must be reached, or be below at equal scores
        self.found = tuple(np.empty(0, np.int64) for _ in range(3))

    def may(self, item: np.ndarray, score: np.ndarray, order: np.ndarray) -> np.ndarray:
        return (score > self.score[item]) | ((score == self.score[item]) & (order < self.order[item]))

    def offer(self, item: np.ndarray, score: np.ndarray, order: np.ndarray) -> None:
        new = self.may(item, score, order)
        if not new.any():
            return
        item, score, order = (np.concatenate([old, x[new]]) for old, x in zip(self.found, (item, score, order), strict=True))
        by = np.lexsort((order, -score, item))
        item = item[by]
        start = np.r_[0, np.flatnonzero(item[1:] != item[:-1]) + 1]
        place = np.arange(len(item)) - np.repeat(start, np.diff(np.r_[start, len(item)]))
        first = place < self.keep
        self.found = item[first], score[by][first], order[by][first]
        last = place[first] == self.keep - 1
        self.score[self.found[0][last]], self.order[self.found[0][last]] = self.found[1][last], self.found[2][last]


class _Queries:
    """Queries as runs of (list, times)."""

    def __init__(self, item: np.ndarray, term: np.ndarray, times: np.ndarray):
        """``item`` ascends from 0."""
        self.term, self.times = term, times
        self.count = np.bincount(item)
        self.start = np.cumsum(self.count) - self.count

    def spread(self, item: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """For each query its terms: (place in ``item``, list, times), and where the terms of each begin."""
        n = self.count[item]
        begin = np.cumsum(n) - n
        which = np.repeat(np.arange(len(item)), n)
        at = np.arange(len(which)) - begin[which] + self.start[item][which]
        return which, self.term[at], self.times[at], begin


def best_first(lists: RangeMaxima, queries: _Queries, docs: int, order: np.ndarray, top: _Top) -> int:
    """Offer ``top`` every document that may have a place in it; returns how many were scored.

    An interval's bound is the sum of its lists' greatest impacts in it. The
    intervals of greatest bound come first, some of each query in a step; each
    is split at the document of its greatest impact, which is scored in full.
    Intervals that cannot reach the last place found so far are dropped.
    """
    # least order of an interval, for equal scores
    least = [order]
    while 2 << (len(least) - 1) <= docs:
        half = 1 << (len(least) - 1)
        least.append(np.r_[np.minimum(least[-1][:-half], least[-1][half:]), least[-1][-half:]])
    least = np.stack(least)

    def bounded(item: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, ...]:
        wide = high > low
        item, low, high = item[wide], low[wide], high[wide]
        if not len(item):
            return item, low, high, item, item
        which, term, times, begin = queries.spread(item)
        entry = lists.over(term, low[which], high[which])
        part = times * (entry >> PLACE)
        bound = np.add.reduceat(part, begin)
        split = (1 << PLACE) - 1 - (np.maximum.reduceat((part << PLACE) | (entry & ((1 << PLACE) - 1)), begin) & ((1 << PLACE) - 1))
        return item, low, high, bound, split

    def kept(item: np.ndarray, low: np.ndarray, high: np.ndarray, bound: np.ndarray, split: np.ndarray) -> tuple[np.ndarray, ...]:
        k = np.log2(high - low).astype(np.int64) if len(low) else low
        keep = top.may(item, bound, np.minimum(least[k, low], least[k, high - (1 << k)]))
        return item[keep], low[keep], high[keep], bound[keep], split[keep]

    scored = 0
    every = np.arange(len(queries.count))
    front = kept(*bounded(every, np.zeros(len(every), np.int64), np.full(len(every), docs)))
    while len(front[0]):
        by = np.lexsort((-front[3], front[0]))
        front = tuple(x[by] for x in front)
        item = front[0]
        start = np.r_[0, np.flatnonzero(item[1:] != item[:-1]) + 1]
        now = np.arange(len(item)) - np.repeat(start, np.diff(np.r_[start, len(item)])) < AT_ONCE
        item, low, high, _, split = (x[now] for x in front)
        which, term, times, begin = queries.spread(item)
        scored += len(item)
        top.offer(item, np.add.reduceat(times * lists.at(term, split[which]), begin), order[split])
        new = bounded(np.r_[item, item], np.r_[low, split + 1], np.r_[split, high])
        front = kept(*(np.concatenate([x[~now], y]) for x, y in zip(front, new, strict=True)))
    return scored


def _search(keep: int, documents: int, length: int, place: int = PLACE, ranks: int = RANKS):
    """The first documents of a cell for each of its queries."""

    def run(docs: pa.Table, items: pa.Table) -> pa.Table:
        nothing = pa.table({"item": pa.array([], pa.int64()), "item_id": pa.array([], pa.int64()), "doc_id": pa.array([], pa.int64()), "score": pa.array([], pa.int64())})
        if not docs.num_rows or not items.num_rows:
            return nothing
        items = items.sort_by("item")
        names = pc.unique(items["term"])
        term = np.asarray(pc.index_in(items["term"], value_set=names)).astype(np.int64)
        weight = np.zeros(len(names), np.int64)
        weight[term] = np.asarray(items["w"])
        item, first, number = np.unique(np.asarray(items["item"]), return_index=True, return_inverse=True)
        queries, top = _Queries(number, term, np.asarray(items["times"])), _Top(len(item), keep)
        # documents of like length stand together, equal ones by doc_id; ``order`` is the place by doc_id, nulls last
        docs = docs.sort_by([("doc_id", "ascending"), ("row", "ascending")])
        n = np.asarray(docs["n"])
        by = np.argsort(n, kind="stable")
        size = int(min(1 << place, max(64, ranks // len(names))))
        for at in range(0, len(by), size):
            order = by[at : at + size]
            part = docs.take(pa.array(order))
            lists = pc.split_pattern(part["terms"].combine_chunks(), " ")
            found = pc.index_in(lists.flatten(), value_set=names)
            own = np.asarray(pc.is_valid(found))
            doc, met = np.repeat(np.arange(len(order)), np.asarray(pc.list_value_length(lists)))[own], np.asarray(found.drop_null()).astype(np.int64)
            tf = np.asarray(part["tf"].combine_chunks().flatten())[own]
            m = 75 + 25 * n[order] * documents // length
            impact = weight[met] * (1_000_000_000 * tf // (1000 * tf + 12 * m[doc]))
            best_first(RangeMaxima(len(order), len(names), met, doc, impact), queries, len(order), order, top)
        q, score, order = top.found
        return pa.table({"item": item[q], "item_id": items["item_id"].take(pa.array(first[q])), "doc_id": docs["doc_id"].take(pa.array(order)), "score": score})

    return run


def rank_documents(docs: DataFrame, items: DataFrame, keep: int = 20, cell_items: int = CELL_ITEMS, cell_docs: int = CELL_DOCS) -> DataFrame:
    """``item_id, rank, doc_id, score``: the ``keep`` documents of highest score for each row of ``items``, equal scores by doc_id.

    Terms are runs of letters, digits and characters beyond ASCII, A-Z in lower
    case. With N documents that have terms, L terms in all of them, n in one,
    and df documents that hold a term, its weight w is
    floor(1000 * ln((2N + 2) / (2df + 1))); a document's m is
    75 + 25 * n * N div L, and its score the sum of
    w * (10**9 * tf div (1000 * tf + 12 * m)) over a query's terms, repeats
    included. Scores of 0 have no rank.

    1. One pass over the texts keeps of each document the terms that pass a
       filter of bounded size made of the queries' terms, and counts all.
    2. Documents and queries meet in the cells of a grid, dealt by a hash.
    3. A cell builds posting lists with range-maximum tables of so many
       documents at a time and searches them best first; what it has found
       bounds what it looks at next.
    4. The first of each cell are ranked together.

    Null or empty texts have no terms: never found, and a query without terms
    has no rows. Rows that share an id are documents, or queries, of their own.
    Null doc_id: last among equals. Very long texts are taken whole. Other
    columns are ignored.
    """
    spark = docs.sparkSession
    asked = items.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text"))
    asked = materialize(asked.mapInArrow(_item_terms, "item long, item_id long, term string, times long, slot long"), "queries")
    slots = bytearray(SLOTS)
    for r in asked.select("slot").distinct().toLocalIterator():  # no more than SLOTS
        slots[r.slot] = 1
    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    posted = source.mapInArrow(_postings(spark.sparkContext.broadcast(bytes(slots))), "row long, doc_id long, n long, terms string, tf array<long>")
    posted = materialize(posted.where("n > 0"), "postings")
    documents, length, holding = posted.agg(F.count(F.lit(1)), F.coalesce(F.sum("n"), F.lit(0)), F.count(F.when(F.col("terms") != "", 1))).first()

    df = posted.where("terms <> ''").select(F.explode(F.split("terms", " ")).alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    weight = F.floor(1000 * F.log((2.0 * documents + 2) / (2 * F.col("df") + 1)))
    known = df.join(asked.select("term").distinct(), "term").select("term", weight.cast("long").alias("w"))
    asked = materialize(asked.join(known, "term").select("item", "item_id", "term", "times", "w"), "weighted")

    count = asked.select("item").distinct().count()
    lines = -(-count // cell_items) or 1
    columns = max(-(-holding // cell_docs), int(spark.conf.get("spark.sql.shuffle.partitions")) // lines, 1)

    def dealt(row: str, own: str, n: int, other: str, m: int) -> list[Column]:
        return [F.pmod(F.xxhash64(row), F.lit(n)).cast("int").alias(own), F.explode(F.sequence(F.lit(0), F.lit(m - 1))).alias(other)]

    left = posted.where("terms <> ''").select("*", *dealt("row", "c", columns, "r", lines)).groupBy("r", "c")
    right = asked.select("*", *dealt("item", "r", lines, "c", columns)).groupBy("r", "c")
    found = left.cogroup(right).applyInArrow(_search(keep, documents, length), "item long, item_id long, doc_id long, score long")
    rank = F.row_number().over(Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("doc_id")))
    return found.withColumn("rank", rank).where(F.col("rank") <= keep).select("item_id", "rank", "doc_id", "score")
