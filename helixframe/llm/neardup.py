"""Near-duplicate documents: MinHash with tensored banding, confirmed on full shingle sets."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from helixframe.llm.shingles import mix, shingle_set
from helixframe.operators.graph import connected_components
from helixframe.storage import materialize

#: Half keys per collection, and minima per half key. A table's key is one half key of each collection:
#: 16 * 16 tables from 2 * 16 * 3 minima instead of 16 * 16 * 6. Two sets of similarity s meet in a table
#: with probability (1 - (1 - s^3)^16)^2: 0.9997 at 0.75, 0.99998 at 0.8.
HALVES, MINIMA = 16, 3
#: Shingles that are hashed at once.
_BLOCK = 8192
#: Parts that the members below one leader are dealt into.
PARTS = 16


def half_keys(shingles: np.ndarray, halves: int = HALVES, minima: int = MINIMA) -> np.ndarray:
    """2 * halves keys: the first half of them for one side of the tables, the rest for the other."""
    count = 2 * halves * minima
    seed = mix(np.arange(1, 2 * count + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    times, plus = seed[:count, None] | np.uint64(1), seed[count:, None]
    low = np.full(count, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(shingles), _BLOCK):
        np.minimum(low, (((shingles[at : at + _BLOCK] ^ plus) * times)).min(axis=1), out=low)
    parts = low.reshape(2 * halves, minima)
    key = np.arange(1, 2 * halves + 1, dtype=np.uint64)
    for k in range(minima):
        key = mix(key + parts[:, k])
    return key.view(np.int64)


def _set_id(shingles: np.ndarray) -> bytes:
    return xxhash.xxh3_128_digest(shingles.tobytes())


def _describe(halves: int, minima: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        names = ["row", "doc_id", "n_shingles", "set_id", "half"]
        row = TaskContext.get().partitionId() << 36
        for b in batches:
            size, ids, keys, offsets = [], [], [], [0]
            for text in b.column(1):
                s = shingle_set(text.as_py())
                size.append(len(s))
                if len(s):
                    ids.append(_set_id(s))
                    keys.append(half_keys(s, halves, minima))
                    offsets.append(offsets[-1] + 2 * halves)
                else:
                    ids.append(None)
                    offsets.append(offsets[-1])
            flat = np.concatenate(keys) if keys else np.empty(0, np.int64)
            rows = pa.array(range(row, row + b.num_rows), pa.int64())
            row += b.num_rows
            yield pa.RecordBatch.from_arrays([rows, b.column(0), pa.array(size, pa.int64()), pa.array(ids, pa.binary()), pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(flat))], names)

    return run


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for at in range(0, b.num_rows, 500):
            part = b.slice(at, 500)
            own = [shingle_set(t.as_py()) for t in part.column(1)]
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array([_set_id(s) for s in own], pa.binary()), pa.array([s.tobytes() for s in own], pa.binary())], ["doc_id", "set_id", "shingles"])


def _confirm(percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keep = []
            for x, y in zip(b.column(2), b.column(3), strict=True):
                x, y = np.frombuffer(x.as_py(), np.uint64), np.frombuffer(y.as_py(), np.uint64)
                both = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(100 * both >= percent * (len(x) + len(y) - both))
            yield pa.RecordBatch.from_arrays(b.columns[:2], ["a", "b"]).filter(pa.array(keep))

    return run


def confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose full sets are similar enough."""
    left, right = sets.toDF("a", "x"), sets.toDF("b", "y")
    met = pairs.select("a", "b").join(left, "a").join(right, "b").select("a", "b", "x", "y")
    return met.mapInArrow(_confirm(percent), "a long, b long")


def _private(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lead, a, g, n, m, both, own): sizes of a document and its leader, of their intersection, and the shingles that only the document has."""
    for b in batches:
        both, own = [], []
        for x, y in zip(b.column(4), b.column(5), strict=True):
            x, y = np.frombuffer(x.as_py(), np.uint64), np.frombuffer(y.as_py(), np.uint64)
            rest = np.setdiff1d(x, y, assume_unique=True)
            both.append((len(x), len(y), len(x) - len(rest)))
            own.append(rest.view(np.int64))
        n, m, i = (pa.array(c, pa.int64()) for c in zip(*both, strict=True)) if both else (pa.array([], pa.int64()),) * 3
        yield pa.RecordBatch.from_arrays([*b.columns[:3], n, m, i, pa.array(own, pa.list_(pa.int64()))], ["lead", "a", "g", "n", "m", "both", "own"])


def _meeting(private: DataFrame, percent: int) -> DataFrame:
    """(lead, a, b), once or more: pairs in different components that share a shingle among each side's rarest outside the leader.

    What many members share ranks last among the shingles of each, so it is met
    only by members that have hardly anything else of their own; those are
    alike enough to be in one component by then.
    """
    # one leader may have a large share of all members; copies of a row per leader are more than the planner takes them for
    part = F.pmod(F.xxhash64("a"), F.lit(PARTS))
    # enough shared shingles of their own means a shared one among each side's rarest: all but as many as must be shared, less one
    least = private.groupBy("lead").agg(F.min("n").alias("least_n")).withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(PARTS - 1).cast("long")))).hint("merge")
    owned = private.withColumn("part", part).join(least, ["lead", "part"]).drop("part")
    share = F.ceil(percent * (F.col("n") + F.greatest(F.col("least_n"), F.col("n") * percent / 100)) / (100 + percent)) - F.col("both")
    rows = owned.select("lead", "a", "g", (F.size("own") - F.greatest(share, F.lit(1)) + 1).alias("reach"), F.expr(f"{percent} * (n + m) > {100 + percent} * both").alias("far"), F.explode("own").alias("s"))
    rows = rows.join(rows.groupBy("lead", "s").agg(F.count(F.lit(1)).alias("c")), ["lead", "s"])
    rows = rows.withColumn("rank", F.row_number().over(Window.partitionBy("lead", "a").orderBy("c", "s"))).where("rank <= reach and c > 1")
    others = rows.select("lead", "s", F.col("a").alias("b"), F.col("g").alias("h"), F.col("far").alias("far_b"))
    return rows.select("lead", "s", "a", "g", "far").join(others, ["lead", "s"]).where("a > b and g <> h and (far or far_b)").select("lead", "a", "b")


def _across(entries: DataFrame, groups: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Pairs that may still be linked although no leader joins them.

    x and y stand below the same leader L in different components, so one of
    them, say x, is not linked with L. Being linked takes an intersection of
    need = percent * (|x| + |y|) / (100 + percent). Without a shared shingle
    outside L the intersection is at most min(|x & L|, |y & L|), so a pair
    either shares shingles outside L, enough of them, or has
    min(|x & L|, |y & L|) >= need, which happens only where |y| < |L|. Copies of
    one text differ from a middling copy in shingles of their own, so either
    way few pairs are left however large the group is.
    """
    member = entries.join(groups, "a")
    mixed = member.groupBy("entry").agg(F.min("g").alias("low"), F.max("g").alias("high")).where("low < high").select("entry")
    below = member.join(mixed, "entry", "left_semi").where("a <> b").select(F.col("b").alias("lead"), "a", "g").distinct()
    met = below.join(sets.toDF("a", "x"), "a").join(sets.toDF("lead", "y"), "lead").select("lead", "a", "g", "x", "x", "y").toDF("lead", "a", "g", "z", "x", "y")
    private = materialize(met.mapInArrow(_private, "lead long, a long, g long, n long, m long, both long, own array<long>"), "private")
    need = f"{percent} * (n + k) <= {100 + percent} * "
    met = _meeting(private, percent).distinct()
    one = private.select("lead", "a", "n", "both", "own")
    sharing = met.join(one, ["lead", "a"]).join(one.toDF("lead", "b", "k", "i", "other"), ["lead", "b"])
    sharing = sharing.where(need + "(least(both, i) + size(array_intersect(own, other)))").select("a", "b")
    far = private.where(f"{percent} * (n + m) > {100 + percent} * both")
    near = private.where("n < m").select("lead", F.col("a").alias("b"), F.col("g").alias("h"), F.col("n").alias("k"), F.col("both").alias("i"))
    part = F.pmod(F.xxhash64("a"), F.lit(PARTS))
    smallest = near.groupBy("lead").agg(F.min("k").alias("least_k")).withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(PARTS - 1).cast("long")))).hint("merge")
    far = far.withColumn("part", part).join(smallest, ["lead", "part"]).drop("part").where(f"{percent} * (n + least_k) <= {100 + percent} * both")
    direct = far.join(near, "lead").where("a <> b and g <> h and " + need + "least(both, i)").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    return sharing.unionAll(direct).distinct()


def near_duplicates(docs: DataFrame, percent: int = 75, halves: int = HALVES, minima: int = MINIMA) -> DataFrame:
    """``doc_id, n_shingles, component_id, kept`` for every row of ``docs``.

    Documents are linked if 100 * intersection >= percent * union of their
    5-word shingle sets; component_id is the smallest doc_id reachable, and the
    document with that id is kept.

    1. Rows with equal sets form a class; only its first row goes on.
    2. A half key counts only if two classes share it. Each class's shared
       half keys of both sides are combined into table keys.
    3. In each table entry the member whose half keys are shared most leads. A
       class is confirmed against one of its leaders first, then against those
       of its other leaders that lie in another component, and at last against
       the members below the same leader that ``_across`` leaves. So a large
       group of copies costs a few pairs per copy and loses no link.

    Null or blank text: empty set, linked with nothing. Rows that share a
    doc_id are one document. Null doc_id: linked with nothing, component null,
    kept. Each input row gives one row. Other columns are ignored.
    """
    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    told = materialize(source.mapInArrow(_describe(halves, minima), "row long, doc_id long, n_shingles long, set_id binary, half array<long>"), "sets")
    alive = told.where("set_id is not null and doc_id is not null")
    classes = alive.groupBy("set_id").agg(F.min("row").alias("a"), F.min("doc_id").alias("doc"), F.min_by("half", "row").alias("half"))
    classes = materialize(classes, "classes")

    side = F.posexplode("half").alias("i", "half")
    halved = classes.select("a", side)
    shared = halved.groupBy("half").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    halved = halved.join(shared, "half")
    first, second = F.when(F.col("i") < halves, F.col("half")), F.when(F.col("i") >= halves, F.col("half"))
    sides = halved.groupBy("a").agg(F.collect_list(first).alias("x"), F.collect_list(second).alias("y"), F.sum("n").alias("weight"))
    entries = sides.select("a", "weight", F.explode("x").alias("x"), "y").select("a", "weight", "x", F.explode("y").alias("y")).select("a", "weight", F.xxhash64("x", "y").alias("entry"))
    leaders = entries.groupBy("entry").agg(F.max(F.struct("weight", F.negative("a").alias("a"))).alias("top"), F.min("a").alias("y"), F.max("a").alias("z")).where("z > y").select("entry", F.negative("top.a").alias("b"), F.col("top.weight").alias("top"))
    entries = materialize(entries.drop("weight").join(leaders, "entry"), "entries")
    pairs = materialize(entries.where("a <> b").groupBy("a", "b").agg(F.max("top").alias("top")), "pairs")

    wanted = entries.select("a").distinct()
    fetched = classes.select("a", "doc", "set_id").join(wanted, "a", "left_semi")
    texts = source.join(fetched.select(F.col("doc").alias("doc_id")), "doc_id", "left_semi").dropDuplicates(["doc_id", "text"])
    found = texts.mapInArrow(_sets, "doc_id long, set_id binary, shingles binary").dropDuplicates(["doc_id", "set_id"])
    sets = materialize(found.join(fetched.withColumnRenamed("doc", "doc_id"), ["doc_id", "set_id"]).select("a", "shingles"), "shingles")

    first_pairs = pairs.groupBy("a").agg(F.max_by("b", F.struct("top", "b")).alias("b"))
    links = materialize(confirmed(first_pairs, sets, percent), "links")
    tried = first_pairs
    groups = _components(wanted, links)
    # other leaders, where the first round has not joined the two
    rest = _apart(pairs, groups).join(tried, ["a", "b"], "left_anti")
    more = materialize(confirmed(rest, sets, percent), "links")
    if not more.isEmpty():
        links = links.unionAll(more)
        groups = _components(wanted, links)
    across = _across(entries, groups, sets, percent).join(pairs, ["a", "b"], "left_anti")
    last = materialize(confirmed(across, sets, percent), "links")
    if not last.isEmpty():
        links = links.unionAll(last)

    # the planner takes a few columns of a written table for smaller than they are: no broadcasts of all classes
    same = alive.join(classes.select("set_id", "doc").hint("merge"), "set_id").where("doc_id <> doc").select(F.col("doc_id").alias("src"), F.col("doc").alias("dst"))
    # rows that share a doc_id but not a text hold their classes together
    doc = classes.select("a", "doc").hint("merge")
    between = links.join(doc.toDF("a", "src"), "a").join(doc.toDF("b", "dst"), "b").where("src <> dst").select("src", "dst")
    found = connected_components(materialize(between.unionAll(same).distinct(), "edges"))
    out = told.select("doc_id", "n_shingles").join(found.withColumnRenamed("node", "doc_id"), "doc_id", "left")
    component = F.coalesce("component", "doc_id")
    return out.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"))


def _components(nodes: DataFrame, links: DataFrame) -> DataFrame:
    """(a, g): the component of each node, itself if it has no link."""
    found = connected_components(links, "a", "b").toDF("a", "g")
    return materialize(nodes.join(found, "a", "left").select("a", F.coalesce("g", "a").alias("g")), "groups")


def _apart(pairs: DataFrame, groups: DataFrame) -> DataFrame:
    """The pairs whose ends lie in different components."""
    return pairs.join(groups, "a").join(groups.toDF("b", "h"), "b").where("g <> h").select("a", "b")
