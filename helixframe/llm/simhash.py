"""Near-duplicate documents: SimHash fingerprints compared bit plane by bit plane."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from helixframe.llm.shingles import words
from helixframe.operators.graph import connected_components
from helixframe.storage import materialize

WIDTH, SEED, RADIUS, BITS = 3, 42, 3, 64
#: Fingerprints that are compared with one another in one step, and rows of a band value beyond which further bits divide it.
PART, DIVIDE = 2048, 8192
#: Bits of a band: 2 ** 16 values, so that the table of values with many fingerprints has a bound.
BAND = 16
#: A fingerprint that so large a share of the rows has is looked up in a broadcast table; there are no more than this many.
FREQUENT = 4096
_QUERIES, _WORDS, _HASHED = 128, 16, 65536
_ALL = np.uint64(0xFFFFFFFFFFFFFFFF)


def fingerprint(text: str | None) -> int:
    """64 bits, each set if it is in over half of the hashes of the text's shingles; 0 without words."""
    own = words(text) if text else []
    if not own:
        return 0
    whole = b" ".join(own)
    ends = np.cumsum(np.array([len(w) for w in own]) + 1) - 1
    starts = np.r_[0, ends[:-1] + 1]
    used = min(WIDTH, len(own))
    digest = xxhash.xxh64_intdigest
    spans = zip(starts[: len(own) - used + 1].tolist(), ends[used - 1 :].tolist(), strict=True)
    h = np.fromiter((digest(whole[a:b], SEED) for a, b in spans), np.uint64, len(own) - used + 1)
    ones = np.zeros(BITS, np.int64)
    for at in range(0, len(h), _HASHED):
        ones += np.unpackbits(h[at : at + _HASHED].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(h), bitorder="little").view(np.uint64)[0])


def _fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        own = np.array([fingerprint(t.as_py()) for t in b.column(1)], np.uint64)
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array(own.view(np.int64))], ["doc_id", "fp"])


def vertical(prints: np.ndarray) -> np.ndarray:
    """(64, n / 64): word w of plane b has bit b of the fingerprints 64w to 64w + 63."""
    bits = np.unpackbits(prints.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    wide = np.zeros((BITS, -(-len(prints) // 64) * 64), np.uint8)
    wide[:, : len(prints)] = bits.T
    return np.packbits(wide, axis=1, bitorder="little").view(np.uint64)


def _carry_save(a: np.ndarray, b: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    u = a ^ b
    return u ^ c, (a & b) | (u & c)


def within(queries: np.ndarray, planes: np.ndarray, radius: int = RADIUS) -> tuple[np.ndarray, np.ndarray]:
    """(indices of queries, words): bit i of word w is set if fingerprint 64w + i differs from the query in ``radius`` bits or fewer.

    The distances of all fingerprints are counted at once in bit-sliced
    counters that carry-save adders update, eight planes at a time; a query
    is done with the block as soon as all of its distances exceed the radius.
    Planes that divide the block most evenly come first. The bits of fingerprints
    that fill up the last word are of no meaning.
    """
    level = max(1, radius.bit_length())
    even = np.abs(np.bitwise_count(planes).sum(axis=1, dtype=np.int64) - planes.shape[1] * 32)
    order = np.argsort(even, kind="stable")
    alive = np.arange(len(queries))
    shape = (len(queries), planes.shape[1])
    counts, over = [np.zeros(shape, np.uint64) for _ in range(level)], np.zeros(shape, np.uint64)
    for at in range(0, BITS, 8):
        own = queries[alive]
        fed = [planes[p] ^ np.where(own >> np.uint64(p) & np.uint64(1), _ALL, np.uint64(0))[:, None] for p in order[at : at + 8]]
        for k in range(level):
            carried = []
            for i in range(0, len(fed), 2):
                counts[k], carry = _carry_save(counts[k], fed[i], fed[i + 1] if i + 1 < len(fed) else np.uint64(0))
                carried.append(carry)
            fed = carried
        for carry in fed:
            over = over | carry
        # beyond the radius: the counter's bits, from the top, exceed those of the radius
        above, same = over, ~over
        for k in reversed(range(level)):
            if radius >> k & 1:
                same = same & counts[k]
            else:
                above, same = above | (same & counts[k]), same & ~counts[k]
        keep = (above != _ALL).any(axis=1)
        if not keep.all():
            alive, over, above, counts = alive[keep], over[keep], above[keep], [c[keep] for c in counts]
            if not len(alive):
                break
    return alive, ~above


def spanning_links(prints: np.ndarray, radius: int = RADIUS, group: np.ndarray | None = None, side: np.ndarray | None = None) -> np.ndarray:
    """(m, 2) places: links that join all that links of at most ``radius`` bits join, and no more of them than are needed.

    ``group``: rows of one group count as joined. ``side``: if rows of both
    sides 0 and 1 are there, only links between the sides are looked for.
    """
    n = len(prints)
    top = np.arange(n)
    if group is not None:
        _, first, back = np.unique(group, return_index=True, return_inverse=True)
        top = first[back]
    found: list[tuple[int, int]] = []
    cross = side is not None and side.any()
    ask, against = (np.flatnonzero(side == 0), np.flatnonzero(side == 1)) if cross else (np.arange(n), np.arange(n))

    def settle() -> None:
        nonlocal top
        while not np.array_equal(up := top[top], top):
            top = up

    def join(a: np.ndarray, b: np.ndarray) -> None:
        for x, y in zip(a.tolist(), b.tolist(), strict=True):
            u, v = x, y
            while top[u] != u:
                u = top[u]
            while top[v] != v:
                v = top[v]
            if u != v:
                top[max(u, v)] = min(u, v)
                found.append((x, y))
        settle()

    for at in range(0, len(ask), _QUERIES):
        chunk = ask[at : at + _QUERIES]
        largest = np.bincount(top, minlength=n).argmax()
        # what is in the largest component needs no look at the rest of it
        for own, rest in ((chunk[top[chunk] == largest], against[top[against] != largest]), (chunk[top[chunk] != largest], against)):
            rest = rest if cross else rest[rest > at]
            for r in range(0, len(rest), 64 * _WORDS) if len(own) else ():
                part = rest[r : r + 64 * _WORDS]
                alive, mask = within(prints[own], vertical(prints[part]), radius)
                hit = np.unpackbits(mask.view(np.uint8), axis=1, bitorder="little")[:, : len(part)].astype(bool)
                hit &= top[own[alive]][:, None] != top[part]
                met = hit.any(axis=0)
                if not met.any():
                    continue
                # one link to each first, then one between any two groups that are still apart
                join(own[alive[hit[:, met].argmax(axis=0)]], part[met])
                q, j = np.nonzero(hit & (top[own[alive]][:, None] != top[part]))
                _, once = np.unique(top[own[alive[q]]] * n + top[part[j]], return_index=True)
                join(own[alive[q[once]]], part[j[once]])
    return np.array(found, np.int64).reshape(-1, 2)


def _links(radius: int):
    """Links (a, b) among rows (key, i, j, side, grp, fp, doc) that come in the order of key, i, j.

    Small groups share a step: a link between rows of two of them is as good as any.
    """

    def of(t: pa.Table) -> pa.RecordBatch:
        prints, doc = np.asarray(t["fp"]).view(np.uint64), t["doc"].combine_chunks()
        side, group = np.asarray(t["side"]), np.asarray(t["grp"])
        pairs = spanning_links(prints, radius, group, side)
        return pa.RecordBatch.from_arrays([doc.take(pa.array(pairs[:, 0])), doc.take(pa.array(pairs[:, 1]))], ["a", "b"])

    def run(batches: Iterator[pa.RecordBatch | None]) -> Iterator[pa.RecordBatch]:
        held: pa.Table | None = None
        for b in chain(batches, [None]):
            if b is not None:
                own = pa.Table.from_batches([b])
                held = own if held is None else pa.concat_tables([held, own])
                if held.num_rows < PART:
                    continue
            elif held is None or not held.num_rows:
                return
            held = held.combine_chunks()
            key, i, j, side = (np.asarray(held[c]) for c in ("key", "i", "j", "side"))
            starts = np.r_[0, np.flatnonzero((key[1:] != key[:-1]) | (i[1:] != i[:-1]) | (j[1:] != j[:-1])) + 1]
            crossed = np.maximum.reduceat(side, starts)
            ends, at = np.r_[starts[1:], held.num_rows].tolist(), 0
            for low, high, apart in list(zip(starts.tolist(), ends, crossed.tolist(), strict=True))[: None if b is None else -1]:  # the last group may go on
                if low > at and (apart or high - at > PART):
                    yield of(held.slice(at, low - at))
                    at = low
                if apart:
                    yield of(held.slice(low, high - low))
                    at = high
            if b is None and at < held.num_rows:
                yield of(held.slice(at))
            held = held.slice(at)

    return run


def _bands(radius: int, bits: int, width: int) -> list[tuple[int, int]]:
    """(lowest bit, bits) of radius + 1 bands: fingerprints within the radius are equal in one of them at least."""
    each = bits // (radius + 1)
    return [(k * each, min(each, width)) for k in range(radius + 1)]


def _field(value: Column, low: int, width: int) -> Column:
    return F.shiftrightunsigned(value, low).bitwiseAND(F.lit((1 << width) - 1).cast("long"))


def _keys(fp: Column, radius: int) -> tuple[Column, Column]:
    """Array of the band values of a fingerprint, and array of those with a band of the other bits each. Keys of the second kind are negative."""
    one, two = [], []
    for k, (low, width) in enumerate(_bands(radius, BITS, BAND)):
        turned = F.shiftrightunsigned(fp, low).bitwiseOR(F.shiftleft(fp, BITS - low)) if low else fp
        band = _field(turned, 0, width) + F.lit(k << BAND).cast("long")
        one.append(band)
        for j, (at, wide) in enumerate(_bands(radius, BITS - width, BAND)):
            two.append(F.negative((band * (radius + 1) + j) * (1 << BAND) + _field(turned, width + at, wide) + 1))
    return F.array(*one), F.array(*two)


def _beside(rows: DataFrame, table: DataFrame, how: str) -> DataFrame:
    """Rows with what a table of one row for each of some keys says; the rows of a key are dealt into parts."""
    salt = F.pmod(F.xxhash64("fp"), F.lit(16))
    spread = table.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(15).cast("long"))))
    return rows.withColumn("salt", salt).join(spread, ["key", "salt"], how).drop("salt")


def _found(cells: DataFrame, radius: int) -> DataFrame:
    rows = cells.select("key", F.col("i").cast("int").alias("i"), F.col("j").cast("int").alias("j"), F.col("side").cast("int").alias("side"), "grp", "fp", "doc")
    return materialize(rows.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j").mapInArrow(_links(radius), "a long, b long"), "links")


def _all_links(classes: DataFrame, radius: int, part: int, divide: int) -> DataFrame:
    """(a, b): links that join what fingerprints of at most ``radius`` differing bits join. ``classes``: fp, doc."""
    one, two = _keys(F.col("fp"), radius)
    keyed = classes.select("fp", "doc", F.explode(one).alias("key"))
    # no more than (radius + 1) * 2 ** BAND rows
    large = keyed.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > divide).select("key", F.lit(True).alias("large"))
    marked = keyed.join(F.broadcast(large), "key", "left")
    below = F.filter(two, lambda k: F.floor(F.floor((F.negative(k) - 1) / (1 << BAND)) / (radius + 1)) == F.col("key"))
    keyed = marked.where("large is null").select("key", "fp", "doc").unionAll(marked.where("large").select(F.explode(below).alias("key"), "fp", "doc"))
    keyed = materialize(keyed, "keyed")
    parts = materialize(keyed.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > part).select("key", F.ceil(F.col("n") / part).alias("parts")), "dense")

    # each fingerprint beside those of its part of a key, and beside the key's first part
    own = _beside(keyed, parts, "left").withColumn("i", F.coalesce(F.pmod(F.xxhash64("fp", F.lit(7)), F.col("parts")), F.lit(0)))
    guests = own.where("i = 0 and parts > 1").withColumn("i", F.explode(F.sequence(F.lit(1).cast("long"), F.col("parts") - 1)))
    links = _found(own.unionByName(guests).selectExpr("key", "i", "0 as j", "0 as side", "doc as grp", "fp", "doc"), radius)
    if parts.isEmpty():
        return links

    # then what is outside a key's largest group beside everything of the key; the largest group is joined by now
    groups = connected_components(links, "a", "b").toDF("doc", "grp")
    rows = _beside(keyed, parts.select("key"), "inner").join(groups, "doc", "left").withColumn("grp", F.coalesce("grp", "doc"))
    rows = materialize(rows.select("key", "fp", "doc", "grp"), "dense")
    count = rows.groupBy("key", "grp").agg(F.count(F.lit(1)).alias("n"))
    shape = count.groupBy("key").agg(F.max(F.struct("n", "grp")).alias("most"), F.sum("n").alias("all"))
    shape = shape.selectExpr("key", "if(most.n > 1, most.grp, null) as largest", f"ceil((all - if(most.n > 1, most.n, 0)) / {part}) as others", f"if(most.n > 1, ceil(most.n / {part}), 0) as members")
    rows = _beside(rows, shape, "inner").where("others > 0").withColumn("inside", F.expr("coalesce(grp = largest, false)"))
    rows = rows.withColumn("p", F.expr("pmod(xxhash64(fp, 11), if(inside, members, others))"))
    cells = F.expr(
        """if(inside, transform(sequence(0L, others - 1), x -> struct(x as i, others + p as j, 1 as side)), concat(
        transform(sequence(p, others - 1), x -> struct(p as i, x as j, 0 as side)),
        if(p > 0, transform(sequence(0L, p - 1), x -> struct(x as i, p as j, 1 as side)), array()),
        if(members > 0, transform(sequence(others, others + members - 1), x -> struct(p as i, x as j, 0 as side)), array())))"""
    )
    spread = rows.select("key", "grp", "fp", "doc", F.explode(cells).alias("cell")).select("key", "cell.i", "cell.j", "cell.side", "grp", "fp", "doc")
    return links.unionAll(_found(spread, radius))


def near_duplicates_by_fingerprint(docs: DataFrame, radius: int = RADIUS, part: int = PART, divide: int = DIVIDE) -> DataFrame:
    """``doc_id, fingerprint, component_id`` for every row of ``docs``.

    Words are lower-cased (A-Z) and taken three at a time, repeats included;
    fewer words are one shingle, none at all give fingerprint zero. Rows whose
    fingerprints differ in ``radius`` bits or fewer are linked; component_id is
    the smallest doc_id reachable.

    1. Rows of one fingerprint form a class, of which one row goes on.
    2. Fingerprints that are close agree in one of radius + 1 bands. The
       classes of a band value are compared in parts, bit plane by bit plane;
       values with more than ``divide`` classes are divided by a band of the
       other bits first. Small values share a part.
    3. A value of several parts: each part is compared with itself and with the
       first one, which joins the greater share of any large family of copies.
       Then all outside the largest group of the value are compared with all of
       it. Parts return links that hold together what is linked, not all pairs.

    Null or blank text: fingerprint zero, linked like any other. Rows that
    share a doc_id are one document. Null doc_id: linked with nothing,
    component null. Each input row gives one row. Very long texts are hashed
    in blocks. Other columns are ignored.
    """
    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    told = materialize(source.mapInArrow(_fingerprints, "doc_id long, fp long"), "prints")
    named = told.where("doc_id is not null")
    classes = materialize(named.groupBy("fp").agg(F.min("doc_id").alias("doc"), F.count(F.lit(1)).alias("n")), "classes")
    links = _all_links(classes.select("fp", "doc"), radius, part, divide)

    # rows that share a doc_id but not a fingerprint hold their classes together
    several = named.groupBy("doc_id").agg(F.min("fp").alias("low"), F.max("fp").alias("high")).where("low < high").select("doc_id", "low")
    held = named.join(several, "doc_id").where("fp <> low").select("fp", "low").distinct()
    one = classes.select("fp", "doc")
    held = held.join(one.toDF("fp", "a"), "fp").join(one.toDF("low", "b"), "low").select("a", "b")
    found = connected_components(materialize(links.unionAll(held).where("a <> b"), "edges"), "a", "b").toDF("doc", "component_id")
    known = materialize(classes.join(found, "doc", "left").select("fp", "n", F.coalesce("component_id", "doc").alias("component_id")), "known")

    # a fingerprint with a large share of all rows: at most FREQUENT of them, so the table has a bound
    total = known.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    often = F.col("n") * FREQUENT > total
    met = named.join(F.broadcast(known.where(often).drop("n")), "fp", "left")
    rest = met.where("component_id is null").drop("component_id").join(known.where(~often).drop("n"), "fp")
    rows = met.where("component_id is not null").unionByName(rest).unionByName(told.where("doc_id is null").withColumn("component_id", F.lit(None).cast("long")))
    return rows.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
