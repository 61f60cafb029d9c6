"""Benchmark passages in documents: CGK embedding, bit-sampling LSH and exact edit distances over words."""

from __future__ import annotations

import re
import sys
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from helixframe.llm.shingles import mix

#: Items that are searched for in one pass over the documents.
BLOCK = 1024
#: A word is rare if so many items of a block hold it at most.
RARE = 4
#: Random walks, keys sampled from each, and embedded positions in a key, for items of up to SHORT words. Walks drift
#: apart with every edit, so longer items have KEYS_LONG keys a walk and a walk more for each STEP words. For windows
#: within the default rate of an item, tests measure a recall above 0.95; windows equal to an item always meet it.
WALKS, KEYS, SAMPLED = 8, 8, 3
SHORT, KEYS_LONG, STEP = 60, 32, 48
#: Shorter items are looked up exactly: their words are in common with anything.
LEAST_WORDS = 8
#: Bytes of text whose words are looked up at once, and words of windows that meet the tables at once.
CHUNK, WINDOW_WORDS = 1 << 21, 1 << 21
_EDGE = re.compile(r"^[\W_]+|[\W_]+\Z")
#: Base of the polynomial hash of words, and its inverse, modulo 2^64.
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
#: Code points that stand for words when word sequences are compared as strings.
_FIRST_CODE, _OTHER = 0x10000, "\x01"


def item_words(text: str | None) -> list[str]:
    """Lower-case words without leading and trailing punctuation; words of punctuation only are left out."""
    return [w for w in (_EDGE.sub("", w) for w in (text or "").lower().split()) if w]


@lru_cache(maxsize=1)
def _classes() -> np.ndarray:
    """By code point: 0 white space, 1 letters and digits, 2 others."""
    out = np.full(sys.maxunicode + 1, 2, np.uint8)
    for c in range(sys.maxunicode + 1):
        own = chr(c)
        if own.isalnum():
            out[c] = 1
        elif own.isspace():
            out[c] = 0
    return out


@lru_cache(maxsize=2)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of the base and of its inverse."""
    base, inverse = np.full(n, _BASE, np.uint64), np.full(n, _INVERSE, np.uint64)
    base[0] = inverse[0] = 1
    return np.cumprod(base), np.cumprod(inverse)


def word_hashes(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Place and hash of each word of ``item_words``, for a text in lower case."""
    c = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")
    if not len(c):
        return np.empty(0, np.int64), np.empty(0, np.uint64)
    kind = _classes()[c]
    power, inverse = _powers(max(CHUNK, 1 << (len(c) - 1).bit_length()))
    total = np.zeros(len(c) + 1, np.uint64)
    np.cumsum((c + np.uint32(1)) * power[: len(c)], out=total[1:])
    solid = np.concatenate([[False], kind != 0, [False]])
    edge = np.flatnonzero(solid[1:] != solid[:-1])
    start, end = edge[::2], edge[1::2]
    # the first and last letter or digit of each; words without one are left out
    at = np.flatnonzero(kind == 1)
    before = np.zeros(len(c) + 1, np.int64)
    np.cumsum(kind == 1, out=before[1:])
    i, j = before[start], before[end]
    start, i, j = start[j > i], i[j > i], j[j > i]
    first, last = at[i], at[j - 1] + 1
    return start, mix((total[last] - total[first]) * inverse[first] + (last - first).astype(np.uint64))


class Lookup:
    """Ids of the words of items by hash; -1 for other words."""

    def __init__(self, known: dict[str, int]):
        words = sorted(known)
        key = np.array([word_hashes(w)[1][0] for w in words], np.uint64)
        order = np.argsort(key)
        self.key, self.id = key[order], np.array([known[w] for w in words], np.int64)[order]

    def _flat(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        at, h = word_hashes(text)
        if not len(self.key):
            return at, np.full(len(h), -1, np.int64)
        place = np.minimum(np.searchsorted(self.key, h), len(self.key) - 1)
        return at, np.where(self.key[place] == h, self.id[place], -1)

    def ids(self, texts: list[str]) -> list[np.ndarray]:
        """For each text the ids of its words."""
        low = [t.lower() for t in texts]
        if len(low) == 1:
            return [np.concatenate([self._flat(part)[1] for part in _pieces(low[0])])]
        at, flat = self._flat("\n".join(low))
        size = np.array([len(t) + 1 for t in low])
        return np.split(flat, np.searchsorted(at, np.cumsum(size)[:-1]))


def _pieces(text: str) -> Iterator[str]:
    """A long text in parts that end at blanks."""
    at = 0
    while len(text) - at > CHUNK:
        cut = text.find(" ", at + CHUNK)
        if cut < 0:
            break
        yield text[at:cut]
        at = cut
    yield text[at:]


def embed(seqs: np.ndarray, walks: int, steps: int) -> np.ndarray:
    """CGK: walk along each row, writing the current symbol at each step and going on at a random bit of step and symbol. (steps, walks, rows)"""
    rows, n = seqs.shape
    padded = np.concatenate([seqs, np.full((rows, 1), -3, seqs.dtype)], axis=1).ravel()
    line = np.arange(rows) * (n + 1)
    at = np.zeros((walks, rows), np.int64)
    out = np.empty((steps, walks, rows), np.uint64)
    seed = mix(np.arange(1, steps + 1, dtype=np.uint64)[:, None] + np.uint64(1_000_003) * np.arange(1, walks + 1, dtype=np.uint64))
    for step in range(steps):
        symbol = padded[line + at].view(np.uint64)
        out[step] = symbol
        at += ((mix(symbol + seed[step][:, None]) >> np.uint64(17)) & np.uint64(1)).view(np.int64)
        np.minimum(at, n, out=at)
    return out


def tables(n: int) -> tuple[int, int]:
    """Walks, and keys from each, for items of n words."""
    return (WALKS, KEYS) if n <= SHORT else (WALKS + (n - SHORT) // STEP, KEYS_LONG)


@lru_cache(maxsize=4096)
def _sampled(n: int, walks: int, keys: int, sampled: int) -> np.ndarray:
    """Positions of the embedding in each key: (walks, keys, sampled). The walk ends after about 2n steps; later positions are alike for all rows."""
    return np.array([[np.random.default_rng([n, walk, k]).choice(2 * n - n // 4, sampled, replace=False) for k in range(keys)] for walk in range(walks)])


def table_keys(seqs: np.ndarray, walks: int | None = None, keys: int | None = None, sampled: int = SAMPLED) -> np.ndarray:
    """A row of keys for each table: sampled positions of an embedding. As many walks and keys as ``tables`` says, unless given."""
    n = seqs.shape[1]
    walks, keys = walks or tables(n)[0], keys or tables(n)[1]
    steps = 2 * n - n // 4
    out = embed(seqs, walks, steps)
    key = np.repeat(np.arange(17, 17 + walks * keys, dtype=np.uint64), len(seqs)).reshape(walks, keys, len(seqs))
    for p in np.moveaxis(_sampled(n, walks, keys, sampled), 2, 0):
        key = mix(key + out[p, np.arange(walks)[:, None]])
    return key.reshape(walks * keys, len(seqs))


def exact_keys(seqs: np.ndarray) -> np.ndarray:
    """One key per row: all of its words in order."""
    key = np.full(len(seqs), 17, np.uint64)
    for p in range(seqs.shape[1]):
        key = mix(key + seqs[:, p].astype(np.int64).view(np.uint64))
    return key


class Short:
    """Items of too few words to be searched for by edits, by their exact word sequences."""

    def __init__(self, items: list[tuple[int, list[str]]]):
        self.known: dict[str, int] = {}
        own = [(i, [self.known.setdefault(x, len(self.known)) for x in w]) for i, w in sorted(items)]
        if len(self.known) > 0x10FFFF - _FIRST_CODE:
            raise ValueError("too many different words in a block of items")
        self.lookup = Lookup(self.known)
        self.tables = {}
        for n in sorted({len(w) for _, w in own}):
            same = [(i, w) for i, w in own if len(w) == n]
            key = exact_keys(np.array([w for _, w in same], np.int64))
            order = np.argsort(key, kind="stable")
            self.tables[n] = (key[order], [same[k] for k in order])

    def find(self, ids: np.ndarray) -> Iterator[tuple[int, int, list[int]]]:
        """Item, its first place in a document, and its words."""
        odd = np.cumsum(np.concatenate([[0], ids < 0]))
        for n, (have, items) in self.tables.items():
            at = np.flatnonzero(odd[n:] == odd[:-n]) if len(ids) >= n else np.zeros(0, np.int64)
            if not len(at):
                continue
            seqs = ids[at[:, None] + np.arange(n)]
            key, first = np.unique(exact_keys(seqs), return_index=True)
            left, right = np.searchsorted(have, key, "left"), np.searchsorted(have, key, "right")
            for k in np.flatnonzero(right > left):
                own = seqs[first[k]].tolist()
                for i, words in items[left[k] : right[k]]:
                    if words == own:
                        yield i, int(at[first[k]]), own


class Items:
    """A block of items by their number of words, with their table keys and an index of their rare words.

    A window within d word edits of an item holds all but d of the item's
    distinct rare words; ``least`` says how many those are.
    """

    def __init__(self, items: list[tuple[int, list[str]]], rate: float):
        self.known: dict[str, int] = {}
        items = sorted(items, key=lambda x: (len(x[1]), x[0]))
        own = [np.array([self.known.setdefault(x, len(self.known)) for x in w], np.int64) for _, w in items]
        if len(self.known) > 0x10FFFF - _FIRST_CODE:
            raise ValueError("too many different words in a block of items")
        self.ids = np.array([i for i, _ in items], np.int64)
        self.size = np.array([len(w) for w in own], np.int64)
        self.allowed = (rate * self.size).astype(np.int64)
        self.codes = ["".join(map(code, w)) for w in own]
        self.lookup = Lookup(self.known)
        self.tables = {}
        for n in np.unique(self.size):
            at = np.flatnonzero(self.size == n)
            keys = table_keys(np.array([own[i] for i in at]))
            # a key differs from table to table, so one sorted list holds them all
            order = np.argsort(keys, axis=None, kind="stable")
            self.tables[int(n)] = (keys.ravel()[order], np.tile(at, len(keys))[order])
        # rare words: for word w the items holders[first[w]:first[w + 1]]
        pairs = [(w, i) for i, ws in enumerate(own) for w in np.unique(ws).tolist()]
        df = np.bincount([w for w, _ in pairs], minlength=len(self.known) + 2)
        pairs = sorted(x for x in pairs if df[x[0]] <= RARE)
        self.holders = np.array([i for _, i in pairs], np.int64)
        # id -1 indexes the empty place at the end
        self.count = np.bincount([w for w, _ in pairs], minlength=len(self.known) + 2)
        self.first = np.cumsum(self.count) - self.count
        self.least = np.bincount(self.holders, minlength=len(items)) - self.allowed


def code(word: int) -> str:
    return chr(_FIRST_CODE + word) if word >= 0 else _OTHER


def _runs(low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The numbers of all ranges low..high (inclusive), and which range each is from."""
    size = np.maximum(0, high - low + 1)
    which = np.repeat(np.arange(len(low)), size)
    return np.repeat(low - np.cumsum(size) + size, size) + np.arange(size.sum()), which


def _windows(block: Items, ids: list[np.ndarray]) -> dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """By number of words: document numbers, starts and words of the windows that may be close to an item.

    Such a window has at most the allowed number of words of no item, and holds
    enough of one item's rare words. Both follow from the edit distance, so
    nothing is lost. Windows may reach past the end of a document.
    """
    reach = int(block.size.max(initial=0))
    pad = np.full(reach, -1, np.int64)
    flat = np.concatenate([x for own in ids for x in (own, pad)])
    length = np.array([len(own) for own in ids])
    base = np.cumsum(length + reach) - length - reach
    doc_of = np.repeat(np.arange(len(ids)), length + reach)
    # each rare word in place, with each of its items
    at = np.flatnonzero(block.count[flat])
    many = block.count[flat[at]]
    item = block.holders[np.repeat(block.first[flat[at]] - np.cumsum(many) + many, many) + np.arange(many.sum())]
    at = np.repeat(at, many)
    key = doc_of[at] * len(block.ids) + item
    # (document, item) pairs with enough distinct rare words
    distinct = np.unique(key * (len(block.known) + 1) + flat[at])
    pair, n = np.unique(distinct // (len(block.known) + 1), return_counts=True)
    pair = pair[n >= np.maximum(1, block.least[pair % len(block.ids)])]
    keep = np.isin(key, pair)
    order = np.lexsort((at[keep], key[keep]))
    at, key = at[keep][order], key[keep][order]
    # from each occurrence on, the one with which the window holds enough
    item = key % len(block.ids)
    last = np.arange(len(at)) + np.maximum(1, block.least[item]) - 1
    fits = last < len(at)
    fits[fits] = key[last[fits]] == key[fits]
    low = at[last[fits]] - block.size[item[fits]] + 1
    high, item, doc = at[fits], item[fits], doc_of[at[fits]]
    low = np.maximum(low, base[doc])
    start, which = _runs(low, high)
    size, doc, allowed = block.size[item[which]], doc[which], block.allowed[item[which]]
    # items with few rare words may be anywhere
    for i in np.flatnonzero(block.least < 1):
        own, w = _runs(base, base + length - 1)
        start, doc = np.concatenate([start, own]), np.concatenate([doc, w])
        size, allowed = np.concatenate([size, np.full(len(own), block.size[i])]), np.concatenate([allowed, np.full(len(own), block.allowed[i])])
    odd = np.cumsum(np.concatenate([[0], flat < 0]))
    near = np.flatnonzero((start + size < len(odd)) & (odd[np.minimum(start + size, len(odd) - 1)] - odd[start] <= allowed))
    out = {}
    for n in np.unique(size[near]):
        own = np.unique(start[near][size[near] == n])
        out[int(n)] = (doc_of[own], own - base[doc_of[own]], flat[own[:, None] + np.arange(n)])
    return out


_NAMES = ["doc_id", "item_id", "start_word", "allowed", "window", "item"]
_KINDS = [pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.string(), pa.string()]


def _parts(b: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """Slices of a batch of about CHUNK bytes of text."""
    lo = total = 0
    for k, n in enumerate(pc.binary_length(b.column(1)).to_pylist()):
        if k > lo and total + n > CHUNK:
            yield b.slice(lo, k - lo)
            lo, total = k, 0
        total += n
    if lo < b.num_rows:
        yield b.slice(lo)


def _meet(block: Items, n: int, seqs: np.ndarray) -> list[tuple[int, int]]:
    """(window, item) pairs that share a key of a table."""
    have, items = block.tables[n]
    walks, keys = tables(n)
    met: set[tuple[int, int]] = set()
    rows = max(1, WINDOW_WORDS // (walks * max(2 * n, keys)))
    for lo in range(0, len(seqs), rows):
        key = table_keys(seqs[lo : lo + rows])
        left, right = np.searchsorted(have, key, "left"), np.searchsorted(have, key, "right")
        t, w = np.nonzero(right > left)
        found, which = _runs(left[t, w], right[t, w] - 1)
        met.update(zip((w[which] + lo).tolist(), items[found].tolist(), strict=True))
    return sorted(met)


class _Waiting:
    """Windows of many parts of the input, so that those of one size meet the tables together."""

    def __init__(self, block: Items):
        self.block, self.parts, self.words = block, {}, 0

    def add(self, names: list[int], n: int, docs: np.ndarray, starts: np.ndarray, seqs: np.ndarray) -> None:
        self.parts.setdefault(n, []).append((np.array(names, np.int64)[docs], starts, seqs))
        self.words += seqs.size

    def flush(self) -> Iterator[pa.RecordBatch]:
        block = self.block
        for n, parts in sorted(self.parts.items()):
            docs, starts, seqs = (np.concatenate(x) for x in zip(*parts, strict=True))
            # repeated passages meet the tables once
            once, back = np.unique(seqs, axis=0, return_inverse=True)
            met = _meet(block, n, once)
            items: dict[int, list[int]] = {}
            for w, i in met:
                items.setdefault(w, []).append(i)
            rows: list[list] = [[], [], [], [], [], []]
            for at in np.flatnonzero(np.isin(back.ravel(), [w for w, _ in met])).tolist():
                window = "".join(map(code, seqs[at].tolist()))
                for i in items[int(back.ravel()[at])]:
                    for c, v in zip(rows, (int(docs[at]), int(block.ids[i]), int(starts[at]), int(block.allowed[i]), window, block.codes[i]), strict=True):
                        c.append(v)
            if rows[0]:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(rows, _KINDS, strict=True)], _NAMES)
        self.parts, self.words = {}, 0


def _candidates(block: Items):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting = _Waiting(block)
        for b in batches:
            for part in _parts(b) if len(block.ids) else ():
                names, ids = part.column(0).to_pylist(), block.lookup.ids(part.column(1).to_pylist())
                for n, (docs, starts, found) in _windows(block, ids).items():
                    waiting.add(names, n, docs, starts, found)
                if waiting.words > WINDOW_WORDS:
                    yield from waiting.flush()
        yield from waiting.flush()

    return run


def _exact(short: Short):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for part in _parts(b):
                rows: list[list] = [[], [], [], []]
                for doc, ids in zip(part.column(0).to_pylist(), short.lookup.ids(part.column(1).to_pylist()), strict=True):
                    for i, at, _ in short.find(ids):
                        for c, v in zip(rows, (doc, i, at, 0), strict=True):
                            c.append(v)
                if rows[0]:
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(rows, (pa.int64(), pa.int64(), pa.int64(), pa.int32()), strict=True)], ["doc_id", "item_id", "start_word", "distance"])

    return run


def contaminated(docs: DataFrame, benchmark: DataFrame, rate: float = 0.15, least_words: int = LEAST_WORDS) -> DataFrame:
    """``doc_id, item_id, distance, start_word``: documents with a window close to a benchmark item.

    Items and documents are words in lower case without punctuation at their
    ends. Windows have an item's number of words; those that cannot be close to
    any item of that size, by their words alone, are passed over. CGK walks turn the edit distance of words into a
    Hamming distance; sampled positions are the keys under which windows meet
    items; ``levenshtein`` then confirms distance <= rate * size. One row per
    document and item: the least distance and, of those, the first window.
    Items are taken in blocks, each a pass over the documents, so benchmarks
    may be of any size. Items of fewer than ``least_words`` words are met by
    their exact word sequence only.

    Null or empty text, documents without doc_id, and items that are null or
    without words give no rows; rows that share a
    doc_id or item_id are taken together. Other columns are ignored.
    """
    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).where("doc_id is not null and text is not null")
    asked = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")).where("item_id is not null and text is not null")
    blocks = max(1, -(-asked.count() // BLOCK))
    part = F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks))
    found = None
    for k in range(blocks):
        own = [(r.item_id, w) for r in asked.where(part == k).collect() if (w := item_words(r.text))]
        items, short = [x for x in own if len(x[1]) >= least_words], [x for x in own if len(x[1]) < least_words]
        near = source.mapInArrow(_candidates(Items(items, rate)), "doc_id long, item_id long, start_word long, allowed int, window string, item string")
        near = near.withColumn("distance", F.levenshtein("window", "item")).where("distance <= allowed").drop("window", "item", "allowed")
        if short:
            near = near.unionByName(source.mapInArrow(_exact(Short(short)), "doc_id long, item_id long, start_word long, distance int"))
        found = near if found is None else found.unionAll(near)
    best = found.groupBy("doc_id", "item_id").agg(F.min(F.struct("distance", "start_word")).alias("best"))
    return best.select("doc_id", "item_id", F.col("best.distance").alias("distance"), F.col("best.start_word").alias("start_word"))
