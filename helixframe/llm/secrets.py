"""Secrets in texts: base rules, and formats learnt from what they find."""

from __future__ import annotations

import hashlib
import heapq
import math
import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from helixframe.llm.grammar import Automaton, learn
from helixframe.storage import materialize

#: Kinds in the order of the listing; the last one holds what the automata find.
KINDS = ("assign", "access", "hex", "format")
_ANY_CASE = "|".join("".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in w) for w in ("password", "passwd", "secret", "token", "api")).replace("[Aa][Pp][Ii]", "[Aa][Pp][Ii]_?[Kk][Ee][Yy]")
_ASSIGN = re.compile(rf"""(?:{_ANY_CASE})["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
_WORDS = ("password", "passwd", "secret", "token", "key")
_ACCESS = re.compile(r"AKIA[A-Z0-9]{12,}")
_HEX = re.compile(r"[0-9a-f]{32,}")

#: Strings of each kind that the automata learn from (those with the smallest hashes), and their longest.
SAMPLE, LONGEST = 1500, 200
#: Shortest candidate: the shortest value of an assignment.
LEAST = 8
_RUN = re.compile(rf"(?<![A-Za-z0-9+/_.=-])[A-Za-z0-9+/_.=-]{{{LEAST},}}")
_DIGIT = re.compile("[0-9]")
#: Runs whose verdict a worker remembers, and their longest.
_MEMO, _MEMO_LONGEST = 100_000, 64
#: A run is a span if labelled strings are expected to be at least this share of all strings that look like it.
SHARE = 0.1
#: Formats with fewer strings of a look are not learnt.
FEWEST = 20


#: Texts whose bytes are looked at together.
AT_ONCE = 200
#: What a byte is: lower case 1, upper case 2, digit 4, another credential character 8, hexadecimal 16.
_BYTES = np.zeros(256, np.uint8)
for _c in range(128):
    _k = chr(_c)
    _BYTES[_c] = (1 if "a" <= _k <= "z" else 2 if "A" <= _k <= "Z" else 4 if "0" <= _k <= "9" else 8 if _k in "+/_.=-" else 0) | (16 if _k in "0123456789abcdef" else 0)


def scan(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """All runs of at least ``LEAST`` credential characters of many texts at once: (text, start, end, look), in code points, and which texts may hold a hexadecimal secret."""
    parts = [t.encode("utf-8", "surrogatepass") for t in texts]
    data = np.frombuffer(b"\n".join([*parts, b""]), np.uint8)
    begin = np.cumsum([0, *(len(p) + 1 for p in parts)])[:-1]
    kind = _BYTES[data]

    def runs(bits: int, least: int) -> tuple[np.ndarray, np.ndarray]:
        edge = np.flatnonzero(np.diff(np.concatenate([[False], (kind & bits) > 0, [False]]).astype(np.int8)))
        start, end = edge[::2], edge[1::2]
        keep = end - start >= least
        return start[keep], end[keep]

    start, end = runs(15, LEAST)
    found = np.bitwise_or.reduceat(kind, np.stack([start, end], axis=1).ravel())[::2] & 15 if len(start) else np.empty(0, np.uint8)
    text = np.searchsorted(begin, start, side="right") - 1
    hexed = np.zeros(len(texts), bool)
    hexed[np.searchsorted(begin, runs(16, 32)[0], side="right") - 1] = True
    if len(data) and data.max() >= 128:  # code points: bytes that do not continue one
        points = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
        return text, points[start] - points[begin[text]], points[end] - points[begin[text]], found, hexed
    return text, start - begin[text], end - begin[text], found, hexed


def base_spans(text: str, hexed: bool = True) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the base rules, by start and kind; code points, end exclusive. ``hexed``: whether there may be hexadecimal ones."""
    out = []
    low = text.lower()
    if any(w in low for w in _WORDS):
        out += [(m.start(), 0, m.end()) for m in _ASSIGN.finditer(text) if m.end(1) - m.start(1) >= 8]
    if "AKIA" in text:
        out += [(m.start(), 1, m.end()) for m in _ACCESS.finditer(text)]
    if hexed:
        out += [(m.start(), 2, m.end()) for m in _HEX.finditer(text)]
    return sorted(out)


def candidates(text: str, base: list[tuple[int, int, int]]) -> Iterator[tuple[int, int]]:
    """Runs of credential characters, or their parts outside the base spans, that are long enough."""
    cuts = sorted((s, e) for s, _, e in base)
    k = 0
    for m in _RUN.finditer(text):
        start, end = m.span()
        # spans that end before this run cannot reach the next one either
        while k < len(cuts) and cuts[k][1] <= start:
            k += 1
        at = k
        while at < len(cuts) and cuts[at][0] < end:
            if cuts[at][0] - start >= LEAST:
                yield start, cuts[at][0]
            start = max(start, cuts[at][1])
            at += 1
        if end - start >= LEAST:
            yield start, end


def look(run: str) -> int:
    """Which characters a run holds, as bits: lower case 1, upper case 2, digits 4, others 8."""
    return (run.upper() != run) + 2 * (run.lower() != run) + 4 * bool(_DIGIT.search(run)) + 8 * (not run.isalnum())


class Scanner:
    """By the look of runs: formats with the number of distinct strings that show each, and the ordinary runs' automaton with theirs."""

    def __init__(self, formats: dict[int, list[tuple[Automaton, float]]], ordinary: dict[int, tuple[Automaton, float]]):
        self.formats = {k: [(a, math.log(n)) for a, n in own] for k, own in formats.items()}
        self.ordinary = {k: (a, math.log(n)) for k, (a, n) in ordinary.items()}
        self.memo: dict[str, bool] = {}

    def margin(self, own: str) -> float:
        """Log of how many labelled strings like this one are expected for each unlabelled one."""
        kind = look(own)
        if kind not in self.formats:
            return -math.inf
        found = max(a.score(own) + n for a, n in self.formats[kind])
        if kind not in self.ordinary:
            return math.inf
        other, n = self.ordinary[kind]
        return found - other.score(own) - n

    def likely(self, own: str) -> bool:
        """Whether enough of the strings that look like the run are labelled ones."""
        found = self.memo.get(own)
        if found is None:
            found = self.margin(own) >= math.log(SHARE / (1 - SHARE))
            if len(own) <= _MEMO_LONGEST:
                if len(self.memo) >= _MEMO:
                    self.memo.clear()
                self.memo[own] = found
        return found

    def spans(self, text: str | None) -> list[tuple[int, int, int]]:
        return self.all_spans([text])[0]

    def all_spans(self, texts: list[str | None]) -> list[list[tuple[int, int, int]]]:
        """Spans of each text. Only runs that look like a format are looked at one by one."""
        return [spans for at in range(0, len(texts), AT_ONCE) for spans in self._spans_of(texts[at : at + AT_ONCE])]

    def _spans_of(self, texts: list[str | None]) -> list[list[tuple[int, int, int]]]:
        known = [t or "" for t in texts]
        text, start, end, kind, hexed = scan(known)
        out = [base_spans(t, h) if t else [] for t, h in zip(known, hexed.tolist(), strict=True)]
        if not self.formats:
            return out
        plain = np.array([not spans for spans in out], bool)
        own = np.flatnonzero(np.isin(kind, list(self.formats)) & plain[text])
        for d, spans in enumerate(out):
            if spans:
                out[d] = sorted(spans + [(s, 3, e) for s, e in candidates(known[d], spans) if self.likely(known[d][s:e])])
        for d, s, e in zip(text[own].tolist(), start[own].tolist(), end[own].tolist(), strict=True):
            if self.likely(known[d][s:e]):
                out[d].append((s, 3, e))
        return out


def listing(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in spans)


def _place(run: str) -> int:
    """A run's place in the order by hash, below 2^63."""
    return xxhash.xxh3_64_intdigest(run) >> 1


def _labelled(sample: int):
    """Kind, look, value and place of each base span (the value alone for assignments), and, as kind 3, of the ``sample`` other runs of each look that come first by hash."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first: dict[int, list[tuple[int, str]]] = {}
        seen: set[str] = set()

        def rows(found: list[tuple[int, str]]) -> pa.RecordBatch:
            kinds, values = [k for k, _ in found], [v for _, v in found]
            return pa.RecordBatch.from_arrays([pa.array(kinds, pa.int32()), pa.array(map(look, values), pa.int32()), pa.array(values, pa.string()), pa.array(map(_place, values), pa.int64())], ["kind", "look", "value", "place"])

        def offer(own: str, kind: int) -> None:
            place, heap = _place(own), first.setdefault(kind, [])
            if len(heap) < sample:
                heapq.heappush(heap, (-place, own))
            elif -place > heap[0][0]:
                heapq.heappushpop(heap, (-place, own))

        def learn_from(texts: list[str], found: set[tuple[int, str]]) -> None:
            text, start, end, kinds, hexed = scan(texts)
            bare = np.ones(len(texts), bool)
            others: dict[str, int] = {}
            for d, (t, h) in enumerate(zip(texts, hexed.tolist(), strict=True)):
                base = base_spans(t, h) if t else []
                bare[d] = not base
                for s, k, e in base:
                    own = t[s:e]
                    own = _ASSIGN.fullmatch(own)[1] if k == 0 else own
                    if len(own) <= LONGEST:
                        found.add((k, own))
                if base:
                    others |= {own: look(own) for s, e in candidates(t, base) if e - s <= LONGEST and (own := t[s:e])}
            keep = np.flatnonzero(bare[text] & (end - start <= LONGEST))
            others |= {texts[d][s:e]: k for d, s, e, k in zip(text[keep].tolist(), start[keep].tolist(), end[keep].tolist(), kinds[keep].tolist(), strict=True)}
            # a run that was offered before is held, or was beaten for good
            for own, k in others.items():
                if own not in seen:
                    offer(own, k)
            if len(seen) > _MEMO:
                seen.clear()
                seen.update(own for heap in first.values() for _, own in heap)
            seen.update(others)

        for b in batches:
            found: set[tuple[int, str]] = set()
            for at in range(0, b.num_rows, AT_ONCE):
                learn_from([t or "" for t in b.column(0).slice(at, AT_ONCE).to_pylist()], found)
            yield rows(sorted(found))
        yield rows([(3, own) for heap in first.values() for _, own in heap])

    return run


def train(docs: DataFrame, sample: int = SAMPLE) -> Scanner:
    """Automata of the formats that the base rules find in ``docs``, and of the runs they leave, each by the characters they hold (``look``).

    Learns from up to ``sample`` distinct strings of each kind and look, and as
    many other runs, of up to ``LONGEST`` characters, first by hash. Their
    numbers in all texts are counted, those of other runs estimated by how far
    the sample reaches. A format with under ``FEWEST`` strings is not learnt.
    """
    found = docs.select(F.col("text").cast("string").alias("text")).where("text is not null").mapInArrow(_labelled(sample), "kind int, look int, value string, place long").distinct()
    found = materialize(found, "labelled")
    formats: dict[int, list[tuple[Automaton, float]]] = {}
    ordinary: dict[int, tuple[Automaton, float]] = {}
    number = {(r["look"], r["kind"]): r["count"] for r in found.groupBy("look", "kind").count().collect()}
    learnt = sorted({own for (own, kind), n in number.items() if kind < 3 and n >= FEWEST})
    place = F.row_number().over(Window.partitionBy("kind", "look").orderBy("place", "value"))
    samples: dict[tuple[int, int], list] = {}
    first = found.where(F.col("look").isin(learnt)).withColumn("rank", place).where(F.col("rank") <= sample)
    for r in first.orderBy("look", "kind", "rank").toLocalIterator():  # so many of each kind and look
        samples.setdefault((r.look, r.kind), []).append((r.value, r.place))
    for (own, kind), n in sorted(number.items()):
        if kind < 3 and n < FEWEST or kind == 3 and own not in formats:
            continue
        first = samples[own, kind]
        automaton = learn([value for value, _ in first], longest=LONGEST)
        if kind < 3:
            formats.setdefault(own, []).append((automaton, n))
        else:
            # the sample holds all runs up to its last place
            ordinary[own] = (automaton, n if n <= sample else (len(first) - 1) / (first[-1][1] / 2**63))
    return Scanner(formats, ordinary)


def find_secrets(docs: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """``doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_format`` for every row of ``docs``.

    Base rules first; then every run of at least ``LEAST`` credential characters,
    or what base spans leave of it, is scored by the automata of the formats
    against that of ordinary runs of its look, and one whose like are labelled often enough
    (``SHARE``) is a span of kind ``format``. Null and empty texts
    have no spans. Repeated rows and null doc_ids are scanned row by row.
    Other columns are ignored.
    """
    scanner = train(docs, sample)
    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans", "n_format"]
        for b in batches:
            count, digest, lists = [[], [], [], []], [], []
            for spans in scanner.all_spans(b.column(1).to_pylist()):
                for k in range(4):
                    count[k].append(sum(1 for s in spans if s[1] == k))
                digest.append(hashlib.sha256(listing([s for s in spans if s[1] < 3]).encode()).hexdigest())
                lists.append(listing(spans))
            n = [pa.array(c, pa.int64()) for c in count]
            yield pa.RecordBatch.from_arrays([b.column(0), *n[:3], pa.array(digest), pa.array(lists), n[3]], names)

    return source.mapInArrow(run, "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_format long")


def redact(docs: DataFrame, mask: Callable[[str], str] = lambda kind: f"[{kind}]", sample: int = SAMPLE) -> DataFrame:
    """The rows and columns of ``docs`` with each secret in ``text`` replaced by ``mask(kind)``; ``n_chars``, if there, follows.

    Null and empty texts stay as they are, repeated rows are treated alike, and very long texts are scanned whole.
    """
    scanner = train(docs, sample)
    schema = docs.schema
    place = {c.lower(): i for i, c in enumerate(docs.columns)}
    at, chars = place["text"], place.get("n_chars")

    def clean(text: str | None, spans: list[tuple[int, int, int]]) -> str | None:
        if not spans:
            return text
        out, done = [], 0
        for s, k, e in spans:
            if e <= done:
                continue
            out += [text[done : max(s, done)], mask(KINDS[k])] if s >= done else []
            done = e
        return "".join(out) + text[done:]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            own = b.column(at).to_pylist()
            texts = [clean(t, spans) for t, spans in zip(own, scanner.all_spans(own), strict=True)]
            columns = list(b.columns)
            columns[at] = pa.array(texts, b.column(at).type)
            if chars is not None:
                columns[chars] = pa.array([old if t is None else len(t) for t, old in zip(texts, b.column(chars).to_pylist(), strict=True)], b.column(chars).type)
            yield pa.RecordBatch.from_arrays(columns, b.schema.names)

    return docs.mapInArrow(run, schema)
