"""Personal data in texts: base rules, and identifiers found by bootstrapped contexts."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from helixframe.storage import materialize

KINDS = ("email", "ip", "card", "phone")
_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
# possessive runs, started only where a run of digits starts: no position is tried twice
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")
_DIGITS = re.compile(r"[0-9@]+")
_OUTER = re.compile(r"^[^\w@+]+|[^\w@]+\Z")
#: Of a word beside a span, so many characters count: the nearest ones.
REACH = 64
#: Shortest token that may be an identifier.
LEAST = 5
#: Weight of an instance of unknown kind against a pattern in the first round (1 in the last), and of the deviations that its confidence stays below its mean.
UNKNOWN, DEVIATIONS = 0.3, 1.6
_SHAPE = re.compile(r"([A-Za-zª-ɏ]+)|([0-9]+)")
#: A token of figures and their punctuation, which may go on behind a blank.
_FIGURES = re.compile(r"[0-9().+/#-]+\Z")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        if i & 1:
            d = 2 * d - 9 if d > 4 else 2 * d
        total += d
    return total % 10 == 0


def emails(text: str) -> Iterator[tuple[int, int]]:
    """Leftmost non-overlapping: each domain takes the run of local characters before it, back to the last address."""
    done = 0
    for m in _DOMAIN.finditer(text):
        start = m.start()
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        if start < m.start():
            yield start, m.end()
            done = m.end()


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the base rules, by start and kind; code points, end exclusive."""
    out = []
    if "@" in text:
        out += [(s, 0, e) for s, e in emails(text)]
    if _DIGIT.search(text):
        for m in _IP.finditer(text):
            if all(len(p := x.lstrip("0")) <= 3 and int(p or "0") <= 255 for x in m[0].split(".")):
                out.append((m.start(), 1, m.end()))
        for m in _CARD.finditer(text):
            digits = m[0].replace(" ", "").replace("-", "")
            if 12 <= len(digits) <= 19 and luhn(digits):
                out.append((m.start(), 2, m.end()))
        if "+" in text:
            for m in _PHONE.finditer(text):
                if 9 <= sum(c in "0123456789" for c in m[0]) <= 15:
                    out.append((m.start(), 3, m.end()))
    return sorted(out)


def shape(item: str) -> str:
    """Runs of letters as a, of digits as 9, the rest as it is."""
    return _SHAPE.sub(lambda m: "a" if m[1] else "9", item)[:REACH]


def patterns(text: str, start: int, end: int) -> list[str]:
    """Lexical patterns around a span: one or two words on a side, both sides, and a word with the span's shape."""
    left = [_OUTER.sub("", w[-REACH:]).lower() for w in text[max(0, start - 3 * REACH) : start].split()[-2:]]
    right = [_OUTER.sub("", w[:REACH]).lower() for w in text[end : end + 3 * REACH].split()[:2]]
    before, behind = left[-1] if left else "", right[0] if right else ""
    out = []
    if before:
        out += [f"l {before}", f"ls {before} {shape(text[start:end])}"]
        if left[0] and len(left) > 1:
            out.append(f"ll {left[0]} {before}")
    if behind:
        out += [f"r {behind}", f"rs {shape(text[start:end])} {behind}"]
        if len(right) > 1 and right[1]:
            out.append(f"rr {behind} {right[1]}")
    if before and behind:
        out.append(f"lr {before} {behind}")
    return out


def tokens(text: str, base: list[tuple[int, int, int]]) -> Iterator[tuple[int, int]]:
    """What contexts may turn out to be identifiers: words with a digit or @ that touch no base span, figures with blanks between them as one."""
    done, k = 0, 0
    for m in _DIGITS.finditer(text):
        if m.start() < done:
            continue
        start, end = m.start(), m.end()
        while start > done and not text[start - 1].isspace():
            start -= 1
        while end < len(text) and not text[end].isspace():
            end += 1
        # a label before a colon or an equals sign is context
        label = max(text.rfind(":", start, m.start()), text.rfind("=", start, m.start()))
        start = max(start, label + 1)
        while k < len(base) and base[k][2] <= start:
            k += 1
        stop = base[k][0] if k < len(base) else len(text)
        if _FIGURES.match(text, start, end):
            while end + 1 < stop and text[end] == " ":
                nxt = end + 1
                while nxt < len(text) and not text[nxt].isspace():
                    nxt += 1
                if nxt > stop or not _FIGURES.match(text, end + 1, nxt):
                    break
                end = nxt
        done = end
        while start < end and not (text[start].isalnum() or text[start] in "@+("):
            start += 1
        while end > start and not text[end - 1].isalnum():
            end -= 1
        if end - start >= LEAST and not any(s < end and start < e for s, _, e in base[k : k + 4]):
            yield start, end


_SPAN = pa.struct([("start", pa.int32()), ("ord", pa.int32()), ("name", pa.string())])
_SEEN = pa.struct([("start", pa.int32()), ("end", pa.int32()), ("kind", pa.int32()), ("item", pa.int64()), ("patterns", pa.list_(pa.int64()))])


def _key(text: str) -> int:
    """Items and patterns go by their hashes; there are too many to carry them as texts."""
    return xxhash.xxh3_64_intdigest(text.encode("utf-8", "surrogatepass")) - (1 << 63)


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    from pyspark import TaskContext

    row = TaskContext.get().partitionId() << 36
    names = ["row", "doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "base", "seen"]
    for b in batches:
        rows, count, digest, spans, seen = [], [[], [], [], []], [], [], []
        for text in b.column(1):
            text = text.as_py() or ""
            base = base_spans(text)
            for k in range(4):
                count[k].append(sum(1 for s in base if s[1] == k))
            listed = [(s, k, f"{KINDS[k]}:{s}:{e}") for s, k, e in base]
            digest.append(hashlib.sha256(",".join(x[2] for x in listed).encode()).hexdigest())
            spans.append([{"start": s, "ord": k, "name": n} for s, k, n in listed])
            found = [(s, e, k) for s, k, e in base]
            if _DIGITS.search(text):
                found += [(s, e, -1) for s, e in tokens(text, base)]
            own = []
            for s, e, k in found:
                own.append({"start": s, "end": e, "kind": k, "item": _key(text[s:e].lower()), "patterns": [_key(p) for p in patterns(text, s, e)]})
            seen.append(own)
            rows.append(row)
            row += 1
        yield pa.RecordBatch.from_arrays([pa.array(rows, pa.int64()), b.column(0), *(pa.array(c, pa.int64()) for c in count), pa.array(digest), pa.array(spans, pa.list_(_SPAN)), pa.array(seen, pa.list_(_SEEN))], names)


def _confident(graph: DataFrame, believed: DataFrame, confidence: float, support: int, unknown: float) -> DataFrame:
    """(pattern, kind, conf) of the patterns that are confident in a kind.

    Of a pattern's distinct instances, those believed to be of the kind count
    for it, those of other kinds against it, and those still
    unknown by the weight ``unknown``. The confidence is the lower end of the share's interval, so
    a pattern needs many instances as well as pure ones.
    """
    size = graph.groupBy("pattern").agg(F.count(F.lit(1)).alias("n"))
    held = graph.select("pattern", "item").join(believed, "item").groupBy("pattern", "kind").agg(F.count(F.lit(1)).alias("holds"), F.sum("trust").alias("trust"))
    every = held.groupBy("pattern").agg(F.sum("holds").alias("known"), F.sum("trust").alias("all"))
    both = held.where(F.col("holds") >= support).join(every, "pattern").join(size, "pattern")
    z = DEVIATIONS**2
    n = F.col("all") + unknown * F.greatest(F.col("n") - F.col("known"), F.lit(0))
    p = F.col("trust") / n
    low = (p + z / (2 * n) - DEVIATIONS * F.sqrt(p * (1 - p) / n + z / (4 * n * n))) / (1 + z / n)
    return both.select("pattern", "kind", low.alias("conf")).where(F.col("conf") >= confidence)


def find_personal_data(docs: DataFrame, rounds: int = 2, confidence: float = 0.75, support: int = 5) -> DataFrame:
    """``doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_context`` for every row of ``docs``.

    Base spans are the seeds. The words around a seed, alone, together or with
    the seed's shape, are its patterns (``patterns``); other tokens with digits
    or @ are instances of unknown kind. In each round patterns are scored by
    their distinct instances (``_confident``), of which at least ``support``
    must be believed to be of the kind, and an instance by all the confident
    patterns around it: it is doubted as far as each of them is. Instances
    believed at ``confidence`` count as seeds of less weight in the next round.
    After the last, tokens in whose place a confident pattern stands become
    spans named after the kind, with ``?``; of several kinds the most confident
    one, then the first listed. Null and empty texts have no spans. Repeated
    rows and null doc_ids are scanned row by row. Other columns are ignored.
    """
    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    span, seen = "array<struct<start:int,ord:int,name:string>>", "array<struct<start:int,end:int,kind:int,item:bigint,patterns:array<bigint>>>"
    schema = f"row long, doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, base {span}, seen {seen}"
    told = materialize(source.mapInArrow(_scan, schema), "pii")

    # the graph: one row per pattern and distinct instance
    stands = told.where("size(seen) > 0").select("row", F.explode("seen").alias("s")).select("row", "s.start", "s.end", "s.kind", "s.item", F.explode("s.patterns").alias("pattern"))
    graph = materialize(stands.groupBy("pattern", "item").agg(F.max("kind").alias("kind")), "graph")
    seeds = graph.where("kind >= 0").select("item", "kind", F.lit(1.0).alias("trust")).distinct()
    believed, confident = seeds, None
    for k in range(rounds):
        # what no pattern has explained by the last round counts in full
        unknown = UNKNOWN + (1 - UNKNOWN) * k / max(1, rounds - 1)
        confident = materialize(_confident(graph, believed, confidence, support, unknown), "patterns")
        if k < rounds - 1:
            # only confident patterns go back to their instances
            doubt = graph.where("kind < 0").select("pattern", "item").join(confident, "pattern").groupBy("item", "kind").agg(F.sum(F.log(1.0001 - F.col("conf"))).alias("doubt"))
            reached = doubt.select("item", "kind", (1 - F.exp("doubt")).alias("trust")).where(F.col("trust") >= confidence)
            believed = materialize(seeds.unionAll(reached), "believed")
    new = stands.where("kind < 0").drop("kind").join(confident, "pattern").groupBy("row", "start", "end").agg(F.max(F.struct("conf", F.negative("kind").alias("kind")))["kind"].alias("kind"))
    name = F.element_at(F.array(*[F.lit(k + "?") for k in KINDS]), 1 - F.col("kind"))
    extra = new.groupBy("row").agg(F.collect_list(F.struct("start", (4 - F.col("kind")).alias("ord"), F.concat(name, F.lit(":"), "start", F.lit(":"), "end").alias("name"))).alias("extra"))
    out = told.drop("seen").join(extra, "row", "left")
    every = F.array_sort(F.concat("base", F.coalesce("extra", F.array().cast(span))))
    return out.select("doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", F.array_join(F.transform(every, lambda s: s["name"]), ",").alias("spans"), F.coalesce(F.size("extra"), F.lit(0)).cast("long").alias("n_context"))
