"""Document quality by Bradley-Terry ranking of feature vectors."""

from __future__ import annotations

import math
import sys
import unicodedata
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

FEATURES = ("log_chars", "word_length", "upper", "symbol", "digit", "space", "symbol_pairs", "repeated_next", "distinct", "commonest", "repeated_lines", "line_words", "bare_symbols", "short_words", "ends_alike", "capital_words")
#: Labelled documents that the ranking learns from (by hash of doc_id), and pairs drawn from them.
SAMPLE, PAIRS = 20_000, 60_000
#: A document at the learnt score quantile gets this score.
CUT = 0.7


@lru_cache(maxsize=1)
def _classes() -> np.ndarray:
    """Class of each code point up to 0xFFFF: 0 other letter, 1 upper case, 2 digit, 3 blank, 4 symbol. Higher ones count as the last."""
    out = np.full(1 << 16, 4, np.uint8)
    for c in range(min(1 << 16, sys.maxunicode)):
        k = unicodedata.category(chr(c))
        out[c] = 1 if k in ("Lu", "Lt") else 0 if k[0] in "LM" else 2 if k[0] == "N" else 3 if chr(c).isspace() else 4
    out[-1] = 0
    return out


def features(text: str | None) -> list[float]:
    """What a text looks like: rates of kinds of characters, of repetition, and of layout. Zeros for an empty text."""
    if not text:
        return [0.0] * len(FEATURES)
    kind = _classes()[np.minimum(np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4"), 0xFFFF)]
    chars = len(kind)
    n = np.bincount(kind, minlength=5)
    letters = max(1, int(n[0] + n[1]))
    symbol = kind == 4
    words = text.split()
    count = Counter(words)
    total = max(1, len(words))
    lines = [x for x in text.split("\n") if x]
    ends = Counter(w[-1] for w in words if not w[-1].isalnum())
    return [
        math.log1p(chars),
        (chars - int(n[3])) / total,
        int(n[1]) / letters,
        int(n[4]) / chars,
        int(n[2]) / chars,
        int(n[3]) / chars,
        int((symbol[1:] & symbol[:-1]).sum()) / total,
        sum(map(eq, words, words[1:])) / total,
        math.log(max(1, len(count))) / math.log(total + 1),
        max(count.values(), default=0) / (total + 10),
        1 - len(set(lines)) / max(1, len(lines)),
        math.log1p(total / max(1, len(lines))),
        sum(c for w, c in count.items() if not any(x.isalnum() for x in w)) / total,
        sum(c for w, c in count.items() if len(w) <= 3) / total,
        max(ends.values(), default=0) / (total + 5),
        sum(c for w, c in count.items() if w[0].isupper()) / (total + 5),
    ]


def held_out(doc_id: Column) -> Column:
    """The rows whose labels are never learnt from."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 4 == 2, F.lit(False))


class Ranking:
    """Utility w . z of standardised features; score is its logistic distance from the cut."""

    def __init__(self, centre: np.ndarray, spread: np.ndarray, weight: np.ndarray, cut: float):
        self.centre, self.spread, self.weight, self.cut = centre, spread, weight, cut

    def utility(self, x: np.ndarray) -> np.ndarray:
        return np.clip((x - self.centre) / self.spread, -8, 8) @ self.weight

    def score(self, x: np.ndarray) -> np.ndarray:
        z = self.utility(x) - self.cut + math.log(CUT / (1 - CUT))
        return 1 / (1 + np.exp(-np.clip(z, -500, 500)))


def fit(x: np.ndarray, good: np.ndarray, pairs: int = PAIRS, ridge: float = 1e-3, steps: int = 40) -> Ranking:
    """Bradley-Terry: P(a above b) = logistic(w . (za - zb)) over pairs of a good and a poor document, by Newton steps.

    The cut is the score quantile of the share of poor documents. Without both
    kinds all documents are alike and at the cut.
    """
    k = len(FEATURES)
    up, down = np.flatnonzero(good), np.flatnonzero(~good)
    if not len(up) or not len(down):
        return Ranking(np.zeros(k), np.ones(k), np.zeros(k), 0.0)
    centre, spread = x.mean(0), np.maximum(x.std(0), 1e-6)
    z = np.clip((x - centre) / spread, -8, 8)
    m = min(pairs, 8 * max(len(up), len(down)))
    i = np.arange(m)
    # each document comes up equally often, with partners that change from round to round
    a, b = up[i % len(up)], down[(i + i // len(up) + i // len(down)) % len(down)]
    d = z[a] - z[b]
    w = np.zeros(k)
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(d @ w, -50, 50)))
        grad = d.T @ (1 - p) / m - ridge * w
        hess = (d * (p * (1 - p))[:, None]).T @ d / m + ridge * np.eye(k)
        step = np.linalg.solve(hess, grad)
        w += step * min(1.0, 5 / max(1e-9, float(np.abs(step).max())))
        if np.abs(step).max() < 1e-7:
            break
    u = np.sort(z @ w)
    # between the share of poor ones and the rest
    at = len(down)
    return Ranking(centre, spread, w, float(u[at - 1] + u[at]) / 2)


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Ranking:
    """Learns from up to ``sample`` labelled rows that are not held out. A doc_id with several labels has the lowest."""
    own = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("quality")).where("doc_id is not null and quality is not null").where(~held_out(F.col("doc_id")))
    own = own.groupBy("doc_id").agg(F.min("quality").alias("quality"))
    n = own.count()
    share = 1 << 20 if n <= sample else int((1 << 20) * sample / n)
    place = F.xxhash64("doc_id")
    own = own.where(F.pmod(place, F.lit(1 << 20)) < share).orderBy(place, "doc_id").limit(sample)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([features(t.as_py()) for t in b.column(2)], pa.list_(pa.float64()))], ["doc_id", "quality", "x"])

    # at most ``sample`` rows, so the labels go to the documents
    seen = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).join(F.broadcast(own), "doc_id").select("doc_id", "quality", "text")
    rows = sorted(seen.mapInArrow(run, "doc_id long, quality int, x array<double>").collect(), key=lambda r: (r.doc_id, r.x))
    if not rows:
        return fit(np.empty((0, len(FEATURES))), np.empty(0, bool))
    return fit(np.array([r.x for r in rows]), np.array([r.quality == 1 for r in rows]))


def _scored(ranking: Ranking, text: str = "text", score: str = "_score"):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at = b.schema.get_field_index(text)
            x = np.array([features(t.as_py()) for t in b.column(at)]).reshape(-1, len(FEATURES))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(ranking.score(x))], [*b.schema.names, score])

    return run


def score_quality(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """``doc_id, held_out, score, predicted`` for every row of ``docs``; predicted is 1 from a score of 0.7 on.

    Only texts are scored: labels, lang, source and doc_id are no features.
    Null and empty texts have features of zero and are scored like others.
    Without labels of both kinds every document has the score 0.7. Repeated
    rows are scored row by row; null doc_ids are not held out. Other columns
    are ignored.
    """
    ranking = train(docs, labels, sample)
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    out = own.mapInArrow(_scored(ranking), "doc_id long, text string, _score double")
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), F.col("_score").alias("score"), (F.col("_score") >= CUT).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """The rows and columns of ``docs`` that ``score_quality`` predicts as good."""
    ranking = train(docs, labels, sample)
    names = {c.lower(): c for c in docs.columns}
    score = "_score"
    while score in names:
        score += "_"
    schema = T.StructType([*docs.schema.fields, T.StructField(score, T.DoubleType())])
    return docs.mapInArrow(_scored(ranking, names["text"], score), schema).where(F.col(score) >= CUT).drop(score)
