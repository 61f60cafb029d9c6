"""Language of texts: blended-spectrum string kernel, Nystroem landmarks and one-versus-rest kernel ridge regression."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from helixframe.llm.quality import held_out
from helixframe.llm.shingles import mix

#: n-grams of 1 to ORDER characters, hashed to BUCKETS features.
ORDER, BUCKETS = 4, 1 << 16
#: Labelled texts and landmarks of each language, chosen by hash of doc_id.
SAMPLE, LANDMARKS = 800, 32
RIDGE = 1e-2
#: Texts whose presence vectors are multiplied at once.
BATCH = 64


def grams(text: str) -> Iterator[np.ndarray]:
    """Buckets of the n-grams of the lower-case text, order by order, repeats included."""
    c = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64)
    h = np.zeros(len(c), np.uint64)
    for n in range(1, ORDER + 1):
        if len(c) < n:
            return
        h = h[: len(c) - n + 1] * np.uint64(0x100000001B3) + c[n - 1 :] + np.uint64(n)
        yield (mix(h) >> np.uint64(48)).astype(np.int64)


def presence(text: str) -> np.ndarray:
    """Sorted distinct buckets of a text."""
    seen = np.zeros(BUCKETS, bool)
    for g in grams(text):
        seen[g] = True
    return np.flatnonzero(seen)


class Classifier:
    """Languages and the weight of each bucket for each of them: landmarks, their Nystroem map and the ridge solution in one matrix."""

    def __init__(self, langs: list[str], weight: np.ndarray):
        self.langs, self.weight = langs, weight

    def predict(self, texts: list[str | None]) -> tuple[list[str], list[float]]:
        langs, scores = ["und"] * len(texts), [0.0] * len(texts)
        asked = [i for i, t in enumerate(texts) if t and self.langs and any(map(str.isalpha, t))]
        for lo in range(0, len(asked), BATCH):
            part = asked[lo : lo + BATCH]
            p = np.zeros((len(part), BUCKETS), np.float32)
            for row, i in enumerate(part):
                for g in grams(texts[i]):
                    p[row, g] = 1
            # kernel values against the landmarks, normalised by the text's own, times the coefficients
            f = (p @ self.weight).astype(np.float64) / np.sqrt(np.maximum(1, p.sum(1, dtype=np.float64)))[:, None]
            e = np.exp(4 * (f - f.max(1, keepdims=True)))
            best = f.argmax(1)
            for row, i in enumerate(part):
                langs[i], scores[i] = self.langs[best[row]], float(e[row, best[row]] / e[row].sum())
        return langs, scores


def fit(rows: list[tuple[str, bool, np.ndarray]], ridge: float = RIDGE) -> Classifier:
    """From (language, is a landmark, distinct buckets) of the sample."""
    langs = sorted({lang for lang, _, _ in rows})
    marks = [u for _, mark, u in rows if mark and len(u)]
    if not marks:
        return Classifier(langs[:0], np.zeros((BUCKETS, 0), np.float32))
    size = np.sqrt([len(u) for u in marks])
    table = np.zeros((BUCKETS, len(marks)), np.float32)
    for j, u in enumerate(marks):
        table[u, j] = 1 / size[j]
    k = np.array([table[u].sum(0, dtype=np.float64) / np.sqrt(max(1, len(u))) for _, _, u in rows])
    k_mm = np.array([table[u].sum(0, dtype=np.float64) / s for u, s in zip(marks, size, strict=True)])
    value, vector = np.linalg.eigh((k_mm + k_mm.T) / 2)
    keep = value > 1e-8 * value.max()
    root = vector[:, keep] / np.sqrt(value[keep])
    phi = k @ root
    y = np.array([[1.0 if lang == x else -1.0 for x in langs] for lang, _, _ in rows])
    a = np.linalg.solve(phi.T @ phi + ridge * len(rows) * np.eye(phi.shape[1]), phi.T @ y)
    return Classifier(langs, (table @ (root @ a).astype(np.float32)).astype(np.float32))


def train(docs: DataFrame, sample: int = SAMPLE, landmarks: int = LANDMARKS) -> Classifier:
    """Learns from up to ``sample`` texts of each language that are not held out."""
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"))
    own = own.where("doc_id is not null and text is not null and lang is not null").where(~held_out(F.col("doc_id")))
    counts = own.groupBy("lang").count().collect()
    if not counts:
        return fit([])
    # a hash threshold leaves little more than the sample of each language, which is then cut exactly
    share = docs.sparkSession.createDataFrame([(r["lang"], min(1 << 30, int((1 << 30) * 1.3 * (sample + 30) / r["count"]))) for r in counts], "lang string, share long")
    h = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30))
    few = own.join(F.broadcast(share), "lang").where(h <= F.col("share"))
    place = F.row_number().over(Window.partitionBy("lang").orderBy(h, "doc_id", "text"))
    few = few.withColumn("place", place).where(F.col("place") <= sample).select("lang", "place", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([presence(t.as_py()).astype("<u2").tobytes() for t in b.column(2)], pa.binary())], ["lang", "place", "buckets"])

    rows = few.mapInArrow(run, "lang string, place int, buckets binary").collect()
    rows = sorted(((r["lang"], r["place"], bytes(r["buckets"])) for r in rows), key=lambda r: r[:2])
    return fit([(lang, place <= landmarks, np.frombuffer(u, "<u2").astype(np.int64)) for lang, place, u in rows])


def identify_languages(docs: DataFrame, sample: int = SAMPLE, landmarks: int = LANDMARKS) -> DataFrame:
    """``doc_id, held_out, lang_pred, score`` for every row of ``docs``.

    Learns from text and lang of rows that are not held out; a prediction sees
    the text alone. ``und`` with score 0 where the text is null, empty or has
    no letter (Unicode category L), or nothing could be learnt. Score is the softmax of the
    regression values. Repeated rows are predicted row by row; null doc_ids are
    not held out. Other columns are ignored.
    """
    model = train(docs, sample, landmarks)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            langs, scores = model.predict(b.column(1).to_pylist())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(langs, pa.string()), pa.array(scores, pa.float64())], ["doc_id", "lang_pred", "score"])

    out = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, lang_pred string, score double")
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")
