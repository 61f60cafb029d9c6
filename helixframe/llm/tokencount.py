"""Token counts of whole texts without their token ids."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from helixframe.storage import materialize

#: Entries of a worker's table of pre-tokens, and characters of the texts in it, before it is handed on.
FLUSH, FLUSH_CHARS = 300_000, 1 << 26
#: Rows, and characters of pre-tokens, that are handed on at once.
ROWS, ROW_CHARS = 100_000, 1 << 24
#: The frequent pre-tokens are chosen by steps of frequency, so many to an octave, and those of one step by so many buckets.
STEPS, BUCKETS = 4, 1024

_PLAIN = re.compile(r"  |▁| \n|^ ")
_RUN = re.compile(r"(?:▁+|\n)[^▁\n]*")


def pretokens(text: str) -> list[str]:
    """Stretches that no piece reaches across: each starts at blanks or at a newline.

    The blank that starts a stretch is left out ("" is a lone blank), further
    ones are "▁". The library puts a blank before the text.
    """
    if not text:
        return []
    if _PLAIN.search(text):
        return [w[1:] if w[0] == "▁" else w for w in _RUN.findall("▁" + text.replace(" ", "▁"))]
    return text.replace("\n", " \n").split(" ")


@lru_cache(maxsize=2)
def _model(path: str):
    import sentencepiece as sp
    from sentencepiece import sentencepiece_model_pb2 as pb

    spec = pb.ModelProto()
    with open(path, "rb") as f:
        spec.ParseFromString(f.read())
    norm = spec.normalizer_spec
    crosses = [p.piece for p in spec.pieces if p.type in (1, 4) and ("\n" in p.piece or re.search("[^▁]▁", p.piece))]
    if norm.precompiled_charsmap or norm.remove_extra_whitespaces or not norm.add_dummy_prefix or crosses or any(p.type == 4 for p in spec.pieces):
        raise ValueError("the model's pieces reach across blanks or newlines, or it rewrites texts")
    return sp.SentencePieceProcessor(model_file=path)


def count_pieces(words: list[str], path: str) -> list[int]:
    """Pieces of each pre-token. A newline stretch is counted behind the library's own blank, which is one piece."""
    found = _model(path).encode(words, num_threads=1)
    return [1 if not w else len(ids) - 1 if w[0] == "\n" else len(ids) for w, ids in zip(words, found, strict=True)]
def most_frequent(counts: DataFrame, frequent: int, frequent_bytes: int) -> Column:
    """Condition that holds for the most frequent rows of ``pretoken, freq``: at most ``frequent``, and ``frequent_bytes`` of text.

    Frequencies come in steps of a quarter of an octave, whatever their size;
    the first step that does not fit as a whole is filled by buckets of a hash.
    The driver sees a row per step and per bucket of that step.
    """
    step, bucket = F.floor(STEPS * F.log2("freq")), F.pmod(F.xxhash64("pretoken"), F.lit(BUCKETS))
    n, size = 0, 0

    def fits(by: Column, rows: DataFrame, down: bool) -> int | None:
        """Takes what fits, in order; returns the first that does not."""
        nonlocal n, size
        found = rows.groupBy(by.alias("at")).agg(F.count(F.lit(1)).alias("n"), F.sum(F.octet_length("pretoken")).alias("b")).collect()
        for s in sorted(found, reverse=down):
            if n + s.n > frequent or size + s.b > frequent_bytes:
                return s["at"]
            n, size = n + s.n, size + s.b
        return None

    short = fits(step, counts, True)
    if short is None:
        return F.lit(True)
    last = fits(bucket, counts.where(step == short), False)
    return (step > short) | ((step == short) & (bucket < last))


def count_tokens(docs: DataFrame, path: str, limit: int = 4096, frequent: int = 1 << 18, frequent_bytes: int = 1 << 25) -> DataFrame:
    """``doc_id, n_bytes, n_tokens, over_limit`` for every row of ``docs``.

    1. Workers count their pre-tokens; one row per distinct pre-token follows,
       and its pieces are counted once.
    2. The most frequent pre-tokens, at most ``frequent`` of them and
       ``frequent_bytes`` of text, are the hot keys of the join: every worker
       holds them. All others meet their counts in a shuffled join.
    3. Both parts are summed per document; no ids are kept.

    Null or empty text: no bytes and no tokens. Repeated rows and null doc_ids
    are counted row by row. Other columns are ignored.
    """
    spark = docs.sparkSession
    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))

    def local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out(seen):
            return pa.RecordBatch.from_arrays([pa.array(list(seen), pa.string()), pa.array(list(seen.values()), pa.int64())], ["pretoken", "freq"])

        seen: Counter[str] = Counter()
        chars = 0
        for b in batches:
            for text in b.column(1):
                text = text.as_py() or ""
                seen.update(pretokens(text))
                chars += len(text)
                if len(seen) >= FLUSH or chars >= FLUSH_CHARS:
                    yield out(seen)
                    seen, chars = Counter(), 0
        if seen:
            yield out(seen)

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n = count_pieces(b.column(0).to_pylist(), path)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(n, pa.int32())], ["pretoken", "freq", "n"])

    distinct = source.select("doc_id", "text").mapInArrow(local, "pretoken string, freq long").groupBy("pretoken").agg(F.sum("freq").alias("freq"))
    counts = materialize(distinct.mapInArrow(pieces, "pretoken string, freq long, n int"), "pieces")

    hot = most_frequent(counts, frequent, frequent_bytes)
    top = counts.where(hot).select("pretoken", "n").toArrow()
    known = spark.sparkContext.broadcast(dict(zip(top.column(0).to_pylist(), top.column(1).to_pylist(), strict=True)))

    def per_document(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        get, key = known.value.get, TaskContext.get().partitionId() << 36
        names = ["row", "doc_id", "n_bytes", "tokens", "pretoken", "freq"]
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int32()]
        for b in batches:
            rows: list[list] = [[], [], [], [], [], []]
            chars = 0
            for doc, text in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                text, total, rare = text.as_py() or "", 0, []
                chars += len(text)
                for w, f in Counter(pretokens(text)).items():
                    n = get(w)
                    if n is None:
                        rare.append((w, f))
                    else:
                        total += n * f
                # the document's own row has frequency 0 and a key that spreads over partitions
                rare.append((f"\0{key}", 0))
                m = len(rare) - 1
                rows[0] += [key] * (m + 1)
                rows[1] += [None] * m + [doc]
                rows[2] += [None] * m + [len(text.encode())]
                rows[3] += [None] * m + [total]
                rows[4] += [w for w, _ in rare]
                rows[5] += [f for _, f in rare]
                key += 1
                if len(rows[0]) >= ROWS or chars >= ROW_CHARS:
                    chars = 0
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(rows, kinds, strict=True)], names)
                    rows = [[], [], [], [], [], []]
            if rows[0]:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(rows, kinds, strict=True)], names)

    parts = source.mapInArrow(per_document, "row long, doc_id long, n_bytes long, tokens long, pretoken string, freq int")
    met = parts.join(counts.where(~hot).select("pretoken", "n"), "pretoken", "left")
    total = F.coalesce(F.sum("tokens"), F.lit(0)) + F.coalesce(F.sum(F.col("freq") * F.col("n").cast("long")), F.lit(0))
    summed = met.groupBy("row").agg(F.max("doc_id").alias("doc_id"), F.max("n_bytes").alias("n_bytes"), total.alias("n_tokens"))
    return summed.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
