"""Media columns: payloads as lossless WebP files, and WebP files as pixel arrays."""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from helixframe.llm.webp import decode_many, encode_many

#: Payloads are padded with this byte to a positive multiple of UNIT.
PAD, UNIT = b"\xff", 576
#: Bytes of payloads that are written at once, and of those that are read side by side: reading gains by many images.
WRITE_CHUNK, CHUNK = 1 << 21, 1 << 23


def payload_length(n: int) -> int:
    """Bytes of the payload for a text of n bytes; what an image holds behind them is to spare."""
    return max(UNIT, n + -n % UNIT)


def _chunks(sizes: list[int], most: int) -> Iterator[tuple[int, int]]:
    lo = total = 0
    for k, n in enumerate(sizes):
        if k > lo and total + n > most:
            yield lo, k
            lo, total = k, 0
        total += n
    if lo < len(sizes):
        yield lo, len(sizes)


def texts_to_webp(docs: DataFrame) -> DataFrame:
    """``doc_id, n_bytes, media`` for every row: each text's UTF-8 bytes, padded, as a lossless WebP file.

    Null text: empty. The samples of the image (A, R, G, B per pixel) are the
    payload, behind which the largest images have spare ones. Equal texts give equal files. One file holds up to 1 GiB. Repeated
    rows and null doc_ids are kept; other columns are ignored.
    """
    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sizes = pc.binary_length(b.column(1)).to_pylist()
            for lo, hi in _chunks(sizes, WRITE_CHUNK):
                part = b.slice(lo, hi - lo)
                raw = [t or b"" for t in part.column(1).cast(pa.binary()).to_pylist()]
                files = encode_many([t + PAD * (-len(t) % UNIT if t else UNIT) for t in raw])
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([len(t) for t in raw], pa.int64()), pa.array(files, pa.binary())], ["doc_id", "n_bytes", "media"])

    return source.mapInArrow(run, "doc_id long, n_bytes long, media binary")


def _read(files: list[bytes | None]) -> tuple[list[np.ndarray | None], list[str | None]]:
    """Pixels of each file, and errors; together if all are sound, else one by one."""
    try:
        read = decode_many([f for f in files if f is not None])
        return [None if f is None else next(read) for f in files], [None] * len(files)
    except (ValueError, IndexError):
        found: list[np.ndarray | None] = []
        errors: list[str | None] = []
        for f in files:
            try:
                found.append(None if f is None else next(decode_many([f])))
                errors.append(None)
            except (ValueError, IndexError) as wrong:
                found.append(None)
                errors.append(str(wrong) or "broken stream")
        return found, errors


def read_webp(media: DataFrame, column: str = "media") -> DataFrame:
    """All other columns, and ``width, height, pixels, error`` of each file in ``column``: row by row, four bytes A, R, G, B a pixel.

    Null files give nulls. Files that are no lossless WebP or broken give null
    pixels and what is wrong with them as ``error``. Columns of ``media`` with
    one of the four names give way to the new ones; other columns and repeated
    rows are kept.
    """
    made = ("width", "height", "pixels", "error")
    rest = [c for c in media.columns if c != column and c.lower() not in made]
    source = media.select(*rest, F.col(column).cast("binary").alias("media"))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in source.schema.fields[:-1]) + (", " if rest else "") + "width int, height int, pixels binary, error string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            files = b.column(b.num_columns - 1)
            for lo, hi in _chunks([2 * (n or 0) for n in pc.binary_length(files).to_pylist()], CHUNK):
                part = b.slice(lo, hi - lo)
                own = part.column(b.num_columns - 1).to_pylist()
                found, errors = _read(own)
                yield pa.RecordBatch.from_arrays(
                    [
                        *part.columns[:-1], pa.array([None if p is None else p.shape[1] for p in found], pa.int32()), pa.array([None if p is None else p.shape[0] for p in found], pa.int32()),
                        pa.array([None if p is None else p.tobytes() for p in found], pa.binary()), pa.array(errors, pa.string()),
                    ],
                    [*rest, *made],
                )

    return source.mapInArrow(run, schema)


def feature(pixels: np.ndarray) -> str:
    """Mean and spread of the four channels and the mean step between neighbours in a row."""
    p = pixels.reshape(-1, 4).astype(np.int64)
    n = len(p)
    step = np.abs(p[1:] - p[:-1]).sum() if n > 1 else 0
    mean, square = p.sum(0), (p * p).sum(0)
    spread = np.sqrt(np.maximum(0, square / n - (mean / n) ** 2))
    return ",".join(f"{x:.3f}" for x in (*(mean / n), *spread, step / n))


def media_digests(docs: DataFrame) -> DataFrame:
    """Texts stored as WebP, read back, and what the stored and the read bytes are: one row per document.

    Empty and null texts: one unit of padding. Row order, repeated rows and null doc_ids stay as they are.
    """
    stored = texts_to_webp(docs).select("doc_id", "n_bytes", F.octet_length("media").cast("long").alias("media_bytes"), F.sha2("media", 256).alias("media_sha256"), "media")
    pixels = read_webp(stored)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            own = b.column(b.schema.get_field_index("pixels"))
            columns: list[list] = [[], [], [], []]
            for p, n in zip(own, b.column(b.schema.get_field_index("n_bytes")).to_pylist(), strict=True):
                p = p.as_py()[: payload_length(n)]
                for c, v in zip(columns, (len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-32:]), feature(np.frombuffer(p, np.uint8))), strict=True):
                    c.append(v)
            kinds = (pa.int64(), pa.string(), pa.int64(), pa.string())
            yield pa.RecordBatch.from_arrays([*b.columns[:4], *(pa.array(c, k) for c, k in zip(columns, kinds, strict=True))], [*b.schema.names[:4], "payload_bytes", "payload_sha256", "tail_crc32", "feature"])

    out = pixels.select("doc_id", "n_bytes", "media_bytes", "media_sha256", "pixels").mapInArrow(run, "doc_id long, n_bytes long, media_bytes long, media_sha256 string, payload_bytes long, payload_sha256 string, tail_crc32 long, feature string")
    return out.select("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature")
