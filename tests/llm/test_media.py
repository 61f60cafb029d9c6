import hashlib
import os
import random
import zlib

import numpy as np
import pytest
from helixframe.llm import webp
from helixframe.llm.media import media_digests, payload_length, read_webp
from helixframe.llm.webp import BitWriter, code_lengths, codes_of, container, cross_colour, decode_many, encode_many, plane_offsets, predictor, write_code


def write_image(out, pixels, cache_bits=0, tokens=None, main=True, tile=None):
    """A test writer for any tokens: ("p", argb), ("r", length, distance code), ("c", index)."""
    argb = pixels.reshape(-1, 4).astype(np.int64)
    tokens = tokens or [("p", tuple(p)) for p in argb.tolist()]
    out.put(1 if cache_bits else 0, 1)
    if cache_bits:
        out.put(cache_bits, 4)
    if main:
        out.put(0, 1)
    sizes = (280 + (1 << cache_bits if cache_bits else 0), 256, 256, 256, 40)
    counts = [[0] * n for n in sizes]

    def split(v):
        if v <= 4:
            return v - 1, 0, 0
        v -= 1
        top = v.bit_length() - 1
        return 2 * top + ((v >> (top - 1)) & 1), v & ((1 << (top - 1)) - 1), top - 1

    plan = []
    for t in tokens:
        if t[0] == "p":
            a, r, g, b = t[1]
            plan.append([(0, g, 0, 0), (1, r, 0, 0), (2, b, 0, 0), (3, a, 0, 0)])
        elif t[0] == "r":
            s, e, n = split(t[1])
            d, f, m = split(t[2])
            plan.append([(0, 256 + s, e, n), (4, d, f, m)])
        else:
            plan.append([(0, 280 + t[1], 0, 0)])
    for row in plan:
        for c, s, _, _ in row:
            counts[c][s] += 1
    lengths = [code_lengths(c, 15) for c in counts]
    for n in lengths:
        write_code(out, n)
    for row in plan:
        for c, s, extra, bits in row:
            single = sum(1 for n in lengths[c] if n) == 1
            if not single:
                out.put(int(codes_of(np.array(lengths[c]), 15)[s]), lengths[c][s])
            out.put(extra, bits)


def head(w, h):
    out = BitWriter()
    for v, n in ((0x2F, 8), (w - 1, 14), (h - 1, 14), (1, 1), (0, 3)):
        out.put(v, n)
    return out


def done(out):
    return container(out.value.to_bytes(-(-out.size // 8), "little"))


def noise(h, w, seed=0, most=256):
    return np.random.default_rng(seed).integers(0, most, (h, w, 4)).astype(np.uint8)


def test_round_trip():
    payloads = [os.urandom(576 * 5), b"\xff" * 576, bytes([1, 2] * 288), b"plain words " * 48 * 30, bytes(range(256)) * 9]
    for p, px in zip(payloads, decode_many(encode_many(payloads)), strict=True):
        assert px.tobytes() == p
    long = (b"some long text %d " * 40_000)[: 576 * 1000]
    assert next(decode_many(encode_many([long]))).tobytes() == long


@pytest.mark.parametrize("mode", range(14))
def test_predictor(mode):
    px, tiles = noise(9, 11), np.zeros((3, 3, 4), np.uint8)
    tiles[..., 2] = mode
    out = head(11, 9)
    out.put(1, 1), out.put(0, 2), out.put(0, 3)
    write_image(out, tiles, main=False)
    out.put(0, 1)
    write_image(out, predictor(px, 2, tiles, forward=True))
    assert (next(decode_many([done(out)])) == px).all()


def test_predictor_by_hand():
    tiles = np.zeros((1, 1, 4), np.uint8)
    tiles[..., 2] = 11
    rest = np.array([[[0, 1, 2, 3], [1, 1, 1, 1]], [[2, 2, 2, 2], [1, 0, 0, 0]]], np.uint8)
    # first pixel on opaque black, first row on the left, first column on the top, then select
    want = np.array([[[255, 1, 2, 3], [0, 2, 3, 4]], [[1, 3, 4, 5], [2, 3, 4, 5]]], np.uint8)
    assert (predictor(rest, 2, tiles) == want).all()


def test_colour_transforms():
    px, tiles = noise(10, 7, 1), noise(3, 2, 2)
    out = head(7, 10)
    out.put(1, 1), out.put(1, 2), out.put(0, 3)
    write_image(out, tiles, main=False)
    out.put(1, 1), out.put(2, 2), out.put(0, 1)
    coded = cross_colour(px, 2, tiles, forward=True)
    coded[..., 1] -= coded[..., 2]
    coded[..., 3] -= coded[..., 2]
    write_image(out, coded)
    assert (next(decode_many([done(out)])) == px).all()


@pytest.mark.parametrize("colours", [2, 3, 16, 40])
def test_palette(colours):
    table = noise(1, colours, 3)
    index = np.random.default_rng(4).integers(0, colours, (5, 13))
    px = table[0][index]
    bits = 3 if colours <= 2 else 2 if colours <= 4 else 1 if colours <= 16 else 0
    out = head(13, 5)
    out.put(1, 1), out.put(3, 2), out.put(colours - 1, 8)
    write_image(out, np.diff(table.astype(np.int64), axis=1, prepend=0).astype(np.uint8), main=False)
    out.put(0, 1)
    each = 8 >> bits
    packed = np.zeros((5, (13 + (1 << bits) - 1) >> bits, 4), np.uint8)
    for x in range(13):
        packed[:, x >> bits, 2] |= (index[:, x] << ((x & ((1 << bits) - 1)) * each)).astype(np.uint8)
    write_image(out, packed)
    assert (next(decode_many([done(out)])) == px).all()


def test_back_references_and_cache():
    px = noise(6, 8, 5, 4)
    flat = [tuple(p) for p in px.reshape(-1, 4).tolist()]
    # a literal, a run of it, the pixel above by a short distance, a far copy, a cached colour
    value = lambda p: p[0] << 24 | p[1] << 16 | p[2] << 8 | p[3]
    tokens, want = [], []
    for p in flat[:9]:
        tokens.append(("p", p))
        want.append(p)
    tokens.append(("r", 3, plane_offsets().index((1, 0)) + 1))
    want += [want[-1]] * 3
    tokens.append(("r", 8, plane_offsets().index((0, 1)) + 1))
    for _ in range(8):
        want.append(want[-8])
    tokens.append(("r", 20, 120 + 11))
    for _ in range(20):
        want.append(want[-11])
    while len(want) < 48:
        p = want[2]
        tokens.append(("c", (0x1E35A7BD * value(p) & 0xFFFFFFFF) >> 28))
        same = [q for q in want if (0x1E35A7BD * value(q) & 0xFFFFFFFF) >> 28 == tokens[-1][1]]
        want.append(same[-1])
    out = head(8, 6)
    out.put(0, 1)
    write_image(out, px, cache_bits=4, tokens=tokens)
    assert next(decode_many([done(out)])).reshape(-1, 4).tolist() == [list(p) for p in want]


def test_short_distances():
    # the first ones as the format lists them
    assert plane_offsets()[:12] == [(0, 1), (1, 0), (1, 1), (-1, 1), (0, 2), (2, 0), (1, 2), (-1, 2), (2, 1), (-2, 1), (2, 2), (-2, 2)]
    assert len(plane_offsets()) == 120 and plane_offsets()[-1] == (8, 7)


def brute(text):
    raw = (text or "").encode()
    p = raw + b"\xff" * (-len(raw) % 576 if raw else 576)
    return len(raw), len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-32:])


def test_table(spark):
    texts = [None, "", "a", "é" * 288, "x" * 576, "y" * 577, "long " * 40_000, "\0", "日本"]
    df = spark.createDataFrame([(i, t, b"m") for i, t in enumerate(texts)] + [(None, "a", None)] * 2, "doc_id long, text string, media binary")
    rows = media_digests(df).collect()
    got = sorted((-1 if r.doc_id is None else r.doc_id, r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) for r in rows)
    assert got == sorted([(i, *brute(t)) for i, t in enumerate(texts)] + [(-1, *brute("a"))] * 2)
    assert len({(r.media_sha256, r.feature) for r in rows if r.n_bytes == 1 and r.doc_id in (None, 2)}) == 1
    assert media_digests(df.limit(0)).collect() == []
    assert read_webp(spark.createDataFrame([(1, None)], "a int, media binary")).first().pixels is None


def test_whole_table(spark):
    df = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = {r.doc_id: (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) for r in media_digests(df).collect()}
    assert got == {r.doc_id: brute(r.text) for r in df.collect()}


def test_sides():
    for units in (1, 16384, 16385, 16386, 32769, 32770, 1_048_577, 1 << 30 >> 6):
        pixels = units * 144 if units < 1 << 22 else 1 << 28
        width, height = webp.image_side(pixels)
        assert max(width, height) <= 1 << 14 and 0 <= width * height - pixels < width
    with pytest.raises(ValueError):
        webp.image_side((1 << 28) + 1)


def test_odd_units(monkeypatch):
    """Images of up to 200 pixels a side; 201 units are 201 rows of 144 pixels, or 145 of 200 with some to spare."""
    monkeypatch.setattr(webp, "SIDE", 200)
    payloads = [os.urandom(576 * n) for n in (3, 200, 201, 203)]
    for p, px in zip(payloads, decode_many(encode_many(payloads)), strict=True):
        raw = px.tobytes()
        assert raw[: len(p)] == p and set(raw[len(p) :]) <= {255} and payload_length(len(p) - 100) == len(p)


def test_broken_files(spark):
    """A bad file gives an error, the rest their pixels; an extended file is read by its image chunk."""
    good = encode_many([bytes(range(256)) * 9])[0]
    at = 12
    chunk = good[at:]
    extended = b"VP8X" + (10).to_bytes(4, "little") + b"\x10" + b"\0" * 9 + b"ICCP" + (3).to_bytes(4, "little") + b"abc\0" + chunk
    extended = b"RIFF" + (4 + len(extended)).to_bytes(4, "little") + b"WEBP" + extended
    rows = [(1, good, "w"), (2, b"no image", "w"), (3, good[:-40], "w"), (4, None, "w"), (5, extended, "w"), (6, b"RIFF\x04\0\0\0WEBP", "w"), (7, good[:30] + b"\xff" * (len(good) - 30), "w")]
    got = {r.id: r for r in read_webp(spark.createDataFrame(rows, "id int, media binary, Width string")).collect()}
    assert got[1].pixels == got[5].pixels == bytes(range(256)) * 9 and got[1].error is None
    assert all(got[k].pixels is None and got[k].error for k in (2, 3, 6)) and got[4].pixels is None and got[4].error is None
    assert got[7].pixels is not None or got[7].error
    assert set(got[1].asDict()) == {"id", "width", "height", "pixels", "error"}


def test_written_references_and_cache(spark):
    """Images that repeat themselves: runs beyond the longest match, far copies, cached colours; and the files of a whole table hold them."""
    rnd = random.Random(2)
    unit = lambda n: bytes(rnd.randrange(256) for _ in range(n))
    far = unit(576 * 40)
    few = [unit(4) for _ in range(6)]
    mixed = b"".join(rnd.choice(few) for _ in range(2000))
    payloads = [b"\xff" * 576, b"\0" * 576 * 200, unit(4) * 144, far + far, unit(12) * 48 * 30, far[:576] + b"ab" * 288 * 3, mixed[: 576 * 13] + b"\xff" * 576 * 14, b"\0" * 576 * 30 + far[:576]]
    files = encode_many(payloads)
    for p, px in zip(payloads, decode_many(files), strict=True):
        assert px.tobytes() == p
    heads = [webp.Image(f) for f in files]
    assert len(files[1]) < 200 and len(files[3]) < 0.6 * len(payloads[3])
    assert any(h.codes.cache_bits for h in heads) and sum(h.codes.groups[0][0][256:280].any() for h in heads) >= 5
    texts = [r.text for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").orderBy("doc_id").collect()]
    heads = [webp.Image(f) for f in encode_many([(t or "").encode() + b"\xff" * (-len((t or "").encode()) % 576 if t else 576) for t in texts])]
    kinds = [(bool(h.codes.cache_bits), bool(h.codes.groups[0][0][256:280].any())) for h in heads]
    print({k: kinds.count(k) for k in set(kinds)})
    assert any(r for _, r in kinds) and not all(r for _, r in kinds)
    # alone or among others, a payload gives the same file
    assert [encode_many([p])[0] for p in payloads] == files
