"""Lossless WebP (VP8L) in numpy: many images are coded side by side."""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from functools import lru_cache

import numpy as np

#: Fixed values of the format.
LENGTH_ORDER = (17, 18, 0, 1, 2, 3, 4, 5, 16, 6, 7, 8, 9, 10, 11, 12, 13, 14, 15)
CACHE_MULTIPLIER = 0x1E35A7BD
LITERALS, LENGTHS, DISTANCES, PLANE_CODES, SIDE = 256, 24, 40, 120, 1 << 14
#: Longest code that our own writer uses; the format allows 15.
WRITER_BITS = 11


@lru_cache(maxsize=1)
def plane_offsets() -> list[tuple[int, int]]:
    """(dx, dy) of the 120 short distances: by length, then by row of the longer reach, left before right."""
    near = [(dx, dy) for dy in range(8) for dx in range(-7, 9) if dy > 0 or dx > 0]
    return sorted(near, key=lambda p: (p[0] ** 2 + p[1] ** 2, abs(p[0]), -p[0]))


# ---------------------------------------------------------------- prefix codes


def code_lengths(counts: list[int], most: int) -> list[int]:
    """Lengths of a prefix code for the counts, none above ``most``."""
    used = [s for s, c in enumerate(counts) if c]
    out = [0] * len(counts)
    if len(used) < 2:
        for s in used:
            out[s] = 1
        return out
    while True:
        heap = [(c, s) for s, c in enumerate(counts) if c]
        heapq.heapify(heap)
        above, new = {}, len(counts)
        while len(heap) > 1:
            a, b = heapq.heappop(heap), heapq.heappop(heap)
            above[a[1]] = above[b[1]] = new
            heapq.heappush(heap, (a[0] + b[0], new))
            new += 1
        depth = {new - 1: 0}
        for node in range(new - 2, -1, -1):
            if node in above:
                depth[node] = depth[above[node]] + 1
        if max(depth[s] for s in used) <= most:
            for s in used:
                out[s] = depth[s]
            return out
        counts = [(c + 3) // 2 if c else 0 for c in counts]


@lru_cache(maxsize=16)
def _reversal(bits: int) -> np.ndarray:
    """The bit reversal of each value of so many bits."""
    v = np.arange(1 << bits, dtype=np.uint32)
    out = np.zeros_like(v)
    for k in range(bits):
        out |= ((v >> np.uint32(k)) & np.uint32(1)) << np.uint32(bits - 1 - k)
    return out


def codes_of(lengths: np.ndarray, bits: int) -> np.ndarray:
    """Canonical codes in the bit order of the stream (first bit lowest)."""
    order = np.lexsort((np.arange(len(lengths)), lengths))
    order = order[lengths[order] > 0]
    out = np.zeros(len(lengths), np.uint32)
    if len(order) > 1:
        size = lengths[order].astype(np.int64)
        start = np.cumsum(1 << (bits - size)) - (1 << (bits - size))
        out[order] = _reversal(bits)[start]
    return out


def lookup(lengths: np.ndarray, bits: int) -> np.ndarray:
    """Next ``bits`` bits -> symbol * 16 + code length. A code of one symbol takes no bits."""
    symbols = np.flatnonzero(lengths)
    if len(symbols) == 0:
        return np.zeros(1 << bits, np.uint16)
    if len(symbols) == 1:
        return np.full(1 << bits, symbols[0] << 4, np.uint16)
    order = symbols[np.argsort(lengths[symbols], kind="stable")]
    size = lengths[order].astype(np.int64)
    spread = np.repeat((order << 4 | size).astype(np.uint16), 1 << (bits - size))
    if len(spread) != 1 << bits:
        raise ValueError("a prefix code is not complete")
    return spread[_reversal(bits)]


# ---------------------------------------------------------------- bits


class BitWriter:
    def __init__(self):
        self.value, self.size = 0, 0

    def put(self, value: int, bits: int) -> None:
        self.value |= value << self.size
        self.size += bits


class BitReader:
    """Reads single fields of a stream; its first bytes are kept as one number."""

    HEAD = 512

    def __init__(self, data: bytes, at: int = 0):
        self.data, self.at = data, at
        self.value, self.end = int.from_bytes(data[: self.HEAD], "little"), 8 * (self.HEAD - 9)

    def get(self, bits: int) -> int:
        at = self.at
        self.at += bits
        if at < self.end:
            return (self.value >> at) & ((1 << bits) - 1)
        return (int.from_bytes(self.data[at >> 3 : (at >> 3) + 9], "little") >> (at & 7)) & ((1 << bits) - 1)

    def peek(self, bits: int) -> int:
        at = self.at
        if at < self.end:
            return (self.value >> at) & ((1 << bits) - 1)
        return (int.from_bytes(self.data[at >> 3 : (at >> 3) + 9], "little") >> (at & 7)) & ((1 << bits) - 1)


def write_code(out: BitWriter, lengths: list[int]) -> None:
    """A prefix code: one or two symbols in short form, else its lengths with runs of zeros."""
    used = [s for s, n in enumerate(lengths) if n]
    if len(used) <= 2 and all(s < 256 for s in used) and all(lengths[s] == 1 for s in used):
        used = used or [0]
        out.put(1, 1)
        out.put(len(used) - 1, 1)
        out.put(1, 1)
        out.put(used[0], 8)
        if len(used) == 2:
            out.put(used[1], 8)
        return
    tokens: list[tuple[int, int, int]] = []
    s, end = 0, (used[-1] + 1 if used else 0)
    end_of_all = len(lengths)
    while s < end:
        n = lengths[s]
        run = 1
        while s + run < end and lengths[s + run] == n:
            run += 1
        if n == 0 and run >= 3:
            run = min(run, 138)
            tokens.append((17, run - 3, 3) if run <= 10 else (18, run - 11, 7))
        else:
            run = 1
            tokens.append((n, 0, 0))
        s += run
    while s < end_of_all:
        run = min(138, end_of_all - s)
        tokens.append((18, run - 11, 7) if run >= 11 else (17, run - 3, 3) if run >= 3 else (0, 0, 0))
        s += run if run >= 3 else 1
    counts = [0] * 19
    for t, _, _ in tokens:
        counts[t] += 1
    own = code_lengths(counts, 7)
    codes = codes_of(np.array(own), 7).tolist()
    if sum(1 for n in own if n) == 1:
        codes, lens = [0] * 19, [0] * 19
    else:
        lens = own
    top = max((i + 1 for i, s in enumerate(LENGTH_ORDER) if own[s]), default=4)
    out.put(0, 1)
    out.put(max(4, top) - 4, 4)
    for s in LENGTH_ORDER[: max(4, top)]:
        out.put(own[s], 3)
    out.put(0, 1)
    for t, extra, bits in tokens:
        out.put(codes[t], lens[t])
        if bits:
            out.put(extra, bits)


def read_code(r: BitReader, size: int) -> np.ndarray:
    lengths = np.zeros(size, np.int64)
    if r.get(1):
        two, wide = r.get(1), r.get(1)
        lengths[r.get(8 if wide else 1)] = 1
        if two:
            lengths[r.get(8)] = 1
        return lengths
    own = np.zeros(19, np.int64)
    for s in LENGTH_ORDER[: r.get(4) + 4]:
        own[s] = r.get(3)
    table = lookup(own, 7).tolist()
    tokens = 2 + r.get(2 + 2 * r.get(3)) if r.get(1) else size
    out: list[int] = []
    before = 8
    get, peek = r.get, r.peek
    while len(out) < size and tokens:
        tokens -= 1
        hit = table[peek(7)]
        r.at += hit & 15
        t = hit >> 4
        if t < 16:
            out.append(t)
            if t:
                before = t
        elif t == 16:
            out += [before] * (3 + get(2))
        else:
            out += [0] * (3 + get(3) if t == 17 else 11 + get(7))
    out = out[:size]
    lengths[: len(out)] = out
    return lengths


# ---------------------------------------------------------------- writer


def container(stream: bytes) -> bytes:
    body = b"WEBPVP8L" + len(stream).to_bytes(4, "little") + stream + b"\0" * (len(stream) & 1)
    return b"RIFF" + len(body).to_bytes(4, "little") + body


def _put_payloads(heads: list[BitWriter], pixels: list[np.ndarray], lengths: np.ndarray, codes: np.ndarray) -> list[bytes]:
    """Streams of the heads and the coded pixels (uint8 rows in the order of the stream) behind them, all images at once."""
    count = np.array([len(p) for p in pixels])
    image = np.repeat(np.arange(len(pixels)), count)
    flat = np.concatenate(pixels)
    value, size = np.zeros(len(flat), np.uint64), np.zeros(len(flat), np.int64)
    for c in range(4):
        key = image * 256 + flat[:, c]
        value |= codes.reshape(-1)[key].astype(np.uint64) << size.astype(np.uint64)
        size += lengths.reshape(-1)[key]
    total = np.add.reduceat(size, np.cumsum(count) - count)
    words = [-(-(h.size + int(t)) // 64) + 1 for h, t in zip(heads, total, strict=True)]
    base = np.cumsum([0, *words])
    ends = np.cumsum(size)
    first = ends[np.cumsum(count) - 1] - total
    at = ends - size + np.repeat(base[:-1] * 64 + np.array([h.size for h in heads]) - first, count)
    word, shift = at >> 6, (at & 63).astype(np.uint64)
    out = np.zeros(base[-1] + 1, np.uint64)
    starts = np.flatnonzero(np.concatenate([[True], word[1:] != word[:-1]]))
    out[word[starts]] = np.bitwise_or.reduceat(value << shift, starts)
    over = np.flatnonzero((at & 63) + size > 64)
    out[word[over] + 1] |= value[over] >> (np.uint64(64) - shift[over])
    streams = []
    for k, h in enumerate(heads):
        own = out[base[k] : base[k + 1]]
        n = -(-(h.size + int(total[k])) // 8)
        head = np.frombuffer(h.value.to_bytes(8 * len(own), "little"), np.uint64)
        streams.append((own | head).tobytes()[:n])
    return streams


def image_side(pixels: int) -> tuple[int, int]:
    """Width and height of the image for a number of pixels; the last row may have some to spare."""
    width = 144
    while -(-pixels // width) > SIDE and width < SIDE:
        width = min(2 * width, SIDE)
    height = -(-pixels // width)
    if height > SIDE:
        raise ValueError("too long for one image")
    return width, height


#: Shortest back-reference, its longest length, and the share of an image's pixels they must cover to be written.
LEAST_MATCH, LONGEST_MATCH, PAYS = 4, 4096, 0.5
#: Bits of the colour cache that is written if it pays.
CACHE_BITS = 6


def _cache_place(pixels: np.ndarray, bits: int) -> np.ndarray:
    return (np.uint32(CACHE_MULTIPLIER) * pixels) >> np.uint32(32 - bits)


def _latest(pixels: np.ndarray, key: np.ndarray) -> np.ndarray:
    """How far back the last pixel of the same key is, if it is equal; else 0."""
    order = np.argsort(key, kind="stable")
    same = (key[order][1:] == key[order][:-1]) & (pixels[order][1:] == pixels[order][:-1])
    out = np.zeros(len(pixels), np.int64)
    out[order[1:]] = np.where(same, order[1:] - order[:-1], 0)
    return out


def _matches(pixels: np.ndarray, image: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, length and distance of the stretches that repeat what stands at one distance before them."""
    back = _latest(pixels, image << 32 | pixels)
    cut = np.concatenate([[True], (back[1:] != back[:-1]) | (image[1:] != image[:-1])])
    start = np.flatnonzero(cut)
    size = np.diff(np.concatenate([start, [len(pixels)]]))
    keep = (back[start] > 0) & (size >= LEAST_MATCH)
    return start[keep], size[keep], back[start][keep]


def _prefix(value: int) -> tuple[int, int, int]:
    """Symbol, extra bits and their number for a length or distance."""
    if value <= 4:
        return value - 1, 0, 0
    top = (value - 1).bit_length() - 1
    second = (value - 1) >> (top - 1) & 1
    return 2 * top + second, (value - 1) & ((1 << (top - 1)) - 1), top - 1


def _encode_matched(pixels: np.ndarray, width: int, height: int, matches: list[tuple[int, int, int]]) -> bytes:
    """An image (ARGB numbers) with back-references, and a colour cache if it is hit often enough."""
    place = _cache_place(pixels, CACHE_BITS)
    hit = _latest(pixels, place) > 0
    covered = np.zeros(len(pixels), bool)
    for at, n, _ in matches:
        covered[at : at + n] = True
    loose = np.flatnonzero(~covered)
    cached = bool(len(loose)) and hit[loose].mean() > 0.25
    tokens: list[tuple] = []  # (symbol of green, what follows)
    counts = [[0] * (LITERALS + LENGTHS + (cached << CACHE_BITS)), [0] * 256, [0] * DISTANCES]
    jump = {at: (n, d) for at, n, d in matches}
    at = 0
    while at < len(pixels):
        if at in jump:
            n, d = jump[at]
            at += n
            distance = _prefix(2 if d == 1 else d + PLANE_CODES)
            counts[2][distance[0]] += -(-n // LONGEST_MATCH)
            while n:
                part = _prefix(min(n, LONGEST_MATCH))
                counts[0][LITERALS + part[0]] += 1
                tokens.append((LITERALS + part[0], part, distance))
                n -= min(n, LONGEST_MATCH)
            continue
        p = int(pixels[at])
        if cached and hit[at]:
            s = LITERALS + LENGTHS + int(place[at])
            counts[0][s] += 1
            tokens.append((s,))
        else:
            rest = (p >> 16 & 255, p & 255, p >> 24)
            counts[0][p >> 8 & 255] += 1
            for v in rest:
                counts[1][v] += 1
            tokens.append((p >> 8 & 255, rest))
        at += 1
    lengths = [code_lengths(c, WRITER_BITS) for c in counts]
    codes = [codes_of(np.array(x), WRITER_BITS).tolist() for x in lengths]
    # a code of one symbol takes no bits
    size = [[0] * len(x) if sum(map(bool, x)) < 2 else x for x in lengths]
    out = BitWriter()
    for value, bits in ((0x2F, 8), (width - 1, 14), (height - 1, 14), (1, 1), (0, 3), (0, 1)):
        out.put(value, bits)
    out.put(int(cached), 1)
    if cached:
        out.put(CACHE_BITS, 4)
    out.put(0, 1)
    write_code(out, lengths[0])
    for _ in range(3):
        write_code(out, lengths[1])
    write_code(out, lengths[2])
    for symbol, *more in tokens:
        out.put(codes[0][symbol], size[0][symbol])
        if len(more) == 1:
            for v in more[0]:
                out.put(codes[1][v], size[1][v])
        elif more:
            (_, extra, bits), (d, further, wide) = more
            out.put(extra, bits)
            out.put(codes[2][d], size[2][d])
            out.put(further, wide)
    return out.value.to_bytes(-(-out.size // 8), "little")


def encode_many(payloads: list[bytes]) -> list[bytes]:
    """WebP files whose samples (A, R, G, B of each pixel, left to right) are the payloads, multiples of 576 bytes.

    An image that the payload does not fill ends in samples of 255. Images that
    repeat themselves enough (``PAYS``) have back-references and, where it is
    hit often, a colour cache; all others are literal pixels under one prefix
    code, written for each of the four channels, so that they are read side by
    side. Transforms do not make the bytes of texts any shorter.
    """
    raws, sides = [], []
    for p in payloads:
        raw = np.frombuffer(p, np.uint8)
        width, height = image_side(len(raw) // 4)
        if spare := 4 * width * height - len(raw):
            raw = np.concatenate([raw, np.full(spare, 255, np.uint8)])
        raws.append(raw)
        sides.append((width, height))
    if not raws:
        return []
    count = np.array([len(r) // 4 for r in raws])
    image = np.repeat(np.arange(len(raws)), count)
    pixels = np.concatenate(raws).view(">u4").astype(np.uint32)
    first = np.cumsum(count) - count
    start, size, back = _matches(pixels, image)
    share = np.bincount(image[start], size, minlength=len(raws)) / count
    out: list[bytes] = [b""] * len(raws)
    for k in np.flatnonzero(share >= PAYS):
        own = slice(*np.searchsorted(start, [first[k], first[k] + count[k]]))
        found = list(zip((start[own] - first[k]).tolist(), size[own].tolist(), back[own].tolist(), strict=True))
        out[k] = container(_encode_matched(pixels[first[k] : first[k] + count[k]], *sides[k], found))
    rest = np.flatnonzero(share < PAYS).tolist()
    heads, rows = [], []
    lengths, codes = np.zeros((len(rest), 256), np.int64), np.zeros((len(rest), 256), np.uint32)
    for j, k in enumerate(rest):
        raw, (width, height) = raws[k], sides[k]
        own = code_lengths(np.bincount(raw, minlength=256).tolist(), WRITER_BITS)
        h = BitWriter()
        for value, bits in ((0x2F, 8), (width - 1, 14), (height - 1, 14), (1, 1), (0, 3), (0, 1), (0, 1), (0, 1)):
            h.put(value, bits)
        plain = BitWriter()
        write_code(plain, own)
        write_code(h, own + [0] * LENGTHS)
        for _ in range(3):
            h.put(plain.value, plain.size)
        for value, bits in ((1, 1), (0, 1), (0, 1), (0, 1)):  # a distance code of one symbol that no pixel uses
            h.put(value, bits)
        heads.append(h)
        one = sum(1 for n in own if n) == 1
        lengths[j] = 0 if one else own
        codes[j] = codes_of(np.array(own), WRITER_BITS)
        rows.append(raw.reshape(-1, 4)[:, [2, 1, 3, 0]])  # green, red, blue, alpha
    if rest:
        for k, stream in zip(rest, _put_payloads(heads, rows, lengths, codes), strict=True):
            out[k] = container(stream)
    return out


# ---------------------------------------------------------------- reader


class Image:
    """What the head of a stream says, and where its pixels' bits start."""

    def __init__(self, data: bytes):
        if data[:4] != b"RIFF" or data[8:12] != b"WEBP":
            raise ValueError("no WebP file")
        # the image may stand among other chunks of an extended file
        at = 12
        while data[at : at + 4] != b"VP8L":
            if at + 8 > len(data):
                raise ValueError("no lossless image in the file")
            n = int.from_bytes(data[at + 4 : at + 8], "little")
            at += 8 + n + (n & 1)
        size = int.from_bytes(data[at + 4 : at + 8], "little")
        self.stream = data[at + 8 : at + 8 + size]
        if len(self.stream) < size:
            raise ValueError("the file is cut off")
        r = self.reader = BitReader(self.stream)
        if r.get(8) != 0x2F:
            raise ValueError("no lossless stream")
        self.width, self.height = r.get(14) + 1, r.get(14) + 1
        self.alpha, version = r.get(1), r.get(3)
        if version:
            raise ValueError("unknown version")
        self.transforms: list[tuple] = []
        width = self.width
        while r.get(1):
            kind = r.get(2)
            if kind < 2:
                bits = r.get(3) + 2
                w, h = (width + (1 << bits) - 1) >> bits, (self.height + (1 << bits) - 1) >> bits
                self.transforms.append((kind, bits, width, read_pixels(r, w, h)))
            elif kind == 2:
                self.transforms.append((2, 0, width, None))
            else:
                size = r.get(8) + 1
                table = np.cumsum(read_pixels(r, size, 1).reshape(-1, 4), axis=0, dtype=np.uint8)
                bits = 3 if size <= 2 else 2 if size <= 4 else 1 if size <= 16 else 0
                self.transforms.append((3, bits, width, table))
                width = (width + (1 << bits) - 1) >> bits
        self.coded = width
        self.codes = Codes(r, width, self.height, True)


class Codes:
    """Colour cache, entropy image and prefix codes of a coded image."""

    def __init__(self, r: BitReader, width: int, height: int, main: bool):
        self.cache_bits = r.get(4) if r.get(1) else 0
        self.tile_bits, self.tiles, groups = 0, None, 1
        if main and r.get(1):
            self.tile_bits = r.get(3) + 2
            w, h = (width + (1 << self.tile_bits) - 1) >> self.tile_bits, (height + (1 << self.tile_bits) - 1) >> self.tile_bits
            tile = read_pixels(r, w, h).astype(np.int64)
            self.tiles = tile[:, :, 1] << 8 | tile[:, :, 2]
            groups = int(self.tiles.max()) + 1
        sizes = (LITERALS + LENGTHS + (1 << self.cache_bits if self.cache_bits else 0), 256, 256, 256, DISTANCES)
        self.groups = []
        for _ in range(groups):
            own: list[np.ndarray] = []
            span, size = (0, 0), 0
            for n in sizes:
                bits = span[1] - span[0]
                # the same bits again mean the same code
                if own and n == size and 0 < bits < 4096 and r.at + bits < r.end and (r.value >> span[0] ^ r.value >> r.at) & ((1 << bits) - 1) == 0:
                    r.at += bits
                    own.append(own[-1])
                    continue
                at = r.at
                own.append(read_code(r, n))
                span, size = (at, r.at), n
            self.groups.append(own)


def _extended(r: BitReader, symbol: int) -> int:
    if symbol < 4:
        return symbol + 1
    extra = (symbol - 2) >> 1
    return ((2 + (symbol & 1)) << extra) + r.get(extra) + 1


def read_pixels(r: BitReader, width: int, height: int, codes: Codes | None = None) -> np.ndarray:
    """One image, pixel by pixel: any mix of codes, back-references and cache hits. ARGB, height x width x 4."""
    codes = codes or Codes(r, width, height, False)
    wide = [[max(1, int(c.max())) for c in g] for g in codes.groups]
    tables = [[(n, lookup(c, n).tolist()) for c, n in zip(g, own, strict=True)] for g, own in zip(codes.groups, wide, strict=True)]
    out: list[int] = []
    cache, shift = [0] * (1 << codes.cache_bits), 32 - codes.cache_bits
    cached = 0
    total = width * height

    def next_symbol(table: tuple[int, list[int]]) -> int:
        hit = table[1][r.peek(table[0])]
        r.at += hit & 15
        return hit >> 4

    while len(out) < total:
        if r.at > 8 * len(r.data):
            raise ValueError("the stream ends too early")
        group = tables[0]
        if codes.tiles is not None:
            y, x = divmod(len(out), width)
            group = tables[codes.tiles[y >> codes.tile_bits, x >> codes.tile_bits]]
        s = next_symbol(group[0])
        if s < LITERALS:
            red, blue, alpha = next_symbol(group[1]), next_symbol(group[2]), next_symbol(group[3])
            out.append(alpha << 24 | red << 16 | s << 8 | blue)
        elif s < LITERALS + LENGTHS:
            length = _extended(r, s - LITERALS)
            distance = _extended(r, next_symbol(group[4]))
            if distance > PLANE_CODES:
                distance -= PLANE_CODES
            else:
                dx, dy = plane_offsets()[distance - 1]
                distance = max(1, dx + dy * width)
            if distance > len(out):
                raise ValueError("a back-reference reaches before the first pixel")
            length = min(length, total - len(out))
            while length:
                # what is copied may be copied again
                part = out[-distance:][:length]
                out += part
                length -= len(part)
        else:
            while cached < len(out):
                cache[(CACHE_MULTIPLIER * out[cached] & 0xFFFFFFFF) >> shift] = out[cached]
                cached += 1
            out.append(cache[s - LITERALS - LENGTHS])
    flat = np.array(out, ">u4")
    return flat.view(np.uint8).reshape(height, width, 4).copy()


def _side_by_side(images: list[Image]) -> list[np.ndarray]:
    """Images of literal pixels under one set of codes, decoded one pixel of each at a time."""
    bits = max(int(c.max()) for i in images for c in i.codes.groups[0][:4]) or 1
    place: dict[bytes, int] = {}
    tables, table_at = [], np.empty((4, len(images)), np.int64)
    for k, i in enumerate(images):
        for c, lengths in enumerate(i.codes.groups[0][:4]):
            key = lengths.astype(np.uint8).tobytes().rstrip(b"\0")
            if key not in place:
                place[key] = len(tables)
                tables.append(lookup(lengths, bits))
            table_at[c, k] = place[key] << bits
    flat = np.concatenate(tables)
    size = np.array([i.coded * i.height for i in images])
    order = np.argsort(-size, kind="stable")
    size, table_at = size[order], np.ascontiguousarray(table_at[:, order])
    base = np.cumsum([0] + [len(i.stream) + 16 for i in images])
    raw = np.frombuffer(b"".join(x for i in images for x in (i.stream, b"\0" * 16)) + b"\0" * 8, np.uint8)
    # the 64 bits from each byte on
    words = np.lib.stride_tricks.as_strided(raw, (base[-1], 8), (1, 1))
    at = base[:-1][order] * 8 + np.array([i.reader.at for i in images])[order]
    mask, steps = np.uint64((1 << bits) - 1), int(size[0])
    first = np.cumsum(np.concatenate([[0], size]))
    out = np.empty((first[-1], 4), np.uint16)
    active = np.searchsorted(-size, -np.arange(steps), "left").tolist()
    write = first[:-1].copy()
    for step in range(steps):
        n = active[step]
        a = at[:n]
        # four codes of at most 14 bits lie within 64 bits behind the first one's byte
        v = words[a >> 3].view(np.uint64).reshape(n) >> (a & 7).astype(np.uint64)
        hits = np.empty((n, 4), np.uint16)
        for c in range(4):
            hit = flat[table_at[c, :n] + (v & mask).view(np.int64)]
            hits[:, c] = hit
            length = hit & np.uint16(15)
            v >>= length
            a += length
        out[write[:n]] = hits
        write[:n] += 1
    out >>= np.uint16(4)
    ends = base[:-1][order] * 8 + np.array([8 * len(i.stream) for i in images])[order]
    if (at > ends).any():
        raise ValueError("a stream ends too early")
    done: list[np.ndarray] = [None] * len(images)
    for j, k in enumerate(order):
        i, own = images[k], out[first[j] : first[j + 1]]
        done[k] = own[:, [3, 1, 0, 2]].astype(np.uint8).reshape(i.height, i.coded, 4)
    return done


def decode_many(files: list[bytes], at_once: int = 4096, most_bytes: int = 1 << 24) -> Iterator[np.ndarray]:
    """The pixels of each file: height x width x 4 (A, R, G, B)."""
    lo = 0
    while lo < len(files):
        hi, total = lo, 0
        while hi < len(files) and hi - lo < at_once and (hi == lo or total + len(files[hi]) <= most_bytes):
            total += len(files[hi])
            hi += 1
        images = [Image(f) for f in files[lo:hi]]
        lo = hi
        alike = [i for i in images if i.codes.tiles is None and not i.codes.groups[0][0][LITERALS:].any() and max(int(c.max()) for c in i.codes.groups[0][:4]) <= 14]
        pixels = dict(zip(map(id, alike), _side_by_side(alike), strict=True)) if alike else {}
        for i in images:
            own = pixels[id(i)] if id(i) in pixels else read_pixels(i.reader, i.coded, i.height, i.codes)
            for t in reversed(i.transforms):
                own = invert(own, *t)
            if not i.alpha:
                own = own.copy()
                own[..., 0] = 255
            yield own


# ---------------------------------------------------------------- transforms


def _average(a, b):
    return (a + b) >> 1


def _select(left, top, corner):
    p = left + top - corner
    near_left = np.abs(p - left).sum(-1, keepdims=True)
    near_top = np.abs(p - top).sum(-1, keepdims=True)
    return np.where(near_left < near_top, left, top)


def _predict(mode: int, left, top, corner, right):
    """The prediction of a pixel from its neighbours (int arrays with a last axis of channels)."""
    if mode == 0 or mode > 13:
        return np.array([255, 0, 0, 0])
    return (
        lambda: left,
        lambda: top,
        lambda: right,
        lambda: corner,
        lambda: _average(_average(left, right), top),
        lambda: _average(left, corner),
        lambda: _average(left, top),
        lambda: _average(corner, top),
        lambda: _average(top, right),
        lambda: _average(_average(left, corner), _average(top, right)),
        lambda: _select(left, top, corner),
        lambda: np.clip(left + top - corner, 0, 255),
        lambda: np.clip(_average(left, top) + np.trunc((_average(left, top) - corner) / 2).astype(np.int64), 0, 255),
    )[mode - 1]()


def predictor(pixels: np.ndarray, bits: int, modes: np.ndarray, forward: bool = False) -> np.ndarray:
    """Add (or, forward, take off) each pixel's prediction; the green of ``modes`` names the rule of a tile."""
    h, w, _ = pixels.shape
    full = pixels.astype(np.int64)
    out = full.copy()
    whole = full if forward else out
    for y in range(h):
        for x in range(w):
            if y == 0 or x == 0:
                guess = np.array([255, 0, 0, 0]) if x == 0 and y == 0 else whole[y, x - 1] if y == 0 else whole[y - 1, x]
            else:
                # right of the last column stands the row's own first pixel
                right = whole[y - 1, x + 1] if x + 1 < w else whole[y, 0]
                guess = _predict(int(modes[y >> bits, x >> bits, 2]), whole[y, x - 1], whole[y - 1, x], whole[y - 1, x - 1], right)
            out[y, x] = (full[y, x] - guess if forward else full[y, x] + guess) & 255
    return out.astype(np.uint8)


def _signed(x: np.ndarray) -> np.ndarray:
    return x.astype(np.uint8).view(np.int8).astype(np.int64)


def cross_colour(pixels: np.ndarray, bits: int, tiles: np.ndarray, forward: bool = False) -> np.ndarray:
    """Take the green's share off red and blue, and the red's off blue; or put them back."""
    h, w, _ = pixels.shape
    t = tiles[np.arange(h)[:, None] >> bits, np.arange(w)[None] >> bits]
    red_to_blue, green_to_blue, green_to_red = _signed(t[..., 1]), _signed(t[..., 2]), _signed(t[..., 3])
    out = pixels.copy()
    green = _signed(pixels[..., 2])
    sign = -1 if forward else 1
    out[..., 1] = (pixels[..., 1].astype(np.int64) + sign * ((green_to_red * green) >> 5)) & 255
    red = _signed(pixels[..., 1] if forward else out[..., 1])
    out[..., 3] = (pixels[..., 3].astype(np.int64) + sign * (((green_to_blue * green) >> 5) + ((red_to_blue * red) >> 5))) & 255
    return out


def invert(pixels: np.ndarray, kind: int, bits: int, width: int, data: np.ndarray | None) -> np.ndarray:
    if kind == 0:
        return predictor(pixels, bits, data)
    if kind == 1:
        return cross_colour(pixels, bits, data)
    if kind == 2:
        out = pixels.copy()
        out[..., 1] += pixels[..., 2]
        out[..., 3] += pixels[..., 2]
        return out
    index = pixels[..., 2]
    if bits:
        each = 8 >> bits
        x = np.arange(width)
        index = (index[:, x >> bits] >> ((x & ((1 << bits) - 1)) * each).astype(np.uint8)) & ((1 << each) - 1)
    table = np.zeros((256, 4), np.uint8)
    table[: len(data)] = data
    return table[index]
