"""Byte-level BPE ids, equal to those of the ``tokenizers`` library for the same file.

A byte-level BPE never merges across pre-tokens. Where no two white-space
characters stand side by side, the pre-tokens follow from a pattern without
look-ahead, which ``tiktoken`` over the same vocabulary runs many times as fast.
Texts this does not cover (special strings, unusual white space, characters
beyond Latin) go to the library itself.
"""

from __future__ import annotations

import json
from array import array
from collections.abc import Iterator
from functools import cached_property, lru_cache

import numpy as np

#: Byte-level pre-tokens of texts whose white space is single.
PATTERN = r"'(?:[stmd]|re|ve|ll)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+"
#: Longer texts are coded in parts, which begin at blanks.
PART = 1 << 20
#: Lead bytes of UTF-8 from here on are beyond Latin; lower bytes than the second are control characters.
_BEYOND, _BLANK = 0xCA, 0x20


def byte_alphabet() -> dict[str, int]:
    """The printable stand-in of each byte in byte-level vocabularies."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


def _plain(text: str) -> bool:
    """Whether single blanks and newlines are the only white space, inside the text, and all characters are Latin."""
    flat = text.replace("\n", " ")
    if "  " in flat or flat[0] == " " or flat[-1] == " " or "\xa0" in flat or "\x85" in flat:
        return False
    raw = np.frombuffer(flat.encode("utf-8", "surrogatepass"), np.uint8)
    return bool(raw.min() >= _BLANK and raw.max() < _BEYOND)


def _parts(text: str) -> Iterator[str]:
    at = 0
    while len(text) - at > PART:
        # a blank begins a pre-token
        cut = text.find(" ", at + PART)
        if cut < 0:
            break
        yield text[at:cut]
        at = cut
    yield text[at:]


class ByteBpe:
    def __init__(self, path: str):
        import tiktoken

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        pre, model = spec["pre_tokenizer"] or {}, spec["model"]
        if spec["normalizer"] or model["type"] != "BPE" or pre.get("type") != "ByteLevel" or pre.get("add_prefix_space") or not pre.get("use_regex", True):
            raise ValueError("a byte-level BPE file without normaliser or prefix blank is needed")
        self.path = path
        self.special = [t["content"] for t in spec["added_tokens"]]
        code = byte_alphabet()
        added = {t["id"] for t in spec["added_tokens"]}
        ranks = {bytes(code[c] for c in piece): i for piece, i in model["vocab"].items() if i not in added}
        self.fast = tiktoken.Encoding("byte-bpe", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})._core_bpe.encode_ordinary

    @cached_property
    def library(self):
        from tokenizers import Tokenizer

        return Tokenizer.from_file(self.path)

    def encode(self, text: str) -> bytes:
        """Ids of a text as little-endian uint32 bytes."""
        if not text:
            return b""
        if _plain(text) and not any(s in text for s in self.special):
            return b"".join(np.array(array("I", self.fast(part)), "<u4").tobytes() for part in _parts(text))
        return np.array(self.library.encode(text, add_special_tokens=False).ids, "<u4").tobytes()


@lru_cache(maxsize=2)
def byte_bpe(path: str) -> ByteBpe:
    return ByteBpe(path)
