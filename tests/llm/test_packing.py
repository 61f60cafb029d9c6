import zlib

import numpy as np
import public_tokenizers
import pytest
from helixframe.llm.packing import cut, pack
from helixframe.llm.vocab import byte_bpe

PATH = public_tokenizers.path("byte_bpe_50k.json")


def library_ids(texts):
    from tokenizers import Tokenizer

    return [e.ids for e in Tokenizer.from_file(PATH).encode_batch([t or "" for t in texts], add_special_tokens=False)]


def check(rows, docs):
    """Each id in one piece, sequences gapless and within capacity, checksums right."""
    want = dict(zip(docs, library_ids(docs.values()), strict=True))
    pieces, sequences = {}, {}
    for r in rows:
        pieces.setdefault(r.doc_id, []).append(r)
        sequences.setdefault(r.sequence_id, []).append(r)
    assert set(pieces) == set(docs)
    for doc, own in pieces.items():
        ids, at = [*want[doc], 0], 0
        for r in sorted(own, key=lambda r: r.start):
            assert r.start == at and r.length > 0 and r.doc_tokens == len(ids)
            assert r.ids_crc32 == zlib.crc32(np.array(ids[at : at + r.length], "<u4").tobytes())
            at += r.length
        assert at == len(ids)
    for own in sequences.values():
        at = 0
        for r in sorted(own, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= 1024
    return sequences


def test_edges(spark):
    docs = {1: None, 2: "", 3: "a", 4: " lead", 5: "two  blanks\n\nlines ", 6: "x<|endoftext|>y", 7: "日本語 text é naïve", 8: "word " * 5000, 9: "z" * 30000, 10: "it's we'll 12.5% of\ttabs\x1c", 11: "ha.\nThe end", 12: "²³ a² b¾c"}
    df = spark.createDataFrame([(k, v, "x", 3) for k, v in docs.items()], "doc_id long, text string, start string, length int")
    check(pack(df, PATH).collect(), docs)
    assert pack(df.limit(0), PATH).collect() == []
    twice = pack(spark.createDataFrame([(None, "a b"), (None, "a b")], "doc_id long, text string"), PATH).collect()
    assert [(r.doc_id, r.start) for r in twice] == [(None, 0), (None, 0)]


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_whole_table(spark, sf):
    df = spark.read.parquet(f"/root/testdata/{sf}/documents.parquet")
    docs = {r.doc_id: r.text for r in df.collect()}
    sequences = check(pack(df, PATH).collect(), docs)
    used = sum(r.length for s in sequences.values() for r in s)
    assert used / (1024 * len(sequences)) > 0.98


def test_cut_keeps_all():
    for n in range(1, 3000):
        lengths = cut(n, 1024, 0.02)
        assert sum(lengths) == n and min(lengths) > 0


def test_ids_equal_library():
    bpe = byte_bpe(PATH)
    texts = ["the quick", "a\nb c\nd", "don't can't we've I'm you'd", "é è ß ñ", "###&&& %%% a_b", "A1B2 c3", "ª º µ", "\n", " ", "a b", "a\r\nb", "x́y", "😀 ok"]
    for text, ids in zip(texts, library_ids(texts), strict=True):
        assert np.frombuffer(bpe.encode(text), "<u4").tolist() == ids, text
