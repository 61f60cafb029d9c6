import public_tokenizers
from helixframe.llm import tokencount
import sentencepiece
from helixframe.llm.tokencount import count_tokens

PATH = public_tokenizers.path("piece_bpe_32k.model")
TEXTS = [None, "", " ", "  ", "a", " a", "a ", "a  b", "a\nb", "\n", "\n\n", " \n ", "a \nb", "▁", "a▁b", "a▁ b", "<s> x </s> <unk>", "日本語 のテキスト", "😀😀", "x" * 20000, "tab\tand\r\nlines", "\0null\0 1", "ab " * 6000]


def brute(texts):
    m = sentencepiece.SentencePieceProcessor(model_file=PATH)
    return [len(x) for x in m.encode([t or "" for t in texts], num_threads=1)]


def test_small(spark):
    for frequent in (1 << 18, 3, 0):
        df = spark.createDataFrame([(i, t, 1) for i, t in enumerate(TEXTS)] + [(None, "a b", 2)] * 2, "doc_id long, text string, n_tokens int")
        got = sorted((r.doc_id if r.doc_id is not None else -1, r.n_bytes, r.n_tokens, r.over_limit) for r in count_tokens(df, PATH, frequent=frequent).collect())
        texts = [*TEXTS, "a b", "a b"]
        want = sorted((i if i < len(TEXTS) else -1, len((t or "").encode()), n, n > 4096) for i, (t, n) in enumerate(zip(texts, brute(texts), strict=True)))
        assert got == want
    assert count_tokens(df.limit(0), PATH).collect() == []


def test_whole_table(spark):
    df = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    docs = df.collect()
    want = dict(zip([d.doc_id for d in docs], brute([d.text for d in docs]), strict=True))
    for frequent in (1 << 18, 500):
        assert {r.doc_id: r.n_tokens for r in count_tokens(df, PATH, frequent=frequent).collect()} == want


def test_flushes_by_size(spark, monkeypatch):
    """Small bounds on what is held at once change nothing."""
    monkeypatch.setattr(tokencount, "FLUSH_CHARS", 50)
    monkeypatch.setattr(tokencount, "ROW_CHARS", 50)
    docs = spark.createDataFrame([(i, "\u65e5\u672c" * 40 + f" word{i}") for i in range(9)], "doc_id long, text string")
    path = public_tokenizers.path("piece_bpe_32k.model")
    got = {r.doc_id: r.n_tokens for r in tokencount.count_tokens(docs, path).collect()}
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    assert got == {r.doc_id: len(sp.encode(r.text)) for r in docs.collect()}


def test_the_most_frequent_are_held_whatever_their_frequency(spark):
    """Very high and equal frequencies: as many as fit are chosen."""
    for freq in (7, 1 << 16, 10**15):
        df = spark.createDataFrame([(f"w{i}", freq) for i in range(10)] + [("rare", 1)], "pretoken string, freq long")
        assert df.where(tokencount.most_frequent(df, 3, 1 << 20)).count() == 3
        assert df.where(tokencount.most_frequent(df, 10, 1 << 20)).count() == 10
        assert df.where(tokencount.most_frequent(df, 100, 1 << 20)).count() == 11
        assert df.where(tokencount.most_frequent(df, 100, 7)).count() == 3
    rising = spark.createDataFrame([(f"w{i}", 2**i) for i in range(60)], "pretoken string, freq long")
    assert sorted(int(r.pretoken[1:]) for r in rising.where(tokencount.most_frequent(rising, 5, 1 << 20)).collect()) == [55, 56, 57, 58, 59]
    assert rising.where(tokencount.most_frequent(rising, 0, 1 << 20)).count() == 0
    assert rising.limit(0).where(tokencount.most_frequent(rising.limit(0), 3, 3)).count() == 0


def test_clashing_names(spark):
    df = spark.createDataFrame([(1, "a b", 3, "x", 9)], "doc_id long, text string, freq int, pretoken string, row int")
    assert [(r.doc_id, r.n_tokens) for r in count_tokens(df, PATH).collect()] == [(1, brute(["a b"])[0])]
