import random

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tallyloom.llm import encode as e
from tallyloom.llm import vocab
from tallyloom.llm.words import split_batch

SCHEMA = "doc_id bigint, text string, ids string, words string, block string"
ODD = [
    None,
    "",
    " ",
    "\n\n\n",
    "   x y　\u0085z  ",
    "<|endoftext|> is text <|endoftext|>",
    "a  b   c\t\td\r\n e\n\n  f\n",
    "it's we'll I'd 'tis’s",
    "café naïve 你好 مرحبا \U0001f600\U0001f468‍\U0001f469",
    "x" * 5000 + " " * 3000 + "\n" * 2000 + "0123456789" * 500,
    "\x00\x01\x1c\x1d control \x7f",
    "tail space ",
    " lead",
]


def frame(spark, texts):
    return spark.createDataFrame([(i, t, "i", "w", "b") for i, t in enumerate(texts)], SCHEMA)


@given(st.lists(st.one_of(st.none(), st.text(alphabet="ab .\n\t\r   　\u0085é你'1", max_size=40)), max_size=8))
@settings(max_examples=300, deadline=None)
def test_words_are_the_text_and_encode_alone(texts):
    enc, sizes = vocab.encoder(), vocab.piece_sizes()
    n, words = split_batch(pa.array(texts, pa.string()))
    flat, at = words.to_pylist(), np.concatenate([[0], np.cumsum(n)])
    for t, a, b in zip(texts, at, at[1:]):
        assert "".join(flat[a:b]) == (t or "")
        assert [i for w in flat[a:b] for i in enc.encode_ordinary(w)] == enc.encode_ordinary(t or "")
    different = pa.array(sorted(set(flat)), pa.string())
    count, ids = e.encode_words(enc, sizes, different)
    ends = np.concatenate([[0], np.cumsum(count)])
    assert [ids[a:b].tolist() for a, b in zip(ends, ends[1:])] == [enc.encode_ordinary(w) for w in different.to_pylist()]


@pytest.mark.parametrize("block", [1, 50, e.BLOCK_WORDS])
def test_ids_equal_the_library(spark, block, monkeypatch):
    from tokenizers import Tokenizer

    monkeypatch.setattr(e.word_blocks, "__defaults__", (block,))
    rng = random.Random(block)
    texts = ODD + [" ".join(rng.choice(["the", "The", "fox,", "ran\n", "", "\t", "0x1f", "дом"]) for _ in range(rng.randrange(60))) for _ in range(150)]
    full = Tokenizer.from_file(f"{vocab.folder()}/byte_bpe_50k.json")
    full.encode_special_tokens = True
    df = frame(spark, texts).repartition(3)
    got = {r["doc_id"]: r["ids"] for r in e.encode_corpus(df, "doc_id", "text").collect()}
    assert got == {i: full.encode(t or "", add_special_tokens=False).ids for i, t in enumerate(texts)}
    sizes = {r["doc_id"]: r["n_tokens"] for r in e.count_tokens(df, "doc_id", "text").collect()}
    assert sizes == {i: len(x) for i, x in got.items()}


def test_round_trip(spark):
    df = frame(spark, ODD)
    back = {r["doc_id"]: r["text"] for r in e.decode_corpus(e.encode_corpus(df, "doc_id", "text"), "doc_id", "ids").collect()}
    assert back == {i: t or "" for i, t in enumerate(ODD)}


def test_repeats_null_ids_other_ids_and_empty(spark):
    df = spark.createDataFrame([("a", "x y"), ("a", "x y"), (None, "x"), ("b", None)], "doc_id string, text string")
    got = sorted((r["doc_id"] or "", len(r["ids"])) for r in e.encode_corpus(df, "doc_id", "text").collect())
    assert got == [("", 1), ("a", 2), ("a", 2), ("b", 0)]
    assert e.encode_corpus(df.where("false"), "doc_id", "text").count() == 0


def test_documents_come_back(spark, monkeypatch):
    import __spark_entry__ as entry

    lost, folder = entry.queries()["p6_lost"], f"{entry.DATA}/sf0.001"
    assert lost(spark, folder).count() == 0
    real = e.decode_corpus
    monkeypatch.setattr(e, "decode_corpus", lambda df, i, ids: real(df.where("doc_id % 2 = 0"), i, ids))
    odd = spark.read.parquet(f"{folder}/documents.parquet").where("doc_id % 2 <> 0").count()
    assert lost(spark, folder).count() == odd > 0


def test_decoding_keeps_a_row_each(spark, monkeypatch):
    enc = vocab.encoder()
    lists = [enc.encode_ordinary("alpha beta"), enc.encode_ordinary("gamma"), None, [], [None, -1, 10**6, *enc.encode_ordinary("ω")], enc.encode_ordinary("\U00010450")[:1]]
    keys = [1, 1, None, None, 2, 3]
    df = spark.createDataFrame([(k, x, "t") for k, x in zip(keys, lists)], "doc_id bigint, ids array<int>, text string").coalesce(1)
    want = [(1, "alpha beta"), (1, "gamma"), (None, ""), (None, ""), (2, "ω")]
    for most in (1, 10**7):
        monkeypatch.setattr(e, "DECODED_IDS", most)
        got = [(r["doc_id"], r["text"]) for r in e.decode_corpus(df, "doc_id", "ids").collect()]
        assert got[:5] == want and got[5][0] == 3 and "\ufffd" in got[5][1]
    assert e.decode_corpus(df.where("false"), "doc_id", "ids").count() == 0


def test_hot_words_are_split(spark, monkeypatch):
    """Partitions that the places of hot words fill are split, and the ids stay the same."""
    monkeypatch.setattr(e.word_blocks, "__defaults__", (20,))
    df = frame(spark, ["the same words again and again %d" % (i % 3) for i in range(3000)])
    want = {r["doc_id"]: r["ids"] for r in e.encode_corpus(df, "doc_id", "text").collect()}
    spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", "2000")
    try:
        out = e.encode_corpus(df, "doc_id", "text")
        assert {r["doc_id"]: r["ids"] for r in out.collect()} == want
        assert "AQEShuffleRead" in out._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.adaptive.advisoryPartitionSizeInBytes")
    assert want[0] == vocab.encoder().encode_ordinary("the same words again and again 0")
