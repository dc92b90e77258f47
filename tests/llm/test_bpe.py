import hashlib

import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from lexisweep.llm import bpe, registered

PATH = public_tokenizers.path("byte_bpe_50k.tiktoken")
SMALL = bpe.Codec(PATH, public_tokenizers.PATTERN, leaf=8)
FULL = bpe.codec(PATH, public_tokenizers.PATTERN)
PIECES = ["the", " ", "  ", "'", "'s", "'re", "re", "\n", "12", "é", "!", "...", "日本", "a", "aaa", " ", "ly", "x1", "-", "'ll "]


@given(st.lists(st.sampled_from(PIECES), max_size=60).map("".join) | st.text(max_size=80))
@settings(max_examples=800, deadline=None)
def test_tree_equals_whole(text):
    ids = SMALL.bpe.encode_ordinary(text)
    assert SMALL.encode(text) == ids
    assert SMALL.decode(ids) == text.encode()


@given(st.lists(st.sampled_from(["a", "b", "th", "e", "ing", "zq"]), min_size=20, max_size=200).map("".join))
@settings(max_examples=200, deadline=None)
def test_one_long_word(text):
    assert SMALL.encode(text) == SMALL.bpe.encode_ordinary(text)


@pytest.mark.parametrize("text", ["a" * 50_000, " " * 20_001 + "x", "ab1!" * 9000, "=" * 30_000, "the of\n" * 9000])
def test_long_runs(text):
    assert FULL.encode(text) == FULL.bpe.encode_ordinary(text)
    assert FULL.decode(FULL.encode(text)) == text.encode()


def test_rows(spark):
    rows = [(1, "the the", "x"), (1, "the the", "x"), (None, None, None), (2, "", "y"), (3, "word " * 50_000, "")]
    df = spark.createDataFrame(rows, "doc_id long, text string, ids string")
    out = bpe.round_trip(df, PATH, public_tokenizers.PATTERN).collect()
    assert len(out) == 5
    assert {(r.doc_id, bytes(r.decoded)) for r in out} == {(i, (t or "").encode()) for i, t, _ in rows}
    assert bpe.round_trip(df.limit(0), PATH, public_tokenizers.PATTERN).collect() == []


def test_query(spark, data):
    texts = dict(spark.read.parquet(f"{data}/documents.parquet").select("doc_id", "text").collect())
    out = registered.QUERIES["op2_bpe"](spark, data).collect()
    assert len(out) == len(texts)
    for r in out:
        ids = FULL.bpe.encode_ordinary(texts[r.doc_id])
        raw = b"".join(i.to_bytes(4, "little") for i in ids)
        want = (len(ids), hashlib.sha256(raw).hexdigest(), hashlib.sha256(texts[r.doc_id].encode()).hexdigest())
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == want
