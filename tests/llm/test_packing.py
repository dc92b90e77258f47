import zlib
from collections import defaultdict

import numpy
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from lexisweep.llm import packing, registered
from lexisweep.llm.words import Words

PATH = public_tokenizers.path("word_bpe_49k.json")
PLAIN = Tokenizer.from_file(PATH)
PLAIN.encode_special_tokens = True


def ids_of(text):
    return PLAIN.encode(text or "", add_special_tokens=False).ids


@given(st.text(max_size=60) | st.lists(st.sampled_from(["The", "thing's", "é", "é", "x2", "İ", "...", ", ", "\x1c", " ", " ", "STRASSE", "don't", "<|endoftext|>", "日本", "²"]), max_size=20).map(" ".join))
@settings(max_examples=600, deadline=None)
def test_words_equal_whole(text):
    assert numpy.frombuffer(Words_.encode(text), "<u4").tolist() == ids_of(text)


Words_ = Words(PATH)


def test_patterns():
    found = packing.patterns(9, 3)
    assert len(found) == len(set(found)) == 12
    assert all(sum(p) == 9 and list(p) == sorted(p, reverse=True) for p in found)


def test_nnls():
    a = numpy.array([[1.0, 0, 1], [0, 1, 1]])
    x = packing.nnls(a, numpy.array([3.0, 2.0]))
    assert numpy.allclose(a @ x, [3, 2]) and (x >= 0).all()
    assert numpy.allclose(packing.nnls(a[:, :1], numpy.array([-1.0, 0.0])), 0)


def filled(ranges, histogram, capacity):
    seen, used = defaultdict(int), defaultdict(list)
    for length, low, high, sequence, offset in ranges:
        assert low == seen[length]
        seen[length] = high
        for k in range(high - low):
            used[sequence + k].append((offset, length))
    assert {k: v for k, v in seen.items() if v} == {k: v for k, v in histogram.items() if v}
    for parts in used.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= capacity
    return len(used)


@given(st.dictionaries(st.integers(1, 64), st.integers(0, 30), max_size=40))
@settings(max_examples=150, deadline=None)
def test_plan(histogram):
    made = packing.Plan(histogram, 64)
    made.fill_patterns(16, 4)
    made.fill_rest()
    n = filled(made.ranges, histogram, 64)
    total = sum(k * v for k, v in histogram.items())
    assert n == made.sequences and n >= -(-total // 64)
    assert n <= 2 * total / 64 + 1


def test_plan_is_tight():
    random = numpy.random.default_rng(1)
    lengths = numpy.minimum(2048, 1 + random.lognormal(6, 1, 20_000).astype(int))
    histogram = dict(zip(*(x.tolist() for x in numpy.unique(lengths, return_counts=True))))
    made = packing.plan(histogram, 2048)
    n = filled(made.ranges, histogram, 2048)
    assert n <= 1.003 * lengths.sum() / 2048 + 1
    assert len(made.ranges) < 20_000


def check(rows, out, capacity):
    found = defaultdict(list)
    for i, text in rows:
        ids = [*ids_of(text), 0]
        for piece, at in enumerate(range(0, len(ids), capacity)):
            part = numpy.array(ids[at : at + capacity], "<u4").tobytes()
            found[i, piece, at, len(part) // 4, zlib.crc32(part)].append(1)
    got = defaultdict(list)
    used = defaultdict(list)
    for r in out:
        got[r.doc_id, r.piece, r.start, r.length, r.ids_crc32].append(1)
        used[r.sequence_id].append((r.offset, r.length))
    assert got == found
    for parts in used.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= capacity
    return len(used), sum(r.length for r in out)


@pytest.mark.parametrize("capacity", [7, 100])
def test_edges(spark, capacity):
    rows = [(1, "a b c"), (1, "a b c"), (2, None), (3, ""), (None, "x"), (5, "long word " * 20_000)]
    df = spark.createDataFrame([(i, t, 9, "z") for i, t in rows], "doc_id long, text string, offset int, ids string")
    check(rows, packing.pack_documents(df, PATH, capacity).collect(), capacity)
    assert packing.pack_documents(df.limit(0), PATH, capacity).collect() == []


def test_query(spark, data):
    rows = spark.read.parquet(f"{data}/documents.parquet").select("doc_id", "text").collect()
    n, total = check(rows, registered.QUERIES["op9_packing"](spark, data).collect(), 2048)
    assert n <= 1.01 * total / 2048 + 1
