import re
import zlib
from collections import Counter

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lexisweep.llm import spelling


def apart(a, b):
    """The whole edit matrix."""
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def words_of(docs):
    counts = Counter()
    for i, text in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(c.lower() if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if h % 31 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            counts[run] += 1
    return {w: n for w, n in counts.items() if len(w) >= 7 and n >= 2}


def expected(docs):
    n = words_of(docs)
    near = {w: [v for v in n if abs(len(v) - len(w)) <= 1 and apart(v, w) == 1] for w in n}
    form = {}
    for w in n:
        best = min(near[w], key=lambda v: (-n[v], v), default=None)
        form[w] = best if best and n[best] >= 10 * n[w] else None

    def root(w):
        return root(form[w]) if form[w] else w

    return sorted((w, form[w], root(w), n[w], len(near[w]), n.get(form[w])) for w in n)


def run(spark, docs):
    table = spark.createDataFrame(docs, "doc_id long, text string")
    for name in ("word", "run", "n", "block", "key", "hash", "doc"):
        table = table.withColumn(name, F.lit("x"))
    rows = spelling.variants(table).collect()
    key = lambda r: r[0]
    return sorted((tuple(r) for r in rows), key=key)


WORDS = st.lists(st.text("abÿ", min_size=1, max_size=11), max_size=40)


@settings(max_examples=300, deadline=None)
@given(WORDS)
def test_lookup_finds_every_pair_that_shares_half(words):
    words = sorted(set(words))
    list_ = spelling.SortedWords(words)
    queries, found = list_.lookup(words)
    pairs = list(zip(queries.tolist(), found.tolist()))
    assert len(pairs) == len(set(pairs))
    assert set(pairs) == {
        (i, j)
        for i, a in enumerate(words)
        for j, b in enumerate(words)
        if a[: len(a) // 2] == b[: len(a) // 2] and apart(a, b) == 1
    }


@settings(max_examples=300, deadline=None)
@given(st.text("abc", max_size=9), st.text("abc", max_size=9))
def test_helpers(a, b):
    assert spelling.one_edit(a, b) == (apart(a, b) == 1)
    if apart(a, b) <= 1:
        assert all(spelling.may_hold(a, b[:k]) for k in range(len(b) + 1))


def corpus():
    stems = [f"{a}{b}{c}" for a in ("stand", "strand", "brand") for b in ("ing", "éch", "er") for c in "abc"]
    texts = []
    for k, stem in enumerate(stems):
        texts.append((k, f"{stem} " * (1 + k * k)))
        texts.append((k + 100, f"x{stem}, {stem[1:]}! {stem.upper()}x " * 2))
        texts.append((k + 200, f"{stem[:4]}q{stem[4:]} {stem[:4]}z{stem[5:]} " * (2 + k % 3)))
    chain = ["verbunden", "verbundem", "verbundex", "verbumdex"]
    texts += [(510 + k, f"{w} " * 12 ** (3 - k) * 2) for k, w in enumerate(chain)]
    long = "langeswort" * 4000
    texts += [(400, f"{long} {long}x {long[:9]}{long[10:]} " * 2)]
    texts += [(None, "nulldocument nulldocumant " * 2), (None, "nulldocument " * 3)]
    texts += [(401, None), (402, ""), (403, "1234 \n\t"), (404, "repeated words"), (404, "repeated words")]
    return texts


def checked(spark, docs):
    got, want = run(spark, docs), sorted(expected(docs))
    assert got == want
    return got


def test_brute_force(spark):
    docs = [(i, t) for i, t in corpus() if i != 400]
    got = checked(spark, docs)
    assert max(n_near for *_, n_near, _ in got) > 3
    assert any(form and root != form for _, form, root, *_ in got)


def test_many_blocks_and_slices(spark, monkeypatch):
    monkeypatch.setattr(spelling, "BLOCK_BYTES", 64)
    monkeypatch.setattr(spelling, "SLICE", 0.2)
    monkeypatch.setattr(spelling, "LOOKUPS", 5)
    checked(spark, [(i, t) for i, t in corpus() if i != 400])


def test_long_words(spark):
    long = "langeswort" * 4000
    text = f"{long} {long}x {long[:9]}{long[10:]} {long[::-1]} " * 2
    # Ids without a planted error.
    ids = [i for i in range(40) if len(words_of([(i, text)])) == 4 and long in words_of([(i, text)])][:1]
    got = {r[0]: r for r in run(spark, [(ids[0], text)])}
    assert got[long][4] == 2 and got[long + "x"][4] == 1 and got[long[::-1]][4] == 0


@pytest.mark.parametrize("docs", [[], [(1, None)], [(1, "short words only")]])
def test_no_words(spark, docs):
    assert run(spark, docs) == []
