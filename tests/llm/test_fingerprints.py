import hashlib

import pytest
from hypothesis import given
from hypothesis import strategies as st

from lexisweep.llm import fingerprints, registered
from lexisweep.llm.fingerprints import fingerprint, likeness


def phrases(text):
    seen, start = [], 0
    for end in range(1, len(text) + 1):
        if text[start:end] not in seen:
            seen.append(text[start:end])
            start = end
    return set(seen) | ({text[start:]} if start < len(text) else set())


@given(st.text(alphabet="abé \U0001f600", max_size=200), st.text(alphabet="abcé ", max_size=200))
def test_exact_when_small(one, other):
    a, b = phrases(one), phrases(other)
    if len(a | b) <= fingerprints.SIZE:
        want = 1.0 if a == b else len(a & b) / len(a | b)
        assert abs(likeness(fingerprint(one), fingerprint(other)) - want) < 1e-12
    assert len(fingerprint(one)) == 8 * min(fingerprints.SIZE, len(a))


@given(st.text(alphabet="ab", max_size=80), st.text(alphabet="ab", max_size=40), st.text(alphabet="ab", max_size=40))
def test_shared_beginning(common, one, other):
    pair = fingerprints.fingerprint_pair(common + one, common + other, len(common))
    assert pair == (fingerprint(common + one), fingerprint(common + other))
    found = fingerprints.Phrases(common + one)
    assert found.ends == plain_ends(common + one)


def plain_ends(text):
    seen, ends, start = set(), [], 0
    for end in range(1, len(text) + 1):
        if text[start:end] not in seen:
            seen.add(text[start:end])
            ends.append(end)
            start = end
    return ends + [len(text)] * (start < len(text))


def expected(rows):
    rows = sorted(((i, t or "") for i, t in rows), key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
    out = []
    for k, (i, text) in enumerate(rows):
        after = rows[(k + 1) % len(rows)][1]
        cut = len(text) // 4
        edited = text[: len(text) - cut] + after[:cut]
        marks = [fingerprint(t) for t in (text, edited, after)]
        out.append((
            i, len(text), hashlib.sha256(edited.encode()).hexdigest(), marks[0], marks[1],
            likeness(marks[0], marks[1]), likeness(marks[0], marks[2]),
        ))
    return out


@pytest.mark.parametrize("size", [0, 1, 2, 9, 60])
def test_rows(spark, size):
    rows = [(7 * k % 64 + 5, f"Text {k} é " * (k % 5) + "the end \U0001f600" * k) for k in range(size)]
    if size == 9:
        rows += [(None, "no id"), (None, None), (9, "same id"), (9, "another"), (200, ""), rows[3]]
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], "doc_id long, text string, block string, next int")
    out = fingerprints.edited_likeness(df).collect()
    key = lambda r: tuple(map(str, r))
    assert sorted(map(tuple, out), key=key) == sorted(expected(rows), key=key)


def test_long_text(spark):
    df = spark.createDataFrame([(1, "ab" * 200_000)], "doc_id long, text string")
    assert tuple(fingerprints.edited_likeness(df).first()) == expected([(1, "ab" * 200_000)])[0]


def test_query(spark, data):
    rows = [tuple(r) for r in spark.read.parquet(f"{data}/documents.parquet").select("doc_id", "text").collect()]
    out = registered.QUERIES["op4_fingerprints"](spark, data).collect()
    assert sorted(map(tuple, out)) == sorted(expected(rows))
    long = [r for r in out if r.n_chars > 400]
    assert sum(r.near_edited > r.near_next for r in long) > 0.97 * len(long)
