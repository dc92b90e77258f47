import hashlib
import re

import duckdb
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lexisweep.llm import private_data as private
from lexisweep.llm import registered

PLAIN = [
    r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    r"[0-9]([\x20-]?[0-9])+",
    r"\+[0-9][\x20().0-9-]+[0-9]",
]


def luhn(digits):
    total = 0
    for place, digit in enumerate(map(int, reversed(digits))):
        digit *= 1 + place % 2
        total += digit - 9 * (digit > 9)
    return total % 10 == 0


def plain_base(text):
    """The contract's own patterns, as they stand."""
    found = []
    for kind, pattern in enumerate(PLAIN):
        for m in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", m[0])
            if (
                kind == 0
                or (kind == 1 and all(int(p) <= 255 for p in m[0].split(".")))
                or (kind == 2 and 12 <= len(digits) <= 19 and luhn(digits))
                or (kind == 3 and 9 <= len(digits) <= 15)
            ):
                found.append((m.start(), kind, m.end()))
    return sorted(found)


def expected(doc_id, text):
    base = plain_base(text or "")
    listed = ",".join(f"{private.KINDS[k]}:{a}:{b}" for a, k, b in base)
    counts = [sum(k == kind for _, k, _ in base) for kind in range(4)]
    return (doc_id, *counts, hashlib.sha256(listed.encode()).hexdigest())


PIECES = st.sampled_from(
    ["@", ".", "a", "b-c", "%", "+", "1", "12", " ", "  ", "-", "255", "256", "(", ")", "é", "\n",
     "4111111111111111", "x@y.z", "1.2.3.4", "+1 (017) 555-7713", "00", "[at]", "(dot)", "Anna Bolt"]
)


@settings(max_examples=1500, deadline=None)
@given(st.lists(PIECES, max_size=24).map("".join))
def test_base_spans_are_those_of_the_patterns(text):
    base, failing = private.base_spans(text)
    assert base == plain_base(text)
    loose = private.loose_spans(text, base, failing)
    assert loose == sorted(loose)
    spans = sorted(loose + base)
    for (_, k, end), (start, other, _) in zip(spans, spans[1:]):
        assert end <= start or (k < private.BASE and other < private.BASE)


def test_whole_table(spark, data):
    texts = duckdb.sql(f"select doc_id, text from '{data}/documents.parquet'").fetchall()
    names = ["doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256"]
    got = registered.op12_private(spark, data)
    rows = got.collect()
    assert sorted(tuple(r[n] for n in names) for r in rows) == sorted(expected(*t) for t in texts)
    of = dict(texts)
    for row in rows:
        spans = [s.split(":") for s in row["spans"].split(",") if s]
        base = [(int(a), private.KINDS.index(k), int(b)) for k, a, b in spans if k in private.KINDS[:4]]
        assert base == plain_base(of[row["doc_id"]] or "")
        assert len(spans) == len(base) + row["n_added"]


def found(spark, texts):
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    for name in ("spans", "row", "votes", "__weights"):
        docs = docs.withColumn(name, F.lit(1))
    return {
        r["doc_id"]: [(private.KINDS[s["kind"]], s["start"], s["end"]) for s in r["spans"]]
        for r in private.find_private(docs).collect()
    }


def corpus():
    """Prose with personal data told by context, and numbers that are none."""
    texts = []
    for k in range(400):
        a, b, c = 200 + k % 700, 100 + k * 7 % 900, 1000 + k * 13 % 9000
        number = f"{1000 + k}{2000 + k}{3000 + k}{4000 + k}"
        texts.append([
            f"Please call ({a}) {b}-{c} today or mail me at name{k}@host{k % 9}.org for more.",
            f"The phone is +1 ({a}) {b}-{c} and my card 4{k:03d}111111111111 was lost.",
            f"Page {k} of order no {number} in version {k}.2 of serial {number[::-1]}.",
            f"Nothing here but plain words and the year {1900 + k % 100}.",
            f"Write to bob{k} [at] host{k % 9} [dot] com, he is kind.",
        ][k % 5])
    return texts


def test_labellers_are_weighed_without_labels(spark):
    texts = corpus()
    got = found(spark, list(enumerate(texts)))
    kinds = [{kind for kind, _, _ in got[k]} for k in range(len(texts))]
    assert all("tel" in kinds[k] and "email" in kinds[k] for k in range(0, 400, 5))
    assert all("mail" in kinds[k] for k in range(4, 400, 5))
    assert not any(kinds[k] - {"card"} for k in range(2, 400, 5))  # numbers of orders
    assert not any(kinds[k] for k in range(3, 400, 5))


def test_odd_rows(spark):
    email = "x " * 70_000 + "anna@host.org"
    rows = [(1, None), (2, ""), (None, "a@b.co"), (3, "a@b.co"), (3, "a@b.co"), (4, email), (5, "1" * 50_000)]
    got = found(spark, rows)
    assert got[1] == got[2] == got[5] == []
    assert got[None] == got[3] == [("email", 0, 6)]
    assert got[4] == [("email", 140_000, 140_013)]
    assert found(spark, []) == {}
    assert found(spark, [(1, "no data")]) == {1: []}


def test_long_runs_take_linear_time():
    for text in ("a" * 400_000 + " @", "1" * 400_000, "1." * 200_000, "+1" + "(" * 300_000, "a@" * 150_000):
        base, failing = private.base_spans(text)
        private.loose_spans(text, base, failing)
