import re
from collections import Counter
from itertools import permutations

from pyspark.sql import functions as F

from lexisweep.llm.common import maybe_in
from lexisweep.llm.filter_audit import audit

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
LABELS = "doc_id long, quality int, toxic int"


def failures(docs):
    found = []
    for i, text, source in docs:
        text = text or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", text)
        failed = ""
        failed += "A" * (len(words) < 50)
        failed += "B" * (100 * len(set(words)) < 65 * len(words))
        failed += "C" * (100 * len(re.findall("[A-Z]", text)) > 5 * len(text))
        failed += "D" * bool(re.search("[#$%&*|]", text))
        failed += "E" * any(
            i is not None and j is not None and j < i and (other or "") == text for j, other, _ in docs
        )
        found.append((i, source or "", failed))
    return found


def expected(docs, labels):
    good = {i for i, quality, _ in labels if quality == 1 and i is not None}
    toxic = {i for i, _, bad in labels if bad == 1 and i is not None}
    rows, found = [], failures(docs)
    for part in {p for _, p, _ in found}:
        own, shapley = [f for f in found if f[1] == part], Counter()
        block = []
        for order in permutations("ABCDE"):
            for step, name in enumerate(order):
                gone = set(order[:step])
                removed = [f for f in own if name in f[2] and not gone & set(f[2])]
                shapley[name] += len(removed)
                block.append((
                    part, "".join(order), step + 1,
                    sum(not (gone | {name}) & set(f[2]) for f in own), len(removed),
                    sum(name in f[2] and bool(gone & set(f[2])) for f in own),
                    sum(f[2] == name for f in own),
                    sum(f[0] in good for f in removed), sum(f[0] in toxic for f in removed),
                ))
        rows += [row + (shapley[row[1][row[2] - 1]],) for row in block]
    return sorted(rows)


def run(spark, docs, labels):
    table = spark.createDataFrame([(i, t, "en", s, 0) for i, t, s in docs], DOCS)
    # Names of the operator's own columns among the documents' must not matter.
    for name in ("digest", "part", "bits", "words", "rows", "counts", "first"):
        table = table.withColumn(name, F.lit("x"))
    marks = spark.createDataFrame(labels, LABELS).withColumn("good", F.lit(5))
    return sorted(tuple(row) for row in audit(table, marks).collect())


LONG = " ".join(f"w{k}" for k in range(60))


def test_brute_force(spark):
    texts = [
        LONG, LONG, LONG + " #", "WORDS " * 60, "a b a b", "", None, "  \t ", LONG, "X|Y " * 30,
        LONG.upper(), "* " * 80, "word " * 70000,
    ]
    docs = [(k, t, f"s{k % 3}") for k, t in enumerate(texts)]
    docs += [(7, LONG, None), (7, LONG, None), (None, LONG, "s1"), (None, "", ""), (99, "", None)]
    docs += [(100 + k, "one hot text", "s0") for k in range(40)]
    labels = [(k, k % 2, k % 3 == 0) for k in range(0, 120, 2)]
    labels = [(i, q, int(t)) for i, q, t in labels] + [(4, 1, 0), (None, 1, 1), (8, None, None)]
    assert run(spark, docs, labels) == expected(docs, labels)


def test_no_labels(spark):
    docs = [(1, LONG, "a"), (0, LONG, "a")]
    assert run(spark, docs, []) == expected(docs, [])


def test_empty(spark):
    assert run(spark, [], [(1, 1, 1)]) == []


def test_equal_hashes_need_equal_texts(spark, monkeypatch):
    from lexisweep.llm import filter_audit

    monkeypatch.setattr(filter_audit, "text_digest", lambda: F.lit(b"same"))
    docs = [(1, LONG, "a"), (2, LONG + " x", "a"), (3, LONG, "a")]
    assert run(spark, docs, []) == expected(docs, [])


def test_maybe_in_loses_nothing(spark):
    rows = spark.range(20_000).withColumn("key", F.md5(F.col("id").cast("string")))
    wanted = rows.filter("id % 7 = 0").select("key")
    kept = {r["id"] for r in maybe_in(rows, wanted, "key").select("id").collect()}
    assert kept >= set(range(0, 20_000, 7))
    assert len(kept) < 3_500
    assert maybe_in(rows, wanted.limit(0), "key").count() == 0
