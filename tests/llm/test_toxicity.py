import math
import zlib
from collections import Counter

import numpy
import pytest

from lexisweep.llm import registered, toxicity


@pytest.mark.parametrize("seed", range(6))
def test_nearest_equals_brute_force(seed):
    rng = numpy.random.default_rng(seed)
    vectors = []
    for _ in range(700):
        terms = sorted(rng.choice(60, size=rng.integers(1, 8), replace=False).tolist())
        weights = rng.integers(1, 4, len(terms)).astype(float)
        vectors.append((terms, weights / numpy.sqrt(weights @ weights)))
    dense = numpy.zeros((700, 60))
    for row, (terms, weights) in enumerate(vectors):
        dense[row, terms] = weights
    index = toxicity.Index(vectors, block=16)
    for terms, weights in vectors[:80]:
        cosines = dense[:, terms] @ weights
        order = numpy.lexsort((numpy.arange(700), -numpy.round(cosines, 12)))[:15]
        order = order[cosines[order] > 0]
        found, scores = index.nearest(terms, weights)
        assert found.tolist() == order.tolist()
        assert numpy.allclose(scores, cosines[order])
    assert len(index.nearest([99], [1.0])[0]) == 0


def rows_and_labels():
    rows, labels = [], []
    for k in range(200):
        toxic = k % 4 == 0
        rows.append((k, f"plain words number {'abcdefghij'[k % 10] * 3} " + ("you dreadful rottenness" if toxic else "you kind soul")))
        labels.append((k, int(toxic)))
    return rows, labels


def test_rows(spark):
    rows, labels = rows_and_labels()
    rows += [(300, "Dreadful! ROTTENISH thing"), (301, ""), (302, None), (None, "dreadful rottenly"), (303, "kind " * 50_000), (300, "Dreadful! ROTTENISH thing")]
    docs = spark.createDataFrame([(*r, 0.5, "x") for r in rows], "doc_id long, text string, score double, terms string")
    marks = spark.createDataFrame([(*r, 1) for r in labels + [(1, None), (None, 1), (301, None)]], "doc_id long, toxic int, quality int")
    out = toxicity.classify(docs, marks).collect()
    assert len(out) == len(rows)
    for r in out:
        want = r.doc_id is None or zlib.crc32(str(r.doc_id).encode()) % 4 == 2
        assert r.held_out == want and 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3)
    got = {r.doc_id: r.predicted for r in out}
    assert all(got[k] == int(k % 4 == 0) for k in range(200))
    assert got[300] == 1 and got[None] == 1 and got[301] == got[302] == got[303] == 0
    assert toxicity.classify(docs.limit(0), marks).collect() == []
    none = toxicity.classify(docs, marks.limit(0)).collect()
    assert {r.score for r in none} == {0.0} and len(none) == len(rows)
    one = toxicity.classify(docs, marks.filter("toxic = 0")).collect()
    assert {r.predicted for r in one} == {0}


def test_held_out_labels_do_not_count(spark):
    rows, labels = rows_and_labels()
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    schema = "doc_id long, toxic int"
    turned = [(k, 1 - t if zlib.crc32(str(k).encode()) % 4 == 2 else t) for k, t in labels]
    a, b = (toxicity.classify(docs, spark.createDataFrame(x, schema)).collect() for x in (labels, turned))
    assert sorted((r.doc_id, r.score) for r in a) == sorted((r.doc_id, r.score) for r in b)


def test_query_on_held_out(spark, data):
    out = registered.QUERIES["op7_toxicity"](spark, data)
    assert out.columns[:4] == ["doc_id", "held_out", "score", "predicted"]
    assert out.count() == spark.read.parquet(f"{data}/documents.parquet").count()
    labels = spark.read.parquet(f"{data}/labels.parquet")
    rows = out.join(labels, "doc_id").filter("held_out").select("predicted", "toxic").collect()
    hit = sum(r.predicted == r.toxic for r in rows)
    assert hit >= 0.95 * len(rows)


def plain_terms(text):
    """Counts of words and of their beginnings."""
    found = Counter()
    for word in "".join(c if c.isalpha() else " " for c in (text or "").lower()).split():
        found.update([word] + [word[:n] + "-" for n in (4, 5, 6) if len(word) > n])
    return found


def plain_vote(vector, examples, zero_share):
    """By all cosines; examples: (id, toxic, vector)."""
    if not vector:
        return zero_share
    cosines = [(sum(w * v.get(t, 0) for t, w in vector.items()), i, toxic) for i, toxic, v in examples]
    near = sorted((-round(c, 12), i, toxic, c) for c, i, toxic in cosines if c > 0)[:15]
    votes = sum(c * c for *_, c in near)
    return (sum(c * c * toxic for *_, toxic, c in near) + 0.5 * zero_share) / (votes + 0.5)


def test_scores_equal_brute_force(spark):
    rows, labels = rows_and_labels()
    rows = [(k, t + (" dreadful day" if k % 7 == 0 else "")) for k, t in rows[:120]]
    rows += [(900, ""), (901, None), (902, "rottenly dreadful you")]
    marks = {k: int(t) if k % 9 else 1 - t for k, t in labels[:120] if zlib.crc32(str(k).encode()) % 4 != 2}
    terms = {k: plain_terms(t) for k, t in rows}
    by_label = [[set(terms[k]) for k in marks if marks[k] == label] for label in (0, 1)]
    share = lambda t, label: (sum(t in s for s in by_label[label]) + 0.5) / (len(by_label[label]) + 1)
    telling = {
        t
        for t in set().union(*by_label[1])
        if sum(t in s for s in by_label[1]) >= 3 and share(t, 1) / share(t, 0) >= 4
    }
    frequency = Counter(t for found in terms.values() for t in found)
    vectors = {}
    for k, found in terms.items():
        raw = {
            t: (1 + math.log(n)) * (math.log((len(rows) + 1) / (frequency[t] + 1)) + 1)
            for t, n in found.items()
            if t in telling
        }
        size = math.sqrt(sum(w * w for w in raw.values()))
        vectors[k] = {t: w / size for t, w in raw.items()}
    examples = [(k, marks[k], vectors[k]) for k in marks if vectors[k]]
    bare = [marks[k] for k in marks if not vectors[k]]
    zero_share = sum(bare) / len(bare) if bare else 0.0
    own = [plain_vote(vectors[k], [e for e in examples if e[0] != k], zero_share) for k in marks]
    curve = toxicity.fit_calibration(own, list(marks.values()), [1.0] * len(marks))
    assert telling and curve is not None
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    table = spark.createDataFrame(list({**dict(labels[:120]), **marks}.items()), "doc_id long, toxic int")
    got = {r.doc_id: r.score for r in toxicity.classify(docs, table).collect()}
    for k, _ in rows:
        want = toxicity.calibrated(plain_vote(vectors[k], examples, zero_share), curve)
        assert abs(got[k] - want) < 1e-6, k


def test_calibration():
    rng = numpy.random.default_rng(0)
    votes = rng.random(20_000)
    odds = 2 * numpy.log(votes / (1 - votes)) + 0.7
    labels = (rng.random(len(votes)) < 1 / (1 + numpy.exp(-odds))).astype(int)
    curve = toxicity.fit_calibration(votes, labels, numpy.ones(len(votes)))
    assert abs(curve[0] - 2) < 0.15 and abs(curve[1] - 0.7) < 0.15
    scores = [toxicity.calibrated(v, curve) for v in (0.0, 0.2, 0.5, 0.9, 1.0)]
    assert scores == sorted(scores) and 0 < scores[0] and scores[-1] < 1
    assert toxicity.fit_calibration([0.1, 0.2], [0, 0], [1, 1]) is None
    assert toxicity.fit_calibration([0.9, 0.1] * 9, [0, 1] * 9, [1] * 18) is None
    sharp = toxicity.fit_calibration([0.0] * 50 + [1.0] * 10, [0] * 50 + [1] * 10, [1] * 60)
    assert toxicity.calibrated(0.0, sharp) < 0.05 and toxicity.calibrated(1.0, sharp) > 0.85
