import math
import re
from collections import Counter

import numpy

from lexisweep.llm import quality, registered


def test_votes_are_weighed():
    # Two labellers that are right agree; the third is a coin.
    rng = numpy.random.default_rng(0)
    truth = rng.random(20_000) < 0.7
    flip = lambda p: numpy.where(rng.random(len(truth)) < p, truth, ~truth)
    cast = [flip(0.9), flip(0.85), flip(0.9), rng.random(len(truth)) < 0.5]
    patterns = {}
    names = ["".join("bg"[int(v)] for v in row) for row in zip(*cast)]
    for p in names:
        patterns[p] = patterns.get(p, 0) + 1
    posterior = quality.fit_votes(patterns)
    guess = numpy.array([posterior[p] > 0.5 for p in names])
    assert (guess == truth).mean() > 0.93
    assert abs(posterior["gggb"] - posterior["gggg"]) < 0.1
    assert quality.fit_votes({}) == {}


def test_scorer_learns():
    rng = numpy.random.default_rng(0)
    x = rng.random((500, 8))
    y = (x[:, 0] > x[:, 1]).astype(float)
    w, bias = quality.fit_scorer(x, y)
    assert (((x @ w + bias) > 0) == (y > 0.5)).mean() > 0.95


GOOD = "The river runs by the old mill and turns slowly to the sea. Nobody minds it, one year with another."
BAD = ["BUY NOW " * 40, "CLICK!! HERE!! NOW!! FREE!! MONEY!! GO!! GET!! IT!! TODAY!!", "ab%%% cd$$$ ef### gh&&& ij*** kl%%% mn$$$ op%%%", "win win win win " * 30]


def test_rows(spark):
    rows = [(k, GOOD + f" It is number {k}.") for k in range(40)]
    rows += [(100 + k, BAD[k % 4] + f" {k}") for k in range(12)]
    rows += [(1, rows[1][1]), (None, GOOD), (200, None), (201, ""), (202, "word and another thing " * 5000)]
    df = spark.createDataFrame([(*r, 0.5, "x") for r in rows], "doc_id long, text string, score double, votes string")
    out = quality.classify(df).collect()
    assert len(out) == len(rows)
    kept = {r.doc_id: r.kept for r in out}
    assert all(kept[k] for k in range(40)) and kept[None]
    assert not any(kept[100 + k] for k in range(12)) and not kept[200] and not kept[201]
    assert all(0 <= r.score <= 1 and 0 <= r.posterior <= 1 for r in out)
    good = quality.keep_good(df)
    assert good.columns == df.columns and good.count() == sum(r.kept for r in out)
    assert quality.classify(df.limit(0)).collect() == []
    alike = quality.classify(df.filter("doc_id < 40"))
    assert alike.filter("kept").count() == alike.count()


def test_query_against_labels(spark, data):
    out = registered.QUERIES["op3_quality"](spark, data)
    assert out.count() == spark.read.parquet(f"{data}/documents.parquet").count()
    labels = spark.read.parquet(f"{data}/labels.parquet")
    rows = out.join(labels, "doc_id").select("quality", "kept", "score").collect()
    good = [r for r in rows if r.quality == 1]
    bad = [r for r in rows if r.quality == 0]
    assert sum(r.kept for r in good) >= 0.99 * len(good)
    assert sum(not r.kept for r in bad) >= 0.95 * len(bad)


def plain_measures(text):
    """(quantities, number of words, kinds of bytes), byte by byte."""
    raw = (text or "").encode()
    words = [w.lower() for w in re.split(rb"[\t\n\v\f\r ]+", raw) if w]
    signs = [b for b in range(33, 127) if not chr(b).isalnum()]
    order = {b: 4 + k for k, b in enumerate(signs)}
    space, digits, capitals = b"\t\n\v\f\r ", b"0123456789", range(65, 91)
    kinds = [
        3 if b in space else 2 if b in digits else 1 if b in capitals else order.get(b, 0) for b in raw
    ]
    n = max(len(words), 1)
    values = [
        sum(b in signs and b not in b".,;:!?'\"()-" for b in raw) / max(len(raw), 1),
        kinds.count(1) / max(kinds.count(0) + kinds.count(1), 1),
        sum(a == b for a, b in zip(words, words[1:])) / n,
        1 - len(set(words)) / n,
        sum(all(b in signs for b in w) for w in words) / n,
        raw.count(b"!") / n,
        sum(len(w) > 30 for w in words) / n,
        sum(a == b and b in signs for a, b in zip(raw, raw[1:])) / n,
    ]
    return values, len(words), kinds


def plain_votes(values, n):
    found = ""
    for value, (_, bad, good) in zip(values, quality.LABELLERS):
        found += "-" if n < quality.FEW else "b" if value >= bad else "g" if value <= good else "-"
    return found


def plain_posteriors(cast, rounds=200):
    """Expectation-maximisation, document by document."""
    good = [0.1 if "b" in c else 0.95 for c in cast]
    for _ in range(rounds):
        total = [sum(1 - g for g in good), sum(good)]
        prior = [(t + 1) / (len(cast) + 2) for t in total]
        tables = []
        for k in range(len(cast[0])):
            counts = [{v: 0.1 for v in "bg-"} for _ in range(2)]
            for c, g in zip(cast, good):
                counts[0][c[k]] += 1 - g
                counts[1][c[k]] += g
            tables.append([{v: x / sum(t.values()) for v, x in t.items()} for t in counts])
        good = []
        for c in cast:
            odds = [prior[s] * math.prod(t[s][v] for t, v in zip(tables, c)) for s in (0, 1)]
            good.append(odds[1] / sum(odds))
    return good


def plain_bucket(code):
    mask = (1 << 64) - 1
    x = code + 1
    x = (x ^ (x >> 30)) * 0xBF58476D1CE4E5B9 & mask
    x = (x ^ (x >> 27)) * 0x94D049BB133111EB & mask
    return (x ^ (x >> 31)) % quality.BUCKETS


def plain_vector(values, kinds):
    all_kinds, vector = 4 + 32, numpy.zeros(quality.BUCKETS)
    pairs = Counter(a * all_kinds + b for a, b in zip(kinds, kinds[1:]))
    for code, times in pairs.items():
        vector[plain_bucket(code)] += math.sqrt(times / sum(pairs.values()))
    for k, value in enumerate(values):
        vector[plain_bucket(min(int(value * 20), 20) + 32 * (k + 1) + all_kinds**2)] += 0.3
    return vector


def plain_scores(vectors, labels, asked, rounds=400, rate=4.0, decay=1e-4):
    """Gradient steps with momentum on a balanced logistic loss."""
    share = sum(labels) / len(labels)
    w, bias, speed, drift = numpy.zeros(quality.BUCKETS), 0.0, numpy.zeros(quality.BUCKETS), 0.0
    for _ in range(rounds):
        slope, lean = decay * w, 0.0
        for x, y in zip(vectors, labels):
            error = 1 / (1 + math.exp(-(x @ w + bias))) - y
            error *= 0.5 / (share if y > 0.5 else 1 - share) / len(labels)
            slope, lean = slope + error * x, lean + error
        speed, drift = 0.9 * speed - rate * slope, 0.9 * drift - rate * lean
        w, bias = w + speed, bias + drift
    return [1 / (1 + math.exp(-(x @ w + bias))) for x in asked]


def test_equals_brute_force(spark):
    rows = [(k, GOOD + f" It is number {k}.") for k in range(30)]
    rows += [(100 + k, BAD[k % 4] + f" {k}") for k in range(12)]
    rows += [(200, "é ü Ω ##"), (201, ""), (202, None), (203, "FEW, w0rds!! here")]
    measured = [plain_measures(t) for _, t in rows]
    cast = [plain_votes(v, n) for v, n, _ in measured]
    posterior = plain_posteriors(cast)
    vectors = [plain_vector(v, kinds) for v, _, kinds in measured]
    scores = plain_scores(vectors, posterior, vectors)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r for r in quality.classify(df).collect()}
    for (i, _), c, p, s, (_, n, _) in zip(rows, cast, posterior, scores, measured):
        assert got[i].votes == c
        assert abs(got[i].posterior - p) < 1e-6
        assert abs(got[i].score - (s if n else 0)) < 1e-3
