"""Quality from weak labels: labellers, expectation-maximisation, linear scorer.

1. Labellers are rules of thumb that vote good, bad or nothing on a text.
2. What each is worth is estimated without true labels: a document is good or
   bad, each labeller votes given that by its own probabilities, and
   expectation-maximisation fits those.  It needs only how often each pattern of
   votes occurs, at most 3 ** 8 rows whatever the corpus.
3. The posteriors of the patterns label a bounded sample, on which a logistic
   scorer over hashed features is trained; it scores every document.
"""

from dataclasses import dataclass

import numpy
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexisweep.llm.common import text_digest
from lexisweep.llm.shingles import mixed, word_hashes
from lexisweep.staging import staged

# Rows of either posterior label, at most, that the scorer is trained on.
SAMPLE = 4096

# Hash buckets of features.
BUCKETS = 1024

# Score from which on a document is kept.
KEEP = 0.5

# Classes of bytes: letters, capitals, digits, white space, and each sign its own.
_CLASS = numpy.zeros(256, dtype=numpy.int64)
_CLASS[ord("A") : ord("Z") + 1] = 1
_CLASS[ord("0") : ord("9") + 1] = 2
_CLASS[[9, 10, 11, 12, 13, 32]] = 3
_SIGNS = [b for b in range(33, 127) if not chr(b).isalnum()]
_CLASS[_SIGNS] = 4 + numpy.arange(len(_SIGNS))
_KINDS = 4 + len(_SIGNS)
_USUAL = [ord(c) for c in ".,;:!?'\"()-"]

# Name, bound from which on a text is bad, bound up to which it is
# good; in between, and for texts of under FEW words, there is no vote.
LABELLERS = [
    ("odd signs per character", 0.02, 0.008),
    ("capitals among letters", 0.5, 0.15),
    ("words equal to the one before", 0.25, 0.05),
    ("missing variety of words", 0.9, 0.7),
    ("words of signs only", 0.1, 0.02),
    ("exclamation marks per word", 0.2, 0.05),
    ("odd lengths of words", 0.5, 0.2),
    ("doubled signs per word", 0.2, 0.05),
]
FEW = 8


def measures(text, described=True):
    """The labellers' quantities, the number of words, and the hashed features
    (counts per bucket) unless ``described`` is false."""
    raw = numpy.frombuffer((text or "").encode(), dtype=numpy.uint8)
    words = word_hashes(text or "")
    n = len(words)
    kinds = _CLASS[raw]
    counts = numpy.bincount(raw, minlength=256)
    by_kind = numpy.bincount(kinds, minlength=_KINDS)
    letters = by_kind[0] + by_kind[1]
    signs = by_kind[4:].sum()
    usual = counts[_USUAL].sum()
    solid = numpy.diff(numpy.concatenate(([0], kinds != 3, [0])).astype(numpy.int8))
    starts, ends = numpy.flatnonzero(solid == 1), numpy.flatnonzero(solid == -1)
    sign = numpy.concatenate(([0], numpy.cumsum(kinds >= 4)))
    sizes = ends - starts
    every = max(n, 1)
    values = numpy.array(
        [
            (signs - usual) / max(len(raw), 1),
            by_kind[1] / max(letters, 1),
            float((words[1:] == words[:-1]).sum()) / every,
            1 - len(numpy.unique(words)) / every,
            float((sign[ends] - sign[starts] == sizes).sum()) / every,
            counts[ord("!")] / every,
            float((sizes > 30).sum()) / every,
            float(((raw[1:] == raw[:-1]) & (kinds[1:] >= 4)).sum()) / every,
        ]
    )
    if not described:
        return values, n, None
    pairs = kinds[:-1] * _KINDS + kinds[1:] if len(kinds) > 1 else kinds[:0]
    found, times = numpy.unique(pairs, return_counts=True)
    steps = numpy.minimum((values * 20).astype(int), 20) + 32 * numpy.arange(1, len(values) + 1)
    vector = numpy.zeros(BUCKETS, dtype=numpy.float32)
    numpy.add.at(vector, _bucket(found), numpy.sqrt(times / max(len(pairs), 1)))
    numpy.add.at(vector, _bucket(steps + _KINDS * _KINDS), 0.3)
    return values, n, vector


def _bucket(codes):
    return (mixed(codes.astype(numpy.uint64) + numpy.uint64(1)) % numpy.uint64(BUCKETS)).astype(int)


def votes(values, n):
    """One letter per labeller: b(ad), g(ood) or - ."""
    if n < FEW:
        return "-" * len(LABELLERS)
    return "".join(
        "b" if v >= bad else "g" if v <= good else "-"
        for v, (_, bad, good) in zip(values, LABELLERS)
    )


def fit_votes(patterns, rounds=200):
    """{pattern: probability that such a document is good}, by
    expectation-maximisation over a {pattern: count}."""
    names = sorted(patterns)
    if not names:
        return {}
    weight = numpy.array([patterns[p] for p in names], dtype=float)
    chosen = numpy.array([[[c == v for v in "bg-"] for c in p] for p in names], dtype=float)
    # Bad is what any labeller calls bad, to begin with.
    good = numpy.where([("b" in p) for p in names], 0.1, 0.95)
    for _ in range(rounds):
        old = good
        shares = numpy.stack([1 - good, good]) * weight
        prior = (shares.sum(axis=1) + 1) / (weight.sum() + 2)
        cast = numpy.einsum("cp,plv->clv", shares, chosen) + 0.1
        cast /= cast.sum(axis=2, keepdims=True)
        log = numpy.log(prior)[:, None] + numpy.einsum("plv,clv->cp", chosen, numpy.log(cast))
        good = 1 / (1 + numpy.exp(numpy.clip(log[0] - log[1], -500, 500)))
        if numpy.abs(good - old).max() < 1e-9:
            break
    return dict(zip(names, good.tolist()))


def fit_scorer(x, y, rounds=400, rate=4.0, decay=1e-4):
    """Weights and bias of a logistic scorer for soft labels, classes balanced."""
    x = x.astype(numpy.float32)
    share = max(min(float(y.mean()), 1 - 1e-6), 1e-6)
    weight = numpy.where(y > 0.5, 0.5 / share, 0.5 / (1 - share)) / len(y)
    w, bias = numpy.zeros(x.shape[1], dtype=numpy.float32), 0.0
    speed, drift = numpy.zeros_like(w), 0.0
    for _ in range(rounds):  # gradient steps with momentum
        p = 1 / (1 + numpy.exp(-(x @ w + bias)))
        error = (p - y) * weight
        speed = 0.9 * speed - rate * (x.T @ error + decay * w)
        drift = 0.9 * drift - rate * float(error.sum())
        w, bias = w + speed, bias + drift
    return w.astype(numpy.float32), bias


@dataclass(frozen=True)
class Model:
    weights: numpy.ndarray
    bias: float
    posterior: dict

    def score(self, vector, n):
        """0 to 1, higher is better; a text without words has 0."""
        if n == 0:
            return 0.0
        return float(1 / (1 + numpy.exp(-numpy.clip(vector @ self.weights + self.bias, -50, 50))))


def train(docs: DataFrame, sample: int = SAMPLE) -> Model:
    """Two passes over the texts: votes of all, features of the sampled rows.

    A class's sample is the rows of least hash of (doc_id, text), at most
    ``sample``; equal rows count once.  If all documents have the same label the
    scorer is constant, at that side of KEEP.
    """

    def cast(batches):
        for batch in batches:
            found = [votes(*measures(t.as_py(), False)[:2]) for t in batch.column("text")]
            yield pa.RecordBatch.from_arrays(
                [batch.column("key"), pa.array(found, pa.string())], ["key", "votes"]
            )

    keyed = docs.select(F.xxhash64("doc_id", text_digest()).alias("key"), "text")
    table = staged(keyed.mapInArrow(cast, "key bigint, votes string"), "votes")
    counts = table.groupBy("votes").count().collect()  # at most 3 ** 8 rows
    posterior = fit_votes({r["votes"]: r["count"] for r in counts})
    good = [p for p, value in posterior.items() if value > 0.5]
    bounds = []
    for side in (F.col("votes").isin(good), ~F.col("votes").isin(good)):
        least = table.filter(side).select("key").orderBy("key").limit(sample)
        bounds.append(least.agg(F.max("key")).first()[0])
    if None in bounds:
        bias = 50.0 if bounds[0] is not None else -50.0
        return Model(numpy.zeros(BUCKETS, numpy.float32), bias, posterior)

    def describe(batches):
        for batch in batches:
            keys, labels, vectors = [], [], []
            for key, text in zip(batch.column("key"), batch.column("text")):
                values, n, vector = measures(text.as_py())
                label = posterior[votes(values, n)]
                if key.as_py() <= bounds[0 if label > 0.5 else 1]:
                    keys.append(key.as_py())
                    labels.append(label)
                    vectors.append(vector.tobytes())
            yield pa.RecordBatch.from_arrays(
                [pa.array(keys, pa.int64()), pa.array(labels, pa.float64()), pa.array(vectors, pa.binary())],
                ["key", "label", "vector"],
            )

    chosen = keyed.filter(F.col("key") <= max(bounds)).dropDuplicates(["key"])
    rows = chosen.mapInArrow(describe, "key bigint, label double, vector binary").collect()
    rows.sort(key=lambda r: r["key"])  # at most 2 * sample rows
    x = numpy.array([numpy.frombuffer(r["vector"], numpy.float32) for r in rows])
    return Model(*fit_scorer(x, numpy.array([r["label"] for r in rows])), posterior)


def score_column(text, model: Model):
    """struct<votes, posterior, score> of a text column."""

    def scored(texts: pa.Array) -> pa.Array:
        found = []
        for text in texts:
            values, n, vector = measures(text.as_py())
            pattern = votes(values, n)
            found.append(
                {
                    "votes": pattern,
                    "posterior": model.posterior.get(pattern, 0.5),
                    "score": model.score(vector, n),
                }
            )
        kinds = [("votes", pa.string()), ("posterior", pa.float64()), ("score", pa.float64())]
        return pa.array(found, pa.struct(kinds))

    schema = "votes string, posterior double, score double"
    return F.arrow_udf(scored, f"struct<{schema.replace(' ', ':').replace(',:', ',')}>")(text)


def classify(docs: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """(doc_id, votes, posterior, score, kept) of every row.

    A text without words, or null, gets no votes and score 0, and is not kept.
    Repeated rows get the same result, null ids are no exception, and an empty
    table gives an empty one.  Only ``doc_id`` and ``text`` are read.
    """
    found = docs.select("doc_id", score_column(F.col("text"), train(docs, sample)).alias("found"))
    return found.select("doc_id", "found.*", (F.col("found.score") >= KEEP).alias("kept"))


def keep_good(docs: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """The rows of ``docs`` that ``classify`` keeps, all columns."""
    names = docs.columns
    scored = docs.select(
        F.struct(*names).alias("__doc"),
        score_column(F.col("text"), train(docs, sample))["score"].alias("__score"),
    )
    return scored.filter(F.col("__score") >= KEEP).select(
        *(F.col("__doc")[n].alias(n) for n in names)
    )
