"""Toxicity by the nearest labelled examples under TF-IDF cosine.

1. A bounded sample of labelled learning rows gives the examples, and the terms
   that go with the label (words and beginnings of words).  Only those terms make
   up a vector; else likeness in everything else would drown them.
2. One pass turns every document into the counts of these terms; document
   frequencies are taken over all documents.
3. The examples' vectors form an inverted index in blocks of examples with each
   term's largest weight per block.  A query adds up these bounds, visits blocks
   from the highest bound on, and stops when no block can reach its K-th best, so
   the nearest are exact.  The index is bounded by the sample and is broadcast.
4. The neighbours vote by squared cosine; what the sample says of documents
   without any term stands in where neighbours are far.
5. Votes of each example by its neighbours, itself left out, calibrate the scores:
   a logistic curve turns a vote into the share of such examples that are toxic.
"""

import math
import re
from collections import Counter

import numpy
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexisweep.staging import staged

# Examples of either label, and neighbours, at most.
SAMPLE = 8192
K = 15

# A term goes with the label if so many examples have it, and so many times the
# share of the others that do.
LEAST_EXAMPLES = 3
LEAST_RATIO = 4.0

# Lengths of beginnings of words that are terms, too.
BEGINNINGS = (4, 5, 6)

# Examples of a block of the index.
BLOCK = 64

# Weight of the prior against neighbours, each of which weighs at most 1.
PRIOR = 0.5

# Votes are this far from 0 and 1, at least, when they are calibrated.
LEAST_VOTE = 1e-3

# Score from which on a document is predicted toxic.
TOXIC = 0.3

# Words whose terms a task keeps before it starts anew.
KEPT = 1_000_000

_WORD = re.compile(r"[^\W\d_]+")


def terms_of(word):
    return (word, *(f"{word[:n]}-" for n in BEGINNINGS if len(word) > n))


class Counts:
    """Counts of vocabulary terms in texts."""

    def __init__(self, vocabulary):
        self.numbers, self.known = {t: k for k, t in enumerate(vocabulary)}, {}

    def of(self, text):
        """(term numbers, counts), sorted."""
        words, found = Counter(_WORD.findall((text or "").lower())), Counter()
        if len(self.known) > KEPT:
            self.known = {}
        for word, times in words.items():
            terms = self.known.get(word)
            if terms is None:
                hits = (self.numbers.get(t) for t in terms_of(word))
                terms = self.known[word] = tuple(n for n in hits if n is not None)
            for term in terms:
                found[term] += times
        terms = sorted(found)
        return terms, [found[t] for t in terms]


class Index:
    """Unit vectors of examples in blocks; exact nearest by largest cosine.

    Postings are in flat arrays by term and example.  A segment is the postings
    of a term in a block, with their largest weight.
    """

    def __init__(self, vectors, block=BLOCK):
        self.block, self.blocks = block, -(-len(vectors) // block)
        sizes = [len(terms) for terms, _ in vectors]
        terms = numpy.array([t for terms, _ in vectors for t in terms], dtype=int)
        weights = numpy.array([w for _, weights in vectors for w in weights], dtype=float)
        examples = numpy.repeat(numpy.arange(len(vectors)), sizes)
        order = numpy.lexsort((examples, terms))
        terms, self.examples, self.weights = terms[order], examples[order], weights[order]
        keys = terms * max(self.blocks, 1) + self.examples // block
        keys, self.starts = numpy.unique(keys, return_index=True)
        self.stops = numpy.append(self.starts[1:], len(terms))
        self.of_block = keys % max(self.blocks, 1)
        self.most = numpy.maximum.reduceat(self.weights, self.starts) if len(keys) else keys
        of_term = keys // max(self.blocks, 1)
        found, first = numpy.unique(of_term, return_index=True)
        last = numpy.append(first[1:], len(keys))
        self.segments = dict(zip(found.tolist(), zip(first.tolist(), last.tolist())))

    def nearest(self, terms, weights, k=K):
        """(examples, cosines) of the ``k`` largest positive cosines, largest
        first, ties to the earlier example."""
        known = [(self.segments[t], w) for t, w in zip(terms, weights) if t in self.segments]
        if not known:
            return numpy.zeros(0, int), numpy.zeros(0)
        segments = numpy.concatenate([numpy.arange(*ends) for ends, _ in known])
        asked = numpy.repeat([w for _, w in known], [b - a for (a, b), _ in known])
        of_block = self.of_block[segments]
        bounds = numpy.bincount(of_block, asked * self.most[segments], self.blocks)
        order = numpy.argsort(-bounds, kind="stable")
        order = order[: numpy.count_nonzero(bounds)]
        found, scores, at, step = numpy.zeros(0, int), numpy.zeros(0), 0, 8
        while at < len(order):
            # Bounds and scores are sums in the same order up to rounding.
            if len(scores) >= k and bounds[order[at]] < scores[k - 1] - 1e-9:
                break
            chosen = numpy.zeros(self.blocks, dtype=bool)
            chosen[order[at : at + step]] = True
            new, values = self._scored(segments[chosen[of_block]], asked[chosen[of_block]])
            found = numpy.concatenate([found, new])
            scores = numpy.concatenate([scores, values])
            best = numpy.lexsort((found, -numpy.round(scores, 12)))[:k]
            found, scores = found[best], scores[best]
            at, step = at + step, step * 2
        return found, scores

    def _scored(self, segments, asked):
        """All examples of the segments, with their cosines."""
        sizes = self.stops[segments] - self.starts[segments]
        ends = numpy.cumsum(sizes)
        at = numpy.arange(ends[-1]) + numpy.repeat(self.starts[segments] - ends + sizes, sizes)
        values = self.weights[at] * numpy.repeat(asked, sizes)
        examples, place = numpy.unique(self.examples[at], return_inverse=True)
        return examples, numpy.bincount(place, values)


def unit(terms, counts, idf):
    """Unit TF-IDF weights."""
    weights = (1 + numpy.log(numpy.asarray(counts, dtype=float))) * idf[numpy.asarray(terms, int)]
    return weights / math.sqrt(float(weights @ weights))


class Model:
    def __init__(self, idf, examples, zero_share):
        """examples: (id, label, class weight, terms, counts), none of them empty."""
        self.idf, self.zero_share = idf, zero_share
        self.ids = [e[0] for e in examples]
        self.labels = numpy.array([e[1] for e in examples], dtype=float)
        self.weights = numpy.array([e[2] for e in examples], dtype=float)
        self.index = Index([(t, unit(t, c, idf)) for *_, t, c in examples])

    def score(self, terms, counts, own=None):
        """(vote, evidence): evidence is the nearest three, nearest first.  The
        example with id ``own`` is left out."""
        if not len(terms):
            return self.zero_share, []
        found, cosines = self.index.nearest(terms, unit(terms, counts, self.idf), K + (own is not None))
        if own is not None:
            others = numpy.array([self.ids[e] != own for e in found], dtype=bool)
            found, cosines = found[others][:K], cosines[others][:K]
        weight = cosines**2 * self.weights[found]
        score = (float(weight @ self.labels[found]) + PRIOR * self.zero_share) / (
            float(weight.sum()) + PRIOR
        )
        near = [
            {"doc_id": self.ids[e], "cosine": float(c), "toxic": int(self.labels[e])}
            for e, c in zip(found[:3], cosines[:3])
        ]
        return min(max(score, 0.0), 1.0), near


def fit_calibration(votes, labels, weights, rounds=100):
    """(slope, shift) of the logistic curve from the log odds of votes to labels, by
    Newton steps; None if there is one label only or votes do not rise with it."""
    votes, labels, weights = (numpy.asarray(a, dtype=float) for a in (votes, labels, weights))
    ones, zeros = float(weights @ labels), float(weights @ (1 - labels))
    if not ones or not zeros:
        return None
    # Targets just short of 0 and 1 keep the curve finite where votes are never wrong.
    target = numpy.where(labels > 0.5, (ones + 1) / (ones + 2), 1 / (zeros + 2))
    x = numpy.stack([_log_odds(votes), numpy.ones(len(votes))], axis=1)
    curve = numpy.array([1.0, 0.0])

    def loss(curve):
        z = x @ curve
        return float(weights @ (numpy.logaddexp(0, z) - target * z))

    now = loss(curve)
    for _ in range(rounds):
        p = 1 / (1 + numpy.exp(-(x @ curve)))
        slope = x.T @ (weights * (p - target))
        bend = (x * (weights * p * (1 - p))[:, None]).T @ x + 1e-9 * numpy.eye(2)
        step, size = numpy.linalg.solve(bend, slope), 1.0
        while loss(curve - size * step) > now and size > 1e-6:
            size /= 2
        curve = curve - size * step
        before, now = now, loss(curve)
        if before - now < 1e-10 * abs(before):
            break
    return (float(curve[0]), float(curve[1])) if curve[0] > 0 else None


def _log_odds(votes):
    votes = numpy.clip(votes, LEAST_VOTE, 1 - LEAST_VOTE)
    return numpy.log(votes / (1 - votes))


def calibrated(vote, curve):
    """The score of a vote; votes rank documents as scores do."""
    if curve is None:
        return vote
    return float(1 / (1 + numpy.exp(-(curve[0] * _log_odds(vote) + curve[1]))))


def held_out(doc_id="doc_id"):
    """Rows from whose labels nothing is learnt; a null id is one of them."""
    remainder = F.pmod(F.crc32(F.col(doc_id).cast("string").cast("binary")), F.lit(4))
    return F.coalesce(remainder == 2, F.lit(True))


def _choose_terms(rows):
    """All terms that go with label 1, the most telling first: no more than the
    bounded sample has."""

    def count(batches):
        found = [Counter(), Counter()]
        for batch in batches:
            for text, toxic in zip(batch.column("text"), batch.column("toxic")):
                words = set(_WORD.findall((text.as_py() or "").lower()))
                found[toxic.as_py()].update({t for w in words for t in terms_of(w)})
        terms = sorted(found[0].keys() | found[1].keys())
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(terms, pa.string()),
                pa.array([found[1][t] for t in terms], pa.int64()),
                pa.array([found[0][t] for t in terms], pa.int64()),
            ],
            ["term", "ones", "zeros"],
        )

    totals = {r["toxic"]: r["count"] for r in rows.groupBy("toxic").count().collect()}
    ones, zeros = totals.get(1, 0), totals.get(0, 0)
    counted = rows.select("text", "toxic").mapInArrow(
        count, "term string, ones bigint, zeros bigint"
    )
    share = lambda c, n: (F.col(c) + 0.5) / (n + 1)
    ratio = share("ones", ones) / share("zeros", zeros)
    best = (
        counted.groupBy("term")
        .agg(F.sum("ones").alias("ones"), F.sum("zeros").alias("zeros"))
        .filter((F.col("ones") >= LEAST_EXAMPLES) & (ratio >= LEAST_RATIO))
        .orderBy((F.col("ones") * F.log(ratio)).desc(), "term")
        .collect()
    )
    return [r["term"] for r in best], ones, zeros


def _examples(docs, labels, sample):
    """(doc_id, text, toxic, weight) of the learning rows of least hash, at most
    ``sample`` of either label; the weight makes up for those left out."""
    known = (
        labels.filter(F.col("toxic").isin(0, 1) & ~held_out())
        .groupBy("doc_id")
        .agg(F.max("toxic").cast("int").alias("toxic"))
    )
    known = staged(known, "labels")
    parts = []
    for r in known.groupBy("toxic").count().collect():
        least = known.filter(F.col("toxic") == r["toxic"]).orderBy(F.xxhash64("doc_id"), "doc_id")
        weight = F.lit(max(1.0, r["count"] / sample))
        parts.append(least.limit(sample).withColumn("weight", weight))
    if not parts:
        return None
    chosen = parts[0] if len(parts) == 1 else parts[0].union(parts[1])
    # At most 2 * sample rows of two numbers each.  Of repeated ids one text counts.
    return staged(
        docs.select("doc_id", "text")
        .join(F.broadcast(chosen), "doc_id")
        .groupBy("doc_id", "toxic", "weight")
        .agg(F.min(F.coalesce("text", F.lit(""))).alias("text")),
        "examples",
    )


def _counted(docs, vocabulary):
    """Staged (doc_id, terms, counts) per row; ``docs`` may have more columns."""
    names = [c for c in docs.columns if c != "text"]
    kept = ", ".join(f"{c} {docs.schema[c].dataType.simpleString()}" for c in names)

    def count(batches):
        counts = Counts(vocabulary)
        for batch in batches:
            found = list(zip(*(counts.of(t.as_py()) for t in batch.column("text")))) or [[], []]
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(n) for n in names), *(pa.array(c, pa.list_(pa.int32())) for c in found)],
                [*names, "terms", "counts"],
            )

    return staged(docs.mapInArrow(count, f"{kept}, terms array<int>, counts array<int>"), "terms")


def _curve(examples, shared):
    """The calibration by the examples' own votes, each without itself."""

    def vote(batches):
        model = shared.value
        for batch in batches:
            columns = (batch.column(n).to_pylist() for n in ("doc_id", "terms", "counts"))
            found = [model.score(t, c, own)[0] for own, t, c in zip(*columns)]
            yield pa.RecordBatch.from_arrays(
                [pa.array(found, pa.float64()), batch.column("toxic"), batch.column("weight")],
                ["vote", "toxic", "weight"],
            )

    # The files of a sample are few; its rows are dealt over all cores.
    dealt = examples.repartition("doc_id")
    rows = dealt.mapInArrow(vote, "vote double, toxic int, weight double").collect()
    rows.sort()  # at most 2 * sample rows of three numbers, summed in one order
    return fit_calibration(*zip(*rows)) if rows else None


def classify(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """(doc_id, held_out, score, predicted, evidence) of every row of ``docs``.

    Labels are learnt from rows of ``labels`` (doc_id, toxic) that are not held
    out; of several labels of an id the largest counts, null ones do not.  A score
    depends on the text alone, and a very long one is treated whole.  Texts without
    telling terms, also empty and null ones, score what such examples have on
    average; without any examples that is 0.  Of examples equally near, those of
    smaller id vote.  With examples of one label only, votes are not calibrated.  Rows with a null id are held out.  Repeated rows get the same result; an
    empty table gives an empty one.
    """
    examples = _examples(docs, labels, sample)
    vocabulary, ones, zeros = [], 0, 0
    if examples is not None:
        vocabulary, ones, zeros = _choose_terms(examples)
    rows = _counted(docs.select("doc_id", "text"), vocabulary)
    frequency = numpy.zeros(len(vocabulary))
    each = rows.select(F.explode("terms").alias("term")).groupBy("term").count()
    for r in each.collect():  # a row per term of the sample
        frequency[r["term"]] = r["count"]
    idf = numpy.log((rows.count() + 1) / (frequency + 1)) + 1
    found, empty, counted = [], [0.0, 0.0], None
    if ones + zeros:
        counted = _counted(examples, vocabulary)
        for r in counted.orderBy("doc_id").collect():  # the sample
            if r["terms"]:
                found.append((r["doc_id"], r["toxic"], r["weight"], r["terms"], r["counts"]))
            else:
                empty[r["toxic"]] += r["weight"]
    zero_share = empty[1] / sum(empty) if sum(empty) else 0.0
    shared = docs.sparkSession.sparkContext.broadcast(Model(idf, found, zero_share))
    curve = None if counted is None else _curve(counted, shared)

    def score(batches):
        model, known = shared.value, {}
        near = pa.list_(pa.struct([("doc_id", pa.int64()), ("cosine", pa.float64()), ("toxic", pa.int32())]))
        for batch in batches:
            scores, evidence = [], []
            for terms, counts in zip(batch.column("terms").to_pylist(), batch.column("counts").to_pylist()):
                key = tuple(terms), tuple(counts)
                result = known.get(key)
                if result is None:
                    result = model.score(terms, counts)
                    if len(known) < 10_000:
                        known[key] = result
                scores.append(calibrated(result[0], curve))
                evidence.append(result[1])
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(scores, pa.float64()), pa.array(evidence, near)],
                ["doc_id", "score", "evidence"],
            )

    schema = (
        f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, score double, "
        "evidence array<struct<doc_id:bigint,cosine:double,toxic:int>>"
    )
    return rows.mapInArrow(score, schema).select(
        "doc_id",
        held_out().alias("held_out"),
        "score",
        (F.col("score") >= TOXIC).cast("int").alias("predicted"),
        "evidence",
    )
