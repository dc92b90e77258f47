import math

import numpy
import pytest

from lexisweep.llm import graph, neighbours, registered

SCHEMA = "vec_id long, embedding array<float>, label int, rank string, score string"


def brute(rows, every=20, k=20):
    """rows: (vec_id, vector), sound ones, ids unique."""
    out = {}
    for q, a in rows:
        if q % every == 0:
            scores = [(-float(numpy.dot(a, b)), i) for i, b in rows if i != q]
            out[q] = [(i, -s) for s, i in sorted(scores)[:k]]
    return out


def found(rows):
    out = {}
    for r in sorted(rows, key=lambda r: (r.query_id, r.rank)):
        out.setdefault(r.query_id, []).append((r.vec_id, r.score))
        assert r.rank == len(out[r.query_id])
    return out


def recall(got, want):
    hit = sum(len({i for i, _ in got[q]} & {i for i, _ in want[q]}) for q in want)
    return hit / sum(map(len, want.values()))


def test_prune_keeps_diverse_edges():
    points = numpy.array([[0, 0], [1, 0], [1.1, 0], [0, 2], [-3, 0]], numpy.float32)
    kept = graph.robust_prune(points, numpy.array([0]), numpy.array([[1, 2, 3, 4, 0, -1, 1]]), 1.2, 3)
    assert kept.tolist() == [[1, 3, 4]]


@pytest.mark.parametrize("n", [1, 2, 30, 900])
def test_graph_finds(n):
    vectors = numpy.random.default_rng(0).normal(size=(n, 16)) * numpy.linspace(0.5, 1.5, n)[:, None]
    edges, entry = graph.build(vectors)
    queries = numpy.concatenate([vectors[:50], numpy.zeros((len(vectors[:50]), 1))], axis=1).astype("float32")
    near, _ = graph.beam_search(graph.even_lengths(vectors), edges, entry, queries, 64)
    for row, q in enumerate(vectors[:50]):
        best = numpy.argsort(-(vectors @ q))[:10]
        assert len(set(best) & set(near[row])) >= 0.9 * len(best)


def test_rows(spark):
    rng = numpy.random.default_rng(1)
    sound = [(i, rng.normal(size=8).astype("float32").astype(float)) for i in range(0, 300)]
    sound += [(i, sound[3][1]) for i in range(300, 420)]
    sound += [(-40, sound[5][1])]
    odd = [(1000, None), (1020, [0.0] * 8), (1040, [1.0, None] * 4), (1060, [math.nan] * 8), (1080, [math.inf] * 8), (None, [1.0] * 8), (1100, [1.0] * 7), (1120, [])]
    rows = [(i, [float(x) for x in v]) for i, v in sound] + odd + [(0, [float(x) for x in sound[0][1]])]
    df = spark.createDataFrame([(*r, 1, "x", "y") for r in rows], SCHEMA)
    got, want = found(neighbours.nearest(df).collect()), brute(sound)
    assert got.keys() == want.keys()
    assert all(len(got[q]) == 20 for q in got)
    assert recall(got, want) >= 0.99
    for q in got:
        if [i for i, _ in got[q]] == [i for i, _ in want[q]]:
            assert numpy.allclose([s for _, s in got[q]], [s for _, s in want[q]], rtol=1e-12)
    assert neighbours.nearest(df.limit(0)).collect() == []
    few = found(neighbours.nearest(df.filter("vec_id between 0 and 4")).collect())
    assert sorted(i for i, _ in few[0]) == [1, 2, 3, 4]


def test_query(spark, data):
    rows = spark.read.parquet(f"{data}/embeddings.parquet").collect()
    want = brute([(r.vec_id, numpy.array(r.embedding, dtype=float)) for r in rows])
    out = registered.QUERIES["op1_neighbours"](spark, data)
    assert out.dtypes == [("query_id", "bigint"), ("rank", "int"), ("vec_id", "bigint"), ("score", "double")]
    got = found(out.collect())
    assert got.keys() == want.keys() and all(len(v) == 20 for v in got.values())
    assert recall(got, want) >= 0.97
