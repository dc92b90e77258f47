"""Tables of queries against single searches and the automaton."""

import random

import pytest
from pyspark.sql import functions as F

from lexisweep.functions import grams
from lexisweep.functions.multi_match import Walk, Wanted
from lexisweep.operators.queries import Query
from lexisweep.plans import query_join, search

TABLE = "query_id long, pattern string, whole_words boolean, min_matches int, wiki string"
PAGES = "chunk_id int, seq long, title string, text string, wiki string"


@pytest.fixture(params=[True, False], ids=["broadcast", "shuffled"])
def sizes(request, monkeypatch):
    """Both ways to meet, with small pieces so that texts span several."""
    if not request.param:
        monkeypatch.setattr(query_join, "BROADCAST_BYTES", 0)
        monkeypatch.setattr(query_join, "PART", 5)
    return request.param


def corpus_of(spark, texts, wikis=("en", "fr", None)):
    rows = [(k // 5, k, f"t{k % 7}", t, wikis[k % len(wikis)]) for k, t in enumerate(texts)]
    return spark.createDataFrame(rows, PAGES).repartition(3)


def random_text(rng, size):
    return "".join(rng.choice("aab é_.,7") for _ in range(size))


def test_equal_to_the_automaton(spark, sizes):
    rng = random.Random(3)
    texts = [random_text(rng, rng.choice([0, 1, 6, 7, 8, 9, 40, 300])) for _ in range(60)]
    texts += [None, "", "a" * 200, texts[10], texts[10]]
    patterns = {random_text(rng, rng.choice([1, 2, 3, 7])) for _ in range(40)}
    for text in texts[:60]:
        for size in (7, 8, 9, 17, 40):
            if len(text) > size:
                at = rng.randrange(len(text) - size)
                patterns.add(text[at : at + size])
    patterns |= {"a" * 8, "a" * 9, "aab", "a b", "zzzzzzzzzz", "é", "aaaaaaaaz", "_"}
    queries = [
        (k, p, rng.random() < 0.5, rng.choice([0, 1, 1, 2, 3]), rng.choice(["en", "fr"]))
        for k, p in enumerate(sorted(patterns) * 2)
    ]
    asked = spark.createDataFrame(queries, TABLE)
    corpus = corpus_of(spark, texts)
    walk = Walk([Wanted(p, w, n, l) for _, p, w, n, l in queries])
    want = set()
    for row in corpus.collect():
        if row.wiki is not None:
            counts = dict.fromkeys(walk.without_minimum(row.wiki), 0) | walk.occurrences(row.text, row.wiki)
            want |= {(q, *row[:3], n) for q, n in counts.items() if n >= queries[q][3]}
    got = [tuple(r) for r in search.search_batch(corpus, asked).collect()]
    assert len(got) == len(set(got)) and set(got) == want
    pairs = {k: Query(*rest) for k, *rest in queries}
    expected = sorted(search.batch_stats(corpus, pairs).collect())
    assert sorted(search.batch_stats(corpus, asked).collect()) == expected


def test_texts_of_many_pieces(spark, monkeypatch):
    # What one piece holds and where it is cut must not matter.
    rng = random.Random(5)
    texts = [random_text(rng, n) for n in (0, 3, 100, 0, 50, 8)]
    import pyarrow as pa

    batch = pa.RecordBatch.from_arrays([pa.array([0, *range(len(texts))]), pa.array([None, *texts])], ["seq", "text"])
    counts = []
    for piece in (1 << 20, 1, 7, 16):
        monkeypatch.setattr(grams, "PIECE", piece)
        wanted = pa.RecordBatch.from_arrays(
            [pa.array([1, 2, 3]), pa.array(["a", "ab", texts[2][11:30]])], ["row", "pattern"]
        )
        found = [r for b in grams.pattern_grams([wanted]) for r in zip(*b.to_pydict().values())]
        sizes = [s for _, s, _, _ in found]
        assert sizes.count(1) == sizes.count(2) == 1 and sizes.count(8) == len(texts[2][11:30].encode()) - 7
        pairs = pa.RecordBatch.from_arrays(
            [pa.array(sizes, pa.int32()), pa.array([g for *_, g in found], pa.int64())], ["size", "gram"]
        )
        [words] = grams.filter_words(16)([pairs])
        chosen = grams.Filter(16, [1, 2, 8], words.column("slot").to_numpy(), words.column("word").to_numpy())

        class Shared:
            value = chosen

        rows = {}
        for b in grams.gram_finder(Shared, ["seq"])([batch, batch.slice(2, 3), batch.slice(0, 0)]):
            for seq, size, gram, at, anywhere, whole in zip(*b.to_pydict().values()):
                key = seq, size, gram, at
                rows[key] = rows.get(key, (0, 0))[0] + anywhere, rows.get(key, (0, 0))[1] + whole
        counts.append(rows)
    assert counts[0] and all(c == counts[0] for c in counts)


def test_odd_tables(spark, sizes):
    corpus = corpus_of(spark, ["the other the", "mother"], ["en"])
    odd = [(1, None, True, 1, "en"), (2, "", True, 1, "en"), (None, "the", True, 1, "en"), (3, "the", None, -1, "en"), (4, "the", None, None, None), (5, "the", True, 1, "nl")]
    asked = spark.createDataFrame(odd, TABLE)
    got = sorted(tuple(r) for r in search.search_batch(corpus, asked).collect())
    assert got == [(4, 0, 0, "t0", 3), (4, 0, 1, "t1", 1)]
    plain = search.search_batch(corpus.drop("wiki"), asked).collect()
    assert sorted(tuple(r) for r in plain) == got
    # Extra columns on either side, and clashing ones, do no harm.
    extra = corpus.withColumn("pattern", F.lit("x")).withColumn("bytes", F.lit(1))
    found = search.search_batch(extra, asked.withColumn("seq", F.lit(9)).withColumn("text", F.lit("a")))
    assert sorted(tuple(r) for r in found.collect()) == got
    empty = spark.createDataFrame([], TABLE)
    assert search.search_batch(corpus, empty).collect() == []
    assert search.batch_stats(corpus, empty).collect() == []
    nobody = corpus.filter("false")
    assert search.search_batch(nobody, asked).collect() == []
    assert [tuple(r) for r in search.batch_stats(nobody, asked).filter("query_id = 4").collect()] == [(4, 0, 0, 0, None)]


def test_queries_stay_off_the_driver(spark):
    corpus = corpus_of(spark, [f"w{k} shared tail of text {k}" for k in range(50)], ["en"])
    asked = spark.range(20_000).selectExpr(
        "id as query_id", "concat('w', id) as pattern", "true as whole_words", "1 as min_matches", "'en' as wiki"
    )
    assert search.search_batch(corpus, asked).count() == 50
    long = asked.withColumn("pattern", F.concat(F.lit("tail of text "), "query_id"))
    assert search.search_batch(corpus, long.withColumn("whole_words", F.lit(False))).filter("query_id >= 10").count() == 40
