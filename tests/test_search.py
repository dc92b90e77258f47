"""Whole searches: invariances, batches, streams, plans, and query tables."""

import random

import pytest

from lexisweep import registered
from lexisweep.functions import multi_match
from lexisweep.operators import queries as query_ops
from lexisweep.operators import runlog
from lexisweep.operators.queries import Query
from lexisweep.plans import search
from lexisweep.streaming.scan import stream_hits, stream_totals

PATTERNS = ["the", "tion", "erer", "on the", "e", ".", " th", "é", "a a"]


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture(scope="module")
def docs(spark, data):
    return registered.documents(spark, data)


def test_same_answer_for_any_partitioning(spark, data):
    pages = registered.web_pages(spark, data)
    query = Query("the", True, 2)
    shapes = [pages.coalesce(1), pages.repartition(13), pages.repartition(5, "title")]
    for build in (
        lambda c: search.search_hits(c, query),
        lambda c: search.search_stats(c, query),
        lambda c: search.search_response(c, query, 4),
        lambda c: search.search_response(c, query),
        lambda c: search.Search.run(c, query, 4).partials(),
    ):
        answers = [sorted(build(shape).collect()) for shape in shapes]
        assert answers[0] == answers[1] == answers[2] and answers[0]


def test_views_of_one_run(spark, data):
    pages = registered.web_pages(spark, data)
    for capacity in (4, None):
        query = Query("the", True, 2)
        run = search.Search.run(pages, query, capacity)
        assert sorted(run.response().collect()) == sorted(search.search_response(pages, query, capacity).collect())
        assert sorted(run.hits().collect()) == sorted(search.search_hits(pages, query).collect())
        row, totals = run.stats().first(), search.search_stats(pages, query).first()
        assert row[: len(totals)] == totals[:]
        assert row.num_result_records == run.merged().count()
        assert row.all_known is (capacity is None)


@pytest.mark.parametrize("capacity", [4, None])
def test_document(spark, data, capacity):
    run = search.Search.run(registered.web_pages(spark, data), Query("the", True, 2), capacity)
    row = run.document().first()
    assert row.query.asDict() == {
        "mode": 0, "pattern": "the", "whole_words": True, "min_matches": 2, "wiki": "en",
    }
    totals = run.stats().first()
    assert row.stats.num_page_matches == totals.num_page_matches
    assert row.stats.num_result_records == totals.num_result_records
    assert row.stats.time_taken_ms == run.time_us // 1000 > 0
    assert row.stats.bandwidth.endswith(" GB/s")
    shown = run.response().orderBy("rank").collect()
    of_band = {b: [(r.title, r["count"]) for r in shown if r.band == b] for b in ("top", "top_ten", "other")}
    assert [tuple(row.top_result)] == of_band["top"]
    assert [tuple(r) for r in row.top_ten_results] == of_band["top_ten"]
    assert [tuple(r) for r in row.other_results] == of_band["other"]
    empty = search.Search.run(registered.web_pages(spark, data), Query("nowhere at all"), capacity)
    nothing = empty.document().first()
    assert nothing.top_result is None and nothing.other_results == []


@pytest.fixture(scope="module")
def spoken(spark):
    rows = [(1, "A", "the other", "en"), (2, "B", "mother the", "fr"), (3, "C", None, "en"), (4, "D", "other other", "en"), (5, "E", "the", None)]
    return spark.createDataFrame(rows, "seq long, title string, text string, wiki string")


@pytest.mark.parametrize("n", [1, 6, 7, 100])
@pytest.mark.parametrize("languages", [True, False])
def test_batch_equals_single_searches(spark, docs, spoken, n, languages):
    rng = random.Random(n)
    corpus = spoken if languages else docs.union(docs.limit(1).selectExpr("chunk_id", "-1L", "'null'", "null"))
    kinds = [(p, w) for p in [*PATTERNS, "other", "zebra"] for w in (False, True)]
    queries = {
        i: Query(*kinds[i % len(kinds)], rng.choice([0, 1, 3]), rng.choice(["en", "fr"]) if languages else "en")
        for i in range(n)
    }
    got = {i: set() for i in queries}
    for row in search.search_batch(corpus, iter(queries.items())).collect():
        assert tuple(row[1:]) not in got[row.query_id]
        got[row.query_id].add(tuple(row[1:]))
    totals = {row.query_id: tuple(row)[1:] for row in search.batch_stats(corpus, queries).collect()}
    assert totals.keys() == queries.keys()
    singles = {}
    for key, query in queries.items():
        if query not in singles:
            hits = {tuple(r) for r in search.search_hits(corpus, query).collect()}
            stats = tuple(search.search_stats(corpus, query).first())[:4]
            singles[query] = hits, stats if stats[2] else (*stats[:3], None)
        assert (got[key], totals[key]) == singles[query], query


def test_batch_output_comes_in_pieces(spark, docs, monkeypatch):
    queries = {i: Query(pattern, min_matches=0) for i, pattern in enumerate(PATTERNS)}
    whole = sorted(search.search_batch(docs, queries).collect())
    monkeypatch.setattr(multi_match, "OUTPUT_ROWS", 7)
    walk = multi_match.Walk([multi_match.Wanted("a", False, 0, "en")] * 20)
    assert walk.occurrences(None) == {} and len(walk.without_minimum()) == 20
    assert sorted(search.search_batch(docs, queries).collect()) == whole


def test_batch_ids(spark, docs, spoken):
    named = search.search_batch(docs, {"a": Query("the")})
    assert named.schema["query_id"].dataType.simpleString() == "string"
    many = search.search_batch(docs, [(i, Query(f"x{i}")) for i in range(30_000)])
    assert plan(many).count("FileScan") == 1
    assert many.schema["query_id"].dataType.simpleString() == "bigint"
    with pytest.raises(ValueError):
        search.search_batch(docs, [])
    with pytest.raises(TypeError):
        search.search_batch(docs, {1: Query("a"), "b": Query("a")})
    for batch in (search.search_batch, search.batch_stats):
        with pytest.raises(ValueError):
            batch(docs, {1: Query("a"), 2: Query("a", wiki="nl")})


def test_language_of_the_corpus(spark, data):
    corpus = spark.read.parquet(f"{data}/documents.parquet").selectExpr(
        "doc_id as seq", "source as title", "text", "lang as wiki"
    )
    every = search.search_hits(corpus.drop("wiki"), Query("tion")).count()
    english = search.search_hits(corpus, Query("tion")).count()
    french = search.search_hits(corpus, Query("tion", wiki="fr")).count()
    assert 0 < french < english < every
    with pytest.raises(ValueError):
        search.search_hits(corpus.drop("wiki"), Query("tion", wiki="fr"))


def test_one_scan_and_one_count_per_text(spark, docs):
    query = Query("the", True, 2)
    for df in (
        search.search_hits(docs, query),
        search.search_stats(docs, query),
        search.search_response(docs, query, 8),
        search.search_response(docs, query),
    ):
        assert plan(df).count("FileScan") == 1
        assert plan(df).count("regexp_extract_all") == 1
    assert "Exchange" not in plan(search.search_hits(docs, query))
    assert "WindowGroupLimit" in plan(search.search_response(docs, query, 8))
    assert "TakeOrderedAndProject" in plan(search.search_response(docs, query))


def test_stream_equals_batch(spark, data):
    columns = ("doc_id as seq", "source as title", "text", "lang as wiki")
    batch = spark.read.parquet(f"{data}/documents.parquet")
    stream = (
        spark.readStream.schema(batch.schema)
        .option("pathGlobFilter", "documents.parquet")
        .parquet(data)
    )
    query = Query("tion", min_matches=5)
    for name, df, mode in (
        ("totals", stream_totals(stream.selectExpr(*columns), query), "complete"),
        ("found", stream_hits(stream.selectExpr(*columns), query), "append"),
    ):
        run = df.writeStream.format("memory").queryName(name).outputMode(mode).start()
        run.processAllAvailable()
        run.stop()
    pages = batch.selectExpr(*columns)
    want = search.search_stats(pages, query).first()
    assert spark.table("totals").first()[:] == want[:3]
    assert sorted(spark.table("found").collect()) == sorted(search.search_hits(pages, query).collect())
    with pytest.raises(ValueError):
        stream_hits(stream.selectExpr(*columns[:3]), Query("tion", wiki="nl"))


def test_query_values():
    assert Query.parse("~two words") == Query("two words", True)
    assert Query.parse("plain~") == Query("plain~", False)
    assert Query("a") == Query("a", False, 1, "en")
    for text in ("", "~"):
        with pytest.raises(ValueError):
            Query.parse(text)
    with pytest.raises(ValueError):
        Query("a", min_matches=-1)


def test_query_tables(spark):
    rows = [("a", None, None, None), ("b", True, 0, "en"), ("c", True, 2, "nl"), ("", None, None, None), ("d", None, -1, None)]
    asked = spark.createDataFrame(rows, "pattern string, whole_words boolean, min_matches int, wiki string")
    assert [tuple(r) for r in query_ops.normalise_query(asked).orderBy("pattern").collect()] == [
        ("a", False, 1, "en", 0),
        ("b", True, 0, "en", 0),
    ]
    log = spark.createDataFrame([("~a b",), ("a~",), ("~",)], "text string")
    assert [tuple(r)[1:] for r in query_ops.parse_query_text(log).collect()] == [
        ("a b", True, 1),
        ("a~", False, 1),
        ("", True, 1),
    ]


def test_run_log(spark):
    rows = [("q", "cpu", 22_000_000_000, 2_500_999), ("q", "fast", 22_000_000_000, 1_000_000), ("r", "cpu", 1, 0)]
    log = spark.createDataFrame(rows, "query string, mode string, input_size bigint, time_us bigint")
    got = runlog.run_metrics(log).select("time_taken_ms", "bandwidth").collect()
    assert [tuple(r) for r in got] == [(2500, "8.80 GB/s"), (1000, "22.00 GB/s"), (0, None)]
    assert [tuple(r) for r in runlog.speedup(log, "cpu", "fast").collect()] == [("q", 2_500_999, 1_000_000, "2.50")]
