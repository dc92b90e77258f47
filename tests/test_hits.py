"""Ranking, merging and totals against a literal brute force."""

import random

import pytest
from pyspark.sql import functions as F

from lexisweep.operators import hits, stats
from lexisweep.operators.first_rows import first_rows
from lexisweep.operators.score import filter_min_matches, score_pages

SCHEMA = "chunk_id int, seq bigint, title string, count bigint, bytes bigint"

ARTICLES = [
    (0, 0, "title a", "Hello this is the 1st line"),
    (0, 1, "title b", "This is the second line"),
    (0, 2, "title c", "And another line is herehereherehereherehere"),
]


def brute_force(rows, k, capacity):
    """Chunk by chunk: best page first, then the first hits; later ones win."""
    merged, known = {}, True
    for chunk in sorted({row[0] for row in rows}):
        pages = sorted(row for row in rows if row[0] == chunk)
        matching = [p for p in pages if p[3] >= k]
        best = max(pages, key=lambda p: (p[3], p[1]))
        if best[3] >= k:
            merged[best[2]] = best[3]
        stored = matching if capacity is None else matching[:capacity]
        merged |= {p[2]: p[3] for p in stored}
        known = known and len(stored) == len(matching)
    ranked = sorted(merged.items(), key=lambda hit: (-hit[1], hit[0].encode()))
    bands = [("top", 1), ("top_ten", 9 if known else 0), ("other", 90)]
    shown, rank = [], 0
    for band, size in bands:
        for title, count in ranked[rank : rank + size]:
            rank += 1
            shown.append((rank, band, title, count, known))
    return merged, shown


def random_pages(rng, n, chunks, titles):
    return [
        (i * chunks // n, i, f"t{rng.randrange(titles)}", max(0, rng.randint(-2, 6)), 10)
        for i in range(n)
    ]


@pytest.mark.parametrize("seed", range(6))
@pytest.mark.parametrize("capacity", [3, 40, None])
def test_response(spark, seed, capacity):
    rng = random.Random(seed)
    rows = random_pages(rng, 300, rng.choice([1, 4, 9]), rng.choice([20, 150, 10_000]))
    k = rng.choice([0, 1, 4])
    scored = spark.createDataFrame(rows, SCHEMA).repartition(7)
    merged, shown = brute_force(rows, k, capacity)
    assert sorted(map(tuple, hits.respond(scored, k, capacity).collect())) == shown

    if capacity is None:
        composed = hits.last_per_title(filter_min_matches(scored, k))
        known = True
    else:
        composed = hits.merge_hits(hits.best_hits(scored, k), hits.first_hits(scored, capacity, k))
        known = stats.all_known(stats.partial_stats(scored, k, capacity)).first()[0]
    assert dict(composed.select("title", "count").collect()) == merged
    assert hits.num_result_records(composed).first()[0] == len(merged)
    assert sorted(map(tuple, hits.result_bands(composed, known).collect())) == shown


def test_three_articles(spark):
    corpus = spark.createDataFrame(ARTICLES, "chunk_id int, seq bigint, title string, text string")
    scored = score_pages(corpus, "line")
    row = stats.search_stats(scored).first()
    assert (row.num_word_matches, row.num_page_matches, row.max_word_matches) == (3, 3, 1)
    assert row.max_page_title == "title c"
    assert [r.title for r in hits.first_hits(scored, 2, 1).orderBy("seq").collect()] == ["title a", "title b"]
    shown = hits.rank_labels(hits.respond(scored, 1, 2)).orderBy("rank").collect()
    assert [(r.band, r.title, r.label) for r in shown] == [
        ("top", "title a", 1),
        ("other", "title b", None),
        ("other", "title c", None),
    ]
    partial = stats.partial_stats(scored, 1, 2).first()
    assert (partial.num_records, partial.num_page_matches) == (2, 3)
    compressed = spark.createDataFrame([(28,), (25,), (29,)], "bytes bigint")
    assert compressed.agg(stats.input_size()).first()[0] == 94


def test_partials_merge_to_the_totals(spark):
    rows = random_pages(random.Random(1), 500, 8, 60)
    scored = spark.createDataFrame(rows, SCHEMA)
    for k in (0, 1, 5):
        merged = stats.merge_stats(stats.partial_stats(scored, k)).first()
        assert merged == stats.search_stats(scored, k).first()
    totals = stats.search_stats(scored, 5).first()
    assert totals.num_word_matches == sum(r[3] for r in rows)  # also below the minimum
    assert totals.max_page_title == max(rows, key=lambda r: (r[3], r[1]))[2]


def test_no_pages(spark):
    scored = spark.createDataFrame([], SCHEMA)
    assert hits.respond(scored, 1, 4).count() == 0
    assert hits.respond(scored, 1, None).count() == 0
    partials = stats.partial_stats(scored)
    assert tuple(stats.search_stats(scored).first()) == (0, 0, 0, None, 0)
    assert tuple(stats.merge_stats(partials).first()) == (0, 0, 0, None, 0)
    assert stats.all_known(partials).first()[0] is True


def test_first_rows_of_a_group_spread_over_all_tasks(spark):
    rows = spark.range(0, 20_000, 1, 40).select(
        F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("k"), F.col("id") % 50)).alias("key"),
        ((F.col("id") * 7919) % 20_011).alias("at"),
    )
    got = {}
    for row in first_rows(rows, ["key"], ["at"], 5).collect():
        got.setdefault(row["key"], []).append((row["position"], row["at"]))
    want = {}
    for i in range(20_000):
        want.setdefault("hot" if i % 3 == 0 else f"k{i % 50}", []).append(i * 7919 % 20_011)
    assert {k: sorted(v) for k, v in got.items()} == {
        k: list(enumerate(sorted(v)[:5], 1)) for k, v in want.items()
    }


def test_links_are_plain_concatenation(spark):
    df = spark.createDataFrame([("A b/ç?",)], "title string")
    assert hits.link_hits(df).first()["link"] == "https://en.wikipedia.org/wiki/A b/ç?"


def test_negative_minimum(spark):
    with pytest.raises(ValueError):
        filter_min_matches(spark.createDataFrame([], SCHEMA), -1)
