"""Search jobs: one query, or a table of queries, over a whole corpus."""

import time
from dataclasses import asdict, dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexisweep.functions import multi_match
from lexisweep.operators import hits as hit_ops
from lexisweep.operators import stats as stat_ops
from lexisweep.operators.queries import DEFAULTS, Query, of_language, require_known
from lexisweep.operators.runlog import run_metrics
from lexisweep.operators.score import filter_min_matches, score_pages
from lexisweep.plans.query_join import search_table, table_stats
from lexisweep.schema import CORPUS_KEYS
from lexisweep.staging import new_path, release, written

def _scored(corpus: DataFrame, query: Query) -> DataFrame:
    return score_pages(of_language(corpus, query), query.pattern, query.whole_words)


def search_hits(corpus: DataFrame, query: Query) -> DataFrame:
    """Every matching page with its count: a filter on the scan, no shuffle."""
    return filter_min_matches(_scored(corpus, query), query.min_matches).drop("bytes")


def search_stats(corpus: DataFrame, query: Query) -> DataFrame:
    """Totals and best page, one row."""
    return stat_ops.search_stats(_scored(corpus, query), query.min_matches)


def search_response(
    corpus: DataFrame, query: Query, capacity: int | None = None
) -> DataFrame:
    """The ranked pages to show, in one scan.

    ``capacity`` limits the hits stored per chunk (256 is customary), so the
    answer then depends on the chunks; without it all matches are ranked.
    """
    return hit_ops.respond(_scored(corpus, query), query.min_matches, capacity)


@dataclass(frozen=True)
class Search:
    """A query run once, with every view of its result.

    The scored pages, without their text, are written to the shared folder, so
    the views below read the text once between them.
    """

    scored: DataFrame
    query: Query
    capacity: int | None
    time_us: int
    path: str

    @classmethod
    def run(cls, corpus: DataFrame, query: Query, capacity: int | None = None) -> "Search":
        start = time.perf_counter()
        path = new_path(corpus.sparkSession, "scored")
        scored = written(_scored(corpus, query), path)
        elapsed = time.perf_counter() - start
        return cls(scored, query, capacity, round(elapsed * 1e6), path)

    def close(self) -> None:
        """Delete the scored pages; the views are void."""
        release(self.scored.sparkSession, self.path)

    def hits(self) -> DataFrame:
        return filter_min_matches(self.scored, self.query.min_matches).drop("bytes")

    def partials(self) -> DataFrame:
        return stat_ops.partial_stats(self.scored, self.query.min_matches, self.capacity)

    def merged(self) -> DataFrame:
        k = self.query.min_matches
        if self.capacity is None:
            return hit_ops.last_per_title(filter_min_matches(self.scored, k))
        records = hit_ops.first_hits(self.scored, self.capacity, k)
        return hit_ops.merge_hits(hit_ops.best_hits(self.scored, k), records)

    def stats(self) -> DataFrame:
        """Totals, number of distinct titles found, and completeness; one row."""
        totals = stat_ops.search_stats(self.scored, self.query.min_matches)
        records = hit_ops.num_result_records(self.merged())
        known = stat_ops.all_known(self.partials())
        return totals.select(
            "*",
            records.scalar().alias("num_result_records"),
            known.scalar().alias("all_known"),
        )

    def response(self) -> DataFrame:
        return hit_ops.respond(self.scored, self.query.min_matches, self.capacity)

    def document(self) -> DataFrame:
        """The whole answer as one nested row, for ``to_json``: the query, its
        stats, and the (title, count) lists of the bands."""
        echo = {"mode": DEFAULTS["mode"]} | asdict(self.query)
        query = F.struct(*(F.lit(value).alias(name) for name, value in echo.items()))
        run = self.stats().withColumn("time_us", F.lit(self.time_us).cast("bigint"))
        stats = run_metrics(run).select(
            F.struct(
                "num_word_matches",
                "num_page_matches",
                "num_result_records",
                "input_size",
                "time_taken_ms",
                "bandwidth",
            ).alias("stats")
        )
        ranked = F.sort_array(F.collect_list(F.struct("rank", "band", "title", "count")))
        shown = self.response().agg(ranked.alias("shown"))  # at most 100 rows

        def band(name):
            chosen = F.filter(F.col("shown"), lambda h: h["band"] == name)
            return F.transform(chosen, lambda h: F.struct(h["title"], h["count"]))

        bands = shown.select(
            F.get(band("top"), 0).alias("top_result"),
            band("top_ten").alias("top_ten_results"),
            band("other").alias("other_results"),
        )
        return bands.select(query.alias("query"), stats.scalar().alias("stats"), "*")


def search_batch(corpus: DataFrame, queries) -> DataFrame:
    """``(query_id, <keys>, count)`` of every matching page of every query: for
    each query the rows of :func:`search_hits`.

    ``queries`` is a mapping, or pairs, of id and :class:`Query`, or a table of
    queries (see ``query_join``), which may be of any size.
    """
    if isinstance(queries, DataFrame):
        return search_table(corpus, queries)
    scored = score_batch(corpus, queries)
    return scored.filter(F.col("count") >= F.col("min_matches")).drop("min_matches")


def batch_stats(corpus: DataFrame, queries) -> DataFrame:
    """Per query: the totals of search_stats; no best page if nothing is found.

    Totals are added up where the texts are read: a query that matches every page
    costs a row per input batch.
    """
    if isinstance(queries, DataFrame):
        return table_stats(corpus, queries)
    pairs, id_type = _pairs(queries)
    shared, ids, spoken = _shipped(corpus, pairs)
    schema = f"query_id {id_type}, words bigint, pages bigint, most bigint, seq bigint, title string"
    wanted = ["seq", "title", "text"] + ["wiki"] * spoken
    found = corpus.select(*wanted).mapInArrow(
        multi_match.total_counter(shared, ids, spoken), schema
    )
    # A row per query, so that those found nowhere are reported too.
    absent = corpus.sparkSession.createDataFrame(
        [(key, 0, 0, 0, None, None) for key, _ in pairs], schema
    )
    return (
        found.unionAll(absent)
        .groupBy("query_id")
        .agg(
            F.sum("words").alias("num_word_matches"),
            F.sum("pages").alias("num_page_matches"),
            F.max("most").alias("max_word_matches"),
            F.max_by("title", F.when(F.col("most") > 0, F.struct("most", "seq"))).alias(
                "max_page_title"
            ),
        )
    )


def score_batch(corpus: DataFrame, queries) -> DataFrame:
    """``(query_id, min_matches, <keys>, count)`` of every page and query that
    occurs in it, or asks for no minimum.

    One walk over each text counts all patterns: the corpus is scanned once and
    neither joined nor replicated.  The queries are broadcast: like the automaton
    made of them, they have to fit in a task.
    """
    pairs, id_type = _pairs(queries)
    shared, ids, spoken = _shipped(corpus, pairs)
    keys = [name for name in CORPUS_KEYS if name in corpus.columns]
    kept = "".join(f"{k} {corpus.schema[k].dataType.simpleString()}, " for k in keys)
    schema = f"query_id {id_type}, min_matches bigint, {kept}count bigint"
    pages = corpus.select(*keys, "text", *["wiki"] * spoken)
    return pages.mapInArrow(multi_match.pair_counter(shared, ids, keys, spoken), schema)


def _pairs(queries):
    """The pairs, and the SQL type of their ids."""
    pairs = list(queries.items() if hasattr(queries, "items") else queries)
    if not pairs:
        raise ValueError("no queries given")
    for kind, name in ((int, "bigint"), (str, "string")):
        if all(isinstance(key, kind) for key, _ in pairs):
            return pairs, name
    raise TypeError("query ids must be all integers or all strings")


def _shipped(corpus, pairs):
    spoken = "wiki" in corpus.columns
    if not spoken:
        for _, query in pairs:
            require_known(query)
    context = corpus.sparkSession.sparkContext
    wanted = [
        multi_match.Wanted(q.pattern, q.whole_words, q.min_matches, q.wiki) for _, q in pairs
    ]
    return context.broadcast(wanted), context.broadcast([key for key, _ in pairs]), spoken
