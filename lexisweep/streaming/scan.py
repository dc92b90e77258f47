"""Searching pages as they arrive.

Matching is a column expression and the totals are plain aggregates, so the
batch operators apply to a streaming DataFrame as they are.
"""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexisweep.operators.queries import Query, of_language
from lexisweep.operators.score import filter_min_matches, score_pages
from lexisweep.operators.stats import num_page_matches, num_word_matches


def stream_hits(pages: DataFrame, query: Query) -> DataFrame:
    """Matching pages of a stream; stateless, so for append mode."""
    scored = score_pages(of_language(pages, query), query.pattern, query.whole_words)
    return filter_min_matches(scored, query.min_matches).drop("bytes")


def stream_totals(pages: DataFrame, query: Query) -> DataFrame:
    """Running totals; one row of state, for complete or update mode."""
    scored = score_pages(of_language(pages, query), query.pattern, query.whole_words)
    return scored.agg(
        num_word_matches(), num_page_matches(query.min_matches), F.max("count").alias("max_word_matches")
    )
