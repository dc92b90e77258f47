"""Totals over scored pages, per chunk and overall."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Fixed value: bytes of the offset stored with each text.
OFFSET_BYTES = 4


def num_word_matches() -> Column:
    """Occurrences in all pages, also those below the minimum."""
    return _or_zero(F.sum("count")).alias("num_word_matches")


def num_page_matches(min_matches: int) -> Column:
    return F.count_if(F.col("count") >= F.lit(min_matches)).alias("num_page_matches")


def max_word_matches() -> Column:
    return _or_zero(F.max("count")).alias("max_word_matches")


def best_page() -> Column:
    """Title of the page with most occurrences; of equals, the last in scan order."""
    return F.max_by("title", F.struct("count", "seq")).alias("max_page_title")


def input_size() -> Column:
    """Bytes scanned: the stored text and its offset."""
    return _or_zero(F.sum(F.col("bytes") + F.lit(OFFSET_BYTES))).alias("input_size")


def search_stats(scored: DataFrame, min_matches: int = 1) -> DataFrame:
    """One row of totals, in one pass with partial aggregation in every task."""
    return scored.agg(*_totals(min_matches))


def partial_stats(
    scored: DataFrame, min_matches: int = 1, capacity: int | None = None
) -> DataFrame:
    """The totals of each chunk and the number of hits stored for it: all, or at
    most ``capacity`` (256 is customary)."""
    records = F.col("num_page_matches")
    if capacity is not None:
        records = F.least(records, F.lit(capacity).cast("bigint"))
    return (
        scored.groupBy("chunk_id")
        .agg(*_totals(min_matches))
        .withColumn("num_records", records)
    )


def merge_stats(partials: DataFrame) -> DataFrame:
    """One row of totals from those per chunk; of equal best pages, the last."""
    last_best = F.struct("max_word_matches", "chunk_id")
    return partials.agg(
        _or_zero(F.sum("num_word_matches")).alias("num_word_matches"),
        _or_zero(F.sum("num_page_matches")).alias("num_page_matches"),
        _or_zero(F.max("max_word_matches")).alias("max_word_matches"),
        F.max_by("max_page_title", last_best).alias("max_page_title"),
        _or_zero(F.sum("input_size")).alias("input_size"),
    )


def all_known(partials: DataFrame) -> DataFrame:
    """Whether no chunk has more matching pages than stored hits."""
    stored = F.col("num_records") >= F.col("num_page_matches")
    return partials.agg(F.coalesce(F.bool_and(stored), F.lit(True)).alias("all_known"))


def _or_zero(total: Column) -> Column:
    """Totals over no pages at all are 0."""
    return F.coalesce(total, F.lit(0).cast("bigint"))


def _totals(min_matches):
    return (
        num_word_matches(),
        num_page_matches(min_matches),
        max_word_matches(),
        best_page(),
        input_size(),
    )
