"""Choosing, merging and ranking hits."""

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lexisweep.functions.wiki import result_link
from lexisweep.operators.first_rows import first_rows
from lexisweep.operators.score import filter_min_matches
from lexisweep.operators.stats import best_page, max_word_matches

# Sizes of the bands of a response.
TOP_TEN = 10
OTHERS = 90
SHOWN = TOP_TEN + OTHERS

# Within a chunk the best page is inserted first, then the stored hits.
_BEST, _RECORD = 0, 1


def first_hits(scored: DataFrame, capacity: int, min_matches: int = 1) -> DataFrame:
    """The first ``capacity`` matching pages of each chunk in scan order."""
    hits = filter_min_matches(scored, min_matches)
    return first_rows(hits, ["chunk_id"], ["seq"], capacity)


def best_hits(scored: DataFrame, min_matches: int = 1) -> DataFrame:
    """The best page of each chunk, if it matches."""
    hits = filter_min_matches(scored, min_matches)
    return hits.groupBy("chunk_id").agg(
        F.max(F.struct("count", "seq")).getField("seq").alias("seq"),
        best_page().alias("title"),
        max_word_matches().alias("count"),
    )


def merge_hits(best: DataFrame, records: DataFrame) -> DataFrame:
    """One row per title: of equal titles the one inserted last wins."""
    columns = ("chunk_id", "seq", "title", "count")
    union = best.select(*columns, F.lit(_BEST).alias("kind")).unionByName(
        records.select(*columns, F.lit(_RECORD).alias("kind"))
    )
    return _last_inserted(union, "title")


def last_per_title(hits: DataFrame) -> DataFrame:
    """One row per title over all hits.

    What merge_hits comes to without a capacity: each best page is then among
    the hits, which are inserted after it.
    """
    return hits.groupBy("title").agg(F.max_by("count", "seq").alias("count"))


def num_result_records(merged: DataFrame) -> DataFrame:
    return merged.agg(F.count(F.lit(1)).alias("num_result_records"))


def rank_hits(merged: DataFrame) -> DataFrame:
    """Most occurrences first, then title in byte order."""
    return merged.orderBy(F.desc("count"), F.asc("title"))


def result_bands(merged: DataFrame, all_known: bool = True) -> DataFrame:
    """The pages shown: rank, band, title and count.

    ``top`` is the first, ``top_ten`` the next nine if all matches are known,
    ``other`` the next ninety.
    """
    shown = rank_hits(merged).limit(SHOWN)
    by_rank = Window.orderBy(F.desc("count"), F.asc("title"))  # <= 100 rows
    ranked = shown.withColumn("rank", F.row_number().over(by_rank))
    return _band(ranked.withColumn("all_known", F.lit(all_known)))


def rank_labels(banded: DataFrame) -> DataFrame:
    """Add the rank to show; ``other`` has none unless all matches are known."""
    hidden = (F.col("band") == "other") & ~F.col("all_known")
    return banded.withColumn("label", F.when(~hidden, F.col("rank")))


def link_hits(hits: DataFrame, wiki: str = "en") -> DataFrame:
    """Add the address of each article."""
    return hits.withColumn("link", result_link(F.lit(wiki), F.col("title")))


def respond(
    scored: DataFrame, min_matches: int = 1, capacity: int | None = None
) -> DataFrame:
    """The ranked response, from one pass over the scored pages.

    With a ``capacity`` it equals best_hits + first_hits + merge_hits +
    result_bands with the matching ``all_known``, but those would read the text
    once per branch.  Here each hit carries both of its sort keys, one per
    question asked of its chunk, and one grouped limit answers both.  It keeps
    one hit more than the capacity: that row tells that not all are known.
    """
    hits = filter_min_matches(scored, min_matches)
    if capacity is None:
        return result_bands(last_per_title(hits), all_known=True)

    best = F.struct(
        F.lit(_BEST).alias("kind"),
        (-F.col("count")).alias("major"),
        (-F.col("seq")).alias("minor"),
    )
    record = F.struct(
        F.lit(_RECORD).alias("kind"),
        F.col("seq").alias("major"),
        F.lit(0).cast("bigint").alias("minor"),
    )
    asked = hits.select(
        "chunk_id", "seq", "title", "count", F.inline(F.array(best, record))
    )
    leaders = first_rows(asked, ["chunk_id", "kind"], ["major", "minor"], capacity + 1)
    is_record = F.col("kind") == _RECORD
    kept = leaders.filter(is_record | (F.col("position") == 1)).withColumn(
        "overflow", is_record & (F.col("position") > capacity)
    )
    # The overflow rows fold into one marker row that sorts before all hits.
    marked = kept.withColumn(
        "title", F.when(F.col("overflow"), F.lit("")).otherwise(F.col("title"))
    )
    merged = _last_inserted(marked, "overflow", "title")
    order = (F.desc("overflow"), F.desc("count"), F.asc("title"))
    shown = merged.orderBy(*order).limit(SHOWN + 1)
    everything = Window.partitionBy()  # <= 101 rows
    ranked = (
        shown.withColumn("all_known", ~F.max("overflow").over(everything))
        .withColumn("place", F.row_number().over(Window.orderBy(*order)))
        .filter(~F.col("overflow"))
        .withColumn("rank", F.col("place") - (~F.col("all_known")).cast("int"))
        .filter(F.col("rank") <= SHOWN)
    )
    return _band(ranked)


def _last_inserted(hits, *keys):
    inserted = F.struct("chunk_id", "kind", "seq")
    return hits.groupBy(*keys).agg(F.max_by("count", inserted).alias("count"))


def _band(ranked):
    rank, known = F.col("rank"), F.col("all_known")
    band = (
        F.when(rank == 1, "top")
        .when(known & (rank <= TOP_TEN), "top_ten")
        .otherwise("other")
    )
    # Without a top ten, the ninety others follow the top hit directly.
    shown = known | (rank <= 1 + OTHERS)
    return ranked.filter(shown).select("rank", band.alias("band"), "title", "count", "all_known")
