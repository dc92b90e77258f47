"""From text to counts: the only step that touches the text."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexisweep.functions.match import match_count
from lexisweep.schema import CORPUS_KEYS


def score_pages(corpus: DataFrame, pattern: str, whole_words: bool = False) -> DataFrame:
    """``(chunk_id, seq, title, count, bytes)``, with those keys the corpus has.

    ``bytes`` is the stored size: the column of that name, else the text's own.

    The counts leave through a generator.  Catalyst does not push a later
    filter on ``count`` below it, which would count every text twice.
    """
    keys = [name for name in CORPUS_KEYS if name in corpus.columns]
    stored = F.col("bytes") if "bytes" in corpus.columns else F.octet_length("text")
    scores = F.struct(
        match_count("text", pattern, whole_words).alias("count"),
        stored.cast("bigint").alias("bytes"),
    )
    return corpus.select(*keys, F.inline(F.array(scores)))


def filter_min_matches(scored: DataFrame, min_matches: int = 1) -> DataFrame:
    """The matching pages; every page matches if ``min_matches`` is 0."""
    if min_matches < 0:
        raise ValueError("min_matches must not be negative")
    return scored.filter(F.col("count") >= F.lit(min_matches))
