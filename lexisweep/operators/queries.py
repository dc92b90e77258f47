"""Search parameters: a value object, and operators on tables of queries."""

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexisweep.functions.match import check_pattern

# Defaults of the parameters, the language known, and the mark of
# a whole-word query in its text form.
DEFAULTS = {"whole_words": False, "min_matches": 1, "mode": 0, "wiki": "en"}
WIKIS = ("en",)
WHOLE_WORDS_MARK = "~"


@dataclass(frozen=True)
class Query:
    pattern: str
    whole_words: bool = DEFAULTS["whole_words"]
    min_matches: int = DEFAULTS["min_matches"]
    wiki: str = DEFAULTS["wiki"]

    def __post_init__(self):
        check_pattern(self.pattern)
        if self.min_matches < 0:
            raise ValueError("min_matches must not be negative")

    @classmethod
    def parse(cls, text: str) -> "Query":
        """From the text form: a leading mark asks for whole words."""
        whole = text.startswith(WHOLE_WORDS_MARK)
        return cls(text[len(WHOLE_WORDS_MARK):] if whole else text, whole)


def of_language(pages: DataFrame, query: Query) -> DataFrame:
    """The pages in the query's language, by their column ``wiki``.

    Pages without that column are of the one known language; a query for any
    other is refused.
    """
    if "wiki" in pages.columns:
        return pages.filter(F.col("wiki") == query.wiki)
    require_known(query)
    return pages


def require_known(query: Query) -> None:
    if query.wiki not in WIKIS:
        raise ValueError(f"unknown wiki language {query.wiki}")


def complete_queries(queries: DataFrame) -> DataFrame:
    """Fill in the defaults of absent or null parameters."""
    for name, default in DEFAULTS.items():
        value = F.lit(default)
        if name in queries.columns:
            value = F.coalesce(F.col(name), value)
        queries = queries.withColumn(name, value)
    return queries


def reject_reason():
    """Why a completed query is not run; null if it is."""
    return (
        F.when(~F.col("wiki").isin(*WIKIS), "unknown wiki language")
        .when(F.col("pattern").isNull() | (F.col("pattern") == ""), "empty pattern")
        .when(F.col("min_matches") < 0, "negative min_matches")
    )


def normalise_query(queries: DataFrame) -> DataFrame:
    """The queries that can run, with defaults filled in."""
    return complete_queries(queries).filter(reject_reason().isNull())


def parse_query_text(log: DataFrame, text: str = "text") -> DataFrame:
    """Add pattern, whole_words and min_matches parsed from the text form."""
    line = F.col(text)
    whole = F.startswith(line, F.lit(WHOLE_WORDS_MARK))
    rest = F.expr(f"substring(`{text}`, {len(WHOLE_WORDS_MARK) + 1})")
    return (
        log.withColumn("pattern", F.when(whole, rest).otherwise(line))
        .withColumn("whole_words", whole)
        .withColumn("min_matches", F.lit(DEFAULTS["min_matches"]))
    )
