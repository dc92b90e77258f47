"""Column functions on wiki markup, titles and links."""

from pyspark.sql import Column
from pyspark.sql import functions as F

# The markup patterns and the link format.
LINK = r"\[\[(?:[^\]\[]+\|)?([^\]\[]+)\]\]"
LINK_PASSES = 2
META_TITLE = r"[A-Za-z_0-9]+:[^ ].*"
ARTICLE_URL = ("https://", ".wikipedia.org/wiki/")


def strip_links(text) -> Column:
    """``[[target|label]]`` to ``label`` and ``[[x]]`` to ``x``.

    Two passes, so a link inside the label of another one is resolved too.
    """
    column = F.col(text) if isinstance(text, str) else text
    stripped = column
    for _ in range(LINK_PASSES):
        stripped = F.regexp_replace(stripped, LINK, "$1")
    # A byte search is far cheaper than the passes, and texts without links stay.
    return F.when(F.contains(column, F.lit("[[")), stripped).otherwise(column)


def is_meta_title(title) -> Column:
    """Whether ``name:rest`` with no space after the colon occurs anywhere."""
    column = F.col(title) if isinstance(title, str) else title
    return column.rlike(META_TITLE)


def result_link(wiki, title) -> Column:
    """Address of an article: plain concatenation, nothing is escaped."""
    scheme, host = ARTICLE_URL
    return F.concat(F.lit(scheme), wiki, F.lit(host), title)
