"""Choosing and cleaning the pages of a dump."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexisweep.functions.wiki import is_meta_title
from lexisweep.functions.wiki import strip_links as strip_links_column


def select_page_text(dump: DataFrame, *keys: str) -> DataFrame:
    """Title and article text, behind the columns ``keys``."""
    return dump.select(*keys, "title", F.col("revision.text._VALUE").alias("text"))


def drop_null_pages(pages: DataFrame) -> DataFrame:
    """Drop a page without title or without text (an empty element is null)."""
    return pages.na.drop("any", subset=["title", "text"])


def drop_meta_pages(pages: DataFrame) -> DataFrame:
    """Drop pages of other namespaces, told by their titles."""
    return pages.filter(~is_meta_title("title"))


def strip_links(pages: DataFrame) -> DataFrame:
    """Replace wiki links in the text by their labels."""
    return pages.withColumn("text", strip_links_column("text"))
