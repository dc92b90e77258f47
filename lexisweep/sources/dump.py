"""XML dumps."""

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lexisweep.schema import DUMP_PAGE

# The element of a page, and how it is parsed.  Surrounding
# spaces belong to the text.
ROW_TAG = "page"
PARSE_OPTIONS = {"mode": "PERMISSIVE", "ignoreSurroundingSpaces": "false"}

_MALFORMED = "_malformed"
_START, _END = rf"<{ROW_TAG}[\s>]", f"</{ROW_TAG}>"


# What is parsed of a page to get its article: malformed other elements, which
# nobody reads, do not cost the page.
ARTICLE = T.StructType(
    [
        T.StructField("title", T.StringType()),
        T.StructField(
            "revision",
            T.StructType(
                [T.StructField("text", T.StructType([T.StructField("_VALUE", T.StringType())]))]
            ),
        ),
    ]
)

# Where a page stands: its file and the split of it.
SPLIT = ("file_path", "file_block_start")


def read_dump(
    spark: SparkSession, path: str, columns=None, schema=DUMP_PAGE, places=False
) -> DataFrame:
    """One row per page of a dump, plain or bz2; malformed pages are dropped.

    ``columns`` names the top-level elements of ``schema`` wanted, all by default.
    A page counts as malformed only if what is parsed is: nothing else is looked
    at.  ``places`` adds the columns of SPLIT.

    Spark's XML format reads each file in one task.  A dump is one huge file, so
    it is cut into records at the end tag by the text source, which splits plain
    and bz2 files alike, and each record is parsed by itself.
    """
    wanted = schema.fieldNames() if columns is None else list(columns)
    parsed_as = T.StructType(
        [schema[name] for name in wanted] + [T.StructField(_MALFORMED, T.StringType())]
    )
    options = PARSE_OPTIONS | {"columnNameOfCorruptRecord": _MALFORMED}
    records = _records(spark, path)
    from_start = F.regexp_extract("value", f"(?s){_START}.*", 0)
    page = F.from_xml(F.concat(from_start, F.lit(_END)), parsed_as, options)
    # Through a generator, so that the test below does not parse a second time.
    parsed = records.select(*(SPLIT if places else ()), F.inline(F.array(page)))
    return parsed.filter(F.col(_MALFORMED).isNull()).drop(_MALFORMED)


def dump_splits(spark: SparkSession, path: str) -> DataFrame:
    """(file_path, file_block_start, split): the splits that hold pages, numbered
    in the order of file names and places.  One row per split: a small table."""
    splits = _records(spark, path).select(*SPLIT).distinct()
    return splits.withColumn("split", F.row_number().over(Window.orderBy(*SPLIT)) - 1)


def _records(spark, path):
    """(value, <SPLIT>) of the pieces that hold a page: not so after the last."""
    place = [F.col(f"_metadata.{name}").alias(name) for name in SPLIT]
    text = spark.read.text(path, lineSep=_END)
    return text.select("value", *place).filter(F.col("value").rlike(_START))


def write_dump(pages: DataFrame, path: str, compression: str = "none") -> None:
    """Write pages (any part of the dump schema) in the format read above."""
    (
        pages.write.format("xml")
        .option("rowTag", ROW_TAG)
        .option("rootTag", "mediawiki")
        .option("compression", compression)
        .save(path)
    )
