"""A table of queries, of any size, as a join of texts with patterns.

No query passes the driver.  Patterns and texts meet by parts of theirs:

* A whole word that is one run of word characters meets the words of the texts,
  counted per page.
* Any other pattern of fewer than 8 bytes meets the fragments of that length.
* A longer one meets the places of its rarest fragment of 8 bytes; there the texts
  are compared with it, byte by byte.  Patterns with a fragment that stands nowhere
  are done with at once.

Only fragments that pass a bounded filter of those wanted leave the scan.  The queries
are broadcast while they take at most BROADCAST_BYTES; else both sides are shuffled,
and the rows of the HOT_KEYS heaviest words or fragments are split in parts.
"""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexisweep.functions import grams
from lexisweep.functions.match import WORD_CHARACTERS
from lexisweep.operators.queries import WIKIS, complete_queries
from lexisweep.schema import CORPUS_KEYS
from lexisweep.staging import staged

BROADCAST_BYTES = 16 << 20

HOT_KEYS = 1000
# Rows of one part of a hot key.
PART = 1 << 18


def search_table(corpus: DataFrame, queries: DataFrame) -> DataFrame:
    """``(query_id, <keys>, count)`` of every matching page of every query of the
    table ``(query_id, pattern, whole_words, min_matches, wiki)``.

    Absent or null parameters get their defaults; queries that cannot run (no id or
    pattern, negative minimum, language that the corpus does not have) find nothing.
    A query without a minimum gets every page of its language.  ``seq`` has to be
    unique in the corpus, ``query_id`` in the table.
    """
    asked, found = _scored(corpus, queries)
    keys = _keys(corpus)
    hits = found.filter(F.col("count") >= F.col("min_matches")).select("query_id", *keys, "count")
    every = asked.filter(F.col("min_matches") == 0).select("query_id", "wiki")
    if every.isEmpty():
        return hits
    # By meaning a row per page and query.  Pages are spread, queries copied to each part.
    parts = int(corpus.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    pages = _spoken(corpus).select(*keys, "wiki", F.pmod(F.xxhash64("seq"), F.lit(parts)).alias("__part"))
    copies = every.withColumn("__part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1)))).withColumn(
        "__part", F.col("__part").cast("bigint")
    )
    pairs = pages.join(copies, ["wiki", "__part"]).select("query_id", *keys)
    absent = pairs.join(hits.select("query_id", "seq"), ["query_id", "seq"], "left_anti")
    return hits.unionByName(absent.select("query_id", *keys, F.lit(0).cast("bigint").alias("count")))


def table_stats(corpus: DataFrame, queries: DataFrame) -> DataFrame:
    """Per query the totals of search_stats; no best page if nothing is found."""
    asked, found = _scored(corpus, queries)
    totals = found.groupBy("query_id").agg(
        F.sum("count").alias("words"),
        F.count_if(F.col("count") >= F.col("min_matches")).alias("hits"),
        F.max("count").alias("most"),
        F.max_by("title", F.struct("count", "seq")).alias("max_page_title"),
    )
    pages = _spoken(corpus).groupBy("wiki").agg(F.count(F.lit(1)).alias("pages"))
    # Languages are the few that queries ask for.
    zero = F.lit(0).cast("bigint")
    return (
        asked.select("query_id", "min_matches", "wiki")
        .join(totals, "query_id", "left")
        .join(pages, "wiki", "left")
        .select(
            "query_id",
            F.coalesce("words", zero).alias("num_word_matches"),
            F.when(F.col("min_matches") == 0, F.coalesce("pages", zero))
            .otherwise(F.coalesce("hits", zero))
            .alias("num_page_matches"),
            F.coalesce("most", zero).alias("max_word_matches"),
            "max_page_title",
        )
    )


def _keys(corpus):
    return [name for name in CORPUS_KEYS if name in corpus.columns]


def _spoken(corpus):
    """The corpus with a language; pages of a null one are asked by no query."""
    return corpus if "wiki" in corpus.columns else corpus.withColumn("wiki", F.lit(WIKIS[0]))


def _scored(corpus, queries):
    """The staged queries, and ``(query_id, min_matches, <keys>, count)`` of every
    query and page that it occurs in."""
    runs = f"^[{WORD_CHARACTERS}]+\\z"
    full = complete_queries(queries).filter(
        "query_id is not null and pattern <> '' and min_matches >= 0"
    )
    if "wiki" not in corpus.columns:
        full = full.filter(F.col("wiki").isin(*WIKIS))
    asked = staged(
        full.select(
            "query_id",
            "pattern",
            "whole_words",
            F.col("min_matches").cast("bigint").alias("min_matches"),
            "wiki",
            (F.col("whole_words") & F.rlike("pattern", F.lit(runs))).alias("is_word"),
        ),
        "queries",
    )
    sizes = asked.groupBy("is_word").agg(F.sum(F.octet_length("pattern") + 64).alias("bytes"))
    sizes = {r["is_word"]: r["bytes"] for r in sizes.collect()}  # two rows
    pages, keys = _spoken(corpus).select(*_keys(corpus), "wiki", "text"), _keys(corpus)
    found = []
    if True in sizes:
        small = sizes[True] <= BROADCAST_BYTES
        found.append(_by_word(pages, keys, asked.filter("is_word"), small))
    if False in sizes:
        small = sizes[False] <= BROADCAST_BYTES
        found += _by_fragment(pages, keys, asked.filter("not is_word"), small)
    columns = ["query_id", "min_matches", *keys, "count"]
    if not found:
        nothing = pages.filter("false").crossJoin(asked.filter("false").select("query_id", "min_matches"))
        return asked, nothing.withColumn("count", F.lit(0).cast("bigint")).select(*columns)
    scored = found[0].select(*columns)
    for more in found[1:]:
        scored = scored.unionByName(more.select(*columns))
    return asked, scored


def _by_word(pages, keys, asked, small):
    wanted = asked.select("query_id", "min_matches", "wiki", F.col("pattern").alias("word"))
    run = F.lit(f"[{WORD_CHARACTERS}]+")
    words = pages.select(*keys, "wiki", F.explode(F.regexp_extract_all("text", run, F.lit(0))).alias("word"))
    if small:  # words that nobody asks for are not counted
        words = words.join(F.broadcast(wanted.select("word").distinct()), "word", "left_semi")
    counted = words.groupBy(*keys, "wiki", "word").agg(F.count(F.lit(1)).alias("count"))
    return _meet(counted, wanted, ["word"], small)


def _by_fragment(pages, keys, asked, small):
    rows = staged(
        asked.withColumn("row", F.monotonically_increasing_id()), "patterns"
    )  # numbers that stay, once written
    every = staged(
        rows.select("row", "pattern").mapInArrow(
            grams.pattern_grams, "row bigint, size int, offset bigint, gram bigint"
        ),
        "fragments",
    )
    long = every.filter(F.col("size") == grams.SIZE)
    first = _filter(long)
    chosen = every.filter(F.col("size") < grams.SIZE).select("row", "size", "offset", "gram")
    if first is not None:
        counted = pages.select("text").mapInArrow(grams.gram_counter(first), "gram bigint, n bigint")
        counted = counted.groupBy("gram").agg(F.sum("n").alias("n"))
        rarest = (
            long.join(counted, "gram", "left")
            .groupBy("row")
            .agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "offset", "gram")).alias("least"))
            .filter("least.n > 0")
            .select("row", F.lit(grams.SIZE).alias("size"), "least.offset", "least.gram")
        )
        chosen = chosen.unionByName(rarest)
    chosen = staged(chosen, "chosen")
    shared = _filter(chosen)
    if shared is None:
        return []
    names = [*keys, "wiki"]
    kept = ", ".join(f"{k} {pages.schema[k].dataType.simpleString()}" for k in names)
    places = pages.mapInArrow(
        grams.gram_finder(shared, names),
        f"{kept}, size int, gram bigint, at bigint, anywhere bigint, whole bigint",
    )
    wanted = rows.join(chosen, "row").select(
        "query_id", "min_matches", "wiki", "whole_words", "size", "gram", "offset", "pattern"
    )
    met = staged(_meet(places, wanted, ["size", "gram"], small), "places")
    group = ["query_id", "min_matches", *keys]
    occurrences = F.when(F.col("whole_words"), F.col("whole")).otherwise(F.col("anywhere"))
    short = met.filter(F.col("size") < grams.SIZE).groupBy(*group)
    short = short.agg(F.sum(occurrences).alias("count")).filter("count > 0")
    if first is None:
        return [short]
    at = met.filter((F.col("size") == grams.SIZE) & (F.col("at") >= F.col("offset")))
    at = at.select(*group, "whole_words", "pattern", (F.col("at") - F.col("offset")).alias("start"))
    texts = pages.select("seq", F.col("text").cast("binary").alias("bytes"))
    exact = texts.join(at, "seq").filter(_stands()).groupBy(*group)
    return [short, exact.agg(F.count(F.lit(1)).alias("count"))]


def _stands():
    """Whether ``pattern`` stands at byte ``start`` of ``bytes``."""
    word = f"[{WORD_CHARACTERS}]"
    # Positions of substr count from 1; a part of a character is no word character.
    same = "substr(bytes, int(start) + 1, octet_length(pattern)) = cast(pattern as binary)"
    before = f"start > 0 and cast(substr(bytes, greatest(int(start), 1), 1) as string) rlike '{word}'"
    after = f"cast(substr(bytes, int(start) + 1 + octet_length(pattern), 1) as string) rlike '{word}'"
    return F.expr(f"{same} and (not whole_words or not (({before}) or {after}))")


def _filter(fragments):
    """A broadcast filter of ``(size, gram)``; None if there are none."""
    wanted = fragments.select("size", "gram").distinct()
    counts = {r["size"]: r["count"] for r in wanted.groupBy("size").count().collect()}  # <= SIZE rows
    if not counts:
        return None
    bits = grams.filter_bits(sum(counts.values()))
    words = wanted.mapInArrow(grams.filter_words(bits), "slot int, word bigint")
    words = words.groupBy("slot").agg(F.bit_or("word").alias("word")).toPandas()  # 2 ** 19 rows at most
    filled = grams.Filter(bits, sorted(counts), words["slot"].to_numpy(), words["word"].to_numpy())
    return fragments.sparkSession.sparkContext.broadcast(filled)


def _meet(rows, wanted, key, small):
    """Inner join on ``key`` and language; see the module for sizes."""
    on = [*key, "wiki"]
    if small:
        return rows.join(F.broadcast(wanted), on)
    rows = staged(rows, "rows")
    heaviest = rows.groupBy(*on).count().orderBy(F.desc("count"), *on).limit(HOT_KEYS)
    parts = F.ceil(F.col("count") / PART).cast("bigint").alias("__parts")
    hot = F.broadcast(heaviest.select(*on, parts))
    one = F.coalesce("__parts", F.lit(1).cast("bigint"))
    rows = rows.join(hot, on, "left").withColumn("__part", F.pmod(F.xxhash64(*rows.columns), one))
    copies = F.explode(F.sequence(F.lit(0).cast("bigint"), one - 1))
    wanted = wanted.join(hot, on, "left").withColumn("__part", copies)
    return rows.drop("__parts").join(wanted.drop("__parts"), [*on, "__part"]).drop("__part")
