"""What several operators share: joins on hot keys, positions, block numbers."""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Keys that are joined by broadcast.  A key that is not among the HOT_KEYS most
# frequent ones holds less than 1/HOT_KEYS of all rows.
HOT_KEYS = 1000


def text_digest(text: str = "text") -> Column:
    """16 bytes that stand for a text; a null text is an empty one."""
    return F.unhex(F.md5(F.coalesce(F.col(text), F.lit(""))))


def join_facts(rows: DataFrame, facts: DataFrame, key: str, weight: str) -> DataFrame:
    """``rows`` left joined with ``facts``, of which each key has one row.

    ``weight`` says how many rows have the key.  The HOT_KEYS heaviest keys, a
    bounded table, are broadcast, so one key may hold most of the rows; the
    others meet in a shuffle, where each is a small share.  Rows of hot keys go
    through the same shuffle without meeting: spread evenly by ``spread`` below.
    ``facts`` is read three times: pass a staged table.
    """
    values = [c for c in facts.columns if c != key]
    packed = facts.select(key, weight, F.struct(*values).alias("__fact"))
    hot = packed.orderBy(F.col(weight).desc(), key).limit(HOT_KEYS).select(key, "__fact")
    cold = packed.join(F.broadcast(hot.select(key)), key, "left_anti").select(
        F.col(key).alias("__key"), F.lit(-1).alias("__spread"), F.col("__fact").alias("__cold")
    )
    # Of the row itself, so that a task which runs again deals it out alike.
    spread = F.pmod(F.xxhash64(*rows.columns), F.lit(65536)).cast("int")
    marked = rows.join(F.broadcast(hot), key, "left").withColumn(
        "__spread",
        F.when(F.col("__fact").isNull(), -1).otherwise(spread),
    )
    on = (F.col(key) == F.col("__key")) & (marked["__spread"] == cold["__spread"])
    joined = marked.join(cold, on, "left")
    fact = F.coalesce("__fact", "__cold")
    return joined.select(*rows.columns, *(fact[c].alias(c) for c in values))


# Words of 64 bits in the largest filter of ``maybe_in``: 2 ** 21 rows are broadcast.
FILTER_WORDS = 1 << 21


def maybe_in(rows: DataFrame, wanted: DataFrame, key: str) -> DataFrame:
    """The ``rows`` whose ``key`` is in ``wanted``, and a few others.

    A Bloom filter spares a join the rows that it would drop, before they are
    shuffled; the join itself has to follow.  A key sets four bits of one word;
    the words, at most FILTER_WORDS, are broadcast.  Beyond some 4 * FILTER_WORDS
    keys more and more other rows pass, none that is wanted is ever lost.
    ``wanted`` is read twice: pass a staged table.
    """
    count = wanted.count()
    words = 1024
    while words < FILTER_WORDS and words * 4 < count:
        words *= 2
    hashed = F.xxhash64(key)
    slot = F.pmod(hashed, F.lit(words)).cast("int").alias("__slot")
    of = "shiftleft(1L, cast(shiftright(xxhash64(`{key}`), {by}) & 63 as int))"
    bits = F.expr(" | ".join(of.format(key=key, by=by) for by in (24, 33, 42, 51))).alias("__bits")
    filled = wanted.select(slot, bits).groupBy("__slot").agg(F.bit_or("__bits").alias("__word"))
    held = rows.select("*", slot, bits).join(F.broadcast(filled), "__slot")
    return held.filter("(__word & __bits) = __bits").select(*rows.columns)


def numbered(rows: DataFrame, groups, order, out: str) -> DataFrame:
    """Number rows from 0 without gaps in each of ``groups``, which may be huge.

    Rows are dealt over blocks by their hash and numbered there; the rows of a
    group in earlier blocks are added.  ``order`` need only be total up to equal
    rows.  The sums over blocks have at most as many rows per group as there
    are shuffle partitions.
    """
    blocks = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = rows.withColumn("__block", F.pmod(F.xxhash64(*order), F.lit(blocks)).cast("int"))
    counts = dealt.groupBy(*groups, "__block").agg(F.count(F.lit(1)).alias("__rows"))
    earlier = (
        Window.partitionBy(*groups)
        .orderBy("__block")
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    before = counts.withColumn("__before", F.coalesce(F.sum("__rows").over(earlier), F.lit(0)))
    within = Window.partitionBy(*groups, "__block").orderBy(*order)
    placed = dealt.withColumn("__place", F.row_number().over(within) - 1)
    return placed.join(before.drop("__rows"), [*groups, "__block"]).select(
        *rows.columns, (F.col("__before") + F.col("__place")).cast("bigint").alias(out)
    )
