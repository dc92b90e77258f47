"""How filters of documents interact, whatever order they are applied in.

A filter of one text alone is a condition on it.  The filter of repeats is an
existential self-join: a row fails it if some row with the same hash and exactly
the same text has a smaller ``doc_id`` (left-semi join).  The ids of those rows
and the ids of all other failures are united; a row's failures are the bits of
one number.  How often each number occurs per part is all that the audit needs:
what each filter removes at each step of each order follows from those counts.
"""

import json
from itertools import permutations
from math import factorial

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexisweep.llm.common import maybe_in, text_digest
from lexisweep.staging import staged

_WORDS = r"filter(split(text, r'[\x20\x09-\x0D]+', -1), w -> w <> '')"

# Failure conditions in SQL, on ``text`` and its ``words``.
CONDITIONS = {
    "A": "size(words) < 50",
    "B": "100 * size(array_distinct(words)) < 65 * size(words)",
    "C": "100 * regexp_count(text, '[A-Z]') > 5 * char_length(text)",
    "D": "text rlike '[#$%&*|]'",
}
REPEATS = "E"

_ROW = ("doc_id", "digest", "part")


def audit(
    docs: DataFrame, labels: DataFrame, conditions: dict = CONDITIONS, repeats: str = REPEATS
) -> DataFrame:
    """(part, filter_order, step, kept, removed, redundant, unique_fails, good_lost,
    toxic_lost, shapley): a row per ``source``, order of all filters, and step.

    ``conditions`` maps names to failure conditions in SQL, on ``text`` and ``words``
    (an array); ``repeats`` is the name of the filter of repeated texts.  All orders
    are listed, so there should be few filters (five have 120).  ``shapley`` is a
    filter's ``removed`` summed over all orders.

    A null text is empty, a null source the empty string.  A null ``doc_id`` is
    neither smaller nor larger than others: such rows repeat nothing, and have no
    labels.  Of equal texts with one ``doc_id`` none is a repeat of the other.
    Repeated rows count each.  Repeated labels: one is enough.  An empty table
    gives an empty one.  Texts may be of any length; other columns are not read.
    """
    names = [*conditions, repeats]
    rows = _keyed(docs)
    marked = staged(_marked(rows, conditions), "marked")
    repeat_bit = 1 << len(conditions)
    failures = marked.select(*_ROW, "bits", F.lit(1).alias("rows")).unionByName(
        _repeated(rows, marked)
        .distinct()
        .select(*_ROW, F.lit(repeat_bit).alias("bits"), F.lit(0).alias("rows"))
    )
    together = failures.groupBy(*_ROW).agg(
        F.bit_or("bits").alias("bits"), F.sum("rows").alias("rows")
    )
    known = labels.groupBy("doc_id").agg(
        F.max((F.col("quality") == 1).cast("int")).alias("good"),
        F.max((F.col("toxic") == 1).cast("int")).alias("toxic"),
    )
    among = lambda name: F.sum(F.col("rows") * F.coalesce(name, F.lit(0))).alias(name)
    counts = (
        together.join(staged(known, "known"), "doc_id", "left")
        .groupBy("part", "bits")
        .agg(F.sum("rows").alias("rows"), among("good"), among("toxic"))
    )
    per_part = counts.groupBy("part").agg(
        F.collect_list(F.struct("bits", "rows", "good", "toxic")).alias("counts")
    )
    return _steps(per_part, names)


def _keyed(docs):
    return docs.select(
        "doc_id",
        text_digest().alias("digest"),
        F.coalesce(F.col("source").cast("string"), F.lit("")).alias("part"),
        F.coalesce("text", F.lit("")).alias("text"),
    )


def _marked(rows, conditions):
    """(<row>, bits) of every row: the pass over all texts."""
    bits = F.lit(0)
    for place, condition in enumerate(conditions.values()):
        bits = bits + F.when(F.expr(condition), 1 << place).otherwise(0)
    return rows.withColumn("words", F.expr(_WORDS)).select(*_ROW, bits.alias("bits"))


def _repeated(rows, marked):
    """The rows whose text also has a smaller doc_id.

    Texts move only if their hash has several ids.  One row per text, of the
    smallest id, is what they are held against, so that a text which most rows
    have takes one partner; Spark can split the rows that look for it.
    """
    several = staged(
        marked.groupBy("digest")
        .agg(F.min("doc_id").alias("least"), F.max("doc_id").alias("most"))
        .filter("least < most")
        .select("digest"),
        "several",
    )
    # Written, or the optimiser pulls the join below the filter and moves all texts.
    texts = staged(maybe_in(rows, several, "digest"), "texts")
    firsts = staged(texts.groupBy("digest", "text").agg(F.min("doc_id").alias("first")), "firsts")
    theirs = firsts.select(F.col("digest").alias("its"), F.col("text").alias("same"), "first")
    found = (
        (F.col("digest") == F.col("its"))
        & (F.col("text") == F.col("same"))
        & (F.col("first") < F.col("doc_id"))
    )
    return texts.join(theirs, found, "left_semi").select(*_ROW)


def _steps(per_part, names):
    """A row per order and step, from the counts of a part: one per number."""
    bit = {name: 1 << place for place, name in enumerate(names)}
    orders = factorial(len(names))
    steps = [
        {
            "filter_order": "".join(order),
            "step": step,
            "own": bit[order[step - 1]],
            "before": sum(bit[name] for name in order[: step - 1]),
        }
        for order in permutations(names)
        for step in range(1, len(names) + 1)
    ]
    # One literal: thousands of expressions would be slow to plan.
    schema = "array<struct<filter_order:string,step:int,own:int,before:int>>"
    listed = F.from_json(F.lit(json.dumps(steps)), schema)
    each = per_part.select("part", "counts", F.inline(listed))
    own, before = F.col("own"), F.col("before")
    fails = lambda c, which: c["bits"].bitwiseAND(which) != 0
    total = lambda test, of: F.aggregate(
        F.filter("counts", test), F.lit(0).cast("bigint"), lambda sum_, c: sum_ + of(c)
    )
    removed = lambda c: fails(c, own) & ~fails(c, before)
    rows = lambda c: c["rows"]
    # In all orders, each of a row's failures comes first equally often.
    share = lambda c: c["rows"] * (F.lit(orders) / F.bit_count(c["bits"])).cast("bigint")
    return each.select(
        "part",
        "filter_order",
        "step",
        total(lambda c: ~fails(c, own) & ~fails(c, before), rows).alias("kept"),
        total(removed, rows).alias("removed"),
        total(lambda c: fails(c, own) & fails(c, before), rows).alias("redundant"),
        total(lambda c: c["bits"] == own, rows).alias("unique_fails"),
        total(removed, lambda c: c["good"]).alias("good_lost"),
        total(removed, lambda c: c["toxic"]).alias("toxic_lost"),
        total(lambda c: fails(c, own), share).alias("shapley"),
    )
