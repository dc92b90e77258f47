"""Shards of nearly equal bytes by differencing (Karmarkar and Karp).

Equal texts form a group that stays together.  A group is a partial partition:
its bytes in one shard, nothing in the others.  Differencing takes the two
partial partitions of largest spread and combines them in opposite order, the
fullest part of one with the emptiest of the other, until one is left.

That runs in blocks: each task differences some thousand groups to one partial
partition, and these are the items of the next level, a few thousand times
fewer, until one is left.  Every level is a table; no level meets in one place.
"""

import heapq
import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexisweep.llm.common import join_facts, numbered, text_digest
from lexisweep.staging import staged

# Partial partitions that one task combines.
BLOCK = 2048


def difference(items, parts):
    """For each item, a list of ``parts`` sums: which final part each goes to."""
    orders, heap, merges = [], [], []
    for number, sums in enumerate(items):
        order = sorted(range(parts), key=sums.__getitem__, reverse=True)
        orders.append(order)
        heap.append(_entry(number, [sums[p] for p in order]))
    heapq.heapify(heap)
    while len(heap) > 1:
        (_, a, large), (_, b, small) = heapq.heappop(heap), heapq.heappop(heap)
        sums = [x + y for x, y in zip(large, reversed(small))]
        order = sorted(range(parts), key=sums.__getitem__, reverse=True)
        heapq.heappush(heap, _entry(len(items) + len(merges), [sums[p] for p in order]))
        merges.append((a, b, order))
    places = {heap[0][1]: list(range(parts))}
    for number in range(len(merges) - 1, -1, -1):
        a, b, order = merges[number]
        final = places.pop(len(items) + number)
        of_a, of_b = [0] * parts, [0] * parts
        for place, part in enumerate(order):
            of_a[part] = of_b[parts - 1 - part] = final[place]
        places[a], places[b] = of_a, of_b
    result = []
    for number, order in enumerate(orders):
        final = [0] * parts
        for place, part in enumerate(order):
            final[part] = places[number][place]
        result.append(final)
    return result


def _entry(number, sums):
    """Heap entry: largest spread first; only differences of sums matter."""
    least = sums[-1]
    return least - sums[0], number, [x - least for x in sums]


def assign(groups: DataFrame, key: str, size: str, parts: int, block: int = BLOCK) -> DataFrame:
    """(key, part) for every row of ``groups``: sums of ``size`` nearly equal.

    ``groups`` has unique keys.  Ties are broken by key.  Runs a job per level.
    """
    spark = groups.sparkSession
    n = groups.count()
    blocks = max(1, math.ceil(n / block))
    items = groups.select(
        F.col(key).alias("node"),
        F.pmod(F.xxhash64(key), F.lit(blocks)).alias("parent"),
        F.lit(0).alias("bin"),
        F.col(size).cast("bigint").alias("bytes"),
    )
    node = items.schema["node"].dataType.simpleString()
    levels = []
    while True:
        schema = f"node {node}, parent bigint, bin int, part int, bytes bigint"
        levels.append(
            staged(items.groupBy("parent").applyInPandas(_combine(parts), schema), "parts")
        )
        if blocks == 1:
            break
        done, node = levels[-1], "bigint"
        blocks = math.ceil(blocks / block)
        items = (
            done.groupBy("parent", "part")
            .agg(F.sum("bytes").alias("bytes"))
            .select(
                F.col("parent").alias("node"),
                F.pmod(F.xxhash64("parent"), F.lit(blocks)).alias("parent"),
                F.col("part").alias("bin"),
                "bytes",
            )
        )
    final = levels.pop().select("node", "bin", "part")
    while levels:
        upper = final.select(F.col("node").alias("parent"), F.col("bin").alias("part"), F.col("part").alias("to"))
        final = levels.pop().join(upper, ["parent", "part"]).select("node", "bin", F.col("to").alias("part"))
    return final.select(F.col("node").alias(key), "part")


def _combine(parts):
    def combine(frame):
        import numpy

        frame = frame.sort_values(["node", "bin"], ignore_index=True)
        first = ~frame["node"].duplicated().to_numpy()
        number = numpy.cumsum(first) - 1
        sums = numpy.zeros((int(first.sum()), parts), dtype="int64")
        sums[number, frame["bin"]] = frame["bytes"]
        final = numpy.array(difference(sums.tolist(), parts), dtype="int32")
        frame["part"] = final[number, frame["bin"]]
        return frame[["node", "parent", "bin", "part", "bytes"]]

    return combine


def shard_by_bytes(docs: DataFrame, shards: int) -> DataFrame:
    """(doc_id, size, text_crc32, law, shard, slot, grown_shard) of every row.

    Law ``bytes``: sizes of shards nearly equal, equal texts in one shard.  A size
    is the text's UTF-8 bytes plus 1, so empty and null texts (equal ones) count;
    one text that fills more than its share leaves its shard larger than others.
    Repeated rows are kept, each with its own slot; slots are gapless from 0 in
    each shard.  Null ids are treated like others.  An empty table gives an empty
    one.  Only ``doc_id`` and ``text`` are read; the text is not shuffled.
    """
    text = F.coalesce("text", F.lit(""))
    rows = staged(
        docs.select(
            "doc_id",
            (F.octet_length(text) + 1).cast("bigint").alias("size"),
            F.crc32(text.cast("binary")).alias("text_crc32"),
            text_digest().alias("digest"),
        ),
        "sizes",
    )
    groups = staged(
        rows.groupBy("digest").agg(
            F.sum("size").alias("bytes"), F.count(F.lit(1)).alias("rows")
        ),
        "groups",
    )
    parts = assign(groups, "digest", "bytes", shards)
    facts = staged(groups.join(parts, "digest").select("digest", "rows", "part"), "shards")
    placed = join_facts(rows, facts, "digest", "rows").select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), F.col("part").alias("shard")
    )
    slotted = numbered(staged(placed, "placed"), ["shard"], ["doc_id", "size", "text_crc32"], "slot")
    return slotted.withColumn("grown_shard", F.lit(None).cast("int"))
