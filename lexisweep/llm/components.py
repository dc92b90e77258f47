"""Connected components: forests inside partitions, stars between them."""

import numpy
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexisweep.llm.shingles import Forest
from lexisweep.staging import staged

# Links of which a task makes one forest, a few MB.
RUN = 1 << 18


def components(links: DataFrame) -> DataFrame:
    """(node, component) of every node of ``links`` (u, v), longs: the component
    is its smallest node.

    In partitions of about RUN links, a forest replaces the links by one per node, to
    the root of its tree; that settles most components, and paths that lie in one
    partition.  Rounds of large and small stars join what is left.  Each
    round writes its links as a table, so lineage stays short.  A node may have most
    of the links: minima combine before the shuffle, and the join that spreads them
    reads written tables, so that Spark can split a hot node's rows.
    """
    stars = _forests(links)
    while not _are_stars(stars):
        stars = _forests(_small_star(_large_star(stars)))
    # Partitions may have found the same link.
    once = stars.distinct()
    return once.select(F.col("u").alias("node"), F.col("v").alias("component")).union(
        stars.select("v", "v").distinct()
    )


def _forests(links):
    """Falling links (node, root) of spanning forests of the links of each partition,
    staged.  Links are written first, so that their number can size the partitions."""
    links = staged(links.select("u", "v"), "found")
    parts = 1 + links.count() // RUN

    def trees(batches):
        held, size = [], 0
        for batch in batches:
            held.append(batch)
            size += batch.num_rows
            if size >= RUN:
                yield _trees(held)
                held, size = [], 0
        if size:
            yield _trees(held)

    return staged(links.coalesce(parts).mapInArrow(trees, "u bigint, v bigint"), "links")


def _trees(batches):
    u, v = (
        numpy.concatenate([b.column(k).to_numpy(zero_copy_only=False) for b in batches])
        for k in (0, 1)
    )
    nodes, places = numpy.unique(numpy.concatenate([u, v]), return_inverse=True)
    forest = Forest(len(nodes))
    for x, y in zip(places[: len(u)].tolist(), places[len(u) :].tolist()):
        forest.join(x, y)
    roots = numpy.array([forest.root(x) for x in range(len(nodes))], dtype=numpy.int64)
    below = roots < numpy.arange(len(nodes))
    return pa.RecordBatch.from_arrays(
        [pa.array(nodes[below]), pa.array(nodes[roots[below]])], ["u", "v"]
    )


def _are_stars(links):
    """Whether each node has links to one smaller node, which has no such link."""
    ends = links.select(
        F.col("u").alias("node"), F.col("v").alias("low"), F.col("v").alias("high"), F.lit(0).alias("up")
    )
    ends = ends.union(links.select("v", F.lit(None), F.lit(None), F.lit(1)))
    nodes = ends.groupBy("node").agg(
        F.min("low").alias("low"), F.max("high").alias("high"), F.max("up").alias("up")
    )
    between = (F.col("low") < F.col("high")) | (F.col("low").isNotNull() & (F.col("up") == 1))
    return nodes.filter(between).isEmpty()


def _large_star(links):
    """Larger neighbours are linked to the least neighbour, or the node itself."""
    both = links.union(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.least(F.first("u"), F.min("v")).alias("m"))
    rising = links.select(F.col("v").alias("u"), F.col("u").alias("v"))
    joined = rising.join(staged(least, "least"), "u")
    return joined.select(F.col("v").alias("u"), F.col("m").alias("v"))


def _small_star(links):
    """Smaller neighbours and the node itself are linked to the least one.  After a
    large star no node has many smaller neighbours."""
    least = links.groupBy("u").agg(F.min("v").alias("m"))
    found = links.join(least, "u")
    own = found.select("u", F.col("m").alias("v"))
    others = found.select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u > v")
    return own.union(others).distinct()
