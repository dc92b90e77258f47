"""Near-duplicate documents: tensored banding of minhashes, exact verification.

A table of the usual banding has a key of 2 * ROWS minhashes, and each of the
SIDE * SIDE tables its own.  Here two collections hold SIDE half keys of ROWS
minhashes each, and a table's key is a pair of half keys, one of either: as many
tables from 2 * SIDE * ROWS minhashes, about a square root of what it took.  Two
documents meet unless one collection has no half key in common: at 85 % likeness
about once in 7000 pairs.  For a lower threshold the collections grow (``side``),
so that pairs at the threshold are missed no more often.

Documents with equal shingle sets are one class; everything below is on classes.

1. Buckets propose: each class is linked with the smallest class of its bucket
   (a star, not all pairs), and the components of that are clusters.
2. A cluster of at most BLOCK classes is verified in one task, all pairs at once.
3. In larger clusters each class is first verified against the stars it came by.
   Components of those links are mostly final.  Whoever is not in the cluster's
   largest component (outsiders) is then verified against all its classes, in
   blocks, each of which returns at most as many links as it has classes.

So no pair of a cluster that could join two components is left unverified.
"""

import math

import numpy
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lexisweep.llm.common import join_facts, maybe_in, numbered, text_digest
from lexisweep.llm.components import components
from lexisweep.llm.shingles import (
    Forest,
    linked,
    minhashes,
    mixed,
    numbers,
    shingle_set,
)
from lexisweep.staging import staged

# Half keys of a collection at a threshold of 85 % or more, and minhashes of a half
# key.
SIDE = 10
ROWS = 3

# Classes that are verified in one task, and pairs of one chunk with a star.
BLOCK = 256

_FOLD = numbers(4, ROWS)


def side(percent):
    """Half keys of a collection: pairs at ``percent`` are missed at most as often
    as pairs at 85 % with SIDE of them."""
    if percent >= 85:
        return SIDE
    miss = [math.log(1 - (p / 100) ** ROWS) for p in (85, percent)]
    return math.ceil(SIDE * miss[0] / miss[1])


def half_keys(values, seeds):
    """Half keys of a shingle set, one for ROWS seeds, as signed 64-bit numbers."""
    least = minhashes(values, seeds).reshape(-1, ROWS)
    folded = mixed((least * _FOLD[None, :]).sum(axis=1, dtype=numpy.uint64))
    return folded.view(numpy.int64)


def _sketched(docs, percent):
    """(doc_id, n_shingles, digest, text_digest, halves) per row; the first pass
    over the texts.  Documents without words have no digest."""
    id_type = docs.schema["doc_id"].dataType.simpleString()
    schema = (
        f"doc_id {id_type}, text_digest binary, n_shingles bigint, "
        "digest binary, halves array<bigint>"
    )
    seeds = numbers(3, 2 * side(percent) * ROWS)

    def sketch(batches):
        import xxhash

        for batch in batches:
            sizes, digests, halves = [], [], []
            for text in batch.column("text"):
                values = shingle_set(text.as_py())
                sizes.append(len(values))
                found = len(values) > 0
                digests.append(xxhash.xxh3_128_digest(values.tobytes()) if found else None)
                halves.append(half_keys(values, seeds) if found else None)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"),
                    batch.column("text_digest"),
                    pa.array(sizes, pa.int64()),
                    pa.array(digests, pa.binary()),
                    pa.array(halves, pa.list_(pa.int64())),
                ],
                ["doc_id", "text_digest", "n_shingles", "digest", "halves"],
            )

    rows = docs.select("doc_id", text_digest().alias("text_digest"), "text")
    return rows.mapInArrow(sketch, schema)


def _proposed(classes, percent):
    """(u, v): each class and the smallest class of a bucket that it is in."""
    n = side(percent)
    left = F.posexplode(F.slice("halves", 1, n)).alias("i", "a")
    right = F.posexplode(F.slice("halves", n + 1, n)).alias("j", "b")
    keys = (
        classes.select("class", "halves", left)
        .select("class", "i", "a", right)
        .select("class", F.xxhash64("i", "j", "a", "b").alias("key"))
    )
    full = keys.groupBy("key").agg(F.min("class").alias("star"), F.count(F.lit(1)).alias("n"))
    full = staged(full.filter("n > 1"), "buckets")
    return (
        join_facts(keys, full, "key", "n")
        .filter("star < class")
        .select(F.col("class").alias("u"), F.col("star").alias("v"))
        .distinct()
    )


def _texts_of(docs, wanted):
    """``wanted`` with the text of its (doc_id, text_digest): many rows may have one
    id, or none, but a class is met only by rows equal to its representative.  Only
    texts that may be wanted are shuffled."""
    ids = wanted.withColumnsRenamed({"doc_id": "__id", "text_digest": "__digest"})
    texts = maybe_in(
        docs.select("doc_id", "text", text_digest().alias("text_digest")), wanted, "text_digest"
    )
    same = F.col("doc_id").eqNullSafe(F.col("__id")) & (F.col("text_digest") == F.col("__digest"))
    return texts.join(ids, same).select("class", "cluster", "members", "text")


def _sets_of(docs, wanted):
    """(class, cluster, members, values) for ``wanted`` (those and doc_id,
    text_digest), from the texts; a class may come more than once if rows are
    repeated."""

    def sets(batches):
        for batch in batches:
            values = [shingle_set(text.as_py()).view(numpy.int64) for text in batch.column("text")]
            names = ["class", "cluster", "members"]
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(n) for n in names), pa.array(values, pa.list_(pa.int64()))],
                [*names, "values"],
            )

    return _texts_of(docs, wanted).mapInArrow(
        sets, "class bigint, cluster bigint, members bigint, values array<bigint>"
    )


def _unsigned(column):
    return [numpy.asarray(v).view(numpy.uint64) for v in column]


def _verified_alone(small, percent):
    """(node, component) from whole clusters, many of them in a task."""

    def verify(frame):
        import pandas

        frame = frame.drop_duplicates("class").sort_values(["cluster", "class"])
        found = []
        for _, group in frame.groupby("cluster", sort=False):
            sets, forest = _unsigned(group["values"]), Forest(len(group))
            for x, y in numpy.argwhere(numpy.triu(linked(sets, sets, percent), 1)):
                forest.join(int(x), int(y))
            ids = group["class"].to_numpy()
            found.append((ids, ids[[forest.root(x) for x in range(len(ids))]]))
        nodes, roots = (numpy.concatenate(x) for x in zip(*found))
        return pandas.DataFrame({"node": nodes, "component": roots})

    schema = "node bigint, component bigint"
    return small.groupBy("bin").applyInPandas(verify, schema)


def _star_links(links, sets, percent):
    """The links (u, v) of which both sets are alike enough; sets meet in chunks
    of at most BLOCK rows, whatever the number of links of one ``v``."""
    ranked = numbered(links, ["v"], ["u"], "rank")
    chunked = staged(ranked.withColumn("chunk", F.expr(f"rank div {BLOCK}")), "chunks")
    stars = (
        chunked.groupBy("v")
        .agg(F.max("chunk").alias("last"))
        .join(sets.select(F.col("class").alias("v"), F.col("values").alias("star")), "v")
        .select("v", "star", F.explode(F.sequence(F.lit(0), F.col("last"))).alias("chunk"))
    )
    ours = chunked.join(sets.select(F.col("class").alias("u"), "values"), "u")
    both = F.size(F.array_intersect("values", "star"))
    union = F.size("values") + F.size("star") - F.col("both")
    return (
        ours.join(stars, ["v", "chunk"])
        .withColumn("both", both)
        .filter(100 * F.col("both") >= percent * union)
        .select("u", "v")
    )


def _block_links(members, percent):
    """Links of outsiders with all classes of their clusters.

    ``members``: (cluster, component, class, values), each class once.
    """
    sizes = members.groupBy("cluster", "component").agg(F.count(F.lit(1)).alias("n"))
    totals = sizes.groupBy("cluster").agg(
        F.max_by("component", F.struct("n", -F.col("component"))).alias("largest"),
        F.max("n").alias("n"),
        F.sum("n").alias("all"),
    )
    open_ = totals.filter("all > n").select(
        "cluster", "largest", "all", (F.col("all") - F.col("n")).alias("out")
    )
    narrow = members.select("cluster", "component", "class")
    every = numbered(narrow, ["cluster"], ["class"], "rank")
    outside = numbered(
        narrow.join(open_.select("cluster", "largest"), "cluster").filter("component != largest"),
        ["cluster"],
        ["class"],
        "rank",
    )
    blocks = lambda n: F.sequence(F.lit(0), F.expr(f"({n} - 1) div {BLOCK}"))
    of = F.expr(f"rank div {BLOCK}")
    left = outside.join(open_, "cluster").select(
        "cluster", "class", "component", of.alias("x"), F.explode(blocks("all")).alias("y"),
        F.lit(True).alias("out_side"),
    )
    right = every.join(open_, "cluster").select(
        "cluster", "class", "component", F.explode(blocks("out")).alias("x"), of.alias("y"),
        F.lit(False).alias("out_side"),
    )
    dealt = left.union(right).join(members.select("class", "values"), "class")

    def verify(frame):
        import pandas

        frame = frame.sort_values(["out_side", "class"])
        sides = [frame[frame["out_side"]], frame[~frame["out_side"]]]
        sets = [_unsigned(side["values"]) for side in sides]
        found = []
        if sets[0] and sets[1]:
            components_ = [side["component"].to_numpy() for side in sides]
            new = linked(*sets, percent) & (components_[0][:, None] != components_[1][None, :])
            number = {c: k for k, c in enumerate(numpy.unique(numpy.concatenate(components_)))}
            forest = Forest(len(number))
            ids = [side["class"].to_numpy() for side in sides]
            for x, y in numpy.argwhere(new):
                if forest.join(number[components_[0][x]], number[components_[1][y]]):
                    found.append((ids[0][x], ids[1][y]))
        return pandas.DataFrame(found, columns=["u", "v"], dtype="int64")

    return dealt.groupBy("cluster", "x", "y").applyInPandas(verify, "u bigint, v bigint")


def _class_components(docs, classes, percent):
    """(node, component) for the classes that are in clusters; others are alone."""
    links = staged(_proposed(classes, percent), "proposed")
    clusters = components(links).select(
        F.col("node").alias("class"), F.col("component").alias("cluster")
    )
    facts = clusters.groupBy("cluster").agg(F.count(F.lit(1)).alias("members"))
    sized = staged(
        join_facts(clusters, staged(facts, "sizes"), "cluster", "members"), "clusters"
    )
    wanted = classes.select("class", "doc_id", "text_digest").join(sized, "class")
    wanted = staged(wanted, "wanted")
    sets = staged(_sets_of(docs, wanted), "sets")
    small = sets.filter(F.col("members") <= BLOCK)
    bins = 1 + sized.count() // BLOCK
    alone = _verified_alone(
        small.withColumn("bin", F.pmod(F.xxhash64("cluster"), F.lit(bins))), percent
    )
    if sized.filter(F.col("members") > BLOCK).isEmpty():
        return alone
    large = staged(
        sets.filter(F.col("members") > BLOCK)
        .groupBy("class", "cluster")
        .agg(F.first("values").alias("values")),
        "large",
    )
    inside = large.select("class")
    near = staged(
        _star_links(
            links.join(inside.withColumnRenamed("class", "u"), "u", "left_semi"), large, percent
        ),
        "near",
    )
    first = components(near).select(F.col("node").alias("class"), "component")
    members = staged(
        large.join(first, "class", "left").select(
            "cluster", F.coalesce("component", "class").alias("component"), "class", "values"
        ),
        "members",
    )
    return alone.union(components(near.union(_block_links(members, percent))))


def near_duplicates(docs: DataFrame, percent: int = 85) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept, text_digest, component) of every row.

    Documents are linked if 100 * intersection >= percent * union of their sets
    of 5-word shingles; ``component_id`` is the smallest ``doc_id`` that links
    reach, ``kept`` says that it is the row's own.  A text without words, or
    null, has no shingles and is linked with nothing.  Rows with a null id are
    linked like others; the smallest id is that of the others, if any.  Repeated
    rows get the same result.  ``component`` numbers the components, null without
    shingles.  An empty table gives an empty one.  Only
    ``doc_id`` and ``text`` are read.
    """
    rows = staged(_sketched(docs, percent), "sketches")
    # A null id comes after all others.
    row = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_digest")
    classes = staged(
        rows.filter("digest is not null")
        .groupBy("digest")
        .agg(
            F.min(row).alias("one"),
            F.first("halves").alias("halves"),
            F.count(F.lit(1)).alias("rows"),
        )
        .select("digest", "one.doc_id", "one.text_digest", "halves", "rows")
        .withColumn("class", F.monotonically_increasing_id()),
        "classes",
    )
    found = _class_components(docs, classes, percent)
    labels = staged(
        classes.select("class", "digest", "rows", "doc_id")
        .join(found.withColumnRenamed("node", "class"), "class", "left")
        .withColumn("component", F.coalesce("component", "class")),
        "labels",
    )
    least = labels.groupBy("component").agg(
        F.min("doc_id").alias("component_id"), F.count(F.lit(1)).alias("n")
    )
    facts = join_facts(labels, staged(least, "least"), "component", "n")
    facts = staged(facts.select("digest", "rows", "component_id", "component"), "facts")
    joined = join_facts(rows.drop("halves"), facts, "digest", "rows")
    own = F.when(F.col("digest").isNull(), F.col("doc_id")).otherwise(F.col("component_id"))
    return joined.withColumn("component_id", own).select(
        "doc_id",
        "n_shingles",
        "component_id",
        F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"),
        "text_digest",
        "component",
    )


def keep_one(docs: DataFrame, percent: int = 85) -> DataFrame:
    """One row of ``docs`` for each component of near duplicates, all columns: that
    of the smallest id, and of several with that id the least by text digest.

    Of rows without shingles those with different ids or texts are all kept.
    Equal rows (same id, same text) count once.
    """
    found = near_duplicates(docs, percent).filter("kept")
    one = found.groupBy("component").agg(F.min(F.struct("doc_id", "text_digest")).alias("one"))
    chosen = one.filter("component is not null").select("one.*")
    alone = found.filter("component is null").select("doc_id", "text_digest").distinct()
    reps = chosen.union(alone).toDF("__id", "__digest")
    names = docs.columns
    rows = docs.select(F.struct(*names).alias("__doc"), text_digest().alias("__own"))
    same = F.col("__doc")["doc_id"].eqNullSafe(F.col("__id")) & (F.col("__own") == F.col("__digest"))
    first = F.row_number().over(Window.partitionBy("__id", "__digest").orderBy(F.lit(0)))
    return (
        rows.join(staged(reps, "kept"), same)
        .withColumn("__first", first)
        .filter("__first = 1")
        .select(*(F.col("__doc")[n].alias(n) for n in names))
    )
