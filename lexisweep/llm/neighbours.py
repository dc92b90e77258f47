"""Approximate nearest neighbours: a graph per shard, every shard is searched.

Equal vectors are one class with its smallest ids, so copies neither fill the
graph nor are lost.  Classes are dealt over shards by hash; each shard's graph is
built in one task and written.  Queries are distinct vectors as well; slices of
them meet each shard's graph in a task, which holds one shard and one slice.
"""

import math

import numpy
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lexisweep.llm import graph
from lexisweep.llm.common import join_facts
from lexisweep.staging import staged

# Shards at least, and classes of one at most on average.
SHARDS = 8
SHARD_ROWS = 65_536

# Query vectors of one slice, and of one step.
SLICE = 8192
TOGETHER = 256

# Beam width of searches.
BEAM = 128


def _valid(vectors):
    """(vec_id, vector, digest): one vector for each id, of the commonest length."""
    value = F.transform("embedding", lambda x: x.cast("double") + F.lit(0.0))
    sound = F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < math.inf))
    some = F.exists("vector", lambda x: x != 0)
    rows = (
        vectors.filter("vec_id is not null and embedding is not null")
        .select(F.col("vec_id").cast("bigint").alias("vec_id"), value.alias("vector"))
        .filter(F.coalesce(sound & some, F.lit(False)))
    )
    one = staged(rows.groupBy("vec_id").agg(F.min("vector").alias("vector")), "vectors")
    sizes = one.groupBy(F.size("vector").alias("n")).count()
    most = sizes.orderBy(F.col("count").desc(), "n").first()
    written = F.array_join(F.transform("vector", lambda x: x.cast("string")), ",")
    return one.filter(F.size("vector") == (most["n"] if most else 0)).withColumn(
        "digest", F.unhex(F.md5(written))
    )


def _least_ids(rows, n):
    """(digest, ids): the ``n`` smallest ids of each digest, sorted.

    A digest may have most of the rows, so ids are thinned out in parts first;
    each step keeps at most ``n`` of a part.
    """
    ids = rows.select("digest", "vec_id")
    for parts in (1024, 32, 1):
        part = F.pmod(F.xxhash64("vec_id"), F.lit(parts))
        order = Window.partitionBy("digest", "part").orderBy("vec_id")
        ids = (
            ids.withColumn("part", part)
            .withColumn("place", F.row_number().over(order))
            .filter(F.col("place") <= n)
            .select("digest", "vec_id")
        )
    return ids.groupBy("digest").agg(F.array_sort(F.collect_list("vec_id")).alias("ids"))


def _built(classes, shards):
    """Staged (shard, node, class vector, ids, edges, entry), a row per class."""

    def build(frame):
        frame = frame.sort_values("first", ignore_index=True)
        edges, entry = graph.build(numpy.stack(frame["vector"].to_numpy()))
        frame["node"] = numpy.arange(len(frame), dtype="int32")
        frame["edges"] = list(edges.astype("int32"))
        frame["entry"] = frame["node"] == entry
        return frame[["shard", "node", "vector", "ids", "edges", "entry"]]

    schema = (
        "shard int, node int, vector array<double>, ids array<bigint>, "
        "edges array<int>, entry boolean"
    )
    dealt = classes.select(
        F.pmod(F.xxhash64("digest"), F.lit(shards)).cast("int").alias("shard"),
        F.element_at("ids", 1).alias("first"),
        "vector",
        "ids",
    )
    return staged(dealt.groupBy("shard").applyInPandas(build, schema), "graph")


def _searched(built, queries, shards, slices, k, beam):
    """(query, score, ids): the ``k`` best classes of each shard for each query."""
    cut = F.pmod(F.xxhash64("query"), F.lit(slices)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = built.withColumn("slice", every(slices)).groupBy("shard", "slice")
    right = queries.select("query", F.col("vector").alias("asked"), cut.alias("slice"))
    right = right.withColumn("shard", every(shards)).groupBy("shard", "slice")

    def search(nodes, asked):
        import pandas

        found = []
        if len(nodes) and len(asked):
            nodes = nodes.sort_values("node", ignore_index=True)
            vectors = numpy.stack(nodes["vector"].to_numpy())
            edges = numpy.stack(nodes["edges"].to_numpy())
            entry = int(nodes["entry"].to_numpy().argmax())
            points = graph.even_lengths(vectors)
            firsts = numpy.array([ids[0] for ids in nodes["ids"]])
            exact = numpy.stack(asked["asked"].to_numpy())
            flat = numpy.concatenate([exact, numpy.zeros((len(exact), 1))], axis=1)
            flat = flat.astype(numpy.float32)
            for low in range(0, len(asked), TOGETHER):
                part = slice(low, low + TOGETHER)
                near, _ = graph.beam_search(points, edges, entry, flat[part], beam)
                scores = numpy.einsum("ijk,ik->ij", vectors[near], exact[part])
                scores[near < 0] = -numpy.inf
                order = numpy.lexsort((firsts[near], -scores), axis=1)[:, :k]
                for row, query in enumerate(asked["query"].to_numpy()[part]):
                    best = order[row][near[row, order[row]] >= 0]
                    for place in best:
                        found.append((query, scores[row, place], nodes["ids"][near[row, place]]))
        return pandas.DataFrame(found, columns=["query", "score", "ids"])

    return left.cogroup(right).applyInPandas(
        search, "query binary, score double, ids array<bigint>"
    )


def nearest(vectors: DataFrame, every: int = 20, k: int = 20, beam: int = BEAM) -> DataFrame:
    """(query_id, rank, vec_id, score): the ``k`` nearest found of every row but
    the query's own, for rows whose vec_id is divisible by ``every``.

    Nearness is the inner product of the vectors in double precision, ties go to
    the smaller vec_id.  Null and zero vectors, such with null or non-finite
    components, of another length than most, and rows without id take no part; of
    rows that share an id the least vector counts.  With ``k`` candidates or fewer
    in all, all are found that the graph reaches.  An empty table gives an empty
    one.
    """
    rows = _valid(vectors)
    # Any class can give all k results, and one id may be the query's own.
    ids = _least_ids(rows, k + 1)
    sample = rows.groupBy("digest").agg(F.first("vector").alias("vector"))
    classes = staged(sample.join(ids, "digest"), "classes")
    n = classes.count()
    shards = max(SHARDS, math.ceil(n / SHARD_ROWS))
    asked = rows.filter(F.col("vec_id") % every == 0).select("vec_id", "digest")
    weights = staged(asked.groupBy("digest").agg(F.count(F.lit(1)).alias("rows")), "queries")
    queries = classes.join(weights, "digest").select(F.col("digest").alias("query"), "vector")
    slices = max(1, math.ceil(weights.count() / SLICE))
    found = _searched(_built(classes, shards), queries, shards, slices, k + 1, beam)
    # k + 1 classes, then k + 1 ids of them, of each query.
    by_class = Window.partitionBy("query").orderBy(F.col("score").desc(), F.element_at("ids", 1))
    by_id = Window.partitionBy("query").orderBy(F.col("score").desc(), "vec_id")
    best = (
        staged(found, "found")
        .withColumn("place", F.row_number().over(by_class))
        .filter(F.col("place") <= k + 1)
        .select("query", "score", F.explode("ids").alias("vec_id"))
        .withColumn("place", F.row_number().over(by_id))
        .filter(F.col("place") <= k + 1)
        .groupBy(F.col("query").alias("digest"))
        .agg(F.array_sort(F.collect_list(F.struct("place", "vec_id", "score"))).alias("near"))
    )
    facts = staged(best.join(weights, "digest"), "nearest")
    named = join_facts(asked.withColumnRenamed("vec_id", "query_id"), facts, "digest", "rows")
    others = F.filter("near", lambda x: x["vec_id"] != F.col("query_id"))
    return named.select("query_id", F.posexplode(F.slice(others, 1, k)).alias("at", "x")).select(
        "query_id", (F.col("at") + 1).alias("rank"), "x.vec_id", "x.score"
    )
