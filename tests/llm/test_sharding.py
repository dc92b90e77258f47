import itertools
import zlib

from hypothesis import given, settings
from hypothesis import strategies as st

from lexisweep.llm import registered, sharding

SCHEMA = "doc_id long, text string, size string, shard string"


def spread(items, final, parts):
    sums = [0] * parts
    for item, to in zip(items, final):
        assert sorted(to) == list(range(parts))
        for part, value in enumerate(item):
            sums[to[part]] += value
    return max(sums) - min(sums)


def test_known_two_way():
    items = [[x, 0] for x in (8, 7, 6, 5, 4)]
    assert spread(items, sharding.difference(items, 2), 2) == 2


@given(st.lists(st.integers(1, 50), min_size=1, max_size=40), st.integers(2, 5))
@settings(max_examples=200, deadline=None)
def test_spread_is_at_most_the_largest(sizes, parts):
    items = [[x] + [0] * (parts - 1) for x in sizes]
    assert spread(items, sharding.difference(items, parts), parts) <= max(sizes)


def check(rows, out, shards):
    assert sorted((r.doc_id is None, r.doc_id, r.size, r.text_crc32) for r in out) == sorted(
        (i is None, i, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t in rows
    )
    by = {}
    for r in out:
        assert 0 <= r.shard < shards and r.law == "bytes" and r.grown_shard is None
        by.setdefault(r.shard, []).append(r)
    for found in by.values():
        assert sorted(r.slot for r in found) == list(range(len(found)))
    for _, same in itertools.groupby(sorted(out, key=lambda r: (r.text_crc32, r.size)), lambda r: (r.text_crc32, r.size)):
        assert len({r.shard for r in same}) == 1
    return [sum(r.size for r in by.get(s, [])) for s in range(shards)]


def test_edges(spark):
    rows = [(1, "a"), (1, "a"), (2, None), (3, ""), (None, "b" * 50), (5, "long " * 40_000)]
    df = spark.createDataFrame([(i, t, "x", None) for i, t in rows], SCHEMA)
    check(rows, sharding.shard_by_bytes(df, 3).collect(), 3)
    assert sharding.shard_by_bytes(df.limit(0), 3).collect() == []


def test_levels(spark):
    groups = spark.range(500).selectExpr("id as g", "id * 37 % 101 + 1 as size")
    out = sharding.assign(groups, "g", "size", 4, block=8).collect()
    sums = [0] * 4
    for r in out:
        sums[r.part] += r.g * 37 % 101 + 1
    assert len(out) == 500 and max(sums) - min(sums) <= 10  # blocks of 8 are far too small for better


def test_query(spark, data):
    rows = spark.read.parquet(f"{data}/documents.parquet").select("doc_id", "text").collect()
    sizes = check(rows, registered.QUERIES["op6_sharding"](spark, data).collect(), 8)
    assert max(sizes) - min(sizes) <= 2


def plain_difference(items, parts):
    """Differencing on sets: the (item, bin) pairs of each final part, fullest first."""
    partials = []
    for number, sums in enumerate(items):
        bins = [(value, {(number, k)}) for k, value in enumerate(sums)]
        partials.append((number, sorted(bins, key=lambda b: -b[0])))
    made = len(items)
    while len(partials) > 1:
        partials.sort(key=lambda p: (p[1][-1][0] - p[1][0][0], p[0]))
        (_, a), (_, b) = partials[:2]
        both = [(x + y, s | t) for (x, s), (y, t) in zip(a, reversed(b))]
        partials[:2] = [(made, sorted(both, key=lambda b: -b[0]))]
        made += 1
    return [pairs for _, pairs in partials[0][1]]


@given(st.integers(2, 5).flatmap(lambda p: st.lists(st.lists(st.integers(0, 30), min_size=p, max_size=p), min_size=1, max_size=30)))
@settings(max_examples=300, deadline=None)
def test_difference_equals_brute_force(items):
    parts = len(items[0])
    got = [set() for _ in range(parts)]
    for number, to in enumerate(sharding.difference(items, parts)):
        for k, part in enumerate(to):
            got[part].add((number, k))
    assert got == plain_difference(items, parts)
