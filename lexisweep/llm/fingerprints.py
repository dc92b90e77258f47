"""Fingerprints by Lempel-Ziv phrases.

A text is parsed as LZ78 does: each phrase is the longest phrase seen before plus
one character.  What two texts share of their phrases is what a compressor could
use of one for the other.  The phrases' hashes form a set, and the SIZE smallest
of them, written in hexadecimal, are the fingerprint.  The likeness of two
fingerprints estimates the Jaccard similarity of the phrase sets from the SIZE
smallest hashes of both; with fewer phrases it is exact.
"""

import bisect
import functools
import hashlib
import math

import numpy
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexisweep.llm.shingles import mixed, numbers

SIZE = 128

_TIMES = numbers(6, 1)[0]


class Phrases:
    """The phrases of a text, and those of another with the same beginning."""

    def __init__(self, text):
        self.text, self.seen, self.ends = text, set(), []
        self._parse(0)

    def _parse(self, at):
        """Phrases from ``at`` on.  With a phrase its beginnings are in the set, so
        the longest one can be sought from any length, here from the last one's."""
        text, seen, ends, n, size = self.text, self.seen, self.ends, len(self.text), 1
        self.last_seen_before = False
        while at < n:
            end = at + size
            phrase = text[at:end]
            if phrase in seen:
                while phrase in seen and end < n:
                    end += 1
                    phrase = text[at:end]
                if phrase in seen:  # the text ends in a phrase seen before
                    ends.append(n)
                    self.last_seen_before = True
                    return
            else:
                end = at + len(phrase)
                while end - 1 > at and (shorter := text[at : end - 1]) not in seen:
                    phrase, end = shorter, end - 1
            seen.add(phrase)
            ends.append(end)
            at, size = end, end - at

    def turn_to(self, text, common):
        """Parse ``text`` instead, of which the first ``common`` characters are the
        same; returns how many phrases stay."""
        keep = bisect.bisect_right(self.ends, common)
        if keep == len(self.ends) and self.last_seen_before:
            keep -= 1  # it may go on
        starts = [self.ends[keep - 1] if keep else 0, *self.ends[keep:]]
        gone = list(zip(starts, self.ends[keep:]))
        if self.last_seen_before:
            gone.pop()
        self.seen.difference_update(self.text[a:b] for a, b in gone)
        del self.ends[keep:]
        self.text = text
        self._parse(starts[0])
        return keep


@functools.lru_cache(maxsize=8)
def _powers(size):
    return numpy.cumprod(numpy.full(size, _TIMES))


def _hashes(text, ends, start=0):
    """32-bit hashes of the phrases of ``text[start:]``."""
    ends = numpy.array(ends, dtype=numpy.int64) - start
    if not len(ends):
        return numpy.zeros(0, numpy.uint32)
    points = numpy.frombuffer(text[start:].encode("utf-32-le"), dtype="<u4").astype(numpy.uint64)
    starts = numpy.concatenate(([0], ends[:-1]))
    sizes = ends - starts
    place = numpy.arange(len(points)) - numpy.repeat(starts, sizes)
    powers = _powers(1 << int(sizes.max()).bit_length())
    hashes = mixed(numpy.add.reduceat((points + numpy.uint64(1)) * powers[place], starts))
    return (hashes >> numpy.uint64(32)).astype(numpy.uint32)


def _written(hashes):
    if len(hashes) > 4 * SIZE:
        hashes = hashes[hashes <= numpy.partition(hashes, 2 * SIZE)[2 * SIZE]]
    return numpy.unique(hashes)[:SIZE].astype(">u4").tobytes().hex()


def fingerprint(text):
    """The smallest hashes of the phrase set, 8 hexadecimal digits each, rising;
    of an empty text, an empty string."""
    return _written(_hashes(text, Phrases(text).ends))


def fingerprint_pair(text, other, common):
    """Fingerprints of two texts whose first ``common`` characters are the same,
    which are parsed once."""
    phrases = Phrases(text)
    hashes = _hashes(text, phrases.ends)
    keep = phrases.turn_to(other, common)
    start = phrases.ends[keep - 1] if keep else 0
    more = _hashes(other, phrases.ends[keep:], start)
    return _written(hashes), _written(numpy.concatenate([hashes[:keep], more]))


def likeness(one, other):
    """0 to 1; two empty texts are alike."""
    if one == other:
        return 1.0
    a = numpy.frombuffer(bytes.fromhex(one), ">u4").astype(numpy.int64)
    b = numpy.frombuffer(bytes.fromhex(other), ">u4").astype(numpy.int64)
    both = numpy.sort(numpy.concatenate([a, b]))
    twice = both[1:] == both[:-1]
    distinct = both[numpy.concatenate(([True], ~twice))]
    # A fingerprint that is not full holds its whole set.
    size = min(len(distinct), SIZE)
    if size == 0:
        return 0.0
    return float((both[1:][twice] <= distinct[size - 1]).sum() / size)


def with_next(docs: DataFrame) -> DataFrame:
    """Rows (block, ord, doc_id, text): each document once, in blocks of doc_id,
    and after each block, with ``ord`` 1, the one that follows its last.

    A block is a range of ids; there are as many as shuffle partitions, so what
    the driver gets, a bound and a first id for each, is bounded by that setting.
    The first document follows the last.  Only ids are read to find the blocks.
    """
    spark = docs.sparkSession
    wanted = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ids = docs.select("doc_id")
    shares = [k / wanted for k in range(1, wanted)]
    bounds = []
    if shares:
        found = ids.agg(F.percentile_approx("doc_id", shares, 100 * wanted)).first()[0]
        bounds = sorted(set(found or []))
    block = _block_of(bounds)
    least = F.struct(F.col("doc_id").isNotNull(), "doc_id")
    firsts = ids.groupBy(block.alias("block")).agg(F.min(least)["doc_id"].alias("id")).collect()
    firsts = sorted((r["block"], r["id"]) for r in firsts)  # at most ``wanted``
    before, first_id, null_first = [None] * wanted, [None] * wanted, False
    for k, (number, first) in enumerate(firsts):
        before[number] = firsts[k - 1][0]  # the last one's for the first
        first_id[number] = first
        null_first = null_first or first is None
    lookup = lambda values, kind: F.get(
        F.array(*map(F.lit, values)).cast(f"array<{kind}>"), F.col("own")
    )
    is_first = F.coalesce(F.col("doc_id") == lookup(first_id, "bigint"), F.lit(null_first))
    place = lambda number, ord_: F.struct(
        number.alias("block"), F.lit(ord_).alias("ord")
    )
    own = place(F.col("own"), 0)
    # One pass: every row goes to its block, and a first one also to the block before.
    targets = F.when(is_first, F.array(own, place(lookup(before, "int"), 1))).otherwise(F.array(own))
    return docs.select(
        "doc_id", F.coalesce("text", F.lit("")).alias("text"), block.alias("own")
    ).select(F.inline(targets), "doc_id", "text")


def _block_of(bounds):
    """How many of the sorted ``bounds`` are less than doc_id, in two steps of
    about the square root of their number; null ids come before all others."""
    if not bounds:
        return F.lit(0)
    step = math.isqrt(len(bounds) - 1) + 1
    smaller = lambda array: F.size(F.filter(array, lambda b: b < F.col("doc_id")))
    literal = lambda values: F.array(*map(F.lit, values)).cast("array<bigint>")
    skipped = smaller(literal(bounds[step - 1 :: step])) * step
    inside = smaller(F.slice(literal(bounds), skipped + 1, F.lit(step)))
    return F.when(F.col("doc_id").isNull(), 0).otherwise(skipped + inside)


def edited_likeness(docs: DataFrame) -> DataFrame:
    """(doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint,
    near_edited, near_next) of every row.

    The edited text is the text with its last quarter (floor of n_chars / 4 code
    points) replaced by as many first ones, or all, of the next document in the
    order of doc_id; the first document follows the last.  Null texts are empty;
    rows of equal id are in the order of their texts, those without id come
    first.  One document follows itself.  An empty table gives an empty one.
    Texts are shuffled once; only ``doc_id`` and ``text`` are read.

    A block is read in order by one task that holds a document and the next.
    """
    blocks = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = (
        with_next(docs)
        .repartitionById(blocks, "block")
        .sortWithinPartitions("block", "ord", F.col("doc_id").asc_nulls_first(), "text")
    )
    names = ["doc_id", "n_chars", "edited_sha256", "fingerprint"]
    names += ["edited_fingerprint", "near_edited", "near_next"]
    kinds = [pa.int64(), pa.int64(), *[pa.string()] * 3, pa.float64(), pa.float64()]

    def compare(batches):
        out, last, waiting = [], None, None

        def batch():
            columns = zip(*out) if out else [[]] * len(names)
            arrays = [pa.array(c, k) for c, k in zip(columns, kinds)]
            return pa.RecordBatch.from_arrays(arrays, names)

        def follow(own):
            """The waiting row has learnt its next one's fingerprint."""
            if waiting is not None:
                out.append((*waiting, likeness(waiting[3], own)))

        for found in batches:
            columns = (found.column(n) for n in ("block", "ord", "doc_id", "text"))
            for row in zip(*columns):
                block, after, doc_id, text = (value.as_py() for value in row)
                if last is not None and (block != last[0] or last[1]):
                    # ``last`` followed its block's last row, and was asked for that.
                    if block == last[0]:
                        continue
                    follow(fingerprint(last[3]))
                    last, waiting = None, None
                if last is not None:
                    _, _, own_id, own = last
                    cut = len(own) // 4
                    edited = own[: len(own) - cut] + text[:cut]
                    mark, other = fingerprint_pair(own, edited, len(own) - cut)
                    follow(mark)
                    digest = hashlib.sha256(edited.encode()).hexdigest()
                    waiting = (own_id, len(own), digest, mark, other, likeness(mark, other))
                last = block, after, doc_id, text
            yield batch()
            out.clear()
        if last is not None:
            follow(fingerprint(last[3]))
        yield batch()

    schema = (
        f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, n_chars bigint, "
        "edited_sha256 string, fingerprint string, edited_fingerprint string, "
        "near_edited double, near_next double"
    )
    return rows.mapInArrow(compare, schema)
