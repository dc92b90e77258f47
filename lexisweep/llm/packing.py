"""Packing of whole documents into sequences by patterns of lengths.

1. ``pieces`` cuts each document's ids into pieces of at most one sequence.
2. A histogram of lengths, as long as a sequence, is all that the plan needs.
   Patterns of a few lengths (in bins) that fill a sequence are enumerated;
   non-negative least squares fits how often each is used to the histogram.
   The counts are rounded down.  The smallest piece of each pattern and what
   the rounding leaves go, longest first, where they fit best: into the rests of
   sequences or into new ones.
3. The plan says for ranges of the pieces of one length which sequences they go
   to, at which offset.  Its size depends on the number of lengths only.  Pieces
   are numbered within their length, and meet the plan in a broadcast join.
"""

import bisect
import zlib
from collections import defaultdict

import numpy
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexisweep.llm.common import numbered
from lexisweep.llm.words import KEPT, words
from lexisweep.staging import staged

# Bins of lengths, and documents of a pattern at most.
BINS = 128
FEW = 4


def pieces(
    docs: DataFrame, path: str, capacity: int, end: int = 0, ids: bool = False, kept: int = KEPT
) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32[, ids]) of every row of ``docs``.

    A document is its text's ids and the id ``end``; a null text is empty.  Only
    longer documents are cut, into pieces of ``capacity`` ids.  ``kept`` bounds the
    bytes of words that a Python worker remembers.
    """
    schema = "doc_id {}, piece int, start bigint, length bigint, ids_crc32 bigint".format(
        docs.schema["doc_id"].dataType.simpleString()
    ) + (", ids binary" if ids else "")
    width, last = 4 * capacity, int(end).to_bytes(4, "little")

    def cut(batches):
        encode = words(path, kept).encode
        for batch in batches:
            rows, columns = [], [[] for _ in range(4 + ids)]
            for row, text in enumerate(batch.column("text")):
                whole = encode(text.as_py() or "") + last
                for piece, at in enumerate(range(0, len(whole), width)):
                    part = whole[at : at + width]
                    values = piece, at // 4, len(part) // 4, zlib.crc32(part), part
                    rows.append(row)
                    for column, value in zip(columns, values):
                        column.append(value)
            kinds = [pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary()]
            arrays = [pa.array(c, k) for c, k in zip(columns, kinds)]
            keys = batch.column("doc_id").take(pa.array(rows, pa.int64()))
            names = ["doc_id", "piece", "start", "length", "ids_crc32", "ids"][: 5 + ids]
            yield pa.RecordBatch.from_arrays([keys, *arrays], names)

    return docs.select("doc_id", "text").mapInArrow(cut, schema)


def patterns(bins: int = BINS, few: int = FEW):
    """All falling tuples of 1 to ``few`` bins that sum to ``bins``."""

    def parts(total, most, left):
        if total <= most:
            yield (total,)
        if left > 1:
            for first in range(min(most, total - 1), (total - 1) // left, -1):
                for rest in parts(total - first, first, left - 1):
                    yield (first, *rest)

    return list(parts(bins, bins, few))


def nnls(a, b, tolerance=1e-9):
    """x >= 0 that minimises |a x - b|, by the active-set method."""
    x, active = numpy.zeros(a.shape[1]), numpy.zeros(a.shape[1], dtype=bool)
    scale = max(1.0, float(numpy.abs(b).max(initial=0)))
    for _ in range(3 * a.shape[0]):
        gradient = a.T @ (b - a @ x)
        gradient[active] = -numpy.inf
        best = int(gradient.argmax())
        if gradient[best] <= tolerance * scale:
            break
        active[best] = True
        while True:
            chosen = numpy.flatnonzero(active)
            fit = numpy.linalg.lstsq(a[:, chosen], b, rcond=None)[0]
            if (fit > 0).all():
                x[:] = 0
                x[chosen] = fit
                break
            old, low = x[chosen], fit <= 0
            step = (old[low] / (old[low] - fit[low])).min()
            x[chosen] = numpy.maximum(old + step * (fit - old), 0)
            active &= x > 1e-12
            x[~active] = 0
            if not active.any():
                break
    return x


class Plan:
    """Ranges of the pieces of each length, and where they go."""

    def __init__(self, histogram, capacity):
        self.capacity, self.left, self.next = capacity, dict(histogram), defaultdict(int)
        self.ranges, self.sequences = [], 0
        self.open = defaultdict(list)  # rest of a sequence -> [(first sequence, how many)]

    def take(self, length, count, sequence, offset):
        """The next ``count`` pieces of a length go to as many sequences."""
        low = self.next[length]
        self.ranges.append((length, low, low + count, sequence, offset))
        self.next[length] += count
        self.left[length] -= count

    def fill_patterns(self, bins=BINS, few=FEW):
        """Sequences that hold all but the smallest piece of their pattern.

        Bins are of rounded lengths, so a pattern fills a sequence on average.
        The smallest piece is left to ``fill_rest``, which finds for each exact
        rest what fits best; else the rounding would be lost in every sequence.
        """
        width = -(-self.capacity // bins)
        bins = self.capacity // width
        inside = defaultdict(list)  # bin -> its lengths, longest first
        for length in sorted((n for n, c in self.left.items() if c), reverse=True):
            inside[min(bins, max(1, (2 * length + width) // (2 * width)))].append(length)
        have = numpy.zeros(bins)
        for b, lengths in inside.items():
            have[b - 1] = sum(self.left[n] for n in lengths)
        usable = [p for p in patterns(bins, few) if all(have[b - 1] for b in p)]
        if not usable:
            return
        use = numpy.zeros((bins, len(usable)))
        for column, pattern in enumerate(usable):
            for b in pattern:
                use[b - 1, column] += 1
        times = numpy.floor(nnls(use, have) + 1e-6).astype(int)
        for column in numpy.argsort(-times, kind="stable"):
            pattern = usable[column]
            count = min(
                int(times[column]),
                *(int(have[b - 1]) // pattern.count(b) for b in pattern),
            )
            if count <= 0:
                continue
            for b in pattern:
                have[b - 1] -= count
            made = [(self.sequences, count, 0)]  # first sequence, how many, filled
            self.sequences += count
            for b in pattern[:-1] or pattern:
                made = self._fill_slot(made, inside[b])
            for sequence, n, filled in made:
                if filled < self.capacity:
                    self.open[self.capacity - filled].append((sequence, n))

    def _fill_slot(self, made, lengths):
        """Longest pieces of the bin to the emptiest sequences, if they fit."""
        result = []
        for sequence, n, filled in sorted(made, key=lambda m: (m[2], m[0])):
            fitting = (x for x in lengths if filled + x <= self.capacity and self.left[x])
            while n and (length := next(fitting, None)):
                count = min(n, self.left[length])
                self.take(length, count, sequence, filled)
                result.append((sequence, count, filled + length))
                sequence, n = sequence + count, n - count
            if n:
                result.append((sequence, n, filled))
        return result

    def fill_rest(self):
        """Best fit, longest first; the pieces of one length go together."""
        rests = sorted(self.open)
        for length in sorted((n for n, c in self.left.items() if c), reverse=True):
            while self.left[length]:
                at = bisect.bisect_left(rests, length)
                if at == len(rests):
                    rest, n = self.capacity, -(-self.left[length] // (self.capacity // length))
                    sequence, self.sequences = self.sequences, self.sequences + n
                else:
                    rest = rests[at]
                    sequence, n = self.open[rest].pop()
                    if not self.open[rest]:
                        rests.pop(at)
                count = min(n, self.left[length])
                self.take(length, count, sequence, self.capacity - rest)
                for new, s, many in (
                    (rest - length, sequence, count),
                    (rest, sequence + count, n - count),
                ):
                    if new and many:
                        if not self.open[new]:
                            bisect.insort(rests, new)
                        self.open[new].append((s, many))


def plan(histogram, capacity: int) -> Plan:
    """Of a {length: count}, with all lengths from 1 to ``capacity``."""
    made = Plan(histogram, capacity)
    made.fill_patterns()
    made.fill_rest()
    return made


def pack(cut: DataFrame, capacity: int) -> DataFrame:
    """Rows of ``pieces`` with ``sequence_id`` and ``offset``.  Pass a staged table.

    The driver gets one row per length.
    """
    spark = cut.sparkSession
    counts = cut.groupBy("length").count().collect()  # at most ``capacity`` rows
    ranges = plan({r["length"]: r["count"] for r in counts}, capacity).ranges
    schema = "length bigint, low bigint, high bigint, sequence bigint, offset bigint"
    table = spark.createDataFrame(ranges, schema).withColumnRenamed("length", "of")
    ranked = numbered(cut, ["length"], ["doc_id", "piece", "start", "ids_crc32"], "rank")
    on = (F.col("length") == F.col("of")) & F.col("rank").between(F.col("low"), F.col("high") - 1)
    return ranked.join(F.broadcast(table), on).select(
        *cut.columns,
        (F.col("sequence") + F.col("rank") - F.col("low")).alias("sequence_id"),
        "offset",
    )


def pack_documents(docs: DataFrame, path: str, capacity: int, kept: int = KEPT) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, sequence_id, offset), per piece.

    Every row of ``docs`` has at least one piece: an empty or null text is the
    end id alone.  Repeated rows and null ids are packed like others.  An empty
    table gives an empty one.  Only ``doc_id`` and ``text`` are read.
    """
    return pack(staged(pieces(docs, path, capacity, kept=kept), "pieces"), capacity)
