"""Fragments of texts: where the fragments of many patterns stand.

A fragment is the first SIZE bytes at some place of a pattern, or a whole pattern of
fewer bytes, as an integer (``gram``) beside its number of bytes (``size``).  Bytes of
UTF-8 do: an occurrence of one text in another starts and ends between characters.
Whole Arrow batches are looked at as arrays, a bounded piece at a time.
"""

import numpy
import pyarrow as pa

from lexisweep.functions.multi_match import OUTPUT_ROWS

SIZE = 8

# Bytes of text whose fragments are held at once: few enough for a processor's cache.
PIECE = 1 << 17

# Bits of a filter of fragments: 16 for each, within these bounds (4 MB at most).
LEAST_BITS, MOST_BITS = 16, 25

_FACTORS = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)

_WORD = numpy.zeros(256, dtype=bool)
_WORD[list(b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789_")] = True


def filter_bits(fragments: int) -> int:
    """Binary logarithm of the size of a filter of so many fragments."""
    return min(max((16 * fragments).bit_length(), LEAST_BITS), MOST_BITS)


def _places(grams, size, bits, factor):
    mixed = (grams ^ numpy.uint64(size)) * numpy.uint64(factor)
    return mixed >> numpy.uint64(64 - bits)


def filter_words(bits):
    """A function for ``mapInArrow``: from ``(size, gram)`` to the words of 64 bits
    ``(slot, word)`` of a filter, of which equal slots are yet to be united."""

    def fill(batches):
        for batch in batches:
            sizes = numpy.asarray(batch.column("size"))
            grams = numpy.asarray(batch.column("gram")).view(numpy.uint64)
            places = [
                _places(grams[sizes == size], size, bits, factor)
                for size in numpy.unique(sizes).tolist()
                for factor in _FACTORS
            ]
            places = numpy.unique(numpy.concatenate([numpy.zeros(0, numpy.uint64), *places]))
            slots, first = numpy.unique(places >> numpy.uint64(6), return_index=True)
            ones = numpy.uint64(1) << (places & numpy.uint64(63))
            words = numpy.bitwise_or.reduceat(ones, first) if len(slots) else ones
            columns = [slots.astype(numpy.int32), words.view(numpy.int64)]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["slot", "word"])

    return fill


class Filter:
    """Which fragments may be wanted: all that are, and a few others."""

    def __init__(self, bits, sizes, slots, words):
        self.bits, self.sizes = bits, sizes
        self.words = numpy.zeros(1 << (bits - 6), dtype=numpy.uint64)
        self.words[slots] = numpy.asarray(words, dtype=numpy.int64).view(numpy.uint64)

    def at(self, grams, size):
        """Places in ``grams`` of those that may be wanted."""
        found = None
        for factor in _FACTORS:
            places = _places(grams if found is None else grams[found], size, self.bits, factor)
            words = self.words[places >> numpy.uint64(6)]
            passed = numpy.flatnonzero((words >> (places & numpy.uint64(63))) & numpy.uint64(1))
            found = passed if found is None else found[passed]
        return found


def _bytes(column):
    """The bytes of a column of texts and where each starts (and the last ends)."""
    column = column.cast(pa.large_binary())
    _, offsets, data = column.buffers()
    first = column.offset
    offsets = numpy.frombuffer(offsets, numpy.int64)[first : first + len(column) + 1] if offsets else None
    if offsets is None or not len(offsets):
        offsets = numpy.zeros(len(column) + 1, numpy.int64)
    if column.null_count:  # a null text has no bytes, whatever its offsets say
        column = column.fill_null(b"")
        return _bytes(column)
    data = numpy.frombuffer(data, numpy.uint8) if data else numpy.zeros(0, numpy.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


class Piece:
    """The fragments that start at the bytes of one piece of a batch."""

    def __init__(self, data, offsets, start):
        self.offsets, self.start = offsets, start
        size = min(PIECE, len(data) - start)
        # Whole rounds of SIZE starts, and what the last fragments need beyond them.
        held = numpy.zeros(-(-size // SIZE) * SIZE + SIZE, dtype=numpy.uint8)
        there = data[start : start + size + SIZE - 1]
        held[: len(there)] = there
        grams = numpy.empty(len(held) - SIZE, dtype="<u8")
        for k in range(SIZE):
            grams[k::SIZE] = held[k : len(grams) + k].view("<u8")
        self.grams = grams[:size]

    def of_size(self, size, chosen=None):
        """(rows, places in their text, fragments) of those that end within their
        text and, if there is a filter, pass it."""
        grams = self.grams & numpy.uint64((1 << (8 * size)) - 1) if size < SIZE else self.grams
        if chosen is not None:
            hits = chosen.at(grams, size)
            grams = grams[hits]
        else:
            hits = numpy.arange(len(grams))
        places = hits + self.start
        # Of several texts that start there, the last one is not empty.
        rows = numpy.searchsorted(self.offsets, places, side="right") - 1
        ends = self.offsets[rows + 1] - places >= size
        rows = rows[ends]
        return rows, places[ends] - self.offsets[rows], grams[ends]


def _pieces(column):
    data, offsets = _bytes(column)
    for start in range(0, len(data), PIECE):
        yield data, offsets, Piece(data, offsets, start)


def pattern_grams(batches):
    """For ``mapInArrow``: from ``(row, pattern)`` to ``(row, size, offset, gram)`` of
    every fragment of a pattern."""
    for batch in batches:
        names = batch.column("row")
        for _, offsets, piece in _pieces(batch.column("pattern")):
            lengths = numpy.minimum(numpy.diff(offsets), SIZE)
            for size in numpy.unique(lengths[lengths > 0]).tolist():
                rows, at, grams = piece.of_size(size)
                mine = lengths[rows] == size
                rows, at, grams = rows[mine], at[mine], grams[mine].view(numpy.int64)
                sizes = pa.array(numpy.full(len(rows), size, numpy.int32))
                yield pa.RecordBatch.from_arrays(
                    [names.take(pa.array(rows)), sizes, pa.array(at), pa.array(grams)],
                    ["row", "size", "offset", "gram"],
                )


def gram_counter(shared):
    """A function for ``mapInArrow``: from ``text`` to ``(gram, n)``, how often
    fragments of SIZE bytes that pass the filter stand in a piece."""

    def count(batches):
        chosen = shared.value
        for batch in batches:
            for _, _, piece in _pieces(batch.column("text")):
                *_, grams = piece.of_size(SIZE, chosen)
                grams, n = numpy.unique(grams, return_counts=True)
                columns = [pa.array(grams.view(numpy.int64)), pa.array(n.astype(numpy.int64))]
                yield pa.RecordBatch.from_arrays(columns, ["gram", "n"])

    return count


def gram_finder(shared, keys):
    """A function for ``mapInArrow``: from ``keys`` and ``text`` to the fragments that
    pass the filter: ``(<keys>, size, gram, at, anywhere, whole)``.

    One of SIZE bytes is a row per place ``at`` (in bytes); shorter ones, which are
    whole patterns, are counted per text and piece: in all, and as whole words.
    """

    def find(batches):
        chosen = shared.value
        for batch in batches:
            for data, offsets, piece in _pieces(batch.column("text")):
                for size in chosen.sizes:
                    rows, at, grams = piece.of_size(size, chosen)
                    grams = grams.view(numpy.int64)
                    if size == SIZE:
                        ones = numpy.ones(len(rows), numpy.int64)
                        columns = rows, grams, at, ones, ones
                    else:
                        columns = _summed(data, offsets, rows, grams, at, size)
                    yield from _batches(batch, keys, size, columns)

    return find


def _summed(data, offsets, rows, grams, at, size):
    if not len(rows):
        return rows, grams, at, at, at
    start = offsets[rows] + at
    stop = start + size
    before = (at > 0) & _WORD[data[numpy.maximum(start - 1, 0)]]
    after = (stop < offsets[rows + 1]) & _WORD[data[numpy.minimum(stop, len(data) - 1)]]
    order = numpy.lexsort((grams, rows))
    rows, grams, whole = rows[order], grams[order], ~(before | after)[order]
    fresh = numpy.append(True, (numpy.diff(rows) != 0) | (numpy.diff(grams) != 0))
    first = numpy.flatnonzero(fresh)
    n = numpy.diff(numpy.append(first, len(rows)))
    total = numpy.add.reduceat(whole.astype(numpy.int64), first)
    return rows[first], grams[first], numpy.zeros(len(first), numpy.int64), n, total


def _batches(batch, keys, size, columns):
    for k in range(0, len(columns[0]), OUTPUT_ROWS):
        rows, *rest = (c[k : k + OUTPUT_ROWS] for c in columns)
        kept = batch.select(list(keys)).take(pa.array(rows))
        sizes = pa.array(numpy.full(len(rows), size, numpy.int32))
        gram, *counts = (pa.array(c.astype(numpy.int64, copy=False)) for c in rest)
        yield pa.RecordBatch.from_arrays(
            [*kept.columns, sizes, gram, *counts],
            [*keys, "size", "gram", "at", "anywhere", "whole"],
        )
