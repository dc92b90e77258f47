"""Rows of an Arrow file without the rest of it.

Opening a record batch reads all of it.  Its buffers, though, lie where the metadata
in front of it says: of text, offsets and then bytes.  So a range of rows is a slice of
the offsets and what they enclose, and sizes are differences of offsets alone.
"""

import struct

import numpy
import pyarrow as pa

# The format of files.  The end is a length and a name; a footer lists the
# blocks of batches, a message precedes each; numbers of the fields used.
_END = "<i6s"
_NAME = b"ARROW1"
_BLOCK = "<qi4xq"
_BATCHES = 3  # of a footer
_HEADER = 2  # of a message
_LENGTH, _NODES, _BUFFERS, _COMPRESSION = range(4)  # of a record batch
_PER_COLUMN = 3  # validity, offsets, bytes


class _Record:
    """A record of the metadata, read by the numbers of its fields."""

    def __init__(self, data, at=None):
        self.data = data
        self.at = self._number("<I", 0) if at is None else at

    def _number(self, kind, at):
        return struct.unpack_from(kind, self.data, at)[0]

    def _place(self, field):
        table = self.at - self._number("<i", self.at)
        slot = 4 + 2 * field
        if slot >= self._number("<H", table):
            return None
        return self.at + step if (step := self._number("<H", table + slot)) else None

    def has(self, field):
        return self._place(field) is not None

    def long(self, field):
        place = self._place(field)
        return 0 if place is None else self._number("<q", place)

    def record(self, field):
        place = self._place(field)
        return _Record(self.data, place + self._number("<I", place))

    def pairs(self, field):
        """A vector of pairs of longs."""
        start, count = self.vector(field)
        return [struct.unpack_from("<qq", self.data, start + 16 * k) for k in range(count)]

    def vector(self, field):
        place = self._place(field)
        if place is None:
            return 0, 0
        place += self._number("<I", place)
        return place + 4, self._number("<I", place)


class TextBatch:
    """The first record batch of an open file of text columns."""

    def __init__(self, source, schema):
        self.source, self.names, self.types = source, schema.names, schema.types
        end = source.size() - struct.calcsize(_END)
        length, name = struct.unpack(_END, self._read(end, struct.calcsize(_END)))
        if name != _NAME:
            raise ValueError("not an Arrow file")
        footer = _Record(self._read(end - length, length))
        first, count = footer.vector(_BATCHES)
        self.rows, self._buffers, self.plain = 0, [], True
        if count:
            offset, size, _ = struct.unpack_from(_BLOCK, footer.data, first)
            message = self._read(offset, size)
            skip = 8 if message[:4] == b"\xff\xff\xff\xff" else 4
            batch = _Record(message[skip:]).record(_HEADER)
            self.rows = batch.long(_LENGTH)
            self._buffers = [(offset + size + at, n) for at, n in batch.pairs(_BUFFERS)]
            nulls = any(missing for _, missing in batch.pairs(_NODES))
            flat = all(t in (pa.string(), pa.binary()) for t in self.types)
            # Anything else is for whoever reads whole batches.
            self.plain = flat and not nulls and not batch.has(_COMPRESSION)

    def _read(self, at, size):
        self.source.seek(at)
        return self.source.read(size)

    def offsets(self, name, start, stop):
        """Of rows ``start`` to ``stop``, and where the last one ends."""
        at, _ = self._buffers[_PER_COLUMN * self.names.index(name) + 1]
        return numpy.frombuffer(self._read(at + 4 * start, 4 * (stop - start + 1)), dtype="<i4")

    def column(self, name, offsets):
        """The rows that ``offsets`` enclose."""
        number = self.names.index(name)
        at, _ = self._buffers[_PER_COLUMN * number + 2]
        self.source.seek(at + int(offsets[0]))
        size = int(offsets[-1] - offsets[0])
        data = self.source.read_buffer(size) if size else pa.py_buffer(b"")
        from_zero = pa.py_buffer(numpy.ascontiguousarray(offsets - offsets[0]))
        buffers = [None, from_zero, data]
        return pa.Array.from_buffers(self.types[number], len(offsets) - 1, buffers)


def pieces(offsets, most):
    """Pairs (from, to) of runs of rows of at most ``most`` bytes, or one row."""
    start, last = 0, len(offsets) - 1
    while start < last:
        stop = int(numpy.searchsorted(offsets, int(offsets[start]) + most, "right")) - 1
        stop = min(max(stop, start + 1), last)
        yield start, stop
        start = stop
