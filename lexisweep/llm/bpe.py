"""Byte-level BPE as a monoid: halves are encoded apart and joined at the seam.

``encode`` splits a text in halves down to leaves and joins neighbours by
encoding a window around the seam anew.  The window grows until both its ends
are provably stable, so tokens outside it can be kept:

* Characters fall in four classes: letters, numbers, white space, the rest.  No
  match of the pattern covers a letter and a following non-letter, a number and
  a following non-number, a non-space and a following space, or a sign other
  than an apostrophe and a following letter or number.  Such a place ends a
  match whatever the text on either side, and the pattern looks ahead only at
  white space, so the text between two such places encodes alike everywhere.
* Inside one long match (a run of one class) the window grows token by token.
  Merges go by rank, so a token sequence is the encoding if and only if all its
  neighbouring pairs are; once the window's own encoding begins and ends with
  the tokens that were there before, every pair is one already seen.

``decode`` concatenates the tokens' bytes up the same tree.
"""

import base64
import functools

import pyarrow as pa
import regex
import tiktoken
from pyspark.sql import DataFrame

# Characters of a leaf, so that most documents have seams, and of the first window on
# either side of a seam.
LEAF = 512
WINDOW = 32

# Bytes of text whose ids a task holds at once; a longer text comes alone.
PART = 4 << 20

_STABLE = regex.compile(
    r"(?<=\S)(?=\s)|(?<=\p{L})(?=\P{L})|(?<=\p{N})(?=\P{N})"
    r"|(?<=[^\s\p{L}\p{N}'])(?=[\p{L}\p{N}])"
)


class Codec:
    """The ranks of one vocabulary file and the pattern that splits texts."""

    def __init__(self, path, pattern, leaf=LEAF):
        with open(path, "rb") as lines:
            pairs = (line.split() for line in lines)
            ranks = {base64.b64decode(token): int(rank) for token, rank in pairs}
        self.bpe = tiktoken.Encoding(
            "ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={}
        )
        self.bytes_of = {rank: token for token, rank in ranks.items()}
        self.pattern = regex.compile(pattern)
        self.leaf = leaf

    def encode(self, text):
        return self._encode(text, 0, len(text))

    def _encode(self, text, low, high):
        if high - low <= self.leaf:
            return self.bpe.encode_ordinary(text[low:high])
        middle = (low + high) // 2
        left = self._encode(text, low, middle)
        return self.join(text, low, middle, high, left, self._encode(text, middle, high))

    def join(self, text, low, middle, high, left, right):
        """Ids of ``text[low:high]`` from those of its two parts."""
        start, end = _before(text, low, middle), _after(text, middle, high)
        keep = len(left) - self._covering(reversed(left), text[start:middle])
        skip = self._covering(right, text[middle:end])
        if end - start > self.leaf:
            one = self.pattern.match(text, start, end)
            if one and one.end() == end:
                return left[:keep] + self._one_match(left[keep:], right[:skip]) + right[skip:]
        return left[:keep] + self.bpe.encode_ordinary(text[start:end]) + right[skip:]

    def _covering(self, ids, text):
        """How many of ``ids`` make up the bytes of ``text``."""
        left, count = len(text.encode()), 0
        for token in ids:
            if left <= 0:
                break
            left -= len(self.bytes_of[token])
            count += 1
        if left:
            raise AssertionError("a stable place lies inside a token")
        return count

    def _one_match(self, left, right):
        """Both parts lie in one match of the pattern; the window is of tokens."""
        width = 4
        while True:
            a, b = left[-width:], right[:width]
            piece = b"".join(self.bytes_of[token] for token in a + b)
            ids = self.bpe._encode_single_piece(piece)
            if (len(a) == len(left) or ids[0] == a[0]) and (
                len(b) == len(right) or ids[-1] == b[-1]
            ):
                return left[: len(left) - len(a)] + ids + right[len(b) :]
            width *= 2

    def decode(self, ids):
        return self._decode(ids, 0, len(ids))

    def _decode(self, ids, low, high):
        if high - low <= self.leaf:
            return b"".join(map(self.bytes_of.__getitem__, ids[low:high]))
        middle = (low + high) // 2
        return self._decode(ids, low, middle) + self._decode(ids, middle, high)


def _before(text, low, middle):
    """The last stable place in ``text[low:middle]``, or ``low``."""
    size = WINDOW
    while True:
        start = max(low, middle - size)
        # ``pos`` hides nothing from a lookbehind, so places begin after start.
        places = [m.start() for m in _STABLE.finditer(text, start, middle) if m.start() > start]
        if places or start == low:
            return places[-1] if places else low
        size *= 2


def _after(text, middle, high):
    """The first stable place in ``text[middle + 1:high]``, or ``high``."""
    size = WINDOW
    while True:
        end = min(high, middle + size)
        found = _STABLE.search(text, middle + 1, end)
        if found and found.start() < end:
            return found.start()
        if end == high:
            return high
        size *= 2


@functools.lru_cache(maxsize=4)
def codec(path, pattern) -> Codec:
    return Codec(path, pattern)


def round_trip(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """(doc_id, ids, decoded) of every row; only ``doc_id`` and ``text`` are read.

    ``ids`` are little-endian unsigned 32-bit integers, ``decoded`` the bytes they
    stand for.  A null text is an empty one; an empty text has no ids.  Rows are
    treated one by one, so repeated rows, ties and null ids need no rule; an empty
    table gives an empty one.  No row is shuffled: a text is one row of one task.
    """

    def code(batches):
        import numpy

        both = codec(path, pattern)
        for batch in batches:
            for part in _parts(batch):
                ids = [both.encode(t.as_py() or "") for t in part.column("text")]
                packed = [numpy.array(i, "<u4").tobytes() for i in ids]
                decoded = [both.decode(numpy.frombuffer(i, "<u4").tolist()) for i in packed]
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), pa.array(packed, pa.binary()), pa.array(decoded, pa.binary())],
                    ["doc_id", "ids", "decoded"],
                )

    schema = f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, ids binary, decoded binary"
    return docs.select("doc_id", "text").mapInArrow(code, schema)


def _parts(batch, most=PART):
    """A batch in slices of about ``most`` bytes of text, so that a task holds the
    ids of few texts at once."""
    import numpy
    import pyarrow.compute as pc

    sizes = pc.fill_null(pc.binary_length(batch.column("text")), 0).to_numpy(zero_copy_only=False)
    cuts = numpy.flatnonzero(numpy.diff(numpy.cumsum(sizes) // most)) + 1
    starts = [0, *cuts.tolist()]
    for start, stop in zip(starts, [*starts[1:], batch.num_rows]):
        if stop > start:
            yield batch.slice(start, stop - start)
