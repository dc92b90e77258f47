"""Sets of word shingles as sorted arrays of 64-bit hashes, and their sketches."""

import functools

import numpy

WORDS = 5

_U = numpy.uint64


def mixed(x):
    """A bijection of 64-bit numbers that scatters them (splitmix64's last step)."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def numbers(seed, count):
    """``count`` fixed pseudo-random odd 64-bit numbers."""
    steps = numpy.arange(1, count + 1, dtype=_U) + _U(seed << 32)
    return mixed(steps * _U(0x9E3779B97F4A7C15)) | _U(1)


_SPACE = numpy.zeros(256, dtype=bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_BYTE = numpy.where(_SPACE, _U(0), numbers(1, 256))
_PLACE = numbers(2, WORDS)


@functools.lru_cache(maxsize=8)
def _powers(size):
    return numpy.cumprod(numpy.full(size, _U(0x9E3779B97F4A7C15)))


def word_hashes(text):
    """A hash of each word, white space (ASCII) apart, A-Z as a-z."""
    raw = numpy.frombuffer(text.encode().lower(), dtype=numpy.uint8)
    inside = numpy.zeros(len(raw) + 1, dtype=numpy.int8)
    inside[1:] = ~_SPACE[raw]
    starts = numpy.flatnonzero(numpy.diff(inside) == 1)
    if not len(starts):
        return numpy.zeros(0, dtype=_U)
    spans = numpy.diff(starts, append=len(raw))
    place = numpy.arange(starts[0], len(raw)) - numpy.repeat(starts, spans)
    size = 1 << int(spans.max()).bit_length()
    values = _BYTE[raw[starts[0] :]] * _powers(size)[place]
    return mixed(numpy.add.reduceat(values, starts - starts[0]))


def shingle_set(text, width=WORDS):
    """Sorted distinct hashes of runs of ``width`` words; with fewer words, the
    one of them all; without words, none."""
    words = word_hashes(text or "")
    n = min(width, len(words))
    if n == 0:
        return words
    count = len(words) - n + 1
    total = numpy.full(count, n, dtype=_U)
    for k in range(n):
        total += words[k : k + count] * _PLACE[k]
    return numpy.unique(mixed(total))


def minhashes(values, seeds, chunk=8192):
    """The minimum of each seed's hash over a set that is not empty."""
    least = None
    for start in range(0, len(values), chunk):
        x = (values[start : start + chunk, None] ^ seeds[None, :]) * seeds[None, :]
        x = ((x ^ (x >> _U(32))) * _U(0xD6E8FEB86659FD93)).min(axis=0)
        least = x if least is None else numpy.minimum(least, x)
    return least


def overlaps(left, right, chunk=4096):
    """Sizes of the intersections of sets in two lists, as a matrix."""
    vocabulary, counts = numpy.unique(
        numpy.concatenate([*left, *right, numpy.zeros(0, _U)]), return_counts=True
    )
    vocabulary = vocabulary[counts > 1]
    result = numpy.zeros((len(left), len(right)), dtype=numpy.int64)
    if not len(vocabulary):
        return result

    def places(sets):
        rows, columns = [], []
        for row, values in enumerate(sets):
            at = numpy.searchsorted(vocabulary, values)
            at[at == len(vocabulary)] = 0
            at = at[vocabulary[at] == values]
            rows.append(numpy.full(len(at), row))
            columns.append(at)
        rows, columns = numpy.concatenate(rows), numpy.concatenate(columns)
        order = numpy.argsort(columns, kind="stable")
        return rows[order], columns[order]

    sides = [places(left), places(right)]
    for start in range(0, len(vocabulary), chunk):
        parts = []
        for (rows, columns), sets in zip(sides, (left, right)):
            low, high = numpy.searchsorted(columns, [start, start + chunk])
            part = numpy.zeros((len(sets), chunk), dtype=numpy.float32)
            part[rows[low:high], columns[low:high] - start] = 1
            parts.append(part)
        result += (parts[0] @ parts[1].T).astype(numpy.int64)
    return result


def linked(left, right, percent):
    """Whether 100 * intersection >= percent * union, for all pairs of two lists."""
    both = overlaps(left, right)
    sizes = [numpy.array([len(s) for s in side], dtype=numpy.int64) for side in (left, right)]
    union = sizes[0][:, None] + sizes[1][None, :] - both
    return 100 * both >= percent * union


class Forest:
    """Union-find over 0..n-1; the root of a tree is its smallest member."""

    def __init__(self, n):
        self.up = list(range(n))

    def root(self, x):
        while self.up[x] != x:
            self.up[x] = x = self.up[self.up[x]]
        return x

    def join(self, x, y):
        x, y = self.root(x), self.root(y)
        if x != y:
            self.up[max(x, y)] = min(x, y)
        return x != y
