"""Counting many patterns in one walk over each text.

Built-in expressions look for one pattern at a time, so their time grows with
the number of patterns.  An Aho-Corasick automaton does not care how many there
are; it runs on Arrow batches inside ``mapInArrow``.
"""

from collections import defaultdict
from typing import NamedTuple

import ahocorasick
import pyarrow as pa

# Fixed value: the word characters, as in `match`.
_WORD = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789_")

# Rows of one output batch, and input rows whose totals are added up before they
# go on.  Both bound what a task holds, whatever the number of queries found.
OUTPUT_ROWS = 16_384


class Wanted(NamedTuple):
    pattern: str
    whole_words: bool
    min_matches: int
    wiki: str


class Walk:
    """The automaton of a batch of queries, applied to one text at a time."""

    def __init__(self, wanted):
        self.wanted = wanted
        by_pattern = defaultdict(lambda: ([], []))
        for index, query in enumerate(wanted):
            by_pattern[query.pattern][query.whole_words].append(index)
        self.automaton = ahocorasick.Automaton()
        for pattern, (anywhere, whole) in by_pattern.items():
            self.automaton.add_word(pattern, (len(pattern), anywhere, whole))
        self.automaton.make_automaton()
        self.always = defaultdict(list)  # queries without a minimum, by language
        for index, query in enumerate(wanted):
            if query.min_matches == 0:
                self.always[query.wiki].append(index)

    def occurrences(self, text, wiki=None):
        """{query: count} of those that occur; a null text has none.  ``wiki``
        is the text's language; without one every query is asked."""
        counts, text = defaultdict(int), text or ""
        last = len(text) - 1
        for end, (size, anywhere, whole) in self.automaton.iter(text):
            for index in anywhere:
                counts[index] += 1
            if whole:
                start = end - size
                if (start < 0 or text[start] not in _WORD) and (
                    end == last or text[end + 1] not in _WORD
                ):
                    for index in whole:
                        counts[index] += 1
        if wiki is not None:
            return {i: n for i, n in counts.items() if self.wanted[i].wiki == wiki}
        return counts

    def without_minimum(self, wiki=None):
        if wiki is not None:
            return self.always.get(wiki, [])
        return [i for indices in self.always.values() for i in indices]


def _texts(batch, spoken):
    """Pairs of text and language; no language where the corpus has no column."""
    languages = batch.column("wiki").to_pylist() if spoken else [None] * batch.num_rows
    # A page of null language is asked by no query; none is called "".
    return ((t.as_py(), ("" if spoken and w is None else w)) for t, w in zip(batch.column("text"), languages))


def pair_counter(shared, ids, keys, spoken):
    """A function for ``mapInArrow``: from ``keys``, ``text`` (and ``wiki`` if
    ``spoken``) to a row ``(query_id, min_matches, <keys>, count)`` per text and
    query that occurs in it, or has no minimum.

    ``shared`` is a broadcast list of Wanted, ``ids`` of their ids.
    """

    def count(batches):
        walk = Walk(shared.value)
        names = pa.array(ids.value)
        minima = pa.array([q.min_matches for q in walk.wanted], pa.int64())
        for batch in batches:
            rows, found, counts = [], [], []

            def piece():
                kept = batch.select(list(keys)).take(pa.array(rows, pa.int64()))
                index = pa.array(found, pa.int32())
                return pa.RecordBatch.from_arrays(
                    [names.take(index), minima.take(index), *kept.columns, pa.array(counts, pa.int64())],
                    names=["query_id", "min_matches", *keys, "count"],
                )

            for row, (text, wiki) in enumerate(_texts(batch, spoken)):
                counted = dict.fromkeys(walk.without_minimum(wiki), 0)
                counted.update(walk.occurrences(text, wiki))
                for index, n in counted.items():
                    rows.append(row)
                    found.append(index)
                    counts.append(n)
                    if len(rows) == OUTPUT_ROWS:
                        yield piece()
                        rows, found, counts = [], [], []
            if rows:
                yield piece()

    return count


def total_counter(shared, ids, spoken):
    """A function for ``mapInArrow``: from ``seq``, ``title``, ``text`` (and
    ``wiki``) to totals per query and input batch: ``(query_id, words, pages,
    most, seq, title)``, the last two of the page with most occurrences."""

    def total(batches):
        walk = Walk(shared.value)
        names = pa.array(ids.value)
        for batch in batches:
            totals, pages = {}, defaultdict(int)
            seqs, titles = batch.column("seq").to_pylist(), batch.column("title").to_pylist()
            for row, (text, wiki) in enumerate(_texts(batch, spoken)):
                pages[wiki] += 1
                for index, n in walk.occurrences(text, wiki).items():
                    least = walk.wanted[index].min_matches
                    words, hits, most, seq, title = totals.get(index, (0, 0, 0, None, None))
                    if (n, seqs[row]) > (most, seq):
                        most, seq, title = n, seqs[row], titles[row]
                    totals[index] = words + n, hits + (0 < least <= n), most, seq, title
            for wiki, n in pages.items():  # without a minimum every page counts
                for index in walk.without_minimum(wiki):
                    words, hits, *best = totals.get(index, (0, 0, 0, None, None))
                    totals[index] = words, hits + n, *best
            columns = list(zip(*totals.values())) or [[]] * 5
            kinds = [pa.int64()] * 4 + [pa.string()]
            yield pa.RecordBatch.from_arrays(
                [names.take(pa.array(list(totals), pa.int32())), *(pa.array(c, k) for c, k in zip(columns, kinds))],
                names=["query_id", "words", "pages", "most", "seq", "title"],
            )

    return total
