"""Ids of whole texts by a word-level tokenizer file, one word at a time.

The tokenizer drops white space, so the ids of a text are those of its words.
Each task keeps the ids of words it has met; the library sees only new words.
"""

import functools
import os
import re

import numpy

# Bytes of words and ids in either of the two generations that a worker keeps, for as
# long as it lives.  Fewer cost time: words are encoded again.
KEPT = 100 << 20

# What an entry takes beside its characters and ids.
_ENTRY = 200

# Characters that Python's str.split() takes for white space and
# the tokenizer does not.
_ODD = re.compile("[\x1c-\x1f]")
_TAIL = ".,;:!?"


class Words:
    def __init__(self, path, kept=KEPT):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True  # in a text they are plain text
        vocabulary = self.tokenizer.get_vocab()
        self.ends = numpy.zeros(max(vocabulary.values()) + 1, dtype=bool)
        for token, number in vocabulary.items():
            self.ends[number] = token.endswith("</w>")
        self.kept = kept
        self.known, self.older, self.size = {}, {}, 0

    def encode(self, text) -> bytes:
        """Ids as little-endian unsigned 32-bit integers."""
        if _ODD.search(text):
            return _packed(self.tokenizer.encode(text, add_special_tokens=False).ids)
        words = text.split()
        found = list(map(self.known.get, words))
        if None in found:
            self._recall({w for w, ids in zip(words, found) if ids is None})
            found = list(map(self.known.__getitem__, words))
            if self.size > self.kept:  # what is not met again before the next time goes
                self.known, self.older, self.size = {}, self.known, 0
        return b"".join(found)

    def _recall(self, words):
        """Words from the older generation, or else from the tokenizer."""
        older = {w: self.older[w] for w in words if w in self.older}
        self.known.update(older)
        if len(older) < len(words):
            self._look_up(words - older.keys())
        self.size += _ENTRY * len(words) + 2 * sum(map(len, words))

    def _look_up(self, words):
        """Letters followed by signs split between the two; letters alone are
        encoded many at a time."""
        known, letters, others, cut = self.known, set(), set(), {}
        for word in words:
            stem = word.rstrip(_TAIL)
            if stem.isalpha():
                if stem not in known:
                    letters.add(stem)
                if len(stem) < len(word):
                    tail = word[len(stem) :]
                    cut[word] = stem, tail
                    if tail not in known:
                        others.add(tail)
            else:
                others.add(word)
        letters = list(letters)
        ids = self.tokenizer.encode(" ".join(letters), add_special_tokens=False).ids
        ids = numpy.array(ids, dtype="<u4")
        stops = numpy.flatnonzero(self.ends[ids]) + 1
        if len(stops) == len(letters):  # each was one word to the tokenizer too
            start = 0
            for word, stop in zip(letters, stops.tolist()):
                known[word] = ids[start:stop].tobytes()
                start = stop
        else:
            others.update(letters)
        others = list(others)
        for word, encoding in zip(
            others, self.tokenizer.encode_batch_fast(others, add_special_tokens=False)
        ):
            known[word] = _packed(encoding.ids)
        for word, (stem, tail) in cut.items():
            known[word] = known[stem] + known[tail]


def _packed(ids):
    return numpy.array(ids, dtype="<u4").tobytes()


@functools.lru_cache(maxsize=2)
def words(path, kept=KEPT) -> Words:
    return Words(path, kept)
