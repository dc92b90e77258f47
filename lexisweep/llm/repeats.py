"""Substring deduplication by sliding spans of sentences.

A text is a list of sentences.  From every sentence on, and up to every sentence,
the shortest run of at least SENTENCES sentences and MIN_WORDS words is a span,
so a repeated passage of that size is covered by spans that lie wholly inside it,
wherever it stands.  Spans are hashed and joined over the whole corpus; each has a
first occurrence (smallest doc_id, then place), and the sentences that any other
occurrence covers are removed.

The text is read twice: for the spans, and to cut it.  What moves in between are
hashes and places.
"""

import re

import numpy
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexisweep.llm.common import join_facts, text_digest
from lexisweep.llm.shingles import mixed, numbers
from lexisweep.staging import staged

# A span has at least so many sentences and words.
SENTENCES = 2
MIN_WORDS = 12

# A sentence ends at a stop followed by white space, or at a line's end.  One of
# more than LONG words is cut in parts of at most so many.
LONG = 25

# A part starts at a word whose hash (with the two words after it) is the least of
# so many words on both sides: where a sentence starts does not matter, so copies
# of a passage are cut alike but for its first and last few words.
NEAR = 3

_STOP = re.compile(r"(?<=[.!?])\s+|\s*\n\s*")
_WORD = re.compile(r"\S+")
_TIMES = int(numbers(5, 1)[0])
_MASK = (1 << 64) - 1


def part_starts(words):
    """Numbers of the words of a long sentence at which its parts start."""
    import xxhash

    one = xxhash.xxh3_64_intdigest
    keys = [one(" ".join(words[k : k + 3]).lower().encode()) for k in range(len(words) - 2)]
    found, k = [0], NEAR
    while k + NEAR < len(keys):
        ahead = keys[k : k + NEAR + 1]
        least = min(ahead)
        if ahead[0] != least:
            k += ahead.index(least)
        elif least < min(keys[k - NEAR : k]):
            found.append(k)
            k += NEAR + 1
        else:
            k += 1
    ends = [*found[1:], len(words)]
    return [k for start, end in zip(found, ends) for k in range(start, end, LONG)]


def sentences(text):
    """(start, words) of each sentence or part; it reaches to the next one's start."""
    found, start = [], 0
    ends = [m.end() for m in _STOP.finditer(text)]
    for end in [*ends, len(text)]:
        words = text[start:end].split()
        if len(words) > LONG:
            places = [start + m.start() for m in _WORD.finditer(text[start:end])]
            starts = part_starts(words)
            for k, to in zip(starts, [*starts[1:], len(words)]):
                found.append((start if k == 0 else places[k], words[k:to]))
        elif words:
            found.append((start, words))
        if words:
            start = end
    return found


def spans(text):
    """(hashes, starts, ends) of a text's spans; places in code points."""
    import xxhash

    found = sentences(text)
    n = len(found)
    counts = [len(words) for _, words in found]
    runs, end, total = set(), 0, 0
    for start in range(n):
        while end < n and (total < MIN_WORDS or end - start < SENTENCES):
            total += counts[end]
            end += 1
        if total >= MIN_WORDS and end - start >= SENTENCES:
            runs.add((start, end))
        total -= counts[start]
    start, total = n, 0
    for end in range(n, 0, -1):
        while start > 0 and (total < MIN_WORDS or end - start < SENTENCES):
            start -= 1
            total += counts[start]
        if total >= MIN_WORDS and end - start >= SENTENCES:
            runs.add((start, end))
        total -= counts[end - 1]
    if not runs:
        return numpy.zeros(0, numpy.int64), numpy.zeros(0, numpy.int32), numpy.zeros(0, numpy.int32)
    one = xxhash.xxh3_64_intdigest
    own = [one(" ".join(words).lower().encode()) for _, words in found]
    runs = numpy.array(sorted(runs))
    # Rolling sums: the hash of a run is a polynomial of its sentences' hashes.
    sums, powers, power = [0], [1], 1
    for value in own:
        sums.append((sums[-1] * _TIMES + value) & _MASK)
        power = power * _TIMES & _MASK
        powers.append(power)
    sums, powers = numpy.array(sums, numpy.uint64), numpy.array(powers, numpy.uint64)
    a, b = runs[:, 0], runs[:, 1]
    values = mixed(sums[b] - sums[a] * powers[b - a] + (b - a).astype(numpy.uint64))
    places = numpy.array([start for start, _ in found] + [len(text)], numpy.int32)
    return values.view(numpy.int64), places[a], places[b]


def _spanned(docs):
    """Staged (row, doc_id, digest, spans), one per row."""
    id_type = docs.schema["doc_id"].dataType.simpleString()
    schema = (
        f"doc_id {id_type}, digest binary, hash array<bigint>, start array<int>, end array<int>"
    )

    def find(batches):
        for batch in batches:
            columns = list(zip(*(spans(t.as_py() or "") for t in batch.column("text"))))
            kinds = [pa.int64(), pa.int32(), pa.int32()]
            arrays = [pa.array(c, pa.list_(k)) for c, k in zip(columns or [[], [], []], kinds)]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("digest"), *arrays],
                ["doc_id", "digest", "hash", "start", "end"],
            )

    rows = docs.select("doc_id", text_digest().alias("digest"), "text").mapInArrow(find, schema)
    return staged(rows.withColumn("row", F.monotonically_increasing_id()), "spans")


def repeated_places(docs: DataFrame) -> DataFrame:
    """(doc_id, digest, cuts) of rows with something to remove: sorted code point
    ranges, end exclusive, of all spans that are not first occurrences."""
    rows = _spanned(docs)
    each = rows.select(
        "row", "doc_id", F.inline(F.arrays_zip("hash", "start", "end"))
    )
    # A null id comes after all others.
    place = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "start")
    facts = (
        each.groupBy("hash")
        .agg(F.min(place).alias("first"), F.count(F.lit(1)).alias("n"))
        .filter("n > 1")
    )
    again = join_facts(each, staged(facts, "repeated"), "hash", "n").filter(
        F.col("first").isNotNull() & (place > F.col("first"))
    )
    cuts = again.groupBy("row").agg(
        F.array_sort(F.collect_set(F.struct("start", "end"))).alias("cuts")
    )
    return rows.select("row", "doc_id", "digest").join(cuts, "row").drop("row")


def _without(text, cuts):
    def cut(text, ranges):
        if text is None or ranges is None:
            return text
        kept, at = [], 0
        for r in ranges:
            if r["start"] > at:
                kept.append(text[at : r["start"]])
            at = max(at, r["end"])
        return "".join(kept) + text[at:]

    def without(texts: pa.Array, ranges: pa.Array) -> pa.Array:
        pairs = zip(texts, ranges)
        return pa.array((cut(t.as_py(), r.as_py()) for t, r in pairs), pa.string())

    return F.arrow_udf(without, "string")(text, cuts)


def remove_repeats(docs: DataFrame) -> DataFrame:
    """``docs`` with repeated sentences cut from ``text``, and ``cut_chars``.

    Rows and columns stay, but for a given ``cut_chars``, which is replaced; a null text stays null, an empty one empty, and a text
    all of which stands elsewhere first becomes empty.  Places of equal rows
    (same id, same text) are one occurrence, so repeated rows get the same result
    and do not empty each other; rows with a null id come last.  An empty table
    gives an empty one.
    """
    names = [n for n in docs.columns if n != "cut_chars"]
    cuts = repeated_places(docs).withColumnsRenamed({"doc_id": "__id", "digest": "__digest"})
    cuts = staged(cuts, "cuts").dropDuplicates(["__id", "__digest"])
    packed = docs.select(F.struct(*names).alias("__doc"), text_digest().alias("__own"))
    joined = packed.join(
        cuts,
        (F.col("__own") == F.col("__digest")) & F.col("__doc")["doc_id"].eqNullSafe(F.col("__id")),
        "left",
    )
    text = F.col("__doc")["text"]
    new = joined.withColumn("__text", _without(text, F.col("cuts")))
    return new.select(
        *((F.col("__text") if n == "text" else F.col("__doc")[n]).alias(n) for n in names),
        (F.char_length(text) - F.char_length("__text")).cast("bigint").alias("cut_chars"),
    )
