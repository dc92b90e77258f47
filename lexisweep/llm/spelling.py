"""Spelling variants: words one edit apart, found by scanning the sorted vocabulary.

Against one word, a scan of a sorted list computes a row of the edit matrix for each
character it passes.  Words that share a prefix share its rows, so a word takes up
from the rows of what it has in common with the word before (their longest common
prefix), and where the row of a shared prefix has no entry of one or less, all words
with that prefix are skipped.  One edit keeps to a band of three entries.

Here many words are looked up at once, level by level: an item is a word, a range of
the list that shares a prefix, and the band's row there.

Two words one edit apart share the first half of the longer one, or else its second
half.  So the list is scanned twice, sorted by the words and by the reversed words, and
only below the half that a word must share.  The list is cut in blocks of bounded size;
a word visits the other blocks that its half reaches and that their own shared prefix
does not rule out.
"""

import bisect
import math
import os
import string

import numpy
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexisweep.staging import staged

# The letters of a run; one run in ERROR loses a character.
RUN = "[A-Za-zÀ-ÿ]"
ERROR = 31

LEAST_LENGTH = 7
LEAST_COUNT = 2

# Times a word's own count from which on the near word is its form.
RATIO = 10

# Bytes of words in a block, on average, and words looked up at once.
BLOCK_BYTES = 1 << 20
LOOKUPS = 8192

# Visitors of a slice of a block, in multiples of the words of an average block.
SLICE = 4

# Depth from which on a range of one word is compared directly.
DEEP = 32

_LAST = "\U0010ffff"


def vocabulary(docs: DataFrame, least_length=LEAST_LENGTH, least_count=LEAST_COUNT) -> DataFrame:
    """(word, n) of the words of all texts: runs of letters, A-Z as a-z, with an error
    planted in about one of ERROR by the hash of document and run."""
    runs = docs.select(
        F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("doc"),
        F.explode(
            F.regexp_extract_all("text", F.lit(f"{RUN}{{{least_length},}}"), F.lit(0))
        ).alias("run"),
    )
    lower = F.translate("run", string.ascii_uppercase, string.ascii_lowercase)
    runs = runs.withColumn("run", F.when(F.col("run").rlike("[A-Z]"), lower).otherwise(F.col("run")))
    hashed = runs.withColumn("hash", F.crc32(F.concat_ws(":", "doc", "run").cast("binary")))
    place = (F.col("hash") % F.char_length("run")).cast("int")
    cut = F.concat(
        F.col("run").substr(F.lit(1), place), F.col("run").substr(place + 2, F.char_length("run"))
    )
    word = F.when(F.col("hash") % ERROR == 0, cut).otherwise(F.col("run"))
    counts = hashed.select(word.alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("n"))
    fits = (F.char_length("word") >= least_length) & (F.col("n") >= least_count)
    return counts.filter(fits)


class SortedWords:
    """A sorted list of distinct words as one array of code points, a zero after each."""

    def __init__(self, words):
        self.words = words
        self.codes, self.starts, self.sizes = _codes(words)
        self.shared = self._shared()
        self._heads = {}

    def _shared(self):
        """The length of the longest common prefix of each word and the one before."""
        shared = numpy.zeros(len(self.words), dtype=numpy.int32)
        open_, depth = numpy.arange(1, len(self.words)), 0
        while len(open_):
            one = self.codes[self.starts[open_ - 1] + depth]
            other = self.codes[self.starts[open_] + depth]
            open_ = open_[(one == other) & (one != 0)]
            depth += 1
            shared[open_] = depth
        return shared

    def _at(self, depth):
        """Where words begin that differ from the one before within ``depth`` + 1."""
        return numpy.flatnonzero(self.shared <= depth)

    def lookup(self, queries):
        """Arrays (query, word) of the pairs one edit apart that share at least half
        (rounded down) of the query."""
        codes, starts, sizes = _codes(queries)
        halves, low, high = sizes // 2, [], []
        for query, half in zip(queries, halves.tolist()):
            low.append(bisect.bisect_left(self.words, query[:half]))
            high.append(bisect.bisect_left(self.words, query[:half] + _LAST, low[-1]))
        low, high = numpy.array(low, dtype=numpy.int64), numpy.array(high, dtype=numpy.int64)
        order = numpy.argsort(halves, kind="stable")
        order = order[high[order] > low[order]]
        items = [numpy.zeros(0, dtype=numpy.int64)] * 6  # query, range, row of three
        found, depth, entered = [], 0, 0
        while entered < len(order) or len(items[0]):
            if not len(items[0]):
                depth = int(halves[order[entered]])
            until = entered + int(numpy.searchsorted(halves[order[entered:]], depth, "right"))
            new = order[entered:until]
            entered = until
            ones = numpy.ones(len(new), dtype=numpy.int64)
            fresh = (new, low[new], high[new], ones, ones * 0, ones)
            items = [numpy.concatenate(pair) for pair in zip(items, fresh)]
            if depth >= DEEP:
                alone = items[2] - items[1] == 1
                for query, word in zip(items[0][alone].tolist(), items[1][alone].tolist()):
                    if one_edit(queries[query], self.words[word]):
                        found.append(([query], [word]))
                items = [x[~alone] for x in items]
            items, ends = self._step(items, depth, codes, starts, sizes)
            found.append(ends)
            depth += 1
        if not found:
            return numpy.zeros(0, dtype=numpy.int64), numpy.zeros(0, dtype=numpy.int64)
        return tuple(numpy.concatenate(x).astype(numpy.int64) for x in zip(*found))

    def _step(self, items, depth, codes, starts, sizes):
        """From the rows after ``depth`` characters to the next; also the pairs whose
        word ends here."""
        query, low, high, left, mid, right = items
        heads = self._at(depth) if len(query) else numpy.zeros(0, dtype=numpy.int64)
        first, last = numpy.searchsorted(heads, low), numpy.searchsorted(heads, high)
        count = last - first
        item = numpy.repeat(numpy.arange(len(query)), count)
        place = numpy.arange(len(item)) - numpy.repeat(numpy.cumsum(count) - count, count)
        head = first[item] + place
        begin = heads[head]
        stop = high[item]
        inner = head + 1 < last[item]
        stop[inner] = heads[head[inner] + 1]
        query, left, mid, right = query[item], left[item], mid[item], right[item]
        size = sizes[query]
        letter = self.codes[self.starts[begin] + depth]

        ended = letter == 0
        over = size - depth  # characters of the query beyond the word's
        distance = numpy.select([over == -1, over == 0, over == 1], [left, mid, right], 2)
        near = ended & (distance == 1)

        def differs(offset):
            at = numpy.minimum(depth + offset, size)
            return codes[starts[query] + numpy.maximum(at, 0)] != letter

        one = numpy.minimum(mid + 1, left + differs(-1))
        two = numpy.minimum(numpy.minimum(right + 1, mid + differs(0)), one + 1)
        three = numpy.minimum(right + differs(1), two + 1)
        one = numpy.where(depth > size, 2, one)
        two = numpy.where(depth + 1 > size, 2, two)
        three = numpy.where(depth + 2 > size, 2, three)
        go = ~ended & (numpy.minimum(numpy.minimum(one, two), three) <= 1)
        rows = [query[go], begin[go], stop[go], one[go], two[go], three[go]]
        return rows, (query[near], begin[near])


def _codes(words):
    joined = "".join(w + "\0" for w in words)
    codes = numpy.frombuffer(joined.encode("utf-32-le"), dtype=numpy.uint32)
    sizes = numpy.fromiter(map(len, words), dtype=numpy.int64, count=len(words))
    return codes, numpy.cumsum(sizes + 1) - sizes - 1, sizes


def one_edit(a, b):
    """Whether exactly one inserted, deleted or replaced code point parts two words."""
    if abs(len(a) - len(b)) > 1 or a == b:
        return False
    same = len(os.path.commonprefix((a, b)))
    return a[same + (len(a) >= len(b)) :] == b[same + (len(b) >= len(a)) :]


def may_hold(query, prefix):
    """Whether words with ``prefix`` can be one edit from the query: the band's row
    after the prefix has an entry of one or less."""
    row = {0: 0, 1: 1}
    for depth, letter in enumerate(prefix, 1):
        new = {}
        for j in range(max(depth - 1, 0), min(depth + 1, len(query)) + 1):
            value = row.get(j, 2) + 1
            if j:
                value = min(value, row.get(j - 1, 2) + (query[j - 1] != letter), new.get(j - 1, 2) + 1)
            new[j] = value
        row = new
        if min(row.values(), default=2) > 1:
            return False
    return True


def _nearest(keyed, blocks, backwards):
    """(word, n_near, most, nearest) of the words with near words in one direction:
    pairs that share the first half of the longer word, or backwards all others.

    ``keyed``: (key, n), the words, or the reversed words if ``backwards``.
    """
    # Blocks hold about as many words each; words are distinct, so no key is hot.
    dealt = keyed.repartitionByRange(blocks, "key").sortWithinPartitions("key")
    own = staged(dealt.withColumn("block", F.spark_partition_id()), "blocks")
    ends = own.groupBy("block").agg(F.min("key").alias("low"), F.max("key").alias("high"))
    ends = sorted(tuple(row) for row in ends.collect())  # a row per block
    lows, highs = [low for _, low, _ in ends], [high for _, _, high in ends]

    visit_schema = pa.schema(
        [("block", pa.int32()), ("key", pa.string()), ("n", pa.int64()), ("visits", pa.bool_())]
    )

    def visit(batches):
        for batch in batches:
            columns = {name: [] for name in ("block", "key", "n", "visits")}
            rows = zip(*(batch.column(x).to_pylist() for x in ("block", "key", "n")))
            for block, key, n in rows:
                half = key[: len(key) // 2]
                first = bisect.bisect_left(highs, half)
                last = bisect.bisect_right(lows, half + _LAST)
                for number, low, high in [(block, "", ""), *ends[first:last]]:
                    own_block = not high
                    if not own_block:
                        shared = os.path.commonprefix((low, high))
                        if number == block or not may_hold(key, shared):
                            continue
                    for name, value in zip(columns, (number, key, n, not own_block)):
                        columns[name].append(value)
            yield pa.RecordBatch.from_pydict(columns, visit_schema)

    schema = "block int, key string, n bigint, visits boolean"
    visits = staged(own.select("block", "key", "n").mapInArrow(visit, schema), "visits")
    # A block that many visit is met in slices, each with all words of the block.
    average = own.count() // blocks + 1
    slices = visits.groupBy("block").agg(
        (1 + F.sum(F.col("visits").cast("int")) / (SLICE * average)).cast("int").alias("slices")
    )
    met = visits.join(F.broadcast(slices), "block")  # a row per block
    every = F.explode(F.sequence(F.lit(0), F.col("slices") - 1)).alias("slice")
    one = F.pmod(F.xxhash64("key"), "slices").cast("int").alias("slice")
    theirs = met.filter("visits").select("block", "key", "n", "visits", one)
    ours = met.filter("not visits").select("block", "key", "n", "visits", every)

    near_schema = pa.schema(
        [("word", pa.string()), ("n_near", pa.int64()), ("most", pa.int64()), ("nearest", pa.string())]
    )

    def scan(table):
        rows = list(zip(*(table.column(x).to_pylist() for x in ("visits", "key", "n"))))
        ours_here = sorted((key, n) for visits, key, n in rows if not visits)
        words, n_of = SortedWords([key for key, _ in ours_here]), [n for _, n in ours_here]
        queries = [key for visits, key, _ in rows if visits]
        if table.column("slice")[0].as_py() == 0:  # looks up the block's own words too
            queries += words.words
        best, tally = {}, {}
        for start in range(0, len(queries), LOOKUPS):
            some = queries[start : start + LOOKUPS]
            for query, near in zip(*(x.tolist() for x in words.lookup(some))):
                one, two = some[query], words.words[near]
                half = max(len(one), len(two)) // 2
                first_half = one[-half:] == two[-half:] if backwards else one[:half] == two[:half]
                if first_half != backwards:
                    tally[one] = tally.get(one, 0) + 1
                    word = two[::-1] if backwards else two
                    best[one] = min(best.get(one, (0, "")), (-n_of[near], word))
        return pa.table(
            {
                "word": [w[::-1] if backwards else w for w in tally],
                "n_near": pa.array(list(tally.values()), pa.int64()),
                "most": pa.array([-best[w][0] for w in tally], pa.int64()),
                "nearest": [best[w][1] for w in tally],
            },
            near_schema,
        )

    return ours.union(theirs).groupBy("block", "slice").applyInArrow(
        scan, "word string, n_near bigint, most bigint, nearest string"
    )


def near_words(words: DataFrame) -> DataFrame:
    """(word, n, n_near, most, nearest) of every row of ``words`` (word, n; distinct
    words, staged): how many are one edit apart, and of those the one of largest n
    (ties: smallest) with its n, null if there is none."""
    spark = words.sparkSession
    total = words.agg(F.sum(F.octet_length("word"))).first()[0] or 0
    blocks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 1 + total // BLOCK_BYTES)
    forwards = _nearest(words.select(F.col("word").alias("key"), "n"), blocks, False)
    backwards = _nearest(words.select(F.reverse("word").alias("key"), "n"), blocks, True)
    best = F.min(F.struct((-F.col("most")).alias("less"), "nearest"))
    found = (
        forwards.union(backwards)
        .groupBy("word")
        .agg(F.sum("n_near").alias("n_near"), best.alias("best"))
        .select("word", "n_near", (-F.col("best.less")).alias("most"), "best.nearest")
    )
    return words.join(found, "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0).cast("bigint")).alias("n_near"), "most", "nearest"
    )


def variants(docs: DataFrame, least_length=LEAST_LENGTH, least_count=LEAST_COUNT) -> DataFrame:
    """(word, form, root, n, n_near, form_n) of every word of the vocabulary.

    ``form`` is a word's near word of largest n, if that is RATIO times its own or
    more; ``root`` is where following forms ends.  A null text has no words, a null
    ``doc_id`` counts as an empty one.  Repeated rows count each.  Ties go to the
    smallest word.  An empty table gives an empty one.  Texts and words may be of any
    length.  Only ``doc_id`` and ``text`` are read.
    """
    words = staged(vocabulary(docs, least_length, least_count), "vocabulary")
    is_form = F.col("most") >= RATIO * F.col("n")
    facts = near_words(words).select(
        "word",
        F.when(is_form, F.col("nearest")).alias("form"),
        "n",
        "n_near",
        F.when(is_form, F.col("most")).alias("form_n"),
    )
    facts = staged(facts, "forms")
    # Counts grow by RATIO at every step, so paths are short; a round doubles what
    # a word has followed.
    most = facts.agg(F.max("form_n")).first()[0] or 0
    steps = max(1, math.floor(math.log(max(most, 1) / least_count, RATIO)) + 1)
    links = facts.filter("form is not null").select("word", F.col("form").alias("root"))
    for _ in range(math.ceil(math.log2(steps))):
        onward = links.select(F.col("word").alias("root"), F.col("root").alias("next"))
        links = staged(
            links.join(onward, "root", "left").select("word", F.coalesce("next", "root").alias("root")),
            "roots",
        )
    return facts.join(links, "word", "left").select(
        "word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n"
    )
