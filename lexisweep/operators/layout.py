"""Contiguous partitioning of a corpus by bytes or by rows.

Both need the position of every row, and its bytes, in the whole scan order.  A
window over everything would run in one task, so positions are computed inside
blocks, contiguous ranges of ``seq``, and shifted by what lies before the block.
There are as many blocks as shuffle partitions, whatever the size of the data:
the per-block totals that pass through the driver are bounded by that setting.
"""

from dataclasses import dataclass
from itertools import accumulate

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexisweep.staging import staged

# Fixed value: number of chunks by default.
CHUNKS = 15

# Text per write task of a new layout.
PART_BYTES = 128 << 20

# Chunks that a layout can have: rows are placed by a literal table of their first
# positions, so an absurd number is refused.
MOST_CHUNKS = 1_000_000


@dataclass(frozen=True)
class ScanPositions:
    """``rows``: (block, seq, bytes, pos, start), ``start`` = bytes before."""

    rows: DataFrame
    n_rows: int
    n_bytes: int
    widest: int


@dataclass(frozen=True)
class ChunkLayout:
    """``rows``: (seq, bytes, start, chunk_id, closed), ``closed`` = chunks
    complete after the row."""

    rows: DataFrame
    n_chunks: int
    n_bytes: int


def scan_positions(corpus: DataFrame, blocks: int | None = None) -> ScanPositions:
    """Position and preceding bytes of every row in the order of ``seq``.

    Sizes come from a ``bytes`` column if the corpus has one, so that the text
    is not read at all.  Runs jobs over narrow (seq, bytes) tables.
    """
    spark = corpus.sparkSession
    blocks = blocks or int(spark.conf.get("spark.sql.shuffle.partitions"))
    stored = F.col("bytes") if "bytes" in corpus.columns else F.octet_length("text")
    # Range partitioning samples its input, so take the sizes off the corpus
    # first: it is scanned, or derived, once instead of twice.
    sizes = staged(corpus.select("seq", stored.cast("bigint").alias("bytes")), "sizes")
    table = staged(
        sizes.repartitionByRange(blocks, "seq").withColumn("block", F.spark_partition_id()),
        "blocks",
    )
    totals = (
        table.groupBy("block")
        .agg(
            F.count(F.lit(1)).alias("rows"),
            F.sum("bytes").alias("bytes"),
            F.max("bytes").alias("widest"),
        )
        .orderBy("block")
        .collect()  # at most `blocks` rows
    )
    rows_before = list(accumulate((t["rows"] for t in totals), initial=0))
    bytes_before = list(accumulate((t["bytes"] for t in totals), initial=0))
    offsets = spark.createDataFrame(
        [(t["block"], r, b) for t, r, b in zip(totals, rows_before, bytes_before)],
        "block int, rows_before bigint, bytes_before bigint",
    )
    pos = F.col("rows_before") + F.row_number().over(_by_seq()) - 1
    end = F.col("bytes_before") + F.sum("bytes").over(_up_to(0))
    rows = table.join(F.broadcast(offsets), "block").select(
        "block", "seq", "bytes", pos.alias("pos"), (end - F.col("bytes")).alias("start")
    )
    widest = max((t["widest"] for t in totals), default=0)
    return ScanPositions(rows, rows_before[-1], bytes_before[-1], widest)


def split_rows(positions: ScanPositions, n_slices: int) -> DataFrame:
    """(seq, chunk_id): contiguous slices, equal in rows to within one.

    Slice j starts at row floor(n * j / n_slices).
    """
    if n_slices < 1:
        raise ValueError("at least one slice is needed")
    scaled = F.lit(n_slices).cast("bigint") * (F.col("pos") + 1) - 1
    n = F.lit(max(positions.n_rows, 1)).cast("bigint")
    chunk = F.call_function("div", scaled, n).cast("int")
    return positions.rows.select("seq", chunk.alias("chunk_id"))


def rechunk_by_bytes(positions: ScanPositions, n_chunks: int = CHUNKS) -> ChunkLayout:
    """Contiguous chunks of about equal bytes.

    Threshold j lies at floor(total * (j + 1) / n_chunks) bytes.  A row closes
    the open chunk k if the bytes up to and with it reach threshold k, and
    closes no more than one.  So after row i the number of closed chunks is
    min(closed before + 1, reached(i)), where reached(i) counts the thresholds
    up to the end of row i; unrolled, it is
    i + min(1, min over l <= i of (reached(l) - l)): a running minimum, hence
    blockwise like the running sums.  When no row is wider than the gap between
    thresholds the limit of one never binds and closed = reached.
    """
    if n_chunks < 1:
        raise ValueError("at least one chunk is needed")
    total = positions.n_bytes
    end = F.col("start") + F.col("bytes")
    last = F.lit(n_chunks - 1).cast("bigint")
    if 0 < positions.widest <= total // n_chunks:
        rows = positions.rows
        before = _thresholds_reached(F.col("start"), total, n_chunks)
        closed = _thresholds_reached(end, total, n_chunks)
    else:
        spare = _thresholds_reached(end, total, n_chunks) - F.col("pos")
        rows = _with_least_before(positions.rows.withColumn("spare", spare))
        one = F.lit(1).cast("bigint")
        here = F.least(one, "least_before", F.min("spare").over(_up_to(0)))
        earlier = F.least(one, "least_before", F.min("spare").over(_up_to(-1)))
        closed = F.col("pos") + here
        before = F.when(F.col("pos") == 0, 0).otherwise(F.col("pos") - 1 + earlier)
    chunk = F.least(before.cast("bigint"), last).cast("int")
    rows = rows.select(
        "seq", "bytes", "start", chunk.alias("chunk_id"), closed.alias("closed")
    )
    return ChunkLayout(rows, n_chunks, total)


def rechunk_check(layout: ChunkLayout) -> DataFrame:
    """One row: bytes in and out, chunks asked for and closed, and ``ok``."""
    found = layout.rows.agg(
        F.coalesce(F.sum("bytes"), F.lit(0)).cast("bigint").alias("bytes_out"),
        F.coalesce(F.max("closed"), F.lit(0)).cast("bigint").alias("chunks_closed"),
    )
    bytes_in = F.lit(layout.n_bytes).cast("bigint")
    n_chunks = F.lit(layout.n_chunks).cast("bigint")
    ok = (F.col("bytes_out") == bytes_in) & (F.col("chunks_closed") == n_chunks)
    return found.select(
        bytes_in.alias("bytes_in"),
        "bytes_out",
        n_chunks.alias("n_chunks"),
        "chunks_closed",
        ok.alias("ok"),
    )


def require_complete(layout: ChunkLayout) -> ChunkLayout:
    """Raise unless every byte is placed and every chunk was closed."""
    check = rechunk_check(layout).first()
    if not check["ok"]:
        raise ValueError(f"incomplete layout: {check.asDict()}")
    return layout


def assign_chunks(corpus: DataFrame, layout: ChunkLayout) -> DataFrame:
    """The corpus with its new ``chunk_id``; a projection.

    Chunks are runs of ``seq``, so their first ``seq`` values suffice to place a
    row: no join with the text.
    """
    if layout.n_chunks > MOST_CHUNKS:
        raise ValueError(f"{layout.n_chunks} chunks are more than {MOST_CHUNKS}")
    firsts = (
        layout.rows.groupBy("chunk_id")
        .agg(F.min("seq").alias("first"))
        .orderBy("first")
        .collect()  # one row per chunk
    )
    corpus = corpus.drop("chunk_id")
    if not firsts:
        return corpus.withColumn("chunk_id", F.lit(0))
    index = _last_not_above(F.col("seq"), [p["first"] for p in firsts])
    chunk = F.get(_array_literal([p["chunk_id"] for p in firsts], "int"), index)
    return corpus.withColumn("chunk_id", chunk)


def lay_out(assigned: DataFrame, n_bytes: int, part_bytes: int = PART_BYTES) -> DataFrame:
    """Deal an assigned corpus out for writing, in scan order: as many tasks as
    there are parts of ``part_bytes``, so a large chunk is written by several."""
    tasks = max(1, -(-n_bytes // part_bytes))
    return assigned.repartitionByRange(tasks, "chunk_id", "seq").sortWithinPartitions(
        "chunk_id", "seq"
    )


def _by_seq():
    return Window.partitionBy("block").orderBy("seq")


def _up_to(row: int):
    return _by_seq().rowsBetween(Window.unboundedPreceding, row)


def _thresholds_reached(reached: Column, total: int, n_chunks: int) -> Column:
    # floor(total * (j + 1) / n) <= x  <=>  j + 1 <= (n * (x + 1) - 1) div total;
    # in decimals, for the product outgrows 64 bits.
    if total == 0:
        return F.lit(n_chunks).cast("bigint")
    scaled = (reached.cast("decimal(19,0)") + 1) * F.lit(n_chunks).cast("decimal(10,0)") - 1
    return F.call_function("div", scaled, F.lit(total).cast("decimal(19,0)"))


def _with_least_before(rows: DataFrame) -> DataFrame:
    """Add the least ``spare`` of all earlier blocks (null in the first)."""
    leasts = (
        rows.groupBy("block")
        .agg(F.min("spare").alias("least"))
        .orderBy("block")
        .collect()  # one row per block
    )
    running = list(accumulate((row["least"] for row in leasts), min))
    offsets = rows.sparkSession.createDataFrame(
        [(row["block"], before) for row, before in zip(leasts, [None, *running])],
        "block int, least_before bigint",
    )
    return rows.join(F.broadcast(offsets), "block")


def _array_literal(values, kind: str) -> Column:
    joined = ",".join(map(str, values))
    return F.split(F.lit(joined), ",").cast(f"array<{kind}>")


def _last_not_above(value: Column, ascending: list[int]) -> Column:
    """Index of the last element not above ``value``, by halving steps."""
    firsts = _array_literal(ascending, "bigint")
    steps = [1 << bit for bit in reversed(range(max(len(ascending) - 1, 1).bit_length()))]
    return F.aggregate(
        F.array(*map(F.lit, steps)),
        F.lit(0),
        lambda low, step: F.when(F.get(firsts, low + step) <= value, low + step).otherwise(low),
    )
