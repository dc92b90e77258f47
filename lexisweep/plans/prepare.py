"""From a dump, or any table of pages, to a searchable corpus."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexisweep.functions.codec import encode_text
from lexisweep.operators import clean
from lexisweep.operators.layout import (
    CHUNKS,
    assign_chunks,
    lay_out,
    rechunk_by_bytes,
    require_complete,
    scan_positions,
)
from lexisweep.schema import ROWS_PER_CHUNK
from lexisweep.sources.chunk_files import (
    ChunkMetadata,
    read_chunk_sizes,
    read_chunks,
    write_chunks,
)
from lexisweep.sources.dump import ARTICLE, SPLIT, dump_splits, read_dump
from lexisweep.staging import staged


def clean_pages(dump: DataFrame, *keys: str) -> DataFrame:
    """``(<keys>, title, text)`` of the articles of a dump.  Narrow: no shuffle."""
    pages = clean.select_page_text(dump, *keys)
    pages = clean.drop_null_pages(pages)
    pages = clean.drop_meta_pages(pages)
    return clean.strip_links(pages)


def prepare(
    spark: SparkSession, dump_path: str, compress: bool = False, splits: DataFrame | None = None
) -> DataFrame:
    """A corpus in the order of the dump, one chunk per split of the input.

    ``seq`` follows the names of the dump's files, the splits of a file and the
    pages of a split, however Spark packs splits into tasks.  ``splits`` is the
    staged table of ``dump_splits``; without one a pass of its own over the files
    finds it, which parses nothing.

    ``compress`` turns the text into raw Snappy blocks, as chunk files want it;
    Parquet compresses anyway.  ``bytes`` is kept so that no later layout job
    has to read the text for its size.
    """
    if splits is None:
        splits = staged(dump_splits(spark, dump_path), "splits")
    dump = read_dump(spark, dump_path, schema=ARTICLE, places=True)
    placed = dump.join(F.broadcast(splits), [*SPLIT]).withColumn(
        "row", F.monotonically_increasing_id().bitwiseAND(F.lit(ROWS_PER_CHUNK - 1))
    )
    # Pages of a split are in order within their task, so positions there, counted
    # from the split's rank as spaced as the positions of a task are, ascend.
    seq = F.col("split") * F.lit(ROWS_PER_CHUNK) + F.col("row")
    chunk = F.col("split").cast("int").alias("chunk_id")
    pages = clean_pages(placed.withColumns({"seq": seq, "chunk_id": chunk}), "chunk_id", "seq")
    if compress:
        pages = pages.withColumn("text", encode_text("text"))
    return pages.withColumn("bytes", F.octet_length("text").cast("bigint"))


def rechunk(corpus: DataFrame, n_chunks: int = CHUNKS) -> DataFrame:
    """The corpus in ``n_chunks`` contiguous chunks of about equal bytes."""
    layout = require_complete(rechunk_by_bytes(scan_positions(corpus), n_chunks))
    return lay_out(assign_chunks(corpus, layout), layout.n_bytes)


def prepare_files(
    spark: SparkSession, dump_path: str, prefix: str, metadata: ChunkMetadata | None = None
) -> None:
    """A dump to chunk files of Snappy blocks, one per split of the input.

    Without a shuffle: each task writes the splits it reads.  A split of which
    no page is kept gets a file of no rows.
    """
    splits = staged(dump_splits(spark, dump_path), "splits")
    corpus = prepare(spark, dump_path, compress=True, splits=splits)
    write_chunks(corpus, prefix, splits.count(), metadata, grouped=True)


def rechunk_files(spark: SparkSession, source: str, target: str, n_chunks: int = CHUNKS) -> None:
    """Chunk files to ``n_chunks`` chunk files of about equal bytes."""
    sizes = scan_positions(read_chunk_sizes(spark, source))
    layout = require_complete(rechunk_by_bytes(sizes, n_chunks))
    corpus = assign_chunks(read_chunks(spark, source), layout)
    write_chunks(corpus, target, n_chunks, ChunkMetadata.of(source))
