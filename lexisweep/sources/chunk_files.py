"""Numbered Arrow files ``<prefix>-<i>.rb``, one record batch each.

The interchange format of a chunked corpus: non-null ``title`` utf8 and ``text``
binary.  Inside Spark prefer Parquet (``dataset``); a chunk here is bounded by
the 2 GiB that a record batch can address.
"""

import json
import re
import uuid
from collections import Counter
from contextlib import contextmanager
from dataclasses import dataclass

import numpy
import pyarrow as pa
import pyarrow.compute as pc
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import (
    DataSource,
    DataSourceArrowWriter,
    DataSourceReader,
    InputPartition,
    WriterCommitMessage,
)

from lexisweep.functions.codec import decode_blocks
from lexisweep.schema import ROWS_PER_CHUNK
from lexisweep.sources.row_ranges import TextBatch, pieces

FORMAT = "chunk_files"
READ_SCHEMA = "chunk_id int, seq bigint, title string, text binary"
SIZES_SCHEMA = "chunk_id int, seq bigint, bytes bigint"
DECODED_SCHEMA = "chunk_id int, seq bigint, title string, text string, bytes bigint"
BATCH_ROWS = 4096
BATCH_BYTES = 8 << 20

# Bytes of files that a task reads: a larger file is read by several, small ones are
# read together unless that leaves cores idle.
MOST_TASK = 64 << 20
LEAST_TASK = 1 << 20

# Bytes of rows that go to a Python worker at once while files are written: texts to
# be encoded, and chunks.  Spark's own bound is 64 MB; a worker holds two batches, and
# what it makes of them, and keeps that memory for the tasks after.
WRITE_BATCH = 4 << 20
BATCH_SETTING = "spark.sql.execution.arrow.maxBytesPerBatch"

# Names and types inside and outside a chunk file.
SUFFIX = ".rb"
FILE_FIELDS = (("title", pa.string()), ("text", pa.binary()))
MAX_TEXT = (1 << 31) - 1  # what the 32-bit offsets of a record batch can address


def read_chunks(spark: SparkSession, prefix: str, chunks=None) -> DataFrame:
    """``(chunk_id, seq, title, text)`` of the files 0, 1, ... up to the first gap.

    ``seq`` is the scan position.  A task holds BATCH_BYTES of text, or one text,
    whatever the size of a file.  With ``chunks``, numbers of chunks, only their files
    are opened.  (Spark's pushdown of filters into Python sources is not used: what one
    query pushes stays for the next query on the same DataFrame, which then lacks rows.)
    """
    return _reader(spark, chunks).load(prefix)


def read_chunk_corpus(spark: SparkSession, prefix: str, chunks=None) -> DataFrame:
    """Chunk files of Snappy blocks as a corpus to search: the text decoded,
    ``bytes`` the size of the block.

    Decoding in the reader spares the blocks a way into the JVM and back.
    """
    return _reader(spark, chunks).option("decoded", "true").load(prefix)


def read_chunk_sizes(spark: SparkSession, prefix: str, chunks=None) -> DataFrame:
    """``(chunk_id, seq, bytes)`` of chunk files; of the text only offsets are read."""
    return _reader(spark, chunks).option("sizes", "true").load(prefix)


def _reader(spark, chunks):
    spark.dataSource.register(ChunkFiles)
    reader = spark.read.format(FORMAT).option("tasks", spark.sparkContext.defaultParallelism)
    return reader if chunks is None else reader.option("chunks", _ranges(chunks))


@dataclass(frozen=True)
class ChunkMetadata:
    """Key-value metadata in the schema of a chunk file: of the whole, and of
    the text field."""

    schema: dict[str, str]
    text: dict[str, str]

    @classmethod
    def of(cls, prefix: str) -> "ChunkMetadata":
        """As found in the first file of a set."""
        finish_commit(prefix)
        files, path = fs.FileSystem.from_uri(f"{prefix}-0{SUFFIX}")
        with files.open_input_file(path) as source:
            schema = pa.ipc.open_file(source).schema
        return cls(_decoded(schema.metadata), _decoded(schema.field("text").metadata))


def write_chunks(
    chunks: DataFrame,
    prefix: str,
    n_chunks: int | None = None,
    metadata: ChunkMetadata | None = None,
    grouped: bool = False,
) -> None:
    """Write ``(chunk_id, seq, title, text)``, one file per chunk in ``seq`` order.

    A chunk without rows below ``n_chunks`` (or below the highest chunk) gets a
    file of no rows.  ``grouped`` says that every chunk lies in one partition
    already, in order, and saves the shuffle; if that is not so the write fails
    and leaves what was there.  While it runs, the session sends batches of at most
    WRITE_BATCH bytes to Python workers.
    """
    chunks.sparkSession.dataSource.register(ChunkFiles)
    metadata = metadata or ChunkMetadata({}, {})
    options = {f"schema.{k}": v for k, v in metadata.schema.items()}
    options |= {f"text.{k}": v for k, v in metadata.text.items()}
    if not grouped:
        tasks = n_chunks or 1 + (chunks.agg(F.max("chunk_id")).first()[0] or 0)
        # Chunk k is written by task k: no two by one while another is idle.
        chunks = chunks.repartitionById(tasks, "chunk_id")
        chunks = chunks.sortWithinPartitions("chunk_id", "seq")
    rows = chunks.select("chunk_id", "title", F.col("text").cast("binary"))
    writer = rows.write.format(FORMAT).options(**options).option("n_chunks", n_chunks or 0)
    with _small_batches(chunks.sparkSession):
        writer.mode("overwrite").save(prefix)


@contextmanager
def _small_batches(spark):
    """Bounds the session's batches to Python workers; a smaller bound stays."""
    before = spark.conf.get(BATCH_SETTING, None)
    if before is not None:
        as_bytes = spark.sparkContext._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes
        if 0 < as_bytes(before) <= WRITE_BATCH:
            yield
            return
    spark.conf.set(BATCH_SETTING, f"{WRITE_BATCH}b")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(BATCH_SETTING)
        else:
            spark.conf.set(BATCH_SETTING, before)


class ChunkFiles(DataSource):
    @classmethod
    def name(cls):
        return FORMAT

    def schema(self):
        if self._asked("sizes"):
            return SIZES_SCHEMA
        return DECODED_SCHEMA if self._asked("decoded") else READ_SCHEMA

    def reader(self, schema):
        tasks = int(self.options.get("tasks", 1))
        wanted = self.options.get("chunks")
        if wanted is not None:
            wanted = [tuple(map(int, run.split(":"))) for run in wanted.split(",") if run]
        return _Reader(
            self.options["path"], self._asked("decoded"), self._asked("sizes"), tasks, wanted
        )

    def _asked(self, option):
        return self.options.get(option, "false") == "true"

    def writer(self, schema, overwrite):
        return _Writer(self.options)


@dataclass
class _Piece:
    """Part ``part`` of ``parts`` of the rows of a chunk file."""

    chunk_id: int
    path: str
    part: int
    parts: int


@dataclass
class _Task(InputPartition):
    pieces: list


class _Reader(DataSourceReader):
    """A large file is read by several tasks, each a range of its rows; a task reads
    several small ones."""

    def __init__(self, prefix, decoded, sizes, tasks, wanted=None):
        self.prefix = prefix
        self.decoded = decoded
        self.sizes = sizes
        self.tasks = tasks
        self.wanted = wanted  # pairs of first and last numbers, or all

    def partitions(self):
        finish_commit(self.prefix)
        sizes, chunks = _existing(self.prefix), 0
        while chunks in sizes:
            chunks += 1
        if not chunks:
            raise FileNotFoundError(f"no chunk files for prefix {self.prefix}")
        chosen = range(chunks)
        if self.wanted is not None:
            chosen = [k for low, high in self.wanted for k in chosen[low : high + 1]]
        share = sum(sizes[k] for k in chosen) // self.tasks
        most = min(max(share, LEAST_TASK), MOST_TASK)
        tasks, held = [], most
        for k in chosen:
            parts = 1 + sizes[k] // MOST_TASK
            for part in range(parts):
                if held + sizes[k] // parts > most:
                    tasks.append(_Task([]))
                    held = 0
                tasks[-1].pieces.append(_Piece(k, f"{self.prefix}-{k}{SUFFIX}", part, parts))
                held += sizes[k] // parts
        return tasks

    def read(self, partition):
        for piece in partition.pieces if partition else ():
            files, path = fs.FileSystem.from_uri(piece.path)
            if isinstance(files, fs.LocalFileSystem):
                files = fs.LocalFileSystem(use_mmap=True)
            with files.open_input_file(path) as source:
                yield from self._rows(piece, source)

    def _rows(self, piece, source):
        file = pa.ipc.open_file(source)
        batch = TextBatch(source, file.schema)
        if not batch.plain:  # compressed or with nulls: as a whole, by one task
            whole = file.get_batch(0) if piece.part == 0 else None
            for start in range(0, whole.num_rows if whole else 0, BATCH_ROWS):
                rows = whole.slice(start, BATCH_ROWS)
                lengths = pc.binary_length(rows.column("text")).cast(pa.int64())
                yield self._batch(piece, start, lengths, rows.column("title"), rows.column("text"))
            return
        first, last = (batch.rows * (piece.part + k) // piece.parts for k in (0, 1))
        for start in range(first, last, BATCH_ROWS):
            stop = min(start + BATCH_ROWS, last)
            offsets = batch.offsets("text", start, stop)
            if self.sizes:
                yield self._batch(piece, start, pa.array(numpy.diff(offsets), pa.int64()))
                continue
            titles = batch.column("title", batch.offsets("title", start, stop))
            for low, high in pieces(offsets, BATCH_BYTES):
                part = offsets[low : high + 1]
                lengths = pa.array(numpy.diff(part), pa.int64())
                texts = batch.column("text", part)
                yield self._batch(piece, start + low, lengths, titles.slice(low, high - low), texts)

    def _batch(self, piece, start, lengths, titles=None, texts=None):
        first = piece.chunk_id * ROWS_PER_CHUNK + start
        columns = {
            "chunk_id": pa.array(numpy.full(len(lengths), piece.chunk_id, numpy.int32)),
            "seq": pa.array(numpy.arange(first, first + len(lengths))),
        }
        if not self.sizes:
            columns["title"] = titles
            columns["text"] = decode_blocks(texts) if self.decoded else texts
        if self.sizes or self.decoded:
            columns["bytes"] = lengths
        return pa.RecordBatch.from_pydict(columns)


def _ranges(chunks):
    """Numbers as text: runs of them as pairs."""
    runs = []
    for k in sorted(set(chunks)):
        if runs and runs[-1][1] == k - 1:
            runs[-1][1] = k
        else:
            runs.append([k, k])
    return ",".join(f"{low}:{high}" for low, high in runs)


@dataclass
class _Written(WriterCommitMessage):
    chunks: list


class _Writer(DataSourceArrowWriter):
    """Tasks write to a folder of the run; the commit moves what has succeeded.

    What is to be moved is written down in a journal first.  A commit that is stopped
    half-way is finished by whoever reads or writes the set next, so that nobody sees
    a mix of two sets; one stopped before the journal is there has changed nothing.
    """

    def __init__(self, options):
        self.prefix = options["path"]
        self.n_chunks = int(options.get("n_chunks", 0))
        self.run = f"{self.prefix}-{uuid.uuid4().hex}.tmp"
        schema = pa.schema([pa.field(n, t, nullable=False) for n, t in FILE_FIELDS])
        text = schema.field("text").with_metadata(_chosen(options, "text."))
        self.schema = schema.set(1, text).with_metadata(_chosen(options, "schema."))

    def write(self, batches):
        written = []
        open_chunk, parts, size = None, [], 0
        # Rows come sorted by chunk, so only one chunk is held at a time.
        for batch in batches:
            runs = pc.run_end_encode(batch.column("chunk_id"))
            start = 0
            for end, chunk in zip(runs.run_ends.to_pylist(), runs.values.to_pylist()):
                if chunk != open_chunk:
                    if parts:
                        written.append(self._write_file(open_chunk, parts))
                    open_chunk, parts, size = chunk, [], 0
                parts.append(batch.slice(start, end - start).select(["title", "text"]))
                size += pc.sum(pc.binary_length(parts[-1].column("text"))).as_py() or 0
                if size > MAX_TEXT:
                    raise ValueError(f"chunk {chunk} is over 2 GiB: rechunk into more chunks")
                start = end
        if parts:
            written.append(self._write_file(open_chunk, parts))
        return _Written(written)

    def _write_file(self, chunk, parts):
        files, folder = fs.FileSystem.from_uri(self.run)
        files.create_dir(folder, recursive=True)
        path = f"{folder}/{chunk}-{uuid.uuid4().hex}{SUFFIX}"
        if parts:
            [batch] = pa.Table.from_batches(parts).cast(self.schema).combine_chunks().to_batches()
        else:
            batch = pa.RecordBatch.from_pylist([], self.schema)
        with files.open_output_stream(path) as sink:
            with pa.ipc.new_file(sink, self.schema) as out:
                out.write_batch(batch)
        return chunk, path

    def commit(self, messages):
        written = [pair for message in messages if message for pair in message.chunks]
        numbers = [chunk for chunk, _ in written]
        if repeated := sorted({chunk for chunk, n in Counter(numbers).items() if n > 1}):
            raise ValueError(f"chunks {repeated[:10]} came from more than one task or run")
        if numbers and min(numbers) < 0:
            raise ValueError("chunk numbers must not be negative")
        count = max([self.n_chunks, *(chunk + 1 for chunk, _ in written)])
        missing = set(range(count)) - {chunk for chunk, _ in written}
        written += [self._write_file(chunk, []) for chunk in sorted(missing)]
        finish_commit(self.prefix)  # an earlier one
        files, folder = fs.FileSystem.from_uri(self.run)
        files.create_dir(folder, recursive=True)
        with files.open_output_stream(f"{folder}/journal") as sink:
            sink.write(json.dumps({"run": folder, "files": written, "count": count}).encode())
        files.move(f"{folder}/journal", _journal(self.prefix))
        finish_commit(self.prefix)

    def abort(self, messages):
        files, folder = fs.FileSystem.from_uri(self.run)
        journal = _read_journal(files, _journal(self.prefix))
        if journal is None or journal["run"] != folder:  # else it can be finished
            _drop_folder(files, folder)


def finish_commit(prefix: str) -> None:
    """Finish a commit of chunk files that was stopped after its journal was written.

    Files that are moved already are no longer in the folder of the run, so finishing
    twice, or by several at once, does no harm.
    """
    files, path = fs.FileSystem.from_uri(prefix)
    plan = _read_journal(files, _journal(prefix))
    if plan is None:
        return
    for chunk, source in plan["files"]:
        try:
            _move(files, source, f"{path}-{chunk}{SUFFIX}")
        except FileNotFoundError:  # moved before
            pass
    for index in sorted(_existing(prefix)):
        if index >= plan["count"]:
            files.delete_file(f"{path}-{index}{SUFFIX}")
    files.delete_file(_journal(prefix))
    _drop_folder(files, plan["run"])


def _move(files, source, target):
    files.move(source, target)


def _journal(prefix):
    return f"{fs.FileSystem.from_uri(prefix)[1]}.commit"


def _read_journal(files, path):
    if files.get_file_info(path).type != fs.FileType.File:
        return None
    with files.open_input_stream(path) as source:
        return json.loads(source.read())


def _drop_folder(files, folder):
    if files.get_file_info(folder).type == fs.FileType.Directory:
        files.delete_dir(folder)


def _existing(prefix):
    """{number: bytes} of the chunk files of a prefix."""
    files, path = fs.FileSystem.from_uri(prefix)
    folder, _, name = path.rpartition("/")
    pattern = re.compile(re.escape(name) + r"-(0|[1-9]\d*)" + re.escape(SUFFIX))
    listing = files.get_file_info(fs.FileSelector(folder, allow_not_found=True))
    found = ((pattern.fullmatch(info.base_name), info.size) for info in listing)
    return {int(match[1]): size for match, size in found if match}


def _decoded(metadata):
    return {key.decode(): value.decode() for key, value in (metadata or {}).items()}


def _chosen(options, start):
    return {k[len(start):]: v for k, v in options.items() if k.startswith(start)} or None
