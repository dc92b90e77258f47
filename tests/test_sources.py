"""Dumps, chunk files, datasets, codec and the preparation job."""

import bz2
import os

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lexisweep.functions.codec import decode_text, encode_text
from lexisweep.operators import clean
from lexisweep.operators.queries import Query
from lexisweep.plans.prepare import clean_pages, prepare, prepare_files, rechunk_files
from lexisweep.plans.search import search_stats
from lexisweep.schema import DUMP_PAGE, ROWS_PER_CHUNK
from lexisweep.sources import chunk_files
from lexisweep.sources.chunk_files import (
    ChunkMetadata,
    read_chunk_corpus,
    read_chunk_sizes,
    read_chunks,
    write_chunks,
)
from lexisweep.sources.dataset import OpenDataset, dataset_head, write_dataset
from lexisweep.sources.dump import read_dump, write_dump
from lexisweep.staging import drop_staged, shared_folder, staged

DUMP = """<mediawiki>
  <page><title>A</title><ns>0</ns><id>1</id><revision><id>11</id><timestamp>2020</timestamp>
    <contributor><username>u</username><id>5</id></contributor>
    <text xml:space="preserve">x [[a|b|c]] [[File:p|thumb|cap [[q|r]] z]] [[e|]]</text></revision></page>
  <page><title>Template:Foo</title><id>3</id><revision><text xml:space="preserve">t</text></revision></page>
  <page><title>Star Wars: IV</title><id>4</id><revision><text xml:space="preserve">s</text></revision></page>
  <page><title>Empty</title><id>5</id><revision><text xml:space="preserve"></text></revision></page>
  <page><title>EmptyB</title><id>6</id><revision><text xml:space="preserve" /></revision></page>
  <page><title>NoAttr</title><id>7</id><revision><text>plain</text></revision></page>
  <page><title>Bad</title><id>abc</id><revision><text xml:space="preserve">s</text></revision></page>
  <page><title>Foo 2:Bar</title><id>8</id><revision><text>t</text></revision></page>
  <page><title>Spaces</title><id>9</id><revision><text xml:space="preserve">  two
 lines &amp; more </text></revision></page>
  <page><title>Torn</title><revision><text>t</page>
</mediawiki>
"""

CLEANED = {
    "A": "x c cap r z e|",
    "Star Wars: IV": "s",
    "NoAttr": "plain",
    "Bad": "s",
    "Spaces": "  two\n lines & more ",
}

BLOCKS = {
    "Hello this is the 1st line": "1a6448656c6c6f20746869732069732074686520317374206c696e65",
    "This is the second line": "17585468697320697320746865207365636f6e64206c696e65",
    "And another line is herehereherehereherehere":
        "2c5c416e6420616e6f74686572206c696e6520697320686572654e0400",
}


@pytest.fixture(params=["dump.xml", "dump.xml.bz2"])
def dump_path(request, tmp_path):
    path = tmp_path / request.param
    data = DUMP.encode()
    path.write_bytes(bz2.compress(data) if path.suffix == ".bz2" else data)
    return str(path)


def test_cleaned_dump(spark, dump_path):
    dump = read_dump(spark, dump_path, ("title", "revision"))
    assert dict(clean_pages(dump).collect()) == CLEANED


def test_malformed_pages(spark, dump_path):
    assert "Bad" in [r.title for r in read_dump(spark, dump_path, ["title"]).collect()]
    dump = read_dump(spark, dump_path)
    assert dump.schema == DUMP_PAGE
    assert "Bad" not in [r.title for r in dump.collect()]
    first = dump.filter("id = 1").first()
    assert (first.ns, first.revision.id, first.revision.contributor.id) == (0, 11, 5)


@pytest.mark.parametrize("compression", ["none", "bzip2"])
def test_a_dump_is_split(spark, data, tmp_path, compression):
    """Small splits cut pages anywhere; each page is still read just once."""
    docs = spark.read.parquet(f"{data}/documents.parquet")
    path = str(tmp_path / "dump")
    shaped = docs.selectExpr(
        "concat('t', doc_id) as title",
        "named_struct('text', named_struct('_VALUE', text, '_space', 'preserve')) as revision",
    )
    write_dump(shaped.coalesce(1), path, compression)
    settings = {"spark.sql.files.maxPartitionBytes": "20000", "spark.sql.files.openCostInBytes": "1"}
    try:
        for key, value in settings.items():
            spark.conf.set(key, value)
        dump = read_dump(spark, path, ("title", "revision"))
        assert dump.rdd.getNumPartitions() > 20
        back = dump.selectExpr("title", "revision.text._VALUE as text")
        want = docs.selectExpr("concat('t', doc_id) as title", "text")
        assert back.count() == want.count() and back.exceptAll(want).isEmpty()
    finally:
        for key in settings:
            spark.conf.unset(key)


def test_prepared_corpus(spark, dump_path, tmp_path):
    corpus = prepare(spark, dump_path)
    rows = corpus.orderBy("seq").collect()
    assert {r.title: r.text for r in rows} == CLEANED
    assert [r.title for r in rows] == list(CLEANED)  # dump order
    assert all(r.bytes == len(r.text.encode()) for r in rows)
    packed = prepare(spark, dump_path, compress=True)
    assert dict(packed.select("title", decode_text("text")).collect()) == CLEANED
    plan = corpus._jdf.queryExecution().executedPlan().toString()
    assert " Exchange " not in plan and "redirect" not in plan and "contributor" not in plan
    assert plan.count("from_xml") == 1
    write_dataset(corpus, str(tmp_path / "out"))
    assert spark.read.parquet(str(tmp_path / "out")).count() == len(CLEANED)


def test_known_blocks(spark):
    rows = [(text, bytes.fromhex(block)) for text, block in BLOCKS.items()]
    df = spark.createDataFrame(rows, "text string, block binary")
    assert df.filter(decode_text("block") == F.col("text")).count() == 3
    assert [bytes(r[0]).hex() for r in df.select(encode_text("text")).collect()] == list(BLOCKS.values())


def test_codec_edges(spark):
    texts = ["", "é\0x", "a" * 300_000, None]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, text string")
    back = df.select("i", encode_text("text").alias("b")).select("i", decode_text("b"))
    assert dict(back.collect()) == dict(enumerate(texts))
    for bad in (b"", b"\xff\xff\xff\xff\xff", b"\x05abc"):
        broken = spark.createDataFrame([(bad,)], "b binary")
        with pytest.raises(Exception):
            broken.select(decode_text("b")).collect()


def chunk_frame(spark, ids):
    rows = [(c, i, f"t{i}", f"text {i}".encode()) for i, c in enumerate(ids)]
    return spark.createDataFrame(rows, "chunk_id int, seq bigint, title string, text binary")


def test_chunk_files(spark, tmp_path):
    prefix = str(tmp_path / "set")
    frame = chunk_frame(spark, [0, 0, 0, 1, 3, 3])
    metadata = ChunkMetadata({"mode": "read"}, {"width": "8"})
    write_chunks(frame.repartition(4), prefix, 5, metadata)
    assert ChunkMetadata.of(prefix) == metadata
    assert sorted(os.listdir(tmp_path)) == [f"set-{i}.rb" for i in range(5)]
    with pa.OSFile(f"{prefix}-3.rb") as source:
        file = pa.ipc.open_file(source)
        assert file.num_record_batches == 1
        assert file.schema.metadata == {b"mode": b"read"}
        assert file.schema.field("text").metadata == {b"width": b"8"}
        assert not any(field.nullable for field in file.schema)
        assert file.schema.types == [pa.string(), pa.binary()]
    back = read_chunks(spark, prefix).orderBy("seq").collect()
    assert [(r.chunk_id, r.title, bytes(r.text).decode()) for r in back] == [
        (c, f"t{i}", f"text {i}") for i, c in enumerate([0, 0, 0, 1, 3, 3])
    ]
    assert [r.seq % ROWS_PER_CHUNK for r in back] == [0, 1, 2, 0, 0, 1]


@pytest.mark.parametrize("suffix", [".xml", ".xml.bz2"])
def test_order_over_several_files(spark, tmp_path, suffix):
    def page(k, size):
        return f"<page><title>t{k}</title><revision><text x='y'>{'w' * size}</text><contributor><id>?</id></contributor></revision></page>"

    sizes = {"a": [10] * 3, "b": [997] * 300, "c": [500] * 40}
    want = []
    for name, pages in sizes.items():
        data = "<mediawiki>" + "".join(page(f"{name}{k}", n) for k, n in enumerate(pages)) + "</mediawiki>"
        want += [f"t{name}{k}" for k in range(len(pages))]
        (tmp_path / f"{name}{suffix}").write_bytes(bz2.compress(data.encode()) if "bz2" in suffix else data.encode())
    found = []
    try:
        for most in ("30000", "128m"):
            spark.conf.set("spark.sql.files.maxPartitionBytes", most)
            rows = prepare(spark, str(tmp_path)).orderBy("seq").collect()
            assert [r.title for r in rows] == want
            assert [r.chunk_id for r in rows] == sorted(r.chunk_id for r in rows)
            found.append(len({r.chunk_id for r in rows}))
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert found[0] >= found[1] >= 3


def test_a_chunk_from_two_tasks_is_refused(spark, tmp_path):
    prefix = str(tmp_path / "set")
    write_chunks(chunk_frame(spark, [0, 1]), prefix)
    split = chunk_frame(spark, [0] * 10).repartition(2)
    with pytest.raises(Exception, match="more than one task"):
        write_chunks(split, prefix, grouped=True)
    assert sorted(os.listdir(tmp_path)) == ["set-0.rb", "set-1.rb"]
    assert read_chunks(spark, prefix).count() == 2


def test_chunks_are_placed_by_number(spark, tmp_path):
    prefix = str(tmp_path / "set")
    write_chunks(chunk_frame(spark, [k % 15 for k in range(60)]).repartition(7), prefix)
    assert [r["count"] for r in read_chunks(spark, prefix).groupBy("chunk_id").count().collect()] == [4] * 15
    sizes = read_chunk_sizes(spark, prefix).orderBy("seq").collect()
    blocks = read_chunks(spark, prefix).orderBy("seq").collect()
    assert [(r.chunk_id, r.seq, r.bytes) for r in sizes] == [(r.chunk_id, r.seq, len(r.text)) for r in blocks]


def writer_input():
    return pa.RecordBatch.from_pydict(
        {"chunk_id": pa.array([0, 0, 2], pa.int32()), "title": ["a", "b", "c"], "text": [b"1", b"22", b"333"]}
    )


def test_only_committed_attempts_count(tmp_path):
    writer = chunk_files._Writer({"path": f"{tmp_path}/set", "n_chunks": "4"})
    lost = writer.write(iter([writer_input()]))
    kept = writer.write(iter([writer_input().slice(0, 1), writer_input().slice(1)]))
    nothing = writer.write(iter([]))
    writer.commit([kept, nothing, None])
    assert lost.chunks != kept.chunks
    assert sorted(os.listdir(tmp_path)) == [f"set-{i}.rb" for i in range(4)]
    rows = [pa.ipc.open_file(pa.OSFile(f"{tmp_path}/set-{i}.rb")).get_batch(0).num_rows for i in range(4)]
    assert rows == [2, 0, 1, 0]


def test_an_aborted_write_leaves_nothing(tmp_path):
    writer = chunk_files._Writer({"path": f"{tmp_path}/set"})
    writer.abort([writer.write(iter([writer_input()])), None])
    assert os.listdir(tmp_path) == []


def test_a_chunk_too_large_fails_early(tmp_path, monkeypatch):
    monkeypatch.setattr(chunk_files, "MAX_TEXT", 2)
    with pytest.raises(ValueError, match="2 GiB"):
        chunk_files._Writer({"path": f"{tmp_path}/set"}).write(iter([writer_input()]))


@pytest.mark.parametrize("before", [None, "1m", "32m"])
def test_texts_to_be_written_come_in_small_batches(spark, tmp_path, before):
    """What a Python worker gets at once does not grow with the rows of a task."""
    setting = chunk_files.BATCH_SETTING
    most = min(chunk_files.WRITE_BATCH, (1 << 20) if before == "1m" else 1 << 40)

    @F.arrow_udf("binary")
    def batch_size(text):
        return pa.array([str(text.nbytes).encode()] * len(text), pa.binary())

    rows = spark.range(2000, numPartitions=1).selectExpr(
        "cast(id div 200 as int) as chunk_id", "id as seq", "concat('t', id) as title", "repeat(char(97 + id % 26), 10000) as text"
    )
    if before:
        spark.conf.set(setting, before)
    try:
        write_chunks(rows.withColumn("text", batch_size("text")), f"{tmp_path}/set")
        assert spark.conf.get(setting, None) == before
        back = read_chunks(spark, f"{tmp_path}/set").orderBy("seq").collect()
        assert [r.title for r in back] == [f"t{k}" for k in range(2000)]
        assert max(int(r.text) for r in back) <= most + 20_000
        with pytest.raises(Exception):  # the setting comes back after a failure too
            write_chunks(chunk_frame(spark, [-1]), f"{tmp_path}/other", grouped=True)
        assert spark.conf.get(setting, None) == before
    finally:
        spark.conf.unset(setting)


def test_chunk_files_stop_at_a_gap(spark, tmp_path):
    prefix = str(tmp_path / "set")
    write_chunks(chunk_frame(spark, [0, 1, 2, 3]), prefix)
    os.remove(f"{prefix}-2.rb")
    assert sorted(r.chunk_id for r in read_chunks(spark, prefix).collect()) == [0, 1]
    with pytest.raises(Exception, match="no chunk files"):
        read_chunks(spark, str(tmp_path / "other")).collect()


def test_chunk_files_replace_a_longer_set(spark, tmp_path):
    prefix = str(tmp_path / "set")
    write_chunks(chunk_frame(spark, [0, 1, 2, 3]), prefix)
    write_chunks(chunk_frame(spark, [0, 0, 1]), prefix)
    assert sorted(os.listdir(tmp_path)) == ["set-0.rb", "set-1.rb"]


def test_search_in_chunk_files(spark, tmp_path):
    prefix = str(tmp_path / "set")
    rows = [(0, i, f"title {'abc'[i]}", bytes.fromhex(block)) for i, block in enumerate(BLOCKS.values())]
    write_chunks(spark.createDataFrame(rows, "chunk_id int, seq bigint, title string, text binary"), prefix)
    got = search_stats(read_chunk_corpus(spark, prefix), Query("line")).first()
    assert tuple(got) == (3, 3, 1, "title c", 94)


def test_dump_to_files_to_even_files(spark, dump_path, tmp_path):
    raw, even = str(tmp_path / "raw"), str(tmp_path / "even")
    metadata = ChunkMetadata({"mode": "read"}, {"width": "8"})
    prepare_files(spark, dump_path, raw, metadata)
    before = read_chunk_corpus(spark, raw).orderBy("seq").collect()
    assert [(r.title, r.text) for r in before] == list(CLEANED.items())
    rechunk_files(spark, raw, even, 2)
    assert ChunkMetadata.of(even) == metadata
    assert len([name for name in os.listdir(tmp_path) if name.startswith("even-")]) == 2
    after = read_chunk_corpus(spark, even).orderBy("seq").collect()
    assert [(r.title, r.text) for r in after] == list(CLEANED.items())
    total, seen, want = sum(r.bytes for r in before), 0, []
    for row in before:
        want.append(sum(seen >= total * (j + 1) // 2 for j in range(2)))
        seen += row.bytes
    assert [r.chunk_id for r in after] == want


def test_dataset_head(spark):
    corpus = spark.range(0, 500, 1, 9).selectExpr("(id * 37) % 500 as seq", "'x' as text")
    assert sorted(r.seq for r in dataset_head(corpus, 12).collect()) == list(range(12))
    assert dataset_head(corpus, 10_000).count() == 500


def test_open_dataset(spark, tmp_path):
    one, two = str(tmp_path / "one"), str(tmp_path / "two")
    write_dataset(chunk_frame(spark, [0, 1]), one, by_directory=True)
    write_dataset(chunk_frame(spark, [0]), two)
    session = OpenDataset(spark)
    first = session.open(one, keep_loaded=True)
    assert session.open(one, keep_loaded=True) is first and first.is_cached
    assert spark.table("dataset").count() == 2
    assert not session.open(one).is_cached
    second = session.open(two)
    assert spark.table("dataset").count() == second.count() == 1
    assert session.open(two, force_reload=True) is not second
    session.close()
    assert not spark.catalog.tableExists("dataset")


def test_null_pages(spark):
    pages = spark.createDataFrame([("a", "x"), (None, "x"), ("a", None)], "title string, text string")
    assert clean.drop_null_pages(pages).count() == 1


def test_staged_tables(spark):
    table = staged(spark.range(10).toDF("seq"), "numbers")
    [folder] = {os.path.dirname(path.removeprefix("file://")) for path in table.inputFiles()}
    assert table.count() == 10 and os.path.isdir(folder)
    drop_staged(spark)
    assert not os.path.exists(folder)


def test_shared_folder_setting(spark, tmp_path):
    class Session:
        conf = {"spark.checkpoint.dir": f"{tmp_path}/"}

    assert shared_folder(Session) == str(tmp_path)

    class Cluster:
        conf = {}

        class sparkContext:
            master = "spark://host:1"

    with pytest.raises(ValueError):
        shared_folder(Cluster)


class Counted:
    """A file that counts the bytes read from it."""

    def __init__(self, path):
        self.file, self.bytes = open(path, "rb"), 0

    def read(self, size=-1):
        data = self.file.read(size)
        self.bytes += len(data)
        return data

    def __getattr__(self, name):
        return getattr(self.file, name)


def chunk_file(tmp_path, rows, number=0, **options):
    schema = pa.schema([pa.field(n, t, nullable=False) for n, t in chunk_files.FILE_FIELDS])
    batch = pa.RecordBatch.from_pylist([{"title": t, "text": x} for t, x in rows], schema)
    path = f"{tmp_path}/set-{number}.rb"
    with pa.ipc.new_file(path, schema, options=pa.ipc.IpcWriteOptions(**options)) as out:
        out.write_batch(batch)
    return path


def drained(reader, task):
    return [row for batch in reader.read(task) for row in batch.to_pylist()]


def test_sizes_touch_no_text(tmp_path):
    path = chunk_file(tmp_path, [(f"t{k}", b"x" * 100_000) for k in range(100)])
    reader = chunk_files._Reader(f"{tmp_path}/set", False, True, 1)
    counted = Counted(path)
    piece = chunk_files._Piece(0, path, 0, 1)
    rows = [r for b in reader._rows(piece, pa.PythonFile(counted, mode="r")) for r in b.to_pylist()]
    assert [r["bytes"] for r in rows] == [100_000] * 100
    assert counted.bytes < 20_000  # of ten million


def test_a_large_file_is_read_by_several_tasks(tmp_path, monkeypatch):
    monkeypatch.setattr(chunk_files, "MOST_TASK", 10_000)
    monkeypatch.setattr(chunk_files, "LEAST_TASK", 10_000)
    monkeypatch.setattr(chunk_files, "BATCH_BYTES", 700)
    rows = [(f"t{k}", bytes([k % 256]) * (k * 7 % 1500)) for k in range(300)]
    path = chunk_file(tmp_path, rows)
    reader = chunk_files._Reader(f"{tmp_path}/set", False, False, 4)
    tasks = reader.partitions()
    assert len(tasks) > 10 and all(len(task.pieces) == 1 for task in tasks)
    read = [row for task in tasks for row in drained(reader, task)]
    assert [(r["title"], r["text"]) for r in read] == rows
    assert [r["seq"] for r in read] == list(range(300))
    for task in tasks:
        for batch in reader.read(task):
            assert batch.num_rows == 1 or sum(map(len, batch.column("text").to_pylist())) <= 700
    # A part reads its own bytes, and little else.
    counted = Counted(path)
    list(reader._rows(tasks[3].pieces[0], pa.PythonFile(counted, mode="r")))
    assert counted.bytes < 2.5 * sum(len(r["text"]) for r in drained(reader, tasks[3])) + 4_000


def test_small_files_share_a_task(tmp_path):
    for number in range(20):
        chunk_file(tmp_path, [("a", b"1"), ("b", b"")], number)
    reader = chunk_files._Reader(f"{tmp_path}/set", False, False, 2)
    [task] = reader.partitions()
    rows = drained(reader, task)
    assert [r["chunk_id"] for r in rows] == [k // 2 for k in range(40)]
    assert [r["text"] for r in rows] == [b"1", b""] * 20


@pytest.mark.parametrize("rows", [[], [("", b"")], [("é", b"\0"), ("", b""), ("z", b"abc")]])
@pytest.mark.parametrize("compression", [None, "zstd"])
def test_odd_batches(tmp_path, rows, compression):
    chunk_file(tmp_path, rows, compression=compression)
    reader = chunk_files._Reader(f"{tmp_path}/set", False, False, 1)
    [task] = reader.partitions()
    assert [(r["title"], r["text"]) for r in drained(reader, task)] == rows


def test_only_files_asked_for_are_opened(spark, tmp_path):
    for number in range(12):
        chunk_file(tmp_path, [(f"{number}", b"1"), ("b", b"22")], number)
    prefix = f"{tmp_path}/set"
    for number in (0, 1, 2, 3, 4, 5, 7, 8, 11):
        with open(f"{prefix}-{number}.rb", "wb") as broken:
            broken.write(b"broken")
    ids = lambda df: sorted(r["chunk_id"] for r in df.collect())
    assert ids(read_chunks(spark, prefix, [6])) == [6, 6]
    assert ids(read_chunks(spark, prefix, (9, 6, 40, 9))) == [6, 6, 9, 9]
    assert ids(read_chunk_sizes(spark, prefix, range(9, 11))) == [9, 9, 10, 10]
    assert ids(read_chunks(spark, prefix, [50])) == ids(read_chunks(spark, prefix, [])) == []
    with pytest.raises(Exception, match="Arrow"):
        read_chunks(spark, prefix).collect()


def chunk_set(spark, text, n_chunks):
    rows = [(k, k * 10, f"t{k}", text) for k in range(n_chunks)]
    return spark.createDataFrame(rows, "chunk_id int, seq long, title string, text binary")


@pytest.mark.parametrize("moved", [0, 1, 3])
@pytest.mark.parametrize("then", ["read", "write"])
def test_a_stopped_commit_is_finished(spark, tmp_path, monkeypatch, moved, then):
    prefix = f"{tmp_path}/set"
    write_chunks(chunk_set(spark, b"old", 6), prefix)
    schema = pa.schema([("chunk_id", pa.int32()), ("title", pa.string()), ("text", pa.binary())])
    batch = pa.RecordBatch.from_pylist(
        [{"chunk_id": k, "title": f"t{k}", "text": b"new"} for k in range(4)], schema
    )
    writer = chunk_files._Writer({"path": prefix})
    message = writer.write(iter([batch]))
    moves, move = [], chunk_files._move

    def stopping(files, source, target):
        if len(moves) == moved:
            raise OSError("the driver is gone")
        moves.append(target)
        move(files, source, target)

    with monkeypatch.context() as patch:
        patch.setattr(chunk_files, "_move", stopping)
        with pytest.raises(OSError):
            writer.commit([message])
        writer.abort([message])
    if then == "write":
        write_chunks(chunk_set(spark, b"newer", 5), prefix)
    rows = read_chunks(spark, prefix).collect()
    want = b"new" if then == "read" else b"newer"
    assert sorted((r.chunk_id, bytes(r.text)) for r in rows) == [
        (k, want) for k in range(4 if then == "read" else 5)
    ]
    assert sorted(os.listdir(tmp_path)) == [f"set-{k}.rb" for k in range(len(rows))]


def test_a_commit_stopped_before_its_journal_changes_nothing(spark, tmp_path):
    prefix = f"{tmp_path}/set"
    write_chunks(chunk_set(spark, b"old", 2), prefix)
    writer = chunk_files._Writer({"path": prefix})
    schema = pa.schema([("chunk_id", pa.int32()), ("title", pa.string()), ("text", pa.binary())])
    message = writer.write(iter([pa.RecordBatch.from_pylist([{"chunk_id": 0, "title": "t", "text": b"x"}], schema)]))
    assert {bytes(r.text) for r in read_chunks(spark, prefix).collect()} == {b"old"}
    writer.abort([message])
    assert sorted(os.listdir(tmp_path)) == ["set-0.rb", "set-1.rb"]
