import sys
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parents[2]))
sys.path.insert(0, str(Path(__file__).resolve().parent))

import test_neardup  # noqa: E402
import test_packing  # noqa: E402
import test_repeats  # noqa: E402
import test_secrets  # noqa: E402

import corpus_pipeline  # noqa: E402
from lexisweep.staging import staged  # noqa: E402

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def masked(rows):
    """rows: (doc_id, text, source, repository)."""
    out = {}
    for (i, text, _, _), found in zip(rows, test_secrets.live_spans(rows)):
        marks = set()
        for a, b in found:
            marks.update(range(a, b))
        kept = []
        for k, c in enumerate(text):
            if k not in marks:
                kept.append(c)
            elif k - 1 not in marks:  # overlapping and touching spans are one
                kept.append("[secret]")
        out[i] = "".join(kept)
    return out


def test_stages(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet")
    assert [name for name, _ in corpus_pipeline.STAGES] == ["quality", "near_duplicates", "repeats", "secrets", "packing"]
    steps = [docs]
    for name, stage in corpus_pipeline.STAGES:
        steps.append(staged(stage(spark, steps[-1], data), name))
    raw, good, single, cut, safe, packed = ([r for r in s.collect()] for s in steps)
    for step in steps[1:5]:
        assert step.columns == COLUMNS and step.dtypes == docs.dtypes
    texts = lambda rows: [(r.doc_id, r.text) for r in rows]
    # Good documents pass unchanged; labels agree.
    assert set(texts(good)) < set(texts(raw))
    marks = dict(spark.read.parquet(f"{data}/labels.parquet").select("doc_id", "quality").collect())
    kept = {r.doc_id for r in good}
    assert sum(marks[i] != (i in kept) for i in marks) <= 0.01 * len(marks)
    # One document of each component.
    want = [i for i, _, _, first in test_neardup.expected(texts(good)) if first]
    assert sorted(r.doc_id for r in single) == sorted(want)
    # Repeated sentences are cut.
    plain = test_repeats.plain(texts(single))
    assert sorted(texts(cut)) == sorted((i, t) for i, t, n in plain if not n or t.strip())
    # Live-looking secrets are masked, nothing else changes.
    rows = [(r.doc_id, r.text, r.source, f"{r.source}/{r.lang}") for r in cut]
    assert dict(texts(safe)) == masked(rows)
    assert all(r.n_chars == len(r.text) for r in safe)
    test_packing.check(texts(safe), packed, 2048)


def test_run_on_empty(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(
        str(tmp_path / "documents.parquet")
    )
    assert corpus_pipeline.run(spark, str(tmp_path)).collect() == []


FIRST = "The river runs by the old mill and turns to the sea. Nobody minds it one year with another. The mill stands."
OTHER = "A baker rose before dawn and lit her oven with care. Loaves filled the whole window by seven."
SECRET = "Settings of the service follow here for all who care to read them today. password = Zx81hunter2Qq0"


def odd_documents(spark):
    """Nulls, an empty and a very long text, copies, a repeated row, and columns
    with the names of inner ones."""
    rows = [
        (1, FIRST, "en", "s"),
        (1, FIRST, "en", "s"),
        (2, FIRST, "fr", "t"),
        (3, None, None, None),
        (4, "", "en", None),
        (None, OTHER, "en", "s"),
        (5, " ".join(f"word{k}" for k in range(40_000)), "en", "s"),
        (6, SECRET, None, None),
    ]
    schema = (
        "doc_id long, text string, lang string, source string, n_chars long, "
        "digest string, cuts string, score string, class string, row string"
    )
    return rows, spark.createDataFrame(
        [(i, t, g, s, None if t is None else len(t), *"abcde") for i, t, g, s in rows], schema
    )


def sorted_texts(rows):
    return sorted(((r[0], r[1]) for r in rows), key=repr)


def test_stages_on_odd_rows(spark, data):
    rows, docs = odd_documents(spark)
    stages, found = dict(corpus_pipeline.STAGES), {}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, data)
        found[name] = out.collect()
        if name != "packing":
            assert out.columns == docs.columns and out.dtypes == docs.dtypes
            assert all(tuple(r)[5:] == tuple("abcde") for r in found[name])
            assert stage(spark, docs.limit(0), data).collect() == []
    # Texts without words are not kept; each row counts for itself.
    assert {r.doc_id for r in found["quality"]} <= {1, 2, 5, 6, None}
    assert sorted_texts(found["near_duplicates"]) == sorted_texts(r for k, r in enumerate(rows) if k not in (1, 2))
    assert sorted_texts(found["repeats"]) == sorted_texts(r for r in rows if r[0] != 2)
    rows[-1] = (6, masked([(6, SECRET, "", "")])[6])
    assert "Zx81" not in rows[-1][1]
    assert sorted_texts(found["secrets"]) == sorted_texts(rows)
    assert stages["packing"](spark, docs.limit(0), data).collect() == []
    whole = [(i, t) for i, t, *_ in odd_documents(spark)[0][1:]]
    packed = stages["packing"](spark, docs.dropDuplicates(["doc_id", "text"]), data).collect()
    test_packing.check(whole, packed, 2048)
