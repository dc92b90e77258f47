import sys
from pathlib import Path

import duckdb

sys.path.insert(0, str(Path(__file__).resolve().parent))

import test_neardup  # noqa: E402
import test_secrets  # noqa: E402

from lexisweep.llm import oracles, registered  # noqa: E402


def rows(data, sql):
    connection = duckdb.connect()
    connection.execute(f"create view documents as select * from '{data}/documents.parquet'")
    return connection.execute(sql).fetchall()


def test_neardup_sql(data):
    texts = rows(data, "select doc_id, text from documents")
    assert sorted(rows(data, oracles.NEARDUP)) == test_neardup.expected(texts)


def test_secrets_sql(data):
    texts = rows(data, "select doc_id, text, source, source || '/' || lang from documents")
    assert sorted(rows(data, oracles.SECRETS)) == sorted(test_secrets.expected(texts))


def test_registered():
    assert set(registered.ORACLES) == {"op5_secrets", "op8_neardup", "op11_spelling", "op13_filter_audit"}
