"""Every registered query against its SQL, on whole tables."""

import sys
from collections import Counter
from decimal import Decimal
from pathlib import Path

import duckdb
import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

import __spark_entry__ as contract  # noqa: E402
from lexisweep.registered import ORACLES, QUERIES  # noqa: E402

TABLES = """region nation customer supplier part orders lineitem events documents
embeddings pages benchmark labels conversations""".split()


@pytest.fixture(scope="module")
def sql(data):
    connection = duckdb.connect()
    for name in TABLES:
        connection.execute(f"create view {name} as select * from '{data}/{name}.parquet'")
    return connection


def comparable(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])

    def plain(value):
        return float(value) if isinstance(value, Decimal) else value

    return Counter(tuple(plain(row[i]) for i in order) for row in rows)


def test_all_are_in_the_contract():
    assert QUERIES.items() <= contract.queries().items()
    assert ORACLES.items() <= contract.oracle_sql().items()


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(name, spark, data, sql):
    df = QUERIES[name](spark, data)
    got = comparable(df.columns, df.collect())
    cursor = sql.execute(ORACLES[name])
    columns = [column[0] for column in cursor.description]
    want = comparable(columns, cursor.fetchall())
    assert sorted(df.columns) == sorted(columns)
    assert got == want, (list((got - want).items())[:3], list((want - got).items())[:3])
    assert want


def test_entry(spark):
    df = contract.entry(spark)
    assert df.columns == ["rank", "band", "title", "count", "all_known"]
    assert df.count() > 0
