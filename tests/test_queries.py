"""Every registered query against its SQL, on the smallest data set."""

import duckdb
import pytest

import __spark_entry__ as entry
from tests.conftest import SF
from workload.registry import with_views

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings",
          "pages", "benchmark", "labels", "conversations"]
QUERIES, SQL = entry.queries(), entry.oracle_sql()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{SF}/{name}.parquet'")
    return con


def _plain(value):
    if value is None:
        return "NULL"
    if isinstance(value, (bool, str)):
        return str(value)
    return repr(round(float(value), 6) + 0.0)


def _rows(rows, columns):
    order = sorted(range(len(columns)), key=columns.__getitem__)
    return sorted(tuple(_plain(row[i]) for i in order) for row in rows)


def test_every_sql_has_a_query():
    assert set(SQL) <= set(QUERIES)


@pytest.mark.parametrize("name", sorted(SQL))
def test_matches_sql(spark, duck, name):
    frame = QUERIES[name](spark, SF)
    cursor = duck.execute(SQL[name])
    columns = [c[0] for c in cursor.description]
    assert sorted(frame.columns) == sorted(columns)
    assert _rows(frame.collect(), frame.columns) == _rows(cursor.fetchall(), columns)


def test_bpe_ranks(spark):
    merges = QUERIES["bpe_merges"](spark, SF).orderBy("rank").collect()
    assert [m["rank"] for m in merges] == list(range(1, len(merges) + 1)) and len(merges) > 50
    rows = QUERIES["encode_bpe"](spark, SF).collect()
    assert rows and all(r["same"] for r in rows)


def test_first_merges_match_sql(spark, duck):
    """The whole list goes on where the SQL for a small vocabulary ends."""
    merges = [(m["left"], m["right"]) for m in QUERIES["bpe_merges"](spark, SF).orderBy("rank").collect()]
    steps = duck.execute(with_views("SELECT DISTINCT k, l, r FROM bpe_steps WHERE k > 0 ORDER BY k")).fetchall()
    assert len(merges) > 1_000 > len(steps) > 50 and merges[: len(steps)] == [(left, right) for _, left, right in steps]


def test_entry(spark):
    assert entry.entry(spark).columns == ["pair", "src_lang", "tgt_lang", "line_no", "src", "tgt"]
