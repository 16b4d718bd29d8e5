"""Queries against their SQL on tables with what the given ones rarely show: closes of 0, texts of few sentences."""

import datetime as dt

import duckdb
import pytest

from finloom.plans import catalog

from .compare import differences


def held(spark, folder, name, rows, schema):
    """A table written to folder, and a connection that sees it."""
    spark.createDataFrame(rows, schema).coalesce(1).write.mode("overwrite").parquet(f"{folder}/{name}.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{folder}/{name}.parquet/*.parquet'")
    return con


@pytest.fixture(scope="module")
def prices(spark, tmp_path_factory):
    """Days of three users, of whom two have a close of 0: it is the base of an event and of a return."""
    folder = str(tmp_path_factory.mktemp("events"))
    day = lambda i: dt.datetime(2024, 1, 1 + i, 12)
    rows = [(u * 100 + i, day(i), u, "error" if i < 3 else "view", 0.0 if u < 3 and i == 2 else 10.0 + u * i, "{}") for u in (1, 2, 3) for i in range(12) if (u, i) != (2, 7)]
    rows.append((999, day(7), 2, "view", 0.0, "{}"))
    return folder, held(spark, folder, "events", rows, "event_id long, ts timestamp, user_id long, event_type string, value double, props string")


def test_daily_returns_against_zero(spark, prices):
    folder, con = prices
    assert differences(catalog.QUERIES["daily_returns"](spark, folder), con, catalog.ORACLES["daily_returns"]) == []


@pytest.mark.parametrize("name", ["event_study", "label_summary", "label_purity"])
def test_studies_of_a_base_of_zero(spark, prices, name):
    folder, con = prices
    assert differences(catalog.QUERIES[name](spark, folder), con, catalog.ORACLES[name]) == []


def test_windows_of_short_texts():
    """Texts of two and three sentences have equal windows: whatever their order, they are one."""
    con = duckdb.connect()
    con.execute("CREATE VIEW documents AS SELECT i AS doc_id, ['1. 2. 3', '4. 5'][i % 2 + 1] AS text FROM range(300000) t(i)")
    found = con.execute(f"SELECT count(*), min(first), max(first), sum(last) FROM ({catalog.ORACLES['candidate_windows']})").fetchone()
    assert found == (300_000, 0, 0, 450_000)


@pytest.mark.parametrize("name", ["filing_notes", "section_health", "body_notes", "named_chunks"])
def test_texts_of_one_file_go_to_many_tasks(spark, name):
    """Texts are shuffled by document before they are searched, not in the one task that reads a file of one row group."""
    plan = catalog.QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert "RepartitionByExpression [doc_id" in plan
