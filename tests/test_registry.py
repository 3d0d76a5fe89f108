"""The driver contract, and a cross-section of queries against their twins."""

import os
import subprocess
import sys

import duckdb
import pytest

import __spark_entry__ as entry
from tests.oracle_check import TABLES, norm

SAMPLE = ("bars_1h", "bars_two_weeks", "session_levels", "ind_wma", "ind_adx", "ind_trix", "asof_trade", "range_subtract", "gap_plan", "bt_known_at",
          "bt_calendar", "bt_compare", "ref_statements", "ref_yield_curve", "store_replace_days", "trailing_rows", "cmp_bars", "etl_week_finalise",
          "stream_quotes", "sql_functions_date")


def test_every_query_has_a_twin():
    assert set(entry.plans.queries()) == set(entry.plans.oracle_sql())
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_registers_before_there_is_a_session():
    code = "import __spark_entry__ as e; assert set(e.oracle_sql()) <= set(e.queries())"
    subprocess.run([sys.executable, "-c", code], check=True, timeout=120, cwd=os.path.dirname(entry.__file__))


def test_entry_has_rows(spark):
    assert entry.entry(spark).limit(1).count() == 1


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", SAMPLE)
def test_query_equals_twin(spark, sf, duck, name):
    df = entry.queries()[name](spark, sf)
    cols = sorted(df.columns)
    got = sorted([norm(r[c]) for c in cols] for r in df.collect())
    rel = duck.execute(entry.oracle_sql()[name])
    names = [d[0] for d in rel.description]
    assert cols == sorted(names)
    order = [names.index(c) for c in cols]
    assert got == sorted([norm(r[i]) for i in order] for r in rel.fetchall())
