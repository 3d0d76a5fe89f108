import os

import duckdb
import pytest

import __spark_entry__ as entry


@pytest.fixture(scope="module")
def repeated(tmp_path_factory, sf):
    """Events that fall on the same hours of the same users, many times over."""
    folder = str(tmp_path_factory.mktemp("repeated"))
    base = os.path.join(os.path.dirname(sf), "sf0.1")
    duckdb.connect().execute(
        f"COPY (SELECT event_id + 100000 * k AS event_id, * EXCLUDE (event_id, k) FROM '{base}/events.parquet', range(6) AS r(k)) "
        f"TO '{folder}/events.parquet' (FORMAT parquet)")
    return folder


def test_equal_ranges_leave_the_coalesce_twin_nothing_to_chance(spark, repeated):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW events AS SELECT * FROM '{repeated}/events.parquet'")
    twin = entry.oracle_sql()["range_coalesce"]
    # walked by hand: a range opens an island when it starts over an hour past what was reached
    want, reach = set(), {}
    hours = con.execute("SELECT DISTINCT CAST(user_id AS VARCHAR), date_trunc('hour', ts) AS s, date_trunc('hour', ts) + INTERVAL 5 HOUR AS e "
                        "FROM events ORDER BY 1, 2").fetchall()
    for sym, s, e in hours:
        if sym in reach and (s - reach[sym][1]).total_seconds() <= 3600:
            reach[sym][1] = e
        else:
            if sym in reach:
                want.add((sym, *reach[sym]))
            reach[sym] = [s, e]
    want |= {(sym, *r) for sym, r in reach.items()}
    for _ in range(3):
        got = con.execute(twin).fetchall()
        assert len(got) == len(want) and set(got) == want
    rows = [(r.sym, r.s, r.e) for r in entry.queries()["range_coalesce"](spark, repeated).collect()]
    assert len(rows) == len(want) and set(rows) == want
