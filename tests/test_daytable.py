"""Plain tables: partitions replaced, pruned and counted."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from marketloom.operators import etl
from marketloom.sources import daytable, external
from marketloom.sources import schema as sc


def rows(spark, data):
    return spark.createDataFrame([(s, dt.datetime(2024, 1, d, h), float(p)) for s, d, h, p in data], "symbol string, date timestamp, price double")


def test_partitions(spark, tmp_path):
    first = [(s, d, h, d * 10 + h) for s in ("A", "B", "7") for d in (1, 2, 3, 5) for h in (1, 9)]
    table = daytable.DayTable(spark, str(tmp_path / "t"), rows(spark, first).schema)
    table.write(rows(spark, first))
    table.write(rows(spark, [("A", 2, 4, -1), ("A", 9, 1, -2), ("C", 1, 1, -3)]))  # replaces one day, adds two
    want = {x for x in first if x[:2] != ("A", 2)} | {("A", 2, 4, -1), ("A", 9, 1, -2), ("C", 1, 1, -3)}
    got = {(r.symbol, r.date.day, r.date.hour, r.price) for r in table.read().collect()}
    assert got == {(*x[:3], float(x[3])) for x in want}
    some = table.read(["A", "7"], "2024-01-02", "2024-01-03", ["price"])
    assert some.columns == ["symbol", "date", "price"] and {(r.symbol, r.date.day) for r in some.collect()} == {("A", 2), ("A", 3), ("7", 2), ("7", 3)}
    plan = some._jdf.queryExecution().executedPlan().toString()
    pruned = plan.split("PartitionFilters: [")[1].split("]")[0]
    assert "period#" in pruned and "symbol#" in pruned
    assert {(r.symbol, r.date.day) for r in table.newest_period().collect()} == {("A", 9), ("B", 5), ("7", 5), ("C", 1)}
    for n in (1, 3, 100):
        newest = {(r.symbol, r.date) for r in table.trailing(n).collect()}
        by = {}
        for r in sorted(table.read().collect(), key=lambda r: r.date, reverse=True):
            by.setdefault(r.symbol, []).append(r.date)
        assert newest == {(s, d) for s, dates in by.items() for d in dates[:n]}


def test_external_names(spark, tmp_path):
    rows(spark, [("A", 1, 1, 1)]).write.parquet(str(tmp_path / "x"))
    cat = external.register(spark, {"ext_x": str(tmp_path / "x")}).first()
    assert cat.columns == ["symbol string", "date timestamp", "price double"]
    span = external.spans(spark, ["ext_x"]).first()
    assert (span["name"], span["rows"], span["first"], span["last"]) == ("ext_x", 1, dt.datetime(2024, 1, 1, 1), dt.datetime(2024, 1, 1, 1))
    with pytest.raises(ValueError, match="no table name"):
        external.register(spark, {"a b": "x"})


def test_one_pass_types_all_text(spark):
    df = spark.createDataFrame([("x", None, "2024-01-02"), ("y", None, "2024-02-03 04:05:06"), ("z", None, None)], "a string, b string, c string")
    out = sc.normalize_dates(df)
    assert out.columns == ["date", "a", "b"] and [r.date for r in out.orderBy("a").collect()] == [dt.datetime(2024, 1, 2), dt.datetime(2024, 2, 3, 4, 5, 6), None]
    plain = spark.createDataFrame([("x",)], "a string")
    assert sc.normalize_dates(plain).columns == ["a"]


def test_newest_week_of_columns_is_that_of_the_driver(spark):
    stamps = [dt.datetime(2024, 3, d, h) for d in range(1, 15) for h in (0, 7, 8, 23)]
    df = spark.createDataFrame([(s,) for s in stamps], "now timestamp")
    got = {r.now: r.week for r in df.select("now", etl.newest_complete_week(F.col("now")).alias("week")).collect()}
    assert got == {s: etl.latest_complete_monday(s) for s in stamps}
