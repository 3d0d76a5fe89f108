"""Work that is done once: stamps, file names and counts per day."""

from datetime import date

from pyspark.sql import functions as F

from marketloom.operators import quality
from marketloom.sources import ticks as tk
from tests.test_shaping_reads import plan, rows

STAMPS = ["2024-01-05 09:30:00", "2024-01-05 09:30:00.1", "2024-01-05 09:30:00.12345", "2024-01-05 09:30:00.123456",
          "2024-01-05 09:30:00.1234567", "2024-01-05T09:30:00.123", "2024-01-05T09:30:00.1", "2024-01-05 09:30", "2024-1-5 09:30:00",
          "2024-02-30 09:30:00", "2024-01-05 24:00:00", "2024-01-05 09:60:00", "0000-01-05 09:30:00", "0001-01-05 09:30:00",
          "01/05/2024 09:30:00", "2024-01-05", " 2024-01-05 09:30:00", "2024-01-05 09:30:00\n", "2024-01-05 09:30:00Z", "", None]


def test_plain_stamps_are_cast_to_what_the_layouts_say(spark):
    df = spark.createDataFrame([(s,) for s in STAMPS], "t string")
    slow = F.coalesce(*[F.try_to_timestamp("t", F.lit(f)) for f in tk.STAMPS])
    got = df.select("t", tk.local_stamp(F.col("t")).cast("string").alias("fast"), slow.cast("string").alias("slow")).collect()
    assert len(got) == len(STAMPS) and all(r.fast == r.slow for r in got), got


def test_tick_files_work_out_no_problem_in_a_filter(spark, tmp_path):
    folder = tmp_path / "AA_trades_x" / "day"
    (folder / "f=BRK.B_trades_2024").mkdir(parents=True)
    (folder / "f=BRK.B_trades_2024" / "part-0.txt").write_text("2024-01-05 09:30:00,1.5,2,N,\n")
    (folder / "f=CC_quotes").mkdir()
    (folder / "f=CC_quotes" / "part-0.txt").write_text("2024-03-10 02:30:00,1,2,N,1,2,N\n2024-03-11 02:30:00,1,2,N,1,2,N\n")
    parsed = tk.read(spark, str(folder))
    assert {(r.symbol, r.kind, r.problem) for r in parsed.collect()} == {
        ("BRK.B", "trade", None), ("CC", "quote", "nonexistent local time"), ("CC", "quote", None)}
    sound = tk.sound_files(parsed)
    assert [r.symbol for r in sound.collect()] == ["BRK.B"]
    assert not any("Filter" in line and "utc_timestamp" in line for line in plan(sound).splitlines())


def test_counts_by_day_join_nothing(spark):
    d1, d2 = date(2024, 1, 1), date(2024, 1, 2)
    a = spark.createDataFrame([("x", d1), ("x", d1), (None, d1), ("y", None)], "symbol string, date date")
    b = spark.createDataFrame([("x", d1), ("z", d2)], "symbol string, date date")
    got = quality.counts_by_day(a, b)
    assert {tuple(r) for r in got.collect()} == {("x", d1, 2, 1, False), (None, d1, 1, 0, False), ("y", None, 1, 0, False), ("z", d2, 0, 1, False)}
    assert "Join" not in plan(got) and len(rows(got)) == 4
    assert [t for _, t in got.dtypes] == ["string", "date", "bigint", "bigint", "boolean"]
