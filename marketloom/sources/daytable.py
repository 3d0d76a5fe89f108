"""Plain Parquet tables cut by symbol and period: replaced by partition, read by partition.

A table is nothing but its folders, so any reader can use it. Writing replaces the
(symbol, period) partitions that the new rows touch and leaves the others; reads prune by
symbol and period before any file is opened, and counts read footers alone.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from marketloom.operators.topk import newest
from marketloom.sources.store import bounds


@dataclass(frozen=True)
class DayTable:
    """Rows of `schema` (with `symbol` and `date`) under `path`, one folder per symbol and `grain`."""

    spark: SparkSession
    path: str
    schema: T.StructType
    grain: str = "day"

    def _period(self, at: Column) -> Column:
        return F.date_trunc(self.grain, at).cast("date")

    def write(self, rows: DataFrame) -> None:
        """Replace the partitions that `rows` touch, by one job; each holds whole periods."""
        (rows.select(*self.schema.names).withColumn("period", self._period(F.col("date"))).repartition("symbol", "period")
         .sortWithinPartitions("symbol", "period", "date").write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
         .option("compression", "zstd").partitionBy("symbol", "period").parquet(self.path))

    def _table(self) -> DataFrame:
        held = [f for f in self.schema.fields if f.name != "symbol"]
        return self.spark.read.schema(T.StructType([*held, self.schema["symbol"], T.StructField("period", T.DateType())])).parquet(self.path)

    def read(self, symbols: list[str] | None = None, start: str | None = None, end: str | None = None, columns: list[str] | None = None) -> DataFrame:
        """Rows within [start, end]; a bare date as end covers that day. A projection keeps `symbol` and `date`."""
        rows = self._table()
        if symbols:
            rows = rows.where(F.col("symbol").isin(symbols))
        if start:
            rows = rows.where(F.col("period") >= self._period(F.lit(start).cast("timestamp")))
        if end:
            rows = rows.where(F.col("period") <= self._period(F.lit(end).cast("timestamp")))
        wanted = self.schema.names if columns is None else ["symbol", "date", *[c for c in columns if c not in ("symbol", "date")]]
        return rows.where(bounds(start, end)).select(*wanted)

    def trailing(self, n: int) -> DataFrame:
        """The newest n rows per symbol, reading only the periods that can hold them."""
        table = self._table()
        newer = Window.partitionBy("symbol").orderBy(F.col("period").desc()).rowsBetween(Window.unboundedPreceding, -1)
        counts = table.groupBy("symbol", "period").agg(F.count("*").alias("_n"))
        reach = counts.withColumn("_newer", F.coalesce(F.sum("_n").over(newer), F.lit(0))).where(F.col("_newer") < n)
        rows = table.join(reach.select("symbol", "period"), ["symbol", "period"], "left_semi")
        return newest(rows, n, ("symbol",), (F.col("date").desc(),)).select(*self.schema.names)

    def newest_period(self) -> DataFrame:
        """Each symbol's rows of its newest period."""
        table = self._table()
        last = table.groupBy("symbol").agg(F.max("period").alias("period"))
        return table.join(last, ["symbol", "period"], "left_semi").select(*self.schema.names)


def flush_day(table: DayTable, ticks: DataFrame, day: str) -> DataFrame:
    """Write one UTC day of ticks, replacing that day; rows per symbol as read back."""
    table.write(ticks.where(bounds(day, day, "time")).withColumnsRenamed({"sym": "symbol", "time": "date"}))
    return table.read(start=day, end=day).groupBy("symbol").agg(F.count("*").alias("rows"))


def load_and_verify(table: DayTable, rows: DataFrame, interval: str) -> DataFrame:
    """Write, read back, resample: rows offered, stored and resampled per symbol, PASS when
    stored equals offered and something came out of the resample."""
    from marketloom.operators.bars import resample

    table.write(rows)
    back = table.read()
    n = lambda df, name: df.groupBy("symbol").agg(F.count("*").alias(name))
    out = n(rows, "offered").join(n(back, "stored"), "symbol", "left").join(n(resample(back, interval), "resampled"), "symbol", "left")
    return out.withColumn("status", F.when((F.col("stored") == F.col("offered")) & (F.col("resampled") > 0), "PASS").otherwise("FAIL"))
