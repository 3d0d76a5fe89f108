"""Versioned tables on Parquet: overwrite, append, replace days, read as of.

Layout: `<root>/<library>/data/_commit=N/day=D/` holds the rows of one commit of
many symbols, clustered by symbol; `<root>/<library>/commits/` holds one row per
commit and symbol with per-day counts and bounds. A commit exists once its rows in
`commits` do. One writer per library at a time. `grain` is the span of one `day`
folder: days for ticks, months or years for bars, so that folders stay large.
"""

from __future__ import annotations

import json
from dataclasses import dataclass
from datetime import date, datetime, timedelta, timezone

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from marketloom.operators.topk import latest, newest

COMMIT_SCHEMA = (
    "library string, symbol string, version bigint, commit bigint, ts timestamp, op string, "
    "meta map<string,string>, schema string, rows bigint, min_date timestamp, max_date timestamp, "
    "days array<struct<day:date,rows:bigint,min_date:timestamp,max_date:timestamp>>")
#: What each operation does to earlier rows of a symbol (fixed values).
OPS = ("overwrite", "append", "replace_days", "delete")


def bounds(start: str | None, end: str | None, column: str = "date") -> Column:
    """Inclusive range; a bare date as end covers that whole day."""
    c, out = F.col(column), F.lit(True)
    if start:
        out = out & (c >= F.lit(start).cast("timestamp"))
    if end:
        upper = F.lit(end).cast("timestamp")
        whole_day = len(str(end).strip()) == 10
        out = out & (c < upper + F.expr("INTERVAL 1 DAY") if whole_day else c <= upper)
    return out


@dataclass(frozen=True)
class Store:
    spark: SparkSession
    root: str
    library: str
    grain: str = "day"

    def _period(self, c: Column) -> Column:
        return F.date_trunc(self.grain, c).cast("date")

    @property
    def _data(self) -> str:
        return f"{self.root.rstrip('/')}/{self.library}/data"

    @property
    def _log(self) -> str:
        return f"{self.root.rstrip('/')}/{self.library}/commits"

    def _fs(self, path: str):
        p = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark._jsc.hadoopConfiguration()), p

    def _exists(self, path: str) -> bool:
        fs, p = self._fs(path)
        return fs.exists(p)

    # --- reading the log ------------------------------------------------------------

    def commits(self) -> DataFrame:
        if not self._exists(self._log):
            return self.spark.createDataFrame([], COMMIT_SCHEMA)
        return self.spark.read.schema(COMMIT_SCHEMA).parquet(self._log)

    def symbols(self) -> DataFrame:
        """Symbols whose last commit is not a delete."""
        return latest(self.commits(), ("symbol",), (F.col("commit").desc(),)).filter("op <> 'delete'").select("symbol")

    def history(self) -> DataFrame:
        return self.commits().select("symbol", "version", "ts", "op", "rows").orderBy(
            F.col("ts").desc(), F.col("version").desc())

    def metadata(self) -> DataFrame:
        """Newest metadata per symbol, from the newest commit that carries any."""
        tagged = self.commits().filter("meta is not null")
        return latest(tagged, ("symbol",), (F.col("commit").desc(),)).select("symbol", "version", "meta")

    def _visible(self, version: int | None, as_of: str | datetime | None) -> DataFrame:
        log = self.commits()
        if version is not None:
            log = log.filter(F.col("version") <= version)
        if as_of is not None:
            log = log.filter(F.col("ts") <= F.lit(as_of).cast("timestamp"))
        return log

    def live(self, version: int | None = None, as_of: str | datetime | None = None) -> DataFrame:
        """(symbol, day, commit, rows, bounds) that make up the tables at a point: what
        came after the last overwrite or delete of the symbol and the last replacement
        of the day."""
        log = self._visible(version, as_of)
        floor = log.filter("op in ('overwrite', 'delete')").groupBy("symbol").agg(F.max("commit").alias("_floor"))
        entries = log.select("symbol", "commit", "op", F.inline("days"))
        swapped = entries.filter("op = 'replace_days'").groupBy("symbol", "day").agg(F.max("commit").alias("_day_floor"))
        return (entries.join(floor, "symbol", "left").join(swapped, ["symbol", "day"], "left")
                .filter((F.col("_floor").isNull() | (F.col("commit") >= F.col("_floor")))
                        & (F.col("_day_floor").isNull() | (F.col("commit") >= F.col("_day_floor"))))
                .select("symbol", "day", "commit", "rows", "min_date", "max_date"))

    def describe(self, version: int | None = None, as_of: str | None = None) -> DataFrame:
        """Row count, date span and columns per symbol, from the log alone."""
        spans = self.live(version, as_of).groupBy("symbol").agg(
            F.sum("rows").alias("rows"), F.min("min_date").alias("min_date"), F.max("max_date").alias("max_date"),
            F.count_distinct("day").alias("days"))
        newest_schema = latest(self._visible(version, as_of).filter("schema is not null"), ("symbol",), (F.col("commit").desc(),))
        return spans.join(newest_schema.select("symbol", "version", "schema"), "symbol", "left")

    # --- reading rows ------------------------------------------------------------------

    def read(self, symbols: list[str] | None = None, start: str | None = None, end: str | None = None,
             columns: list[str] | None = None, version: int | None = None,
             as_of: str | datetime | None = None, live: DataFrame | None = None) -> DataFrame:
        """Rows at a point in history. The range and the symbols prune days and files;
        a projection keeps `symbol` and `date`."""
        live = self.live(version, as_of) if live is None else live
        if symbols:
            live = live.filter(F.col("symbol").isin(symbols))
        if start:
            live = live.filter(F.col("day") >= self._period(F.lit(start).cast("timestamp")))
        if end:
            live = live.filter(F.col("day") <= self._period(F.lit(end).cast("timestamp")))
        # Commit numbers are few; with them only live folders are listed and read.
        live = live.select("symbol", "day", F.col("commit").alias("_commit"))
        numbers = [r[0] for r in live.select("_commit").distinct().collect()]
        schema = self._schema(version, as_of)
        if not numbers:
            empty = self.spark.createDataFrame([], schema)
            return empty.select("symbol", "date", *[c for c in columns or [] if c not in ("symbol", "date")]) if columns else empty
        stored = T.StructType([f for f in schema.fields] + [T.StructField("_commit", T.LongType()), T.StructField("day", T.DateType())])
        rows = (self.spark.read.schema(stored).option("basePath", self._data)
                .parquet(*[f"{self._data}/_commit={n}" for n in numbers]).filter(bounds(start, end)))
        if symbols:
            rows = rows.filter(F.col("symbol").isin(symbols))
        out = rows.join(live, ["symbol", "day", "_commit"], "left_semi").drop("_commit", "day")
        return out.select("symbol", "date", *[c for c in columns if c not in ("symbol", "date")]) if columns else out

    def _schema(self, version: int | None, as_of) -> T.StructType:
        row = (self._visible(version, as_of).filter("schema is not null").orderBy(F.col("commit").desc())
               .select("schema").limit(1).collect())
        if not row:
            raise LookupError(f"{self.library} holds nothing at that point")
        return T.StructType.fromJson(json.loads(row[0][0]))

    def trailing(self, n: int, symbols: list[str] | None = None, as_of: str | None = None) -> DataFrame:
        """The newest n rows per symbol, reading only the days that can hold them."""
        live = self.live(as_of=as_of)
        w = Window.partitionBy("symbol").orderBy(F.col("day").desc())
        per_day = live.groupBy("symbol", "day").agg(F.sum("rows").alias("rows"))
        reach = per_day.withColumn("_before", F.coalesce(
            F.sum("rows").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).filter(F.col("_before") < n)
        picked = live.join(reach.select("symbol", "day"), ["symbol", "day"], "left_semi")
        rows = self.read(symbols, as_of=as_of, live=picked)
        return newest(rows, n, ("symbol",), (F.col("date").desc(),)).drop("rank")

    def window(self, start: str | None = None, end: str | None = None, symbols: list[str] | None = None,
               as_of: str | None = None) -> DataFrame:
        """Days inside [start, end]; without bounds each symbol's newest day."""
        if start or end:
            return self.read(symbols, start, end, as_of=as_of)
        live = self.live(as_of=as_of)
        last = live.groupBy("symbol").agg(F.max("day").alias("day"))
        return self.read(symbols, as_of=as_of, live=live.join(last, ["symbol", "day"], "left_semi"))

    # --- writing -------------------------------------------------------------------------

    def _commit(self, rows: DataFrame | None, op: str, meta: dict[str, str] | None, ts: datetime | None,
                symbols: DataFrame | None = None) -> int:
        log = self.commits()
        number = (log.agg(F.max("commit")).first()[0] or 0) + 1
        ts = ts or datetime.now(timezone.utc)
        versions = log.groupBy("symbol").agg(F.max("version").alias("_v"))
        if rows is not None:
            schema = T.StructType([f for f in rows.schema.fields]).json()
            self._write_rows(rows, number)
            written = self.spark.read.option("basePath", self._data).parquet(f"{self._data}/_commit={number}")
            by_day = written.groupBy("symbol", "day").agg(
                F.count("*").alias("rows"), F.min(F.col("date").cast("timestamp")).alias("min_date"),
                F.max(F.col("date").cast("timestamp")).alias("max_date"))
            entries = by_day.groupBy("symbol").agg(
                F.sum("rows").alias("rows"), F.min("min_date").alias("min_date"), F.max("max_date").alias("max_date"),
                F.collect_list(F.struct("day", "rows", "min_date", "max_date")).alias("days"))
        else:
            schema, entries = None, symbols.select(
                "symbol", F.lit(0).cast("long").alias("rows"), F.lit(None).cast("timestamp").alias("min_date"),
                F.lit(None).cast("timestamp").alias("max_date"),
                F.array().cast("array<struct<day:date,rows:bigint,min_date:timestamp,max_date:timestamp>>").alias("days"))
        tags = F.create_map(*[F.lit(str(x)) for kv in meta.items() for x in kv]) if meta else F.lit(None).cast("map<string,string>")
        entries.join(versions, "symbol", "left").select(
            F.lit(self.library).alias("library"), "symbol", (F.coalesce("_v", F.lit(-1)) + 1).alias("version"),
            F.lit(number).cast("long").alias("commit"), F.lit(ts).alias("ts"), F.lit(op).alias("op"), tags.alias("meta"),
            F.lit(schema).cast("string").alias("schema"), "rows", "min_date", "max_date", "days",
        ).coalesce(1).write.mode("append").parquet(self._log)
        return number

    def _write_rows(self, rows: DataFrame, number: int) -> None:
        # Range clustering cuts a hot symbol's day over several files and keeps
        # row groups narrow in symbol.
        (rows.withColumn("day", self._period(F.col("date"))).repartitionByRange("day", "symbol", "date")
         .sortWithinPartitions("day", "symbol", "date").write.mode("overwrite").partitionBy("day")
         .option("compression", "zstd").option("parquet.compression.codec.zstd.level", "3")
         .parquet(f"{self._data}/_commit={number}"))

    def overwrite(self, rows: DataFrame, meta: dict[str, str] | None = None, ts: datetime | None = None) -> int:
        """Replace the tables of every symbol in `rows`; the schema may change."""
        return self._commit(rows, "overwrite", meta, ts)

    def append(self, rows: DataFrame, meta: dict[str, str] | None = None, ts: datetime | None = None) -> int:
        """Add rows; columns and types must be those stored."""
        if self._exists(self._log):
            have = {f.name: f.dataType for f in self._schema(None, None).fields}
            new = {f.name: f.dataType for f in rows.schema.fields}
            if have != new:
                raise ValueError(f"append needs the stored schema; differs in {sorted(set(have.items()) ^ set(new.items()), key=str)}")
        return self._commit(rows, "append", meta, ts)

    def replace_days(self, rows: DataFrame, meta: dict[str, str] | None = None, ts: datetime | None = None) -> list[date]:
        """Replace only the (symbol, day) pairs present in `rows`; returns the days."""
        if self.grain != "day":
            raise ValueError("replacing days needs a library kept by day")
        number = self._commit(rows, "replace_days", meta, ts)
        days = self.commits().filter(F.col("commit") == number).select(F.explode("days.day").alias("d")).distinct()
        return sorted(r[0] for r in days.collect())

    def delete(self, symbols: list[str], ts: datetime | None = None) -> int:
        return self._commit(None, "delete", None, ts, self.spark.createDataFrame([(s,) for s in symbols], "symbol string"))

    def vacuum(self, retention_hours: float, now: datetime | None = None) -> list[int]:
        """Drop the rows of commits that are older than the retention and no longer
        part of any current table. Reads as of before then lose them."""
        cut = (now or datetime.now(timezone.utc)) - timedelta(hours=retention_hours)
        live = self.live().select("commit").distinct()
        old = self.commits().filter(F.col("ts") < F.lit(cut)).select("commit").distinct().join(live, "commit", "left_anti")
        gone = []
        for (number,) in sorted(old.collect()):
            fs, p = self._fs(f"{self._data}/_commit={number}")
            if fs.exists(p):
                fs.delete(p, True)
                gone.append(number)
        return gone


def libraries(spark: SparkSession, root: str) -> list[str]:
    """Folders under `root` that hold a commit log."""
    p = spark._jvm.org.apache.hadoop.fs.Path(root)
    fs = p.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(p):
        return []
    names = [s.getPath().getName() for s in fs.listStatus(p) if s.isDirectory()]
    return sorted(n for n in names if fs.exists(spark._jvm.org.apache.hadoop.fs.Path(f"{root}/{n}/commits")))


def split_day_key(key: Column) -> tuple[Column, Column]:
    """`X_2026_08_28` to (X, date); an impossible date is part of the name."""
    parts = F.regexp_extract(key, r"^(.+)_(\d{4}_\d{2}_\d{2})$", 2)
    day = F.to_date(F.try_to_timestamp(F.nullif(parts, F.lit("")), F.lit("yyyy_MM_dd")))
    return F.when(day.isNotNull(), F.regexp_extract(key, r"^(.+)_(\d{4}_\d{2}_\d{2})$", 1)).otherwise(key), day


def day_tables(keys: DataFrame, start: str | None = None, end: str | None = None) -> DataFrame:
    """Which tables answer for each base name: the plain one if there is one, else the
    day tables inside the bounds, else (no bounds) the newest day."""
    base, day = split_day_key(F.col("key"))
    split = keys.select("key", base.alias("base"), day.alias("day"))
    plain = split.filter("day is null")
    days = split.filter("day is not null").join(plain.select("base"), "base", "left_anti")
    if start or end:
        if start:
            days = days.filter(F.col("day") >= F.to_date(F.lit(start)))
        if end:
            days = days.filter(F.col("day") <= F.to_date(F.lit(end)))
    else:
        days = latest(days, ("base",), (F.col("day").desc(),))
    return plain.unionByName(days)


def flush_day(store: Store, ticks: DataFrame, day: str, dry_run: bool = False) -> DataFrame:
    """Write one UTC day of ticks, replacing that day; returns rows per symbol."""
    of_day = ticks.filter(bounds(day, day, "time")).withColumnsRenamed({"sym": "symbol", "time": "date"})
    counts = of_day.groupBy("symbol").agg(F.count("*").alias("rows"))
    if not dry_run:
        store.replace_days(of_day, {"source": "day-flush", "day": day})
        return store.read(start=day, end=day).groupBy("symbol").agg(F.count("*").alias("rows"))
    return counts


def load_and_verify(store: Store, rows: DataFrame, interval: str = "1d") -> DataFrame:
    """Write, read back, resample: rows offered, stored and resampled per symbol, PASS
    when stored equals offered and something came out of the resample."""
    from marketloom.operators.bars import resample

    (store.replace_days if store.grain == "day" else store.overwrite)(rows, {"source": "load"})
    span = rows.agg(F.min("date").alias("a"), F.max("date").alias("b")).first()
    back = store.read(start=str(span.a), end=str(span.b))
    n = lambda df, name: df.groupBy("symbol").agg(F.count("*").alias(name))
    out = n(rows, "offered").join(n(back, "stored"), "symbol", "left").join(n(resample(back, interval), "resampled"), "symbol", "left")
    return out.withColumn("status", F.when((F.col("stored") == F.col("offered")) & (F.col("resampled") > 0), "PASS").otherwise("FAIL"))


def register_views(store: Store, symbols: list[str]) -> list[str]:
    """A temporary view per symbol, named `<library>_<symbol>`."""
    out = []
    for s in symbols:
        name = f"{store.library}_{s}"
        store.read([s]).createOrReplaceTempView(f"`{name}`")
        out.append(name)
    return out


def snapshot_versions(store: Store) -> DataFrame:
    """Current version per symbol, to pin what a result was read from."""
    return store.commits().groupBy("symbol").agg(F.max("version").alias("version"))


def manifest(store: Store, symbols: list[str], pinned: dict[str, int] | None = None) -> DataFrame:
    """Version of every dependency: the pinned one, which must exist, else the newest."""
    pins = store.spark.createDataFrame([(s, (pinned or {}).get(s)) for s in symbols], "symbol string, pinned bigint")
    known = store.commits().groupBy("symbol").agg(F.collect_set("version").alias("_all"), F.max("version").alias("_top"))
    out = pins.join(known, "symbol", "left")
    bad = out.filter(F.col("pinned").isNotNull() & ~F.coalesce(F.array_contains("_all", F.col("pinned")), F.lit(False)))
    if not bad.isEmpty():
        raise LookupError("a pinned version does not exist")
    return out.select("symbol", F.coalesce("pinned", "_top").alias("version"))


def newer_available(before: DataFrame, now: DataFrame) -> DataFrame:
    """Does any relation's version differ from a saved set of versions?"""
    a, b = before.withColumnRenamed("version", "_a"), now.withColumnRenamed("version", "_b")
    return a.join(b, "symbol", "full_outer").agg(
        F.coalesce(F.bool_or(~F.col("_a").eqNullSafe(F.col("_b"))), F.lit(False)).alias("newer"))


def version_diff(store: Store, left: int, right: int) -> DataFrame:
    """Rows by symbol at two versions and rows committed in between."""
    def rows(v: int, name: str) -> DataFrame:
        return store.live(version=v).groupBy("symbol").agg(F.sum("rows").alias(name))

    between = (store.commits().filter((F.col("version") > left) & (F.col("version") <= right))
               .groupBy("symbol").agg(F.sum("rows").alias("committed")))
    return rows(left, "left_rows").join(rows(right, "right_rows"), "symbol", "full_outer").join(between, "symbol", "left").fillna(0)
