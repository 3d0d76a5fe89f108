"""Tick files: headerless trades and quotes in exchange-local time."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from marketloom.operators.series import Layout, Prefix, scan

ZONE = "America/New_York"
#: Columns of the two file kinds (fixed values).
TRADE = ("timestamp", "price", "volume", "exchange", "conditions")
QUOTE = ("timestamp", "bid_price", "bid_size", "bid_exchange", "ask_price", "ask_size", "ask_exchange")
#: Stamp layouts met in one file (fixed values).
STAMPS = ("yyyy-MM-dd HH:mm:ss[.SSSSSS][.SSSSS][.SSSS][.SSS][.SS][.S]", "yyyy-MM-dd'T'HH:mm:ss[.SSSSSS][.SSS]",
          "yyyy-MM-dd HH:mm", "MM/dd/yyyy HH:mm:ss[.SSSSSS][.SSS]")
#: The first layout without its freedoms: a cast reads it alike.
PLAIN = r"^[1-9]\d{3}-\d\d-\d\d \d\d:\d\d:\d\d(\.\d{1,6})?\z"
_NAME = r"(?i)([A-Z0-9.\-]+)_(trades?|quotes?)[^/]*(?:/part-[^/]*)?$"


def local_stamp(text: Column) -> Column:
    """A stamp in one of the layouts. The plain one is cast, which is many times cheaper."""
    plain = F.when(F.rlike(text, F.lit(PLAIN)), text.try_cast("timestamp"))
    return F.coalesce(plain, *[F.try_to_timestamp(text, F.lit(f)) for f in STAMPS])


def local_to_utc(text: Column, zone: str = ZONE) -> tuple[Column, Column]:
    """(instant, problem) of an exchange-local stamp.

    Spark resolves clock changes silently, so the stamp is checked: converted back
    it must read the same (else it fell in the spring gap), and an hour earlier or
    later must not read the same (else it is one of the two autumn hours).
    """
    local = local_stamp(text)
    at = F.to_utc_timestamp(local, zone)
    return at, _stamp_problem(local, at, zone)


def _stamp_problem(local: Column, at: Column, zone: str) -> Column:
    back = lambda ts: F.from_utc_timestamp(ts, zone)
    hour = F.expr("INTERVAL 1 HOUR")
    twice = (back(at + hour) == local) | (back(at - hour) == local)
    return (F.when(local.isNull(), "unreadable stamp").when(back(at) != local, "nonexistent local time")
            .when(twice, "ambiguous local time"))


def _lines(spark: SparkSession, path: str) -> DataFrame:
    """Non-blank lines with file and physical line number. Spark skips `_*` and `.*`.

    Files stay splittable: lines are counted per split and the counts carried over
    the splits of a file.
    """
    raw = spark.read.text(path).select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("_block"),
        F.monotonically_increasing_id().alias("_row"), F.col("value").alias("line"))
    by_split = Layout(keys=("file",), order=("_block", "_row"), bucket_seconds=1)
    return scan(raw, by_split, {"line_number": Prefix("count")}).drop("_block", "_row").filter("trim(line) <> ''")


def read(spark: SparkSession, path: str) -> DataFrame:
    """Every data line of a folder, split: `file, symbol, kind, fields, time, problem`.

    The first line of a file decides its kind; a line of another width, an unreadable
    stamp or a clock-change stamp gets a `problem`. Splittable: no file is read whole.
    """
    lines = (spark.read.text(path).filter("trim(value) <> ''")
             .select(F.input_file_name().alias("file"), F.split("value", ",").alias("fields")))
    # the name lies in the last two steps of the path; the rest is not searched for it
    name = F.substring_index("file", "/", -2)
    named = lines.withColumns({
        "symbol": F.upper(F.nullif(F.regexp_extract(name, _NAME, 1), F.lit(""))),
        "kind": F.lower(F.regexp_extract(name, _NAME, 2))}).withColumn(
        "kind", F.when(F.startswith(F.col("kind"), F.lit("trade")), "trade").when(
            F.startswith(F.col("kind"), F.lit("quote")), "quote"))
    # each step is a column, so that it is worked out once
    named = named.withColumn("_local", local_stamp(F.col("fields")[0])).withColumn("time", F.to_utc_timestamp("_local", ZONE))
    width = F.size("fields")
    fits = F.when(F.col("kind") == "trade", width == 5).otherwise(width.isin(7, 8))
    problem = (F.when(F.col("symbol").isNull() | F.col("kind").isNull(), "file name names no symbol and kind")
               .when(~fits, F.concat(F.lit("unexpected number of fields: "), width))
               .otherwise(_stamp_problem(F.col("_local"), F.col("time"), ZONE)))
    return named.select("file", "symbol", "kind", "fields", "time", problem.alias("problem"))


def sound_files(parsed: DataFrame) -> DataFrame:
    """Rows of files without any problem; one bad line rejects its file."""
    # an aggregate, as a filter would work the problem out in place of the columns it is made of
    bad = parsed.groupBy("file").agg(F.bool_or(F.col("problem").isNotNull()).alias("_bad")).where("_bad").select("file")
    return parsed.join(bad, "file", "left_anti")


def trades(parsed: DataFrame) -> DataFrame:
    f = lambda i: F.get("fields", F.lit(i))
    return parsed.filter("kind = 'trade'").select(
        "symbol", "time", f(1).try_cast("double").alias("price"), f(2).try_cast("long").alias("volume"),
        f(3).alias("exchange"), F.coalesce(f(4), F.lit("")).alias("conditions"), "file")


def quotes(parsed: DataFrame) -> DataFrame:
    f = lambda i: F.get("fields", F.lit(i))
    return parsed.filter("kind = 'quote'").select(
        "symbol", "time", f(1).try_cast("double").alias("bid_price"), f(2).try_cast("long").alias("bid_size"),
        f(3).alias("bid_exchange"), f(4).try_cast("double").alias("ask_price"), f(5).try_cast("long").alias("ask_size"),
        f(6).alias("ask_exchange"), "file")


def rejects(spark: SparkSession, path: str) -> DataFrame:
    """Files skipped, with the first offending line and how many there are."""
    lines = _lines(spark, path)
    checked = lines.withColumns({
        "kind": F.lower(F.regexp_extract("file", _NAME, 2)), "n": F.size(F.split("line", ","))})
    fits = F.when(F.startswith(F.col("kind"), F.lit("trade")), F.col("n") == 5).otherwise(F.col("n").isin(7, 8))
    bad = checked.filter(~fits | (F.col("kind") == ""))
    return bad.groupBy("file").agg(F.min("line_number").alias("first_line"), F.count("*").alias("bad_lines"))


def reference_bars(raw: DataFrame, names: dict[str, str], zone: str = "UTC", time: str = "date") -> DataFrame:
    """Vendor bars with their columns renamed to OHLCV and stamps in UTC."""
    renamed = raw.select(*[F.col(c).alias(names.get(c, c)) for c in raw.columns])
    missing = [c for c in ("open", "high", "low", "close", "volume") if c not in renamed.columns]
    if missing:
        raise ValueError(f"reference bars miss column(s): {', '.join(missing)}")
    stamp = F.col(names.get(time, time)).cast("timestamp")
    at = stamp if zone == "UTC" else F.to_utc_timestamp(stamp, zone)
    keys = [c for c in ("symbol",) if c in renamed.columns]
    return renamed.select(*keys, at.alias("date"), *[F.col(c).cast("double").alias(c) for c in ("open", "high", "low", "close", "volume")])


def exclusive_end(end: Column) -> Column:
    """A midnight end means that day: one more day for sources that exclude it."""
    return F.when(end == F.date_trunc("day", end), end + F.expr("INTERVAL 1 DAY")).otherwise(end)
