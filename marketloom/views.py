"""Market views over the given star-schema tables, each with a DuckDB twin."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Divides order totals into share-like prices.
PRICE_SCALE = 997.0
#: Adjusted close over raw close.
ADJUSTMENT = 0.98512347


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A given table; TIMESTAMP_NTZ columns become UTC instants once, here."""
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    fixed = [F.col(f.name).cast("timestamp").alias(f.name)
             if f.dataType.typeName() == "timestamp_ntz" else F.col(f.name)
             for f in df.schema.fields]
    return df.select(*fixed)


def ticks(spark: SparkSession, sf_dir: str, by: str = "event_type") -> DataFrame:
    """Trades `sym, time, price, size, seq` from events; `by` names the symbol column."""
    return table(spark, sf_dir, "events").select(
        F.col(by).cast("string").alias("sym"),
        F.col("ts").alias("time"),
        F.col("value").alias("price"),
        F.get_json_object("props", "$.k").cast("double").alias("size"),
        F.col("event_id").alias("seq"),
    )


def daily_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One bar per order priority and day."""
    px = F.col("o_totalprice") / F.lit(PRICE_SCALE)
    return (
        table(spark, sf_dir, "orders")
        .groupBy(F.col("o_orderpriority").alias("symbol"), F.col("o_orderdate").alias("date"))
        .agg(
            F.min_by(px, "o_orderkey").alias("open"),
            F.max(px).alias("high"),
            F.min(px).alias("low"),
            F.max_by(px, "o_orderkey").alias("close"),
            F.count("*").cast("double").alias("volume"),
            F.avg(px).alias("vwap"),
        )
        .withColumn("adj_close", F.col("close") * F.lit(ADJUSTMENT))
        .select("symbol", "date", "open", "high", "low", "close", "adj_close", "volume", "vwap")
    )


def part_trades(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Trades from lineitem: symbol = supplier, price = unit price."""
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_suppkey").cast("string").alias("sym"),
        F.col("l_shipdate").alias("time"),
        (F.col("l_extendedprice") / F.col("l_quantity")).alias("price"),
        F.col("l_quantity").alias("size"),
        (F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("seq"),
        F.col("l_partkey").alias("part"),
    )


def part_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One bar per supplier and ship day."""
    # (seq, part) is unique; one decimal keeps first/last in a hash aggregate.
    order = F.col("seq").cast("decimal(20,0)") * F.lit(10 ** 12).cast("decimal(13,0)") + F.col("part")
    return (
        part_trades(spark, sf_dir)
        .groupBy(F.col("sym").alias("symbol"), F.col("time").alias("date"))
        .agg(
            F.min_by("price", order).alias("open"),
            F.max("price").alias("high"),
            F.min("price").alias("low"),
            F.max_by("price", order).alias("close"),
            F.sum("size").alias("volume"),
            F.try_divide(F.sum(F.col("price") * F.col("size")), F.sum("size")).alias("vwap"),
        )
        .withColumn("adj_close", F.col("close") * F.lit(ADJUSTMENT))
        .select("symbol", "date", "open", "high", "low", "close", "adj_close", "volume", "vwap")
    )


#: DuckDB twins of the views, spliced into oracle SQL as common table expressions.
TWINS: dict[str, str] = {
    "ticks": """
        SELECT event_type AS sym, ts AS time, value AS price,
               CAST(json_extract_string(props, '$.k') AS DOUBLE) AS size, event_id AS seq
        FROM events""",
    "user_ticks": """
        SELECT CAST(user_id AS VARCHAR) AS sym, ts AS time, value AS price,
               CAST(json_extract_string(props, '$.k') AS DOUBLE) AS size, event_id AS seq
        FROM events""",
    "daily_bars": f"""
        SELECT o_orderpriority AS symbol, o_orderdate AS date,
               arg_min(o_totalprice / {PRICE_SCALE}, o_orderkey) AS open,
               max(o_totalprice / {PRICE_SCALE}) AS high,
               min(o_totalprice / {PRICE_SCALE}) AS low,
               arg_max(o_totalprice / {PRICE_SCALE}, o_orderkey) AS close,
               arg_max(o_totalprice / {PRICE_SCALE}, o_orderkey) * CAST({ADJUSTMENT} AS DOUBLE) AS adj_close,
               CAST(count(*) AS DOUBLE) AS volume,
               avg(o_totalprice / {PRICE_SCALE}) AS vwap
        FROM orders GROUP BY 1, 2""",
    "part_trades": """
        SELECT CAST(l_suppkey AS VARCHAR) AS sym, l_shipdate AS time,
               l_extendedprice / l_quantity AS price, l_quantity AS size,
               l_orderkey * 8 + l_linenumber AS seq, l_partkey AS part
        FROM lineitem""",
    "part_bars": f"""
        SELECT sym AS symbol, time AS date,
               arg_min(price, (seq, part, price, size)) AS open, max(price) AS high,
               min(price) AS low, arg_max(price, (seq, part, price, size)) AS close,
               arg_max(price, (seq, part, price, size)) * CAST({ADJUSTMENT} AS DOUBLE) AS adj_close,
               sum(size) AS volume,
               CASE WHEN sum(size) <> 0 THEN sum(price * size) / sum(size) END AS vwap
        FROM part_trades GROUP BY 1, 2""",
}

#: Views that read another view.
TWIN_NEEDS = {"part_bars": ("part_trades",)}


def with_twins(sql: str, *names: str) -> str:
    """Prefix `sql` with the named views; a leading WITH in `sql` is merged."""
    order: list[str] = []
    for name in names:
        for need in (*TWIN_NEEDS.get(name, ()), name):
            if need not in order:
                order.append(need)
    ctes = ",\n".join(f"{n} AS ({TWINS[n].strip()})" for n in order)
    body = sql.strip()
    if not ctes:
        return body
    if body[:15].upper() == "WITH RECURSIVE ":
        return f"WITH RECURSIVE {ctes},\n{body[15:]}"
    if body[:5].upper() == "WITH ":
        return f"WITH {ctes},\n{body[5:]}"
    return f"WITH {ctes}\n{body}"
