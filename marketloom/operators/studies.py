"""Per-symbol studies, plot series, pushes of what changed."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marketloom.operators import indicators as ind
from marketloom.operators import series, sessions
from marketloom.operators.series import Layout

RSI_PERIOD = 14


def studies(bars: DataFrame, anchors: DataFrame | None = None, default_anchor: str | None = None,
            layout: Layout | None = None) -> DataFrame:
    """One row per symbol: last RSI, last anchored VWAP, price's distance from it.

    RSI needs more than 14 bars. `anchors(symbol, anchor)` overrides the default
    anchor; without either, the VWAP runs from the first bar.
    """
    layout = layout or Layout()
    rsi = ind.resolve("rsi", period=RSI_PERIOD)
    frame = ind.compute(bars, [rsi], layout)
    default = F.lit(default_anchor).cast("timestamp") if default_anchor else F.lit(None).cast("timestamp")
    if anchors is None:
        frame = frame.withColumn("anchor", default)
    else:
        frame = (frame.join(anchors.select("symbol", F.col("anchor").alias("_own")), "symbol", "left")
                 .withColumn("anchor", F.coalesce("_own", default)).drop("_own"))
    valid = (F.col("vwap").isNotNull() & ~F.isnan("vwap") & (F.col("volume") > 0)
             & (F.col("anchor").isNull() | (F.col("date") >= F.col("anchor"))))
    # Only the last value is asked for, so plain sums do; the last bar must count itself.
    rows = (frame.withColumn("_ok", valid).groupBy("symbol")
            .agg(F.count("*").alias("bars"), F.max_by(F.col(f"`{rsi.columns()[0]}`"), "date").alias("rsi"),
                 F.max_by("close", "date").alias("price"), F.max_by("_ok", "date").alias("ok"),
                 F.sum(F.when(F.col("_ok"), F.col("vwap") * F.col("volume"))).alias("pv"),
                 F.sum(F.when(F.col("_ok"), F.col("volume"))).alias("vol"),
                 F.first("anchor").alias("vwap_start")))
    avwap = F.when(F.col("ok") & (F.col("vol") > 0), F.col("pv") / F.col("vol"))
    return rows.select("symbol", F.when(F.col("bars") > RSI_PERIOD, F.col("rsi")).alias("rsi"),
                       avwap.alias("avwap"), F.when(avwap != 0, (F.col("price") - avwap) / avwap).alias("avwap_dev"),
                       "vwap_start")


def with_vendor(bars: DataFrame, req: ind.Request, vendor: DataFrame, fields: dict[str, str],
                layout: Layout | None = None) -> DataFrame:
    """The vendor's series where it has one, ours where it does not, and which it was."""
    from marketloom.operators.asof import vendor_series

    ours = ind.compute(bars, [req], layout)
    joined, _ = vendor_series(ours, vendor, fields, "#vendor")
    for out in fields.values():
        mine, theirs = F.col(f"`{out + req.suffix}`"), F.col(f"`{out}#vendor`")
        joined = joined.withColumns({out: F.coalesce(theirs, mine),
                                     f"{out}_source": F.when(theirs.isNotNull(), "vendor").otherwise("local")})
    drop = [f"{o}#vendor" for o in fields.values()] + req.columns()
    return joined.drop(*drop)


def displace(bars: DataFrame, offset: int, layout: Layout | None = None) -> DataFrame:
    """`plot_at`: each bar's date moved by `offset` bars; beyond the ends it goes
    on in steps of the smallest gap seen in the series."""
    layout = layout or Layout()
    keys = list(layout.keys)
    numbered = series.number(series.previous(bars, layout, {"_before": "date"}), layout)
    ends = numbered.groupBy(*keys).agg(
        F.min("date").alias("_d0"), F.max("date").alias("_d1"), F.max(series.POS).alias("_p1"),
        F.min(F.unix_micros("date") - F.unix_micros("_before")).alias("_step"))
    targets = numbered.select(*keys, (F.col(series.POS) - offset).alias(series.POS), F.col("date").alias("_at"))
    out = numbered.join(targets, [*keys, series.POS], "left").join(ends, keys)
    to = F.col(series.POS) + offset
    micros = F.when(to > F.col("_p1"), F.unix_micros("_d1") + F.col("_step") * (to - F.col("_p1"))).when(
        to < 0, F.unix_micros("_d0") + F.col("_step") * to)
    return out.select(*bars.columns, F.coalesce(F.col("_at"), F.timestamp_micros(micros)).alias("plot_at"))


def plot_rows(frame: DataFrame, panes: dict[str, list[str]], keys: tuple[str, ...] = ("symbol",),
              time: str = "date") -> DataFrame:
    """Long output `(pane, column, time, value)`; values that are not finite are null."""
    names = [c for cols in panes.values() for c in cols]
    home = {c: p for p, cols in panes.items() for c in cols}
    wide = frame.select(*keys, F.col(time).alias("time"), *[
        F.col(f"`{c}`").cast("double").alias(f"_y{i}") for i, c in enumerate(names)])
    pairs = F.array(*[F.struct(F.lit(home[c]).alias("pane"), F.lit(c).alias("column"), F.col(f"_y{i}").alias("value"))
                      for i, c in enumerate(names)])
    long = wide.select(*keys, "time", F.inline(pairs))
    finite = F.abs("value") < F.lit(float("inf"))
    return long.withColumn("value", F.when(finite & ~F.isnan("value"), F.col("value")))


def revised(current: DataFrame, sent: DataFrame, key: str = "symbol", time: str = "date",
            business_days: bool = False, feed: str = "us") -> DataFrame:
    """Rows to send since the last push `sent(symbol, date)`.

    From the last bar sent, which was still forming; everything if the bars sent
    are no longer the start of the series. Business-day windows move their whole
    running session, so the rows reach back to its first bar.
    """
    was = sent.groupBy(key).agg(F.max(time).alias("_last"), F.count("*").alias("_n"))
    seen = (current.select(key, time).join(was, key).filter(F.col(time) <= F.col("_last"))
            .groupBy(key).agg(F.count("*").alias("_now")))
    kept = (current.select(key, time).join(sent.select(key, time), [key, time], "left_semi")
            .groupBy(key).agg(F.count("*").alias("_both")))
    edge = was.join(seen, key, "left").join(kept, key, "left").select(
        key, F.when((F.col("_now") == F.col("_n")) & (F.col("_both") == F.col("_n")), F.col("_last")).alias("_from"))
    if business_days:
        running = sessions.running_session(current.withColumnRenamed(time, "date"), feed, (key,))
        edge = edge.join(running.select(key, "first_bar"), key, "left").select(
            key, F.when(F.col("_from").isNotNull(), F.least("_from", "first_bar")).alias("_from"))
    return (current.join(edge, key, "left")
            .filter(F.col("_from").isNull() | (F.col(time) >= F.col("_from"))).drop("_from"))
