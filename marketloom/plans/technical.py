"""One query per indicator over the daily bars, with window or recursive twins."""

from pyspark.sql import functions as F

from marketloom import views
from marketloom.operators import indicators as ind
from marketloom.operators import sessions, studies
from marketloom.plans.registry import query

DIGITS = 4


def _run(spark, sf, name, bars=None, **params):
    req = ind.resolve(name, **params)
    out = ind.compute(views.daily_bars(spark, sf) if bars is None else bars, [req])
    return out.select("symbol", "date", *[
        F.round(F.col(f"`{c}`"), DIGITS).alias(c.split("|")[0].lower()) for c in req.columns()])


def _windowed(name, outputs, steps, frame="", **params):
    """Register `name` with a twin: `steps` are successive CTE select lists."""
    ctes, prev = [], "daily_bars"
    for i, cols in enumerate(steps):
        ctes.append(f"s{i} AS (SELECT *, {cols} FROM {prev} WINDOW w AS (PARTITION BY symbol ORDER BY date))")
        prev = f"s{i}"
    picks = ", ".join(f"round(CAST({e} AS DOUBLE), {DIGITS}) AS {o}" for o, e in outputs.items())
    head = f"WITH {', '.join(ctes)} " if ctes else ""
    query(f"ind_{name}", f"{head}SELECT symbol, date, {picks} FROM {prev}", ("daily_bars",))(
        lambda spark, sf: _run(spark, sf, name, **params))


def _roll(fn, expr, n, over="symbol"):
    """A rolling aggregate that is null until n values are there."""
    fr = f"(PARTITION BY symbol ORDER BY date ROWS {n - 1} PRECEDING)"
    return f"CASE WHEN count({expr}) OVER {fr} = {n} THEN {fn}({expr}) OVER {fr} END"


def _wma(expr, n):
    terms = " + ".join(f"{n - i} * lag({expr}, {i}) OVER w" if i else f"{n} * {expr}" for i in range(n))
    return f"({terms}) / {n * (n + 1) / 2}"


_PREV = ("lag(close) OVER w AS c1, lag(high) OVER w AS h1, lag(low) OVER w AS l1, lag(adj_close) OVER w AS a1, "
         "(high + low + close) / 3 AS tp")
_TR = "greatest(high - low, abs(high - c1), abs(low - c1)) AS tr"

_windowed("sma", {"sma": _roll("avg", "adj_close", 50)}, [])
_windowed("wma", {"wma": "v"}, [f"{_wma('adj_close', 50)} AS v"])
_windowed("hma", {"hma": "v"}, [f"{_wma('adj_close', 4)} AS f, {_wma('adj_close', 9)} AS s",
                                "2 * f - s AS raw", f"{_wma('raw', 3)} AS v"])
_BB = [f"{_roll('avg', 'adj_close', 20)} AS m, {_roll('stddev_pop', 'adj_close', 20)} AS sd"]
_windowed("bbands", {"bb_mid": "m", "bb_up": "m + 2 * sd", "bb_lo": "m - 2 * sd"}, _BB)
_windowed("stddev", {"stddev": "sd"}, _BB)
_windowed("pct_b", {"pct_b": "(adj_close - (m - 2 * sd)) / nullif(4 * sd, 0)"}, _BB)
_windowed("bandwidth", {"bandwidth": "4 * sd / nullif(m, 0) * 100"}, _BB)
_HL = lambda n: f"{_roll('max', 'high', n)} AS hh, {_roll('min', 'low', n)} AS ll"
_windowed("donchian", {"dc_up": "hh", "dc_lo": "ll", "dc_mid": "(hh + ll) / 2"}, [_HL(20)])
_windowed("volume", {"volume_bar": "volume"}, [])
_windowed("vwap", {"vwap": "n / d"},
          [_PREV, "sum(tp * volume) OVER w AS n, sum(volume) OVER w AS d"])
_windowed("avwap", {"avwap": "CASE WHEN ok THEN n / d END"},
          ["vwap IS NOT NULL AND volume > 0 AND date >= TIMESTAMP '1998-01-01' AS ok",
           "sum(CASE WHEN ok THEN vwap * volume ELSE 0 END) OVER w AS n, "
           "sum(CASE WHEN ok THEN volume ELSE 0 END) OVER w AS d"], anchor="1998-01-01T00:00:00Z")
_windowed("stoch", {"stoch_k": "k", "stoch_d": _roll("avg", "k", 3)},
          [_HL(14), "100 * (close - ll) / nullif(hh - ll, 0) AS k"])
_windowed("willr", {"willr": "-100 * (hh - close) / nullif(hh - ll, 0)"}, [_HL(14)])
_windowed("cci", {"cci": f"(tp - m) / nullif(0.015 * {_roll('avg', 'dev', 20)}, 0)"},
          [_PREV, f"{_roll('avg', 'tp', 20)} AS m", "abs(tp - m) AS dev"])
_windowed("roc", {"roc": "100 * (adj_close / nullif(a12, 0) - 1)"}, ["lag(adj_close, 12) OVER w AS a12"])
_windowed("obv", {"obv": "CASE WHEN a1 IS NOT NULL THEN t END"},
          [_PREV, "sum(sign(adj_close - a1) * volume) OVER w AS t"])
_windowed("ao", {"ao": f"{_roll('avg', 'mid', 5)} - {_roll('avg', 'mid', 34)}"}, ["(high + low) / 2 AS mid"])
_windowed("mfi", {"mfi": "CASE WHEN up + dn > 0 THEN 100 * up / (up + dn) END"},
          [_PREV, "lag(tp) OVER w AS tp1",
           "CASE WHEN tp > tp1 THEN tp * volume ELSE 0.0 END AS u, CASE WHEN tp < tp1 THEN tp * volume ELSE 0.0 END AS n",
           f"{_roll('sum', 'u', 14)} AS up, {_roll('sum', 'n', 14)} AS dn"])
_windowed("cmf", {"cmf": f"{_roll('sum', 'f', 20)} / nullif({_roll('sum', 'volume', 20)}, 0)"},
          ["CASE WHEN high > low THEN (2 * close - high - low) / (high - low) ELSE 0.0 END * volume AS f"])
_windowed("uo", {"uo": "100 * (4 * b7 / nullif(t7, 0) + 2 * b14 / nullif(t14, 0) + b28 / nullif(t28, 0)) / 7"},
          [_PREV, f"{_TR}, close - least(low, c1) AS bp",
           ", ".join(f"{_roll('sum', 'bp', n)} AS b{n}, {_roll('sum', 'tr', n)} AS t{n}" for n in (7, 14, 28))])
_windowed("vortex", {"vi_plus": "p / nullif(t, 0)", "vi_minus": "m / nullif(t, 0)"},
          [_PREV, f"{_TR}, abs(high - l1) AS vp, abs(low - h1) AS vm",
           f"{_roll('sum', 'vp', 14)} AS p, {_roll('sum', 'vm', 14)} AS m, {_roll('sum', 'tr', 14)} AS t"])
_windowed("chop", {"chop": "CASE WHEN hh > ll THEN 100 * log10(t / (hh - ll)) / log10(14) END"},
          [_PREV, _TR, f"{_HL(14)}, {_roll('sum', 'tr', 14)} AS t"])
_windowed("ichimoku", {"ichi_conversion": "c9", "ichi_base": "c26", "ichi_span_a": "(c9 + c26) / 2",
                       "ichi_span_b": "c52", "ichi_chikou": "close"},
          [", ".join(f"({_roll('max', 'high', n)} + {_roll('min', 'low', n)}) / 2 AS c{n}" for n in (9, 26, 52))])


def _recursive(name, inputs, state, outputs, pre="", **params):
    """Register a recurrence with a row-by-row recursive twin.

    `inputs`: extra columns of the numbered frame; `state`: column -> (seed, step)
    where a step reads `p.<state>` of the row before and `b.<input>` of this row.
    """
    seeds = ", ".join(f"CAST({seed} AS DOUBLE) AS {n}" for n, (seed, _) in state.items())
    steps = ", ".join(f"{step} AS {n}" for n, (_, step) in state.items())
    picks = ", ".join(f"round({e}, {DIGITS}) AS {o}" for o, e in outputs.items())
    sql = f"""WITH RECURSIVE l AS (SELECT *, {_PREV} FROM daily_bars WINDOW w AS (PARTITION BY symbol ORDER BY date)),
      t AS (SELECT *, {_TR}, row_number() OVER (PARTITION BY symbol ORDER BY date) AS rn FROM l),
      b AS MATERIALIZED (SELECT *, {inputs} FROM t),
      r AS (SELECT b.symbol, b.date, b.rn, {seeds} FROM b WHERE rn = 1
            UNION ALL SELECT b.symbol, b.date, b.rn, {steps} FROM r p JOIN b ON b.symbol = p.symbol AND b.rn = p.rn + 1),
      o AS (SELECT * FROM r)
      SELECT symbol, date, {picks} FROM {pre or 'o'}"""
    query(f"ind_{name}", sql, ("daily_bars",))(lambda spark, sf: _run(spark, sf, name, **params))


def _ema(name, x, span):
    a = 2 / (span + 1)
    return {name: (f"b.{x}", f"{1 - a!r} * p.{name} + {a!r} * b.{x}")}


def _wilder(name, x, n):
    a = 1 / n
    return {name: (f"b.{x}", f"{1 - a!r} * p.{name} + {a!r} * b.{x}")}


_GL = ("CASE WHEN adj_close > a1 THEN adj_close - a1 ELSE 0.0 END AS g, "
       "CASE WHEN adj_close < a1 THEN a1 - adj_close ELSE 0.0 END AS l")
_DM = ("CASE WHEN high - h1 > l1 - low AND high > h1 THEN high - h1 ELSE 0.0 END AS dp, "
       "CASE WHEN l1 - low > high - h1 AND l1 > low THEN l1 - low ELSE 0.0 END AS dm")
_recursive("ema", "1 AS one", _ema("e", "adj_close", 50), {"ema": "e"})
_recursive("rsi", _GL, {**_wilder("ag", "g", 14), **_wilder("al", "l", 14)},
           {"rsi": "100 * ag / nullif(ag + al, 0)"})
_recursive("atr", "1 AS one", _wilder("a", "tr", 14), {"atr": "a"})
_recursive("keltner", "1 AS one", {**_ema("m", "adj_close", 20), **_wilder("a", "tr", 10)},
           {"kc_mid": "m", "kc_up": "m + 2 * a", "kc_lo": "m - 2 * a"})


def _chain(*steps):
    """Successive EMAs: each step reads the one before, on the same row."""
    out = {}
    for i, (name, span) in enumerate(steps):
        a = 2 / (span + 1)
        x = "b.adj_close" if i == 0 else out[steps[i - 1][0]][1]
        out[name] = ("b.adj_close", f"({1 - a!r} * p.{name} + {a!r} * {x})")
    return out


_recursive("trix", "1 AS one", _chain(("e1", 18), ("e2", 18), ("e3", 18)),
           {"trix": "100 * (e3 / nullif(lag(e3) OVER (PARTITION BY symbol ORDER BY date), 0) - 1)"})
_f, _s = _ema("f", "adj_close", 12), _ema("s", "adj_close", 26)
_recursive("macd", "1 AS one", {
    **_f, **_s, "g": ("0", f"0.8 * p.g + 0.2 * (({_f['f'][1]}) - ({_s['s'][1]}))")},
    {"macd": "f - s", "macd_signal": "g", "macd_hist": "f - s - g"})
_recursive("stochrsi", _GL, {**_wilder("ag", "g", 14), **_wilder("al", "l", 14)},
           {"stochrsi": "100 * (rsi - lo) / nullif(hi - lo, 0)"},
           pre=f"(SELECT *, {_roll('min', 'rsi', 14)} AS lo, {_roll('max', 'rsi', 14)} AS hi FROM "
               "(SELECT *, 100 * ag / nullif(ag + al, 0) AS rsi FROM o))")
_dp, _dm, _at = _wilder("p1", "dp", 14), _wilder("m1", "dm", 14), _wilder("t1", "tr", 14)
_dxn = f"(100 * abs(({_dp['p1'][1]}) - ({_dm['m1'][1]})) / nullif(({_dp['p1'][1]}) + ({_dm['m1'][1]}), 0))"
_recursive("adx", _DM, {**_dp, **_dm, **_at, "x": (
    "NULL", f"CASE WHEN {_dxn} IS NULL THEN p.x WHEN p.x IS NULL THEN {_dxn} "
            f"ELSE {1 - 1 / 14!r} * p.x + {1 / 14!r} * {_dxn} END")},
    {"adx": "x", "di_plus": "100 * p1 / nullif(t1, 0)", "di_minus": "100 * m1 / nullif(t1, 0)"})


_ROWS = """b AS MATERIALIZED (SELECT symbol, date, high, low, close, lag(close) OVER w AS c1, lag(low) OVER w AS l1, lag(high) OVER w AS h1,
      coalesce(lag(low, 2) OVER w, lag(low) OVER w) AS l2, coalesce(lag(high, 2) OVER w, lag(high) OVER w) AS h2,
      row_number() OVER w AS rn FROM daily_bars WINDOW w AS (PARTITION BY symbol ORDER BY date))"""


@query("ind_sar", f"""WITH RECURSIVE {_ROWS},
    r AS (SELECT symbol, date, rn, 1 AS up, low AS stop, high AS peak, CAST(0.02 AS DOUBLE) AS pace FROM b WHERE rn = 1
      UNION ALL SELECT symbol, date, rn, CASE WHEN flip THEN 1 - up ELSE up END, CASE WHEN flip THEN peak ELSE s2 END,
        CASE WHEN flip AND up = 1 THEN low WHEN flip THEN high WHEN up = 1 THEN greatest(peak, high) ELSE least(peak, low) END,
        CASE WHEN flip THEN 0.02 WHEN (up = 1 AND high > peak) OR (up = 0 AND low < peak) THEN least(pace + 0.02, 0.2) ELSE pace END
      FROM (SELECT *, CASE WHEN up = 1 THEN low < s2 ELSE high > s2 END AS flip FROM (
        SELECT b.symbol, b.date, b.rn, b.high, b.low, p.up, p.peak, p.pace, CASE WHEN p.up = 1
          THEN least(p.stop + p.pace * (p.peak - p.stop), b.l1, b.l2) ELSE greatest(p.stop + p.pace * (p.peak - p.stop), b.h1, b.h2) END AS s2
        FROM r p JOIN b ON b.symbol = p.symbol AND b.rn = p.rn + 1)))
    SELECT symbol, date, CASE WHEN rn > 1 THEN round(stop, 4) END AS sar FROM r""", ("daily_bars",))
def ind_sar(spark, sf):
    return _run(spark, sf, "sar")


@query("ind_supertrend", f"""WITH RECURSIVE {_ROWS},
    r AS (SELECT symbol, date, rn, high - low AS atr, CAST(NULL AS DOUBLE) AS hi, CAST(NULL AS DOUBLE) AS lo, CAST(1 AS DOUBLE) AS side FROM b WHERE rn = 1
      UNION ALL SELECT symbol, date, rn, atr, hi, lo, CASE WHEN side = 1 AND close < lo THEN -1 WHEN side = -1 AND close > hi THEN 1 ELSE side END
      FROM (SELECT symbol, date, rn, close, atr, side, CASE WHEN hi0 IS NULL OR mid + 3 * atr < hi0 OR c1 > hi0 THEN mid + 3 * atr ELSE hi0 END AS hi,
          CASE WHEN lo0 IS NULL OR mid - 3 * atr > lo0 OR c1 < lo0 THEN mid - 3 * atr ELSE lo0 END AS lo
        FROM (SELECT b.symbol, b.date, b.rn, b.close, b.c1, p.side, p.hi AS hi0, p.lo AS lo0, (b.high + b.low) / 2 AS mid,
            p.atr + (greatest(b.high - b.low, abs(b.high - b.c1), abs(b.low - b.c1)) - p.atr) / 10 AS atr
          FROM r p JOIN b ON b.symbol = p.symbol AND b.rn = p.rn + 1)))
    SELECT symbol, date, CASE WHEN rn > 1 THEN round(CASE WHEN side = 1 THEN lo ELSE hi END, 4) END AS supertrend,
      CASE WHEN rn > 1 THEN side END AS st_direction FROM r""", ("daily_bars",))
def ind_supertrend(spark, sf):
    return _run(spark, sf, "supertrend")


@query("session_levels", """WITH m AS (SELECT sym AS symbol, time_bucket(INTERVAL '1 hour', time) AS date,
      max(price) AS high, min(price) AS low, arg_max(price, (time, seq)) AS close FROM ticks GROUP BY 1, 2),
    s AS (SELECT symbol, date_trunc('day', m.date) AS d, max(high) AS h, min(low) AS l, arg_max(close, m.date) AS c
      FROM m GROUP BY 1, 2),
    p AS (SELECT symbol, d, lag(h) OVER w AS h, lag(l) OVER w AS l, lag(c) OVER w AS c FROM s
      WINDOW w AS (PARTITION BY symbol ORDER BY d)),
    q AS (SELECT *, (h + l + c) / 3 AS pp FROM p)
    SELECT symbol, date, round(pp, 4) AS pp, round(2 * pp - l, 4) AS r1, round(2 * pp - h, 4) AS s1,
      round(pp + (h - l), 4) AS r2, round(pp - (h - l), 4) AS s2, round(h + 2 * (pp - l), 4) AS r3,
      round(l - 2 * (h - pp), 4) AS s3
    FROM m JOIN q USING (symbol) WHERE q.d = date_trunc('day', m.date)""", ("ticks",))
def session_levels(spark, sf):
    from marketloom.operators import bars
    m = bars.from_ticks(views.ticks(spark, sf), "1h").withColumnRenamed("sym", "symbol")
    return _run(spark, sf, "pivots_standard", m)


@query("indicators_together", f"""WITH s AS (SELECT *, {_PREV}, {_roll('avg', 'adj_close', 20)} AS m,
      {_roll('stddev_pop', 'adj_close', 20)} AS sd, {_roll('max', 'high', 14)} AS hh, {_roll('min', 'low', 14)} AS ll
      FROM part_bars WINDOW w AS (PARTITION BY symbol ORDER BY date)),
    t AS (SELECT *, {_TR}, sum(tp * volume) OVER w / sum(volume) OVER w AS cv FROM s
      WINDOW w AS (PARTITION BY symbol ORDER BY date))
    SELECT symbol, date, round(m, 4) AS sma, round(m + 2 * sd, 4) AS bb_up, round(cv, 4) AS vwap,
      round(-100 * (hh - close) / nullif(hh - ll, 0), 4) AS willr,
      round({_roll('sum', 'tr', 14)} / 14, 4) AS mean_tr FROM t""", ("part_bars",))
def indicators_together(spark, sf):
    reqs = [ind.resolve("sma", period=20), ind.resolve("bbands"), ind.resolve("vwap"), ind.resolve("willr"),
            ind.resolve("sma", period=20)]
    # only what the requests read travels with the rows
    bars = views.part_bars(spark, sf).select("symbol", "date", "high", "low", "close", "adj_close", "volume")
    out = ind.compute(bars, [*reqs, _mean_range()])
    return out.select("symbol", "date", *[F.round(F.col(f"`{c}`"), 4).alias(a) for c, a in (
        ("sma|period=20", "sma"), ("bb_up|k=2.0,period=20", "bb_up"), ("willr|period=14", "willr"),
        ("mean_tr|period=14", "mean_tr"), ("vwap", "vwap"))])


def _mean_range():
    """A user-registered indicator: plain mean of the true range."""
    if "mean_tr" not in ind.REGISTRY:
        @ind.indicator("mean_tr", ("mean_tr",), "raw", "window", "Volatility", lambda p: p["period"] + 1,
                       windows=("period",), period=14)
        def declare(plan, p):
            return {"mean_tr": F.col(plan.rolling("mean", plan.true_range(), p["period"]))}
    return ind.resolve("mean_tr")


@query("bundle_squeeze", f"""WITH RECURSIVE l AS (SELECT *, {_PREV} FROM daily_bars WINDOW w AS (PARTITION BY symbol ORDER BY date)),
      t AS (SELECT *, {_TR}, row_number() OVER (PARTITION BY symbol ORDER BY date) AS rn, {_roll('avg', 'adj_close', 20)} AS m,
        {_roll('stddev_pop', 'adj_close', 20)} AS sd FROM l),
      b AS MATERIALIZED (SELECT * FROM t),
      r AS (SELECT symbol, rn, adj_close AS e, tr AS a10, tr AS a14 FROM b WHERE rn = 1 UNION ALL
        SELECT b.symbol, b.rn, p.e * 19 / 21 + b.adj_close * 2 / 21, p.a10 * 9 / 10 + b.tr / 10, p.a14 * 13 / 14 + b.tr / 14
        FROM r p JOIN b ON b.symbol = p.symbol AND b.rn = p.rn + 1)
    SELECT symbol, date, round(m + 2 * sd, 4) AS bb_up, round(e + 1.5 * a10, 4) AS kc_up, round(4 * sd / m * 100, 4) AS bandwidth,
      round((adj_close - (m - 2 * sd)) / nullif(4 * sd, 0), 4) AS pct_b, round(a14, 4) AS atr FROM b JOIN r USING (symbol, rn)""", ("daily_bars",))
def bundle_squeeze(spark, sf):
    from marketloom.functions.requests import shipped
    out = ind.compute(views.daily_bars(spark, sf), shipped("volatility-squeeze").requests())
    picks = {c.split("|")[0]: c for c in out.columns if "|" in c}
    return out.select("symbol", "date", *[F.round(F.col(f"`{picks[n]}`"), DIGITS).alias(n) for n in ("bb_up", "kc_up", "bandwidth", "pct_b", "atr")])
