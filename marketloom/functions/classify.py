"""Which feed a symbol belongs to, and how a provider spells it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

UNSUPPORTED = "unsupported"
#: Feeds, their snapshot suffixes, and the suffixes that name a feed.
FEEDS = ("us", "crypto", "forex")
SNAPSHOT_SUFFIX = {"us": ".US", "crypto": ".CC", "forex": ".FOREX"}
FEED_BY_SUFFIX = {"US": "us", "CC": "crypto", "FOREX": "forex"}
#: Currencies on the forex feed (fixed values).
CURRENCIES = ("USD", "EUR", "GBP", "JPY", "CHF", "AUD", "NZD", "CAD", "SEK", "NOK", "DKK", "PLN", "CZK", "HUF", "TRY", "ZAR", "MXN",
              "SGD", "HKD", "CNH", "ILS", "THB", "KRW", "INR", "BRL")
#: What a hyphenated symbol ends with to be crypto (fixed values).
CRYPTO_QUOTES = ("USD", "USDT", "USDC", "EUR", "BTC", "ETH", "GBP", "JPY")


def clean(symbol: Column) -> Column:
    return F.upper(F.trim(symbol))


def _tail(s: Column, mark: str) -> Column:
    return F.substring_index(s, mark, -1)


def feed_of(symbol: Column) -> Column:
    """us, crypto, forex or unsupported; a bare ticker counts as us."""
    s = clean(symbol)
    by_suffix = F.lit(UNSUPPORTED)
    for suffix, feed in FEED_BY_SUFFIX.items():
        by_suffix = F.when(_tail(s, ".") == suffix, feed).otherwise(by_suffix)
    pair = ((F.length(s) == 6) & F.substring(s, 1, 3).isin(*CURRENCIES) & F.substring(s, 4, 3).isin(*CURRENCIES))
    return (F.when(F.contains(s, F.lit(".")), by_suffix)
            .when(F.contains(s, F.lit("-")) & _tail(s, "-").isin(*CRYPTO_QUOTES), "crypto")
            .when(pair, "forex").otherwise("us"))


def snapshot_ticker(symbol: Column) -> Column:
    """Exchange-qualified ticker; qualified or unroutable symbols stay as they are."""
    s, feed = clean(symbol), feed_of(symbol)
    suffix = F.lit("")
    for name, text in SNAPSHOT_SUFFIX.items():
        suffix = F.when(feed == name, text).otherwise(suffix)
    return F.when(F.contains(s, F.lit(".")), s).otherwise(F.concat(s, suffix))


def qualify(symbol: Column, exchange: str = "US") -> Column:
    """`AAPL` -> `AAPL.US`; a symbol that names its exchange stays."""
    s = clean(symbol)
    return F.when(F.contains(s, F.lit(".")), s).otherwise(F.concat(s, F.lit(f".{exchange}")))


def watchlist_feeds(symbols: DataFrame, column: str = "symbol") -> DataFrame:
    """Distinct symbols with their feed; the unsupported ones are told apart, not dropped."""
    s = symbols.select(clean(F.col(column)).alias("symbol")).filter(F.col("symbol") != "").distinct()
    return s.select(feed_of(F.col("symbol")).alias("feed"), "symbol")
