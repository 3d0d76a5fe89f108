"""Small column functions: cleaning, ratios, dates, names, lookups."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Texts that mean "no value" (fixed values).
SENTINELS = ("", "NA", "Unknown")
#: Tenor to maturity name, in curve order (fixed values).
TENORS = {"1M": "month_1", "2M": "month_2", "3M": "month_3", "4M": "month_4", "6M": "month_6", "1Y": "year_1",
          "2Y": "year_2", "3Y": "year_3", "5Y": "year_5", "7Y": "year_7", "10Y": "year_10", "20Y": "year_20",
          "30Y": "year_30"}
#: Country names and two-letter codes to three letters (fixed values).
COUNTRIES = {
    "united_states": "USA", "us": "USA", "united_kingdom": "GBR", "gb": "GBR", "uk": "GBR", "germany": "DEU",
    "de": "DEU", "france": "FRA", "fr": "FRA", "italy": "ITA", "it": "ITA", "spain": "ESP", "es": "ESP",
    "japan": "JPN", "jp": "JPN", "china": "CHN", "cn": "CHN", "india": "IND", "in": "IND", "canada": "CAN",
    "ca": "CAN", "mexico": "MEX", "mx": "MEX", "brazil": "BRA", "br": "BRA", "australia": "AUS", "au": "AUS",
    "south_korea": "KOR", "korea": "KOR", "kr": "KOR", "switzerland": "CHE", "ch": "CHE", "netherlands": "NLD",
    "nl": "NLD", "sweden": "SWE", "se": "SWE", "norway": "NOR", "no": "NOR", "russia": "RUS", "ru": "RUS",
    "turkey": "TUR", "tr": "TUR", "south_africa": "ZAF", "za": "ZAF", "saudi_arabia": "SAU", "sa": "SAU",
    "indonesia": "IDN", "id": "IDN", "argentina": "ARG", "ar": "ARG", "new_zealand": "NZL", "nz": "NZL",
    "ireland": "IRL", "ie": "IRL", "singapore": "SGP", "sg": "SGP", "hong_kong": "HKG", "hk": "HKG",
    "taiwan": "TWN", "tw": "TWN", "poland": "POL", "pl": "POL", "greece": "GRC", "gr": "GRC", "portugal": "PRT",
    "pt": "PRT", "austria": "AUT", "at": "AUT", "belgium": "BEL", "be": "BEL", "denmark": "DNK", "dk": "DNK",
    "finland": "FIN", "fi": "FIN",
}
MONTHS = ("january", "february", "march", "april", "may", "june", "july", "august", "september", "october",
          "november", "december")


def lookup(table: dict[str, str], key: Column) -> Column:
    """Fixed small table as a map literal; null when the key is not in it."""
    return F.try_element_at(F.create_map(*[F.lit(x) for kv in table.items() for x in kv]), key)


def clean(c: Column) -> Column:
    """Text with sentinels as null."""
    return F.when(~c.isin(*SENTINELS), c)


def double(text: Column) -> Column:
    """Text as a double, else null. Every number holds a digit or is a NaN or an infinity;
    other texts are not tried, since each failure costs an exception."""
    return F.when(F.rlike(text, F.lit("[0-9]|[nN][aAfF]")), text.try_cast("double"))


def number(c: Column) -> Column:
    return clean(c.cast("string")).try_cast("double")


def whole(c: Column) -> Column:
    """Integer part of a number."""
    return number(c).cast("long")


def whole_or_null(c: Column) -> Column:
    """Whole sizes as integers, fractional ones as null."""
    return F.when(c == F.floor(c), c.cast("long"))


def day(c: Column) -> Column:
    """Lenient ISO date from text that may carry a time."""
    return F.to_date(F.try_to_timestamp(c))


def percent(c: Column) -> Column:
    return number(c) / 100


def snake(c: Column) -> Column:
    return F.lower(F.regexp_replace(c, "(?<!^)(?=[A-Z])", "_"))


def change(price: Column, previous: Column) -> Column:
    return price - previous


def change_percent(price: Column, previous: Column) -> Column:
    return F.when(previous != 0, (price - previous) / previous)


def bps(diff: Column, base: Column) -> Column:
    return F.when(base != 0, diff / base * 10_000)


def mid(bid: Column, ask: Column) -> Column:
    """Middle of both sides, or whichever side there is."""
    return F.coalesce((bid + ask) / 2, bid, ask)


def pair_code(base: Column, counter: Column, direct: bool = True) -> Column:
    return F.concat(counter, base) if direct else F.concat(base, counter)


def counter_of(pair: Column, base: Column, direct: bool = True) -> Column:
    """The other currency of a pair; the pair itself when the base is not in place."""
    n = F.length(pair) - F.length(base)
    cut = F.when(F.endswith(pair, base), F.substring(pair, F.lit(1), n)) if direct else F.when(
        F.startswith(pair, base), F.substring(pair, F.length(base) + 1, n))
    return F.coalesce(F.nullif(cut, F.lit("")), pair)


def excerpt(c: Column) -> Column:
    return F.nullif(F.substring(c, 1, 280), F.lit(""))


def country(raw: Column) -> Column:
    key = F.trim(raw)
    return F.coalesce(lookup(COUNTRIES, F.lower(key)), F.upper(key))


def fiscal_month(name: Column) -> Column:
    return lookup({m: str(i) for i, m in enumerate(MONTHS, 1)}, F.lower(F.trim(name))).cast("int")


def fiscal_year(end: Column, year_end_month: Column) -> Column:
    """The fiscal year is named for the calendar year it ends in."""
    return F.year(end) + F.when(F.month(end) > F.coalesce(year_end_month, F.lit(12)), 1).otherwise(0)


def fiscal_quarter(end: Column, year_end_month: Column) -> Column:
    m = F.coalesce(year_end_month, F.lit(12))
    return (F.floor(F.pmod(F.month(end) - m - 1, F.lit(12)) / 3) + 1).cast("int")


def split_parts(text: Column) -> tuple[Column, Column]:
    """`4/1` to numbers; an absent or zero denominator is one, bad text is null."""
    num = F.split_part(text, F.lit("/"), F.lit(1)).try_cast("double")
    raw = F.split_part(text, F.lit("/"), F.lit(2))
    den = F.when(raw == "", F.lit(1.0)).otherwise(raw.try_cast("double"))
    return num, F.when(den == 0, F.lit(1.0)).otherwise(den)


def short(c: Column) -> Column:
    """A number without trailing zeros, six significant digits."""
    text = F.format_string("%.6f", c)
    return F.regexp_replace(F.regexp_replace(text, "0+$", ""), "\\.$", "")


def iso_ms(epoch_ms: Column) -> Column:
    return F.date_format(F.timestamp_millis(epoch_ms), "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")


def names_zone(text: Column) -> Column:
    """Does an ISO instant carry a zone?"""
    return F.coalesce(F.rlike(text, F.lit(r"(Z|[+-]\d{2}:?\d{2})$")) & F.try_to_timestamp(text).isNotNull(), F.lit(False))
