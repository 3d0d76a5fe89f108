"""Bitemporal assertions: which rows count under a context, and the views on them.

Silver relations are append-only tables of assertions. A context says which of
them a reader may see; nothing is ever updated, "current" is always a query.
"""

from __future__ import annotations

from dataclasses import dataclass
from datetime import datetime
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marketloom.functions.requests import require_instant
from marketloom.operators.topk import latest

#: Temporal modes and the one availability policy.
MODES = ("current_corrected", "known_at", "effective_on", "delta_snapshot", "captured_by")
POLICIES = ("local_as_ingested",)

#: Interval columns that end every silver relation (fixed values).
INTERVALS = ("effective_from", "effective_to", "observed_at", "available_at", "system_from", "system_to",
             "capture_id", "assertion_id", "assertion_status", "supersedes_assertion_id")

#: Views, their keys and the relations they read (fixed values).
GOLD = {
    "security_master": (("listing_id",), ("listings", "issuers", "securities", "instruments", "identifiers")),
    "price_daily": (("listing_id", "market_date"), ("prices_normalized", "listings")),
    "corporate_actions": (("listing_id", "action_type", "ex_date"), ("corporate_actions", "listings")),
    "universe_membership": (("universe_id", "listing_id"), ("universe_membership", "listings")),
    "market_calendar": (("calendar_id", "session_date"),
                        ("market_sessions", "calendar_exceptions", "exchanges", "session_interruptions")),
    "odp_equity_info": (("listing_id",), ("listings", "issuers", "fundamental_facts")),
}


@dataclass(frozen=True)
class Context:
    mode: str = "current_corrected"
    effective_at: datetime | None = None
    known_at: datetime | None = None
    availability_policy: str = "local_as_ingested"
    timezone: str = "UTC"
    versions: tuple[tuple[str, int], ...] = ()


def parse_context(raw: dict | None = None) -> Context:
    """A validated context; instants must name their zone."""
    raw = dict(raw or {})
    mode = raw.get("mode", "current_corrected")
    policy = raw.get("availability_policy") or POLICIES[0]
    if mode not in MODES:
        raise ValueError(f"unknown temporal mode {mode!r}; expected one of {MODES}")
    if policy not in POLICIES:
        raise ValueError(f"availability policy {policy!r} is not available")
    needs = {"effective_on": "effective_at", "known_at": "known_at", "captured_by": "known_at"}.get(mode)
    if needs and raw.get(needs) is None:
        raise ValueError(f"{needs} is required for mode {mode}")
    at = {k: None if raw.get(k) is None else require_instant(raw[k]) for k in ("effective_at", "known_at")}
    versions = raw.get("versions") or {}
    if not isinstance(versions, dict) or not all(isinstance(v, int) for v in versions.values()):
        raise ValueError("versions must map a relation to an integer version")
    return Context(mode, at["effective_at"], at["known_at"], policy, str(raw.get("timezone") or "UTC"),
                   tuple(sorted(versions.items())))


def _open_at(start: str, end: str, at: datetime) -> Column:
    t = F.lit(at)
    return (F.col(start) <= t) & (F.col(end).isNull() | (F.col(end) > t))


def in_force(ctx: Context) -> Column:
    """Is an interval row the one in force? Without an instant: nobody closed it."""
    if ctx.effective_at is None:
        return F.col("effective_to").isNull()
    t = F.lit(ctx.effective_at)
    return ((F.col("effective_from").isNull() | (F.col("effective_from") <= t))
            & (F.col("effective_to").isNull() | (F.col("effective_to") > t)))


def assertions(df: DataFrame, ctx: Context, effective: bool = True) -> DataFrame:
    """Rows of one silver relation under the context.

    The order is part of the meaning: what was not yet recorded goes first, then
    the latest row of each assertion is taken, then that row must still count.
    `effective=False` suits relations whose own date is the effective axis.
    """
    if ctx.mode == "known_at":
        df = df.filter(F.col("system_from") <= F.lit(ctx.known_at))
    df = latest(df, ("assertion_id",), (F.col("system_from").desc(), F.col("available_at").desc_nulls_last(),
                                        F.col("system_to").desc_nulls_last()))
    if ctx.mode == "known_at":
        k = F.lit(ctx.known_at)
        df = df.filter((F.col("available_at") <= k) & (F.col("system_to").isNull() | (F.col("system_to") > k)))
    elif ctx.mode == "captured_by":
        df = df.filter(F.col("observed_at") <= F.lit(ctx.known_at))
    elif ctx.mode in ("current_corrected", "effective_on"):
        df = df.filter(F.col("system_to").isNull() & (F.col("assertion_status") == "current"))
    if effective and ctx.effective_at is not None and ctx.mode not in ("delta_snapshot", "captured_by"):
        df = df.filter(_open_at("effective_from", "effective_to", ctx.effective_at))
    return df


Silver = dict[str, DataFrame]


def gold(name: str, silver: Silver, ctx: Context) -> DataFrame:
    return {
        "security_master": security_master, "price_daily": price_daily,
        "corporate_actions": corporate_actions, "universe_membership": universe_membership,
        "odp_equity_info": equity_info, "market_calendar": market_calendar,
    }[name](silver, ctx)


def security_master(silver: Silver, ctx: Context) -> DataFrame:
    """Listings with their issuer's name and their security's identity."""
    issuer = assertions(silver["issuers"], ctx).select("issuer_id", F.col("name").alias("issuer_name"))
    security = assertions(silver["securities"], ctx).select(
        "security_id", "cusip", "successor_security_id", "predecessor_security_id")
    return (assertions(silver["listings"], ctx)
            .join(issuer, "issuer_id", "left").join(security, "security_id", "left")
            .select("listing_id", "instrument_id", "issuer_id", "security_id", "exchange_id", "mic", "symbol",
                    "provider_symbol", "currency", "status", "name", "instrument_type", "issuer_name", "cusip",
                    "successor_security_id", "predecessor_security_id", "assertion_id", "capture_id",
                    "effective_from", "effective_to", "available_at", "system_from"))


def price_daily(silver: Silver, ctx: Context) -> DataFrame:
    return assertions(silver["prices_normalized"], ctx, False).select(
        "listing_id", "market_date", "open", "high", "low", "close", "volume", "price_basis",
        "assertion_id", "capture_id", "available_at", "system_from", "supersedes_assertion_id")


def corporate_actions(silver: Silver, ctx: Context) -> DataFrame:
    return assertions(silver["corporate_actions"], ctx, False).select(
        "listing_id", "action_type", "ex_date", "ratio", "amount", "currency",
        "assertion_id", "capture_id", "available_at")


def universe_membership(silver: Silver, ctx: Context) -> DataFrame:
    return assertions(silver["universe_membership"], ctx).select(
        "universe_id", "listing_id", "effective_from", "effective_to", "assertion_id", "capture_id",
        "available_at")


def equity_info(silver: Silver, ctx: Context) -> DataFrame:
    """Listings with their issuer's newest shares-outstanding fact."""
    facts = assertions(silver["fundamental_facts"], ctx, False).filter("fact = 'shares_outstanding'")
    newest = latest(facts, ("issuer_id",), (F.col("period_end").desc(), F.col("available_at").desc(),
                                            F.col("assertion_id").desc()))
    shares = newest.select("issuer_id", F.col("value").alias("shares_outstanding"), "period_end", "filing_kind",
                           *[F.col(c).alias(f"shares_{c}") for c in ("assertion_id", "capture_id", "available_at")])
    own = assertions(silver["listings"], ctx).select(
        "listing_id", "symbol", "name", "issuer_id", "mic", "currency", "assertion_id", "capture_id")
    return own.join(shares, "issuer_id", "left")


#: How each output of the calendar falls back over market, holiday and session
#: evidence, in that order of trust (fixed values).
_EVIDENCE = {
    "authority_type": ("m", "h"), "authority_name": ("m", "h"), "authority_verified_at": ("m", "h"),
    "supersedes_assertion_id": ("m", "h"), "source_version": ("m", "h", "s"), "rule_id": ("m", "h", "s"), "effective_from": ("m", "h", "s"),
    "effective_to": ("m", "h", "s"), "capture_id": ("m", "h", "s"), "market_open": ("m", "s"), "market_close": ("m", "s"),
}
_SPECIAL = ("early_close", "late_open", "special_session")


def market_calendar(silver: Silver, ctx: Context) -> DataFrame:
    """Every day any evidence speaks of, with the newest of each kind joined on.

    Each side is reduced to the calendar day before the joins, so all of them run
    on one partitioning by (calendar_id, session_date).
    """
    day = ["calendar_id", "session_date"]
    newest = (F.col("available_at").desc(), F.col("system_from").desc(), F.col("assertion_id").desc())
    evidence = assertions(silver["calendar_exceptions"], ctx, False)

    def side(rows: DataFrame, tag: str) -> DataFrame:
        return rows.select(*day, F.struct(*[c for c in rows.columns if c not in day]).alias(tag))

    h = side(latest(evidence.filter("assertion_domain = 'holiday_date'"), tuple(day), newest), "h")
    m = side(latest(evidence.filter("assertion_domain = 'market_session'"), tuple(day), newest), "m")
    s = side(assertions(silver["market_sessions"], ctx, False), "s")
    days = reduce(DataFrame.union, [x.select(*day) for x in (h, m, s)]).distinct()
    e = assertions(silver["exchanges"], ctx).select(
        "calendar_id", "exchange_id", F.col("name").alias("exchange_name"), "mic", "calendar_alias", "timezone")
    joined = days
    for x in (h, m, s):
        joined = joined.join(x, day, "left")
    joined = joined.join(e, "calendar_id", "left")

    effect = F.col("m.market_effect")
    has_h, has_m, has_s = (F.col(x).isNotNull() for x in "hms")
    status = (F.when(effect == "closed", "closed").when(effect.isin(*_SPECIAL), "special")
              .when(effect == "interrupted", "interrupted").when(effect.isNull() & has_h, "unknown")
              .when((effect == "open") | (effect == "none") | has_s, "open").otherwise("unknown"))

    def first(name: str, order: tuple[str, ...], default: Column | None = None) -> Column:
        found = [F.col(f"{x}.{name}") for x in order]
        return F.coalesce(*found, *([default] if default is not None else []))

    return joined.select(
        "calendar_id", "exchange_id", "exchange_name", "mic", "calendar_alias", "session_date",
        F.coalesce("s.trade_date", "session_date").alias("trade_date"), "timezone",
        status.alias("session_status"),
        first("calendar_system", ("h", "m"), F.lit("gregorian")).alias("calendar_system"),
        F.col("h.holiday_family").alias("holiday_family"),
        F.when(has_m, "market_session").when(has_h, "holiday_date").alias("assertion_domain"),
        first("evidence_status", ("m", "h"), F.lit("estimated")).alias("evidence_status"),
        F.col("s.break_start").alias("break_start"), F.col("s.break_end").alias("break_end"),
        F.col("h.holiday_name").alias("holiday_name"),
        F.coalesce("m.special_open", F.lit(False)).alias("special_open"),
        F.coalesce("m.special_close", F.lit(False)).alias("special_close"),
        F.coalesce(effect, F.when(has_h, "pending").otherwise("none")).alias("market_effect"),
        first("source_kind", ("m", "h"), F.lit("pandas_rule")).alias("source_kind"),
        first("available_at", ("m", "h", "s")).alias("known_from"), first("system_to", ("m", "h", "s")).alias("known_to"),
        *[first(n, order).alias(n) for n, order in _EVIDENCE.items()],
        F.col("h.assertion_id").alias("holiday_assertion_id"),
        F.col("m.assertion_id").alias("market_assertion_id"),
        *[F.col(f"m.{c}").alias(c) for c in ("candidate_branches", "selected_branch", "expiry_date",
                                             "settlement_status")],
    )


def with_interruptions(calendar: DataFrame, silver: Silver, ctx: Context, breaks: bool = False,
                       interruptions: bool = True, label: str = "session_date") -> DataFrame:
    """Calendar rows with their halts as an array, breaks only when asked for, branch
    columns as variants, and optionally relabelled by trade date."""
    day = ["calendar_id", "session_date"]
    halts = assertions(silver["session_interruptions"], ctx, False)
    if not interruptions:
        halts = halts.limit(0)
    grouped = halts.groupBy(*day).agg(F.array_sort(F.collect_list(F.struct(
        F.col("interruption_start").alias("start"), F.col("interruption_end").alias("end")))).alias("interruptions"))
    out = calendar.join(grouped, day, "left").withColumn(
        "interruptions", F.coalesce("interruptions", F.array().cast("array<struct<start:timestamp,end:timestamp>>")))
    if not breaks:
        out = out.withColumns({c: F.lit(None).cast("timestamp") for c in ("break_start", "break_end")})
    # Text that is not JSON must fail, not become null.
    out = out.withColumns({c: F.parse_json(c) for c in ("candidate_branches", "selected_branch")})
    return out.withColumn("session_date", F.col("trade_date")) if label == "trade_date" else out


def calendar_id(exchanges: DataFrame, mic: str | None = None, exchange: str | None = None) -> DataFrame:
    """The calendars a mic or an exchange alias names, and whether exactly one does."""
    if not (mic or exchange):
        raise ValueError("calendar_id, mic or exchange is required")
    named = F.lit(False)
    if mic:
        named = named | (F.upper("mic") == mic.upper())
    if exchange:
        named = named | (F.upper(F.coalesce("calendar_alias", "name")) == exchange.upper())
    found = exchanges.filter(named).select("calendar_id").distinct()
    n = found.agg(F.count("*")).scalar()
    return found.withColumn("status", F.when(n == 1, "resolved").otherwise("ambiguous"))


def calendar_warnings(calendar: DataFrame) -> DataFrame:
    """Days whose market effect is pending or whose evidence is not final."""
    final = ("market_final", "observed")
    return (calendar.filter((F.col("market_effect") == "pending") | ~F.col("evidence_status").isin(*final))
            .select("calendar_id", "session_date", "market_effect", "evidence_status"))


def modal_hours(calendar: DataFrame) -> DataFrame:
    """Most common (open, close) clock pair per calendar over ordinary sessions."""
    usual = calendar.filter((F.col("market_effect") == "open") & (F.col("session_status") == "open")
                            & ~F.col("special_open") & ~F.col("special_close")
                            & F.col("market_open").isNotNull() & F.col("market_close").isNotNull())
    clock = usual.select("calendar_id", F.date_format("market_open", "HH:mm:ss").alias("open"),
                         F.date_format("market_close", "HH:mm:ss").alias("close"))
    counted = clock.groupBy("calendar_id", "open", "close").agg(F.count("*").alias("n"))
    return latest(counted, ("calendar_id",), (F.col("n").desc(), F.col("open"), F.col("close"))).drop("n")


def calendar_envelope(calendar: DataFrame) -> DataFrame:
    """Per calendar: zone, usual hours, and a map of holidays and early closes.

    A calendar without a zone or without usual hours has no envelope.
    """
    iso = F.col("session_date").cast("string")
    closed = F.col("market_effect") == "closed"
    entry = F.when(closed, F.struct(
        F.coalesce("holiday_name", F.lit("Exchange holiday")).alias("holiday"), F.lit("Official").alias("type"),
        F.lit(None).cast("string").alias("early_close"))).when(
        F.col("special_close") & F.col("market_close").isNotNull(), F.struct(
            F.coalesce("holiday_name", F.lit("Early close")).alias("holiday"), F.lit("EarlyClose").alias("type"),
            F.date_format("market_close", "HH:mm:ss").alias("early_close")))
    days = (calendar.withColumn("_e", entry).groupBy("calendar_id")
            .agg(F.max("timezone").alias("timezone"),
                 F.map_from_entries(F.array_sort(F.collect_list(
                     F.when(F.col("_e").isNotNull(), F.struct(iso.alias("k"), F.col("_e").alias("v")))))).alias("holidays")))
    return days.filter("timezone is not null").join(modal_hours(calendar), "calendar_id")


def state_at(states: DataFrame, cutoffs: DataFrame, keys: tuple[str, ...] = ("fixture_id",)) -> DataFrame:
    """The last state known at each inclusive cutoff."""
    from marketloom.operators.asof import backward

    facts = states.withColumnRenamed("known_from", "time")
    return backward(cutoffs.withColumnRenamed("cutoff", "time"), facts, keys, "time", None).withColumnRenamed(
        "time", "cutoff")


def state_problems(states: DataFrame, evidence: DataFrame, keys: tuple[str, ...] = ("fixture_id",)) -> DataFrame:
    """States that share an instant with another, cite unknown evidence, or evidence
    published after them. `evidence(keys, event_id, known_from)`."""
    twice = (states.groupBy(*keys, "known_from").count().filter("count > 1")
             .select(*keys, "known_from", F.lit(None).cast("string").alias("event_id"),
                     F.lit("not strictly increasing").alias("problem")))
    cited = states.select(*keys, "known_from", F.explode("evidence_event_ids").alias("event_id"))
    known = evidence.select(*keys, "event_id", F.col("known_from").alias("_published"))
    bad = cited.join(known, [*keys, "event_id"], "left").withColumn(
        "problem", F.when(F.col("_published").isNull(), "unknown evidence")
        .when(F.col("_published") > F.col("known_from"), "evidence is later than its state"))
    return twice.unionByName(bad.filter("problem is not null").select(*keys, "known_from", "event_id", "problem"))
