"""From landed payloads to assertions: normalise, check, supersede; job logs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marketloom.operators.temporal import INTERVALS, assertions, parse_context

#: Business keys of promotable relations (fixed values).
KEYS = {"prices_normalized": ("listing_id", "market_date"),
        "fundamental_facts": ("issuer_id", "fact", "period_end"),
        "calendar_exceptions": ("calendar_id", "session_date", "assertion_domain")}
#: Provider holiday type to market effect; anything else closes (fixed values).
EFFECTS = {"official": "closed", "closed": "closed", "early_close": "early_close",
           "half_day": "early_close", "late_open": "late_open"}
#: Stages that end a job (fixed values).
TERMINAL = ("partial", "rate_limited", "entitlement_denied", "validation_failed", "cancel_pending",
            "cancelled", "failed", "gold_ready")


def land(payloads: DataFrame) -> DataFrame:
    """Captured responses, whole, with the hash and size of what is kept."""
    return payloads.withColumns({"content_hash": F.sha2("payload", 256), "bytes": F.octet_length("payload")})


def fingerprint(*columns: str, chars: int = 24) -> Column:
    """Short content hash of a row."""
    return F.substring(F.sha2(F.to_json(F.struct(*columns)), 256), 1, chars)


def _interval_columns(prefix: str, ident: str, day: str) -> dict[str, Column]:
    at = F.col("observed_at")
    return {
        "effective_from": F.col(day).cast("timestamp"), "effective_to": F.lit(None).cast("timestamp"),
        "observed_at": at, "available_at": at, "system_from": at, "system_to": F.lit(None).cast("timestamp"),
        "assertion_id": F.concat_ws("_", F.lit(f"as_{prefix}"), ident, F.col(day).cast("string"), "capture_id"),
        "assertion_status": F.lit("current"), "supersedes_assertion_id": F.lit(None).cast("string"),
    }


def _iso_day(c: str) -> Column:
    return F.expr(f"try_to_date(substring({c}, 1, 10), 'yyyy-MM-dd')")


def well_formed(payload: Column, kind: str) -> Column:
    """Does a body have the container its dataset is read from?"""
    v = F.try_parse_json(payload)
    if kind == "exchange_calendar":
        return F.coalesce(F.schema_of_variant(F.try_variant_get(v, "$.results.ExchangeHolidays", "variant"))
                          .startswith("OBJECT"), F.lit(False))
    return F.coalesce(F.schema_of_variant(F.try_variant_get(v, "$.results", "variant")).startswith("ARRAY"),
                      F.lit(False))


def daily_prices(landed: DataFrame, price_basis: str = "raw") -> DataFrame:
    """`landed(listing_id, capture_id, observed_at, payload)` to price assertions."""
    shape = "results array<struct<date:string,open:string,high:string,low:string,close:string,volume:string>>"
    rows = (landed.withColumn("_r", F.explode(F.from_json("payload", shape)["results"])).select("*", "_r.*")
            .withColumn("market_date", _iso_day("date")).filter("market_date is not null"))
    nums = ("open", "high", "low", "close", "volume")
    return rows.withColumns({n: F.col(n).try_cast("double") for n in nums}).withColumns(
        {"price_basis": F.lit(price_basis), **_interval_columns("px", "listing_id", "market_date")}).select(
        "listing_id", "market_date", *nums, "price_basis", *INTERVALS)


def exchange_holidays(landed: DataFrame) -> DataFrame:
    """`landed(calendar_id, capture_id, observed_at, payload)` to market-session assertions."""
    shape = "results struct<ExchangeHolidays: map<string, struct<Date:string,Holiday:string,Type:string>>>"
    rows = (landed.withColumn("_r", F.explode(F.map_values(F.from_json("payload", shape)["results"]["ExchangeHolidays"])))
            .select("*", "_r.*").withColumn("session_date", _iso_day("Date")).filter("session_date is not null"))
    table = F.create_map(*[F.lit(x) for pair in EFFECTS.items() for x in pair])
    effect = F.coalesce(F.element_at(table, F.lower(F.coalesce("Type", F.lit("official")))), F.lit("closed"))
    return rows.withColumn("market_effect", effect).withColumns({
        "assertion_domain": F.lit("market_session"), "calendar_system": F.lit("gregorian"),
        "evidence_status": F.lit("estimated"), "authority_type": F.lit("calendar_package"),
        "holiday_name": F.col("Holiday"), "special_open": F.col("market_effect") == "late_open",
        "special_close": F.col("market_effect") == "early_close", "source_version": F.col("capture_id"),
        **_interval_columns("cal", "calendar_id", "session_date")}).select(
        "calendar_id", "session_date", "assertion_domain", "calendar_system", "evidence_status", "authority_type",
        "holiday_name", "market_effect", "special_open", "special_close", "source_version", *INTERVALS)


def shares_outstanding(landed: DataFrame) -> DataFrame:
    """`landed(issuer_id, capture_id, observed_at, payload)` to fact assertions."""
    shape = "results array<struct<shares_outstanding:string,period_end:string,date:string,filing_kind:string>>"
    rows = (landed.withColumn("_r", F.explode(F.from_json("payload", shape)["results"])).select("*", "_r.*")
            .withColumn("value", F.col("shares_outstanding").try_cast("double")).filter("value is not null"))
    period = F.coalesce(F.nullif("period_end", F.lit("")), F.nullif("date", F.lit("")),
                        F.to_date("observed_at").cast("string"))
    rows = rows.withColumn("_p", period).withColumn("period_end", _iso_day("_p")).filter("period_end is not null")
    return rows.withColumns({
        "fact": F.lit("shares_outstanding"), "unit": F.lit("shares"),
        "filing_kind": F.coalesce(F.nullif("filing_kind", F.lit("")), F.lit("provider")),
        **_interval_columns("so", "issuer_id", "period_end")}).select(
        "issuer_id", "fact", "period_end", "value", "unit", "filing_kind", *INTERVALS)


def problems(rows: DataFrame, relation: str) -> DataFrame:
    """Everything wrong with rows about to be promoted, one row per problem."""
    if relation == "prices_normalized":
        found = [F.when(F.col("close").isNull(), "close is missing"),
                 F.when(F.col("high") < F.col("low"), "high below low"),
                 F.when(F.col("volume") < 0, "negative volume")]
    elif relation == "fundamental_facts":
        found = [F.when(F.col("value") <= 0, "non-positive value")]
    else:
        found = [F.lit(None).cast("string")]
    return (rows.withColumn("problem", F.explode(F.array_compact(F.array(*found))))
            .select("assertion_id", *KEYS.get(relation, ()), "problem"))


def supersede(stored: DataFrame, incoming: DataFrame, relation: str, now: Column) -> DataFrame:
    """Rows to append in one commit: a closing row for every current assertion the
    incoming ones replace, and the incoming ones linked to what they replace."""
    keys = list(KEYS[relation])
    old = assertions(stored, parse_context(), effective=False)
    link = old.select(*keys, F.col("assertion_id").alias("_old"))
    new = (incoming.join(link, keys, "left")
           .withColumn("supersedes_assertion_id", F.when(
               F.col("_old") != F.col("assertion_id"), F.col("_old")).otherwise(F.col("supersedes_assertion_id"))))
    replaced = new.filter(F.col("_old") != F.col("assertion_id")).select(*keys).distinct()
    closes = old.join(replaced, keys, "left_semi").withColumns(
        {"system_from": now, "system_to": now, "assertion_status": F.lit("superseded")})
    return closes.unionByName(new.select(*incoming.columns), allowMissingColumns=True)


def job_states(jobs: DataFrame, events: DataFrame) -> DataFrame:
    """Jobs with the state their event log gives them and how many stages it holds.

    The log decides; the newest job row speaks where there is no event yet.
    """
    from marketloom.operators.topk import latest

    row = latest(jobs, ("job_id",), (F.col("seq").desc(),)).drop("seq")
    log = events.groupBy("job_id").agg(
        F.max_by("stage", "seq").alias("_stage"), F.max_by("at", "seq").alias("_at"),
        F.max_by("detail", F.when(F.col("stage").isin(*TERMINAL), F.col("seq"))).alias("_summary"),
        F.count("*").alias("_stages"))
    return row.join(log, "job_id", "left").select(
        "job_id", "kind", "fingerprint", "created_at", F.coalesce("_stage", "state").alias("state"),
        F.coalesce("_at", "updated_at").alias("updated_at"), F.col("_summary").alias("summary"),
        F.coalesce("_stages", F.lit(0).cast("long")).alias("stages"))


def stage_history(events: DataFrame) -> DataFrame:
    """Every job's stages as rows, numbered in order."""
    from marketloom.operators import series

    layout = series.Layout(keys=("job_id",), order=("seq",), bucket_seconds=100_000)
    return series.number(events.select("job_id", "seq", "stage", "at"), layout).withColumnRenamed(series.POS, "place")


def jobs_in_state(states: DataFrame, state: str) -> DataFrame:
    return states.filter(F.col("state") == state).orderBy("created_at", "job_id")


def active_jobs(states: DataFrame) -> DataFrame:
    """The job still at work per request fingerprint; an ended job answers nothing."""
    from marketloom.operators.topk import latest

    return latest(states.filter(~F.col("state").isin(*TERMINAL)), ("fingerprint",),
                  (F.col("created_at"), F.col("job_id")))
