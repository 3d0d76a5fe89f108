"""Resolving identifiers, comparing contexts, lineage, projections."""

from __future__ import annotations

from datetime import date
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marketloom.functions.requests import require_instant
from marketloom.operators.temporal import Context, Silver, assertions, gold, in_force
from marketloom.operators.topk import latest

#: Identifier types, the stable ones by prefix, candidate fields.
TYPES = ("ticker", "eodhd_symbol", "cusip", "isin", "figi", "cik", "listing_id", "instrument_id",
         "security_id", "issuer_id")
STABLE = {"lst_": "listing_id", "ins_": "instrument_id", "sec_": "security_id", "iss_": "issuer_id"}
SILVER_BY_KIND = {"security_id": "securities", "issuer_id": "issuers", "instrument_id": "instruments"}
CLAIMS = ("listing_id", "instrument_id", "issuer_id", "security_id", "symbol", "name",
          "successor_security_id", "predecessor_security_id")


def _picked(rows: DataFrame, keys: tuple[str, ...], ctx: Context) -> DataFrame:
    """Per key the row in force, else the one that started last."""
    return latest(rows.withColumn("_on", in_force(ctx)), keys,
                  (F.col("_on").desc(), F.col("effective_from").desc_nulls_last(), F.col("assertion_id")))


def _kind() -> Column:
    guess = F.lit(None).cast("string")
    for prefix, kind in STABLE.items():
        guess = F.when(F.startswith(F.col("ident"), F.lit(prefix)), kind).otherwise(guess)
    return F.coalesce("identifier_type", guess)


def resolve(requests: DataFrame, silver: Silver, ctx: Context, include_historical: bool = True) -> DataFrame:
    """Candidates for each request `(request, identifier, identifier_type)`.

    One row per candidate; a request without one keeps a single row. `status` is
    resolved, none_live (known, but only history, which was not asked for),
    not_effective, unresolved, or ambiguous: several (listing, security) pairs and
    no effective instant to tell them apart.
    """
    asked = requests.select("request", F.trim("identifier").alias("ident"), "identifier_type").withColumn(
        "kind", _kind())
    stable = asked.filter(F.col("kind").isin(*STABLE.values()))
    named = asked.filter(F.col("kind").isNull() | ~F.col("kind").isin(*STABLE.values()))
    rows = _by_name(named, silver, ctx, include_historical).unionByName(
        _by_stable_id(stable, silver, ctx, include_historical))
    pairs = rows.filter("reason is not null").groupBy("request").agg(
        F.count_distinct(F.struct("listing_id", "security_id")).alias("_n"))
    out = asked.select("request", F.col("ident").alias("asked")).join(rows, "request", "left").join(
        pairs, "request", "left")
    status = F.coalesce("_state", F.lit("unresolved"))
    if ctx.effective_at is None:
        status = F.when(F.col("_n") > 1, "ambiguous").otherwise(status)
    return out.select("request", "asked", *CLAIMS, "identifier_type", "identifier", "reason", "effective_from",
                      "effective_to", "assertion_id", "capture_id", status.alias("status"))


def _by_name(asked: DataFrame, silver: Silver, ctx: Context, history: bool) -> DataFrame:
    ids = assertions(silver["identifiers"], ctx, False).withColumnRenamed("identifier_type", "id_type")
    rows = asked.drop("identifier_type").join(
        ids, (F.col("ident") == ids["identifier"]) & (F.col("kind").isNull() | (F.col("kind") == ids["id_type"])))
    rows = rows.withColumn("_live", in_force(ctx))
    about = rows.groupBy("request").agg(F.bool_or("_live").alias("_any"),
                                        F.bool_or(F.col("effective_to").isNotNull()).alias("_past"))
    rows = rows.join(about, "request")
    old = F.lit(history) & ~F.col("_any") & F.col("effective_to").isNotNull()
    rows = rows.withColumn("reason", F.when(F.col("_live"), "active").when(old, "historical_alias"))
    state = (F.when(F.col("_any"), "resolved").when(F.lit(not history), "none_live")
             .when(F.col("_past"), "resolved").otherwise("not_effective"))
    # Rows that are no candidate only carry their request's state, once.
    chosen = rows.filter("reason is not null").withColumn("_state", F.lit("resolved"))
    rest = (rows.withColumn("_state", state).filter("_state <> 'resolved'").select("request", "_state").distinct())
    master = _picked(gold("security_master", silver, ctx), ("listing_id",), ctx).select(
        F.col("listing_id").alias("_lst"), F.struct(*CLAIMS).alias("own"))
    security = _picked(assertions(silver["securities"], ctx, False), ("security_id",), ctx).select(
        F.col("security_id").alias("_sec"), F.lit(True).alias("_found"),
        F.struct("successor_security_id", "predecessor_security_id").alias("sec"))
    joined = (chosen.join(master, chosen["listing_id"] == F.col("_lst"), "left")
              .join(security, chosen["security_id"] == F.col("_sec"), "left"))
    values = {}
    for c in CLAIMS:
        # The alias row's own claim wins; a found security outranks the listing's view of it.
        value = F.col(f"own.{c}")
        if c.endswith("successor_security_id") or c.endswith("predecessor_security_id"):
            value = F.when(F.col("_found"), F.col(f"sec.{c}")).otherwise(value)
        values[c] = F.coalesce(chosen[c], value) if c in chosen.columns else value
    full = joined.select("request", *[v.alias(c) for c, v in values.items()],
                         F.col("id_type").alias("identifier_type"), chosen["identifier"], "reason",
                         chosen["effective_from"], chosen["effective_to"], chosen["assertion_id"],
                         chosen["capture_id"], "_state")
    return full.unionByName(rest, allowMissingColumns=True)


def _by_stable_id(asked: DataFrame, silver: Silver, ctx: Context, history: bool) -> DataFrame:
    master = gold("security_master", silver, ctx)
    kinds = F.array(*[F.struct(F.lit(k).alias("kind"), F.col(k).alias("ident")) for k in STABLE.values()])
    wanted = asked.drop("identifier_type")
    keyed = master.withColumn("_id", F.explode(kinds)).select("*", "_id.*").drop("_id")
    hits = wanted.join(keyed, ["kind", "ident"])
    picked = _picked(hits, ("request", "listing_id"), ctx).withColumn(
        "reason", F.when(F.col("_on"), "active").otherwise("historical_alias"))
    shown = picked if history else picked.filter("reason = 'active'")
    known = picked.select("request").distinct()
    silent = known.join(shown.select("request").distinct(), "request", "left_anti").withColumn(
        "_state", F.lit("none_live"))
    out = shown.withColumn("_state", F.lit("resolved"))
    missing = wanted.join(known, "request", "left_anti")
    for kind, relation in SILVER_BY_KIND.items():
        alone = missing.filter(F.col("kind") == kind).join(
            assertions(silver[relation], ctx, False).withColumn("ident", F.col(kind)), "ident")
        out = out.unionByName(_picked(alone, ("request",), ctx).withColumns(
            {"reason": F.lit("active"), "_state": F.lit("resolved")}), allowMissingColumns=True)
    cols = [F.col(c) for c in CLAIMS]
    return out.select("request", *cols, F.col("kind").alias("identifier_type"), F.col("ident").alias("identifier"),
                      "reason", "effective_from", "effective_to", "assertion_id", "capture_id",
                      "_state").unionByName(silent, allowMissingColumns=True)


# --- comparing two contexts -----------------------------------------------------

#: Fields that name a row's provenance, and fields that name an identity (fixed values).
PROVENANCE = ("assertion_id", "capture_id", "available_at", "system_from", "known_from", "known_to",
              "holiday_assertion_id", "market_assertion_id", "supersedes_assertion_id")
IDENTITY = ("security_id", "listing_id", "instrument_id", "issuer_id")


def compare(left: DataFrame, right: DataFrame, keys: tuple[str, ...], left_ctx: Context, right_ctx: Context) -> DataFrame:
    """Field-by-field differences of one selection under two contexts, classified."""

    def one(df: DataFrame) -> DataFrame:
        order = [c for c in (("effective_from", True), ("system_from", False), ("assertion_id", False))
                 if c[0] in df.columns]
        cols = tuple(F.col(c).desc_nulls_last() if n else F.col(c).desc() for c, n in order)
        return latest(df, keys, cols or tuple(F.col(k) for k in keys))

    fields = [c for c in left.columns if c not in PROVENANCE]
    marks = [c for c in ("assertion_id", "available_at", "supersedes_assertion_id") if c in left.columns]

    def packed(df: DataFrame, side: str) -> DataFrame:
        return one(df).select(
            *[F.col(k).cast("string").alias(k) for k in keys],
            F.struct(*[F.col(c).cast("string").alias(c) for c in dict.fromkeys([*fields, *marks])]).alias(side))

    both = packed(left, "l").join(packed(right, "r"), list(keys), "full_outer")
    pairs = F.array(*[F.struct(F.lit(c).alias("field"), F.col(f"l.{c}").alias("left"), F.col(f"r.{c}").alias("right"))
                      for c in fields])
    long = both.select(*keys, "l", "r", F.inline(pairs)).filter(~F.col("left").eqNullSafe(F.col("right")))
    mark = lambda side, c: F.col(f"{side}.{c}") if c in marks else F.lit(None).cast("string")
    lv, rv = F.col("left"), F.col("right")
    chain = F.when(F.col("field").isin(*IDENTITY) & lv.isNotNull() & rv.isNotNull(), "identity_successor")
    if _effective_only(left_ctx, right_ctx):
        chain = chain.when(rv.isNull(), "expired").otherwise("became_effective")
    else:
        corrected = mark("r", "supersedes_assertion_id") == mark("l", "assertion_id")
        changed = ~mark("l", "assertion_id").eqNullSafe(mark("r", "assertion_id"))
        chain = (chain.when(lv.isNull(), "newly_known").when(rv.isNull(), "expired")
                 .when(corrected, "corrected")
                 .when(changed, F.when(~mark("r", "available_at").eqNullSafe(mark("l", "available_at")), "corrected")
                       .otherwise("superseded"))
                 .otherwise("became_effective"))
    return long.select(*keys, "field", "left", "right", chain.alias("classification"))


def _effective_only(a: Context, b: Context) -> bool:
    """Do the contexts differ in effective time alone?"""
    return (a.mode == b.mode and a.known_at == b.known_at
            and (a.mode == "effective_on" or a.effective_at != b.effective_at))


# --- lineage ----------------------------------------------------------------------


def lineage(asserted: DataFrame, captures: DataFrame, requests: DataFrame, runs: DataFrame) -> DataFrame:
    """Assertion, capture, request and run of many assertions at once, as
    `(assertion_id, hop, kind, id, detail)`; the capture's payload stays out."""

    def hop(df: DataFrame, n: int, kind: str, key: str) -> DataFrame:
        cols = [c for c in df.columns if c not in ("payload", "_root")]
        return df.select(F.col("_root").alias("assertion_id"), F.lit(n).alias("hop"), F.lit(kind).alias("kind"),
                         F.col(key).cast("string").alias("id"), F.to_json(F.struct(*cols)).alias("detail"))

    top = latest(asserted, ("assertion_id",), (F.col("system_from").desc(),)).withColumn("_root", F.col("assertion_id"))
    link = top.select("_root", "capture_id").filter("capture_id is not null")
    caps = link.join(captures, "capture_id")
    reqs = link.join(requests, "capture_id")
    done = reqs.filter("job_id is not null").select("_root", "job_id").join(runs, "job_id")
    return (hop(top, 0, "assertion", "assertion_id").unionByName(hop(caps, 1, "capture", "capture_id"))
            .unionByName(hop(reqs, 2, "request", "request_id")).unionByName(hop(done, 3, "run", "job_id")))


# --- receipts -----------------------------------------------------------------------


def receipt(kind: str, ctx: Context, manifest: DataFrame, request_id: str, fingerprint: str) -> DataFrame:
    """One row per relation an answer was read from, with its pinned version, to append
    to a receipts table. `manifest(symbol, version)`."""
    return manifest.select(
        F.lit(kind).alias("kind"), F.lit(request_id).alias("request_id"), F.lit(fingerprint).alias("fingerprint"),
        F.col("symbol").alias("relation"), "version", F.lit(ctx.mode).alias("mode"),
        F.lit(ctx.effective_at).cast("timestamp").alias("effective_at"), F.lit(ctx.known_at).cast("timestamp").alias("known_at"),
        F.current_timestamp().alias("at"))


# --- relations --------------------------------------------------------------------


def relation_detail(rows: DataFrame, relation: str, layer: str, kind: str, keys: tuple[str, ...], modes: tuple[str, ...]) -> DataFrame:
    """One row per column of a relation, in order, with its type, whether it is a key, the
    modes that the relation answers, and the exact number of rows."""
    columns = F.array(*[F.struct(F.lit(i).alias("place"), F.lit(f.name).alias("column"), F.lit(f.dataType.simpleString()).alias("dtype"),
                                 F.lit(f.name in keys).alias("is_key")) for i, f in enumerate(rows.schema.fields, 1)])
    counted = rows.agg(F.count("*").alias("rows"))
    return counted.select(F.lit(relation).alias("relation"), F.lit(layer).alias("layer"), F.lit(kind).alias("kind"),
                          F.lit(",".join(modes)).alias("modes"), "rows", F.inline(columns))


# --- projections ------------------------------------------------------------------

#: Model -> view, parameters as (name, type, required), modes it answers (fixed values).
MODELS: dict[str, dict[str, Any]] = {
    "EquityInfo": {"view": "odp_equity_info", "params": (("symbol", "string", True),),
                   "modes": ("current_corrected", "effective_on", "known_at")},
    "EquitySearch": {"view": "security_master", "params": (("query", "string", True),),
                     "modes": ("current_corrected", "effective_on")},
    "EquityHistorical": {"view": "price_daily", "params": (("symbol", "string", True), ("start_date", "date", True),
                                                           ("end_date", "date", True)),
                         "modes": ("current_corrected", "known_at", "delta_snapshot")},
    "ReferenceSecurity": {"view": "security_master", "params": (("identifier", "string", True),),
                          "modes": ("current_corrected", "effective_on", "known_at")},
    "ReferenceResolve": {"view": "identifiers", "params": (("identifier", "string", True),
                                                           ("identifier_type", "string", False)),
                         "modes": ("current_corrected", "effective_on", "known_at")},
    "MarketCalendar": {"view": "market_calendar",
                       "params": (("calendar_id", "string", False), ("exchange", "string", False),
                                  ("mic", "string", False), ("start_date", "date", True), ("end_date", "date", True),
                                  ("include_closed", "boolean", False), ("include_breaks", "boolean", False),
                                  ("include_interruptions", "boolean", False), ("session_label", "string", False)),
                       "modes": ("current_corrected", "effective_on", "known_at", "delta_snapshot")},
}


def bind(model: str, params: dict) -> dict:
    """Declared parameters, coerced; unknown or missing ones are refused."""
    declared = {n: (t, req) for n, t, req in MODELS[model]["params"]}
    unknown = sorted(set(params) - set(declared))
    if unknown:
        raise ValueError(f"unknown parameter(s): {unknown}")
    out = {}
    for name, (kind, required) in declared.items():
        value = params.get(name)
        if value is None:
            if required:
                raise ValueError(f"parameter {name} is required")
            out[name] = False if kind == "boolean" else None
        elif kind == "date":
            out[name] = date.fromisoformat(str(value))
        elif kind == "datetime":
            out[name] = require_instant(value)
        elif kind == "boolean" and not isinstance(value, bool):
            raise ValueError(f"parameter {name} is not a boolean")
        else:
            out[name] = value if kind == "boolean" else str(value)
    return out


def project(spark, model: str, params: dict, silver: Silver, ctx: Context) -> DataFrame:
    """One of the six parameterised reads over the views."""
    from marketloom.operators.temporal import calendar_id, with_interruptions

    if ctx.mode not in MODELS[model]["modes"]:
        raise ValueError(f"{ctx.mode} is not supported by {model}")
    p = bind(model, params)
    if model == "ReferenceResolve":
        asked = spark.createDataFrame([(p["identifier"], p["identifier"], p["identifier_type"])],
                                      "request string, identifier string, identifier_type string")
        return resolve(asked, silver, ctx)
    view = gold(MODELS[model]["view"], silver, ctx)
    if model == "EquitySearch":
        text = F.lit(p["query"].upper())
        return (view.filter(F.startswith(F.upper("symbol"), text) | F.contains(F.upper("name"), text))
                .select("symbol", "name", "listing_id", "mic", "instrument_id", "assertion_id", "capture_id")
                .orderBy("symbol", "listing_id").limit(100))
    if model == "MarketCalendar":
        if p["calendar_id"]:
            view = view.filter(F.col("calendar_id") == p["calendar_id"])
        else:
            found = calendar_id(assertions(silver["exchanges"], ctx), p["mic"], p["exchange"])
            view = view.join(found.filter("status = 'resolved'").select("calendar_id"), "calendar_id", "left_semi")
        view = view.filter(F.col("session_date").between(p["start_date"], p["end_date"]))
        if not p["include_closed"]:
            view = view.filter("market_effect <> 'closed'")
        return with_interruptions(view, silver, ctx, p["include_breaks"], p["include_interruptions"],
                                  p["session_label"] or "session_date")
    ident = p.get("symbol") or p.get("identifier")
    asked = spark.createDataFrame([("q", ident, None)], "request string, identifier string, identifier_type string")
    # One identity or a refusal; its ids then reach the scans as literals.
    who = resolve(asked, silver, ctx).select("listing_id", "security_id", "status").distinct().limit(2).collect()
    if len(who) > 1:
        raise LookupError(f"{ident} matches several securities under this context")
    if who[0].status != "resolved":
        raise LookupError(f"{ident} is {who[0].status}")
    listing, security = F.lit(who[0].listing_id), F.lit(who[0].security_id)
    if model == "ReferenceSecurity":
        return view.filter((F.col("listing_id") == listing) | (F.col("security_id") == security)).select(
            "security_id", "cusip", "issuer_id", "successor_security_id", "predecessor_security_id", "listing_id",
            "symbol", "assertion_id", "capture_id")
    view = view.filter(F.col("listing_id") == listing)
    if model == "EquityHistorical":
        return (view.filter(F.col("market_date").between(p["start_date"], p["end_date"]))
                .select(F.col("market_date").alias("date"), "open", "high", "low", "close", "volume", "listing_id",
                        "assertion_id", "capture_id", "supersedes_assertion_id").orderBy("date"))
    return view.select("symbol", "name", "shares_outstanding", "period_end", "filing_kind", "currency", "mic",
                       "listing_id", "assertion_id", "capture_id", "shares_assertion_id", "shares_capture_id")
