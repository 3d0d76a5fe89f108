"""Preview of any frame: project, filter, sort, cap, from a plain description."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_NAME = re.compile(r"^[A-Za-z_][A-Za-z0-9_]*$")
#: Filter operators (fixed values).
OPERATORS = ("eq", "ne", "lt", "lte", "gt", "gte", "contains", "starts_with", "in", "between", "is_null", "not_null")


def _column(df: DataFrame, name: object) -> Column:
    if not isinstance(name, str) or not _NAME.match(name) or name not in df.columns:
        raise ValueError(f"invalid column name {str(name)[:40]!r}")
    return F.col(name)


def predicate(df: DataFrame, spec: dict) -> Column:
    """One filter `{field, operator, value}`; text matches ignore case and know no wildcards."""
    c, op, value = _column(df, spec.get("field")), spec.get("operator"), spec.get("value")
    if op not in OPERATORS:
        raise ValueError(f"unsupported operator {op!r}; expected one of {sorted(OPERATORS)}")
    if op == "is_null":
        return c.isNull()
    if op == "not_null":
        return c.isNotNull()
    if op == "in":
        if not isinstance(value, list) or not 1 <= len(value) <= 100:
            raise ValueError("in needs a list of 1..100 values")
        return c.isin(value)
    if op == "between":
        if not isinstance(value, list) or len(value) != 2:
            raise ValueError("between needs two values")
        return c.between(*value)
    if value is None or isinstance(value, (list, dict)):
        raise ValueError(f"{op} needs a scalar value")
    if op in ("contains", "starts_with"):
        text, needle = F.lower(c.cast("string")), F.lit(str(value).lower())
        return F.contains(text, needle) if op == "contains" else F.startswith(text, needle)
    return {"eq": c == value, "ne": c != value, "lt": c < value, "lte": c <= value, "gt": c > value, "gte": c >= value}[op]


def preview(df: DataFrame, columns: list[str] | None = None, filters: list[dict] | None = None,
            sort: list[dict] | None = None, limit: int | None = None) -> DataFrame:
    """The described rows; all of them unless a limit is asked for."""
    for spec in [*(filters or []), *(sort or [])]:
        if not isinstance(spec, dict):
            raise ValueError("filters and sorts are objects")
    keep = reduce(lambda a, b: a & b, [predicate(df, f) for f in filters or []], F.lit(True))
    out = df.filter(keep)
    orders = []
    for s in sort or []:
        way = str(s.get("direction", "asc")).lower()
        if way not in ("asc", "desc"):
            raise ValueError("sort direction must be asc or desc")
        c = _column(df, s.get("field"))
        orders.append(c.asc_nulls_last() if way == "asc" else c.desc_nulls_last())
    if orders:
        out = out.orderBy(*orders)
    if columns:
        out = out.select(*[_column(df, c) for c in columns])
    return _at_most(out, limit)


def _at_most(df: DataFrame, limit: int | None) -> DataFrame:
    if limit is not None and limit < 1:
        raise ValueError(f"a limit of {limit} rows")
    return df if limit is None else df.limit(limit)


def select_ticks(df: DataFrame, symbol: str | None = None, start: str | None = None, end: str | None = None,
                 limit: int | None = None) -> DataFrame:
    """Optional symbol and time bounds on whatever columns hold them; with a limit, the oldest rows."""
    from marketloom.sources.schema import temporal_columns

    name = next((c for c in ("sym", "symbol") if c in df.columns), None)
    time = next(iter(temporal_columns(df)), None)
    if symbol is not None and name:
        df = df.filter(F.col(name) == symbol)
    if time and start:
        df = df.filter(F.col(time) >= F.lit(start).cast("timestamp"))
    if time and end:
        df = df.filter(F.col(time) <= F.lit(end).cast("timestamp"))
    return _at_most(df.orderBy(time) if limit is not None and time else df, limit)
