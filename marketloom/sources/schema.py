"""Bending incoming frames to a fixed or stored schema."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

_INTEGERS = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)


def enforce(df: DataFrame, schema: T.StructType) -> DataFrame:
    """Unknown columns are refused, missing ones are null, text becomes dates."""
    unknown = [c for c in df.columns if c not in schema.names]
    if unknown:
        raise ValueError(f"unknown column(s): {unknown}")
    return df.select(*[
        (F.col(f.name) if f.name in df.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in schema.fields])


def conform(df: DataFrame, stored: T.StructType) -> tuple[DataFrame, list[str]]:
    """Cast columns to their stored types; a column that would lose anything is left
    alone and named in the second value. One pass decides for all columns."""
    types = {f.name: f.dataType for f in stored.fields}
    wanted = {f.name: types[f.name] for f in df.schema.fields if f.name in types and f.dataType != types[f.name]}
    if not wanted:
        return df, []
    checks = []
    for name, kind in wanted.items():
        c = F.col(name)
        cast = c.try_cast(kind)
        kept = cast.isNotNull()
        if isinstance(kind, _INTEGERS):
            kept = kept & (cast.cast("double") == c.try_cast("double"))
        checks.append(F.coalesce(F.bool_and(c.isNull() | kept), F.lit(True)).alias(name))
    verdict = df.agg(*checks).first().asDict()
    lossy = [n for n, ok in verdict.items() if not ok]
    return df.withColumns({n: F.col(n).try_cast(k) for n, k in wanted.items() if n not in lossy}), lossy


def normalize_dates(df: DataFrame, column: str | None = None) -> DataFrame:
    """Any input to a frame with a `date` timestamp, first column, rows unchanged.

    The `date` column in any spelling, else the first timestamp or date column, else
    the first text column whose values read as dates. Numeric keys stay as they are.
    """
    if column is None:
        by_name = next((c for c in df.columns if c.lower() == "date"), None)
        by_type = next((f.name for f in df.schema.fields if isinstance(
            f.dataType, (T.TimestampType, T.TimestampNTZType, T.DateType))), None)
        texts = [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)]
        column = by_name or by_type
        if column is None and texts:  # one pass types all text columns
            reads = df.agg(*[(F.bool_and(F.try_to_timestamp(c).isNotNull() | F.col(c).isNull()) & (F.count(c) > 0)).alias(c) for c in texts]).first()
            column = next((c for c in texts if reads[c]), None)
    if column is None:
        return df
    kind = df.schema[column].dataType
    at = F.try_to_timestamp(F.col(column)) if isinstance(kind, T.StringType) else F.col(column).cast("timestamp")
    if isinstance(kind, T.NumericType):
        return df
    return df.select(at.alias("date"), *[c for c in df.columns if c != column])


def temporal_columns(df: DataFrame) -> list[str]:
    """Columns a time filter can use, by type."""
    return [f.name for f in df.schema.fields if isinstance(f.dataType, (T.TimestampType, T.TimestampNTZType, T.DateType))]


def seed(stored: DataFrame, rows: DataFrame, keys: tuple[str, ...] = ("assertion_id", "system_from")) -> DataFrame:
    """Rows not stored yet, to append."""
    return rows.join(stored.select(*keys), list(keys), "left_anti")
