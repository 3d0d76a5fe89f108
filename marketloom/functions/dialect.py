"""SQL function names of other engines, as Spark SQL.

`register` defines the scalar ones as session functions, so query text that calls
them runs unchanged; `SPELLING` names Spark's own word for the rest (aggregates,
and names Spark gives another meaning).
"""

from __future__ import annotations

from pyspark.sql import SparkSession

#: Scalar functions: signature -> (type, Spark expression) (fixed values).
SCALARS: dict[str, tuple[str, str]] = {
    "strpos(s STRING, t STRING)": ("INT", "instr(s, t)"),
    "starts_with(s STRING, t STRING)": ("BOOLEAN", "startswith(s, t)"),
    "ends_with(s STRING, t STRING)": ("BOOLEAN", "endswith(s, t)"),
    "prefix(s STRING, t STRING)": ("BOOLEAN", "startswith(s, t)"),
    "suffix(s STRING, t STRING)": ("BOOLEAN", "endswith(s, t)"),
    "regexp_matches(s STRING, p STRING)": ("BOOLEAN", "regexp_like(s, p)"),
    "string_split(s STRING, d STRING)": ("ARRAY<STRING>", "split(s, concat('\\\\Q', d, '\\\\E'))"),
    "list_contains(l ARRAY<STRING>, v STRING)": ("BOOLEAN", "array_contains(l, v)"),
    "list_extract(l ARRAY<STRING>, i INT)": ("STRING", "try_element_at(l, i)"),
    "array_extract(l ARRAY<STRING>, i INT)": ("STRING", "try_element_at(l, i)"),
    "json_extract_string(j STRING, p STRING)": ("STRING", "get_json_object(j, p)"),
    "json_valid(j STRING)": ("BOOLEAN", "j IS NOT NULL AND try_parse_json(j) IS NOT NULL"),
    "json_type(j STRING)": ("STRING", "schema_of_variant(try_parse_json(j))"),
    "epoch(t TIMESTAMP)": ("DOUBLE", "unix_micros(t) / 1e6D"),
    "epoch_ms(t TIMESTAMP)": ("BIGINT", "CAST(floor((unix_micros(t) + 500) / 1000) AS BIGINT)"),
    "isodow(t TIMESTAMP)": ("INT", "weekday(t) + 1"),
    "today()": ("DATE", "current_date()"),
    "log10_of(x DOUBLE)": ("DOUBLE", "log10(x)"),
    "sha256(s STRING)": ("STRING", "sha2(s, 256)"),
    "to_zone(zone STRING, t TIMESTAMP)": ("TIMESTAMP", "from_utc_timestamp(t, zone)"),
    "strip_accents(s STRING)": ("STRING", "translate(s, 'àáâãäåçèéêëìíîïñòóôõöùúûüýÿÀÁÂÃÄÅÇÈÉÊËÌÍÎÏÑÒÓÔÕÖÙÚÛÜÝ', "
                                          "'aaaaaaceeeeiiiinooooouuuuyyAAAAAACEEEEIIIINOOOOOUUUUY')"),
}

#: Names Spark has under another word or meaning (fixed values).
SPELLING: dict[str, str] = {
    "//": "div", "**": "power", "^": "power", "log": "log10", "random": "rand", "printf": "format_string",
    "format": "format_string", "date_diff": "timestampdiff", "dayofweek": "dayofweek - 1", "age": "subtraction of timestamps",
    "strftime": "date_format with java_pattern", "strptime": "to_timestamp with java_pattern", "timezone": "to_zone",
    "list_value": "array", "struct_pack": "named_struct", "struct_extract": "field access", "unnest": "explode",
    "json_extract": "variant_get", "json": "parse_json", "arg_min": "min_by", "arg_max": "max_by", "quantile": "percentile",
    "quantile_cont": "percentile_cont within group", "quantile_disc": "percentile_disc within group", "string_agg": "listagg",
    "list": "collect_list", "array_agg": "collect_list", "count_star": "count(*)", "variance": "var_samp", "hash": "xxhash64",
}

#: strftime letters and Java's (fixed values).
_PATTERN = {"%Y": "yyyy", "%m": "MM", "%d": "dd", "%H": "HH", "%M": "mm", "%S": "ss", "%f": "SSSSSS", "%y": "yy", "%B": "MMMM",
            "%b": "MMM", "%A": "EEEE", "%a": "EEE", "%j": "DDD", "%p": "a", "%I": "hh", "%%": "%"}


def java_pattern(text: str) -> str:
    """`%Y-%m-%d` as Spark's date pattern; plain letters are quoted."""
    out, i = "", 0
    while i < len(text):
        two = text[i:i + 2]
        if two in _PATTERN:
            out, i = out + _PATTERN[two], i + 2
        else:
            out, i = out + (f"'{text[i]}'" if text[i].isalpha() else text[i]), i + 1
    return out


def register(spark: SparkSession) -> list[str]:
    """Define the scalar functions in this session."""
    for signature, (kind, body) in SCALARS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {signature} RETURNS {kind} RETURN {body}")
    return [s.split("(")[0] for s in SCALARS]
