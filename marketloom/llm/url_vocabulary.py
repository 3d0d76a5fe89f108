"""Weighted URL vocabulary: which urls to keep, by rules and by the words they hold.

A url's host is what follows its first `://` up to `/`, `?`, `#` or the end, with A-Z
lower-cased; its path follows up to `?`, `#` or the end. A null url, or one without
`://`, has an empty host and path. A rule (host/path) fits its host and every
subdomain where the path begins with the rule's; the longest fitting rule decides.
Without one, an Aho-Corasick automaton counts the strict and soft terms in host and
path that stand alone (no ASCII letter or digit beside them): one strict term or
`soft_limit` distinct soft ones block. Anything else is allowed. Each row is judged by
itself, so repeated rows and ties change nothing; extra columns are dropped. An empty table
gives no rows; an url of any length is read whole.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Fixed values.
STRICT = ("casino", "escort", "gambling", "hentai", "jackpot", "malware", "payday", "phishing", "poker", "porn",
          "porno", "sex", "spam", "viagra", "warez", "xxx")
SOFT = ("ad", "ads", "adult", "bet", "bonus", "cheap", "click", "coupon", "crack", "dating", "deal", "download", "farm",
        "free", "hot", "keygen", "loan", "lottery", "mirror", "pills", "popup", "prize", "promo", "sale", "seo",
        "serial", "slots", "sponsor", "torrent", "track", "tracker", "win")
RULES = (("net/", "block"), ("example.net/en/", "allow"), ("example.com/de/", "block"), ("org/fr/", "allow"))


@cache
def _automaton(strict: tuple, soft: tuple):
    import ahocorasick

    found = ahocorasick.Automaton()
    for weight, terms in ((2, strict), (1, soft)):
        for term in terms:
            found.add_word(term, (term, weight))
    found.make_automaton()
    return found


def term_hits(text: str, strict: tuple, soft: tuple) -> tuple[set[str], set[str]]:
    """Distinct strict and soft terms that stand alone in a lower-cased text."""
    out: tuple[set[str], set[str]] = (set(), set())
    for end, (term, weight) in _automaton(strict, soft).iter(text):
        start = end - len(term)
        if not ((start >= 0 and text[start].isascii() and text[start].isalnum())
                or (end + 1 < len(text) and text[end + 1].isascii() and text[end + 1].isalnum())):
            out[weight == 1].add(term)
    return out


def _count(strict: tuple, soft: tuple):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            where = batch.schema.get_field_index("where_")
            hits = [term_hits(x, strict, soft) for x in batch.column(where).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [c for i, c in enumerate(batch.columns) if i != where]
                + [pa.array([len(h[k]) for h in hits], pa.int32()) for k in (0, 1)],
                names=[n for n in batch.schema.names if n != "where_"] + ["n_strict", "n_soft"])

    return run


def with_parts(pages: DataFrame) -> DataFrame:
    """page_id, host and path of each url."""
    url = F.coalesce(F.col("url"), F.lit(""))
    rest = F.when(F.instr(url, "://") > 0, F.expr("substring(url, instr(url, '://') + 3)")).otherwise(F.lit(""))
    return (pages.select("page_id", "url").select("page_id", rest.alias("rest_"))
            .select("page_id", F.translate(F.regexp_extract("rest_", r"^([^/?#]*)", 1), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz").alias("host"),
                    F.regexp_extract("rest_", r"^[^/?#]*([^?#]*)", 1).alias("path")))


def matching_rule(rules):
    """The longest rule that fits (host, path), or null."""
    out = F.lit(None).cast("string")
    for rule, _ in sorted(rules, key=lambda r: (len(r[0]), r[0])):
        host, _, path = rule.partition("/")
        fits = (F.col("host") == host) | F.col("host").endswith("." + host)
        out = F.when(fits & F.col("path").startswith("/" + path), F.lit(rule)).otherwise(out)
    return out


def judge(pages: DataFrame, rules=RULES, strict: tuple = STRICT, soft: tuple = SOFT, soft_limit: int = 2) -> DataFrame:
    """page_id, host, path, rule, verdict, n_strict and n_soft of every row."""
    lower = F.translate(F.concat("host", "path"), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    parts = with_parts(pages).withColumn("where_", lower)
    schema = f"page_id {dict(parts.dtypes)['page_id']}, host string, path string, n_strict int, n_soft int"
    counted = parts.mapInArrow(_count(tuple(strict), tuple(soft)), schema).withColumn("rule", matching_rule(rules))
    by_rule = F.lit(None).cast("string")
    for rule, verdict in rules:
        by_rule = F.when(F.col("rule") == rule, F.lit(verdict)).otherwise(by_rule)
    by_terms = F.when((F.col("n_strict") >= 1) | (F.col("n_soft") >= soft_limit), F.lit("block")).otherwise(F.lit("allow"))
    return counted.select("page_id", "host", "path", "rule", F.coalesce(by_rule, by_terms).alias("verdict"), "n_strict", "n_soft")


def judge_sql(rules=RULES, strict: tuple = STRICT, soft: tuple = SOFT, soft_limit: int = 2) -> str:
    """The same as DuckDB SQL over a view `pages`."""
    def count(terms):
        return f"CAST(len(list_filter([{', '.join(repr(t) for t in terms)}], lambda t: regexp_matches(w, '(^|[^a-z0-9])' || t || '([^a-z0-9]|$)'))) AS INT)"

    fits = " ".join(f"WHEN (host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '/{p}') THEN '{r}'"
                    for r, h, p in ((r, r.partition('/')[0], r.partition('/')[2]) for r, _ in sorted(rules, key=lambda r: (-len(r[0]), r[0]))))
    verdicts = " ".join(f"WHEN rule = '{r}' THEN '{v}'" for r, v in rules)
    upper, low = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    return f"""
WITH cut AS (SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
parts AS (SELECT page_id, translate(regexp_extract(rest, '^([^/?#]*)', 1), '{upper}', '{low}') AS host,
                 regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM cut),
seen AS (SELECT *, translate(host || path, '{upper}', '{low}') AS w, CASE {fits} END AS rule FROM parts),
counted AS (SELECT *, {count(strict)} AS n_strict, {count(soft)} AS n_soft FROM seen)
SELECT page_id, host, path, rule,
       CASE {verdicts} WHEN n_strict >= 1 OR n_soft >= {soft_limit} THEN 'block' ELSE 'allow' END AS verdict, n_strict, n_soft
FROM counted"""
