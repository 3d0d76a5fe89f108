"""Stories of any length and with odd parts, in the query as in its SQL."""

import duckdb

import __spark_entry__ as entry
from marketloom.operators import shaping

LONG = 20_000_100  # past the 20 million characters at which the JSON reader ends by itself


def test_news_and_its_sql_agree_on_odd_rows(spark, tmp_path):
    con = duckdb.connect()
    con.execute(f"""COPY (SELECT * FROM (VALUES (0, '', 'en', 'src0'), (1, NULL, 'en', 'src1'), (2, 't', 'en', ''), (3, 't', 'en', NULL),
        (NULL, 't', 'en', 'src4'), (5, 'é"' || chr(10) || chr(0), NULL, 'src5'), (6, repeat('a ', {LONG // 2}), 'en', 'src6')) AS d(doc_id, text, lang, source))
        TO '{tmp_path}/documents.parquet'""")
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet'")
    want = sorted(con.execute(entry.oracle_sql()["ref_news"]).fetchall(), key=repr)
    got = sorted((tuple(r) for r in entry.queries()["ref_news"](spark, str(tmp_path)).collect()), key=repr)
    assert got == want
    assert [(title, body and len(body), excerpt and len(excerpt)) for _, title, body, excerpt, _ in got] == [
        (" 2", 1, 1), ("src0 0", None, None), ("src1 1", None, None), ("src5 5", 4, 4), ("src6 6", LONG, 280)]


def test_stories_that_no_variant_holds_are_read_by_field(spark):
    # a key written twice in one story makes no variant of the body, as a story over 128 MiB does
    story = '{"date":"d","title":"a","content":"x","content":"y","link":"u","symbols":["S"],"tags":[],"sentiment":{"neg":0.5}}'
    landed = spark.createDataFrame([("w", f'[{story},{{"date":"e","title":"b"}},{{"date":"f"}}]'), ("w", '[{"date":"d","title":"c"},{"da')],
                                   "symbol string, payload string")
    assert sorted(tuple(r) for r in shaping.news(landed).collect()) == [
        ("d", "a", "y", "y", "u", ["S"], None, {"neg": 0.5}), ("e", "b", None, None, None, None, None, None)]


def test_a_long_text_in_a_section_is_read(spark):
    landed = spark.sql(f"""SELECT 'a' AS symbol, concat('{{"X":{{"Y":{{"k":{{"v":"', repeat('x', {LONG}), '"}}}}}}}}') AS payload""")
    v = shaping.entries(landed, "X.Y").selectExpr("symbol", "key", "length(try_variant_get(doc, '$.v', 'string'))")
    assert [tuple(r) for r in v.collect()] == [("A", "k", LONG)]
