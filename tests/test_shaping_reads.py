"""Provider bodies are read once, with the same rows on odd bodies."""

import contextlib
import io

from pyspark.sql import functions as F

from marketloom.operators import shaping


def plan(df):
    with contextlib.redirect_stdout(io.StringIO()) as out:
        df.explain("extended")
    return out.getvalue().split("== Optimized Logical Plan ==")[1].split("== Physical Plan ==")[0]


def rows(df):
    return sorted(map(repr, (r.asDict() for r in df.collect())))


ODD = [("a", '{"Highlights":{"PERatio":1.50,"EarningsShare":"2","DilutedEpsTTM":0,"BookValue":"NA"},"General":{"CurrencyCode":"USD"}}'),
       ("b", '{"Highlights":null,"Technicals":{"Beta":"1e3"}}'), ("c", '{"Highlights":[1,2]}'), ("d", '{"Valuation":"x"}'),
       ("e", '{"General":{"CurrencyCode":["x"]},"Valuation":{"ForwardPE":{"a":1},"PriceSalesTTM":"n. m.","PriceBookMRQ":null}}'),
       ("f", '{"General":{"CurrencyCode":"USD"}}'), ("g", "[]"), ("h", None)]


def test_wide_maps_read_a_body_once_and_say_what_single_fields_say(spark):
    landed = spark.createDataFrame(ODD, "symbol string, payload string")
    docs = shaping.documents(landed)
    has = F.try_variant_get("doc", "$.Highlights", "variant").isNotNull() | F.try_variant_get("doc", "$.Valuation", "variant").isNotNull()
    got = shaping.key_metrics(landed)
    assert rows(got.drop("fiscal_period")) == rows(shaping.pick(docs.filter(has), shaping.METRICS))
    assert rows(shaping.pick_all(docs, shaping.METRICS)) == rows(shaping.pick(docs, shaping.METRICS))
    text = plan(got.filter("pe_ratio is not null"))
    assert text.count("parseJson") + text.count("parse_json") == 1
    assert not any("Filter" in line and "variant_get" in line for line in text.splitlines())


def test_members_come_from_one_parse_and_odd_sections_still_leniently(spark):
    bodies = [("a", '{"X":{"Y":{"k":{"v":1.5},"l":null}}}'), ("b", '{"X":{"Y":[{"v":"1"},2,null]}}'), ("c", '{"X":{"Y":{"k":1,"k":2}}}'),
              ("d", '{"X":{"Y":"[1,2]"}}'), ("e", '{"X":{"Y":3}}'), ("f", '{"X":{}}'), ("g", '{"X":{"Y":[1'), ("h", None)]
    landed = spark.createDataFrame(bodies, "symbol string, payload string")
    got = shaping.entries(landed, "X.Y")
    # the section's text alone, as it was read for every body before
    text = F.get_json_object("payload", "$.X.Y")
    listed = F.transform(F.from_json(text, "array<variant>"), lambda v, i: F.struct(i.cast("string").alias("key"), v.alias("value")))
    members = F.when(F.startswith(F.ltrim(text), F.lit("[")), listed).otherwise(F.map_entries(F.from_json(text, "map<string,variant>")))
    want = landed.select(F.upper("symbol").alias("symbol"), F.explode(members).alias("_m")).select("symbol", "_m.key", F.col("_m.value").alias("doc"))
    show = [F.col(c) for c in ("symbol", "key")] + [F.to_json("doc").alias("doc")]
    assert rows(got.select(*show)) == rows(want.select(*show)) and got.count() == 9
    line = next(x for x in plan(got).splitlines() if "Generate" in x)
    assert line.index("try_variant_get") < line.index("get_json_object")


def test_statement_texts_are_tried_once(spark):
    items = '{"date":"%s","totalRevenue":"1e3","netIncome":" 7 ","ebit":"","a":"NaN","b":"-Infinity","c":"n. m.","d":null,"e":"1d","f":"N"}'
    body = '{"General":{"FiscalYearEnd":"June"},"Financials":{"Income_Statement":{"%s":{' + ",".join(
        f'"{d}":{items % d}' for d in ("2020-03-31", "2020-06-30", "2020-09-30")) + "}}}}"
    landed = spark.createDataFrame([("a", body % "quarterly")], "symbol string, payload string")
    whole, cut = shaping.statements(landed, "income", "quarter"), shaping.statements(landed, "income", "quarter", 2)
    assert whole.count() == 27 and rows(cut) == rows(whole.filter("period_ending > '2020-04-30'"))
    got = {r.item: (r.value, r.text) for r in cut.collect()}
    want = {r.item: (r.v, r.t) for r in spark.sql(
        "SELECT k AS item, try_cast(nullif(v, '') AS double) AS v, CASE WHEN try_cast(v AS double) IS NULL THEN nullif(v, '') END AS t FROM VALUES "
        "('revenue','1e3'),('net_income',' 7 '),('ebit',''),('a','NaN'),('b','-Infinity'),('c','n. m.'),('d',CAST(NULL AS STRING)),('e','1d'),('f','N') AS x(k, v)").collect()}
    assert repr(sorted(got.items())) == repr(sorted(want.items()))
    assert plan(whole).count("try_cast") == 1


def test_newest_periods_are_ranked_with_their_items_as_one_text(spark):
    body = '{"Financials":{"Income_Statement":{"quarterly":{"2020-03-31":{"date":"2020-03-31","a":null},"2020-06-30":{"date":"2020-06-30","a":"\\u00e9\\""}}}}}'
    cut = shaping.statements(spark.createDataFrame([("a", body)], "symbol string, payload string"), "income", "quarter", 1)
    assert [(str(r.period_ending), r.item, r.text) for r in cut.collect()] == [("2020-06-30", "a", 'é"')]
    text = plan(cut)
    above, below = text[:text.index("Window")], text[text.index("Window"):]
    assert "Generate explode(_items" in above and "StructsToJson" in below
