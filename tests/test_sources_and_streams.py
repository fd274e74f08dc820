import hashlib
import shutil

import pytest
from plumbline.functions import text as T
from plumbline.operators import reports
from plumbline.sources import payloads, sinks
from plumbline.streaming import bars as streams
from plumbline.views import bars
from pyspark.sql import functions as F

SF = "/root/testdata/sf0.001"


def one(spark, *payload):
    return spark.createDataFrame([(p,) for p in payload], "payload string")


def test_klines_refuse_bad_rows(spark):
    good = '["1704067200000","10","12","9","11","5","1704070799999","100","3","1","70","0"]'
    bad = '["1704067200000","10","9","9","11","5","1704070799999","100","3","1","70","0"]'
    rows = payloads.klines(one(spark, f"[{good},{bad},[\"1\"]]")).collect()
    assert [r.reason for r in rows] == [None, "outside_range", "field_count"]
    assert rows[0].order_flow == 40.0 and str(rows[0].open_time) == "2024-01-01 00:00:00"


def test_order_book_and_chart(spark):
    (r,) = payloads.order_book(one(spark, '{"bids":[["10","3"]],"asks":[["10","1"]],"T":0}')).collect()
    assert r.imbalance == 0.5
    rows = payloads.chart(one(spark, '{"timestamp":[0,300],"close":[1.5,null]}')).collect()
    assert [(str(r.at), r.close) for r in rows] == [("1970-01-01 00:00:00", 1.5)]


def test_feed(spark):
    item = "<item><title>{}</title><link>{}</link><pubDate>Tue, 02 Jan 2024 03:04:05 GMT</pubDate></item>"
    xml = "<rss><channel>" + item.format("Rates fall - The Paper", "https://a/1") + item.format("Again", "https://a/1") + item.format("Plain", "http://a/2") + "</channel></rss>"
    (r,) = payloads.rss(one(spark, xml, "<!DOCTYPE x><rss/>")).collect()
    assert r.id == hashlib.sha256(b"https://a/1").hexdigest()[:16] and r.title in ("Rates fall", "Again") and str(r.published) == "2024-01-02 03:04:05"


def test_holdings_and_lists(spark):
    xml = "<informationTable><infoTable><nameOfIssuer>A</nameOfIssuer><cusip>1</cusip><value>1,000</value><shrsOrPrnAmt><sshPrnamt>5</sshPrnamt></shrsOrPrnAmt></infoTable><infoTable><nameOfIssuer>B</nameOfIssuer><cusip>2</cusip><value>0</value></infoTable></informationTable>"
    assert [tuple(r) for r in payloads.holdings(one(spark, xml)).collect()] == [("A", "1", 1000.0, 5.0)]
    eu = '<export><sanctionEntity euReferenceNumber="E1"><nameAlias wholeName="Zed" strong="true" nameLanguage="FR"/><nameAlias wholeName="Able" strong="true" nameLanguage="EN"/><nameAlias wholeName="Aa" strong="false" nameLanguage="EN"/></sanctionEntity></export>'
    assert [tuple(r) for r in payloads.eu_listings(one(spark, eu)).collect()] == [("E1", "Able", 3)]
    un = "<CONSOLIDATED_LIST><INDIVIDUALS><INDIVIDUAL><DATAID>7</DATAID><FIRST_NAME>Ann</FIRST_NAME><SECOND_NAME>Bo</SECOND_NAME><UN_LIST_TYPE>X</UN_LIST_TYPE></INDIVIDUAL></INDIVIDUALS></CONSOLIDATED_LIST>"
    assert [tuple(r) for r in payloads.un_listings(one(spark, un)).collect()] == [("7", "Ann Bo", "X")]
    uk = spark.createDataFrame([("1", "Jo", None, "Doe", "AKA"), ("1", "Joe", "M", "Doe", "Primary name")], "group_id string, name1 string, name2 string, name6 string, alias_type string")
    assert [tuple(r) for r in payloads.uk_listings(uk).collect()] == [("1", "Joe M Doe", 2)]


def test_other_mappers(spark):
    assert payloads.short_interest(one(spark, '{"symbol":"A","settlementDate":"2024-01-15","currentShortPositionQuantity":"12,345"}')).first().shares == 12345
    row = payloads.lobbying(one(spark, '{"client":"c","registrant":"r","income":"10.5","year":2024,"quarter":2,"issues":["TAX","BAN","TAX"]}')).first()
    assert str(row.quarter_start) == "2024-04-01" and row.issues == "BAN,TAX"
    assert payloads.supply_levels(one(spark, '{"date":86400,"circulating":{"a":1.5,"b":2}}')).first().supply == 3.5
    assert payloads.awards(one(spark, '{"id":"1","agency":"a","recipient":"b","amount":"-5","day":"2024-01-01"}')).count() == 0
    forms = payloads.submissions(one(spark, '{"form":["8-K","10-K"],"filingDate":["2024-01-02","2024-01-03"],"accessionNumber":["1","2"]}'))
    assert [r.form for r in payloads.material_forms(forms).collect()] == ["8-K"]
    entities, relations = payloads.catalogue(one(spark, '{"entities":[{"key":"a","kind":"k","name":"n","country":null}],"relationships":[{"src":"a","rel":"owns","dst":"b","source_url":"https://x.y/1"}]}'))
    assert entities.count() == 1 and relations.count() == 1
    assert payloads.ratio_levels(one(spark, '[{"timestamp":0,"fundingRate":"0.01"},{"timestamp":1,"fundingRate":"x"}]').withColumn("k", F.lit(1)), "k", "fundingRate").count() == 1


def test_scalar_functions(spark):
    rows = spark.createDataFrame([("  Acme   Holding  INC ", "1,234.5", "https://sec.gov/x", "p25"), ("=x", "1,23", "http://a.b", "p0")], "n string, v string, u string, t string")
    got = rows.select(T.normalize_name(F.col("n")).alias("n"), F.array_join(T.name_tokens(F.col("n")), " ").alias("k"), T.number(F.col("v")).alias("v"), T.public_url(F.col("u")).alias("u"), T.tier_percent(F.col("t")).alias("t"), T.csv_cell(F.col("n")).alias("c")).collect()
    assert tuple(got[0])[:5] == ("acme holding inc", "acme", 1234.5, True, 25)
    assert tuple(got[1]) == ("=x", "x", None, False, None, "'=x")


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([(1, "=a"), (2, "b")], "i int, t string")
    sinks.export_csv(df, str(tmp_path / "csv"))
    assert {r.t for r in spark.read.option("header", True).csv(str(tmp_path / "csv")).collect()} == {"'=a", "b"}
    sinks.export_json(df, str(tmp_path / "json"))
    assert sinks.backup(df, str(tmp_path / "copy")) == 2
    lines = sinks.chained([{"a": i} for i in range(5)])
    rows = [(1, x["seq"], x["prev"], x["record"], x["hash"]) for x in lines]
    schema = "ledger int, seq long, prev string, record string, hash string"
    assert sinks.verify_chain(spark.createDataFrame(rows, schema)).count() == 0
    del rows[2]
    assert {r.reason for r in sinks.verify_chain(spark.createDataFrame(rows, schema)).collect()} == {"sequence"}
    assert reports.schema_difference(df, {"i": "bigint", "x": "string"}) == ["missing x", "type of i: int instead of bigint", "unexpected t"]


@pytest.fixture()
def folder(tmp_path, spark):
    target = tmp_path / "events"
    target.mkdir()
    shutil.copy(f"{SF}/events.parquet", target / "events.parquet")
    return str(target)


def test_streaming_bars_equal_batch_bars(spark, folder):
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    made = streams.run_once(streams.tumbling_bars(streams.read_events(spark, folder)), "bars_stream")
    assert sorted(map(tuple, made.collect())) == sorted(map(tuple, bars(spark, SF, "day").select("instrument_key", "open_time", "open", "high", "low", "close", "volume").collect()))


def test_streaming_windows_and_sessions(spark, folder):
    events = streams.read_events(spark, folder)
    n = spark.read.parquet(f"{SF}/events.parquet").count()
    assert streams.run_once(streams.weighted_directions(events, {"error": 2}), "dir_stream").agg(F.sum("n")).first()[0] == n
    assert streams.run_once(streams.nested_windows(events, 48), "nested_stream").agg(F.sum("n")).first()[0] == 2 * n
    assert streams.run_once(streams.sessions(events), "session_stream").agg(F.sum("n")).first()[0] == n


def test_streaming_zigzag_and_late_counts(spark, folder, tmp_path):
    closes = [100, 101, 120, 118, 90, 95, 130, 129, 128, 100, 99]
    rows = spark.createDataFrame([("a", i, float(c)) for i, c in enumerate(closes)], "instrument_key string, i int, close double")
    rows.select("instrument_key", F.timestamp_seconds(F.col("i") * 60).alias("at"), "close").coalesce(1).write.parquet(str(tmp_path / "bars"))
    stream = spark.readStream.schema("instrument_key string, at timestamp, close double").parquet(str(tmp_path / "bars"))
    legs = streams.run_once(streams.zigzag(stream, 15.0), "legs_stream", "append").orderBy("start_time").collect()
    assert [(r.direction, r.end_price) for r in legs] == [("up", 120.0), ("down", 90.0), ("up", 130.0)]
    streams.late_counts(streams.read_events(spark, folder), str(tmp_path / "late"), str(tmp_path / "cp")).start().awaitTermination()
    counted = spark.read.parquet(str(tmp_path / "late"))
    assert counted.agg(F.sum("n")).first()[0] == spark.read.parquet(f"{SF}/events.parquet").count()
    assert counted.where("status = 'late'").count() > 0


def test_streaming_forecast_join(spark, tmp_path):
    f = spark.createDataFrame([("a", 10**9, 1.0), ("a", 10**9 + 100_000, 2.0)], "key string, s long, forecast double").select("key", F.timestamp_seconds("s").alias("made_at"), "forecast")
    p = spark.createDataFrame([("a", 10**9 + 1800, 1.5)], "price_key string, s long, price double").select("price_key", F.timestamp_seconds("s").alias("price_at"), "price")
    f.write.parquet(str(tmp_path / "f"))
    p.write.parquet(str(tmp_path / "p"))
    joined = streams.forecast_join(spark.readStream.schema(f.schema).parquet(str(tmp_path / "f")), spark.readStream.schema(p.schema).parquet(str(tmp_path / "p")), 1)
    rows = streams.run_once(joined, "forecast_stream", "append").where("price IS NOT NULL").collect()
    assert [(r.forecast, r.price) for r in rows] == [(1.0, 1.5)]
