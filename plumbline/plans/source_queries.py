"""Payload mappers on payloads made from the supplied tables, so that SQL over those tables is the check."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.functions import times
from plumbline.operators import series
from plumbline.sources import payloads, sinks, validation
from plumbline.views import bars, entities, observations, table, with_views


def ms(c: str) -> F.Column:
    return times.epoch_seconds(F.col(c)) * 1000


def source_klines(spark: SparkSession, d: str) -> DataFrame:
    b = bars(spark, d)
    prices = [F.col(c).cast("string") for c in ("open", "high", "low", "close", "volume")]
    rest = [(ms("open_time") + 3_599_999).cast("string"), *[F.lit(x) for x in ("100.5", "1", "0", "75.25", "0")]]
    row = F.array(ms("open_time").cast("string"), *prices, *rest)
    raw = b.groupBy("instrument_key").agg(F.to_json(F.collect_list(row)).alias("payload"))
    made = payloads.klines(raw).where("reason IS NULL")
    return made.groupBy("open_time").agg(F.count("*").alias("bars"), F.round(F.sum("close"), 4).alias("close"), F.round(F.sum("volume"), 4).alias("volume"), F.sum("order_flow").alias("order_flow"))


def source_order_book(spark: SparkSession, d: str) -> DataFrame:
    """The lines of an order: returned ones ask, the rest bid."""
    li = table(spark, d, "lineitem").withColumn("lv", F.array(F.col("l_quantity").cast("string"), F.col("l_linenumber").cast("string")))
    side = lambda c: F.collect_list(F.when(c, F.col("lv")))
    book = li.groupBy("l_orderkey").agg(F.to_json(F.struct(side(F.col("l_returnflag") != "R").alias("bids"), side(F.col("l_returnflag") == "R").alias("asks"), F.lit(0).alias("T"))).alias("payload"))
    return payloads.order_book(book).select("l_orderkey", F.round("imbalance", 6).alias("imbalance"))


def source_open_interest(spark: SparkSession, d: str) -> DataFrame:
    b = bars(spark, d, "day")
    raw = b.groupBy("instrument_key").agg(F.to_json(F.collect_list(F.struct(ms("open_time").alias("timestamp"), F.col("volume").cast("string").alias("sumOpenInterest")))).alias("payload"))
    return payloads.open_interest(raw, "instrument_key").select("instrument_key", "at", "change")


def source_insider_trades(spark: SparkSession, d: str) -> DataFrame:
    """Orders as ownership documents, lines as transactions."""
    value = lambda tag, c: F.concat(F.lit(f"<{tag}><value>"), c, F.lit(f"</value></{tag}>"))
    code = F.when(F.col("l_returnflag") == "R", "D").otherwise("A")
    t = F.concat(F.lit("<nonDerivativeTransaction>"), value("transactionDate", F.date_format("l_shipdate", "yyyy-MM-dd")), F.lit("<transactionAmounts>"), value("transactionShares", F.col("l_quantity").cast("int").cast("string")), value("transactionAcquiredDisposedCode", code), F.lit("</transactionAmounts></nonDerivativeTransaction>"))
    li = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.array_join(F.collect_list(t), "").alias("t"))
    raw = li.select(F.concat(F.lit("<ownershipDocument><issuer><issuerCik>"), (F.col("l_orderkey") % 50).cast("string"), F.lit("</issuerCik></issuer><reportingOwner><reportingOwnerId><rptOwnerCik>"), (F.col("l_orderkey") % 7).cast("string"), F.lit("</rptOwnerCik></reportingOwnerId></reportingOwner><nonDerivativeTable>"), "t", F.lit("</nonDerivativeTable></ownershipDocument>")).alias("payload"))
    return payloads.insider_trades(raw).groupBy("issuer", "actor").agg(F.count("*").alias("n"), F.sum("amount").alias("net"))


def source_watchlist_csv(spark: SparkSession, d: str) -> DataFrame:
    s = table(spark, d, "supplier")
    line = F.concat(F.col("s_suppkey").cast("string"), F.lit(',"'), "s_name", F.lit('",-0- ,"P'), (F.col("s_nationkey") % 3).cast("string"), F.lit('",-0- ,-0- ,-0- ,-0- ,-0- ,-0- ,-0- ,-0- '))
    return payloads.ofac_csv(s.select(line.alias("value")))


def source_positioning(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "part").select(F.to_json(F.struct(F.lit("2024-01-02").alias("report_date"), F.concat(F.col("p_size").cast("string"), F.lit(",000")).alias("open_interest_all"), F.col("p_size").cast("string").alias("longs"), F.lit("7").alias("shorts"))).alias("payload"))
    return payloads.positioning(c).groupBy("kind").agg(F.count("*").alias("n"), F.sum("amount").alias("amount"))


def source_feed(spark: SparkSession, d: str) -> DataFrame:
    """Parts as feeds of two items, one of them repeated by another feed and one not https."""
    item = lambda title, link: F.concat(F.lit("<item><title>"), title, F.lit("</title><link>"), link, F.lit("</link><pubDate>Mon, 01 Jan 2024 10:00:00 GMT</pubDate></item>"))
    p = table(spark, d, "part")
    a = item(F.concat("p_name", F.lit(" - Some Publisher")), F.concat(F.lit("https://x.example/"), F.floor(F.col("p_partkey") / 2).cast("string")))
    b = item(F.col("p_name"), F.concat(F.lit("http://x.example/"), F.col("p_partkey").cast("string")))
    raw = p.select(F.concat(F.lit("<rss><channel>"), a, b, F.lit("</channel></rss>")).alias("payload"))
    return payloads.rss(raw).select("id", "title", "published")


def ledger_breaks(spark: SparkSession, d: str) -> DataFrame:
    """A chain over the nations, one line changed afterwards."""
    rows = [{"n": r.n_name} for r in table(spark, d, "nation").orderBy("n_nationkey").collect()]
    lines = [(1, x["seq"], x["prev"], x["record"].upper() if x["seq"] == 9 else x["record"], x["hash"]) for x in sinks.chained(rows)]
    return sinks.verify_chain(spark.createDataFrame(lines, "ledger int, seq long, prev string, record string, hash string")).select(F.col("seq"), "reason")


def evidence_validation(spark: SparkSession, d: str) -> DataFrame:
    """Observations as records, some without date or amount: rows by reason."""
    o = observations(spark, d)
    day = F.when(F.col("event_id") % 7 != 0, F.date_format("occurred_at", "yyyy-MM-dd HH:mm:ss"))
    amount = F.when(F.col("event_id") % 5 == 0, F.lit("n/a")).otherwise(F.col("amount").cast("string"))
    raw = o.select(F.when(F.col("event_id") % 11 == 0, "{broken").otherwise(F.to_json(F.struct(day.alias("day"), amount.alias("amount")))).alias("payload"))
    made = payloads.observations_of(raw, "struct<day:string,amount:string>", "day", "amount", "macro_release")
    return made.groupBy(F.coalesce("reason", F.lit("stored")).alias("reason")).agg(F.count("*").alias("n"))


def source_chart(spark: SparkSession, d: str) -> DataFrame:
    b = bars(spark, d)
    close = F.when(F.hour("open_time") != 4, F.col("close"))
    # a list of nulls would lose them, so the document is put together as text
    joined = lambda c: F.concat(F.lit("["), F.array_join(F.collect_list(F.coalesce(c.cast("string"), F.lit("null"))), ","), F.lit("]"))
    row = b.withColumn("at", times.epoch_seconds(F.col("open_time"))).groupBy("instrument_key")
    raw = row.agg(F.concat(F.lit('{"timestamp":'), joined(F.col("at")), F.lit(',"close":'), joined(close), F.lit("}")).alias("payload"))
    return payloads.chart(raw).groupBy("at").agg(F.count("*").alias("points"), F.round(F.sum("close"), 4).alias("close"))


def source_rates(spark: SparkSession, d: str) -> DataFrame:
    b = bars(spark, d, "day")
    rate = F.when(F.col("volume") % 5 == 0, "n/a").otherwise((F.col("volume") / 1000).cast("string"))
    raw = b.groupBy("instrument_key").agg(F.to_json(F.collect_list(F.struct(ms("open_time").alias("timestamp"), rate.alias("fundingRate")))).alias("payload"))
    return payloads.ratio_levels(raw, "instrument_key", "fundingRate").select("instrument_key", "at", F.round("value", 6).alias("value"))


def source_short_interest(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "part")
    shares = F.when(F.col("p_partkey") % 9 == 0, "-1").otherwise(F.concat((F.col("p_size") + 1).cast("string"), F.lit(",500")))
    raw = p.select(F.to_json(F.struct(F.col("p_brand").alias("symbol"), F.lit("2024-01-15").alias("settlementDate"), shares.alias("currentShortPositionQuantity"))).alias("payload"))
    return payloads.short_interest(raw).groupBy("symbol", F.col("day").cast("string").alias("day")).agg(F.count("*").alias("n"), F.sum("shares").alias("shares"))


def source_supply(spark: SparkSession, d: str) -> DataFrame:
    b = bars(spark, d, "day")
    pegs = F.map_from_arrays(F.collect_list("instrument_key"), F.collect_list(F.col("volume").cast("double")))
    raw = b.groupBy("open_time").agg(F.to_json(F.struct(times.epoch_seconds(F.first("open_time")).alias("date"), pegs.alias("circulating"))).alias("payload")).select("payload")
    return payloads.supply_levels(raw).select(F.col("day").cast("string").alias("day"), "supply")


def source_holdings(spark: SparkSession, d: str) -> DataFrame:
    """Suppliers as filers, their parts as holdings; every seventh is worth nothing."""
    tag = lambda name, c: F.concat(F.lit(f"<{name}>"), c, F.lit(f"</{name}>"))
    worth = F.when(F.col("l_linenumber") == 7, "0").otherwise(F.floor("l_extendedprice").cast("string"))
    info = tag("infoTable", F.concat(tag("nameOfIssuer", F.concat(F.lit("Issuer "), F.col("l_partkey").cast("string"))), tag("cusip", F.col("l_partkey").cast("string")), tag("value", worth), tag("shrsOrPrnAmt", tag("sshPrnamt", F.col("l_quantity").cast("int").cast("string")))))
    raw = table(spark, d, "lineitem").groupBy("l_orderkey").agg(tag("informationTable", F.array_join(F.collect_list(info), "")).alias("payload")).select("payload")
    return payloads.holdings(raw).groupBy("cusip").agg(F.count("*").alias("n"), F.sum("value").alias("value"), F.sum("shares").alias("shares"))


def source_awards(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders")
    cents = F.floor(F.col("o_totalprice")).cast("string")
    r = F.struct(F.col("o_orderkey").cast("string").alias("id"), F.substring("o_orderpriority", 1, 1).alias("agency"), (F.col("o_custkey") % 10).cast("string").alias("recipient"), F.when(F.col("o_orderkey") % 6 == 0, F.concat(F.lit("-"), cents)).otherwise(cents).alias("amount"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("day"))
    return payloads.awards(o.select(F.to_json(r).alias("payload"))).groupBy("src", "dst").agg(F.count("*").alias("n"), F.sum("amount").alias("amount"), F.min("day").cast("string").alias("first_day"))


def source_lobbying(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders")
    r = F.struct(F.concat(F.lit("c"), "o_custkey").alias("client"), F.lit("r").alias("registrant"), F.floor("o_totalprice").cast("string").alias("income"), F.year("o_orderdate").alias("year"), F.quarter("o_orderdate").alias("quarter"), F.array(F.col("o_orderstatus"), F.lit("TAX"), F.lit("BAN"), F.lit("TAX")).alias("issues"))
    return payloads.lobbying(o.select(F.to_json(r).alias("payload"))).groupBy(F.col("quarter_start").cast("string").alias("quarter_start"), "issues").agg(F.count("*").alias("n"), F.sum("amount").alias("amount"))


def source_uk_list(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "part")
    kind = F.when(F.col("p_size") % 5 == 0, "Primary name").when(F.col("p_size") % 5 == 1, "AKA").otherwise("Low quality")
    return payloads.uk_listings(p.select(F.col("p_brand").alias("group_id"), F.col("p_type").alias("name1"), F.lit(None).cast("string").alias("name2"), F.col("p_name").alias("name6"), kind.alias("alias_type")))


def xml(tag: str, *parts: F.Column) -> F.Column:
    return F.concat(F.lit(f"<{tag}>"), *parts, F.lit(f"</{tag}>"))


def source_un_list(spark: SparkSession, d: str) -> DataFrame:
    """One list for each nation; a seventh of them declare a document type and are refused whole."""
    s = table(spark, d, "supplier")
    one = xml("INDIVIDUAL", xml("DATAID", F.col("s_suppkey").cast("string")), xml("FIRST_NAME", F.col("s_name")), xml("SECOND_NAME", F.concat(F.lit("n"), F.col("s_nationkey").cast("string"))), xml("UN_LIST_TYPE", F.lit("X")))
    body = xml("CONSOLIDATED_LIST", xml("INDIVIDUALS", F.array_join(F.collect_list(one), "")))
    raw = s.groupBy("s_nationkey").agg(body.alias("b")).select(F.when(F.col("s_nationkey") % 7 == 0, F.concat(F.lit("<!DOCTYPE x>"), "b")).otherwise(F.col("b")).alias("payload"))
    return payloads.un_listings(raw)


def source_eu_list(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "part")
    alias = F.concat(F.lit('<nameAlias wholeName="'), F.col("p_name"), F.lit('" strong="'), F.when(F.col("p_size") % 2 == 0, "true").otherwise("false"), F.lit('" nameLanguage="'), F.when(F.col("p_size") % 3 == 0, "EN").otherwise("FR"), F.lit('"/>'))
    by_brand = p.groupBy("p_brand").agg(F.array_join(F.collect_list(alias), "").alias("a"))
    raw = by_brand.select(F.concat(F.lit('<export><sanctionEntity euReferenceNumber="'), "p_brand", F.lit('">'), "a", F.lit("</sanctionEntity></export>")).alias("payload"))
    return payloads.eu_listings(raw)


FORMS = ["8-K", "10-K", "S-1/A", "424B3", "DEF 14A", "4"]


def source_filings(spark: SparkSession, d: str) -> DataFrame:
    """Orders of a customer as columnar filings; material forms only."""
    form = F.element_at(F.array(*[F.lit(f) for f in FORMS]), (F.col("o_orderkey") % 6 + 1).cast("int"))
    o = table(spark, d, "orders").withColumn("r", F.struct(form.alias("form"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("day"), F.col("o_orderkey").cast("string").alias("id")))
    raw = o.groupBy("o_custkey").agg(F.collect_list("r").alias("r")).select(F.to_json(F.struct(F.col("r.form").alias("form"), F.col("r.day").alias("filingDate"), F.col("r.id").alias("accessionNumber"))).alias("payload"))
    return payloads.material_forms(payloads.submissions(raw)).withColumn("filed", F.col("filed").cast("string"))


def source_catalogue(spark: SparkSession, d: str) -> DataFrame:
    """Imported relationships by whether both ends were imported; a third of the nations is missing."""
    n = table(spark, d, "nation")
    entity = F.struct(F.concat(F.lit("n"), "n_nationkey").alias("key"), F.lit("country").alias("kind"), F.col("n_name").alias("name"), F.lit("XX").alias("country"))
    relation = F.struct(F.concat(F.lit("n"), "n_nationkey").alias("src"), F.lit("subsidiary_of").alias("rel"), F.concat(F.lit("n"), ((F.col("n_nationkey") + 1) % 25).cast("string")).alias("dst"), F.lit("https://sec.gov/x").alias("source_url"))
    raw = n.agg(F.to_json(F.struct(F.collect_list(F.when(F.col("n_nationkey") % 3 != 0, entity)).alias("entities"), F.collect_list(relation).alias("relationships"))).alias("payload"))
    found, relations = payloads.catalogue(raw)
    known = found.select(F.col("key"))
    whole = relations.join(known.withColumnRenamed("key", "src"), "src", "left_semi").join(known.withColumnRenamed("key", "dst"), "dst", "left_semi").select("src", "dst").withColumn("whole", F.lit(True))
    return relations.select("src", "rel", "dst").join(whole, ["src", "dst"], "left").select("src", "rel", "dst", F.coalesce("whole", F.lit(False)).alias("whole"))


def source_fund_holdings(spark: SparkSession, d: str) -> DataFrame:
    """Orders as fund reports, lines as holdings; every seventh line has no name and no value, every ninth order is another form."""
    text = lambda c: c.cast("string")
    li, bare = table(spark, d, "lineitem"), F.col("l_linenumber") == 7
    security = xml("invstOrSec", xml("name", F.when(bare, "").otherwise(F.concat(F.lit("p"), text(F.col("l_partkey"))))), xml("cusip", text(F.col("l_partkey"))), xml("balance", text(F.col("l_quantity").cast("int"))), xml("valUSD", F.when(bare, "N/A").otherwise(text(F.floor("l_extendedprice")))))
    body = li.groupBy("l_orderkey").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("l_linenumber", security.alias("s")))), lambda x: x["s"]), "").alias("b"))
    form = F.when(F.col("l_orderkey") % 9 == 0, "10-K").otherwise("NPORT-P")
    payload = xml("edgarSubmission", xml("submissionType", form), xml("formData", xml("genInfo", xml("regName", F.lit("Fund")), xml("repPdDate", F.lit("2024-01-31"))), xml("invstOrSecs", F.col("b"))))
    return payloads.fund_holdings(body.select("l_orderkey", payload.alias("payload"))).groupBy("l_orderkey", "currency").agg(F.count("*").alias("n"), F.sum("value").alias("value"), F.max("place").cast("long").alias("last"))


def source_fundraising(spark: SparkSession, d: str) -> DataFrame:
    """Orders as notices of offerings; some sold nothing, some have no first sale, some are other forms."""
    o = table(spark, d, "orders")
    k, total = F.col("o_orderkey"), F.floor("o_totalprice").cast("string")
    day = F.date_format("o_orderdate", "yyyy-MM-dd")
    sale = F.when(k % 4 == 0, "").otherwise(xml("dateOfFirstSale", xml("value", day)))
    form = F.when(k % 7 == 0, "C").when(k % 3 == 0, "D/A").otherwise("D")
    sold = F.when(k % 5 == 0, "0").otherwise(total)
    offering = xml("offeringData", xml("typeOfFiling", sale), xml("offeringSalesAmounts", xml("totalOfferingAmount", total), xml("totalAmountSold", sold)), xml("signatureBlock", xml("signature", xml("signatureDate", F.lit("2024-02-01")))))
    payload = xml("edgarSubmission", xml("submissionType", form), xml("primaryIssuer", xml("entityName", F.concat(F.lit("c"), F.col("o_custkey").cast("string")))), offering)
    return payloads.fundraising(o.select("o_orderkey", payload.alias("payload"))).withColumn("day", F.col("day").cast("string"))


def price_document_check(spark: SparkSession, d: str) -> DataFrame:
    """Hourly bars as price documents, some rows off the grid, out of range or out of order: rows by reason."""
    b = bars(spark, d).withColumn("i", F.row_number().over(series.order()))
    shift = F.when(F.col("i") % 50 == 7, F.expr("INTERVAL 1 MINUTE")).when(F.col("i") % 50 == 9, F.expr("INTERVAL -3 HOUR")).otherwise(F.expr("INTERVAL 0 HOUR"))
    at = F.concat(F.date_format(F.col("open_time") + shift, "yyyy-MM-dd HH:mm:ss"), F.lit("Z"))
    price = F.when(F.col("i") % 50 == 11, "0").when(F.col("i") % 50 == 13, "12345678901234").otherwise(F.concat((F.floor("close") + 1).cast("string"), F.lit(".5")))
    rows = b.groupBy("instrument_key").agg(F.sort_array(F.collect_list(F.struct("i", at.alias("timestamp"), price.alias("price")))).alias("r"))
    raw = rows.select("instrument_key", F.to_json(F.struct(F.transform("r", lambda r: F.struct(r["timestamp"].alias("timestamp"), r["price"].alias("price"))).alias("prices"))).alias("payload"))
    made = validation.price_documents(raw, "instrument_key")
    return made.groupBy("instrument_key", F.coalesce("reason", F.lit("stands")).alias("reason")).agg(F.count("*").alias("n"))


def flow_import(spark: SparkSession, d: str) -> DataFrame:
    """Orders as flow records against the entities; some have no amount, an unknown end or a private address."""
    o = table(spark, d, "orders")
    k = F.col("o_orderkey")
    dst = F.when(k % 7 == 0, "nobody").when(k % 11 == 0, F.concat(F.lit("c"), "o_custkey")).otherwise("s1")
    amount = F.when(k % 5 == 0, "-1").when(k % 13 == 0, " ").otherwise(F.floor("o_totalprice").cast("string"))
    url = F.when(k % 17 == 0, "http://plain.example/x").otherwise("https://sec.gov/x")
    records = o.select(F.concat(F.lit("c"), "o_custkey").alias("src"), dst.alias("dst"), F.lit("payment").alias("type"), amount.alias("amount"), F.lit("USD").alias("currency"), url.alias("source_url"))
    return validation.flow_records(records, entities(spark, d)).groupBy(F.coalesce("reason", F.lit("stored")).alias("reason")).agg(F.count("*").alias("n"))


def mapping_check(spark: SparkSession, d: str) -> DataFrame:
    """Events as evidence with mappings of every kind: rows by reason."""
    e = table(spark, d, "events")
    i, kind = F.col("event_id"), F.when(F.col("event_type") == "click", "decision").when(F.col("event_type") == "view", "fund_flow").otherwise("macro_release")
    text = lambda when, value="x": F.when(when, value)
    m = F.struct(
        text(i % 2 == 0, "a").alias("from"),
        text(i % 3 == 0, "b").alias("to"),
        text((i % 5 == 0) & (kind == "decision")).alias("actor"),
        text((i % 7 != 0) & (kind == "decision")).alias("action"),
        text((i % 11 == 0) & (kind == "decision")).alias("reason"),
        F.when((i % 11 == 0) & (kind == "decision"), "stated_reason").otherwise("unknown").alias("reason_basis"),
        F.when(i % 19 == 0, F.array(F.lit("p"), F.lit("p"))).otherwise(F.array(F.lit("p"))).alias("related_ids"),
        text(i % 5 == 0).alias("source_locator"),
    )
    reason = validation.mapping_reason(i.cast("string"), kind, F.when(i % 23 != 0, m), F.col("value").cast("string"), F.when(i % 4 != 0, "USD"))
    return e.select(reason.alias("r")).groupBy(F.coalesce("r", F.lit("stands")).alias("reason")).agg(F.count("*").alias("n"))


MAPPING_CHECK_SQL = """WITH e AS (SELECT event_id AS i, value, CASE event_type WHEN 'click' THEN 'd' WHEN 'view' THEN 'f' ELSE 'm' END AS k FROM events),
    r AS (SELECT CASE WHEN i % 23 = 0 THEN 'stands' WHEN i % 19 = 0 THEN 'related_ids' WHEN k = 'd' AND (i % 2 = 0 OR i % 3 = 0) THEN 'decision_with_route' WHEN k = 'd' AND i % 7 = 0 THEN 'decision_without_action'
    WHEN k = 'd' AND i % 11 = 0 AND i % 5 <> 0 THEN 'unattributed_reason' WHEN k = 'm' AND (i % 2 = 0 OR i % 3 = 0) THEN 'route_kind' WHEN k = 'f' AND (i % 2 = 0) <> (i % 3 = 0) THEN 'half_route'
    WHEN k = 'f' AND i % 6 = 0 AND value <= 0 THEN 'route_amount' WHEN k = 'f' AND i % 6 = 0 AND i % 4 = 0 THEN 'route_currency' ELSE 'stands' END AS reason FROM e) SELECT reason, count(*) AS n FROM r GROUP BY 1"""


QUERIES = {
    "source_klines": (source_klines, with_views("bars_hour", body="SELECT open_time, count(*) AS bars, round(sum(close), 4) AS close, round(sum(volume), 4)::DOUBLE AS volume, sum(50.0::DOUBLE) AS order_flow FROM bars GROUP BY 1")),
    "source_order_book": (source_order_book, "SELECT l_orderkey, round((sum(CASE WHEN l_returnflag <> 'R' THEN 1 ELSE -1 END * l_quantity * l_linenumber)) / sum(l_quantity * l_linenumber), 6) AS imbalance FROM lineitem GROUP BY 1"),
    "source_open_interest": (source_open_interest, with_views("bars_day", body="SELECT * FROM (SELECT instrument_key, open_time AS at, (volume - lag(volume) OVER (PARTITION BY instrument_key ORDER BY open_time))::DOUBLE AS change FROM bars) WHERE change IS NOT NULL")),
    "source_insider_trades": (source_insider_trades, "SELECT (l_orderkey % 50)::VARCHAR AS issuer, 'sec-owner:' || (l_orderkey % 7) AS actor, count(*) AS n, sum(CASE WHEN l_returnflag = 'R' THEN -1 ELSE 1 END * floor(l_quantity)) AS net FROM lineitem GROUP BY 1, 2"),
    "source_watchlist_csv": (source_watchlist_csv, "SELECT s_suppkey::VARCHAR AS key, s_name AS name, NULL::VARCHAR AS type, 'P' || (s_nationkey % 3) AS program FROM supplier"),
    "source_positioning": (source_positioning, "SELECT 'cot_open_interest' AS kind, count(*) AS n, sum(p_size * 1000.0::DOUBLE) AS amount FROM part UNION ALL SELECT 'cot_positioning', count(*), sum(p_size - 7.0::DOUBLE) FROM part"),
    "source_feed": (source_feed, "SELECT substr(sha256('https://x.example/' || (p_partkey // 2)), 1, 16) AS id, min(p_name) AS title, TIMESTAMP '2024-01-01 10:00:00' AS published FROM part GROUP BY 1"),
    "ledger_breaks": (ledger_breaks, "SELECT 9::BIGINT AS seq, 'hash' AS reason"),
    "evidence_validation": (evidence_validation, with_views("observations", body="SELECT CASE WHEN event_id % 11 = 0 THEN 'malformed' WHEN event_id % 7 = 0 THEN 'no_date' WHEN event_id % 5 = 0 THEN 'no_amount' ELSE 'stored' END AS reason, count(*) AS n FROM obs GROUP BY 1")),
    "source_chart": (source_chart, with_views("bars_hour", body="SELECT open_time AS at, count(*) AS points, round(sum(close), 4) AS close FROM bars WHERE hour(open_time) <> 4 GROUP BY 1")),
    "source_rates": (source_rates, with_views("bars_day", body="SELECT instrument_key, open_time AS at, round(volume / 1000, 6) AS value FROM bars WHERE volume % 5 <> 0")),
    "source_short_interest": (source_short_interest, "SELECT p_brand AS symbol, '2024-01-15' AS day, count(*) AS n, sum((p_size + 1) * 1000 + 500)::DOUBLE AS shares FROM part WHERE p_partkey % 9 <> 0 GROUP BY 1"),
    "source_supply": (source_supply, with_views("bars_day", body="SELECT open_time::DATE::VARCHAR AS day, sum(volume)::DOUBLE AS supply FROM bars GROUP BY 1")),
    "source_holdings": (source_holdings, "SELECT l_partkey::VARCHAR AS cusip, count(*) AS n, sum(floor(l_extendedprice)) AS value, sum(floor(l_quantity)) AS shares FROM lineitem WHERE l_linenumber <> 7 AND floor(l_extendedprice) > 0 GROUP BY 1"),
    "source_awards": (source_awards, "SELECT 'agency:' || substr(o_orderpriority, 1, 1) AS src, 'recipient:' || (o_custkey % 10) AS dst, count(*) AS n, sum(floor(o_totalprice)) AS amount, min(o_orderdate)::DATE::VARCHAR AS first_day FROM orders WHERE o_orderkey % 6 <> 0 AND floor(o_totalprice) > 0 GROUP BY 1, 2"),
    "source_lobbying": (source_lobbying, "SELECT date_trunc('quarter', o_orderdate)::DATE::VARCHAR AS quarter_start, array_to_string(list_sort(list_distinct([o_orderstatus, 'TAX', 'BAN'])), ',') AS issues, count(*) AS n, sum(floor(o_totalprice)) AS amount FROM orders GROUP BY 1, 2"),
    "source_uk_list": (source_uk_list, "SELECT p_brand AS group_id, arg_min(p_type || ' ' || p_name, (CASE p_size % 5 WHEN 0 THEN 0 WHEN 1 THEN 1 ELSE 2 END, p_type || ' ' || p_name)) AS name, count(*) AS aliases FROM part GROUP BY 1"),
    "source_un_list": (source_un_list, "SELECT s_suppkey::VARCHAR AS key, s_name || ' n' || s_nationkey AS name, 'X' AS program FROM supplier WHERE s_nationkey % 7 <> 0"),
    "source_eu_list": (source_eu_list, "SELECT p_brand AS key, arg_min(p_name, (p_size % 2 <> 0, p_size % 3 <> 0, p_name)) AS name, count(*) AS aliases FROM part GROUP BY 1"),
    "source_filings": (source_filings, f"SELECT o_orderkey::VARCHAR AS accession, list_extract({FORMS}, o_orderkey % 6 + 1) AS form, o_orderdate::DATE::VARCHAR AS filed FROM orders WHERE o_orderkey % 6 NOT IN (1, 5)"),
    "source_catalogue": (source_catalogue, "SELECT 'n' || n_nationkey AS src, 'subsidiary_of' AS rel, 'n' || ((n_nationkey + 1) % 25) AS dst, n_nationkey % 3 <> 0 AND ((n_nationkey + 1) % 25) % 3 <> 0 AS whole FROM nation"),
    "source_fund_holdings": (source_fund_holdings, "SELECT l_orderkey, 'USD' AS currency, count(*) AS n, sum(floor(l_extendedprice)) AS value, max(i)::BIGINT AS last FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber) AS i FROM lineitem) WHERE l_linenumber <> 7 AND l_orderkey % 9 <> 0 GROUP BY 1"),
    "source_fundraising": (source_fundraising, """SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN 'D/A' ELSE 'D' END AS form, 'c' || o_custkey AS issuer, floor(o_totalprice) AS offered, CASE WHEN o_orderkey % 5 <> 0 AND floor(o_totalprice) > 0 THEN floor(o_totalprice) END AS sold,
        CASE WHEN o_orderkey % 4 = 0 THEN '2024-02-01' ELSE o_orderdate::DATE::VARCHAR END AS day FROM orders WHERE o_orderkey % 7 <> 0"""),
    "price_document_check": (price_document_check, with_views("bars_hour", """r AS (SELECT instrument_key, row_number() OVER (PARTITION BY instrument_key ORDER BY open_time) AS i, open_time FROM bars),
        s AS (SELECT *, open_time + CASE i % 50 WHEN 7 THEN INTERVAL 1 MINUTE WHEN 9 THEN INTERVAL (-3) HOUR ELSE INTERVAL 0 HOUR END AS t FROM r)""",
        body="""SELECT instrument_key, CASE WHEN i % 50 = 7 THEN 'grid' WHEN i % 50 IN (11, 13) THEN 'price' WHEN t <= before THEN 'not_increasing' ELSE 'stands' END AS reason, count(*) AS n FROM (SELECT *, lag(t) OVER (PARTITION BY instrument_key ORDER BY i) AS before FROM s) GROUP BY 1, 2""")),
    "flow_import": (flow_import, """SELECT CASE WHEN o_orderkey % 13 = 0 AND o_orderkey % 5 <> 0 THEN 'missing_field' WHEN o_orderkey % 7 <> 0 AND o_orderkey % 11 = 0 THEN 'same_ends' WHEN o_orderkey % 7 = 0 THEN 'unknown_destination' WHEN o_orderkey % 17 = 0 THEN 'source_url' WHEN o_orderkey % 5 = 0 OR floor(o_totalprice) <= 0 THEN 'amount' ELSE 'stored' END AS reason, count(*) AS n FROM orders GROUP BY 1"""),
    "mapping_check": (mapping_check, MAPPING_CHECK_SQL),
}
