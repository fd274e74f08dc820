"""Captured payloads to rows: one mapper for each shape of public source.

Every mapper takes a DataFrame with a text column ``payload`` (and what else it
carries along) and gives rows; fields that do not parse become null, and
``skipped`` counts by reason are a grouping of the same rows. Nothing here opens
a connection.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline.functions.text import headline_title, number


def instant_ms(ms: Column) -> Column:
    """Milliseconds since 1970 as an instant without a zone."""
    seconds = F.floor(ms / 1000).cast("long")
    return F.expr("timestamp_ntz'1970-01-01 00:00:00'") + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), (seconds + (ms % 1000) / 1000).cast("decimal(18,6)"))


def klines(raw: DataFrame) -> DataFrame:
    """Arrays of 12 fields: bars with quote volume and order flow (twice the taker's quote volume less all), and why a row is refused."""
    rows = raw.select(F.explode(F.from_json("payload", "array<array<string>>")).alias("k"))
    value = lambda i: number(F.get(F.col("k"), F.lit(i)))
    ms = lambda i: F.get(F.col("k"), F.lit(i)).try_cast("long")
    out = rows.select(
        F.size("k").alias("fields"),
        instant_ms(ms(0)).alias("open_time"),
        *[value(i).alias(n) for i, n in ((1, "open"), (2, "high"), (3, "low"), (4, "close"), (5, "volume"))],
        (ms(6) + 1 - ms(0)).alias("span_ms"),
        (2 * value(10) - value(7)).alias("order_flow"),
    )
    reason = (
        F.when(F.col("fields") != 12, "field_count")
        .when(F.col("open_time").isNull() | F.col("close").isNull(), "unparsable")
        .when((F.col("high") < F.greatest("open", "close", "low")) | (F.col("low") > F.least("open", "close")), "outside_range")
        .when(F.col("span_ms") <= 0, "span")
    )
    return out.withColumn("reason", reason)


def chart(raw: DataFrame) -> DataFrame:
    """Columnar chart JSON: one row an instant and close, nulls left out."""
    parsed = F.from_json("payload", "struct<timestamp:array<long>,close:array<double>>").alias("p")
    rows = raw.select(parsed).select(F.explode(F.arrays_zip("p.timestamp", "p.close")).alias("r"))
    return rows.select(instant_ms(F.col("r.timestamp") * 1000).alias("at"), F.col("r.close").alias("close")).where("close IS NOT NULL")


def open_interest(raw: DataFrame, key: str) -> DataFrame:
    """First differences of a series of levels."""
    rows = raw.select(key, F.explode(F.from_json("payload", "array<struct<timestamp:long,sumOpenInterest:string>>")).alias("r"))
    level = rows.select(key, instant_ms(F.col("r.timestamp")).alias("at"), number(F.col("r.sumOpenInterest")).alias("level"))
    order = Window.partitionBy(key).orderBy("at")
    return level.withColumn("change", F.col("level") - F.lag("level").over(order)).where("change IS NOT NULL")


def ratio_levels(raw: DataFrame, key: str, field: str) -> DataFrame:
    """Funding rates and account ratios: instant and number."""
    rows = raw.select(key, F.explode(F.from_json("payload", f"array<struct<timestamp:long,{field}:string>>")).alias("r"))
    return rows.select(key, instant_ms(F.col("r.timestamp")).alias("at"), number(F.col(f"r.{field}")).alias("value")).where("value IS NOT NULL")


def order_book(raw: DataFrame) -> DataFrame:
    """Imbalance (bids - asks) / (bids + asks) of price times quantity, 12 places half-even; null for an empty book."""
    book = F.from_json("payload", "struct<bids:array<array<string>>,asks:array<array<string>>,T:long>").alias("b")
    side = lambda levels: F.aggregate(levels, F.lit(0.0), lambda acc, lv: acc + F.get(lv, F.lit(0)).cast("double") * F.get(lv, F.lit(1)).cast("double"))
    bids, asks = side(F.col("b.bids")), side(F.col("b.asks"))
    out = raw.select(*[c for c in raw.columns if c != "payload"], book)
    return out.select(*[c for c in raw.columns if c != "payload"], instant_ms(F.col("b.T")).alias("at"), F.when(bids + asks > 0, F.bround((bids - asks) / (bids + asks), 12)).alias("imbalance"))


def positioning(raw: DataFrame) -> DataFrame:
    """Commitment reports: two rows each, all open interest and long less short."""
    r = F.from_json("payload", "struct<report_date:string,open_interest_all:string,longs:string,shorts:string>").alias("r")
    net = number(F.col("r.longs")) - number(F.col("r.shorts"))
    kinds = F.array(F.struct(F.lit("cot_open_interest").alias("kind"), number(F.col("r.open_interest_all")).alias("amount")), F.struct(F.lit("cot_positioning").alias("kind"), net.alias("amount")))
    return raw.select(r).select(F.to_date("r.report_date").alias("day"), F.explode(kinds).alias("k")).select("day", "k.*")


def short_interest(raw: DataFrame) -> DataFrame:
    r = F.from_json("payload", "struct<symbol:string,settlementDate:string,currentShortPositionQuantity:string>").alias("r")
    return raw.select(r).select("r.symbol", F.to_date("r.settlementDate").alias("day"), number(F.col("r.currentShortPositionQuantity")).alias("shares")).where("shares >= 0")


def rss(raw: DataFrame) -> DataFrame:
    """Items of feeds with https links, one a link: id, title without publisher, link, instant."""
    items = raw.where(~has_doctype(F.col("payload"))).select(F.explode(F.from_xml("payload", "channel struct<item:array<struct<title:string,link:string,pubDate:string>>>").getField("channel").getField("item")).alias("i")).select("i.*")
    day = F.regexp_extract("pubDate", r"(\d{1,2} \w{3} \d{4} \d{2}:\d{2}:\d{2})", 1)
    kept = items.where(F.col("link").startswith("https://")).select(
        F.substring(F.sha2("link", 256), 1, 16).alias("id"), headline_title(F.col("title")).alias("title"), "link", F.try_to_timestamp(day, F.lit("d MMM yyyy HH:mm:ss")).cast("timestamp_ntz").alias("published")
    )
    # the same link twice is one headline, by the least of its rows
    return kept.groupBy("id").agg(F.min(F.struct("published", "title", "link")).alias("r")).select("id", "r.*")


def has_doctype(payload: Column) -> Column:
    """XML that declares document types or entities is refused."""
    return F.upper(payload).rlike(r"<!(DOCTYPE|ENTITY)")


def insider_trades(raw: DataFrame) -> DataFrame:
    """Ownership documents: signed shares (acquired positive, disposed negative) of each transaction."""
    one = "struct<transactionAmounts:struct<transactionShares:struct<value:string>,transactionAcquiredDisposedCode:struct<value:string>>,transactionDate:struct<value:string>>"
    shape = f"issuer struct<issuerCik:string>, reportingOwner struct<reportingOwnerId:struct<rptOwnerCik:string>>, nonDerivativeTable struct<nonDerivativeTransaction:array<{one}>>"
    x = raw.where(~has_doctype(F.col("payload"))).select(F.from_xml("payload", shape).alias("x"))
    t = x.select(F.col("x.issuer.issuerCik").alias("issuer"), F.concat(F.lit("sec-owner:"), F.col("x.reportingOwner.reportingOwnerId.rptOwnerCik")).alias("actor"), F.explode("x.nonDerivativeTable.nonDerivativeTransaction").alias("t"))
    shares = number(F.col("t.transactionAmounts.transactionShares.value"))
    code = F.col("t.transactionAmounts.transactionAcquiredDisposedCode.value")
    return t.select("issuer", "actor", F.to_date("t.transactionDate.value").alias("day"), F.when(code == "A", shares).when(code == "D", -shares).alias("amount")).where("amount IS NOT NULL")


def holdings(raw: DataFrame) -> DataFrame:
    """Information tables: issuer, identifier and value of holdings worth something."""
    shape = "infoTable array<struct<nameOfIssuer:string,cusip:string,value:string,shrsOrPrnAmt:struct<sshPrnamt:string>>>"
    t = raw.where(~has_doctype(F.col("payload"))).select(F.explode(F.from_xml("payload", shape).getField("infoTable")).alias("t"))
    return t.select(F.col("t.nameOfIssuer").alias("issuer"), "t.cusip", number(F.col("t.value")).alias("value"), number(F.col("t.shrsOrPrnAmt.sshPrnamt")).alias("shares")).where("value > 0")


def fund_holdings(raw: DataFrame) -> DataFrame:
    """Fund reports: one row a holding with a name or a value, its place, value and currency; other forms are refused."""
    security = "struct<name:string,title:string,cusip:string,balance:string,units:string,curCd:string,valUSD:string>"
    shape = f"submissionType string, formData struct<genInfo:struct<regName:string,repPdDate:string>,invstOrSecs:struct<invstOrSec:array<{security}>>>"
    x = raw.where(~has_doctype(F.col("payload"))).select(*[c for c in raw.columns if c != "payload"], F.from_xml("payload", shape).alias("x"))
    # as a condition on the exploded rows: a filter on parsed columns would be pushed below the parser, which then runs again
    held = F.when(F.col("x.submissionType").isin("NPORT-P", "NPORT-P/A"), F.col("x.formData.invstOrSecs.invstOrSec"))
    own = [c for c in raw.columns if c != "payload"]
    rows = x.select(*own, F.col("x.formData.genInfo.regName").alias("fund"), F.to_date("x.formData.genInfo.repPdDate").alias("period"), F.posexplode_outer(held).alias("place", "s")).where("place IS NOT NULL")
    kept = rows.where((F.coalesce("s.name", F.lit("")) != "") | number(F.col("s.valUSD")).isNotNull())
    value = number(F.col("s.valUSD"))
    return kept.select(*own, "fund", "period", (F.col("place") + 1).alias("place"), F.col("s.name").alias("name"), F.col("s.cusip").alias("cusip"), number(F.col("s.balance")).alias("balance"), value.alias("value"), F.when(value.isNotNull(), F.coalesce("s.curCd", F.lit("USD"))).alias("currency"))


def fundraising(raw: DataFrame) -> DataFrame:
    """Notices of offerings: issuer, offered and sold amounts (sold null unless positive), first sale or else signature day; other forms are refused."""
    amount = "struct<totalOfferingAmount:string,totalAmountSold:string>"
    shape = f"submissionType string, primaryIssuer struct<entityName:string>, offeringData struct<offeringSalesAmounts:{amount},typeOfFiling:struct<dateOfFirstSale:struct<value:string>>,signatureBlock:struct<signature:struct<signatureDate:string>>>"
    own = [c for c in raw.columns if c != "payload"]
    x = raw.where(~has_doctype(F.col("payload"))).select(*own, F.from_xml("payload", shape).alias("x")).where(F.col("x.submissionType").isin("D", "D/A"))
    sold, day = number(F.col("x.offeringData.offeringSalesAmounts.totalAmountSold")), lambda c: F.try_to_timestamp(c, F.lit("yyyy-MM-dd")).cast("date")
    first = F.coalesce(day(F.col("x.offeringData.typeOfFiling.dateOfFirstSale.value")), day(F.col("x.offeringData.signatureBlock.signature.signatureDate")))
    return x.select(*own, F.col("x.submissionType").alias("form"), F.col("x.primaryIssuer.entityName").alias("issuer"), number(F.col("x.offeringData.offeringSalesAmounts.totalOfferingAmount")).alias("offered"), F.when(sold > 0, sold).alias("sold"), first.alias("day"))


def awards(raw: DataFrame) -> DataFrame:
    """Public awards as flows from agency to recipient, positive amounts only."""
    r = F.from_json("payload", "struct<id:string,agency:string,recipient:string,amount:string,day:string>").alias("r")
    return raw.select(r).select(F.col("r.id").alias("external_id"), F.concat(F.lit("agency:"), "r.agency").alias("src"), F.concat(F.lit("recipient:"), "r.recipient").alias("dst"), number(F.col("r.amount")).alias("amount"), F.to_date("r.day").alias("day")).where("amount > 0")


def lobbying(raw: DataFrame) -> DataFrame:
    """Filings: client, registrant, amount, first day of the quarter and sorted issue codes."""
    r = F.from_json("payload", "struct<client:string,registrant:string,income:string,year:int,quarter:int,issues:array<string>>").alias("r")
    start = F.make_date("r.year", (F.col("r.quarter") - 1) * 3 + 1, F.lit(1))
    return raw.select(r).select("r.client", "r.registrant", number(F.col("r.income")).alias("amount"), start.alias("quarter_start"), F.array_join(F.array_sort(F.array_distinct("r.issues")), ",").alias("issues"))


def supply_levels(raw: DataFrame) -> DataFrame:
    """Stablecoin supply: the sum over the pegs of a day."""
    r = F.from_json("payload", "struct<date:long,circulating:map<string,double>>").alias("r")
    total = F.aggregate(F.map_values("r.circulating"), F.lit(0.0), lambda a, v: a + F.coalesce(v, F.lit(0.0)))
    return raw.select(r).select(F.to_date(instant_ms(F.col("r.date") * 1000)).alias("day"), total.alias("supply"))


def observations_of(raw: DataFrame, schema: str, at: str, amount: str, kind: str) -> DataFrame:
    """Plain sources (cash balances, registers, energy, trade, flights, advisers): one observation a record, with skips by reason."""
    r = raw.select(F.from_json("payload", schema).alias("r"), "payload")
    day, value = F.try_to_timestamp(F.col(f"r.{at}")).cast("timestamp_ntz"), number(F.col(f"r.{amount}"))
    reason = F.when(F.try_parse_json("payload").isNull(), "malformed").when(day.isNull(), "no_date").when(value.isNull(), "no_amount")
    return r.select(F.lit(kind).alias("kind"), day.alias("occurred_at"), value.alias("amount"), reason.alias("reason"))


# watch-lists --------------------------------------------------------------------------


def ofac_csv(lines: DataFrame) -> DataFrame:
    """Positional CSV lines (column ``value``): key, name, type, program; -0- stands for nothing."""
    names = ["key", "name", "type", "program", *[f"c{i}" for i in range(8)]]
    r = F.from_csv("value", ", ".join(f"{n} STRING" for n in names)).alias("r")
    nothing = lambda c: F.when(F.trim(c) != "-0-", F.trim(c))
    return lines.select(r).select(*[nothing(F.col(f"r.{n}")).alias(n) for n in names[:4]]).where("key IS NOT NULL AND name IS NOT NULL")


def uk_listings(rows: DataFrame) -> DataFrame:
    """Name parts by group id: the row of the best alias rank gives the name."""
    name = F.trim(F.regexp_replace(F.concat_ws(" ", "name1", "name2", "name6"), r"\s+", " "))
    rank = F.when(F.col("alias_type") == "Primary name", 0).when(F.col("alias_type") == "AKA", 1).otherwise(2)
    return rows.select("group_id", name.alias("name"), rank.alias("rank")).groupBy("group_id").agg(F.min_by("name", F.struct("rank", "name")).alias("name"), F.count("*").alias("aliases"))


def un_listings(raw: DataFrame) -> DataFrame:
    shape = "INDIVIDUALS struct<INDIVIDUAL:array<struct<DATAID:string,FIRST_NAME:string,SECOND_NAME:string,UN_LIST_TYPE:string>>>"
    t = raw.where(~has_doctype(F.col("payload"))).select(F.explode(F.from_xml("payload", shape).getField("INDIVIDUALS").getField("INDIVIDUAL")).alias("t"))
    return t.select(F.col("t.DATAID").alias("key"), F.concat_ws(" ", "t.FIRST_NAME", "t.SECOND_NAME").alias("name"), F.col("t.UN_LIST_TYPE").alias("program"))


def eu_listings(raw: DataFrame) -> DataFrame:
    """One row an entity: the best alias, strong before weak, English first."""
    shape = "sanctionEntity array<struct<_euReferenceNumber:string,nameAlias:array<struct<_wholeName:string,_strong:string,_nameLanguage:string>>>>"
    t = raw.where(~has_doctype(F.col("payload"))).select(F.explode(F.from_xml("payload", shape).getField("sanctionEntity")).alias("t"))
    a = t.select(F.col("t._euReferenceNumber").alias("key"), F.explode("t.nameAlias").alias("a")).select("key", "a.*")
    rank = F.struct(F.when(F.col("_strong") == "true", 0).otherwise(1), F.when(F.upper("_nameLanguage") == "EN", 0).otherwise(1), F.col("_wholeName"))
    return a.groupBy("key").agg(F.min_by("_wholeName", rank).alias("name"), F.count("*").alias("aliases"))


def submissions(raw: DataFrame) -> DataFrame:
    """Columnar recent filings zipped to rows."""
    r = F.from_json("payload", "struct<form:array<string>,filingDate:array<string>,accessionNumber:array<string>>").alias("r")
    z = raw.select(r).select(F.explode(F.arrays_zip("r.form", "r.filingDate", "r.accessionNumber")).alias("z"))
    return z.select(F.col("z.accessionNumber").alias("accession"), F.col("z.form").alias("form"), F.to_date("z.filingDate").alias("filed"))


MATERIAL = r"^(8-K(/A)?|S-1(/A)?|424B\d?|DEF 14A|DEFA14A)$"


def material_forms(filings: DataFrame) -> DataFrame:
    return filings.where(F.col("form").rlike(MATERIAL))


def catalogue(raw: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Entity and relationship imports: entities (key, kind, name, country) and relationships; relationships without an entity are left to an anti-join."""
    shape = "struct<entities:array<struct<key:string,kind:string,name:string,country:string>>,relationships:array<struct<src:string,rel:string,dst:string,source_url:string>>>"
    r = raw.select(F.from_json("payload", shape, {"mode": "FAILFAST"}).alias("r"))
    return r.select(F.explode("r.entities").alias("e")).select("e.*"), r.select(F.explode("r.relationships").alias("e")).select("e.*")
