"""Merge rules, references, matching and search over registry tables.

Upserts are aggregations over the rows of a key in load order, so that they
combine before the shuffle and need no sort: the newest non-null value wins, or
the whole newest row, or the first.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.functions.text import name_tokens, normalize_name


def upsert_fields(rows: DataFrame, keys: Sequence[str], order: str) -> DataFrame:
    """One row a key: for every column the newest value that is not null."""
    rest = [c for c in rows.columns if c not in (*keys, order)]
    newest = lambda c: F.max_by(F.col(c), F.when(F.col(c).isNotNull(), F.col(order))).alias(c)
    return rows.groupBy(*keys).agg(*[newest(c) for c in rest], F.max(order).alias(order))


def latest(rows: DataFrame, keys: Sequence[str], order: Column, first: bool = False) -> DataFrame:
    """One whole row a key: the newest, or the first."""
    rest = [c for c in rows.columns if c not in keys]
    pick = (F.min_by if first else F.max_by)(F.struct(*rest), order)
    return rows.groupBy(*keys).agg(pick.alias("_row")).select(*keys, "_row.*")


def sightings(edges: DataFrame, at: str) -> DataFrame:
    """Edges seen more than once become one: first and last sighting, how often, newest active flag."""
    return edges.groupBy("src", "rel", "dst").agg(F.min(at).alias("first_seen"), F.max(at).alias("last_seen"), F.count("*").alias("seen_count"), F.max_by("active", at).alias("active"))


def insert_or_ignore(stored: DataFrame, new: DataFrame, keys: Sequence[str], order: Column) -> DataFrame:
    """Stored rows, and of the new ones the first of each key that is not stored."""
    fresh = latest(new, keys, order, first=True).join(stored.select(*keys), list(keys), "left_anti")
    return stored.unionByName(fresh.select(*stored.columns))


def ohlc_reason() -> Column:
    """Why a bar is refused, or null."""
    o, h, low, c = (F.col(x) for x in ("open", "high", "low", "close"))
    return (
        F.when(o.isNull() | h.isNull() | low.isNull() | c.isNull(), "missing")
        .when((o <= 0) | (h <= 0) | (low <= 0) | (c <= 0), "not_positive")
        .when(h < low, "high_below_low")
        .when((o > h) | (o < low) | (c > h) | (c < low), "outside_range")
        .when(F.col("volume") < 0, "negative_volume")
    )


def quarantine(bars: DataFrame) -> DataFrame:
    """Adds the reason and validity; both parts are filters over it."""
    return bars.withColumn("reason", ohlc_reason()).withColumn("valid", F.col("reason").isNull())


def orphans(child: DataFrame, parent: DataFrame, child_key: str, parent_key: str) -> DataFrame:
    return child.join(parent.select(F.col(parent_key).alias(child_key)), child_key, "left_anti")


def resolve_alias(rows: DataFrame, aliases: DataFrame, key: str) -> DataFrame:
    """Replaces keys that were merged; aliases (alias, target) are one level deep."""
    named = aliases.select(F.col("alias").alias(key), "target")
    return rows.join(named, key, "left").withColumn(key, F.coalesce("target", key)).drop("target")


def alias_chains(aliases: DataFrame) -> DataFrame:
    """Aliases whose target is an alias itself: to be refused."""
    return aliases.join(aliases.select(F.col("alias").alias("target")).distinct(), "target", "left_semi").select("alias", "target")


def delisted(active: DataFrame, snapshot: DataFrame, key: str) -> DataFrame:
    return active.join(snapshot.select(key), key, "left_anti")


def search(entities: DataFrame, text: str, country: str | None = None, kind: str | None = None, limit: int | None = None) -> DataFrame:
    """Entities whose key, kind, name or country holds the text in any case."""
    wanted = f"%{text.replace(chr(92), chr(92) * 2).replace('%', chr(92) + '%').replace('_', chr(92) + '_')}%"
    hit = F.lit(False)
    for c in ("key", "kind", "name", "country"):
        hit = hit | F.col(c).ilike(wanted)
    out = entities.where(hit)
    out = out.where(F.col("country").ilike(country)) if country else out
    out = out.where(F.col("kind") == kind) if kind else out
    return out.orderBy("name", "key").limit(limit) if limit else out


def watchlist_candidates(listings: DataFrame, entities: DataFrame, linked: DataFrame) -> DataFrame:
    """(listing, entity) of equal normalised names that are not linked yet; listings and entities have key and name, linked has listing and entity."""
    named = lambda df, out: df.select(F.col("key").alias(out), normalize_name(F.col("name")).alias("norm")).where("norm <> ''")
    return named(listings, "listing").join(named(entities, "entity"), "norm").select("listing", "entity").join(linked.select("listing", "entity"), ["listing", "entity"], "left_anti")


def duplicate_links(entities: DataFrame) -> DataFrame:
    """Links (a, b, reason) of keys that may be one firm: same LEI, name and country, or name; the strongest of each pair.

    Columns key, name, country and, if known, lei. Each class of one LEI, of one
    name and country, and of one name is linked to its least key, so that a class
    of n members gives n - 1 rows; empty LEIs and countries are not equal.
    """
    some = lambda c: F.when(F.trim(c) != "", c)
    lei = some(F.upper(F.trim("lei"))) if "lei" in entities.columns else F.lit(None).cast("string")
    named = entities.select("key", F.struct(lei.alias("lei"), normalize_name(F.col("name")).alias("norm"), some(F.col("country")).alias("country")).alias("own"))
    rules = {"lei": F.col("own.lei"), "name_country": F.when(F.col("own.norm").isNotNull() & F.col("own.country").isNotNull(), F.struct("own.norm", "own.country")), "name": F.col("own.norm")}
    reason = F.when(F.col("own.lei") == F.col("head.own.lei"), "lei")
    reason = reason.when((F.col("own.norm") == F.col("head.own.norm")) & (F.col("own.country") == F.col("head.own.country")), "name_country").otherwise("name")
    found = None
    for shared in rules.values():
        held = named.select("key", "own", shared.alias("class")).where("class IS NOT NULL")
        heads = held.groupBy("class").agg(F.min_by(F.struct("key", "own"), "key").alias("head"), F.count("*").alias("n")).where("n > 1")
        star = held.join(heads, "class").where(F.col("key") > F.col("head.key")).select(F.col("head.key").alias("a"), F.col("key").alias("b"), reason.alias("reason"))
        found = star if found is None else found.union(star)
    return found.distinct()


def fuzzy_links(entities: DataFrame, tenths: int = 6) -> DataFrame:
    """All links (a, b, score) of names whose token overlap coefficient is ``tenths`` / 10 or more.

    Columns key and name. Keys of one token set are linked to the least of them,
    with score 1, and the least keys of two sets that match are linked with the
    sets' score: every matching pair of names is in these rows, without a row for
    each. Of two sets the smaller has one of its n - ceil(tenths n / 10) + 1
    rarest tokens in the other, so sets meet only on those.
    """
    named = entities.select("key", F.array_sort(name_tokens(F.col("name"))).alias("toks")).where(F.size("toks") > 0)
    sets = named.groupBy("toks").agg(F.min("key").alias("head"), F.size("toks").alias("n")).select("head", "toks", "n")
    listed = sets.select("head", "n", F.explode("toks").alias("tok"))
    rarity = listed.groupBy("tok").agg(F.count("*").alias("often"))
    placed = listed.join(rarity, "tok").groupBy("head", "n").agg(F.sort_array(F.collect_list(F.struct("often", "tok"))).alias("own"))
    first = F.slice("own", F.lit(1), F.col("n") - F.ceil(F.col("n") * tenths / 10).cast("int") + 1)
    few = placed.select(F.col("head").alias("x"), F.col("n").alias("nx"), F.explode(first).alias("t")).select("x", "nx", F.col("t.tok").alias("tok"))
    met = few.join(listed.select(F.col("head").alias("y"), F.col("n").alias("ny"), "tok"), "tok")
    met = met.where("nx < ny OR nx = ny AND x <> y").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()
    side = lambda key, toks: sets.select(F.col("head").alias(key), F.col("toks").alias(toks))
    both = met.join(side("a", "ta"), "a").join(side("b", "tb"), "b").withColumn("n", F.size(F.array_intersect("ta", "tb"))).withColumn("least", F.least(F.size("ta"), F.size("tb")))
    matched = both.where(F.col("n") * 10 >= F.col("least") * tenths).select("a", "b", (F.col("n") / F.col("least")).alias("score"))
    same = named.join(sets.select("toks", "head"), "toks").where("key <> head").select(F.col("head").alias("a"), F.col("key").alias("b"), F.lit(1.0).alias("score"))
    return matched.union(same)
