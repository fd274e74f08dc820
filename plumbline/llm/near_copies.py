"""Near copies: rows whose sets of five-word shingles have a Jaccard similarity of 0.8 or more.

Every such pair is found; shingles are told apart by 32-bit hashes. Distinct sets are
nodes, so exact copies are handled once; nodes are a table bucketed by node that
holds each set packed. In any one order of shingles, two sets of that similarity
share one of the first n - ceil(0.8 n) + 1 of each; shingles that are frequent in a
sample come last in the order, which only spares work.

First come the pairs that SimHash links: fingerprints of five-word shingles that
differ by 2 bits or fewer, met by their segments' bit counts as in ``simhash``; whole
sets decide. No radius of fingerprints holds every pair of that similarity, so a second
search follows. Each node is compared with the largest of its shared shingle and band of
sizes, which joins large groups of near copies in rows in proportion to their
size. A head's set is dealt to shares of its members, so no group meets in one
task. Then all pairs that share a shingle and are not joined yet are compared. A
shingle at place i of n is the first that a set shares with one of m only if
9 (n - i) >= 4 (n + m); where many share a shingle, nodes are listed by it, their
band of sizes and every band that this leaves, so that sets with a common passage
and enough of their own never meet. A bitmap of each set bounds what two can share:
an element sets one bit, so bits that only one has are elements that only it has;
pairs that this leaves below the overlap needed are not made. Similarity is computed from whole sets.

Rows are told apart by a number that they are stored with, so null and repeated
ids, equal rows and columns of any type that Parquet holds are as good as others.
Defined cases: null text is empty; fewer than five words are one shingle; texts
without words are copies of each other; of equal ids any one row stays; an empty
table gives no rows; all columns are kept, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.llm.common import gather, pack, stored, stored_by, unpack
from plumbline.llm.components import components
from plumbline.llm.simhash import LOWER, SEED, fingerprint
from plumbline.llm.simhash import links as linked

SHINGLE = 5
SAMPLE, FREQUENT = 16, 1 << 16
#: Pairs that one copy of a set serves, about; nodes of one shingle that are paired without a look at their sizes.
SHARE, FEW = 256, 64
WORDS = 16  # of 64 bits in a bitmap


def shingle_set(text: str) -> np.ndarray:
    """Sorted distinct 32-bit hashes (of XXH64) of a text's word shingles."""
    from xxhash import xxh64_intdigest

    words = text.encode("utf-8", "surrogatepass").translate(LOWER).split()
    if not words:
        return np.empty(0, dtype="<u4")
    if len(words) <= SHINGLE:
        parts = iter([b" ".join(words)])
    else:
        parts = map(b" ".join, zip(*(words[i:] for i in range(SHINGLE)), strict=False))
    return np.unique(np.fromiter(map(xxh64_intdigest, parts, repeat(SEED)), dtype="<u8").astype("<u4"))


def packed(found: np.ndarray) -> bytes:
    return pack(np.diff(found, prepend=found.dtype.type(0)))


def set_of(data: bytes) -> np.ndarray:
    return np.cumsum(unpack(data)[0], dtype="<u4")


def node_of(found: np.ndarray) -> int:
    from xxhash import xxh3_64_intdigest

    return xxh3_64_intdigest(found.tobytes())


def bits_of(found: np.ndarray) -> np.ndarray:
    """A bitmap of a set: the low bits of each element's hash name its bit."""
    out = np.zeros(WORDS, np.uint64)
    np.bitwise_or.at(out, (found >> 6) % WORDS, np.uint64(1) << (found & 63).astype(np.uint64))
    return out.view(np.int64)


def prefix(found: np.ndarray, frequent: np.ndarray) -> np.ndarray:
    """The first shingles in order, frequent ones last; sets at 0.8 or more share one of them."""
    n = len(found)
    late = np.searchsorted(frequent, found, "right") > np.searchsorted(frequent, found)
    return np.concatenate([found[~late], found[late]])[: n - (4 * n + 4) // 5 + 1]


def frequent_shingles(rows: DataFrame) -> np.ndarray:
    """The most frequent shingles of a sample; they only set the order."""

    def each(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame({"s": np.concatenate([shingle_set(t) for t in batch["text"]] or [[]]).astype(np.int64)})

    sample = rows.where(F.pmod("row", F.lit(SAMPLE)) == 0).select("text").mapInPandas(each, "s long")
    often = sample.groupBy("s").agg(F.count("*").alias("n")).where("n > 3")
    return np.array(sorted(r.s for r in often.orderBy(F.desc("n"), "s").limit(FREQUENT).collect()), dtype=np.int64)


def named(rows: DataFrame, whole: bool) -> DataFrame:
    """(row, node) of each row, and if ``whole`` the size of its set, the packed set, its bitmap and the text's SimHash."""

    def each(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for a in range(0, len(batch), 1024):
                found = [shingle_set(t) for t in batch["text"].iloc[a : a + 1024]]
                out = pd.DataFrame({"row": batch["row"].iloc[a : a + 1024].to_numpy(), "node": np.array([node_of(s) for s in found], dtype="<u8").view("<i8")})
                if whole:
                    marks = [fingerprint(t, SHINGLE) for t in batch["text"].iloc[a : a + 1024]]
                    out = out.assign(n=[len(s) for s in found], packed=[packed(s) for s in found], bits=[bits_of(s) for s in found], fp=marks)
                yield out

    return rows.select("row", "text").mapInPandas(each, "row long, node long" + ", n int, packed binary, bits array<long>, fp long" * whole)


def listed(nodes: DataFrame, frequent: np.ndarray) -> DataFrame:
    """(s, node, at): the first shingles of each node, its size in the high half of ``at`` and the shingle's place in the low."""

    def each(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for a in range(0, len(batch), 1024):
                part = batch.iloc[a : a + 1024]
                firsts = [prefix(set_of(p).astype(np.int64), frequent) for p in part["packed"]]
                many = np.array([len(f) for f in firsts], dtype=np.int64)
                place = gather(np.zeros(len(many), np.int64), many)
                size = np.repeat(part["n"].to_numpy(dtype=np.int64), many)
                yield pd.DataFrame({"s": np.concatenate(firsts or [[]]).astype(np.uint32).view(np.int32), "node": np.repeat(part["node"].to_numpy(), many), "at": (size << 32) | place})

    return nodes.select("node", "n", "packed").mapInPandas(each, "s int, node long, at long")


def with_sets(pairs: DataFrame, key: str, name: str, nodes: DataFrame) -> DataFrame:
    """Adds the packed set of the node in column ``key``. The set of a node in many pairs is dealt out once for every ``SHARE`` of them."""
    many = pairs.groupBy(key).agg(F.floor(F.count("*") / SHARE).cast("int").alias("more"))
    dealt = many.join(nodes.select(F.col("node").alias(key), F.col("packed").alias(name)), key)
    dealt = dealt.select(key, name, F.explode(F.sequence(F.lit(0), F.col("more"))).alias("share"))
    often = many.where("more > 0")
    share = F.coalesce(F.pmod(F.xxhash64("a", "b"), F.col("more") + 1).cast("int"), F.lit(0))
    return pairs.join(often, key, "left").withColumn("share", share).drop("more").join(dealt, [key, "share"]).drop("share")


def similar(pairs: DataFrame, nodes: DataFrame) -> DataFrame:
    """The pairs (a, b) whose sets have a similarity of 0.8 or more."""

    def each(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            good = []
            for x, y in zip(batch["x"], batch["y"], strict=True):
                x, y = set_of(x), set_of(y)
                n = len(np.intersect1d(x, y, assume_unique=True))
                good.append(5 * n >= 4 * (len(x) + len(y) - n))
            yield batch.loc[good, ["a", "b"]]

    return with_sets(with_sets(pairs, "b", "y", nodes), "a", "x", nodes).select("a", "b", "x", "y").mapInPandas(each, "a long, b long")


def overlapping(x: Column, y: Column) -> Column:
    """Whether two (n, bits) may share what a similarity of 0.8 needs: bits that only one has are elements that only it has."""
    alone = lambda a, b: sum(F.bit_count(F.get(a["bits"], F.lit(k)).bitwiseAND(F.bitwise_not(F.get(b["bits"], F.lit(k))))) for k in range(WORDS))
    return 9 * F.least(x["n"] - alone(x, y), y["n"] - alone(y, x)) >= 4 * (x["n"] + y["n"])


def possible(pairs: DataFrame, nodes: DataFrame) -> DataFrame:
    """The pairs (a, b) that sizes and bitmaps leave, before any set is fetched."""
    side = lambda key, name: nodes.select(F.col("node").alias(key), F.struct("n", "bits").alias(name))
    met = pairs.join(side("a", "x"), "a").join(side("b", "y"), "b")
    return met.where(overlapping(F.col("x"), F.col("y"))).select("a", "b")


def open_pairs(left: DataFrame) -> DataFrame:
    """(a, b) of those rows (s, i, n, node, root, bits) that share s, have different roots and may be similar by their sizes, places and bitmaps."""
    x, y = F.col("x"), F.col("y")
    # the first shingle that both share leaves room for the overlap that 0.8 needs
    room = F.least(x["n"] - x["i"], y["n"] - y["i"])
    close = (5 * F.least(x["n"], y["n"]) >= 4 * F.greatest(x["n"], y["n"])) & (9 * room >= 4 * (x["n"] + y["n"]))
    apart = (x["root"] != y["root"]) & close & overlapping(x, y)
    row = F.struct("i", "n", "node", "root", "bits")
    often = left.groupBy("s").agg(F.count("*").alias("many")).where(F.col("many") > FEW).select("s")
    few = left.join(often, "s", "left_anti").select("s", row.alias("x"))
    plain = few.join(few.select("s", F.col("x").alias("y")), "s").where(apart & (x["node"] < y["node"]))
    band = lambda size: F.floor(F.log(F.greatest(size, F.lit(1)).cast("double")) / F.log(F.lit(1.02))).cast("int")
    n, least = F.col("n"), F.ceil(F.col("n") * 4 / 5)
    most = F.least(F.floor(n * 5 / 4), F.floor((9 * (n - F.col("i")) - 4 * n) / 4))
    wide = left.join(often.hint("shuffle_hash"), "s").where(most >= least).select("s", row.alias("x"), band(n).alias("own"), F.explode(F.sequence(band(least), band(most))).alias("other"))
    back = wide.where("own >= other").select("s", F.col("x").alias("y"), F.col("own").alias("other"), F.col("other").alias("own"))
    listed = wide.where("own <= other").join(back, ["s", "own", "other"]).where(apart & ((F.col("own") < F.col("other")) | (x["node"] < y["node"])))
    ends = [F.least(x["node"], y["node"]).alias("a"), F.greatest(x["node"], y["node"]).alias("b")]
    return plain.select(*ends).union(listed.select(*ends)).distinct()


def by_fingerprint(nodes: DataFrame) -> DataFrame:
    """(a, b) of nodes whose SimHashes differ by 2 bits or fewer, each fingerprint's nodes and its neighbours by their least node."""
    heads = stored(nodes.groupBy("fp").agg(F.min("node").alias("head")), "heads")
    same = nodes.select("fp", "node").join(heads, "fp").where("node <> head").select("node", "head")
    side = lambda fp, node: heads.select(F.col("fp").alias(fp), F.col("head").alias(node))
    near = linked(heads.select("fp")).withColumnsRenamed({"a": "fa", "b": "fb"}).join(side("fa", "node"), "fa").join(side("fb", "head"), "fb").select("node", "head")
    return same.union(near).select(F.least("node", "head").alias("a"), F.greatest("node", "head").alias("b")).distinct()


def groups(rows: DataFrame) -> DataFrame:
    """(row, root) of every row; rows of one root are near copies, directly or through others."""
    frequent = frequent_shingles(rows)
    nodes = stored_by(named(rows, whole=True).groupBy("node").agg(F.first("n").alias("n"), F.first("packed").alias("packed"), F.first("bits").alias("bits"), F.min("fp").alias("fp")), "nodes", "node")
    # both columns are read on either side of the join, so that one exchange serves the count and the join
    keys = listed(nodes, frequent).repartition("s")
    who = F.struct("node", "at")
    shared = keys.groupBy("s").agg(F.min(who).alias("lo"), F.max(who).alias("hi")).where("lo.node <> hi.node").select("s")
    met = keys.join(shared.hint("shuffle_hash"), "s")
    met = stored(met.select("s", "node", F.shiftright("at", 32).cast("int").alias("n"), F.col("at").bitwiseAND(F.lit(0xFFFFFFFF)).cast("int").alias("i")), "met")
    first = stored(similar(stored(possible(by_fingerprint(nodes), nodes), "simhash"), nodes), "near")
    joined = components(first)
    band = F.floor(F.log(F.col("n").cast("double")) / F.log(F.lit(1.25))).alias("band")
    heads = met.groupBy("s", band).agg(F.max(F.struct("n", "node")).alias("head"))
    star = met.select("s", band, "node").join(heads.hint("shuffle_hash"), ["s", "band"]).where("node <> head.node")
    star = stored(star.select(F.least("node", "head.node").alias("a"), F.greatest("node", "head.node").alias("b")).distinct(), "star")
    for key in ("a", "b"):
        star = star.join(joined.select(F.col("node").alias(key), F.col("root").alias(f"root_{key}")), key, "left")
    star = stored(possible(star.where(F.coalesce("root_a", "a") != F.coalesce("root_b", "b")).select("a", "b"), nodes), "star")
    links = stored(first.union(similar(star, nodes)), "near")
    roots = components(links)
    rooted = met.join(roots, "node", "left").select("s", "i", "n", "node", F.coalesce("root", "node").alias("root"))
    open_ = rooted.groupBy("s").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo <> hi").select("s")
    left = stored(rooted.join(open_.hint("shuffle_hash"), "s"), "open")
    left = left.join(nodes.select("node", "bits"), "node")
    rest = open_pairs(left).join(star, ["a", "b"], "left_anti")
    more = stored(similar(stored(rest, "rest"), nodes), "near")
    ends = components(links.union(more))
    return named(rows, whole=False).join(ends, "node", "left").select("row", F.coalesce("root", "node").alias("root"))


def deduplicated(documents: DataFrame) -> DataFrame:
    """One row of every group of near copies, all its columns: that of least doc_id, null last."""
    key = "row"
    while key.lower() in (c.lower() for c in documents.columns):
        key += "_"
    own = stored(documents.withColumn(key, F.monotonically_increasing_id()), "numbered")
    rows = own.select(F.col(key).alias("row"), F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    found = stored(groups(rows).join(rows.select("row", "doc_id"), "row"), "groups")
    order = F.struct(F.col("doc_id").isNull(), "doc_id", "row")
    stays = found.groupBy("root").agg(F.min_by("row", order).alias("stays"))
    # texts are shuffled once at any size, as the rows that go are no bounded table
    gone = found.join(stays, "root").where("row <> stays").select(F.col("row").alias(key)).hint("shuffle_hash")
    return own.join(gone, key, "left_anti").select(*documents.columns)
