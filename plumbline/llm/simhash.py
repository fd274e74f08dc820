"""SimHash near-duplicates by a segment-popcount embedding.

A fingerprint is cut into equal segments and mapped to the vector of their bit
counts. The Manhattan distance of two such vectors never exceeds the Hamming
distance of the fingerprints, so a grid range-join under Manhattan distance 2
keeps every pair that links. Two grid points are at most 2 apart exactly if some
grid point is at most 1 from both; every fingerprint is therefore listed at its
own point and at those one step away, and points listed by one fingerprint
alone are dropped. Verification is exact and needs no pairs: inside the points
that are left, fingerprints are listed under themselves and under those one-bit
changes that fall on the point. Fingerprints listed under one value differ by at
most 2 bits, and any two that do meet under some value; a value has at most 65.
So a group of thousands of near copies costs rows in proportion to its size.

Copies share a fingerprint and are handled once. Links become components whose
id is the least doc_id reachable, itself included.

Defined cases: null text is empty; fewer words than a shingle give one shingle
of all words; no words give fingerprint zero, which links like any other;
repeated rows and repeated ids keep all their rows; an empty table gives no
rows; further columns are ignored by ``near_duplicates``.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.llm.common import stored
from plumbline.llm.components import components
from plumbline.llm.textstats import ids_of

LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")
SEED = 42
AT_ONCE = 1 << 16


def fingerprint(text: str, shingle: int = 3) -> int:
    """Signed 64-bit SimHash of a text over XXH64 of its word shingles."""
    from xxhash import xxh64_intdigest

    # bytes.split() without arguments splits at 0x20 and 0x09-0x0D
    words = text.encode("utf-8", "surrogatepass").translate(LOWER).split()
    if not words:
        return 0
    if len(words) <= shingle:
        count, shingles = 1, iter([b" ".join(words)])
    else:
        count = len(words) - shingle + 1
        shingles = map(b" ".join, zip(*(words[i:] for i in range(shingle)), strict=False))
    hashes = np.fromiter(map(xxh64_intdigest, shingles, repeat(SEED)), dtype="<u8", count=count)
    ones = np.zeros(64, dtype=np.int64)
    for at in range(0, count, AT_ONCE):
        octets = hashes[at : at + AT_ONCE].view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(octets, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(ones * 2 > count, bitorder="little").view("<i8")[0])


def fingerprints(documents: DataFrame, shingle: int = 3) -> DataFrame:
    """(doc_id, fp): the fingerprint of every whole text as a signed 64-bit integer."""

    def each(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame({"doc_id": ids_of(batch["doc_id"]), "fp": np.fromiter((fingerprint(t, shingle) for t in batch["text"]), dtype=np.int64, count=len(batch))})

    return documents.select(F.col("doc_id").cast("long").cast("string").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text")).mapInPandas(each, "doc_id long, fp long")


def links(distinct: DataFrame, segments: int = 16) -> DataFrame:
    """(a, b), a < b, such that fingerprints of column ``fp`` link at 2 or fewer bits exactly if these links connect them directly or under one value."""
    width = 64 // segments
    fp = F.col("fp")
    counts = F.array(*[F.bit_count(F.shiftrightunsigned(fp, s * width).bitwiseAND(F.lit((1 << width) - 1))) for s in range(segments)])
    # step 0 stays; step 2s + 1 takes one from segment s, step 2s + 2 adds one
    segment, up = F.floor((F.col("step") - 1) / 2).cast("int"), F.col("step") % 2 == 0
    # An exact number of partitions, or a small table would be listed by one task; not by fp itself, as Spark
    # leaves out a repartitioning that the grouping by fp has already made, and then joins its partitions.
    parts = int(distinct.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    listed = distinct.select("fp").repartition(parts, F.xxhash64("fp", F.lit(1))).select("fp", counts.alias("c")).select("fp", "c", F.explode(F.sequence(F.lit(0), F.lit(2 * segments))).alias("step"))
    own = F.element_at(F.col("c"), F.greatest(segment, F.lit(0)) + 1)
    listed = listed.where((F.col("step") == 0) | F.when(up, own < width).otherwise(own > 0))
    moved = F.transform("c", lambda v, i: F.when((F.col("step") > 0) & (i == segment), v + F.when(up, 1).otherwise(-1)).otherwise(v))
    # Points that share a hash only list more; values decide. Both columns are read on either side of the
    # join, so that one exchange serves the count and the join.
    listed = listed.select("fp", "step", F.xxhash64(moved).alias("point")).repartition("point")
    who = F.xxhash64("fp", "step")
    met = listed.groupBy("point").agg(F.min(who).alias("lo"), F.max(who).alias("hi")).where("lo <> hi").select("point")
    near = listed.join(met.hint("shuffle_hash"), "point")
    # the fingerprint itself, or its one-bit changes that make this step
    flips = F.transform(F.sequence(F.lit(0), F.lit(width - 1)), lambda i: F.call_function("shiftleft", F.lit(1).cast("long"), segment * width + i))
    wanted = F.filter(flips, lambda bit: (F.col("fp").bitwiseAND(bit) == 0) == up)
    values = F.when(F.col("step") == 0, F.array("fp")).otherwise(F.transform(wanted, lambda bit: F.col("fp").bitwiseXOR(bit)))
    value = near.select("fp", F.explode(values).alias("value"))
    groups = value.groupBy("value").agg(F.min("fp").alias("a"), F.collect_set("fp").alias("all")).where(F.size("all") > 1)
    return groups.select("a", F.explode("all").alias("b")).where("a <> b").distinct()


def near_duplicates(documents: DataFrame, shingle: int = 3, segments: int = 16) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id."""
    marked = stored(fingerprints(documents, shingle), "fingerprints")
    distinct = marked.groupBy("fp").agg(F.min("doc_id").alias("least"))
    roots = components(links(distinct, segments))
    linked = distinct.join(roots, F.col("fp") == F.col("node"))
    least = linked.groupBy("root").agg(F.min("least").alias("component_id"))
    by_fp = (
        distinct.join(roots, F.col("fp") == F.col("node"), "left")
        .join(least, "root", "left")
        .select("fp", F.coalesce("component_id", "least").alias("component_id"))
    )
    shown = F.lower(F.lpad(F.hex("fp"), 16, "0"))
    return marked.join(by_fp, "fp").select("doc_id", shown.alias("fingerprint"), "component_id")


def deduplicated(documents: DataFrame, shingle: int = 3, segments: int = 16) -> DataFrame:
    """One document of every group, that of least id, all its columns.

    Rows that share a doc_id are one document, of which the row of least text
    stays; rows with a null doc_id all stay.
    """
    groups = stored(near_duplicates(documents.where(F.col("doc_id").isNotNull()), shingle, segments), "groups")
    # an id whose rows have different texts goes if any of them is in another's group
    # texts are shuffled once at any size: the ids that go are no bounded table, and no sort of texts is needed
    gone = groups.where("doc_id <> component_id").select("doc_id").distinct().hint("shuffle_hash")
    left = documents.join(gone, "doc_id", "left_anti").select(*documents.columns)
    again = groups.groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1").select("doc_id")
    if not again.limit(1).count():
        return left
    rest = [c for c in documents.columns if c not in ("doc_id", "text")]
    one = left.join(again, "doc_id", "left_semi").groupBy("doc_id").agg(F.min(F.struct("text", *rest)).alias("row"))
    once = one.select(*[F.col("doc_id") if c == "doc_id" else F.col("row")[c].alias(c) for c in documents.columns])
    return left.join(again, "doc_id", "left_anti").select(*documents.columns).union(once)
