"""Feature vectors: sparse cosine, pattern search and anomaly scores."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def sparse_cosine(a: Column, b: Column) -> Column:
    """Cosine of two maps of features; 0 if either has no length."""
    add = lambda acc, v: acc + v
    dot = F.aggregate(F.map_values(F.map_zip_with(a, b, lambda _, x, y: F.coalesce(x * y, F.lit(0.0)))), F.lit(0.0), add)
    norm = lambda m: F.sqrt(F.aggregate(F.map_values(m), F.lit(0.0), lambda acc, v: acc + v * v))
    return F.when((norm(a) > 0) & (norm(b) > 0), dot / (norm(a) * norm(b))).otherwise(0.0)


def exact_sum(value: Column) -> Column:
    """Sum of doubles at twelve places, the same in any order; a plain one if a value is not finite or is 1e20 or more."""
    whole = value.try_cast("decimal(32,12)")
    return F.when(F.count(value) == F.count(whole), F.sum(whole).cast("double")).otherwise(F.sum(value))


def feature_vectors(found: DataFrame) -> DataFrame:
    """One row a boundary of ``pit.evidence``: vector (a sparse map) and hash.

    Features are the records, the sum of directions, and for each kind its records
    and total amount. The hash is of the sorted features in millionths, so equal
    vectors have equal hashes; amounts are summed exactly, so their order does not show.
    """
    by_kind = found.groupBy("as_of", "kind").agg(F.count("*").alias("n"), exact_sum(F.col("amount")).alias("total"), F.sum(F.signum("amount")).alias("signs"))
    entry = lambda name, value: F.struct(name.alias("key"), F.coalesce(value.cast("double"), F.lit(0.0)).alias("value"))
    own = F.array(entry(F.concat(F.lit("kind_"), "kind"), F.col("n")), entry(F.concat(F.lit("measured_"), "kind", F.lit("_total")), F.col("total")))
    whole = F.array(entry(F.lit("event_records"), F.sum("n")), entry(F.lit("direction_score"), F.sum("signs")))
    made = by_kind.groupBy("as_of").agg(F.array_sort(F.concat(F.flatten(F.collect_list(own)), whole)).alias("e"))
    shown = F.array_join(F.transform("e", lambda x: F.concat(x["key"], F.lit("="), F.round(x["value"] * 1e6).cast("long").cast("string"))), ",")
    return made.select("as_of", F.map_from_entries("e").alias("vector"), F.substring(F.sha2(shown, 256), 1, 32).alias("hash"))


def similar_within_label(vectors: DataFrame, k: int, every: int, rows: int = 8192) -> DataFrame:
    """The k most similar other vectors of the same label for ids that ``every`` divides; cosine to 6 places, ties to the smaller id.

    Vectors and queries are dealt to blocks of about ``rows``; each query block of a
    label meets each data block of that label in a task, which gives its k best.
    """
    block = lambda n: F.pmod(F.xxhash64("vec_id"), F.lit(n)).cast("int")
    asked = vectors.where(F.col("vec_id") % every == 0)
    blocks, query_blocks = max(1, -(-vectors.count() // rows)), max(1, -(-asked.count() // rows))
    keep = lambda df: df.select("vec_id", "label", F.col("embedding").cast("array<double>").alias("x"))
    left = keep(vectors).withColumn("db", block(blocks)).withColumn("qb", F.explode(F.sequence(F.lit(0), F.lit(query_blocks - 1))))
    right = keep(asked).withColumn("qb", block(query_blocks)).withColumn("db", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))

    def meet(data: pd.DataFrame, queries: pd.DataFrame) -> pd.DataFrame:
        found = []
        if len(data) and len(queries):
            x, q = np.vstack(data["x"].to_numpy()), np.vstack(queries["x"].to_numpy())
            norms = np.sqrt((q * q).sum(1))[:, None] * np.sqrt((x * x).sum(1))[None]
            cosine = np.round(np.divide(q @ x.T, norms, out=np.zeros_like(norms), where=norms > 0), 6)
            ids = data["vec_id"].to_numpy()
            for own, line in zip(queries["vec_id"], cosine, strict=True):
                other = np.flatnonzero(ids != own)
                best = other[np.lexsort((ids[other], -line[other]))[:k]]
                found.append(pd.DataFrame({"query_id": own, "vec_id": ids[best], "similarity": line[best]}))
        return pd.concat(found) if found else pd.DataFrame({"query_id": [], "vec_id": [], "similarity": []})

    keys = ["label", "db", "qb"]
    scored = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInPandas(meet, "query_id long, vec_id long, similarity double")
    best = Window.partitionBy("query_id").orderBy(F.desc("similarity"), "vec_id")
    return scored.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)


def anomaly_score(similar: DataFrame, outcome: DataFrame) -> DataFrame:
    """Similarity-weighted mean outcome of the patterns found, scaled to +-10; null without similarity. outcome: vec_id, value in -1..1."""
    weight = F.sum(F.abs("similarity"))
    w = similar.join(outcome, "vec_id").groupBy("query_id").agg(F.when(weight > 0, F.sum(F.col("similarity") * F.col("value")) / weight).alias("mean"))
    return w.withColumn("score", F.when(F.col("mean").isNotNull(), F.greatest(F.lit(-10.0), F.least(F.lit(10.0), F.col("mean") * 10))))
