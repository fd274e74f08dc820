"""Search over sparse feature maps: exact top-k by an inverted index in blocks, and scores of what is found."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from plumbline.session import staged

#: Vectors and queries of a block, about; places of a block's matrix; scores held at once.
ROWS, PLACES, AT_ONCE = 1 << 15, 1 << 23, 1 << 21


def unit(vectors: DataFrame) -> DataFrame:
    """(id, vector): maps without null, zero and non-finite values, of length one; maps that are empty then are left out."""
    finite = F.map_filter("vector", lambda _, v: v.isNotNull() & (v != 0) & (F.abs(v) < float("inf")))
    kept = vectors.select("id", F.coalesce(finite, F.create_map().cast("map<string,double>")).alias("v"))
    length = F.sqrt(F.aggregate(F.map_values("v"), F.lit(0.0), lambda a, v: a + v * v))
    return kept.withColumn("length", length).where("length > 0").select("id", F.transform_values("v", lambda _, v: v / F.col("length")).alias("vector"))


def best(rows: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("query_id").orderBy(F.desc("similarity"), "id")
    return rows.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


class Index:
    """Weights of a block of vectors by feature: a matrix if it is small, else postings."""

    def __init__(self, rows: pd.DataFrame) -> None:
        self.ids = rows["id"].to_numpy()
        feature, self.weight = np.concatenate(rows["f"].to_numpy()), np.concatenate(rows["w"].to_numpy())
        self.row = np.repeat(np.arange(len(rows)), rows["f"].map(len))
        self.features, place = np.unique(feature, return_inverse=True)
        self.matrix = None
        if len(self.features) * len(rows) <= PLACES:
            self.matrix = np.zeros((len(self.features), len(rows)))
            self.matrix[place, self.row] = self.weight
        else:
            order = np.argsort(place, kind="stable")
            self.row, self.weight = self.row[order], self.weight[order]
            self.starts = np.searchsorted(place[order], np.arange(len(self.features) + 1))

    def scores(self, queries: pd.DataFrame) -> np.ndarray:
        """The sum of products of every query's and every row's weights."""
        out = np.zeros((len(queries), len(self.ids)))
        asked = np.zeros((len(queries), len(self.features))) if self.matrix is not None else None
        for i, (f, w) in enumerate(zip(queries["f"], queries["w"], strict=True)):
            at = np.minimum(np.searchsorted(self.features, f), len(self.features) - 1)
            held = self.features[at] == f
            if asked is not None:
                asked[i, at[held]] = w[held]
                continue
            for a, q in zip(at[held], w[held], strict=True):
                lo, hi = self.starts[a], self.starts[a + 1]
                out[i, self.row[lo:hi]] += self.weight[lo:hi] * q
        return out if asked is None else asked @ self.matrix


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 10, least: float = 0.5) -> DataFrame:
    """(query_id, id, similarity, rank): the k most similar vectors of each query, of ``least`` > 0 at least, the query's own id not among them.

    Both sides are (id, vector: map of text to double). Each block of queries meets
    each block of vectors in a task, which indexes its vectors by feature, adds up
    products along the query's features and gives its k best of each query; no pair
    is shuffled with its vectors. Features are told apart by 64-bit hashes. Every
    vector is compared, so the work grows with queries times vectors, what a task
    holds does not grow. Ties go to the smaller id; ids are distinct.
    """
    if least <= 0:
        raise ValueError("least must be positive: vectors without a common feature are not searched")
    names = F.map_keys("vector")
    listed = lambda df: unit(df).select("id", F.transform(names, lambda n: F.xxhash64(n)).alias("f"), F.map_values("vector").alias("w"))
    data, asked = staged(listed(vectors), "vectors"), staged(listed(queries), "queries")
    many = {"db": max(1, -(-data.count() // ROWS)), "qb": max(1, -(-asked.count() // ROWS))}
    own = lambda name: F.pmod(F.xxhash64("id"), F.lit(many[name])).cast("int").alias(name)
    every = lambda name: F.explode(F.sequence(F.lit(0), F.lit(many[name] - 1))).alias(name)
    left, right = data.select("*", own("db"), every("qb")), asked.select("*", every("db"), own("qb"))

    def meet(rows: pd.DataFrame, wanted: pd.DataFrame) -> pd.DataFrame:
        found = [pd.DataFrame({"query_id": np.array([], "<i8"), "id": np.array([], "<i8"), "similarity": np.array([], "<f8")})]
        if not len(rows) or not len(wanted):
            return found[0]
        index, step = Index(rows), max(1, AT_ONCE // len(rows))
        for a in range(0, len(wanted), step):
            some = wanted.iloc[a : a + step]
            scores = np.floor(index.scores(some) * 1e6 + 0.5) / 1e6
            scores[some["id"].to_numpy()[:, None] == index.ids[None]] = -np.inf
            low = np.partition(scores, max(0, len(rows) - k), axis=1)[:, max(0, len(rows) - k)]
            query, row = np.nonzero((scores >= low[:, None]) & (scores >= least))
            order = np.lexsort((index.ids[row], -scores[query, row], query))
            query, row = query[order], row[order]
            first = np.arange(len(query)) - np.searchsorted(query, query) < k
            query, row = query[first], row[first]
            found.append(pd.DataFrame({"query_id": some["id"].to_numpy()[query], "id": index.ids[row], "similarity": scores[query, row]}))
        return pd.concat(found)

    met = left.groupBy("db", "qb").cogroup(right.groupBy("db", "qb")).applyInPandas(meet, "query_id long, id long, similarity double")
    return best(met, k)


def pattern_score(found: DataFrame, directions: DataFrame) -> DataFrame:
    """Per query: the best match's similarity, times ten, halved and turned round if its direction (id, direction) is another; 0 without a match or a direction."""
    own, other = directions.select(F.col("id").alias("query_id"), F.col("direction").alias("own")), directions.withColumnRenamed("direction", "other")
    top = found.where("rank = 1").join(other, "id", "left")
    made = own.join(top, "query_id", "left")
    agreement = F.when(F.col("own") == F.col("other"), 1.0).otherwise(-0.5)
    value = F.when(F.col("other").isNotNull() & F.col("own").isNotNull(), F.round(F.col("similarity") * agreement * 10, 4)).otherwise(0.0)
    status = F.when(F.col("id").isNull(), "no_match").when(F.col("other").isNull() | F.col("own").isNull(), "no_direction").otherwise("ok")
    return made.select("query_id", F.col("id").alias("matched_id"), "similarity", value.alias("score"), status.alias("status"))
