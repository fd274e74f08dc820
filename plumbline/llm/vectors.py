"""Vectors in bounded blocks: every query block meets every data block once.

The grid is an equi-join on (query block, data block) through ``cogroup``; each
task holds one block of either side, so memory stays bounded however many rows
or queries there are, nothing is broadcast, and a lost task is redone alone.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def usable(embeddings: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """(vec_id, x): distinct rows, components as double.

    Rows with a null id, a null or empty vector, or a null or non-finite
    component take no part. Rows that repeat an id and its vector count once; rows
    that share an id and differ are candidates each.
    """
    x = F.col(embedding).cast("array<double>")
    finite = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) != float("inf")))
    return (
        embeddings.where(F.col(vec_id).isNotNull() & F.col(embedding).isNotNull() & (F.size(embedding) > 0) & finite)
        .select(F.col(vec_id).cast("long").alias("vec_id"), x.alias("x"))
        .distinct()
    )


def block_of(blocks: int) -> F.Column:
    return F.pmod(F.xxhash64("vec_id"), F.lit(blocks)).cast("int")


def block_search(
    data: DataFrame,
    every: int,
    k: int,
    score_type: str,
    search: Callable[..., list[tuple[np.ndarray, np.ndarray]]],
    data_rows: int = 8192,
    query_rows: int = 4096,
) -> DataFrame:
    """The ``k`` best of ``data`` for each row whose id ``every`` divides.

    ``search(query_ids, queries, ids, vectors, least)`` gives for each query the
    ids and scores of its best in the block, at most k. Result: query_id, rank,
    vec_id, score; ties go to the smaller vec_id. An id asks once, by its smallest
    vector, and no row of its own id is its candidate.
    """
    asked = data.where(F.col("vec_id") % every == 0).groupBy("vec_id").agg(F.min("x").alias("x"))
    n, q = data.count(), asked.count()
    data_blocks, query_blocks = max(1, -(-n // data_rows)), max(1, -(-q // query_rows))
    left = data.select("vec_id", "x", block_of(data_blocks).alias("db"), F.explode(F.sequence(F.lit(0), F.lit(query_blocks - 1))).alias("qb"))
    right = asked.select("vec_id", "x", block_of(query_blocks).alias("qb"), F.explode(F.sequence(F.lit(0), F.lit(data_blocks - 1))).alias("db"), F.lit(None).cast("double").alias("least"))
    return best_of(met(left, right, score_type, search), k)


def met(left: DataFrame, right: DataFrame, score_type: str, search: Callable[..., list[tuple[np.ndarray, np.ndarray]]]) -> DataFrame:
    """query_id, vec_id, score from the meetings of data (vec_id, x, db, qb) and queries (the same and least, the score that counts, or null) of one block each."""

    def meet(rows: pd.DataFrame, queries: pd.DataFrame) -> pd.DataFrame:
        found = [(np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0))]
        lengths = set(rows["x"].map(len)) & set(queries["x"].map(len)) if len(rows) and len(queries) else []
        for length in lengths:
            rows_, queries_ = rows[rows["x"].map(len) == length].sort_values("vec_id"), queries[queries["x"].map(len) == length]
            ids, query_ids = rows_["vec_id"].to_numpy(), queries_["vec_id"].to_numpy()
            least = queries_["least"].fillna(-np.inf).to_numpy(dtype=np.float64)
            for own, (best, score) in zip(query_ids, search(query_ids, matrix(queries_["x"]), ids, matrix(rows_["x"]), least), strict=True):
                found.append((np.full(len(best), own), best, score))
        query_id, vec_id, score = (np.concatenate(part) for part in zip(*found[len(found) > 1 :], strict=True))
        return pd.DataFrame({"query_id": query_id, "vec_id": vec_id, "score": score})

    keys = ["db", "qb"]
    # new columns, as both sides may come from one table
    left, right = (df.select(*[F.col(c).alias(c) for c in df.columns]) for df in (left, right))
    return left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInPandas(meet, f"query_id long, vec_id long, score {score_type}")


def best_of(near: DataFrame, k: int) -> DataFrame:
    from pyspark.sql import Window

    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return near.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def matrix(column: pd.Series) -> np.ndarray:
    return np.vstack(column.to_numpy()).astype(np.float64, copy=False)
