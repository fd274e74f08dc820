"""Exact top-k inner product by pivot-table elimination.

Vectors become integers floor(64 * x). Maximum inner product turns into nearest
neighbour by one more coordinate: with M the largest norm,
x' = (x, sqrt(M^2 - |x|^2)) and q' = (q, 0) give |q' - x'|^2 = |q|^2 + M^2 - 2 q.x.
Distances to pivots then bound scores from above, since |d(q', p) - d(x', p)| is
never more than d(q', x').

Pivots eliminate twice. Far-apart rows of a bounded sample are pivots of the whole
table; every row belongs to the cell of its nearest one, and a table holds the
least and largest distance from each cell to each pivot. A query is first answered
in its own cell; its k-th score there is the threshold, and only cells whose bound
reaches it are searched further, so blocks that no query reaches are not shuffled
again. Inside a block (a part of a cell, of bounded size) a pivot table of the
block's own far-apart rows gives each row's bound; candidates are evaluated in
order of their bound until no bound left reaches the k-th score or the threshold.
So the result is exact. Bounds get a slack far above double rounding.

Defined cases: see ``vectors.usable`` for rows that take no part; ties go to the
smaller vec_id; fewer candidates than k give all; an empty table gives no rows;
vectors of another length than a query's are no candidates of it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.llm.common import stored
from plumbline.llm.vectors import best_of, block_of, matrix, met, usable


def pivot_rows(vectors: np.ndarray, pivots: int) -> np.ndarray:
    """Far-apart pivots: each next one maximises the least distance to those before it."""
    chosen = [int(np.argmax((vectors**2).sum(1)))]
    least = np.full(len(vectors), np.inf)
    while len(chosen) < min(pivots, len(vectors)):
        least = np.minimum(least, ((vectors - vectors[chosen[-1]]) ** 2).sum(1))
        chosen.append(int(np.argmax(least)))
    return np.array(chosen)


def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    squared = (a**2).sum(1)[:, None] + (b**2).sum(1)[None] - 2 * a @ b.T
    return np.sqrt(np.maximum(squared, 0))


def search_block(k: int, pivots: int, step: int = 256):
    def search(query_ids, queries, ids, vectors, least):
        norm = (vectors**2).sum(1)
        top = norm.max()
        lifted = np.column_stack([vectors, np.sqrt(top - norm)])
        asks = np.column_stack([queries, np.zeros(len(queries))])
        at = pivot_rows(lifted, pivots)
        table = distances(lifted[at], lifted).astype(np.float32)  # pivots x rows
        to_pivots = distances(asks, lifted[at]).astype(np.float32)
        found = []
        for own, ask, away, reach in zip(query_ids, queries, to_pivots, least, strict=True):
            bound = np.zeros(len(ids), dtype=np.float32)
            for p in range(len(at)):
                np.maximum(bound, np.abs(table[p] - away[p]), out=bound)
            # float32 distances are off by less than 1e-4 of their size
            low = np.maximum(bound.astype(np.float64) - 1e-3 * (1 + np.sqrt(top) + np.sqrt(ask @ ask)), 0)
            best_score = (ask @ ask + top - low**2) / 2 + 1e-6
            left = np.flatnonzero((best_score >= reach) & (ids != own))
            kept_ids, kept = np.empty(0, np.int64), np.empty(0, np.int64)
            width = max(step, k)
            while left.size:
                # those of highest bound, and with them all of the same bound
                edge = np.partition(best_score[left], len(left) - width)[len(left) - width] if len(left) > width else -np.inf
                part = left[best_score[left] >= edge]
                left = left[best_score[left] < edge]
                score = np.rint(vectors[part] @ ask).astype(np.int64)
                kept_ids, kept = np.concatenate([kept_ids, ids[part]]), np.concatenate([kept, score])
                order = np.lexsort((kept_ids, -kept))[:k]
                kept_ids, kept = kept_ids[order], kept[order]
                if len(kept) == k:
                    left = left[best_score[left] >= kept[-1]]
                width *= 4
            found.append((kept_ids, kept))
        return found

    return search


def lifted(vectors: np.ndarray, top: float) -> np.ndarray:
    return np.column_stack([vectors, np.sqrt(np.maximum(top - (vectors**2).sum(1), 0))])


def reached(queries: np.ndarray, least: np.ndarray, points: np.ndarray, low: np.ndarray, high: np.ndarray, top: float) -> np.ndarray:
    """queries x cells: whether the bound of a cell's scores reaches the query's threshold."""
    away = distances(np.column_stack([queries, np.zeros(len(queries))]), points)
    gap = np.maximum(away[:, None, :] - high[None], low[None] - away[:, None, :]).max(2)
    square = (queries**2).sum(1)[:, None]
    gap = np.maximum(gap - 1e-6 * (1 + np.sqrt(top) + np.sqrt(square)), 0)
    return (square + top - gap**2) / 2 + 1e-6 >= least[:, None]


def top_k(embeddings: DataFrame, k: int = 20, every: int = 20, pivots: int = 32, data_rows: int = 8192, query_rows: int = 4096, sample: int = 4096) -> DataFrame:
    """query_id, rank, vec_id, score (integer inner product) for ids that ``every`` divides.

    Pivots of the whole table come from at most ``sample`` rows whose ids a hash
    picks; which they are changes the work only. Vectors of another length than the commonest are in a cell of their own
    that every query reaches.
    """
    whole = stored(usable(embeddings).select("vec_id", F.transform("x", lambda v: F.floor(v * 64).cast("double")).alias("x")), "vectors")
    square = F.aggregate("x", F.lit(0.0), lambda acc, v: acc + v * v)
    usual = whole.groupBy(F.size("x").alias("dim")).agg(F.count("*").alias("n"), F.max(square).alias("top")).orderBy(F.desc("n"), "dim").first()
    dim, top = (usual.dim, usual.top) if usual else (0, 0.0)
    # a share of the ids by hash, so that no more than the sample comes to the driver
    share = max(1, usual.n // sample) if usual else 1
    rows = whole.where((F.size("x") == dim) & (F.pmod(F.xxhash64("vec_id", F.lit(1)), F.lit(share)) == 0)).select("x").limit(sample).collect()
    near = lifted(np.array([r.x for r in rows], dtype=np.float64).reshape(len(rows), dim), top)
    points = near[pivot_rows(near, pivots)] if len(rows) else np.zeros((1, dim + 1))
    cells = len(points)

    def assign(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            cell = np.full(len(batch), cells, dtype=np.int32)
            own = np.flatnonzero(batch["x"].map(len).to_numpy() == dim)
            if len(own):
                cell[own] = distances(lifted(matrix(batch["x"].iloc[own]), top), points).argmin(1)
            yield batch.assign(cell=cell)

    def spread(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for cell, rows in batch.groupby("cell"):
                away = distances(lifted(matrix(rows["x"]), top), points) if cell < cells else np.zeros((len(rows), cells))
                yield pd.DataFrame({"cell": cell, "pivot": np.arange(cells), "low": away.min(0), "high": away.max(0), "n": len(rows)})

    celled = stored(whole.mapInPandas(assign, "vec_id long, x array<double>, cell int"), "cells")
    low, high, size = np.full((cells + 1, cells), np.inf), np.full((cells + 1, cells), -np.inf), np.zeros(cells + 1, dtype=np.int64)
    # as many rows as there are pairs of a cell and a pivot
    for r in celled.mapInPandas(spread, "cell int, pivot int, low double, high double, n long").groupBy("cell", "pivot").agg(F.min("low").alias("low"), F.max("high").alias("high"), F.sum("n").alias("n")).collect():
        low[r.cell, r.pivot], high[r.cell, r.pivot], size[r.cell] = r.low, r.high, r.n
    parts = np.maximum(-(-size // data_rows), 0)
    first = np.cumsum(parts) - parts

    of = lambda values, cell: F.element_at(F.array(*[F.lit(int(v)) for v in values]), cell + 1)
    asked = celled.where(F.col("vec_id") % every == 0).groupBy("vec_id").agg(F.min(F.struct("x", "cell")).alias("q")).select("vec_id", "q.*")
    query_blocks = max(1, -(-asked.count() // query_rows))
    data = celled.select("vec_id", "x", (of(first, F.col("cell")) + F.pmod(F.xxhash64("vec_id"), of(parts, F.col("cell")))).cast("int").alias("db"))

    def search_in(queries: DataFrame) -> DataFrame:
        """Answers of queries (vec_id, x, cell to search, least) in the blocks of that cell."""
        blocks = F.sequence(of(first, F.col("cell")), of(first, F.col("cell")) + of(parts, F.col("cell")) - 1)
        right = queries.where(of(parts, F.col("cell")) > 0).select("vec_id", "x", "least", block_of(query_blocks).alias("qb"), F.explode(blocks).alias("db"))
        left = data.withColumn("qb", F.explode(F.sequence(F.lit(0), F.lit(query_blocks - 1)))).join(right.select("db", "qb").distinct(), ["db", "qb"], "left_semi")
        return met(left, right, "long", search_block(k, pivots))

    near = stored(search_in(asked.withColumn("least", F.lit(None).cast("double"))), "near")
    threshold = best_of(near, k).groupBy(F.col("query_id").alias("vec_id")).agg(F.when(F.count("*") >= k, F.min("score").cast("double")).alias("least"))

    def others(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            reach = np.ones((len(batch), cells + 1), dtype=bool)
            own = np.flatnonzero(batch["x"].map(len).to_numpy() == dim)
            if len(own):
                least = batch["least"].iloc[own].fillna(-np.inf).to_numpy(dtype=np.float64)
                reach[own, :cells] = reached(matrix(batch["x"].iloc[own]), least, points, low[:cells], high[:cells], top)
            reach[np.arange(len(batch)), batch["cell"]] = False
            at, cell = np.nonzero(reach & (size > 0))
            yield batch.iloc[at].assign(cell=cell.astype(np.int32))

    further = asked.join(threshold, "vec_id", "left").select("vec_id", "x", "cell", "least").mapInPandas(others, "vec_id long, x array<double>, cell int, least double")
    return best_of(near.union(search_in(further)), k)
