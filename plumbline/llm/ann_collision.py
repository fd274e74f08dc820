"""Approximate nearest neighbours by collision counting over single projections.

Vectors are scaled to length 1. Every block of rows keeps one sorted array for
each random projection. A query opens a window around its own projection in all
arrays; by virtual rehashing the windows widen by a fixed factor from round to
round, and only the rows that enter on either side of a window are counted. Rows
in the windows of more than a threshold share of the projections are verified by
their exact cosine. A query is done in a block once k verified rows lie within the distance
that the current windows stand for, or every row has been verified; there is no
cap on candidates. Every row is indexed.

Projections come in orthogonal groups, which makes collision counts vary less
than those of independent ones. The window at radius r is ``width * r`` to
either side in units of the projections' spread at that distance.

Defined cases: zero vectors and those named in ``vectors.usable`` take no part;
ties go to the smaller vec_id; fewer candidates than k give all; an empty table
gives no rows.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.llm.common import gather
from plumbline.llm.vectors import block_search, usable


def projections(dim: int, count: int, seed: int) -> np.ndarray:
    """dim x count, columns orthonormal within groups of dim."""
    rng = np.random.default_rng(seed)
    groups = [np.linalg.qr(rng.standard_normal((dim, dim)))[0] for _ in range(-(-count // dim))]
    return np.hstack(groups)[:, :count] * np.sqrt(dim)


def search_block(k: int, count: int, seed: int, radius: float, factor: float, width: float, share: float):
    radii = [radius]
    while radii[-1] < 2:
        radii.append(radii[-1] * factor)
    reach = width * np.array([*radii, np.inf])

    def search(query_ids, queries, ids, vectors, least=None):
        unit = vectors / np.linalg.norm(vectors, axis=1)[:, None]
        asks = queries / np.linalg.norm(queries, axis=1)[:, None]
        turn = projections(vectors.shape[1], count, seed)
        place, at = unit @ turn, asks @ turn
        # the sorted arrays one after the other, and where in them the windows of all rounds begin and end
        order = np.argsort(place, axis=0)
        rows = order.T.ravel()
        low = np.empty((len(asks), len(reach) + 1, count), dtype=np.int64)
        high = np.empty_like(low)
        for i in range(count):
            line = place[order[:, i], i]
            own_place = np.searchsorted(line, at[:, i])
            low[:, 0, i] = high[:, 0, i] = own_place
            low[:, 1:, i] = np.minimum(np.searchsorted(line, at[:, i, None] - reach), own_place[:, None])
            high[:, 1:, i] = np.maximum(np.searchsorted(line, at[:, i, None] + reach, side="right"), own_place[:, None])
        base = np.arange(count) * len(ids)
        need = int(np.ceil(share * count))
        found = []
        for q, (own, ask, raw) in enumerate(zip(query_ids, asks, queries, strict=True)):
            cosine = np.full(len(ids), -np.inf)
            seen = ids == own
            hits = np.zeros(len(ids), dtype=np.int64)
            for r, distance in enumerate([*radii, 2.0]):
                before, after = low[q, r] - low[q, r + 1], high[q, r + 1] - high[q, r]
                entered = gather(np.concatenate([base + low[q, r + 1], base + high[q, r]]), np.concatenate([before, after]))
                hits += np.bincount(rows[entered], minlength=len(ids))
                fresh = np.flatnonzero((hits >= need) & ~seen)
                if fresh.size:
                    cosine[fresh] = unit[fresh] @ ask
                    seen[fresh] = True
                if seen.all() or np.count_nonzero(cosine >= 1 - distance * distance / 2) >= k:
                    break
            part = np.flatnonzero(cosine > -np.inf)
            if len(part) > 4 * k:  # those that could tie with the k-th within rounding
                kth = np.partition(cosine[part], len(part) - k)[len(part) - k]
                part = part[cosine[part] >= kth - 1e-9]
            exact = (vectors[part] * raw).sum(1) / (np.sqrt((vectors[part] ** 2).sum(1)) * np.sqrt((raw * raw).sum()))
            best = np.lexsort((ids[part], -exact))[:k]
            found.append((ids[part][best], exact[best]))
        return found

    return search


def nearest(
    embeddings: DataFrame,
    k: int = 5,
    every: int = 50,
    projections_: int = 64,
    seed: int = 7,
    radius: float = 0.15,
    factor: float = 1.3,
    width: float = 0.8,
    share: float = 0.55,
    data_rows: int = 8192,
    query_rows: int = 4096,
) -> DataFrame:
    """query_id, rank, vec_id, score (cosine) for ids that ``every`` divides."""
    whole = usable(embeddings).where(F.exists("x", lambda v: v != 0))
    return block_search(whole, every, k, "double", search_block(k, projections_, seed, radius, factor, width, share), data_rows, query_rows)
