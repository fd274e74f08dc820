"""Best-fit packing of token sequences, improved by swaps.

Documents of more than a sequence are cut, the first piece being the short one;
all others stay whole. Pieces are dealt out to bounded groups, each packed by
best fit in decreasing order. Then local search works on the bins that are not
full: moving a document, exchanging one for one, or two for one, whenever that
increases the sum of squared fills. The emptiest bins give; a bin whose last
document leaves is gone. The search ends at the lower bound of bins or when no
exchange helps.

Only pieces' sizes are shuffled, never texts or ids. Defined cases: null text is
empty and is the end id alone; repeated rows are packed each; null doc_ids are
kept; an empty table gives no rows; further columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.llm import tokens
from plumbline.llm.common import stored
from plumbline.llm.textstats import ids_of

PIECE = "doc_id long, piece int, start long, length long, ids_crc32 long"


def pieces(documents: DataFrame, vocabulary: str, capacity: int = 2048) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 of every piece."""

    def each(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encode, end = tokens.encoder(vocabulary).encode, np.array([tokens.END], dtype="<u2").tobytes()
        for batch in batches:
            texts, doc_ids = batch["text"].tolist(), ids_of(batch["doc_id"])
            for a, b in tokens.chunks(texts):
                found = [x + end for x in encode(texts[a:b])]
                n = np.array([len(x) // 2 for x in found], dtype=np.int64)
                ids, begin = np.frombuffer(b"".join(found), "<u2").astype("<u4"), np.cumsum(n) - n
                many = -(-n // capacity)
                of = np.repeat(np.arange(b - a), many)
                piece = np.arange(len(of)) - np.repeat(np.cumsum(many) - many, many)
                # the first piece is the short one
                stop = n[of] - (many[of] - 1 - piece) * capacity
                start = np.maximum(stop - capacity, 0)
                crc = [zlib.crc32(ids[s:e]) for s, e in zip((begin[of] + start).tolist(), (begin[of] + stop).tolist(), strict=True)]
                yield pd.DataFrame({"doc_id": doc_ids.iloc[a + of].array, "piece": piece, "start": start, "length": stop - start, "ids_crc32": crc})

    return documents.select(F.col("doc_id").cast("long").cast("string").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text")).mapInPandas(each, PIECE)


def best_fit(sizes: list[int], capacity: int) -> list[list[int]]:
    """Items by bin: the largest first, each into the fullest bin that has room."""
    bins: list[list[int]] = []
    by_room: list[list[int]] = [[] for _ in range(capacity + 1)]
    rooms = 0  # bit r: some bin has room r
    for i in sorted(range(len(sizes)), key=lambda i: -sizes[i]):
        size = sizes[i]
        fitting = rooms >> size
        if fitting:
            room = size + (fitting & -fitting).bit_length() - 1
            b = by_room[room].pop()
            if not by_room[room]:
                rooms ^= 1 << room
        else:
            room, b = capacity, len(bins)
            bins.append([])
        bins[b].append(i)
        left = room - size
        by_room[left].append(b)
        rooms |= 1 << left
    return bins


def improve(bins: list[list[int]], sizes: list[int], capacity: int) -> list[list[int]]:
    """Swap-based local search over all documents, and all pairs of documents, of the giving bin.

    Documents of one size are alike, and the distinct sizes in a bin add up to
    ``capacity`` at most, so they are fewer than the root of twice the capacity.
    """
    least = -(-sum(sizes) // capacity)
    full = [b for b in bins if sum(sizes[i] for i in b) == capacity]
    open_ = [list(b) for b in bins if sum(sizes[i] for i in b) < capacity]
    gone = len(full)
    fill = np.array([sum(sizes[i] for i in b) for b in open_], dtype=np.int64)
    item = np.array([i for b in open_ for i in b], dtype=np.int64)
    if not len(item):
        return bins
    size = np.array([sizes[i] for i in item], dtype=np.int64)
    home = np.repeat(np.arange(len(open_)), [len(b) for b in open_])
    tried = np.zeros(len(open_), dtype=bool)
    alive = len(open_)

    def exchange(giver: int) -> bool:
        own = np.flatnonzero(home == giver)
        own = own[np.argsort(-size[own], kind="stable")]
        first = np.flatnonzero(np.diff(size[own], prepend=-1))
        units = [(int(size[i]), (i,)) for i in own[first]]
        # one document of each size, and a second one that it may be paired with
        some = own[np.unique(np.concatenate([first, np.append(first[1:], len(own)) - 1]))]
        units += [(int(size[a] + size[b]), (a, b)) for n, a in enumerate(some) for b in some[n + 1 :]]
        room = capacity - fill
        for weight, unit in units:
            # a move: into the fullest bin with room
            gain = np.where((room >= weight) & (fill > 0), fill, -1)
            gain[giver] = -1
            to = int(gain.argmax())
            if gain[to] >= 0 and fill[to] + weight > fill[giver]:
                home[list(unit)] = to
                fill[to] += weight
                fill[giver] -= weight
                return True
            # one or two for one: the exchange that fills most
            net = weight - size
            good = (net > 0) & (net <= room[home]) & (home != giver) & (fill[home] + net > fill[giver])
            if good.any():
                other = int(np.where(good, fill[home] + net, -1).argmax())
                to = int(home[other])
                home[list(unit)] = to
                home[other] = giver
                fill[to] += net[other]
                fill[giver] -= net[other]
                return True
        return False

    while gone + alive > least:
        waiting = np.flatnonzero(~tried & (fill > 0))
        if not len(waiting):
            break
        giver = int(waiting[fill[waiting].argmin()])
        while fill[giver] > 0 and exchange(giver):
            pass
        tried[giver] = True
        alive -= int(fill[giver] == 0)
    packed: dict[int, list[int]] = {}
    for i, b in zip(item.tolist(), home.tolist(), strict=True):
        packed.setdefault(b, []).append(i)
    return [*full, *packed.values()]


def pack(documents: DataFrame, vocabulary: str, capacity: int = 2048, group_rows: int = 16384) -> DataFrame:
    """``pieces`` with sequence_id and offset."""
    cut = stored(pieces(documents, vocabulary, capacity), "pieces")
    groups = max(1, round(cut.count() / group_rows))

    def each(key, group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(["doc_id", "piece", "ids_crc32"], kind="stable").reset_index(drop=True)
        sizes = group["length"].tolist()
        bins = improve(best_fit(sizes, capacity), sizes, capacity)
        sequence, offset = np.empty(len(group), np.int64), np.empty(len(group), np.int64)
        for n, b in enumerate(bins):
            at = 0
            for i in b:
                sequence[i], offset[i] = (int(key[0]) << 32) + n, at
                at += sizes[i]
        return group.drop(columns="g").assign(doc_id=ids_of(group["doc_id"]), sequence_id=sequence, offset=offset)

    # ids of rows of the stored files: the same whenever a task reads them again
    dealt = cut.withColumn("doc_id", F.col("doc_id").cast("string")).withColumn("g", F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(groups)).cast("int"))
    return dealt.groupBy("g").applyInPandas(each, f"{PIECE}, sequence_id long, offset long")
