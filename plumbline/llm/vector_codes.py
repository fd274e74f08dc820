"""Vectors compressed to codes of their parts: codebooks by Hamerly's form of Lloyd's rounds, in whole numbers.

Components are scaled and floored to integers, vectors are cut into equal parts,
and every part is replaced by the index of its nearest codebook entry (squared
Euclidean distance, ties to the lower index). Codebooks start as the parts of the
vectors of least id. A round assigns all parts and replaces each used entry by
its parts' componentwise floor(sum / count).

The state of a row is kept in the shared folder between rounds: its integers, its
codes and, for each part, an upper bound of the distance to its entry and a lower
bound of the distance to the second-nearest. When entries move, the upper bound
grows by its entry's move and the lower shrinks by the largest move of another.
A part whose upper bound is strictly below its lower bound, or below half the
distance of its entry to the closest other, keeps its code: no other entry is as
near, so no tie can be missed. Else the upper bound is made exact; only where that
does not help either is the part compared with every entry. Distances are
integers; bounds are single-precision roots, rounded outwards.

Codebooks are bounded (parts x entries), go to tasks with the code and come back
as one partial sum for each task and entry. Labels' errors are summed before they
are joined to rows.

Defined cases: vectors that are null, empty or hold null or non-finite components
are dropped, and so are those of another length than that of the least id; ids
that repeat are rows each and give the codebooks their least vector; null ids
come after all others; fewer distinct ids than entries give smaller codebooks; an empty
table gives no rows; further columns are dropped. Scaled components must stay within
2**24, else ValueError.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.llm.common import drop_stored, stored

LIMIT = 1 << 24
ROWS = 1 << 10
#: Labels whose sums are broadcast at most; more are joined by shuffle.
LABELS = 1 << 16


@dataclass
class Codebooks:
    """Entries as integers, parts x entries x width; ``scanned`` counts the parts compared with every entry, by assignment."""

    entries: np.ndarray
    scanned: list[int]

    def sha256(self) -> str:
        return hashlib.sha256(",".join(map(str, self.entries.ravel().tolist())).encode()).hexdigest()


def integers(vectors: DataFrame, scale: int = 256, key: str = "vec_id", vector: str = "embedding", label: str = "label") -> DataFrame:
    """(vec_id, label, n, x): floor(scale * component) of every vector that has only finite components, packed as 32-bit integers."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column("x")
            lists = column.fill_null([]) if column.null_count else column
            flat = lists.flatten()
            value = flat.to_numpy(zero_copy_only=False).astype(np.float64)
            offsets = lists.offsets.to_numpy().astype(np.int64)
            offsets = offsets - offsets[0]
            length = np.diff(offsets)
            odd = np.concatenate([[0], np.cumsum(~np.isfinite(value))])
            good = np.flatnonzero((length > 0) & (odd[offsets[1:]] == odd[offsets[:-1]]))
            with np.errstate(invalid="ignore"):
                whole = np.floor(scale * value)
            packed = []
            for i in good:
                own = whole[offsets[i] : offsets[i + 1]]
                if np.abs(own).max() > LIMIT:
                    raise ValueError(f"a scaled component is beyond {LIMIT}")
                packed.append(own.astype("<i4").tobytes())
            kept = batch.take(pa.array(good))
            yield pa.RecordBatch.from_arrays([kept.column("vec_id"), kept.column("label"), pa.array(length[good], pa.int32()), pa.array(packed, pa.binary())], names=["vec_id", "label", "n", "x"])

    kind = dict(vectors.dtypes)[label]
    chosen = vectors.select(F.col(key).cast("long").alias("vec_id"), F.col(label).alias("label"), F.col(vector).cast("array<double>").alias("x"))
    return chosen.mapInArrow(each, f"vec_id long, label {kind}, n int, x binary")


def first_vectors(rows: DataFrame, count: int) -> list[np.ndarray]:
    """The least vector of each of the ``count`` least ids. A task passes on as many at most."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict = {}
        for batch in batches:
            for key, x in zip(batch.column("vec_id").to_pylist(), batch.column("x").to_pylist(), strict=True):
                x = np.frombuffer(x, "<i4").tolist()
                found[key] = min(x, found.get(key, x))
            found = {k: found[k] for k in sorted(found, key=lambda k: (k is None, k or 0))[:count]}
        yield pa.RecordBatch.from_arrays([pa.array(list(found), pa.int64()), pa.array(list(found.values()), pa.list_(pa.int32()))], names=["vec_id", "x"])

    few = rows.select("vec_id", "x").mapInArrow(each, "vec_id long, x array<int>").groupBy("vec_id").agg(F.min("x").alias("x"))
    return [np.array(r.x, np.int64) for r in few.orderBy(F.asc_nulls_last("vec_id")).limit(count).collect()]


def distances(x: np.ndarray, entries: np.ndarray) -> np.ndarray:
    """Squared distances of parts (n x width) to the entries (k x width) of one codebook."""
    gap = x[:, None, :] - entries[None]
    return np.einsum("nkw,nkw->nk", gap, gap)


def up(x: np.ndarray) -> np.ndarray:
    """Single-precision numbers that are not below x."""
    return np.nextafter(x.astype("<f4"), np.float32(np.inf))


def down(x: np.ndarray) -> np.ndarray:
    return np.maximum(np.nextafter(x.astype("<f4"), np.float32(-np.inf)), np.float32(0))


@dataclass
class Moves:
    """How far entries moved since the bounds were set: by entry, the largest other move of each entry, and half the gap to the closest other entry."""

    own: np.ndarray
    other: np.ndarray
    half: np.ndarray

    @classmethod
    def between(cls, before: np.ndarray, after: np.ndarray) -> Moves:
        own = np.sqrt(((after - before) ** 2).sum(2).astype(np.float64)) * (1 + 1e-12)
        k = own.shape[1]
        other, half = np.zeros_like(own), np.full_like(own, np.inf)
        if k > 1:
            rank = np.sort(own, axis=1)
            other = np.where(np.arange(k) == own.argmax(1)[:, None], rank[:, -2:-1], rank[:, -1:])
            for p in range(len(after)):
                gap = distances(after[p], after[p]).astype(np.float64)
                np.fill_diagonal(gap, np.inf)
                half[p] = np.sqrt(gap.min(1)) / 2 * (1 - 1e-12)
        return cls(own, other, half)


def scan(x: np.ndarray, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Codes, exact squared distances and the second-least ones of parts of one codebook."""
    gap = distances(x, entries)
    code = gap.argmin(1)
    least = gap[np.arange(len(x)), code]
    if gap.shape[1] == 1:
        return code, least, np.full(len(x), np.inf)
    return code, least, np.partition(gap, 1, axis=1)[:, 1].astype(np.float64)


def assign(x: np.ndarray, entries: np.ndarray, code: np.ndarray | None = None, upper: np.ndarray | None = None, lower: np.ndarray | None = None, moves: Moves | None = None):
    """Codes, exact squared distances, upper and lower bounds (rows x parts) and the number of parts that were scanned.

    ``x`` is rows x parts x width. Without bounds every part is scanned. Distances
    of parts that keep their code by their old bounds are computed too: they are
    one entry's each.
    """
    rows, parts = x.shape[:2]
    out = np.empty((rows, parts), np.int64), np.empty((rows, parts), np.int64), np.empty((rows, parts), "<f4"), np.empty((rows, parts), "<f4")
    scanned = 0
    for p in range(parts):
        if code is None:
            todo, own, exact, low = np.arange(rows), np.zeros(rows, np.int64), np.zeros(rows, np.int64), np.zeros(rows, "<f4")
            high = low.copy()
        else:
            own = code[:, p].astype(np.int64)
            low = down(lower[:, p].astype(np.float64) - moves.other[p, own])
            high = up(upper[:, p].astype(np.float64) + moves.own[p, own])
            bound = np.maximum(low, moves.half[p, own])
            exact = ((x[:, p] - entries[p, own]) ** 2).sum(1)
            loose = np.flatnonzero(~(high < bound))
            high[loose] = up(np.sqrt(exact[loose].astype(np.float64)))
            todo = loose[~(high[loose] < bound[loose])]
        if len(todo):
            own[todo], exact[todo], second = scan(x[todo, p], entries[p])
            high[todo], low[todo] = up(np.sqrt(exact[todo].astype(np.float64))), down(np.sqrt(second))
        scanned += len(todo)
        for to, what in zip(out, (own, exact, high, low), strict=True):
            to[:, p] = what
    return *out, scanned


def blocks_of(batch: pa.RecordBatch, parts: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    for a in range(0, batch.num_rows, ROWS):
        some = batch.slice(a, ROWS)
        x = np.frombuffer(b"".join(some.column("x").to_pylist()), "<i4").astype(np.int64)
        yield some, x.reshape(some.num_rows, parts, -1)


def packed(rows: np.ndarray, kind: str) -> pa.Array:
    return pa.array([r.tobytes() for r in rows.astype(kind)], pa.binary())


def unpacked(column: pa.Array, kind: str, parts: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), kind).reshape(-1, parts)


def assigned(rows: DataFrame, entries: np.ndarray, moves: Moves | None, last: bool = False) -> DataFrame:
    """The state after an assignment, or, if ``last``, vec_id, label, code and error. ``scanned`` is a row's parts that were compared with all entries."""
    parts, code_kind = len(entries), "u1" if entries.shape[1] <= 256 else "<u2"

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for some, x in blocks_of(batch, parts):
                held = [unpacked(some.column(c), k, parts) for c, k in (("code", code_kind), ("upper", "<f4"), ("lower", "<f4"))] if moves else [None] * 3
                code, exact, high, low, scanned = assign(x, entries, *held, moves)
                count = np.zeros(len(x), np.int64)
                count[:1] = scanned  # of the whole block
                columns = [some.column("vec_id"), some.column("label"), packed(code, code_kind)]
                if last:
                    columns += [pa.array(exact.sum(1), pa.int64()), pa.array(count)]
                    yield pa.RecordBatch.from_arrays(columns, names=["vec_id", "label", "code", "error", "scanned"])
                else:
                    columns += [some.column("x"), packed(high, "<f4"), packed(low, "<f4"), pa.array(count)]
                    yield pa.RecordBatch.from_arrays(columns, names=["vec_id", "label", "code", "x", "upper", "lower", "scanned"])

    kind = rows.schema["label"].dataType.simpleString()
    rest = "error long" if last else "x binary, upper binary, lower binary"
    return rows.mapInArrow(each, f"vec_id long, label {kind}, code binary, {rest}, scanned long")


def updated(state: DataFrame, entries: np.ndarray) -> np.ndarray:
    """Entries after a round: floors of their parts' means, unused ones as they were."""
    parts, k, width = entries.shape
    code_kind = "u1" if k <= 256 else "<u2"

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, many = np.zeros((parts * k, width), np.int64), np.zeros(parts * k, np.int64)
        for batch in batches:
            for some, x in blocks_of(batch, parts):
                at = (unpacked(some.column("code"), code_kind, parts).astype(np.int64) + np.arange(parts) * k).ravel()
                np.add.at(sums, at, x.reshape(-1, width))
                many += np.bincount(at, minlength=parts * k)
        used = np.flatnonzero(many)
        yield pa.RecordBatch.from_arrays([pa.array(used, pa.int64()), pa.array(many[used]), pa.array(sums[used].tolist(), pa.list_(pa.int64()))], names=["at", "many", "sums"])

    partial = state.select("code", "x").mapInArrow(each, "at long, many long, sums array<long>")
    total = partial.groupBy("at").agg(F.sum("many").alias("many"), *[F.sum(F.get("sums", F.lit(w)).cast("decimal(38,0)")).alias(f"s{w}") for w in range(width)])
    after = entries.copy()
    for r in total.collect():  # one row for each entry in use
        after[r["at"] // k, r["at"] % k] = [int(r[f"s{w}"]) // int(r["many"]) for w in range(width)]
    return after


def compress(vectors: DataFrame, parts: int = 16, entries: int = 64, rounds: int = 2, scale: int = 256) -> tuple[DataFrame, Codebooks]:
    """(vec_id, label, code, error), stored, and the codebooks: code is a byte for each part (two if a codebook has over 256 entries)."""
    rows = stored(integers(vectors, scale), "integers")
    first = first_vectors(rows, entries)
    if not first:
        return rows.select("vec_id", "label", F.col("x").alias("code"), F.lit(0).cast("long").alias("error")), Codebooks(np.zeros((parts, 0, 0), np.int64), [])
    width, rest = divmod(len(first[0]), parts)
    if rest:
        raise ValueError(f"vectors of {len(first[0])} components have no {parts} equal parts")
    books = np.stack([x for x in first if len(x) == len(first[0])]).reshape(-1, parts, width).transpose(1, 0, 2).copy()
    state, moves, scanned, before = rows.where(F.col("n") == len(first[0])).select("vec_id", "label", "x"), None, [], rows
    for _ in range(rounds):
        state = stored(assigned(state, books, moves), "bounds")
        drop_stored(before)
        before, old, books = state, books, updated(state, books)
        scanned.append(state.agg(F.sum("scanned")).first()[0] or 0)
        moves = Moves.between(old, books)
    out = stored(assigned(state, books, moves, last=True), "codes")
    drop_stored(before)
    scanned.append(out.agg(F.sum("scanned")).first()[0] or 0)
    return out.drop("scanned"), Codebooks(books, scanned)


def decode(codes: DataFrame, books: Codebooks) -> DataFrame:
    """(vec_id, x): the integers that codes stand for."""
    entries, parts = books.entries, len(books.entries)
    code_kind = "u1" if entries.shape[1] <= 256 else "<u2"

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            code = unpacked(batch.column("code"), code_kind, parts).astype(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), pa.array(entries[np.arange(parts), code].reshape(len(code), -1).tolist(), pa.list_(pa.int64()))], names=["vec_id", "x"])

    return codes.select("vec_id", "code").mapInArrow(each, "vec_id long, x array<long>")


def with_label_errors(codes: DataFrame) -> DataFrame:
    """Adds label_error: the error of all rows of the label, nulls being one label."""
    sums = stored(codes.groupBy(F.col("label").alias("of")).agg(F.sum("error").alias("label_error")), "label_errors")
    few = sums.limit(LABELS + 1).count() <= LABELS
    return codes.join(F.broadcast(sums) if few else sums, F.col("label").eqNullSafe(F.col("of"))).drop("of")
