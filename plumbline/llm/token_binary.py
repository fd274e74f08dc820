"""Token ids as binary files: static rANS segments behind one frequency table.

``write`` encodes whole texts by the tokenizers library, appends the end id to
each document and writes segments in ascending doc_id order; ``read`` decodes
them in parallel. The files are Parquet tables in one folder: ``table`` holds the
slots of every id, ``segments`` one row a segment with the binary segment of
``rans``, the part and place that order it, and the ids and lengths of its
documents. Counts for the table cover all documents; texts are tokenised once.

Parts are ranges of doc_id with bounds from approximate quantiles, so that no
data are sampled twice; a segment holds whole documents of about ``segment``
tokens, and a longer document alone.

Defined cases: null text is empty and gives the end id alone; rows of equal
doc_id stand in the order of their compressed ids; rows with null doc_id come first; an empty table gives an
empty file; further columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from plumbline.llm import tokens
from plumbline.llm.common import drop_stored, stored
from plumbline.llm.rans import Coder, frequencies
from plumbline.llm.textstats import ids_of


def tokenized(documents: DataFrame, vocabulary: str, bounds: list[int]) -> DataFrame:
    """doc_id, part, ids (packed unsigned 16-bit ids with the end id); and from each task one row of part -1 with its counts of ids."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = tokens.encoder(vocabulary).encode
        end = np.array([tokens.END], dtype="<u2").tobytes()
        total = np.zeros(1 << 16, dtype="<i8")

        def rows(doc_ids: pa.Array, part: np.ndarray, ids: list[bytes]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([doc_ids, pa.array(part, pa.int32()), pa.array(ids, pa.binary())], names=["doc_id", "part", "ids"])

        for batch in batches:
            texts, doc_ids = batch.column("text").to_pylist(), batch.column("doc_id")
            place = np.searchsorted(bounds, doc_ids.fill_null(0).to_numpy(zero_copy_only=False)) * doc_ids.is_valid().to_numpy(zero_copy_only=False)
            for a, b in tokens.chunks(texts):
                ids = [x + end for x in encode(texts[a:b])]
                total += np.bincount(np.frombuffer(b"".join(ids), "<u2"), minlength=1 << 16)
                yield rows(doc_ids[a:b], place[a:b], [packed(x) for x in ids])
        yield rows(pa.nulls(1, pa.int64()), np.array([-1]), [packed(total.tobytes())])

    return documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text")).mapInArrow(each, "doc_id long, part int, ids binary")


def packed(data: bytes) -> bytes:
    return len(data).to_bytes(4, "little") + pa.Codec("zstd", 1).compress(data, asbytes=True)


def unpacked(data: bytes, kind: str) -> np.ndarray:
    return np.frombuffer(pa.Codec("zstd").decompress(data[4:], int.from_bytes(data[:4], "little"), asbytes=True), kind)


def token_counts(ids: DataFrame) -> np.ndarray:
    """How often each of 65,536 ids occurs, from the tasks' counts."""

    def each(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros(1 << 16, dtype=np.int64)
        for batch in batches:
            for x in batch["ids"]:
                total += unpacked(x, "<i8")
        seen = np.flatnonzero(total)
        yield pd.DataFrame({"id": seen, "n": total[seen]})

    counts = np.zeros(1 << 16, dtype=np.int64)
    for row in ids.where("part = -1").select("ids").mapInPandas(each, "id int, n long").groupBy("id").agg(F.sum("n").alias("n")).collect():
        counts[row.id] = row.n
    return counts


def write(documents: DataFrame, path: str, vocabulary: str, segment: int = 1 << 20, lanes: int = 4096, block: int = 1 << 19) -> None:
    spark = documents.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    cuts = [i / parts for i in range(1, parts)]
    bounds = documents.agg(F.percentile_approx(F.col("doc_id").cast("long"), cuts, 10_000).alias("b")).first()["b"] if cuts else []
    ids = stored(tokenized(documents, vocabulary, sorted(bounds or [])), "ids", "none")
    slots = frequencies(token_counts(ids))
    spark.createDataFrame([(slots.astype("<u4").tobytes(),)], "slots binary").coalesce(1).write.parquet(f"{path}/table")

    def each(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        coder = Coder(slots, lanes, block)
        held: list[tuple[int | None, np.ndarray]] = []
        size = place = part = 0

        def flush() -> pd.DataFrame:
            body = coder.encode(np.concatenate([x for _, x in held]))
            docs = [None if i is None else int(i) for i, _ in held]
            return pd.DataFrame({"part": [part], "segment": [place], "tokens": [size], "doc_ids": [docs], "lengths": [[len(x) for _, x in held]], "data": [body]})

        for batch in batches:
            doc_ids = ids_of(batch["doc_id"])
            for i, p, x in zip(doc_ids, batch["part"], batch["ids"], strict=True):
                ids = unpacked(x, "<u2").astype(np.uint32)
                if held and (p != part or size + len(ids) > segment):
                    yield flush()
                    place, held, size = place + 1, [], 0
                part = int(p)
                held.append((None if i is pd.NA else i, ids))
                size += len(ids)
        if held:
            yield flush()

    (
        ids.where("part >= 0").repartitionById(parts, F.col("part"))
        .sortWithinPartitions("part", F.asc_nulls_first("doc_id"), "ids")
        .withColumn("doc_id", F.col("doc_id").cast("string"))
        .mapInPandas(each, "part int, segment int, tokens long, doc_ids array<long>, lengths array<long>, data binary")
        .write.option("compression", "none")
        .parquet(f"{path}/segments")
    )
    drop_stored(ids)


def read(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start, n_tokens, ids (array of int) of every document."""
    return _decoded(spark, path, "ids array<int>", lambda ids: ids.astype(np.int32))


def read_digests(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document."""
    return _decoded(spark, path, "ids_crc32 long", lambda ids: zlib.crc32(np.ascontiguousarray(ids, "<u4")))


def _decoded(spark: SparkSession, path: str, column: str, of) -> DataFrame:
    found = spark.read.parquet(f"{path}/segments")
    # tokens before each part: one row a part, as many as the writer had partitions
    before, starts = 0, []
    for row in found.groupBy("part").agg(F.sum("tokens").alias("n")).orderBy("part").collect():
        starts.append((row.part, before))
        before += row.n
    within = Window.partitionBy("part").orderBy("segment").rowsBetween(Window.unboundedPreceding, -1)
    places = found.select("part", "segment", F.coalesce(F.sum("tokens").over(within), F.lit(0)).alias("ahead"))
    places = places.join(F.broadcast(spark.createDataFrame(starts, "part int, base long")), "part")
    name = column.split()[0]
    slots = np.frombuffer(spark.read.parquet(f"{path}/table").first()["slots"], "<u4")

    def each(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        coder = Coder(slots)
        for batch in batches:
            for row in batch.itertuples(index=False):
                ids, lengths = coder.decode(row.data), np.asarray(row.lengths)
                ends = np.cumsum(lengths)
                shown = [of(ids[e - n : e]) for e, n in zip(ends, lengths, strict=True)]
                docs = pd.array([None if pd.isna(i) else int(i) for i in row.doc_ids], dtype="Int64")
                yield pd.DataFrame({"part": row.part, "segment": row.segment, "doc_id": docs, "within": ends - lengths, "n_tokens": lengths, name: shown})

    rows = found.select("part", "segment", "doc_ids", "lengths", "data").mapInPandas(each, f"part int, segment int, doc_id long, within long, n_tokens long, {column}")
    # a place row for each segment: about a millionth of the tokens, joined by sort or broadcast as Spark sees its size
    return rows.join(places, ["part", "segment"]).select("doc_id", (F.col("base") + F.col("ahead") + F.col("within")).alias("start"), "n_tokens", name)
