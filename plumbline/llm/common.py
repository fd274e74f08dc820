"""Shared helpers: tables in the cluster's shared folder, and the label split."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir. Where it is unset, a fresh one if Spark runs in this process alone, else an error."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        base = f"file://{tempfile.mkdtemp(prefix='plumbline_')}"
        spark.conf.set("spark.checkpoint.dir", base)
        spark.sparkContext.setCheckpointDir(base)
    return base


_written: list[str] = []
_tables: dict[str, str] = {}


def new_path(spark: SparkSession, name: str) -> str:
    _written.append(f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}")
    return _written[-1]


def delete(spark: SparkSession, folder: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def cleanup(spark: SparkSession) -> int:
    """Delete every intermediate table that this driver wrote; to be called once no result that reads them is needed."""
    gone = len(_written)
    while _written:
        path = _written.pop()
        if path in _tables:
            spark.sql(f"DROP TABLE IF EXISTS {_tables.pop(path)}")
        delete(spark, path)
    return gone


def stored(df: DataFrame, name: str, compression: str = "zstd") -> DataFrame:
    """Write ``df`` to the shared folder and read it back: lineage ends there."""
    path = new_path(df.sparkSession, name)
    df.write.option("compression", compression).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def stored_by(df: DataFrame, name: str, key: str) -> DataFrame:
    """``stored`` in buckets of ``key``, as many as there are shuffle partitions, so that grouping by it needs no shuffle."""
    spark = df.sparkSession
    path = new_path(spark, name)
    table = path.rpartition("/")[2].replace("-", "_")
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    df.write.option("path", path).option("compression", "zstd").bucketBy(buckets, key).saveAsTable(table)
    _tables[path] = table
    return spark.table(table)


def drop_stored(df: DataFrame) -> None:
    """Delete a table made by ``stored`` once nothing reads it any more."""
    for folder in {f.rpartition("/")[0] for f in df.inputFiles()}:
        delete(df.sparkSession, folder)
        _written[:] = [w for w in _written if not folder.endswith(w.rpartition("/")[2])]


def gather(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Places of all items of ranges, one range after the other."""
    ends = np.cumsum(lengths)
    return np.repeat(starts - (ends - lengths), lengths) + np.arange(ends[-1] if len(ends) else 0)


def give_back() -> None:
    """Return freed memory of a worker to the system; workers live on and would hold their largest task's."""
    import ctypes

    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def pack(*arrays: np.ndarray) -> bytes:
    """Arrays of unsigned integers by planes of bytes, compressed."""
    body = [len(arrays).to_bytes(4, "little")]
    for x in arrays:
        x = np.ascontiguousarray(x)
        body += [np.array([x.itemsize, len(x)], "<u8").tobytes(), x.view(np.uint8).reshape(-1, x.itemsize).T.tobytes()]
    whole = b"".join(body)
    return len(whole).to_bytes(8, "little") + pa.Codec("zstd", 3).compress(whole, asbytes=True)


def unpack(packed: pa.Buffer) -> list[np.ndarray]:
    whole = pa.Codec("zstd").decompress(packed[8:], int.from_bytes(memoryview(packed)[:8], "little"), asbytes=True)
    at, out = 4, []
    for _ in range(int.from_bytes(whole[:4], "little")):
        width, n = (int(x) for x in np.frombuffer(whole, "<u8", 2, at))
        out.append(np.frombuffer(whole, np.uint8, width * n, at + 16).reshape(width, n).T.copy().view(f"<u{width}").reshape(-1))
        at += 16 + width * n
    return out


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is evaluated once; expressions inside lambdas are not shared otherwise."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def scan(items: Column, zero: Column, step: Callable[[Column, Column], Column], shown: Callable[[Column, Column], Column], kind: str) -> Column:
    """``shown(state, item)`` of every item of an array in order, ``state`` being what ``step`` made of those before it.

    Spark's folds copy an array to add to it. Items are folded in blocks of about
    the root of their number, so n items cost copies of n * sqrt(n) places.
    """
    none = F.array().cast(f"array<{kind}>")

    def block(acc: Column, some: Column) -> Column:
        first = F.struct(acc["state"].alias("state"), none.alias("out"))
        done = F.aggregate(some, first, lambda a, x: F.struct(step(a["state"], x).alias("state"), F.concat(a["out"], F.array(shown(a["state"], x))).cast(f"array<{kind}>").alias("out")))
        return let(done, lambda r: F.struct(r["state"].alias("state"), F.concat(acc["out"], F.array(r["out"])).cast(f"array<array<{kind}>>").alias("out")))

    first = F.struct(zero.alias("state"), F.array().cast(f"array<array<{kind}>>").alias("out"))
    return let(items, lambda a: F.when(F.size(a) > 0, F.aggregate(blocks(a), first, block, lambda acc: F.flatten(acc["out"]))).otherwise(none))


def blocks(items: Column) -> Column:
    """A non-empty array cut into arrays of about the root of its length."""
    width = F.ceil(F.sqrt(F.size(items).cast("double"))).cast("int")
    return F.transform(F.sequence(F.lit(1), F.size(items), width), lambda at: F.slice(items, at, width))


def held_out() -> F.Column:
    """Rows kept from training: crc32 of the id as text, modulo 5, is 0."""
    return F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(5)) == 0


def training_sample(documents: DataFrame, labels: DataFrame, label: str, rows: int) -> DataFrame:
    """At most ``rows`` labelled training documents (doc_id, text, y), in order of a hash of the id.

    Conflicting labels of one id count as no label. The limit bounds what is
    fitted on, nothing else, and is the caller's documented parameter.
    """
    marked = (
        labels.where(F.col(label).isNotNull() & F.col("doc_id").isNotNull() & ~held_out())
        .groupBy("doc_id")
        .agg(F.min(label).alias("lo"), F.max(label).alias("y"))
        .where("lo = y")
        .orderBy(F.xxhash64("doc_id"), "doc_id")
        .limit(rows)
        .select("doc_id", F.col("y").cast("int").alias("y"))
    )
    texts = documents.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    return texts.join(F.broadcast(marked), "doc_id")


def kept_by(documents: DataFrame, keep: Callable[[list[str]], np.ndarray], chars: int = 1 << 21) -> DataFrame:
    """Rows of ``documents``, every column as it is, whose text ``keep`` marks true; null text counts as empty."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from plumbline.llm.tokens import chunks

        for batch in batches:
            texts = [t or "" for t in batch.column("text").to_pylist()]
            for a, b in chunks(texts, chars):
                yield batch.slice(a, b - a).filter(pa.array(keep(texts[a:b]), pa.bool_()))

    return documents.mapInArrow(each, documents.schema)
