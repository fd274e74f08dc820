"""Session settings and shipping of this package to the executors."""

from __future__ import annotations

import functools
import re
import tempfile
import uuid
import zipfile
from collections.abc import Callable
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

PACKAGE = Path(__file__).resolve().parent
_shipped: set[str] = set()


def local_session(name: str = "plumbline", cores: str = "*", partitions: int = 8, memory: str = "4g") -> SparkSession:
    """A UTC session on this machine, for tests and benchmarks."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(name)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .getOrCreate()
    )


def ship(spark: SparkSession) -> None:
    """Make the package importable in Python workers, once per application."""
    context = spark.sparkContext
    if context.applicationId in _shipped:
        return
    archive = Path(tempfile.mkdtemp(prefix="plumbline_")) / "plumbline.zip"
    with zipfile.ZipFile(archive, "w") as z:
        for source in sorted(PACKAGE.rglob("*.py")):
            z.write(source, Path(PACKAGE.name) / source.relative_to(PACKAGE))
    context.addPyFile(str(archive))
    _shipped.add(context.applicationId)


def shipping(query: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
    @functools.wraps(query)
    def run(spark: SparkSession, *args) -> DataFrame:
        ship(spark)
        return query(spark, *args)

    return run


_staged: list[str] = []


def staged(df: DataFrame, name: str) -> DataFrame:
    """``df`` written to the folder in spark.checkpoint.dir and read back: computed once, lineage ends there.

    Where the setting is unset, a fresh local folder if Spark is this process alone, else ValueError.
    """
    spark = df.sparkSession
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        base = f"file://{tempfile.mkdtemp(prefix='plumbline_')}"
        spark.conf.set("spark.checkpoint.dir", base)
    _staged.append(f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}")
    df.write.option("compression", "zstd").parquet(_staged[-1])
    return spark.read.schema(df.schema).parquet(_staged[-1])


def unstage(spark: SparkSession) -> int:
    """Delete what ``staged`` wrote; to be called once no result that reads it is needed."""
    gone = len(_staged)
    while _staged:
        path = spark._jvm.org.apache.hadoop.fs.Path(_staged.pop())
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
    return gone
