"""Exports, backups and the hash-chained ledger."""

from __future__ import annotations

import hashlib
import json

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from plumbline.functions.text import csv_cell


def export_csv(df: DataFrame, path: str) -> None:
    """CSV with a header; text cells are guarded against formulas."""
    guarded = [csv_cell(F.col(c)).alias(c) if t == "string" else F.col(c) for c, t in df.dtypes]
    df.select(*guarded).write.option("header", True).mode("errorifexists").csv(path)


def export_json(df: DataFrame, path: str) -> None:
    df.write.mode("errorifexists").json(path)


def backup(df: DataFrame, path: str) -> int:
    """Copy a table and compare the counts; the number of rows."""
    df.write.mode("errorifexists").parquet(path)
    before, after = df.count(), df.sparkSession.read.parquet(path).count()
    if before != after:
        raise RuntimeError(f"backup has {after} rows of {before}")
    return after


def canonical(record: dict) -> str:
    return json.dumps(record, sort_keys=True, separators=(",", ":"), ensure_ascii=False)


def chained(records: list[dict], seq: int = 0, prev: str = "") -> list[dict]:
    """Ledger lines of a run's own records: seq, prev, record and hash. Appending is for one writer, so it is not distributed."""
    lines = []
    for record in records:
        seq += 1
        text = canonical(record)
        digest = hashlib.sha256(f"{seq}\n{prev}\n{text}".encode()).hexdigest()
        lines.append({"seq": seq, "prev": prev, "record": text, "hash": digest})
        prev = digest
    return lines


def verify_chain(ledger: DataFrame) -> DataFrame:
    """Ledger lines that break the chain, with the reason; column ``ledger`` names the chain."""
    order = Window.partitionBy("ledger").orderBy("seq")
    before = F.coalesce(F.lag("hash").over(order), F.lit(""))
    own = F.sha2(F.concat_ws("\n", F.col("seq").cast("string"), "prev", "record"), 256)
    reason = F.when(F.col("seq") != F.row_number().over(order), "sequence").when(F.col("prev") != before, "previous").when(F.col("hash") != own, "hash")
    return ledger.withColumn("reason", reason).where("reason IS NOT NULL").select("ledger", "seq", "reason")
