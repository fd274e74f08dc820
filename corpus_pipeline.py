"""Five stages from raw documents to packed sequences.

Quality, toxicity, near-duplicates and personal data act on whole texts and
return the columns of documents; packing returns its sequences. Each stage reads
its predecessor's rows from Parquet. The
classifiers are trained on the labelled rows of the whole documents table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.llm import near_copies, packing, pii, quality_crf, toxicity_gbt
from plumbline.llm.common import stored
from plumbline.llm.queries import table, vocabulary

def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier does not reject."""
    field = quality_crf.train(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return quality_crf.filtered(docs, field)


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity classifier does not reject."""
    model = toxicity_gbt.train(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return toxicity_gbt.filtered(docs, model)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of least id of every group of near copies: five-word shingles, Jaccard 0.8 or more."""
    return near_copies.deduplicated(docs)


def hide_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, personal data replaced by its kind."""
    return pii.redacted(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents and their places in sequences of 2048 tokens."""
    return packing.pack(docs, vocabulary("byte_bpe_50k.json"))


STAGES = [
    ("quality_classifier", keep_good),
    ("toxicity", drop_toxic),
    ("simhash_near_dedup", drop_near_duplicates),
    ("pii", hide_personal_data),
    ("best_fit_packing", pack_sequences),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
