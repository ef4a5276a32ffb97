"""From raw documents to packed token sequences, in four stages.

Each stage takes ``(spark, docs, sf_dir)`` with the documents its predecessor kept and returns documents again;
the last returns the packed pieces.  Stages work on their whole input.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from opinara.llm import mixing, near_dedup, packing, store, toxicity

#: Target weights of the sources (None: by their row counts), and the column of a document's place in the mixture.
WEIGHTS = None
TURN = "_turn"


def reject_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the compression-distance classifier does not predict toxic."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return toxicity.without_toxic(docs, toxicity.train_from(docs, labels))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document (the smallest id) of each group of near duplicates."""
    return near_dedup.deduplicated(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, in the order of the mixture."""
    return place_in_mixture(spark, docs, sf_dir).orderBy(TURN).drop(TURN)


def place_in_mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents with their place in the mixture: the order of rows does not outlive a table."""
    return mixing.with_slots(docs, WEIGHTS).select(*docs.columns, F.col("_position").alias(TURN))


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces with their sequence and offset, in the order of the mixture where documents have a place."""
    return packing.pack(docs, turn_col=TURN if TURN in docs.columns else None)


STAGES = [
    ("toxicity", reject_toxic),
    ("near_dedup", drop_near_duplicates),
    ("mixing", place_in_mixture),
    ("packing", pack_sequences),
]

#: Compression lengths, signatures and tokenizers are not SQL: tests compare run() with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of a folder; what a stage wrote for itself goes once its result is a table."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    before = len(store.held(spark))
    for name, stage in STAGES[:-1]:
        docs = store.materialise(stage(spark, docs, sf_dir), f"stage-{name}")
        store.drop_scratch(spark, keep=before, last=1)
    return STAGES[-1][1](spark, docs, sf_dir)
