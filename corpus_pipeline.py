"""The corpus pipeline: five stages, each written as Parquet and read again as the next one's input.

Every stage takes rows whose doc_id repeats or is null as documents of their own, whole texts of
any length, further columns of any names, and an empty table, of which it makes an empty one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from gridweft.llm.common import scratch_path, table
from gridweft.llm.exact import without_copies
from gridweft.llm.mixing import DEFAULT_WEIGHT, WEIGHTS, mixed, placed
from gridweft.llm.near import without_near_copies
from gridweft.llm.pieces import encode_documents
from gridweft.llm.quality import learned, score


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the positive-unlabelled classifier accepts; null and empty texts are scored too."""
    return score(docs, learned(docs, table(spark, sf_dir, "labels")), keep=True)


def exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts, that of the smallest doc_id; null counts as empty."""
    return without_copies(docs)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates: five-word shingles, similarity 0.8 or more.

    Texts without words are near nothing and stay.
    """
    return without_near_copies(docs)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, files and rows in the order in which the weighted sources take turns."""
    return mixed(docs, WEIGHTS, DEFAULT_WEIGHT)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Piece ids of each document's best segmentation, the scores of the best few, its place in the mixture.

    Files are read in no order, so the places (mix_slot, mix_position) are worked out again: they
    depend on the rows alone, which are those that the mixture had.
    """
    return encode_documents(placed(docs, WEIGHTS, DEFAULT_WEIGHT), ids=True, keep=("mix_slot", "mix_position"))


STAGES = [
    ("quality classifier", quality),
    ("exact dedup", exact_copies),
    ("MinHash near-dedup", near_copies),
    ("mixing sources to target weights", mixture),
    ("SentencePiece encoding and decoding", encode),
]

#: SQL expresses neither the classifier nor the segmentation; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = scratch_path(spark, "stage")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
