"""The corpus pipeline: language ID, exact dedup, near-dedup, mixing, packing. Each stage works on all rows that its predecessor kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillstone.llm import exact_dedup as exact
from quillstone.llm import language_id as lid
from quillstone.llm import mixing, near_dedup, packing
from quillstone.llm.common import Scratch
from quillstone.llm.tokenizing import default_path

#: A text goes if no language has at least this share of its probability, or if it has no letter.
LEAST_SHARE = 0.5


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents whose language is determined, with all columns as they are. The model is fitted on a bounded sample of the rows with a lang."""
    found = lid.predict(docs, lid.fit(docs, default_path("piece_bpe_32k.model")))
    return found.filter((F.col("lang_pred") != lid.UNDETERMINED) & (F.col("score") >= LEAST_SHARE)).select("row.*")


def exact_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the smallest doc_id of equal texts."""
    return exact.exact_dedup(docs)


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group linked by a similarity of 0.8 or more on shingles of five words."""
    return near_dedup.near_dedup(docs, width=5, percent=80)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix: documents repeated or left out so that sources come near their target weights. Documents stay whole."""
    return mixing.mix_documents(docs)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces placed in sequences of 2048 tokens: doc_id, piece, start, length, ids_crc32, sequence_id, offset."""
    return packing.pack_documents(docs, default_path("word_bpe_49k.json"), 2048)


STAGES = [
    ("language_id", language_stage),
    ("exact_dedup", exact_stage),
    ("minhash_near_dedup", near_stage),
    ("mix_sources", mixing_stage),
    ("best_fit_packing", packing_stage),
]

#: Tokenising, sketches and fitted models can't be said in SQL; tests/llm compares the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, work = spark.read.parquet(f"{sf_dir}/documents.parquet"), Scratch(spark, "pipeline")
    for name, stage in STAGES[:-1]:
        docs = work.table(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
