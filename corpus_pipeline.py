"""From raw documents to token ids: five stages, each over all that the one before kept.

Language ID drops documents in no known language, the quality chain those
that score below its threshold, near-dedup all but the first of each group,
decontamination those that repeat benchmark items; the last stage adds the
token ids. Each stage is written as Parquet in the shared folder and read
again, so a lost executor costs one stage's tasks at most.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandline.llm import decontam, langid, neardup, pieces, quality, shared


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return langid.accepted(docs)


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    labels = shared.table(spark, sf_dir, "labels")
    return quality.good_documents(docs, labels, held_out=shared.crc_mod(F.col("doc_id"), 4) == 2)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return neardup.deduplicated(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    marked = decontam.decontaminated(docs, shared.table(spark, sf_dir, "benchmark"))
    return shared.without(docs, marked.where("contaminated").select("doc_id", "text_hash"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pieces.encoded(docs)


STAGES = [
    ("language_id", language),
    ("quality", good_quality),
    ("near_dedup", near_dedup),
    ("decontamination", decontaminate),
    ("sentencepiece", encode),
]

#: No SQL: three of the stages are models or encoders.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents that all stages keep, with piece_ids and lossless."""
    docs = shared.table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = shared.written(stage(spark, docs, sf_dir), name)
    return docs
