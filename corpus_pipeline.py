"""The corpus pipeline: documents to token ids, five stages of which each works on all that the one before it kept.

1. language: documents without a letter, or in which no language has half of the text, go.
2. quality: documents below the threshold of the ranking learned from ``labels`` go.
3. near_duplicates: of each group linked by five-word shingles at a similarity of 0.8 one document stays, the one with the smallest id.
4. decontamination: documents that contain an item of ``benchmark`` go.
5. pieces: token ids of each document, with the digests of ids and decoded text.

All stages but the last return the columns of ``documents`` unchanged. Null texts and texts without letters go in the first stage; null ids
are ids; repeated rows are copies of which the third stage keeps one; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rfmlens.llm import decontam, langid, neardup, pieces, quality
from rfmlens.llm.common import cut_lineage, shared_code

#: Smallest share of the main language.
MAIN_SHARE = 0.5


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Languages are learned from all texts with a known one."""
    told = langid.identify(docs, langid.learn(docs, F.lit(True)), out="__language")
    return told.where((F.col("__language.lang") != langid.UND) & (F.col("__language.score") >= MAIN_SHARE)).select(*docs.columns)


def good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The ranking is learned outside of the fold that ``op5_quality`` holds out."""
    model = quality.learn(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), quality.fold(F.col("doc_id"), 4) != 2)
    return quality.score_quality(docs, model, out="__score").where(F.col("__score") >= quality.CUT).select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return neardup.one_of_each(docs, size=5)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontam.drop_leaks(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 and ids."""
    return pieces.code_documents(docs, pieces.model_bytes(), more=("ids",))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language", language),
    ("quality", good),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("pieces", token_ids),
]

#: The language and quality stages can't be expressed in SQL.
ORACLE_SQL = None


@shared_code
def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on ``documents``; each result but the last is written to the shared folder and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = cut_lineage(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
