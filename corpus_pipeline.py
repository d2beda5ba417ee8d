"""From raw documents to packed training sequences, in stages.

Toxic and low-quality documents go, then exact and near copies; what is left is cut
into sequences. Each stage gets what the one before has kept.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from trackframe.llm.common import read, stored, text_of
from trackframe.llm.exact import drop_exact_duplicates
from trackframe.llm.neardup import keep_one_of_each
from trackframe.llm.packing import pack_documents
from trackframe.llm.quality import quality_model
from trackframe.llm.quality import score_column as quality_score
from trackframe.llm.toxicity import score_column as toxicity_score
from trackframe.llm.toxicity import toxicity_model

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]

#: Documents of this toxicity or more go.
TOXIC = 0.7
#: Documents below this quality go.
POOR = 0.5


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are not toxic. Null and empty texts stay."""
    model = toxicity_model(docs, read(spark, sf_dir, "labels"))
    return docs.filter(toxicity_score(text_of(), model) < TOXIC)


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of good quality. Without labels to learn from all stay."""
    model = quality_model(docs, read(spark, sf_dir, "labels"))
    return docs.filter(quality_score(text_of(), model) >= POOR)


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the document with the largest id; a null text is empty."""
    return drop_exact_duplicates(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each class of near copies the document with the smallest id."""
    return keep_one_of_each(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents in sequences of 4096 tokens."""
    return pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES: list[tuple[str, Stage]] = [
    ("toxicity", toxicity),
    ("quality", quality),
    ("exact_dedup", exact_dedup),
    ("near_dedup", near_dedup),
    ("packing", packing),
]

#: Trained scores and signatures have no SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each is written and read again."""
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
