"""A training corpus from raw documents: quality, near copies, personal data, mix, tokens.

Each stage takes (spark, docs, sf_dir) and gives a DataFrame that is written as Parquet and read as the next stage's docs.
Part of the subpackage pointloom.llm; this file goes when that goes.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pointloom.llm.bpe import encode_texts
from pointloom.llm.jaccard import drop_similar
from pointloom.llm.mixing import repeat_rows
from pointloom.llm.pii import mask_pii
from pointloom.llm.quality import keep_good
from pointloom.llm.scratch import Scratch

#: Near copies share at least this much of their sets of five-word shingles.
WORDS, PERCENT = 5, 80


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier scores 0.5 or more."""
    return keep_good(docs)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of documents linked by likeness one, with the smallest id; a text without words is no copy.

    Rows that repeat an id and a text are copies of each other; rows that repeat only an id are not.
    """
    return drop_similar(docs, width=WORDS, num=PERCENT, den=100)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, spans of personal data replaced by their kind."""
    return mask_pii(docs).withColumn("n_chars", F.length("text").cast("long"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of sources takes them."""
    return repeat_rows(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Ids of every text, and what they decode to."""
    return encode_texts(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [("quality", quality), ("near copies", near_copies), ("personal data", personal_data), ("mix", mix), ("tokens", tokens)]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents."""
    scratch = Scratch(spark)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = scratch.save(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
