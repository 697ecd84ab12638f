"""The corpus pipeline: quality rules, line dedup, near-duplicate removal, mixing, tokens.

Each stage takes (spark, docs, sf_dir) and works on all that its predecessor kept; run() writes what
each returns to the shared folder and reads it back for the next. All but the last return the columns
of documents.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pyrocast.llm import bpe, jaccard_join, line_dedup, mixing, quality
from pyrocast.llm.common import saved

VOCABULARY = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rules or the classifier reject go; null and empty texts fail the base rules.

    Rows that are equal in id and text have one verdict; all columns of docs stay as they are, whatever their names. Without labels of
    both kinds the base rules alone decide. An empty table stays empty.
    """
    return quality.keep(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that a document of smaller id holds go; n_chars, if there is such a column, follows the text.

    Null texts are one empty line and stay; other columns stay as they are, whatever their names. An empty table stays empty.
    """
    out = line_dedup.drop_lines(docs)
    return out.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else out


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of near copies the smallest id stays, with all its rows and columns.

    Texts without words and rows without an id are copies of nothing and stay. An empty table stays empty.
    """
    return jaccard_join.keep_one(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them, with all their columns; texts without words aren't taken.

    A null source is a source; rows of one source with one id are taken alike. An empty table stays empty.
    """
    return mixing.mixed(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each document, with digests of them and of what they decode to; null and empty texts have none.

    A row for each row of docs, repeated ones too; columns other than id and text are not read. An empty table gives an empty one.
    """
    return bpe.round_trip(docs, bpe.read_ranks(VOCABULARY), public_tokenizers.PATTERN, with_ids=True)


STAGES = [
    ("quality_rules", quality_rules),
    ("line_dedup", dedup_lines),
    ("ngram_jaccard_join", drop_near_copies),
    ("mixing", mix_sources),
    ("byte_bpe", encode),
]

#: The classifier of the first stage isn't expressible in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = saved(stage(spark, docs, sf_dir), name)
    return docs
