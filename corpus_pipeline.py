"""A training corpus from documents: quality, repeated lines, near copies, source mix, tokens.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the
last keep the columns of documents. ``run`` writes what a stage returns into
the shared folder and reads it back as the next one's docs.

Defined results: a null or empty text is scored as one empty line; where it
stays it links with nothing and, without words, the mix never takes it. Rows
with a null doc_id are scored, keep their lines, link with nothing and are
mixed like any other; a null source is a source of its own. Of rows that
repeat doc_id and text one stays; rows of one doc_id with different texts are
judged one by one. Very long texts go through all stages whole. Extra columns,
also those with names that operators use, are kept up to the last stage. An
empty table gives no rows.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from loomspan.llm import bpe, linededup, mixing, ngramjoin, quality
from loomspan.llm.q_bpe import RANKS
from loomspan.llm.q_quality import production_model
from loomspan.llm.scratch import Scratch


def drop_low_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the line classifier takes to be good."""
    return quality.keep_good(docs, production_model(spark, docs, sf_dir))


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that a smaller doc_id holds go; the documents stay."""
    return linededup.deduplicate_lines(docs)


def keep_one_of_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents linked by five-word runs at a similarity of 0.8, the smallest doc_id stays."""
    return ngramjoin.keep_one(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as their source's share takes them, in training order."""
    return mixing.mix_documents(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document."""
    return bpe.encode_documents(docs, public_tokenizers.path(RANKS), public_tokenizers.PATTERN)


STAGES = [
    ("quality classifier", drop_low_quality),
    ("line dedup", drop_repeated_lines),
    ("n-gram jaccard join", keep_one_of_near_copies),
    ("source mix", mix_sources),
    ("byte-level bpe", encode),
]

#: The classifier is fitted, and texts are compared by hashes and encoded: not for SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents."""
    scratch = Scratch(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (_, stage) in enumerate(STAGES):
        docs = scratch.keep(stage(spark, docs, sf_dir), f"stage{i}")
        if i:
            scratch.drop(f"stage{i - 1}")
    return docs
