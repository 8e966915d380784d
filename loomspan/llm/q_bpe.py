"""Query op7: every text of documents, encoded and decoded."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from .bpe import encode_documents

RANKS = "byte_bpe_multi_50k.tiktoken"


def op7_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    done = encode_documents(docs, public_tokenizers.path(RANKS), public_tokenizers.PATTERN, with_ids=False)
    return done.select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256")


QUERIES = {"op7_byte_bpe": op7_byte_bpe}
SQL: dict[str, str] = {}
