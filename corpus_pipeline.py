"""From documents to token ids: quality rules, near-duplicates, secrets, mixing, byte-level BPE.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame. All but the last return the columns of documents; the last
one returns each kept document's id, source and digests of its token ids. Empty tables go through all stages; further columns are
kept up to the last one, whatever their names."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.llm import bpe, mixing, neardup, quality, secrets
from quillon.llm.common import cut, cuts, drop_cuts


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that fail the base rules go (under 50 words, null and empty texts among them, or mostly repeats), and all of a host (source;
    null is one) most of whose documents fail. Very long texts are measured whole; repeated rows count and stay as often as they stand there."""
    return quality.good_documents(docs)


def keep_distinct(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates the document with the smallest id stays (null ids last), once where its row is repeated. Null texts stay;
    empty texts are copies of each other; very long texts are compared whole."""
    return neardup.distinct_documents(docs)


def redact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are replaced by their kind and n_chars, if there, is counted anew; every document stays, null and empty texts as they are."""
    out = secrets.redact_secrets(docs)
    return out.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else out


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents are left out or repeated so that each source (null is one) comes near its target; rows of one id, and all of
    null ids within a source, are taken together. Null and empty texts have size 0."""
    return mixing.mix(docs)


def tokenise(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document's number of token ids, and digests of the ids and of the bytes decoded from them; null texts count as
    empty, and repeated rows give repeated results."""
    ranks = bpe.read_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken"))
    return bpe.digests(docs.select("doc_id", "source", "text"), ranks, public_tokenizers.PATTERN)


STAGES = [
    ("quality rules", keep_good),
    ("near-duplicates", keep_distinct),
    ("secrets", redact),
    ("mixing", mix),
    ("byte-level BPE", tokenise),
]
#: SQL can't express the near-duplicate and token stages.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    since = cuts()
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = cut(docs)
            drop_cuts(since, 1)  # what led to this table
    return docs
