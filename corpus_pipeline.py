"""The corpus pipeline: documents that stay are not toxic, exist once, have no near copy, and follow the target mix;
what comes out is their token ids' digests.

Each stage takes (spark, docs, sf_dir) and returns a frame that is written and read again as the next one's docs.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from tessera.llm import bpe, exact_dedup, mixing, ngram_join, toxicity
from tessera.llm._common import settle
from tessera.session import lean

#: Near copies: five-word shingles, a Jaccard similarity of 80 / 100 or more.
WIDTH, NUM, DEN = 5, 80, 100
#: Smaller batches and fewer words encoded ahead than by default: executors have done other stages before.
BPE_BATCH, BPE_AHEAD = 6 << 20, 50_000


def not_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier doesn't reject; it is fitted to the labels table.

    A null or empty text has the bias's score; without labels of both classes all stay, or none if all labels are 1.
    Rows that repeat an id are each judged. All stages: an empty table stays empty, other columns are carried along.
    """
    return toxicity.drop_toxic(docs, lean(spark).read.parquet(f"{sf_dir}/labels.parquet"))


def one_of_equal(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts (without white space; null counts as empty) the longest original, then the least doc_id, null last;
    of rows that tie in all of these one."""
    lean(spark)
    return exact_dedup.drop_copies(docs)


def one_of_similar(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each class of linked documents that with the least doc_id. Texts without words and null ids link with nothing
    and stay; rows that repeat an id stay or go together."""
    lean(spark)
    return ngram_join.one_of_each_class(docs, width=WIDTH, num=NUM, den=DEN)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A sample whose tokens follow the raked margins; null languages and sources are levels of their own, a null or empty
    text counts as one token, and rows that repeat an id stay or go together."""
    lean(spark)
    return mixing.mix_sources(docs)


def tokenized(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, and digests of the ids and of the text decoded from them, one row for each row; a null or empty
    text has no ids."""
    lean(spark)
    ranks = bpe.load_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken"))
    return bpe.digests(docs, ranks, public_tokenizers.PATTERN, size=BPE_BATCH, ahead=BPE_AHEAD)


STAGES = [("toxicity", not_toxic), ("exact_dedup", one_of_equal), ("ngram_join", one_of_similar), ("mix_sources", mixed), ("byte_bpe", tokenized)]

#: The classifier can't be written in SQL; tests compare with a plain Python version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = settle(docs, name)
    return docs
