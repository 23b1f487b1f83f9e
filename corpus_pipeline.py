"""The corpus pipeline: documents are filtered, de-duplicated, masked, mixed and encoded.

Every stage takes (spark, docs, sf_dir) and works on all that its predecessor kept. All but the last
return the columns of ``documents``; the last returns doc_id, n_tokens, ids and the decoded text.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from vistaset.llm import bpe, jaccard, mixing, pii, quality
from vistaset.llm.common import forget, ship, table, written

#: Words of a shingle, and the least similarity of near copies in per cent.
SHINGLE_WORDS, SHINGLE_PERCENT = 5, 80


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier rejects go."""
    ship(spark)
    stats = written(quality.statistics_table(docs), "statistics")
    model = quality.train(stats, table(spark, sf_dir, "labels"))
    forget(stats)
    return quality.keep_good(docs, model)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of linked documents stays, that of the smallest id."""
    ship(spark)
    return jaccard.keep_first(docs, SHINGLE_WORDS, SHINGLE_PERCENT)


def mask_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data is replaced by its kind in brackets."""
    ship(spark)
    return pii.redact(docs, pii.train(docs))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in the numbers, and to the words, that the mix takes."""
    return mixing.taken_documents(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids and the text that they decode to."""
    ship(spark)
    return bpe.encode(docs, public_tokenizers.path("byte_bpe_50k.json"), columns="ids")


STAGES = [
    ("quality classifier", keep_quality),
    ("n-gram Jaccard join", drop_near_copies),
    ("PII", mask_personal_data),
    ("mixing sources to target weights", mix_sources),
    ("BPE encoding and decoding", encode),
]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        before, docs = docs, stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = written(docs, "stage")
            forget(before)
    return docs
