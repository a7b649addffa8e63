"""A corpus pipeline: quality, near-duplicates, mixture, tokens.

Each stage takes (spark, docs, sf_dir) and works on every row its predecessor
kept; ``run`` writes each result as Parquet in the shared folder and reads it
back as the next stage's input.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import covering_simhash, mixing, tree_bpe, zstd_quality
from tessera.llm.common import fresh, materialise, table
from tessera.llm.queries import GOOD, TARGETS, WORD_BPE, domain_of_labels, quality_model


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the documents whose quality score is at least 0.7.

    Where the labels teach nothing, as they are all of one class or none has a
    text here, no document can be told from another, and all are kept.
    """
    model = quality_model(docs, table(spark, sf_dir, "labels"))
    if model.dictionaries is None:
        return docs
    (name,) = fresh(docs, "_quality")
    return zstd_quality.score(docs, model, name=name).filter(F.col(name) >= GOOD).select(*[F.col(f"`{c}`") for c in docs.columns])


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document with the smallest id of each SimHash component."""
    return covering_simhash.keep_one(docs)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeats or leaves out documents so that domains get their target weights."""
    classifier = mixing.fit(docs, table(spark, sf_dir, "labels"), domain_of_labels())
    prefix = fresh(docs, "_mix_tokens", "_mix_posterior", "_mix_rate")[0].removesuffix("tokens")
    mixed, _ = mixing.mix(docs, classifier, TARGETS, prefix=prefix)
    return mixing.resample(mixed, f"{prefix}rate").select(*[F.col(f"`{c}`") for c in docs.columns])


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Encodes and decodes every text: number of ids and both digests."""
    return tree_bpe.round_trip_digests(docs, public_tokenizers.path(WORD_BPE))


STAGES = [("quality", quality), ("near_duplicates", near_duplicates), ("mixture", mixture), ("tokens", tokens)]

#: Compression, SimHash and BPE are beyond SQL; tests hold each stage against a plain version of it.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialise(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
