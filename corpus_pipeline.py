"""A corpus pipeline of five of the training-data operators; each stage's rows are the next stage's documents."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession

from parlance.llm import langid, mixing, packing, secrets, simhash, similar
from parlance.llm._common import WRITTEN, discard, read_table, shared_dir
from parlance.llm.queries import vocabulary

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]
#: Tables that the last stage's result reads; it has been written when the next stage begins, which removes them.
_LEFT: list[str] = []


def tidy(stage: Stage) -> Stage:
    """The stage, after removing what the one before has left; its documents come from a written table."""

    @wraps(stage)
    def run_tidily(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        discard(spark, _LEFT)
        _LEFT.clear()
        first = len(WRITTEN)
        out = stage(spark, docs, sf_dir)
        if stage.__name__ != "pack_sequences":  # the last result stays whole
            _LEFT.extend(WRITTEN[first:])
        return out

    return run_tidily


@tidy
def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is told with confidence; those that the models reject go."""
    return langid.accepted_only(docs)


@tidy
def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: five-word shingles, similarity 0.8 or more."""
    return simhash.keep_one(docs, similar.near_copies)


@tidy
def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with what looks like a secret replaced by a mark."""
    return secrets.redacted(docs)


@tidy
def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as its source's target takes it."""
    return mixing.sampled(docs)


@tidy
def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents in sequences of at most 1,024 tokens."""
    return packing.pack_documents(docs, vocabulary("byte_bpe_50k.json"))


STAGES = [
    ("language_id", identify_language),
    ("simhash_dedup", drop_near_duplicates),
    ("secret_scan", redact_secrets),
    ("source_mix", mix_sources),
    ("sequence_packing", pack_sequences),
]

#: The first stage's models and the last one's vocabulary are beyond SQL; tests hold run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written as Parquet in the shared folder and read again by the next."""
    docs, before = read_table(spark, sf_dir, "documents"), []
    for k, (name, stage) in enumerate(STAGES):
        out = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            path = f"{shared_dir(spark)}/parlance-{name}-{uuid.uuid4().hex}"
            out.write.parquet(path)
            docs = spark.read.schema(out.schema).parquet(path)
            discard(spark, before)
            before = [path]
    return out
