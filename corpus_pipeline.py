"""The training-data pipeline over ``documents``.

Language identification, one document of each group of near copies, mixing the sources, byte-level BPE.
Every stage takes (spark, docs, sf_dir) and returns a DataFrame; :func:`run` writes it to the shared
folder and reads it again as the next stage's documents, so a lost executor costs at most one stage's
tasks. All but the last stage return the columns of ``documents``.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from gaugeworks.llm import jaccard_join, language, merge_replay, mixing
from gaugeworks.session import checkpoint_root, prepare


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is recognised; junk without a language goes."""
    found = language.detect(docs, language.learn(docs), margin=language.MARGIN)
    return found.where("accepted").select(*docs.columns)


def near_copies_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, the smallest id, of each group linked by five-word shingles at a Jaccard similarity
    of 0.8 or more."""
    return jaccard_join.one_per_component(docs, width=5, percent=80)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The sources at their weights within the tokens there are: a row for each copy of a document, in the
    order of the mix."""
    return mixing.written_in_order(mixing.mix_sources(docs)).select(*docs.columns)


def encoding_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document of the mix."""
    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    return merge_replay.encode_texts(docs, path).select("doc_id", "lang", "source", "ids")


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language", language_stage),
    ("near_copies", near_copies_stage),
    ("mixing", mixing_stage),
    ("encoding", encoding_stage),
]

#: SQL has neither zstandard's sizes nor the merges of a vocabulary.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows over ``documents``."""
    root = f"{checkpoint_root(prepare(spark))}/pipeline-{uuid.uuid4().hex}"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{root}/{k}-{name}")
        docs = spark.read.parquet(f"{root}/{k}-{name}")
    return docs
