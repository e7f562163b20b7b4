"""From raw documents to token files: five stages, each on what the one before kept.

A stage's result is written and read again before the next stage, so that the tables a stage wrote on its way are
superseded when the next one begins, and deleted then.
"""

from __future__ import annotations

import functools
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.llm import decontaminate, jaccard_join, language_id, mixing, rans
from weftline.llm.common import cut, documents, drop, shared_dir, written
from weftline.llm.queries import tokenizer_path

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]
_superseded: list[str] = []


def stage(run: Stage) -> Stage:
    """Deletes the tables of the stage before, but not those of a last stage, as its result is still to be read."""

    @functools.wraps(run)
    def clean(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        drop(spark, _superseded)
        _superseded.clear()
        with written() as paths:
            out = run(spark, docs, sf_dir)
        if run.__name__ != STAGES[-1][1].__name__:
            _superseded.extend(paths)
        return out

    return clean


@stage
def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language can't be told go."""
    return language_id.with_language(docs, language_id.learn(docs, F.lit(True)))


@stage
def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays, the one with the smallest id."""
    return jaccard_join.first_of_each(docs)


@stage
def drop_benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a test item go."""
    return decontaminate.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


@stage
def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it, in training order."""
    return mixing.mix(docs)


@stage
def write_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token files; returned is what is read back from them: doc_id, start, n_tokens, ids_crc32."""
    path = f"{shared_dir(spark)}/rans-{uuid.uuid4().hex}"
    rans.write(docs, path, tokenizer_path())
    return rans.read(spark, path, with_ids=False)


STAGES = [
    ("language_id", identify_language),
    ("jaccard_join", drop_near_copies),
    ("decontaminate", drop_benchmark_leaks),
    ("mixing", mix_sources),
    ("rans", write_tokens),
]
#: Hypervectors, BM25 and the tokenizer are beyond SQL; tests hold stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, read = documents(spark, sf_dir), []
    for name, each in STAGES[:-1]:
        with written() as paths:
            docs = cut(each(spark, docs, sf_dir), name)
        drop(spark, read)
        read = paths[-1:]
    return STAGES[-1][1](spark, docs, sf_dir)
