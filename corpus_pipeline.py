"""A corpus from documents to packed sequences: each stage takes all that the one before kept."""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from gridloom.llm.exact_dedup import drop_exact_duplicates
from gridloom.llm.mixing import mixed_copies
from gridloom.llm.near_dedup import drop_near_duplicates
from gridloom.llm.packing import pack_by_mixture
from gridloom.llm.quality_model import fit_quality, keep_good
from gridloom.llm.queries import tokenizer_path
from gridloom.plans.storage import collected, discard, staged

#: Rows of a batch that goes to a worker, unless the session has fewer: whole texts make Spark's 10,000 rows tens of MB, which
#: the JVM's allocator and the worker's both keep.
BATCH_ROWS = 1_000
_BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"

#: What the last stage has staged: by the next one's start its result is written, and these tables go.
_left: list[str] = []


def _stage(f: Callable) -> Callable:
    """A stage that first deletes what the one before has staged for itself, unless its own input still reads it."""

    @functools.wraps(f)
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        # stays set: the caller runs the plan that a stage returns
        if not 0 < int(spark.conf.get(_BATCH)) <= BATCH_ROWS:
            spark.conf.set(_BATCH, BATCH_ROWS)
        discard(spark, _left, docs)
        with collected(_left):
            return f(spark, docs, sf_dir)

    return run_stage



@_stage
def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts. Texts that are null or have no words score 0 and go."""
    return keep_good(docs, fit_quality(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


@_stage
def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts."""
    return drop_exact_duplicates(docs)


@_stage
def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near duplicates."""
    return drop_near_duplicates(docs)


@_stage
def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it: not at all, once or twice."""
    return mixed_copies(docs)


@_stage
def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents in sequences of 2048 ids."""
    return pack_by_mixture(docs, tokenizer_path())


STAGES = [("quality", keep_quality), ("exact dedup", drop_copies), ("near dedup", drop_near_copies), ("mix", mix), ("pack", pack)]

#: No stage but exact dedup can be put in SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            with collected(_left):
                docs = staged(docs, f"stage{k}")
    return docs
