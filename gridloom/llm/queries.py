"""The queries of this package: one for each operator, over its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import sql
from .common import staged_path
from .exact_dedup import exact_duplicates
from .language_id import language_id
from .license_texts import DIGESTS, TEXTS
from .licenses import known_licenses, scan_licenses
from .mixing import mix_to_weights
from .near_dedup import near_duplicates
from .packing import pack_by_mixture
from .preference import preference_pairs
from .quality_model import quality_classifier
from .quality_rules import quality_rules
from .token_files import token_digests, write_token_files


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer_path() -> str:
    """The public tokenizer that the queries use; the operators take any path."""
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op1_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_to_weights(_table(spark, sf_dir, "documents"))


def op2_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = staged_path(spark, "tokens")
    write_token_files(_table(spark, sf_dir, "documents"), path, tokenizer_path(), end_id=2)
    return token_digests(spark, path)


def op3_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(_table(spark, sf_dir, "documents"))


def op4_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_licenses(_table(spark, sf_dir, "documents"), known_licenses(spark, TEXTS, DIGESTS))


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules(_table(spark, sf_dir, "documents"))


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_by_mixture(_table(spark, sf_dir, "documents"), tokenizer_path(), window=2048, end_id=1)


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id(_table(spark, sf_dir, "documents"))


def op8_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_classifier(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op9_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_duplicates(_table(spark, sf_dir, "documents"))


def op10_preference_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations 2k (chosen) and 2k + 1 (rejected) are a pair; spans are written as text."""
    turns = _table(spark, sf_dir, "conversations").select(F.shiftright("conv_id", 1).cast("long").alias("pair_id"), (F.col("conv_id") % 2).alias("odd"), "turn", "role", "text")
    pairs = preference_pairs(turns.filter("odd = 0 OR odd IS NULL"), turns.filter("odd <> 0"))
    spans = F.array_join(F.transform("spans", lambda s: F.concat_ws("-", s["from"], s["to"])), ",")
    return pairs.select("pair_id", "segment", "chunk", F.col("n_turns").cast("long").alias("n_turns"), "text", spans.alias("loss_spans"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: f for name, f in globals().items() if name.startswith("op") and callable(f)}


def oracle_sql() -> dict[str, str]:
    return sql.ORACLES
