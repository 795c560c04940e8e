"""Registered queries of this subpackage: thin digests of the operators' results."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import nearest, shards, spelling, sql, tandem, warc
from .decontam import contaminated
from .language import languages
from .neardup import similar_classes
from .packing import packed
from .quality import quality
from .repeats import without_repeats
from .tokencount import token_counts
from .toxicity import toxicity


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op7_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return similar_classes(_table(spark, sf_dir, "documents"), shingle=3, percent=85)


def op10_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = without_repeats(_table(spark, sf_dir, "documents"))
    return done.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))


def op2_toxicity_nnpu(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"), threshold=0.7)


def op8_quality_fourier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"), threshold=0.5)


def op4_decontamination_lsi(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = contaminated(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "item_id", "common_words", "item_words")


def vocabulary_path(name: str = "byte_bpe_50k.json") -> str:
    return public_tokenizers.path(name)


def op5_packing_dp(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packed(_table(spark, sf_dir, "documents"), vocabulary_path(), size=1024, with_ids=False)


def op1_rendezvous_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shards.sharded(_table(spark, sf_dir, "documents"), [1.0] * 16)


def op3_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.archived(_table(spark, sf_dir, "pages"))


def op6_block_matrix_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest.nearest(_table(spark, sf_dir, "embeddings"), every=20, k=20)


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(_table(spark, sf_dir, "documents"), vocabulary_path("piece_bpe_32k.model"))


def op11_string_kernel_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return languages(_table(spark, sf_dir, "documents"))


def op12_spelling_halves(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.variants(_table(spark, sf_dir, "documents"))


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tandem.periodic_runs(_table(spark, sf_dir, "documents")).drop("runs")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_rendezvous_shards": op1_rendezvous_shards,
    "op2_toxicity_nnpu": op2_toxicity_nnpu,
    "op8_quality_fourier": op8_quality_fourier,
    "op3_warc": op3_warc,
    "op4_decontamination_lsi": op4_decontamination_lsi,
    "op5_packing_dp": op5_packing_dp,
    "op6_block_matrix_ann": op6_block_matrix_ann,
    "op9_token_counts": op9_token_counts,
    "op7_minhash_dedup": op7_minhash_dedup,
    "op10_substring_dedup": op10_substring_dedup,
    "op11_string_kernel_language": op11_string_kernel_language,
    "op12_spelling_halves": op12_spelling_halves,
    "op13_periodic_runs": op13_periodic_runs,
}

ORACLE: dict[str, str] = {
    "op1_rendezvous_shards": shards.oracle(16),
    "op3_warc": warc.ORACLE,
    "op6_block_matrix_ann": nearest.ORACLE,
    "op12_spelling_halves": spelling.oracle(sql.CRC_TABLES, sql.CRC),
    "op13_periodic_runs": tandem.oracle(sql.CRC_TABLES, sql.CRC),
}
