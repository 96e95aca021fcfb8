"""The registered queries ``opN_*``: each applies one operator with production parameters to whole tables."""
from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import ensure_checkpoint_dir
from . import bpe, decontaminate, dedup, exact, language, licenses, oracle, periodic, quality, secrets, selection, substring, tokens, toxicity


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ensure_checkpoint_dir(spark)
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = substring.remove_repeats(_table(spark, sf_dir, "documents")).drop("kept")
    return found.withColumn("has_repeat", F.col("n_removed") > 0)


def op2_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contaminated(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op3_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers as P
    return bpe.bpe_digests(_table(spark, sf_dir, "documents"), P.path("byte_bpe_50k.tiktoken"), P.PATTERN)


def op4_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup.near_duplicates(_table(spark, sf_dir, "documents"))


def op5_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.license_scan(_table(spark, sf_dir, "documents"))


def op6_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.secret_digest(_table(spark, sf_dir, "documents"))


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality_rules(_table(spark, sf_dir, "documents"))


def op8_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers as P
    return tokens.token_files(_table(spark, sf_dir, "documents"), P.path("word_bpe_49k.json"), end_id=2)


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    model = language.fit(docs.filter(~language.held_out()))
    return language.languages(docs, model).withColumn("held_out", language.held_out())


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = _table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels")
    model = toxicity.fit(docs, labels.filter(~toxicity.held_out()))
    return toxicity.toxicity_scores(docs, model).withColumn("held_out", toxicity.held_out())


def op11_importance_resample(spark: SparkSession, sf_dir: str) -> DataFrame:
    drawn = selection.resampled(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))
    return drawn.select("doc_id", "n_features", "weight", "score", "rank")


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return periodic.run_digests(periodic.periodic_runs(periodic.with_planted_runs(_table(spark, sf_dir, "documents"))))


def op13_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Half of the documents, by a hash of the id, are the history; the others come as a batch."""
    return exact.exact_duplicates(_table(spark, sf_dir, "documents"), F.pmod(F.xxhash64("id"), F.lit(2)) == 0)


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline
    ensure_checkpoint_dir(spark)
    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (
        op1_substring_dedup, op2_decontaminate, op3_byte_bpe, op4_minhash_dedup, op5_license_scan, op6_secret_scan,
        op7_quality_rules, op8_token_files, op9_language_id, op10_toxicity, op11_importance_resample,
        op12_periodic_runs, op13_exact_dedup, pipeline)}


def oracle_sql() -> dict[str, str]:
    return oracle.ORACLE_SQL
