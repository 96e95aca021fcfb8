"""A training-corpus pipeline from the operators of ``cohortlab.llm``.

``STAGES`` is applied in order to ``documents``; every stage's result is written as Parquet to the shared
folder and read again as the next one's input. Each stage works on all that its predecessor kept:

1. toxicity           documents that the clause grammar rejects go
2. near_duplicates    one document (the smallest doc_id) of each component stays; documents whose sets of 5-word
                      shingles are 0.8 or more similar are linked (op4_minhash_dedup alone links at 0.85)
3. decontamination    documents that hold a benchmark item go
4. secrets            found secrets are replaced by ``[SECRET:kind]`` in the text; every document stays
5. byte_bpe           texts become token ids; the last stage returns (doc_id, n_tokens, ids, digests)

Null and empty texts pass all stages; rows with the same doc_id share the verdict of stage 2. A document without a
doc_id goes if its component has one with an id; else one text of the component stays, once. Stage 3 searches items
without an item_id too. An empty table passes through as an empty one.
"""
from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from cohortlab.llm import bpe, decontaminate, dedup, secrets, toxicity
from cohortlab.llm.common import saved

#: The rows need tokenising, clause grammars and edit distances: not expressible in SQL, tested by brute force.
ORACLE_SQL = None

#: The columns of documents; further columns of the input pass through as well.
COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


#: Stage 2 links at 0.8; the 13 bands of 3 miss such a pair with probability 9e-5.
NEAR = dedup.Params(numerator=80)


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    labels = _table(spark, sf_dir, "labels")
    model = toxicity.fit(docs, labels.filter(~toxicity.held_out()))
    return toxicity.keep_clean(docs, model)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return dedup.drop_near_duplicates(docs, NEAR)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.drop_contaminated(docs, _table(spark, sf_dir, "benchmark"))


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return secrets.mask_secrets(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    import public_tokenizers as P
    return bpe.bpe_digests(docs, P.path("byte_bpe_50k.tiktoken"), P.PATTERN, with_ids=True)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", drop_toxic), ("near_duplicates", drop_near_duplicates), ("decontamination", drop_contaminated),
    ("secrets", mask_secrets), ("byte_bpe", encode)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = saved(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
