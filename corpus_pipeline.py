"""A training-data pipeline: toxicity, line dedup, near-dedup, decontamination, BPE.

In every stage null ids and texts are rows like others, very long texts are taken whole, ties go by
id and then by content, rows alike share one decision, an empty table gives an empty table, and
extra columns pass, whatever their names. What a stage does with such rows beyond that is said there.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from corpuscle.llm import bpe, decontaminate, linededup, simhash, toxicity
from corpuscle.llm.common import materialize
from corpuscle.session import bounded, shipped


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier chain rejects go; it learns from the labels of sf_dir.

    Null and empty texts have no evidence against them; without usable labels all documents stay.
    """
    return toxicity.keep_clean(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Later copies of line runs of 50 words or more are deleted; documents left without a line go.

    Null and empty texts have no lines to lose and stay. Rows alike in id and text are one document.
    """
    return linededup.keep_remaining(docs)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates the first document stays. Near: a Jaccard of 0.8 on shingles of five words, or two bits.

    Null and empty texts are one group. The first has the least id, null before all, then the least content
    key; of rows alike one stays.
    """
    return simhash.keep_one(docs, shingle=5, similarity=0.8)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with passages of the benchmark go.

    Null and empty texts have none; an empty benchmark, or items under eight letters, digits and spaces, match nothing.
    """
    return decontaminate.keep_clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256, ids; null and empty texts have no ids. Extra columns end here."""
    return bpe.encode_decode(docs, decoded=False)


STAGES = [
    ("toxicity", shipped(bounded(drop_toxic))),
    ("line_dedup", shipped(bounded(drop_repeated_lines))),
    ("simhash_near_dedup", shipped(bounded(drop_near_duplicates))),
    ("decontamination", shipped(bounded(drop_contaminated))),
    ("bpe", shipped(bounded(encode))),
]

#: A trained classifier, near-duplicate groups and BPE are beyond SQL; tests hold the stages to brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of sf_dir; each is written and read again by the next."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
