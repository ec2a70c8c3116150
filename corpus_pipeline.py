"""From raw documents to packed token sequences, in five stages.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; run() writes every stage's
result as Parquet in the shared folder and hands the reader of it to the next.

In every stage an empty table gives an empty result, a text of any length is taken whole, and
columns of any other name pass through, up to the packing.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from scriptorium.llm.common import materialise, prepare
from scriptorium.llm.decontam import drop_contaminated
from scriptorium.llm.line_align import dedup_lines
from scriptorium.llm.near_copies import keep_one_of_each_group
from scriptorium.llm.packing import pack_documents
from scriptorium.llm.preference_quality import keep_good_documents


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the ranking rejects go.

    Null and empty texts are scored as texts without words. Rows are judged each by its own
    text, so repeated ones stand or fall together, as ties do. Without labels all stay.
    """
    prepare(spark)
    return keep_good_documents(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Aligned blocks of lines go from the later document; documents of nothing else go.

    Null and empty texts stay, rows without a doc_id do not change, and rows that share a
    doc_id are none the later one.
    """
    prepare(spark)
    return dedup_lines(docs, counted=False, keep_emptied=False)


def simhash_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies (five-word shingles, similarity 0.8 or more) the first document stays.

    SimHash groups come first, checked on whole shingle sets; the links that fingerprints
    cannot show are completed exactly. Texts without words are copies of each other; rows
    without a doc_id go if another row is a copy; of equal rows one stays.
    """
    prepare(spark)
    return keep_one_of_each_group(docs)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold benchmark passages go.

    Null and empty texts hold none and stay; each row is judged by its own text. Without
    benchmark items all stay.
    """
    prepare(spark)
    return drop_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces and their places in sequences of 2048.

    A null or empty text is its end id alone; repeated rows are packed each; pieces of equal
    length are placed in a fixed order.
    """
    prepare(spark)
    return pack_documents(docs, public_tokenizers.path("byte_bpe_50k.json"), end_id=0, capacity=2048)


STAGES = [
    ("quality_classifier", quality_classifier),
    ("line_dedup", line_dedup),
    ("simhash_dedup", simhash_dedup),
    ("benchmark_decontamination", benchmark_decontamination),
    ("best_fit_packing", best_fit_packing),
]

#: SQL cannot express the classifier, the fingerprints or the tokenizer.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents table."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = materialise(stage(spark, docs, sf_dir), name)
    return docs
