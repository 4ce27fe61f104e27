"""The corpus pipeline: classify, apply rules, drop near copies, cut repeats, pack.

Every stage takes (spark, docs, sf_dir) and works on all that the stage before
it kept. All but the last return the columns of ``documents``. Nulls, empty texts,
repeated rows and an empty table are handled as the operators state; columns
that ``documents`` does not have stay as they are, whatever their names.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from lacuna.functions import settle
from lacuna.llm import classifier, packing, rules, simhash, suffixes

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")

#: No SQL: the fitted scores and the packing cannot be stated in it. Tests hold the
#: stages against brute force.
ORACLE_SQL = None


def _beside(docs: DataFrame, work: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """``work`` with columns other than those of ``documents`` out of its way."""
    inner = [c if c in COLUMNS else f"beside_{i}" for i, c in enumerate(docs.columns)]
    return work(docs.toDF(*inner)).select(*inner).toDF(*docs.columns)


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier does not reject."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    learnt = classifier.training_labels(labels)
    return _beside(docs, lambda rows: classifier.classify(rows, learnt).filter("predicted = 1"))


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that keep the rules, without lines that many documents of their source share."""
    return _beside(docs, rules.clean)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies, that of the smallest doc_id."""
    return _beside(docs, simhash.one_of_each)


def suffix_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without long strings that stand anywhere else too."""
    return _beside(docs, suffixes.clean)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document's token pieces and their places in packed sequences."""
    tokenizer = public_tokenizers.path("word_bpe_49k.json")
    return packing.pack(packing.pieces(docs.select("doc_id", "text"), tokenizer))


STAGES = [
    ("quality classifier", quality_classifier),
    ("quality rules", quality_rules),
    ("SimHash near-dedup", near_dedup),
    ("suffix-array dedup", suffix_dedup),
    ("best-fit packing", packing_stage),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = settle(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
