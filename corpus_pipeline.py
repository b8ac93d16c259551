"""The corpus pipeline: each stage calls one operator on all that the stage before it kept.

1. ``quality``: documents that the quality classifier rejects go;
2. ``language``: so do those whose language is not known;
3. ``near_dedup``: one document of each group of near duplicates stays;
4. ``decontaminate``: documents that share a passage with the benchmark go;
5. ``mix``: the rest is mixed to target weights: rows of the mixed stream.

A stage takes and returns documents with all their columns (the last one returns
the stream), handles nulls, empty tables and repeated rows as its operator says,
and learns from ``labels`` and ``benchmark`` in ``sf_dir``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from viewlark.llm import op2_language_id, op4_mixing, op6_quality, op7_near_dedup, op8_decontamination
from viewlark.llm.common import fold_of, materialise, table


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return op6_quality.keep(docs, table(spark, sf_dir, "labels"))


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return op2_language_id.keep(docs, op2_language_id.fit(docs, fold_of(F.col("doc_id"), 5) == 0))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return op7_near_dedup.dedup(docs, shingle=5, percent=80)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return op8_decontamination.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return op4_mixing.mix(docs)


STAGES = [
    ("quality", quality),
    ("language", language),
    ("near_dedup", near_dedup),
    ("decontaminate", decontaminate),
    ("mix", mix),
]

#: Two stages' models are learned, which SQL cannot express.  Tests hold each stage against a plain loop over its input: the models' scores text by
#: text, all pairs of shingle sets, the SQL of decontamination and of mixing on what the stage was given.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
