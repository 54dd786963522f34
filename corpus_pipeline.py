"""A training corpus from raw documents: toxic texts out, copies out, near copies out, mixed
to target weights, packed into sequences.

Each stage takes (spark, docs, sf_dir) and works on all rows its predecessor kept; its result
is written as Parquet and read again as the next stage's docs. All but the last return the
columns of documents. Rows with null ids or texts, repeated rows and empty tables are
handled as each operator's module says.
"""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession

from tracklake.llm import exact_dedup, mixing, near_dedup, packing, shared, toxicity


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go."""
    return toxicity.drop_toxic(docs, toxicity.train(docs, shared.table(spark, sf_dir, "labels")))


def exact_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of equal texts stays."""
    return exact_dedup.drop_copies(docs)


#: Least Jaccard index of near copies, in hundredths: stages on word shingles take five words and 0.8 or more.
NEAR_PERCENT = 80


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near copies stays."""
    return near_dedup.drop_near_copies(docs, NEAR_PERCENT)


#: A document enters the corpus once, so copies that went before don't come back as epochs.
MIX = replace(mixing.RECIPE, max_epochs=1)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Leaves beyond their share of the budget are cut to a prefix of a seeded order."""
    return mixing.select_rows(docs, MIX).select(*docs.columns)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Where each piece of each document lies in the sequences."""
    return packing.pack(docs)


STAGES = [
    ("toxicity", toxicity_stage),
    ("exact_dedup", exact_stage),
    ("near_dedup", near_stage),
    ("mixing", mixing_stage),
    ("packing", packing_stage),
]

#: The classifier, the seeded order and the tokeniser can't be expressed in SQL; tests/llm
#: runs the stages against brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = shared.table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = shared.materialise(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
