"""Corpus pipeline: toxicity, near-duplicates, benchmark decontamination, SentencePiece.

Each stage takes (spark, docs, sf_dir) and works on all that the stage before it kept. All
but the last return the columns of ``documents``; the last one the kept documents' ids.
Every stage is written as Parquet in the shared folder and read again.

Defined results: null, empty and blank texts are not toxic, near-duplicates of nothing and hold no passage, so they
stay, with no pieces; a row without id stays, linked with nothing; repeated rows share their fate, and all rows of a kept id stay;
columns that a stage does not use pass through, whatever their names; without documents there are no
rows; without labels (or labels of one kind) no document is toxic; without benchmark items none is contaminated.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from wayfold.llm import decontaminate, near_dups, pieces, toxicity
from wayfold.llm.common import materialize, table


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier does not reject."""
    return toxicity.clean(docs, toxicity.fit_on(docs, table(spark, sf_dir, "labels")))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates."""
    return near_dups.keep_one(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark passage."""
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """``doc_id, n_pieces, ids, round_trip`` of each document."""
    return pieces.round_trip(docs, pieces.load(pieces.model_file()))


STAGES = [("toxicity", drop_toxic), ("near_duplicates", drop_near_duplicates), ("decontamination", drop_contaminated), ("sentencepiece", encode)]

#: A trained classifier, approximate candidates, alignment and a tokenizer: no stage is SQL; tests hold each to a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in order, from ``documents``."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
