"""From raw documents to packed sequences: five stages, each a function of (spark, docs, sf_dir).

Every stage is written as Parquet in the shared folder and read back before the
next, so a lost executor never costs more than the stage that runs.

For all stages but the last: an empty table gives an empty one; columns beside
doc_id, text and n_chars stay as they are, whatever their names; repeated rows get
one decision and stay as often as they came.  The classifier decides by text; line
dedup by (doc_id, text); the next two by doc_id, so rows that share an id go
together, and rows without one stay.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from kmerweave.llm import decontaminate, jaccard, line_dedup, packing, quality
from kmerweave.llm._shared import staged, table


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go.

    Null and empty texts have the score of the labelled sample's share of good ones;
    without labels all stay.  Texts of any length are scored whole; equal texts have
    equal scores, so ties go together.
    """
    return quality.keep_good(docs, table(spark, sf_dir, "labels"))


def line_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Later copies of repeated line runs are deleted; documents that hold nothing else go.

    Null, empty and blank texts stay as they are.  Of equal runs the one of the smallest
    doc_id, then of the first line, stays.
    """
    return line_dedup.dedup_lines(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates (five words, similarity 0.8) the smallest id stays.

    Texts without words link with nothing, so null and empty ones stay; a text of
    fewer than five words is one shingle.
    """
    return jaccard.keep_one(docs, words=5, percent=80)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a window of a benchmark item go.

    Null texts and texts without words stay; an item of fewer than ten words is one
    window, an item without words none.
    """
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents and their places in sequences.

    A null text is an empty one, which is its end token alone; repeated rows are packed
    each; ties between pieces of one length need no rule; an empty table has no pieces.
    """
    return packing.pack(docs)


STAGES = [
    ("quality classifier", quality_classifier),
    ("line dedup", line_dedup_stage),
    ("n-gram Jaccard join", near_duplicates),
    ("benchmark decontamination", benchmark_decontamination),
    ("best-fit packing", best_fit_packing),
]

#: The classifier and the tokenizer can't be written in SQL; tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = staged(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
