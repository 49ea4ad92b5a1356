"""Bounded samples of labelled rows for the trained operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


#: Parts in which the rows of one label are ranked before the rank of all.
SALT = 64


def first_of(rows: DataFrame, label: str, bound: int) -> DataFrame:
    """The first ``bound`` rows of each label by a hash of doc_id.  Parts of a label are ranked first, so no task ranks more than ``SALT * bound`` rows of it at last."""
    by = [F.xxhash64("doc_id"), F.col("doc_id")]
    part = Window.partitionBy(label, F.pmod(F.xxhash64("doc_id", F.lit(1)), F.lit(SALT))).orderBy(*by)
    some = rows.withColumn("_rank", F.row_number().over(part)).where(F.col("_rank") <= bound)
    return some.withColumn("_rank", F.row_number().over(Window.partitionBy(label).orderBy(*by))).where(F.col("_rank") <= bound).drop("_rank")


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, outside_fold: Column, bound: int) -> list:
    """Rows (label, text) of documents labelled 0 or 1 for which ``outside_fold`` holds: at most ``bound`` of each label, in hash order.

    ``bound`` is the documented limit on what a classifier is trained on.  A
    document with several labels or a null one is left out, a repeated document
    counts once.
    """
    one = labels.where(F.col(label).isNotNull()).groupBy(F.col("doc_id").alias("doc_id")).agg(F.min(label).alias("label"), F.max(label).alias("other")).where("label = other and label in (0, 1)").drop("other")
    chosen = one.where(outside_fold)
    ids = first_of(chosen.select("label", "doc_id"), "label", bound)
    # 2 * bound ids at most, so they are broadcast and no text is shuffled but the sample's
    texts = docs.select("doc_id", "text").where("text is not null").join(F.broadcast(ids), "doc_id").groupBy("doc_id").agg(F.min("label").alias("label"), F.min("text").alias("text"))
    return sorted(texts.select("label", "text", "doc_id").collect(), key=lambda r: str(r.doc_id))
