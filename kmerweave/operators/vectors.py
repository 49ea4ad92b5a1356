"""Vectors of one length: standardising and principal components."""

from __future__ import annotations

from pyspark.ml.feature import PCA
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _usable(df: DataFrame, vector: str) -> DataFrame:
    """Rows whose vector has finite components only; null vectors and others go."""
    v = F.col(vector).cast("array<double>")
    return df.where(F.coalesce(F.size(v) > 0, F.lit(False)) & F.forall(v, lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) < float("inf")), F.lit(False)))).withColumn(vector, v)


def standardised(df: DataFrame, vector: str) -> DataFrame:
    """The rows with every component less its mean, over its (population) deviation; constant components become 0.

    The means are one row of two arrays, the length of a vector.
    """
    good = _usable(df, vector)
    each = good.select(F.posexplode(vector).alias("i", "x")).groupBy("i").agg(F.avg("x").alias("m"), F.stddev_pop("x").alias("s"))
    stats = each.agg(F.sort_array(F.collect_list(F.struct("i", "m", "s"))).alias("_stats"))
    z = F.zip_with(vector, "_stats", lambda x, t: F.when(t.s > 0, (x - t.m) / t.s).otherwise(F.lit(0.0)))
    return good.crossJoin(F.broadcast(stats)).withColumn(vector, z).drop("_stats")  # one row


def principal_components(df: DataFrame, key: str, vector: str, k: int) -> tuple[DataFrame, list[float]]:
    """key, scores on the first ``k`` components of standardised vectors, and the share of variance of each.

    Only the covariances, the square of a vector's length, come to the driver.
    """
    rows = standardised(df, vector).select(key, array_to_vector(vector).alias("_v")).persist()
    model = PCA(k=k, inputCol="_v", outputCol="_pc").fit(rows)
    out = model.transform(rows).select(key, vector_to_array("_pc").alias("scores"))
    rows.unpersist()
    return out, list(model.explainedVariance)
