"""Embedding vectors: decayed and recency-weighted centroids, cosine.

A centroid is a weighted sum, with the weight of each vector known from its rank in the user's order, so
sums combine before the shuffle and no user's vectors meet in one row or task. Vectors with a null or another length than the first of their group are left out by the caller.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from driftlens.operators.ordered import with_rank


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity within [-1, 1]; 0 where either vector has no length, null where either is null."""
    n = norm(a) * norm(b)
    return F.when(n == 0, 0.0).otherwise(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), dot(a, b) / F.when(n == 0, 1.0).otherwise(n))))


def normalised(a: Column) -> Column:
    n = norm(a)
    return F.when(n == 0, a).otherwise(F.transform(a, lambda x: x / n))


def weighted_sum(rows: DataFrame, group: str, vector: str, weight: str) -> DataFrame:
    """``(group, centroid)``: the sum of weight times vector, by dimension."""
    parts = rows.select(group, weight, F.posexplode(vector).alias("dim", "x"))
    sums = parts.groupBy(group, "dim").agg(F.sum(F.col(weight) * F.col("x").cast("double")).alias("x"))
    return sums.groupBy(group).agg(F.transform(F.array_sort(F.collect_list(F.struct("dim", "x"))), lambda e: e["x"]).alias("centroid"))


def ranked(rows: DataFrame, group: str, order: str, width: int = 1 << 16) -> DataFrame:
    """``i``, the place in the group's order, and ``n``, its size. A numeric order is cut into spans, so that no group has to fit into one task."""
    if dict(rows.dtypes)[order] in ("bigint", "int", "smallint", "tinyint"):
        return with_rank(rows, group, [order], width)
    w = Window.partitionBy(group)
    return rows.withColumn("i", F.row_number().over(w.orderBy(order))).withColumn("n", F.count(F.lit(1)).over(w))


def decayed(rows: DataFrame, group: str, vector: str, decay: float) -> DataFrame:
    """The decayed mean c = decay * c + (1 - decay) * x of ranked rows, started with the first vector, at unit length."""
    weight = F.when(F.col("i") == 1, F.pow(F.lit(decay), F.col("n") - 1)).otherwise((1 - decay) * F.pow(F.lit(decay), F.col("n") - F.col("i")))
    return weighted_sum(rows.withColumn("w", weight), group, vector, "w").withColumn("centroid", normalised(F.col("centroid")))


def ema_centroid(rows: DataFrame, group: str, order: str, vector: str, decay: float = 0.95) -> DataFrame:
    """``decayed``, in the order of a column."""
    return decayed(ranked(rows, group, order), group, vector, decay)


def mean_centroid(parts: Column) -> Column:
    """The mean of an array of vectors at unit length: the centroid of a profile that has topics but no history. Null without vectors."""
    total = F.aggregate(F.slice(parts, 2, F.greatest(F.size(parts) - 1, F.lit(0))), parts[0], lambda a, v: F.zip_with(a, v, lambda x, y: x + y))
    return F.when(F.size(parts) > 0, normalised(total))


def recency_weight() -> Column:
    """exp of -1 for the oldest to 0 for the newest; needs ``i`` and ``n``."""
    return F.exp(F.when(F.col("n") == 1, -1.0).otherwise(-1 + (F.col("i") - 1) / (F.col("n") - 1)))


def recency_centroid(rows: DataFrame, group: str, order: str, vector: str) -> DataFrame:
    """The mean weighted by recency, at unit length."""
    return weighted_sum(ranked(rows, group, order).withColumn("w", recency_weight()), group, vector, "w").withColumn("centroid", normalised(F.col("centroid")))
