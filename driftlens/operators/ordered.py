"""Neighbours, ranks and rates in the order of time of an account, without an account in one task.

A window by account puts all rows of a hot account into one task. Here an account's time is cut into spans: the window is
over (account, span), and what crosses a span's edge - its last row, its number of rows - is a row per span, which is small.

Defined results: equal instants are in the order of the further columns given. Rows with a null account are taken as one
account of their own; rows with a null instant are in a span of their own, before all others.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

HOUR = 3_600_000_000


def span_of(us: str, width: int = HOUR) -> Column:
    return F.floor(F.col(us) / F.lit(width))


def with_previous(rows: DataFrame, key: str, order: list[str], carried: list[str], out: str = "before", width: int = HOUR) -> DataFrame:
    """``rows`` with ``out``, a struct of ``carried`` of the row before; ``order`` begins with the instant in microseconds."""
    spanned = rows.withColumn("_span", span_of(order[0], width))
    within = Window.partitionBy(key, "_span").orderBy(*order)
    last = spanned.groupBy(key, "_span").agg(F.max(F.struct(*order, *[F.col(c).alias(f"_c{i}") for i, c in enumerate(carried)])).alias("_last"))
    of_before = F.lag("_last").over(Window.partitionBy(key).orderBy("_span"))  # a row per span
    edges = last.select(F.col(key).alias("_key"), F.col("_span").alias("_s"), of_before.alias("_edge")).where("_edge IS NOT NULL")
    edges = edges.select("_key", "_s", F.struct(*[F.col(f"_edge._c{i}").alias(c) for i, c in enumerate(carried)]).alias("_edge"))
    near = spanned.withColumn(out, F.lag(F.struct(*carried)).over(within))
    joined = near.join(edges, near[key].eqNullSafe(edges["_key"]) & near["_span"].eqNullSafe(edges["_s"]), "left")
    return joined.withColumn(out, F.coalesce(F.col(out), F.col("_edge"))).drop("_span", "_key", "_s", "_edge")


def with_rank(rows: DataFrame, key: str, order: list[str], width: int = HOUR) -> DataFrame:
    """``rows`` with ``i``, the place in the account's order from 1, and ``n``, the account's number of rows."""
    spanned = rows.withColumn("_span", span_of(order[0], width))
    counts = spanned.groupBy(key, "_span").agg(F.count(F.lit(1)).alias("_n"))
    all_ = Window.partitionBy(key)  # a row per span
    edges = counts.select(
        F.col(key).alias("_key"), F.col("_span").alias("_s"), F.sum("_n").over(all_).alias("n"), (F.sum("_n").over(all_.orderBy("_span")) - F.col("_n")).alias("_before")
    )
    placed = spanned.withColumn("_i", F.row_number().over(Window.partitionBy(key, "_span").orderBy(*order)))
    joined = placed.join(edges, placed[key].eqNullSafe(edges["_key"]) & placed["_span"].eqNullSafe(edges["_s"]))
    return joined.withColumn("i", F.col("_i") + F.col("_before")).drop("_span", "_key", "_s", "_i", "_before")


def with_recent(rows: DataFrame, key: str, us: str, seconds: int, out: str) -> DataFrame:
    """``rows`` with ``out``, the account's rows of the last ``seconds``, this one and both ends included.

    A row also stands in the span after its own, where it may be recent to others; spans are as long as the window.
    """
    width = seconds * 1_000_000
    both = rows.withColumn("_own", F.explode(F.array(F.lit(True), F.lit(False)))).withColumn("_span", span_of(us, width) + F.when(F.col("_own"), 0).otherwise(1))
    w = Window.partitionBy(key, "_span").orderBy(us).rangeBetween(-width, 0)
    return both.withColumn(out, F.count(F.lit(1)).over(w)).where("_own").drop("_own", "_span")
