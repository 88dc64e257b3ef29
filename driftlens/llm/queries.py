"""Queries on training data by name."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from driftlens.llm import abuse, leaks, mixing, pii, residue, splits
from driftlens.plans.events import key_sql
from driftlens.sources.tables import table, tables
from driftlens.storage import cut


def p1_found(spark: SparkSession, folder: str) -> DataFrame:
    return abuse.p1_found(table(spark, folder, "messages"))


def p1_scores(spark: SparkSession, folder: str) -> DataFrame:
    return abuse.p1_scores(table(spark, folder, "messages"))


def p1_rates(spark: SparkSession, folder: str) -> DataFrame:
    return abuse.p1_rates(table(spark, folder, "messages"))


def p3_found(spark: SparkSession, folder: str) -> DataFrame:
    return splits.p3_found(table(spark, folder, "messages"))


def p3_splits(spark: SparkSession, folder: str) -> DataFrame:
    """Rows and spellings of each split."""
    return (
        splits.assign_splits(*tables(spark, folder, "messages", "split_targets"))
        .groupBy("split_name")
        .agg(F.count(F.lit(1)).alias("n_rows"), F.count_distinct("user_id").alias("n_spellings"))
    )


def p3_classes(spark: SparkSession, folder: str) -> DataFrame:
    """One row per spelling: its component, known by its smallest spelling, and how many spellings the component has."""
    found = cut(splits.spelling_components(table(spark, folder, "messages")), "spellings")
    sizes = found.groupBy("component").agg(F.min("user_id").alias("class_id"), F.count(F.lit(1)).alias("n_spellings"))
    return found.join(sizes, "component").select("user_id", "class_id", "n_spellings")


def p3_invariants(spark: SparkSession, folder: str) -> DataFrame:
    """Rows in all splits, rows without a split, accounts, and accounts that are in more than one split."""
    messages, targets = tables(spark, folder, "messages", "split_targets")
    placed = cut(splits.assign_splits(messages, targets).select("message_id", "user_id", "split_name"), "placed")
    per = placed.join(splits.spelling_components(messages), "user_id").groupBy("component").agg(F.count_distinct("split_name").alias("n"))
    totals = placed.agg(F.count(F.lit(1)).alias("n_rows"), F.count_if(F.col("split_name").isNull()).alias("n_without"))
    return totals.crossJoin(per.agg(F.count_if(F.col("n") > 1).alias("n_torn"), F.count(F.lit(1)).alias("n_accounts")))  # a row each


def p5_found(spark: SparkSession, folder: str) -> DataFrame:
    return pii.p5_found(*tables(spark, folder, "messages", "message_records"))


def p5_sanitised(spark: SparkSession, folder: str) -> DataFrame:
    """Messages and message records with their personal information replaced."""
    return pii.sanitised(*tables(spark, folder, "messages", "message_records"))


def p6_found(spark: SparkSession, folder: str) -> DataFrame:
    return leaks.p6_found(*tables(spark, folder, "documents", "eval_items"))


def p7_shares(spark: SparkSession, folder: str) -> DataFrame:
    """The shares that the mixture reaches."""
    documents, targets = tables(spark, folder, "documents", "mix_targets")
    return mixing.shares(mixing.mixture(documents, targets), targets)


def p7_mixture(spark: SparkSession, folder: str) -> DataFrame:
    return mixing.mixture(*tables(spark, folder, "documents", "mix_targets"))


def p7_invariants(spark: SparkSession, folder: str) -> DataFrame:
    """By source: documents that are more often in the mixture than they may be, or twice in the list, and whether the share is met as nearly as whole documents allow.

    A source may miss its tokens by half of its largest document, and all sources' misses move the total.
    """
    documents, targets = tables(spark, folder, "documents", "mix_targets")
    mixed = cut(mixing.mixture(documents, targets), "mixed")
    largest = mixing.with_tokens(documents.select("source", "text")).groupBy("source").agg(F.max("_tokens").alias("largest"))
    over = mixed.join(targets.groupBy("source").agg(F.max("max_repeats").alias("cap")), "source").groupBy("source").agg(F.count_if(F.col("copies") > F.col("cap")).alias("n_over"), (F.count(F.lit(1)) - F.count_distinct("doc_id")).alias("n_twice"))
    all_ = Window.partitionBy(F.lit(0))  # a row per listed source
    got = mixing.shares(mixed, targets).join(largest, "source").where("n_tokens > 0")
    wanted = F.col("target_share") / F.sum("target_share").over(all_)
    room = (F.col("largest") + wanted * F.sum("largest").over(all_)) / 2
    met = F.abs(F.col("n_tokens") - wanted * F.sum("n_tokens").over(all_)) <= room + 1
    return got.withColumn("met", met).join(over, "source").select("source", "n_over", "n_twice", "met")


def p8_found(spark: SparkSession, folder: str) -> DataFrame:
    return residue.p8_found(table(spark, folder, "documents"))


def p8_clean(spark: SparkSession, folder: str) -> DataFrame:
    """Ids of the documents fit for further use."""
    return residue.clean(table(spark, folder, "documents")).select("doc_id")


QUERIES = {f.__name__: f for f in (p1_found, p1_scores, p1_rates, p3_found, p3_classes, p3_splits, p3_invariants, p5_found, p5_sanitised, p6_found, p7_mixture, p7_shares, p7_invariants, p8_found, p8_clean)}

SQL = {
    "p3_classes": f"""WITH ids AS (SELECT DISTINCT user_id, {key_sql('user_id')} AS k FROM messages)
SELECT user_id, min(user_id) OVER (PARTITION BY k) AS class_id, count(*) OVER (PARTITION BY k) AS n_spellings FROM ids WHERE k IS NOT NULL""",
    "p3_invariants": f"SELECT count(*) AS n_rows, 0::BIGINT AS n_without, 0::BIGINT AS n_torn, count(DISTINCT {key_sql('user_id')}) AS n_accounts FROM messages",
    "p7_invariants": "SELECT source, 0::BIGINT AS n_over, 0::BIGINT AS n_twice, true AS met FROM mix_targets WHERE target_share > 0 AND max_repeats >= 1 AND source IN (SELECT source FROM documents WHERE doc_id IS NOT NULL AND length(text) > 0) GROUP BY source",
    "p3_found": f"""WITH ids AS (SELECT DISTINCT user_id, {key_sql('user_id')} AS k FROM messages)
SELECT a.user_id AS user_id_a, b.user_id AS user_id_b FROM ids a JOIN ids b ON a.k = b.k AND a.user_id < b.user_id""",
}
