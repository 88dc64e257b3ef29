"""Profiles: one row per user from the ordered history of their normal messages.

All parts of a profile are grouped aggregates that combine before the shuffle; the order that gaps and centroids need is that of
``operators.ordered``, which doesn't put a user's messages into one task, and windows of top values run over distinct values.

Defined results: a record imported twice counts once; records without user, or without a readable timestamp, are left out;
null text counts as empty, a null anomaly flag as normal. Users without normal history get the cold-start profile
when scored. Ties among hours, weekdays and words go to the one seen first.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from driftlens.functions import lexicons as X
from driftlens.functions import text as T
from driftlens.functions.encoders import Encoder
from driftlens.functions.timestamps import iso_instant, iso_wall
from driftlens.operators import vectors
from driftlens.operators.ordered import with_previous, with_rank
from driftlens.sources.tables import spread
from driftlens.storage import cut

#: The profile of a user without history.
COLD_START = {
    "n_history": 0, "p_tokens": 20.0, "p_chars": 100.0, "p_lex": 0.7, "p_lex_std": 0.1, "p_formality": 0.5, "p_formality_std": 0.15, "p_polite": 0.6,
    "p_polite_std": 0.15, "p_question": 0.3, "p_tech": False, "p_code": False, "p_sensitive": False, "p_session_minutes": 30.0, "p_longest_minutes": 60.0,
    "p_gap": 30.0, "p_per_session": 8.0, "p_frequency": 3.0, "p_diversity": 0.5,
}
COLD_HOURS = list(range(9, 18))
COLD_TOPICS = ["general"]


def history(records: DataFrame) -> DataFrame:
    """Features of each normal record, narrow: ``(user_id, id, us, session, hour, day, ...)``."""
    t = F.coalesce("text", F.lit(""))
    wall = iso_wall(F.col("timestamp"))
    read = spread(records.where(F.col("record_id").isNotNull()).select("record_id", "user_id", "text", "timestamp", "session_id", "is_anomaly", "operation_risk"))
    base = read.select(
        F.col("user_id"), F.col("record_id").alias("id"), F.unix_micros(iso_instant(F.col("timestamp"))).alias("us"), F.coalesce("session_id", F.lit("default")).alias("session"),
        wall.alias("wall"), F.coalesce("is_anomaly", F.lit(False)).alias("anomaly"), T.valid_risk(F.col("operation_risk")).alias("risk"), t.alias("text"), F.lower(t).alias("low"), T.words(t).alias("ws"),
    )
    seen = base.select(
        "user_id", "id", "us", "session", F.hour("wall").alias("hour"), F.date_format("wall", "EEEE").alias("day"), F.size("ws").alias("n_tokens"), F.length("text").alias("n_chars"),
        T.lexical_diversity(F.col("ws")).alias("lex"), T.question_ratio(F.col("text")).alias("question"), F.least(F.lit(1.0), F.size("ws") / 50.0).alias("formality"),
        T.contains_any(F.col("low"), X.POLITE_BUILD).cast("double").alias("polite"), T.contains_any(F.col("text"), ["def ", "```"]).alias("code"), T.contains_any(F.col("low"), X.TECH_WORDS).alias("tech"),
        F.coalesce(F.col("risk").isin("high", "critical"), F.lit(False)).alias("sensitive"), T.topic_words(F.col("ws")).alias("topic_words"), "anomaly",
    )
    return seen.dropDuplicates(["id"]).where("user_id IS NOT NULL AND us IS NOT NULL AND NOT anomaly").drop("anomaly")


def _spread(c: str) -> Column:
    return F.greatest(F.coalesce(F.stddev_samp(c), F.lit(0.0)), F.lit(0.01))


def statistics(rows: DataFrame) -> DataFrame:
    """Per user: counts, means and sample deviations (at least 0.01), flags and the last instant."""
    return rows.groupBy("user_id").agg(
        F.count(F.lit(1)).alias("n_history"), F.avg("n_tokens").alias("p_tokens"), F.avg("n_chars").alias("p_chars"), F.avg("lex").alias("p_lex"), _spread("lex").alias("p_lex_std"),
        F.avg("formality").alias("p_formality"), _spread("formality").alias("p_formality_std"), F.avg("polite").alias("p_polite"), _spread("polite").alias("p_polite_std"), F.avg("question").alias("p_question"),
        F.bool_or("tech").alias("p_tech"), F.bool_or("code").alias("p_code"), F.bool_or("sensitive").alias("p_sensitive"), F.max("us").alias("last_us"),
    )


def gaps(rows: DataFrame) -> DataFrame:
    """Mean of the gaps between neighbouring messages that are positive and under an hour; 30 seconds without any."""
    s = (F.col("us") - F.col("before.us")) / 1e6
    return with_previous(rows.select("user_id", "us", "id"), "user_id", ["us", "id"], ["us"]).select("user_id", s.alias("s")).groupBy("user_id").agg(F.coalesce(F.avg(F.when((F.col("s") > 0) & (F.col("s") < 3600), F.col("s"))), F.lit(30.0)).alias("p_gap"))


def session_statistics(rows: DataFrame) -> DataFrame:
    """Per user, by the supplied sessions: mean and longest duration in minutes, messages a session, sessions."""
    per = rows.groupBy("user_id", "session").agg(F.count(F.lit(1)).alias("n"), ((F.max("us") - F.min("us")) / 6e7).alias("minutes"))
    long = F.when(F.col("n") >= 2, F.col("minutes"))
    return per.groupBy("user_id").agg(
        F.coalesce(F.avg(long), F.lit(30.0)).alias("p_session_minutes"), F.coalesce(F.max(long), F.lit(60.0)).alias("p_longest_minutes"), (F.sum("n") / F.count(F.lit(1))).alias("p_per_session"), F.count(F.lit(1)).alias("n_sessions")
    )


def top(rows: DataFrame, value: str, k: int, place: list[str], out: str) -> DataFrame:
    """Per user the ``k`` most frequent values, ties by first place, as an array in that order.

    Counts are combined by (user, value) before a user's values meet, so the window is over distinct values.
    """
    counted = rows.groupBy("user_id", value).agg(F.count(F.lit(1)).alias("n"), F.min(F.struct(*place)).alias("at"))
    rank = F.row_number().over(Window.partitionBy("user_id").orderBy(F.desc("n"), "at"))
    kept = counted.withColumn("r", rank).where(F.col("r") <= k)
    return kept.groupBy("user_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("r", value))), lambda x: x[value]).alias(out))


def topics(rows: DataFrame) -> DataFrame:
    said = rows.select("user_id", "us", "id", F.posexplode("topic_words").alias("pos", "word"))
    return top(said, "word", 10, ["us", "id", "pos"], "topics")


def centroids(records: DataFrame, encoder: Encoder, decay: float = 0.95) -> DataFrame:
    """``(user_id, centroid)``: the decayed mean of the vectors of a user's normal records, in their order, at unit length."""
    vectors_ = records.where("record_id IS NOT NULL").dropDuplicates(["record_id"]).where("user_id IS NOT NULL AND NOT coalesce(is_anomaly, false)")
    rows = vectors_.select("user_id", F.unix_micros(iso_instant(F.col("timestamp"))).alias("us"), F.col("record_id").alias("id"), encoder(F.coalesce("text", F.lit(""))).alias("v")).where("us IS NOT NULL")
    return vectors.decayed(with_rank(rows, "user_id", ["us", "id"]), "user_id", "v", decay)


def build(records: DataFrame, users: DataFrame, encoder: Encoder | None = None, decay: float = 0.95) -> DataFrame:
    """Profiles of all users with normal history; with an encoder, with the centroid of their texts."""
    made = _built(records, users)
    return made if encoder is None else made.join(centroids(records, encoder, decay), "user_id", "left")


def _built(records: DataFrame, users: DataFrame) -> DataFrame:
    rows = cut(history(records), "history")  # read by seven aggregates
    ages = users.where("user_id IS NOT NULL").groupBy("user_id").agg(F.max(F.struct("updated_at", "account_age_days")).alias("v")).select("user_id", F.col("v.account_age_days").alias("age"))
    return (
        statistics(rows)
        .join(gaps(rows), "user_id")
        .join(session_statistics(rows), "user_id")
        .join(top(rows, "hour", 6, ["us", "id"], "hours"), "user_id")
        .join(top(rows, "day", 5, ["us", "id"], "days"), "user_id")
        .join(topics(rows), "user_id", "left")
        .join(ages, "user_id", "left")
        .withColumn("p_diversity", F.least(F.lit(1.0), F.coalesce(F.size("topics"), F.lit(0)) / 10.0))
        .withColumn("topics", F.coalesce("topics", F.array(F.lit("general"))))
        .withColumn("p_frequency", F.least(F.col("n_sessions") / F.greatest(F.coalesce(F.col("age"), F.lit(0)) / 7.0, F.lit(1.0)), F.lit(14.0)))
        .withColumn("complexity", F.when(F.col("p_tokens") > 40, "complex").when(F.col("p_tokens") > 15, "moderate").otherwise("simple"))
    )
