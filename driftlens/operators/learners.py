"""What detectors and profiles learn from history besides ``operators.profiles``: weighted statistics, quick profiles, feature vectors, training sets.

Order is that of ``operators.ordered``; all is aggregated by combinable sums.

Defined results: users without history get the documented defaults where a table of users is given; null features count as their default.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from driftlens.functions import text as T
from driftlens.functions.encoders import Encoder, hashed_bag
from driftlens.operators.ordered import with_previous, with_rank
from driftlens.operators.profiles import COLD_START
from driftlens.operators.vectors import recency_weight

# fixed values: the style and the timing of a user without history, and of a missing feature
STYLE = {"length_tokens": (50.0, 10.0), "lexical_diversity": (0.7, 0.1), "formality": (0.5, 0.1), "politeness": (0.6, 0.1)}
TIMING = {"gap": 30.0, "duration": 45.0, "hours": list(range(9, 18)), "frequency": 5.0}
ACTIVE_SHARE = 0.10
MIN_HISTORY, COLD_MESSAGES = 3, 10


def enough(rows: DataFrame, user: str, least: int = MIN_HISTORY) -> DataFrame:
    """Users with at least ``least`` rows."""
    return rows.groupBy(user).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least).select(user)


def weighted_style(history: DataFrame) -> DataFrame:
    """By user the mean and deviation of each feature of style, recent messages weighing more: exp(-1) for the oldest to 1 for the newest.

    ``history`` is ``profiles.history``. Deviations are those of the weights, 0.01 at least: sums of w, wx and wxx about a
    user's plain mean, so that large numbers don't cancel.
    """
    names = {"length_tokens": "n_tokens", "lexical_diversity": "lex", "formality": "formality", "politeness": "polite"}
    rows = history.select("user_id", "us", "id", *[F.coalesce(F.col(c).cast("double"), F.lit(STYLE[k][0])).alias(k) for k, c in names.items()])
    weighed = with_rank(rows, "user_id", ["us", "id"]).withColumn("w", recency_weight())
    base = rows.groupBy("user_id").agg(*[F.avg(k).alias(f"{k}_base") for k in names])
    d = {k: F.col(k) - F.col(f"{k}_base") for k in names}
    sums = weighed.join(base, "user_id").groupBy("user_id").agg(
        F.sum("w").alias("w"), *[F.first(f"{k}_base").alias(f"{k}_base") for k in names], *[F.sum(F.col("w") * d[k]).alias(f"{k}_1") for k in names], *[F.sum(F.col("w") * d[k] * d[k]).alias(f"{k}_2") for k in names]
    )
    out = []
    for k in names:
        m = F.col(f"{k}_1") / F.col("w")
        out += [(F.col(f"{k}_base") + m).alias(f"{k}_mean"), F.greatest(F.sqrt(F.greatest(F.col(f"{k}_2") / F.col("w") - m * m, F.lit(0.0))), F.lit(0.01)).alias(f"{k}_std")]
    return sums.select("user_id", *out)


def learned_timing(history: DataFrame) -> DataFrame:
    """By user the recency-weighted gap (30 seconds for the first message), the hours with more than a tenth of the messages, and fixed duration and frequency."""
    near = with_previous(history.select("user_id", "us", "id", "hour"), "user_id", ["us", "id"], ["us"])
    gap = F.coalesce((F.col("us") - F.col("before.us")) / 1e6, F.lit(TIMING["gap"]))
    weighed = with_rank(near.withColumn("g", gap).drop("before"), "user_id", ["us", "id"]).withColumn("w", recency_weight())
    by_hour = weighed.groupBy("user_id", "hour").agg(F.count(F.lit(1)).alias("k"), F.sum("w").alias("w"), F.sum(F.col("w") * F.col("g")).alias("wg"))
    total = F.sum("k").over(Window.partitionBy("user_id"))  # a row per hour
    shares = by_hour.withColumn("active", F.col("k") / total > ACTIVE_SHARE)
    return shares.groupBy("user_id").agg((F.sum("wg") / F.sum("w")).alias("typical_gap"), F.array_sort(F.collect_list(F.when(F.col("active"), F.col("hour")))).alias("active_hours")).withColumns(
        {"typical_duration": F.lit(TIMING["duration"]), "frequency": F.lit(TIMING["frequency"])}
    )


def with_defaults(users: DataFrame, style: DataFrame, timing: DataFrame) -> DataFrame:
    """``users`` with what was learned of each, the defaults where nothing was."""
    rows = users.select("user_id").distinct().join(style, "user_id", "left").join(timing, "user_id", "left")
    filled = {f"{k}_{part}": F.coalesce(f"{k}_{part}", F.lit(v)) for k, pair in STYLE.items() for part, v in zip(("mean", "std"), pair, strict=True)}
    hours = F.array(*[F.lit(h) for h in TIMING["hours"]])
    return rows.withColumns(filled | {"typical_gap": F.coalesce("typical_gap", F.lit(TIMING["gap"])), "active_hours": F.coalesce("active_hours", hours), "typical_duration": F.lit(TIMING["duration"]), "frequency": F.lit(TIMING["frequency"])})


def quick_profiles(history: DataFrame, users: DataFrame, least: int = MIN_HISTORY) -> DataFrame:
    """The profile of an evaluation: mean lengths, distinct hours and the flag of sensitive operations from history, all else fixed. Users with few rows have none."""
    # fixed values: what a quick profile doesn't learn
    fixed = COLD_START | {"p_lex": 0.7, "p_lex_std": 0.1, "p_formality": 0.5, "p_formality_std": 0.1, "p_polite": 0.6, "p_polite_std": 0.1, "p_question": 0.3, "p_tech": True, "p_code": False}
    fixed |= {"p_session_minutes": 40.0, "p_longest_minutes": 80.0, "p_gap": 30.0, "p_per_session": 10.0, "p_frequency": 5.0, "p_diversity": 0.5}
    made = history.groupBy("user_id").agg(F.count(F.lit(1)).alias("n_history"), F.avg("n_tokens").alias("p_tokens"), F.avg("n_chars").alias("p_chars"), F.bool_or("sensitive").alias("p_sensitive"), F.array_sort(F.collect_set("hour")).alias("hours"), F.max("us").alias("last_us"))
    given = users.where("user_id IS NOT NULL").groupBy("user_id").agg(F.max(F.struct("updated_at", "typical_topics")).alias("v")).select("user_id", F.col("v.typical_topics").alias("topics"))
    learnt = ("n_history", "p_tokens", "p_chars", "p_sensitive")
    return (
        made.where(F.col("n_history") >= least).join(given, "user_id", "left").withColumn("topics", F.coalesce("topics", F.array(F.lit("general"))))
        .withColumns({k: F.lit(v) for k, v in fixed.items() if k not in learnt} | {"complexity": F.lit("moderate"), "domains": F.array(F.lit("conversation"))})
    )


def example_topics(records: DataFrame, k: int = 8) -> DataFrame:
    """``(user_id, topics)``: the ``k`` most frequent words of more than four characters, marks and all; ties by first place."""
    from driftlens.functions.timestamps import iso_instant
    from driftlens.operators.profiles import top

    rows = records.where("record_id IS NOT NULL").dropDuplicates(["record_id"]).select(
        "user_id", F.unix_micros(iso_instant(F.col("timestamp"))).alias("us"), F.col("record_id").alias("id"),
        F.posexplode(F.transform(F.filter(T.words(F.coalesce("text", F.lit(""))), lambda w: F.length(w) > 4), lambda w: F.lower(w))).alias("pos", "word"),
    )
    return top(rows.where("user_id IS NOT NULL AND us IS NOT NULL"), "word", k, ["us", "id", "pos"], "topics")


def says_code(text: Column) -> Column:
    """The detectors' idea of code: the word, a function's head, or the word function."""
    return F.contains(F.lower(text), F.lit("code")) | T.contains_any(text, ["def ", "function"])


def feature_vector(text: Column, wall: Column, encoder: Encoder = hashed_bag) -> Column:
    """The vector that fitted detectors see: the text's embedding, words, characters, diversity, questions, code, hour and weekday (Monday first) in parts of one."""
    ws = T.words(text)
    own = [F.size(ws), F.length(text), T.lexical_diversity(ws, fold=False), T.question_ratio(text), says_code(text).cast("int"), F.hour(wall) / 24.0, F.weekday(wall) / 7.0]
    return F.concat(encoder(text), F.array(*[c.cast("double") for c in own]))


def training_rows(rows: DataFrame, user: str, order: list[str], users: int = 20, each: int = 10) -> DataFrame:
    """The first ``each`` normal rows, in order, of the first ``users`` users by id: a sample by definition."""
    chosen = rows.where(F.col(user).isNotNull()).select(user).distinct().orderBy(user).limit(users)
    normal = rows.where(~F.coalesce(F.col("is_anomaly"), F.lit(False))).join(F.broadcast(chosen), user, "left_semi")  # at most ``users`` rows
    return with_rank(normal, user, order).where(F.col("i") <= each).drop("i", "n")


def cold_coverage(rows: DataFrame, user: str, least: int = COLD_MESSAGES) -> DataFrame:
    """Users, those with fewer than ``least`` training rows, and their share in percent."""
    per = rows.groupBy(user).agg(F.count_if(F.col("part") == "train").alias("n"))
    return per.agg(F.count(F.lit(1)).alias("n_users"), F.count_if(F.col("n") < least).alias("n_cold")).withColumn("cold_pct", F.when(F.col("n_users") > 0, 100.0 * F.col("n_cold") / F.col("n_users")).otherwise(0.0))
