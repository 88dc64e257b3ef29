"""Detectors judged on labelled messages: each account's first part trains its profile, the rest is predicted, measures follow.

One pass makes the predictions of all methods and settings as rows ``(dataset, method, user_id, id, score, ...)``; every measure is an
aggregate by (dataset, method), so methods and datasets are groups, not loops. Predictions of two methods are compared by key.

Defined results: accounts with fewer than three normal training messages have no profile and are left out. A dataset is a value of the
column ``source``; null is the dataset 'unknown'. Null labels are negative.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from driftlens.functions.encoders import hashed_bag
from driftlens.functions.timestamps import iso_wall
from driftlens.operators import detectors, forest, learners, metrics, ordered, profiles, scoring
from driftlens.storage import cut

# fixed values: parts that an ablation leaves on
ABLATIONS = {
    "no_semantic": (False, True, True), "no_linguistic": (True, False, True), "no_temporal": (True, True, False), "semantic_only": (True, False, False), "linguistic_only": (False, True, False), "temporal_only": (False, False, True),
}
LEVELS = ("low", "medium", "high", "maximum")
DECAYS = (0.90, 0.95, 0.99)
FULL, BASELINES = "full_system", ("rule_based", "isolation_forest", "autoencoder", "content_safety")
_KEEP = ["dataset", "user_id", "id", "should_flag", "anomaly_type", "attack_phase"]


def split_messages(messages: DataFrame, split_users: DataFrame | None = None, share: float = 0.8, max_users: int | None = None) -> DataFrame:
    """The latest delivery of each message with its ``part``: the first ``share`` of an account's messages train.

    ``split_users`` (``user_id``) keeps the accounts of a given split; ``max_users`` samples so many, those with anomalies first.
    """
    once = scoring.latest(messages).withColumns({"account": scoring.account_key(F.col("user_id")), "us": F.unix_micros(scoring.iso_instant(F.col("timestamp")))}).where("account IS NOT NULL AND us IS NOT NULL")
    if split_users is not None:
        once = once.join(split_users.select(scoring.account_key(F.col("user_id")).alias("account")).distinct(), "account", "left_semi")
    if max_users is not None:
        once = once.join(F.broadcast(metrics.sample_users(once, "account", "should_flag", max_users).select("account")), "account", "left_semi")  # at most ``max_users`` rows
    parts = metrics.ordinal_split(once.select("account", "us", "message_id"), "account", ["us", "message_id"], share)
    return once.join(parts.select("message_id", "part"), "message_id").withColumn("dataset", F.coalesce("source", F.lit("unknown")))


def _history(train: DataFrame) -> DataFrame:
    return train.select(F.col("message_id").alias("record_id"), F.col("account").alias("user_id"), F.col("message_text").alias("text"), "timestamp", "session_id", "is_anomaly", "operation_risk")


def _profiles(records: DataFrame, users: DataFrame, kind: str, decay: float) -> DataFrame:
    """Profiles by account key: quick ones or built ones; of accounts with enough normal history."""
    keyed = users.withColumn("user_id", scoring.account_key(F.col("user_id")))
    if kind == "quick":
        made = learners.quick_profiles(profiles.history(records), keyed)
        return made.join(profiles.centroids(records, hashed_bag, decay), "user_id", "left")
    return profiles.build(records, keyed, hashed_bag, decay).where(F.col("n_history") >= learners.MIN_HISTORY)


def predictions(parts: DataFrame, users: DataFrame, methods: tuple[str, ...] = (FULL, "rule_based", "content_safety"), profile: str = "quick", decay: float = 0.95, configs: dict[str, dict[str, object]] | None = None) -> DataFrame:
    """``(dataset, method, user_id, id, score, should_flag, anomaly_type, attack_phase, mechanism)`` of all test messages, all methods in one table.

    ``configs`` adds settings of the full system, each under its own name; parts of the score are worked out once for all of them.
    """
    train, test = parts.where("part = 'train'"), parts.where("part = 'test'")
    records = cut(_history(train), "training")
    held = cut(_profiles(records, users, profile, decay), "profiles")
    test = cut(test.join(held.select(F.col("user_id").alias("account")), "account", "left_semi"), "test")
    out = []
    settings = {m: c for m, c in ({FULL: {}} if FULL in methods else {}).items()} | (configs or {})
    if settings:
        rows = cut(scoring.learned(scoring.prepared(test, held, hashed_bag)), "parts")
        rows = rows.withColumns({"semantic": F.col("semantic_ml"), "linguistic": F.col("linguistic_ml"), "temporal": F.col("temporal_ml"), "dataset": F.coalesce("source", F.lit("unknown")), "user_id": F.col("account")})
        out += [scoring.composite(rows, c).select(*_KEEP, F.lit(name).alias("method"), "score", "mechanism") for name, c in settings.items()]
    base = test.select("dataset", F.col("account").alias("user_id"), F.col("message_id").alias("id"), F.coalesce("should_flag", F.lit(False)).alias("should_flag"), "anomaly_type", "attack_phase", "us", F.coalesce("message_text", F.lit("")).alias("text"), iso_wall(F.col("timestamp")).alias("wall"))
    if "rule_based" in methods:
        rated = ordered.with_recent(base.withColumn("signs", detectors.rule_signs(F.col("text"))).drop("text"), "user_id", "us", 60, "recent")
        out.append(rated.withColumn("found", detectors.rule_sum(F.col("signs"), F.col("recent"))).select(*_KEEP, F.lit("rule_based").alias("method"), F.col("found.score").alias("score"), F.lit("n/a").alias("mechanism")))
    if "content_safety" in methods:
        out.append(base.withColumn("found", detectors.hazard_verdict(F.col("text"))).select(*_KEEP, F.lit("content_safety").alias("method"), F.round("found.score", 3).alias("score"), F.lit("n/a").alias("mechanism")))
    fitted = [m for m in methods if m in ("isolation_forest", "autoencoder")]
    if fitted:
        chosen = learners.training_rows(train.select("account", "us", "message_id", "is_anomaly", "message_text", "timestamp"), "account", ["us", "message_id"])
        vector = learners.feature_vector(F.coalesce("message_text", F.lit("")), iso_wall(F.col("timestamp")))
        seen = cut(chosen.select(F.col("message_id").alias("id"), vector.alias("v")), "training-vectors")
        asked = cut(base.select("id", learners.feature_vector(F.col("text"), F.col("wall")).alias("v")), "vectors")
        for m in fitted:
            model = forest.fit_forest(seen, "id", "v") if m == "isolation_forest" else forest.fit_autoencoder(seen, "id", "v")
            out.append(base.join(forest.predict(model, asked, "id", "v"), "id").select(*_KEEP, F.lit(m).alias("method"), "score", F.lit("n/a").alias("mechanism")))
    return cut(reduce(DataFrame.unionByName, out), "predictions")


def measures(made: DataFrame, by: list[str] | None = None) -> DataFrame:
    """The confusion counts, rates, AUC and average precision of each (dataset, method)."""
    keys = by or ["dataset", "method"]
    return metrics.confusion(made, keys).join(metrics.rank_measures(made, keys), keys)


def compared(made: DataFrame, one: str = FULL, others: tuple[str, ...] = BASELINES) -> DataFrame:
    """Whether two methods are right on the same messages: paired by dataset, account and message. Means, deviation and t by (dataset, other)."""
    right = made.withColumn("right", (F.coalesce("should_flag", F.lit(False)) == (F.col("score") > metrics.CUT)).cast("double")).select("dataset", "user_id", "id", "method", "right")
    a = right.where(F.col("method") == one).select("dataset", "user_id", "id", F.col("right").alias("a"))
    b = right.where(F.col("method").isin(*others)).select("dataset", "user_id", "id", F.col("method").alias("other"), F.col("right").alias("b"))
    d = F.col("a") - F.col("b")
    sums = a.join(b, ["dataset", "user_id", "id"]).groupBy("dataset", "other").agg(F.count(F.lit(1)).alias("n"), F.avg(d).alias("mean"), F.stddev_samp(d).alias("sd"), F.stddev_pop(d).alias("sd_pop"))
    t = F.when(F.col("sd") > 0, F.col("mean") / (F.col("sd") / F.sqrt("n"))).otherwise(0.0)
    return sums.select("dataset", "other", "n", "mean", t.alias("t"), (F.col("mean") / (F.col("sd_pop") + 1e-8)).alias("cohens_d"))


def run(messages: DataFrame, users: DataFrame, methods: tuple[str, ...] = (FULL, *BASELINES), datasets: list[str] | None = None, max_users: int | None = 20, decays: tuple[float, ...] = DECAYS) -> dict[str, DataFrame]:
    """The whole evaluation: ``measures`` of methods, ``ablations``, ``levels`` of sensitivity and ``decays``, ``compared``, ``attribution``, ``coverage``."""
    chosen = messages if datasets is None else messages.where(F.col("source").isin(*datasets))
    parts = cut(split_messages(chosen, max_users=max_users), "parts")
    configs: dict[str, dict[str, object]] = {n: dict(zip(("use_semantic", "use_linguistic", "use_temporal"), on, strict=True)) for n, on in ABLATIONS.items()}
    configs |= {f"level_{s}": {"sensitivity": s} for s in LEVELS} | {"no_overrides": {"overrides": False}}
    made = predictions(parts, users, methods, configs=configs)
    by_decay = [predictions(parts, users, (FULL,), profile="built", decay=d).withColumn("method", F.lit(f"decay_{d}")) for d in decays]
    own = made.where(~F.col("method").isin(*configs))
    return {
        "predictions": made, "measures": measures(own), "ablations": measures(made.where(F.col("method").isin(*ABLATIONS, "no_overrides"))), "levels": measures(made.where(F.col("method").startswith("level_"))),
        **({"decays": measures(reduce(DataFrame.unionByName, by_decay))} if by_decay else {}), "compared": compared(made), "attribution": metrics.attribution(made.where(F.col("method") == FULL)), "coverage": learners.cold_coverage(parts, "account"),
    }
