"""Evaluation of predictions: ordinal splits, confusion, rank measures, classes, bootstrap, paired tests.

Predictions are rows ``(user_id, id, score, should_flag, ...)``; a prediction is positive above ``CUT``. Rank measures
aggregate by distinct score first, so ties are exact and the window runs over distinct scores. Null scores are left out;
a null truth counts as negative. With one class only, the confusion counts are 0, as defined, and the AUC and the average precision 0.5.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from driftlens.operators.ordered import with_rank

CUT = 0.60


def ordinal_split(rows: DataFrame, user: str, order: list[str], share: float = 0.8) -> DataFrame:
    """``part``: 'train' for the first share of each user's rows in order (the instant first), rounded down, else 'test'."""
    placed = with_rank(rows, user, order)
    return placed.withColumn("part", F.when(F.col("i") <= F.floor(F.col("n") * F.lit(share)), "train").otherwise("test")).drop("i", "n")


def sample_users(rows: DataFrame, user: str, anomaly: str, limit: int = 20) -> DataFrame:
    """The first ``limit`` users: those with anomalies first, each kind in order of the id. A top-k, kept by partial sorts."""
    has = rows.where(F.col(user).isNotNull()).groupBy(user).agg(F.max(F.coalesce(F.col(anomaly), F.lit(False))).alias("has_anomaly"))
    return has.orderBy(F.desc("has_anomaly"), user).limit(limit)


def _ratio(a: Column, b: Column) -> Column:
    return F.when(b == 0, 0.0).otherwise(a / F.when(b == 0, 1).otherwise(b))


def _counts(rows: DataFrame, by: list[str] | None) -> DataFrame:
    y, p = F.coalesce(F.col("should_flag"), F.lit(False)), F.col("score") > CUT
    return rows.where(F.col("score").isNotNull()).groupBy(*(by or [])).agg(
        F.count_if(y & p).alias("tp"), F.count_if(~y & ~p).alias("tn"), F.count_if(~y & p).alias("fp"), F.count_if(y & ~p).alias("fn")
    )


def confusion(rows: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Counts and the measures made of them. With one class only, the counts and the rates made of them are 0; precision, recall, F1 and accuracy stay."""
    c = {k: F.col(k) for k in ("tp", "tn", "fp", "fn")}
    precision, recall = _ratio(c["tp"], c["tp"] + c["fp"]), _ratio(c["tp"], c["tp"] + c["fn"])
    mcc = F.sqrt((c["tp"] + c["fp"]).cast("double") * (c["tp"] + c["fn"]) * (c["tn"] + c["fp"]) * (c["tn"] + c["fn"]))
    out = _counts(rows, by).withColumns(
        {
            "precision": precision, "recall": recall, "f1": _ratio(2 * precision * recall, precision + recall), "accuracy": _ratio(c["tp"] + c["tn"], c["tp"] + c["tn"] + c["fp"] + c["fn"]),
            "fpr": _ratio(c["fp"], c["fp"] + c["tn"]), "fnr": _ratio(c["fn"], c["fn"] + c["tp"]), "tpr": recall, "tnr": _ratio(c["tn"], c["tn"] + c["fp"]), "mcc": _ratio((c["tp"] * c["tn"] - c["fp"] * c["fn"]).cast("double"), mcc),
        }
    )
    single = (c["tp"] + c["fn"] == 0) | (c["tn"] + c["fp"] == 0)
    zero = (*c, "fpr", "fnr", "tpr", "tnr", "mcc")
    return out.withColumn("single", single).withColumns({k: F.when(F.col("single"), 0).otherwise(F.col(k)) for k in zero}).drop("single")


def per_class(rows: DataFrame) -> DataFrame:
    """Precision, recall, F1 and support by ``anomaly_type`` and by ``attack_phase``; missing classes are benign.

    Within a class only its own rows count: positives are the flagged ones, and the support is the number of rows.
    """
    both = rows.select("should_flag", "score", F.explode(F.array(*[F.struct(F.lit(k).alias("key"), F.lower(F.trim(F.col(k))).alias("cls")) for k in ("anomaly_type", "attack_phase")])).alias("k"))
    cls = F.when(F.coalesce(F.col("k.cls"), F.lit("")) == "", "benign").otherwise(F.col("k.cls"))
    c = _counts(both.select("should_flag", "score", F.col("k.key").alias("key"), cls.alias("cls")), ["key", "cls"])
    precision, recall = _ratio(F.col("tp"), F.col("tp") + F.col("fp")), _ratio(F.col("tp"), F.col("tp") + F.col("fn"))
    return c.select("key", "cls", (F.col("tp") + F.col("tn") + F.col("fp") + F.col("fn")).alias("support"), precision.alias("precision"), recall.alias("recall"), _ratio(2 * precision * recall, precision + recall).alias("f1"))


#: Ranges of scores whose sums are worked out first, so that no task has all distinct scores.
RANGES = 4096


def _by_score(rows: DataFrame, falling: bool, keys: list[str]) -> DataFrame:
    """By keys and distinct score: positives, negatives, and the sums of both before it (``pos_before``, ``neg_before``) in rising or falling order."""
    y = F.coalesce(F.col("should_flag"), F.lit(False)).cast("long")
    sums = rows.where(F.col("score").isNotNull()).groupBy(*keys, "score").agg(F.sum(y).alias("pos"), F.sum(1 - y).alias("neg"))
    # Scores lie between 0 and 1; any others fall into the first or the last range.
    place = F.greatest(F.lit(0), F.least(F.lit(RANGES - 1), F.floor(F.col("score") * RANGES)))
    sums = sums.withColumn("_r", (RANGES - 1 - place) if falling else place).withColumn("_s", -F.col("score") if falling else F.col("score"))
    each = sums.groupBy(*keys, "_r").agg(F.sum("pos").alias("_p"), F.sum("neg").alias("_n"))
    up = Window.partitionBy(*keys).orderBy("_r").rowsBetween(Window.unboundedPreceding, -1)  # at most RANGES rows each
    before = each.select(*keys, "_r", F.coalesce(F.sum("_p").over(up), F.lit(0)).alias("_p"), F.coalesce(F.sum("_n").over(up), F.lit(0)).alias("_n"))
    within = Window.partitionBy(*keys, "_r").orderBy("_s").rowsBetween(Window.unboundedPreceding, -1)
    inner = {f"{c}_before": F.coalesce(F.sum(c).over(within), F.lit(0)) for c in ("pos", "neg")}
    return sums.withColumns(inner).join(before, [*keys, "_r"]).select(*keys, "score", "pos", "neg", (F.col("pos_before") + F.col("_p")).alias("pos_before"), (F.col("neg_before") + F.col("_n")).alias("neg_before"))


def _auc() -> Column:
    both = (F.coalesce("p", F.lit(0)) > 0) & (F.coalesce("n", F.lit(0)) > 0)
    return F.when(both, F.col("u") / (F.col("p").cast("double") * F.col("n"))).otherwise(0.5)


def _precision() -> Column:
    both = (F.coalesce("p", F.lit(0)) > 0) & (F.coalesce("n", F.lit(0)) > 0)
    return F.when(both, F.col("s") / F.col("p")).otherwise(0.5)


def roc_auc(rows: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """The chance that a positive has a higher score than a negative, ties counting half; 0.5 with one class."""
    keys = keys or []
    won = _by_score(rows, False, keys).groupBy(*keys).agg(F.sum("pos").alias("p"), F.sum("neg").alias("n"), F.sum(F.col("pos") * (F.col("neg_before") + F.col("neg") / 2)).alias("u"))
    return won.select(*keys, F.coalesce(F.col("p"), F.lit(0)).alias("n_pos"), F.coalesce(F.col("n"), F.lit(0)).alias("n_neg"), _auc().alias("auc"))


def average_precision(rows: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """The sum over thresholds of the gain in recall times precision; 0.5 with one class."""
    keys = keys or []
    c = _by_score(rows, True, keys)
    tp, every = F.col("pos_before") + F.col("pos"), F.col("pos_before") + F.col("pos") + F.col("neg_before") + F.col("neg")
    return c.groupBy(*keys).agg(F.sum("pos").alias("p"), F.sum("neg").alias("n"), F.sum(F.col("pos") * (tp / every)).alias("s")).select(*keys, _precision().alias("average_precision"))


def rank_measures(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Both, by ``keys``."""
    return roc_auc(rows, keys).select(*keys, "auc").join(average_precision(rows, keys), keys)


def attribution(rows: DataFrame) -> DataFrame:
    """True positives by the mechanism that flagged them, and their share in percent."""
    hit = rows.where(F.coalesce(F.col("should_flag"), F.lit(False)) & (F.col("score") > CUT)).groupBy("mechanism").agg(F.count(F.lit(1)).alias("n"))
    return hit.withColumn("pct", F.round(100.0 * F.col("n") / F.sum("n").over(Window.partitionBy(F.lit(0))), 1))  # a row per mechanism


def latency(rows: DataFrame, value: str) -> DataFrame:
    return rows.agg(F.avg(value).alias("mean"), F.percentile(F.col(value), F.lit(0.5)).alias("median"), F.percentile(F.col(value), F.lit(0.95)).alias("p95"))


def bootstrap(rows: DataFrame, replicates: int = 1000, seed: int = 42) -> DataFrame:
    """95 % intervals of the measures, users drawn with replacement.

    Users are reduced to their four counts first. Each replicate draws as many users as there are, by the Poisson
    approximation of drawing with replacement: every user gets an independent Poisson(1) weight from a hash, so
    nothing is collected and users needn't be numbered.
    """
    y, p = F.coalesce(F.col("should_flag"), F.lit(False)), F.col("score") > CUT
    users = rows.where(F.col("score").isNotNull()).groupBy("user_id").agg(F.count_if(y & p).alias("tp"), F.count_if(~y & ~p).alias("tn"), F.count_if(~y & p).alias("fp"), F.count_if(y & ~p).alias("fn"))
    u = (F.pmod(F.xxhash64("user_id", "rep", F.lit(seed)), F.lit(1 << 30)) + 0.5) / float(1 << 30)
    cdf, weight, total = math.exp(-1), F.lit(0), 0.0
    for k in range(12):
        total += cdf
        weight = weight + (u > total).cast("int")
        cdf /= k + 1
    drawn = users.withColumn("rep", F.explode(F.sequence(F.lit(0), F.lit(replicates - 1)))).withColumn("w", weight).where("w > 0")
    sums = drawn.groupBy("rep").agg(*[F.sum(F.col("w") * F.col(c)).alias(c) for c in ("tp", "tn", "fp", "fn")])
    c = {k: F.col(k) for k in ("tp", "tn", "fp", "fn")}
    precision, recall = _ratio(c["tp"], c["tp"] + c["fp"]), _ratio(c["tp"], c["tp"] + c["fn"])
    each = sums.select(precision.alias("precision"), recall.alias("recall"), _ratio(2 * precision * recall, precision + recall).alias("f1"), _ratio(c["fp"], c["fp"] + c["tn"]).alias("fpr"))
    long = each.select(F.explode(F.array(*[F.struct(F.lit(m).alias("measure"), F.col(m).alias("v")) for m in each.columns])).alias("m")).select("m.*")
    return long.groupBy("measure").agg(F.percentile("v", F.lit(0.025)).alias("low"), F.avg("v").alias("mean"), F.percentile("v", F.lit(0.975)).alias("high"))


def _t_cdf(t: float, df: int) -> float:
    """Student's distribution function by the continued fraction of the incomplete beta function."""
    x = df / (df + t * t)
    a, b = df / 2, 0.5
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)) if 0 < x < 1 else 0.0

    def fraction(a: float, b: float, x: float) -> float:
        c, d = 1.0, 1 / (1 - (a + b) * x / (a + 1))
        out = d
        for m in range(1, 300):
            for num in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
                d, c = 1 / (1 + num * d), 1 + num / c
                out *= c * d
            if abs(c * d - 1) < 1e-14:
                break
        return out

    tail = (front * fraction(a, b, x) / a if x < (a + 1) / (a + b + 2) else 1 - front * fraction(b, a, 1 - x) / b) / 2
    return 1 - tail if t > 0 else tail


def paired_test(rows: DataFrame, a: str, b: str) -> dict[str, float]:
    """Paired t-test of two score columns, Cohen's d and the 95 % interval of the mean difference; one aggregate row."""
    d = F.col(a) - F.col(b)
    r = rows.where(d.isNotNull()).agg(F.count(F.lit(1)).alias("n"), F.avg(d).alias("mean"), F.stddev_samp(d).alias("sd"), F.stddev_pop(d).alias("sd_pop")).first()
    n, mean, sd = r["n"], r["mean"] or 0.0, r["sd"] or 0.0
    if n < 2 or sd == 0:
        return {"n": n, "mean": mean, "t": 0.0, "p": 1.0, "cohens_d": mean / ((r["sd_pop"] or 0.0) + 1e-8), "low": mean, "high": mean}
    se = sd / math.sqrt(n)
    t = mean / se
    low, high = 0.0, 1e3
    for _ in range(200):
        mid = (low + high) / 2
        low, high = (mid, high) if _t_cdf(mid, n - 1) < 0.975 else (low, mid)
    return {"n": n, "mean": mean, "t": t, "p": 2 * (1 - _t_cdf(abs(t), n - 1)), "cohens_d": mean / (r["sd_pop"] + 1e-8), "low": mean - low * se, "high": mean + low * se}
