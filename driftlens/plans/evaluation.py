"""Queries on vectors and on the quality of scores, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from driftlens.operators import forest, metrics, scoring, vectors
from driftlens.plans.events import instant_sql, key_sql
from driftlens.plans.scoring import EVALUATED_SQL, VERDICT, built
from driftlens.sources.tables import table, tables
from driftlens.storage import cut


def _by_dim(made: DataFrame) -> DataFrame:
    return made.select(F.col("label").cast("long").alias("label"), F.posexplode("centroid").alias("dim", "x")).select("label", F.col("dim").cast("long").alias("dim"), F.round("x", 6).alias("x"))


def ema_centroid(spark: SparkSession, folder: str) -> DataFrame:
    return _by_dim(vectors.ema_centroid(table(spark, folder, "embeddings"), "label", "vec_id", "embedding"))


def recency_centroid(spark: SparkSession, folder: str) -> DataFrame:
    return _by_dim(vectors.recency_centroid(table(spark, folder, "embeddings"), "label", "vec_id", "embedding"))


def cosine_score(spark: SparkSession, folder: str) -> DataFrame:
    """Each vector against its label's centroid; the centroids are a row per label."""
    rows = table(spark, folder, "embeddings")
    joined = rows.join(vectors.ema_centroid(rows, "label", "vec_id", "embedding"), "label")
    c = vectors.cosine(F.col("embedding"), F.col("centroid"))
    return joined.select("vec_id", F.round(c, 6).alias("cosine"), F.round(F.least(F.lit(1.0), (1 - c) / 2), 6).alias("score"))


def standardise(spark: SparkSession, folder: str) -> DataFrame:
    return forest.standardised(table(spark, folder, "embeddings"), "vec_id", "embedding").select("vec_id", F.round(F.aggregate("z", F.lit(0.0), lambda a, x: a + x * x), 5).alias("sum_of_squares"))


def pca_recon(spark: SparkSession, folder: str) -> DataFrame:
    return forest.reconstruction(table(spark, folder, "embeddings"), "vec_id", "embedding")


def mlp_recon(spark: SparkSession, folder: str) -> DataFrame:
    return forest.autoencoder(table(spark, folder, "embeddings"), "vec_id", "embedding")


def iso_forest(spark: SparkSession, folder: str) -> DataFrame:
    return forest.isolation_forest(table(spark, folder, "embeddings"), "vec_id", "embedding")


def _scored(spark: SparkSession, folder: str) -> DataFrame:
    rows = scoring.composite(scoring.components(scoring.prepared(table(spark, folder, "messages"), built(spark, folder))))
    narrow = rows.select(F.col("account").alias("user_id"), "id", F.round("score", 6).alias("score"), "should_flag", "anomaly_type", "attack_phase", "mechanism", "weighted")
    # Written once: a measure's filter on the score would else be pushed down with all that the score is made of.
    return cut(narrow, "predictions")


_RATES = ["precision", "recall", "f1", "accuracy", "fpr", "fnr", "mcc"]


def confusion(spark: SparkSession, folder: str) -> DataFrame:
    return metrics.confusion(_scored(spark, folder)).select("tp", "tn", "fp", "fn", *[F.round(c, 6).alias(c) for c in _RATES])


def per_class(spark: SparkSession, folder: str) -> DataFrame:
    return metrics.per_class(_scored(spark, folder)).select("key", "cls", "support", *[F.round(c, 6).alias(c) for c in ("precision", "recall", "f1")])


def roc_auc(spark: SparkSession, folder: str) -> DataFrame:
    return metrics.roc_auc(_scored(spark, folder)).select("n_pos", "n_neg", F.round("auc", 6).alias("auc"))


def avg_precision(spark: SparkSession, folder: str) -> DataFrame:
    return metrics.average_precision(_scored(spark, folder)).select(F.round("average_precision", 6).alias("average_precision"))


def attribution(spark: SparkSession, folder: str) -> DataFrame:
    return metrics.attribution(_scored(spark, folder))


def latency_percentiles(spark: SparkSession, folder: str) -> DataFrame:
    return metrics.latency(table(spark, folder, "events"), "value").select(*[F.round(c, 6).alias(c) for c in ("mean", "median", "p95")])


def split_80_20(spark: SparkSession, folder: str) -> DataFrame:
    rows = scoring.timed(table(spark, folder, "messages"))
    return metrics.ordinal_split(rows, "account", ["us", "id"]).select(F.col("id").alias("message_id"), "part")


def sample_users(spark: SparkSession, folder: str) -> DataFrame:
    return metrics.sample_users(table(spark, folder, "message_records"), "user_id", "is_anomaly")


def bootstrap_ci(spark: SparkSession, folder: str) -> DataFrame:
    return metrics.bootstrap(_scored(spark, folder))


def paired_ttest(spark: SparkSession, folder: str) -> DataFrame:
    """The score with overrides against the weighted score alone."""
    r = metrics.paired_test(_scored(spark, folder), "score", "weighted")
    return spark.createDataFrame([(int(r["n"]), *[round(float(r[k]), 6) for k in ("mean", "t", "p", "cohens_d", "low", "high")])], "n long, mean double, t double, p double, cohens_d double, low double, high double")


QUERIES = {f.__name__: f for f in (ema_centroid, recency_centroid, cosine_score, standardise, pca_recon, mlp_recon, iso_forest, confusion, per_class, roc_auc, avg_precision, attribution, latency_percentiles, split_80_20, sample_users, bootstrap_ci, paired_ttest)}

_VEC = """ranked AS (SELECT vec_id, label, embedding, row_number() OVER (PARTITION BY label ORDER BY vec_id) AS i, count(*) OVER (PARTITION BY label) AS n FROM embeddings),
parts AS (SELECT label, i, n, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) - 1 AS dim FROM ranked)"""
_EMA = f"""{_VEC}, sums AS (SELECT label, dim, sum(x * CASE WHEN i = 1 THEN power(95e-2, n - 1) ELSE (1e0 - 95e-2) * power(95e-2, n - i) END) AS x FROM parts GROUP BY label, dim),
unit AS (SELECT label, dim, x / sqrt(sum(x * x) OVER (PARTITION BY label)) AS x FROM sums)"""
_P = f"WITH {EVALUATED_SQL}, pred AS (SELECT account, id, round(score, 6) AS score, should_flag, anomaly_type, attack_phase, mechanism, weighted FROM {VERDICT})"
_COUNTS = "CAST(count_if(should_flag AND score > 6e-1) AS BIGINT) AS tp, CAST(count_if(NOT should_flag AND score <= 6e-1) AS BIGINT) AS tn, CAST(count_if(NOT should_flag AND score > 6e-1) AS BIGINT) AS fp, CAST(count_if(should_flag AND score <= 6e-1) AS BIGINT) AS fn"


def _div(a: str, b: str) -> str:
    return f"coalesce(CAST({a} AS DOUBLE) / nullif(CAST({b} AS DOUBLE), 0), 0)"


_PR = f"{_div('tp', 'tp + fp')} AS precision, {_div('tp', 'tp + fn')} AS recall"
_F1 = _div("2 * precision * recall", "precision + recall")
SQL = {
    "ema_centroid": f"WITH {_EMA} SELECT CAST(label AS BIGINT) AS label, CAST(dim AS BIGINT) AS dim, round(x, 6) AS x FROM unit",
    "recency_centroid": f"""WITH {_VEC}, sums AS (SELECT label, dim, sum(x * exp(CASE WHEN n = 1 THEN -1e0 ELSE -1e0 + (i - 1) / (n - 1) END)) AS x FROM parts GROUP BY label, dim)
SELECT CAST(label AS BIGINT) AS label, CAST(dim AS BIGINT) AS dim, round(x / sqrt(sum(x * x) OVER (PARTITION BY label)), 6) AS x FROM sums""",
    "cosine_score": f"""WITH {_EMA}, flat AS (SELECT vec_id, label, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) - 1 AS dim FROM embeddings),
c AS (SELECT vec_id, greatest(-1e0, least(1e0, sum(f.x * u.x) / (sqrt(sum(f.x * f.x)) * sqrt(sum(u.x * u.x))))) AS c FROM flat f JOIN unit u USING (label, dim) GROUP BY vec_id)
SELECT vec_id, round(c, 6) AS cosine, round(least(1e0, (1 - c) / 2), 6) AS score FROM c""",
    "standardise": """WITH flat AS (SELECT vec_id, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) AS dim FROM embeddings), s AS (SELECT dim, avg(x) AS m, stddev_pop(x) AS d FROM flat GROUP BY dim)
SELECT vec_id, round(sum(power((x - m) / (d + 1e-8), 2)), 5) AS sum_of_squares FROM flat JOIN s USING (dim) GROUP BY vec_id""",
    "confusion": f"""{_P}, c AS (SELECT {_COUNTS} FROM pred), r AS (SELECT *, {_PR} FROM c)
SELECT tp, tn, fp, fn, round(precision, 6) AS precision, round(recall, 6) AS recall, round({_F1}, 6) AS f1, round({_div('tp + tn', 'tp + tn + fp + fn')}, 6) AS accuracy, round({_div('fp', 'fp + tn')}, 6) AS fpr, round({_div('fn', 'fn + tp')}, 6) AS fnr,
  round({_div('tp * tn - fp * fn', 'sqrt((tp + fp)::DOUBLE * (tp + fn) * (tn + fp) * (tn + fn))')}, 6) AS mcc FROM r""",
    "per_class": f"""{_P}, k AS (SELECT 'anomaly_type' AS key, coalesce(nullif(lower(trim(anomaly_type)), ''), 'benign') AS cls, should_flag, score FROM pred UNION ALL SELECT 'attack_phase', coalesce(nullif(lower(trim(attack_phase)), ''), 'benign'), should_flag, score FROM pred),
cnt AS (SELECT key, cls, {_COUNTS} FROM k GROUP BY key, cls), r AS (SELECT *, {_PR} FROM cnt)
SELECT key, cls, tp + tn + fp + fn AS support, round(precision, 6) AS precision, round(recall, 6) AS recall, round({_F1}, 6) AS f1 FROM r""",
    "roc_auc": f"""{_P}, g AS (SELECT score, count_if(should_flag) AS pos, count_if(NOT should_flag) AS neg FROM pred GROUP BY score), b AS (SELECT *, coalesce(sum(neg) OVER (ORDER BY score ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS below FROM g)
SELECT CAST(sum(pos) AS BIGINT) AS n_pos, CAST(sum(neg) AS BIGINT) AS n_neg, round(sum(pos * (below + neg / 2e0)) / (sum(pos)::DOUBLE * sum(neg)), 6) AS auc FROM b""",
    "avg_precision": f"""{_P}, g AS (SELECT score, count_if(should_flag) AS pos, count(*) AS n FROM pred GROUP BY score), cum AS (SELECT *, sum(pos) OVER (ORDER BY score DESC) AS tp, sum(n) OVER (ORDER BY score DESC) AS alln FROM g)
SELECT CASE WHEN coalesce(sum(pos), 0) IN (0, sum(n)) THEN 5e-1 ELSE round(sum(pos * (tp::DOUBLE / alln)) / sum(pos), 6) END AS average_precision FROM cum""",
    "attribution": f"{_P}, h AS (SELECT mechanism, count(*) AS n FROM pred WHERE should_flag AND score > 6e-1 GROUP BY mechanism) SELECT mechanism, n, round(1e2 * n / sum(n) OVER (), 1) AS pct FROM h",
    "latency_percentiles": "SELECT round(avg(value), 6) AS mean, round(quantile_cont(value, 0.5), 6) AS median, round(quantile_cont(value, 0.95), 6) AS p95 FROM events",
    "split_80_20": f"""WITH m AS (SELECT message_id, {key_sql('user_id')} AS account, {instant_sql('timestamp')} AS us FROM (SELECT *, row_number() OVER (PARTITION BY message_id ORDER BY ingested_at DESC) AS rn FROM messages) WHERE rn = 1)
SELECT message_id, CASE WHEN row_number() OVER (PARTITION BY account ORDER BY us, message_id) <= floor(count(*) OVER (PARTITION BY account) * 8e-1) THEN 'train' ELSE 'test' END AS part FROM m WHERE account IS NOT NULL AND us IS NOT NULL""",
    "sample_users": "SELECT user_id, max(coalesce(is_anomaly, false)) AS has_anomaly FROM message_records WHERE user_id IS NOT NULL GROUP BY user_id ORDER BY has_anomaly DESC, user_id LIMIT 20",
}
