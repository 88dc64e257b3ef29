"""Queries on what is learned from history and on whole evaluations, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from driftlens.functions import text as T
from driftlens.functions.encoders import WIDTH, hashed_bag
from driftlens.functions.timestamps import iso_wall
from driftlens.operators import evaluation, explain, learners, profiles, scoring
from driftlens.plans.events import instant_sql, key_sql
from driftlens.plans.features import HISTORY_SQL, words_sql
from driftlens.plans.scoring import FACTS_SQL, built, slots_sql
from driftlens.sources.tables import spread, table, tables
from driftlens.storage import cut


def weighted_style(spark: SparkSession, folder: str) -> DataFrame:
    made = learners.weighted_style(profiles.history(table(spark, folder, "message_records")))
    return made.select("user_id", *[F.round(c, 8).alias(c) for c in made.columns if c != "user_id"])


def learned_timing(spark: SparkSession, folder: str) -> DataFrame:
    made = learners.learned_timing(profiles.history(table(spark, folder, "message_records")))
    return made.select("user_id", F.round("typical_gap", 4).alias("typical_gap"), F.array_join("active_hours", ",").alias("active_hours"), "typical_duration", "frequency")


def quick_profile(spark: SparkSession, folder: str) -> DataFrame:
    records, users = tables(spark, folder, "message_records", "users")
    made = learners.quick_profiles(profiles.history(records), users)
    return made.select("user_id", "n_history", F.round("p_tokens", 9).alias("p_tokens"), F.round("p_chars", 9).alias("p_chars"), "p_sensitive", F.array_join("hours", ",").alias("hours"), "last_us", "complexity")


def example_topics(spark: SparkSession, folder: str) -> DataFrame:
    return learners.example_topics(table(spark, folder, "message_records")).select("user_id", F.array_join("topics", "|").alias("topics"))


def centroids(spark: SparkSession, folder: str, decay: float = 0.95) -> DataFrame:
    """The centroid of each user's history, a row per slot that isn't 0."""
    made = profiles.centroids(table(spark, folder, "message_records"), hashed_bag, decay)
    return made.select("user_id", F.posexplode("centroid").alias("slot", "x")).where("x != 0").select("user_id", F.col("slot").cast("long").alias("slot"), F.round("x", 6).alias("x"))


def decay_sweep(spark: SparkSession, folder: str) -> DataFrame:
    """Centroids at three decays, by the largest slot's weight."""
    parts = [centroids(spark, folder, d).groupBy("user_id").agg(F.max("x").alias("largest"), F.count(F.lit(1)).alias("n_slots")).withColumn("decay", F.lit(d)) for d in evaluation.DECAYS]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


def feature_vectors(spark: SparkSession, folder: str) -> DataFrame:
    """The vectors of fitted detectors: the own features, and the sum of the embedding."""
    rows = spread(table(spark, folder, "message_records").where("record_id IS NOT NULL").dropDuplicates(["record_id"]).select("record_id", "text", "timestamp"))
    v = rows.select("record_id", learners.feature_vector(F.coalesce("text", F.lit("")), iso_wall(F.col("timestamp"))).alias("v"))
    names = ["n_words", "n_chars", "lex", "question", "code", "hour", "weekday"]
    return v.select("record_id", *[F.round(F.col("v")[WIDTH + i], 8).alias(n) for i, n in enumerate(names)], F.aggregate(F.slice("v", 1, WIDTH), F.lit(0.0), lambda a, x: a + x * x).alias("embedding_squares"))


def z_values(spark: SparkSession, folder: str) -> DataFrame:
    rows = scoring.prepared(table(spark, folder, "messages"), built(spark, folder)).withColumn("style", explain.z_values())
    return rows.select(F.col("id").alias("message_id"), *[F.round(F.col("style")[i]["z"], 6).alias(n) for i, n in enumerate(("z_length", "z_diversity", "z_formality", "z_politeness"))])


def training_rows(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "message_records").where("record_id IS NOT NULL").dropDuplicates(["record_id"]).select("user_id", F.unix_micros(scoring.iso_instant(F.col("timestamp"))).alias("us"), "record_id", "is_anomaly").where("us IS NOT NULL")
    return learners.training_rows(rows, "user_id", ["us", "record_id"]).select("user_id", "record_id")


def minimum_history(spark: SparkSession, folder: str) -> DataFrame:
    return learners.enough(profiles.history(table(spark, folder, "message_records")), "user_id")


def cold_coverage(spark: SparkSession, folder: str) -> DataFrame:
    return learners.cold_coverage(evaluation.split_messages(table(spark, folder, "messages")), "account").select("n_users", "n_cold", F.round("cold_pct", 6).alias("cold_pct"))


def evaluation_measures(spark: SparkSession, folder: str) -> DataFrame:
    """Detectors by source: trained on the first part of each account's messages, judged on the rest; all accounts."""
    messages, users = tables(spark, folder, "messages", "users")
    made = evaluation.predictions(evaluation.split_messages(messages), users, ("rule_based", "content_safety"))
    rows = evaluation.measures(made)
    return rows.select("dataset", "method", "tp", "tn", "fp", "fn", *[F.round(c, 6).alias(c) for c in ("precision", "recall", "f1", "accuracy", "fpr", "fnr", "tpr", "tnr", "mcc", "auc", "average_precision")])


def evaluation_run(spark: SparkSession, folder: str) -> DataFrame:
    """The full system, its ablations and levels, and the fitted detectors beside it, by source; the 20 accounts of the sample."""
    messages, users = tables(spark, folder, "messages", "users")
    out = evaluation.run(messages, users, decays=(0.95,))
    return out["measures"].unionByName(out["ablations"]).unionByName(out["levels"]).unionByName(out["decays"]).select("dataset", "method", "tp", "tn", "fp", "fn", F.round("f1", 6).alias("f1"), F.round("auc", 6).alias("auc"))


QUERIES = {f.__name__: f for f in (weighted_style, learned_timing, quick_profile, example_topics, centroids, decay_sweep, feature_vectors, z_values, training_rows, minimum_history, cold_coverage, evaluation_measures, evaluation_run)}

_RANKED = "ranked AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY us, id) AS i, count(*) OVER (PARTITION BY user_id) AS n, us - lag(us) OVER (PARTITION BY user_id ORDER BY us, id) AS gap_us FROM hist), weighed AS (SELECT *, exp(CASE WHEN n = 1 THEN -1e0 ELSE -1e0 + (i - 1) / (n - 1) END) AS w FROM ranked)"
_STYLE = {"length_tokens": "n_tokens", "lexical_diversity": "lex", "formality": "formality", "politeness": "polite"}
_CENT = "SELECT user_id, slot, x / sqrt(sum(x * x) OVER (PARTITION BY user_id)) AS x FROM (SELECT user_id, slot, sum(CASE WHEN i = 1 THEN power({d}, n - 1) ELSE (1e0 - {d}) * power({d}, n - i) END) AS x FROM (SELECT user_id, i, n, unnest({s}) AS slot FROM ranked) GROUP BY ALL)"
_SLOTTED = slots_sql("array_to_string(ws, ' ')")
_T = "coalesce(text, '')"
_WS = words_sql(_T)
_CLOCK = r"regexp_replace(regexp_replace(trim(timestamp), '^([0-9]{4})([0-9]{2})([0-9]{2})[Tt ]([0-9]{2})', '\1-\2-\3T\4'), ' ', 'T')"
_ONCE = "(SELECT *, row_number() OVER (PARTITION BY record_id) AS rn FROM message_records WHERE record_id IS NOT NULL)"
_PARTS = f"""m AS (SELECT message_id, {key_sql('user_id')} AS account, {instant_sql('timestamp')} AS us, coalesce(source, 'unknown') AS dataset, coalesce(should_flag, false) AS should_flag, coalesce(is_anomaly, false) AS anomaly, coalesce(message_text, '') AS text
  FROM (SELECT *, row_number() OVER (PARTITION BY message_id ORDER BY ingested_at DESC) AS rn FROM messages) WHERE rn = 1),
parts AS (SELECT *, row_number() OVER (PARTITION BY account ORDER BY us, message_id) <= floor(count(*) OVER (PARTITION BY account) * 8e-1) AS train FROM m WHERE account IS NOT NULL AND us IS NOT NULL)"""


def _measures_sql(pred: str) -> str:
    """Measures by dataset and method from predictions in ``pred``."""

    def div(a: str, b: str) -> str:
        return f"coalesce(CAST({a} AS DOUBLE) / nullif(CAST({b} AS DOUBLE), 0), 0)"

    pr, rc = div("a", "a + c"), div("a", "a + d")
    zero = "a + d = 0 OR b + c = 0"
    rates = {"fpr": div("c", "c + b"), "fnr": div("d", "d + a"), "tpr": rc, "tnr": div("b", "b + c"), "mcc": div("a * b - c * d", "sqrt((a + c)::DOUBLE * (a + d) * (b + c) * (b + d))")}
    return f"""cnt AS (SELECT dataset, method, CAST(count_if(should_flag AND score > 6e-1) AS BIGINT) AS a, CAST(count_if(NOT should_flag AND score <= 6e-1) AS BIGINT) AS b, CAST(count_if(NOT should_flag AND score > 6e-1) AS BIGINT) AS c, CAST(count_if(should_flag AND score <= 6e-1) AS BIGINT) AS d FROM {pred} GROUP BY ALL),
g AS (SELECT dataset, method, score, count_if(should_flag) AS pos, count_if(NOT should_flag) AS neg FROM {pred} GROUP BY ALL),
cum AS (SELECT *, sum(neg) OVER (PARTITION BY dataset, method ORDER BY score) - neg AS below, sum(pos) OVER (PARTITION BY dataset, method ORDER BY score DESC) AS tps, sum(pos + neg) OVER (PARTITION BY dataset, method ORDER BY score DESC) AS alls FROM g),
rk AS (SELECT dataset, method, CASE WHEN sum(pos) = 0 OR sum(neg) = 0 THEN 5e-1 ELSE sum(pos * (below + neg / 2e0)) / (sum(pos)::DOUBLE * sum(neg)) END AS auc, CASE WHEN sum(pos) = 0 OR sum(neg) = 0 THEN 5e-1 ELSE sum(pos * (tps::DOUBLE / alls)) / sum(pos) END AS ap FROM cum GROUP BY ALL)
SELECT dataset, method, {', '.join(f'CASE WHEN {zero} THEN 0 ELSE {x} END AS {n}' for n, x in (('tp', 'a'), ('tn', 'b'), ('fp', 'c'), ('fn', 'd')))}, round({pr}, 6) AS precision, round({rc}, 6) AS recall,
  round({div(f'2 * {pr} * {rc}', f'{pr} + {rc}')}, 6) AS f1, round({div('a + b', 'a + b + c + d')}, 6) AS accuracy, {', '.join(f'CASE WHEN {zero} THEN 0e0 ELSE round({x}, 6) END AS {n}' for n, x in rates.items())}, round(auc, 6) AS auc, round(ap, 6) AS average_precision
FROM cnt JOIN rk USING (dataset, method)"""


def _evaluation_sql() -> str:
    from driftlens.plans import scoring as P

    rules = " + ".join(f"CASE WHEN {c} THEN {s} ELSE 0e0 END" for c, s, _ in P.RULES_SQL)
    return f"""WITH {_PARTS}, held AS (SELECT account FROM parts WHERE train AND NOT anomaly GROUP BY account HAVING count(*) >= 3), test AS (SELECT * FROM parts WHERE NOT train AND account IN (SELECT account FROM held)),
rated AS (SELECT *, count(*) OVER (PARTITION BY account ORDER BY us RANGE BETWEEN 60000000 PRECEDING AND CURRENT ROW) AS recent FROM test),
{P.SAFETY_CTES.replace('{source}', '(SELECT message_id, text AS t FROM test)')},
pred AS (SELECT dataset, 'rule_based' AS method, should_flag, least({rules}, 1e0) AS score FROM rated UNION ALL SELECT dataset, 'content_safety', should_flag, round(f, 3) FROM final JOIN test USING (message_id)),
{_measures_sql('pred')}"""


SQL = {
    "weighted_style": f"""WITH {HISTORY_SQL}, {_RANKED}, m AS (SELECT user_id, {', '.join(f'sum(w * {c}) / sum(w) AS {k}_mean' for k, c in _STYLE.items())} FROM weighed GROUP BY user_id)
SELECT user_id, {', '.join(f'round({k}_mean, 8) AS {k}_mean' for k in _STYLE)}, {', '.join(f'round(greatest(sqrt(sum(w * power({c} - {k}_mean, 2)) / sum(w)), 1e-2), 8) AS {k}_std' for k, c in _STYLE.items())}
FROM weighed JOIN m USING (user_id) GROUP BY user_id, {', '.join(f'{k}_mean' for k in _STYLE)}""",
    "learned_timing": f"""WITH {HISTORY_SQL}, {_RANKED}, h AS (SELECT user_id, hour, count(*) AS k, any_value(n) AS n FROM ranked GROUP BY user_id, hour), a AS (SELECT user_id, array_to_string(list(hour ORDER BY hour), ',') AS hrs FROM h WHERE CAST(k AS DOUBLE) / n > 1e-1 GROUP BY user_id)
SELECT user_id, round(sum(w * coalesce(gap_us / 1e6, 30e0)) / sum(w), 4) AS typical_gap, coalesce(any_value(hrs), '') AS active_hours, 45e0 AS typical_duration, 5e0 AS frequency FROM weighed LEFT JOIN a USING (user_id) GROUP BY user_id""",
    "quick_profile": f"WITH {HISTORY_SQL} SELECT user_id, count(*) AS n_history, round(avg(n_tokens), 9) AS p_tokens, round(avg(n_chars), 9) AS p_chars, bool_or(sensitive) AS p_sensitive, array_to_string(list_sort(list(DISTINCT hour)), ',') AS hours, max(us) AS last_us, 'moderate' AS complexity FROM hist GROUP BY user_id HAVING count(*) >= 3",
    "example_topics": f"""WITH r AS (SELECT user_id, {instant_sql('timestamp')} AS us, record_id AS id, list_transform(list_filter({_WS}, lambda x: length(x) > 4), lambda x: lower(x)) AS ws FROM {_ONCE} WHERE rn = 1),
w AS (SELECT user_id, us, id, unnest(ws) AS word, generate_subscripts(ws, 1) AS pos FROM r WHERE user_id IS NOT NULL AND us IS NOT NULL),
c AS (SELECT user_id, word, count(*) AS n, min((us, id, pos)) AS place FROM w GROUP BY ALL), k AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY n DESC, place) AS r FROM c)
SELECT user_id, array_to_string(list(word ORDER BY r), '|') AS topics FROM k WHERE r <= 8 GROUP BY user_id""",
    "centroids": f"WITH {HISTORY_SQL}, {_RANKED} SELECT user_id, CAST(slot AS BIGINT) AS slot, round(x, 6) AS x FROM ({_CENT.format(d='95e-2', s=_SLOTTED)}) WHERE x <> 0",
    "decay_sweep": f"WITH {HISTORY_SQL}, {_RANKED} " + " UNION ALL ".join(f"SELECT user_id, max(round(x, 6)) AS largest, count(*) AS n_slots, {d}::DOUBLE AS decay FROM ({_CENT.format(d=f'{d}e0', s=_SLOTTED)}) WHERE x <> 0 GROUP BY user_id" for d in evaluation.DECAYS),
    "feature_vectors": f"""SELECT record_id, CAST(len(ws) AS DOUBLE) AS n_words, CAST(length(t) AS DOUBLE) AS n_chars, round(CAST(len(list_distinct(ws)) AS DOUBLE) / greatest(len(ws), 1), 8) AS lex,
  round(CAST(length(t) - length(replace(t, '?', '')) AS DOUBLE) / (length(t) - length(replace(t, '.', '')) + 1), 8) AS question, (contains(lower(t), 'code') OR contains(t, 'def ') OR contains(t, 'function'))::INT::DOUBLE AS code,
  round(CAST(substr(clock, 12, 2) AS INT) / 24e0, 8) AS hour, round((isodow(TRY_CAST(substr(clock, 1, 10) AS DATE)) - 1) / 7e0, 8) AS weekday,
  coalesce(list_sum(list_transform(range(0, {WIDTH}), lambda d: power(len(list_filter(slots, lambda s: s = d)), 2))), 0)::DOUBLE AS embedding_squares
FROM (SELECT record_id, {_T} AS t, {_WS} AS ws, CASE WHEN {instant_sql('timestamp')} IS NOT NULL THEN {_CLOCK} END AS clock, {slots_sql(_T)} AS slots FROM {_ONCE} WHERE rn = 1)""",
    "z_values": f"WITH {FACTS_SQL} SELECT id AS message_id, round((n_tokens - p_tokens) / greatest(p_lex_std * p_tokens, 1e0), 6) AS z_length, round((lex - p_lex) / greatest(p_lex_std, 1e-2), 6) AS z_diversity, round((formality - p_formality) / greatest(p_formality_std, 1e-2), 6) AS z_formality, round((polite - p_polite) / greatest(p_polite_std, 1e-2), 6) AS z_politeness FROM facts",
    "training_rows": f"""WITH r AS (SELECT user_id, record_id, {instant_sql('timestamp')} AS us, coalesce(is_anomaly, false) AS anomaly FROM {_ONCE} WHERE rn = 1), u AS (SELECT DISTINCT user_id FROM r WHERE us IS NOT NULL AND user_id IS NOT NULL ORDER BY user_id LIMIT 20)
SELECT user_id, record_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY us, record_id) AS i FROM r WHERE us IS NOT NULL AND NOT anomaly AND user_id IN (SELECT user_id FROM u)) WHERE i <= 10""",
    "minimum_history": f"WITH {HISTORY_SQL} SELECT user_id FROM hist GROUP BY user_id HAVING count(*) >= 3",
    "cold_coverage": f"WITH {_PARTS}, u AS (SELECT account, count_if(train) AS n FROM parts GROUP BY account) SELECT count(*) AS n_users, CAST(count_if(n < 10) AS BIGINT) AS n_cold, round(1e2 * count_if(n < 10) / count(*), 6) AS cold_pct FROM u",
    "evaluation_measures": _evaluation_sql(),
}
