"""Queries over texts and profiles."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from driftlens.functions import lexicons as X
from driftlens.functions import text as T
from driftlens.operators import profiles
from driftlens.plans.events import instant_sql
from driftlens.sources.tables import spread, table, tables


def _read(spark: SparkSession, folder: str) -> DataFrame:
    """``(message_id, t, h)``: texts of messages, and a hash by which equal ones of a message are known after their features have been worked out."""
    t = F.coalesce("message_text", F.lit(""))
    return spread(table(spark, folder, "messages").select("message_id", t.alias("t"))).withColumn("h", F.xxhash64("t"))


def text_features(spark: SparkSession, folder: str) -> DataFrame:
    rows = _read(spark, folder).select("message_id", "h", "t", F.lower("t").alias("low"), T.words(F.col("t")).alias("ws"), T.topics(F.col("t")).alias("topics"))
    seen = rows.select(
        "message_id", "h", F.size("ws").cast("long").alias("n_tokens"), F.length("t").cast("long").alias("n_chars"), F.round(T.lexical_diversity(F.col("ws")), 6).alias("lex"),
        F.round(T.lexical_diversity(F.col("ws"), fold=False), 6).alias("lex_cased"), F.round(T.question_ratio(F.col("t")), 6).alias("question"), F.least(F.lit(1.0), F.size("ws") / 50.0).alias("formality"),
        T.contains_any(F.col("low"), X.POLITE_BUILD).alias("polite"), T.contains_any(F.col("t"), ["def ", "```"]).alias("code"), F.contains("t", F.lit("http")).alias("urls"),
        T.contains_any(F.col("low"), X.TECH_WORDS).alias("tech"), F.size("topics").cast("long").alias("n_topics"), F.array_join(F.array_sort(T.topic_words(F.col("ws"))), " ").alias("topic_words"),
    )
    return seen.dropDuplicates(["message_id", "h"]).drop("h")


def operation_risk(spark: SparkSession, folder: str) -> DataFrame:
    return _read(spark, folder).select("message_id", "h", T.operation_risk(F.col("t")).alias("inferred_risk")).dropDuplicates(["message_id", "h"]).drop("h")


def profile_full(spark: SparkSession, folder: str) -> DataFrame:
    rounded = ["p_tokens", "p_chars", "p_lex", "p_lex_std", "p_formality", "p_formality_std", "p_polite", "p_polite_std", "p_question", "p_session_minutes", "p_longest_minutes", "p_gap", "p_per_session", "p_frequency", "p_diversity"]
    made = profiles.build(*tables(spark, folder, "message_records", "users"))
    return made.select(
        "user_id", "n_history", "p_tech", "p_code", "p_sensitive", "last_us", "complexity", F.array_join(F.transform("hours", lambda h: h.cast("string")), ",").alias("hours"), F.array_join("days", ",").alias("days"),
        F.array_join("topics", ",").alias("topics"), *[F.round(c, 9).alias(c) for c in rounded],
    )


def profile_sessions(spark: SparkSession, folder: str) -> DataFrame:
    made = profiles.session_statistics(profiles.history(table(spark, folder, "message_records")))
    return made.select("user_id", "n_sessions", *[F.round(c, 9).alias(c) for c in ("p_session_minutes", "p_longest_minutes", "p_per_session")])


def topk_words(spark: SparkSession, folder: str) -> DataFrame:
    return profiles.topics(profiles.history(table(spark, folder, "message_records"))).select("user_id", F.array_join("topics", ",").alias("topics"))


QUERIES = {f.__name__: f for f in (text_features, operation_risk, profile_full, profile_sessions, topk_words)}

_WS = r"list_filter(string_split_regex({t}, '[\s\p{{Z}}]+'), lambda x: x <> '')"


def words_sql(t: str) -> str:
    return _WS.format(t=t)


def any_sql(t: str, phrases: list[str]) -> str:
    return "(" + " OR ".join(f"contains({t}, '{p.replace(chr(39), chr(39) * 2)}')" for p in phrases) + ")"


def count_sql(t: str, patterns: list[str]) -> str:
    return " + ".join(f"regexp_matches({t}, '{T.sql_regex(p)}', 'is')::INT" for p in patterns)


def risk_sql(t: str) -> str:
    n = rf"trim(regexp_replace(lower({t}), '[\s\p{{Z}}]+', ' ', 'g'))"
    return f"CASE WHEN {n} = '' THEN 'low' WHEN {count_sql(n, X.CRITICAL_OPS)} > 0 THEN 'critical' WHEN {count_sql(n, X.HIGH_OPS)} > 0 THEN 'high' ELSE 'low' END"


STOP_SQL = "[" + ", ".join(f"'{w}'" for w in X.STOPWORDS) + "]"
TOPICS_SQL = rf"list_distinct(list_filter(string_split_regex(regexp_replace(lower({{t}}), '[^\p{{{{L}}}}\p{{{{N}}}}_\s]', ' ', 'g'), '[\s\p{{{{Z}}}}]+'), lambda x: length(x) > 2 AND NOT list_contains({STOP_SQL}, x)))"
TOPIC_WORDS_SQL = r"list_transform(list_filter({ws}, lambda x: length(x) > 4 AND regexp_full_match(x, '\p{{L}}+')), lambda x: lower(x))"
_QUESTION = "CAST(length({t}) - length(replace({t}, '?', '')) AS DOUBLE) / (length({t}) - length(replace({t}, '.', '')) + 1)"
_LEX = "CAST(len(list_distinct({ws})) AS DOUBLE) / greatest(len({raw}), 1)"
HISTORY_SQL = rf"""hist AS (
  SELECT user_id, id, us, session, CAST(substr(clock, 12, 2) AS INT) AS hour, dayname(CAST(substr(clock, 1, 10) AS DATE)) AS day, len(ws) AS n_tokens, length(t) AS n_chars, ws,
    {_LEX.format(ws='list_transform(ws, lambda x: lower(x))', raw='ws')} AS lex, {_QUESTION.format(t='t')} AS question, least(1.0::DOUBLE, len(ws) / 50.0::DOUBLE) AS formality,
    {any_sql('lower(t)', X.POLITE_BUILD)}::INT::DOUBLE AS polite, {any_sql('t', ['def ', '```'])} AS code, {any_sql('lower(t)', X.TECH_WORDS)} AS tech,
    coalesce(lower(trim(operation_risk)) IN ('high', 'critical'), false) AS sensitive
  FROM (SELECT user_id, record_id AS id, {instant_sql('timestamp')} AS us, coalesce(session_id, 'default') AS session, coalesce(text, '') AS t, operation_risk,
      regexp_replace(regexp_replace(trim(timestamp), '^([0-9]{{4}})([0-9]{{2}})([0-9]{{2}})[Tt ]([0-9]{{2}})', '\1-\2-\3T\4'), ' ', 'T') AS clock, {words_sql("coalesce(text, '')")} AS ws, coalesce(is_anomaly, false) AS anomaly,
      row_number() OVER (PARTITION BY record_id) AS rn FROM message_records)
  WHERE rn = 1 AND user_id IS NOT NULL AND us IS NOT NULL AND NOT anomaly)"""
SESSION_SQL = """sess AS (SELECT user_id, coalesce(avg(CASE WHEN n >= 2 THEN minutes END), 30.0::DOUBLE) AS p_session_minutes, coalesce(max(CASE WHEN n >= 2 THEN minutes END), 60.0::DOUBLE) AS p_longest_minutes,
    CAST(sum(n) AS DOUBLE) / count(*) AS p_per_session, count(*) AS n_sessions
  FROM (SELECT user_id, session, count(*) AS n, (max(us) - min(us)) / 6e7 AS minutes FROM hist GROUP BY user_id, session) GROUP BY user_id)"""


def _top_sql(name: str, source: str, value: str, place: str, k: int) -> str:
    return f"""{name} AS (SELECT user_id, array_to_string(list(v ORDER BY r), ',') AS {name}, count(*) AS n_{name} FROM (
    SELECT user_id, v, row_number() OVER (PARTITION BY user_id ORDER BY n DESC, place) AS r FROM (SELECT user_id, CAST({value} AS VARCHAR) AS v, count(*) AS n, min({place}) AS place FROM {source} GROUP BY user_id, v)) WHERE r <= {k} GROUP BY user_id)"""


WORDS_SQL = f"said AS (SELECT user_id, us, id, unnest(w) AS word, generate_subscripts(w, 1) AS pos FROM (SELECT user_id, us, id, {TOPIC_WORDS_SQL.format(ws='ws')} AS w FROM hist))"
PROFILE_SQL = f"""{HISTORY_SQL}, {SESSION_SQL}, {WORDS_SQL}, {_top_sql('hours', 'hist', 'hour', '(us, id)', 6)}, {_top_sql('days', 'hist', 'day', '(us, id)', 5)}, {_top_sql('topics', 'said', 'word', '(us, id, pos)', 10)},
gap AS (SELECT user_id, coalesce(avg(s) FILTER (s > 0 AND s < 3600), 30.0::DOUBLE) AS p_gap FROM (SELECT user_id, (us - lag(us) OVER (PARTITION BY user_id ORDER BY us, id)) / 1e6 AS s FROM hist) GROUP BY user_id),
age AS (SELECT user_id, arg_max(coalesce(account_age_days, -1), updated_at) AS age FROM users GROUP BY user_id),
stat AS (SELECT user_id, count(*) AS n_history, avg(n_tokens) AS p_tokens, avg(n_chars) AS p_chars, avg(lex) AS p_lex, greatest(coalesce(stddev_samp(lex), 0), 0.01::DOUBLE) AS p_lex_std, avg(formality) AS p_formality,
    greatest(coalesce(stddev_samp(formality), 0), 0.01::DOUBLE) AS p_formality_std, avg(polite) AS p_polite, greatest(coalesce(stddev_samp(polite), 0), 0.01::DOUBLE) AS p_polite_std, avg(question) AS p_question,
    bool_or(tech) AS p_tech, bool_or(code) AS p_code, bool_or(sensitive) AS p_sensitive, max(us) AS last_us FROM hist GROUP BY user_id),
prof AS (SELECT stat.*, p_gap, p_session_minutes, p_longest_minutes, p_per_session, hours, days, coalesce(topics, 'general') AS topics, n_hours, coalesce(n_topics, 1) AS n_typical_all, least(1.0::DOUBLE, coalesce(n_topics, 0) / 10.0::DOUBLE) AS p_diversity,
    least(n_sessions / greatest(greatest(coalesce(age, 0), 0) / 7.0::DOUBLE, 1.0::DOUBLE), 14.0::DOUBLE) AS p_frequency,
    CASE WHEN p_tokens > 40 THEN 'complex' WHEN p_tokens > 15 THEN 'moderate' ELSE 'simple' END AS complexity
  FROM stat JOIN gap USING (user_id) JOIN sess USING (user_id) JOIN hours USING (user_id) JOIN days USING (user_id) LEFT JOIN topics USING (user_id) LEFT JOIN age USING (user_id))"""
_R = ", ".join(f"round({c}, 9) AS {c}" for c in "p_tokens p_chars p_lex p_lex_std p_formality p_formality_std p_polite p_polite_std p_question p_session_minutes p_longest_minutes p_gap p_per_session p_frequency p_diversity".split())
SQL = {
    "text_features": f"""SELECT message_id, len(ws) AS n_tokens, length(t) AS n_chars, round({_LEX.format(ws='list_transform(ws, lambda x: lower(x))', raw='ws')}, 6) AS lex, round({_LEX.format(ws='ws', raw='ws')}, 6) AS lex_cased,
  round({_QUESTION.format(t='t')}, 6) AS question, least(1.0::DOUBLE, len(ws) / 50.0::DOUBLE) AS formality, {any_sql('lower(t)', X.POLITE_BUILD)} AS polite, {any_sql('t', ['def ', '```'])} AS code, contains(t, 'http') AS urls,
  {any_sql('lower(t)', X.TECH_WORDS)} AS tech, len({TOPICS_SQL.format(t='t')}) AS n_topics, array_to_string(list_sort({TOPIC_WORDS_SQL.format(ws='ws')}), ' ') AS topic_words
FROM (SELECT message_id, t, {words_sql('t')} AS ws FROM (SELECT DISTINCT message_id, coalesce(message_text, '') AS t FROM messages))""",
    "operation_risk": f"SELECT message_id, {risk_sql('t')} AS inferred_risk FROM (SELECT DISTINCT message_id, coalesce(message_text, '') AS t FROM messages)",
    "profile_full": f"WITH {PROFILE_SQL} SELECT user_id, n_history, p_tech, p_code, p_sensitive, last_us, complexity, hours, days, topics, {_R} FROM prof",
    "profile_sessions": f"WITH {HISTORY_SQL}, {SESSION_SQL} SELECT user_id, n_sessions, round(p_session_minutes, 9) AS p_session_minutes, round(p_longest_minutes, 9) AS p_longest_minutes, round(p_per_session, 9) AS p_per_session FROM sess",
    "topk_words": f"WITH {HISTORY_SQL}, {WORDS_SQL}, {_top_sql('topics', 'said', 'word', '(us, id, pos)', 10)} SELECT user_id, topics FROM topics",
}
