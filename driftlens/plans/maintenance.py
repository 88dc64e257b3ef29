"""Queries on profiles that are kept current, and on input that is checked."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from driftlens.operators import profiles, scoring
from driftlens.plans.features import HISTORY_SQL
from driftlens.plans.events import instant_sql, key_sql
from driftlens.sources import history
from driftlens.sources.tables import table, tables
from driftlens.streaming import online


def online_update(spark: SparkSession, folder: str) -> DataFrame:
    """Profiles after a fold over all records; the columns that an average also gives."""
    made = online.replay(table(spark, folder, "message_records"))
    return made.select("user_id", "n_history", *[F.round(c, 9).alias(c) for c in ("p_tokens", "p_chars", "p_lex", "p_formality", "p_question")], "p_tech", "p_code", "last_us")


def cold_start_join(spark: SparkSession, folder: str) -> DataFrame:
    """Accounts of messages with the length of their history: 0 and the cold-start profile where there is none."""
    messages, records, users = tables(spark, folder, "messages", "message_records", "users")
    seen = messages.select("user_id").distinct().select(scoring.account_key(F.col("user_id")).alias("account")).where("account IS NOT NULL").distinct()
    held = profiles.statistics(profiles.history(records)).select(scoring.account_key(F.col("user_id")).alias("account"), "n_history", "p_tokens")
    joined = seen.join(held, "account", "left")
    return joined.select("account", F.coalesce("n_history", F.lit(0)).cast("long").alias("n_history"), F.round(F.coalesce("p_tokens", F.lit(20.0)), 9).alias("p_tokens"))


def validate_input(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "messages").select("message_id", "ingested_at", "user_id", F.col("message_text").alias("text"), "timestamp", "operation_type", "operation_risk")
    checked = history.validate(rows)
    return checked.select("message_id", "ingested_at", F.explode("_errors").alias("error")).groupBy("error").agg(F.count(F.lit(1)).alias("n"))


def safe_names(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "users").select("user_id").distinct().select("user_id", history.safe_name(F.col("user_id")).alias("safe"))


QUERIES = {f.__name__: f for f in (online_update, cold_start_join, validate_input, safe_names)}

_TYPES = "read write delete export auth_change permission_change financial admin none".split()
_IN = ", ".join(f"'{t}'" for t in _TYPES)


def _error(cond: str, text: str) -> str:
    return f"SELECT '{text}' AS error FROM messages WHERE {cond}"


SQL = {
    "online_update": f"WITH {HISTORY_SQL} SELECT user_id, count(*) AS n_history, round(avg(n_tokens), 9) AS p_tokens, round(avg(n_chars), 9) AS p_chars, round(avg(lex), 9) AS p_lex, round(avg(formality), 9) AS p_formality, round(avg(question), 9) AS p_question, bool_or(tech) AS p_tech, bool_or(code) AS p_code, max(us) AS last_us FROM hist GROUP BY user_id",
    "cold_start_join": f"""WITH {HISTORY_SQL}, seen AS (SELECT DISTINCT {key_sql('user_id')} AS account FROM messages), held AS (SELECT {key_sql('user_id')} AS account, count(*) AS n, avg(n_tokens) AS t FROM hist GROUP BY user_id)
SELECT account, coalesce(n, 0) AS n_history, round(coalesce(t, 20e0), 9) AS p_tokens FROM seen LEFT JOIN held USING (account) WHERE account IS NOT NULL""",
    "validate_input": "SELECT error, count(*) AS n FROM ("
    + " UNION ALL ".join(
        [
            *[_error(f"{c} IS NULL", f"{n}: Field required") for c, n in (("user_id", "user_id"), ("message_text", "text"), ("timestamp", "timestamp"))],
            _error(f"timestamp IS NOT NULL AND {instant_sql('timestamp')} IS NULL", "timestamp: not a date-time"),
            _error(f"operation_type NOT IN ({_IN})", f"requested_operation -> operation_type: Input should be one of {', '.join(_TYPES)}"),
            _error("operation_risk NOT IN ('low', 'medium', 'high', 'critical')", "requested_operation -> operation_risk: Input should be one of low, medium, high, critical"),
        ]
    )
    + ") GROUP BY error",
    "safe_names": r"SELECT DISTINCT user_id, regexp_replace(user_id, '[^\p{L}\p{N}_\-.]', '_', 'g') AS safe FROM users",
}
