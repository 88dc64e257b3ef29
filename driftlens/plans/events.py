"""Queries over account activity: problems 2 and 4."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from driftlens.operators import entity_features, sessions
from driftlens.sources.tables import tables
from driftlens.storage import cut


def p2_found(spark: SparkSession, folder: str) -> DataFrame:
    return entity_features.p2_found(*tables(spark, folder, "messages", "users"))


def p2_feature_table(spark: SparkSession, folder: str) -> DataFrame:
    """One row per account; the map of types is written out as an ordered string of type=count pairs."""
    wide = entity_features.feature_table(*tables(spark, folder, "messages", "users"))
    pairs = F.transform(F.map_entries("by_type"), lambda e: F.concat(e["key"], F.lit("="), e["value"]["n"].cast("string")))
    return wide.select(
        "user_id",
        "n_messages",
        "n_chars",
        F.unix_micros("first_at").alias("first_us"),
        F.unix_micros("last_at").alias("last_us"),
        F.array_join(F.array_sort(pairs), ",").alias("by_type"),
    )


def p2_maintained(spark: SparkSession, folder: str) -> DataFrame:
    """The state after two batches, split at an arrival time in the middle, the second applied to the state of the first."""
    messages, users = tables(spark, folder, "messages", "users")
    half = messages.agg(F.percentile_approx(F.unix_micros("ingested_at"), 0.5)).first()[0]
    early = F.coalesce(F.unix_micros("ingested_at") <= F.lit(half), F.lit(True))
    state, known = entity_features.apply(None, None, messages.where(early))
    state, _ = entity_features.apply(cut(state, "state"), cut(known, "versions"), messages.where(~early))
    return entity_features.named(state, messages, users).select("user_id", "event_type", F.col("n").alias("n_messages"), F.col("total_chars").alias("n_chars"), F.col("first.event_id").alias("first_message_id"), F.col("last.event_id").alias("last_message_id"))


def p4_found(spark: SparkSession, folder: str) -> DataFrame:
    return sessions.p4_found(*tables(spark, folder, "messages", "message_records", "users"))


def p4_sessions(spark: SparkSession, folder: str) -> DataFrame:
    """Sessions at three settings, cut from one tree."""
    messages, records, users = tables(spark, folder, "messages", "message_records", "users")
    tree = sessions.gap_tree(sessions.account_events(messages, records))
    parts = [
        sessions.cut(tree, s).groupBy("record_set").agg(
            F.lit(s).cast("long").alias("gap_seconds"),
            F.count(F.lit(1)).alias("n_sessions"),
            F.sum("n").alias("n_messages"),
            F.sum(F.col("end_us") - F.col("start_us")).alias("total_us"),
            F.max("n").alias("longest"),
        )
        for s in (300, 1800, 7200)
    ]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


QUERIES = {f.__name__: f for f in (p2_found, p2_feature_table, p2_maintained, p4_found, p4_sessions)}

# The account key and the instant, in SQL. RE2 has no \p{Cf} list of its own that differs, so the same classes serve.
_WIDE = "".join(chr(c) for c in [*range(0xFF10, 0xFF1A), *range(0xFF21, 0xFF3B), *range(0xFF41, 0xFF5B), 0xFF0D, 0xFF1A])
_NARROW = "".join(chr(ord(c) - 0xFEE0) for c in _WIDE)


def key_sql(c: str) -> str:
    s = f"lower(translate({c}, '{_WIDE}', '{_NARROW}'))"
    s = rf"regexp_replace({s}, '[\t\r\n]', ' ', 'g')"
    s = rf"regexp_replace({s}, '[\p{{Cf}}\p{{Cc}}]', '', 'g')"
    s = rf"""regexp_replace({s}, '^[\p{{Z}}\s"''`<>()\[\]]+|[\p{{Z}}\s"''`<>()\[\]]+$', '', 'g')"""
    s = rf"regexp_replace({s}, '^[a-z]+[:/=#][\p{{Z}}\s]*', '')"
    s = rf"regexp_replace({s}, '[\p{{Pd}}\p{{Z}}\s_.−]+', '-', 'g')"
    return rf"nullif(regexp_replace({s}, '^([a-z]+[0-9]{{2}})-?0*([0-9]+)(?:-?([a-z]+))?$', '\1-\2-\3'), '')"


def instant_sql(c: str) -> str:
    """Microseconds since the epoch."""
    basic = rf"regexp_replace(trim({c}), '^([0-9]{{4}})([0-9]{{2}})([0-9]{{2}})[Tt ]([0-9]{{2}})([0-9]{{2}})([0-9]{{2}})', '\1-\2-\3T\4:\5:\6')"
    shape = r"^[0-9]{4}-[0-9]{2}-[0-9]{2}[Tt ][0-9]{2}:[0-9]{2}:[0-9]{2}([.][0-9]{1,6})?([Zz]|[+-][0-9]{2}:?[0-9]{2})?$"
    zoned = rf"CASE WHEN regexp_matches({basic}, '([Zz]|[+-][0-9]{{2}}:?[0-9]{{2}})$') AND length({basic}) > 19 THEN {basic} ELSE {basic} || 'Z' END"
    return f"CASE WHEN regexp_matches({basic}, '{shape}') THEN epoch_us(TRY_CAST({zoned} AS TIMESTAMPTZ)) END"


_RISK = "CASE WHEN lower(trim({r})) IN ('low', 'medium', 'high', 'critical') THEN lower(trim({r})) ELSE 'unset' END"
_TYPE = "coalesce(nullif(lower(trim(detected_intent)), ''), 'unknown') || ':' || " + _RISK.format(r="operation_risk")
_LATEST = f"""latest AS (
  SELECT message_id, {key_sql('user_id')} AS account, {instant_sql('timestamp')} AS us, {_TYPE} AS event_type,
         coalesce(length(message_text), 0) AS chars
  FROM (SELECT *, row_number() OVER (PARTITION BY message_id ORDER BY ingested_at DESC) AS rn FROM messages) WHERE rn = 1)"""
_NAMES = """names AS (
  SELECT account, arg_min(spelling, (rank, -n, spelling)) AS account_id FROM (
    SELECT {ku} AS account, user_id AS spelling, 0 AS rank, 0 AS n FROM users WHERE user_id IS NOT NULL
    UNION ALL SELECT {km}, user_id, 1, count(*) FROM ({src}) GROUP BY user_id)
  WHERE account IS NOT NULL GROUP BY account)"""


def names_sql(src: str) -> str:
    return _NAMES.format(ku=key_sql("user_id"), km=key_sql("user_id"), src=src)


_PER_PAIR = """per_pair AS (SELECT account, event_type, count(*) AS n, sum(chars) AS chars, arg_min(message_id, (us, message_id)) AS first_message_id,
  arg_max(message_id, (us, message_id)) AS last_message_id, min(us) AS first_us, max(us) AS last_us
  FROM latest WHERE account IS NOT NULL AND us IS NOT NULL GROUP BY account, event_type)"""
_EVENTS = f"""events_of AS (
  SELECT 'messages' AS record_set, account, message_id AS id, us FROM latest
  UNION ALL SELECT 'message_records', {key_sql('user_id')}, record_id, {instant_sql('timestamp')}
  FROM (SELECT *, row_number() OVER (PARTITION BY record_id) AS rn FROM message_records) WHERE rn = 1),
gaps AS (SELECT *, us - lag(us) OVER w AS gap FROM events_of WHERE account IS NOT NULL AND us IS NOT NULL
  WINDOW w AS (PARTITION BY record_set, account ORDER BY us, id))"""
_SESSIONS = """SELECT record_set, account, {s} AS gap_seconds, arg_min(id, (us, id)) AS first_id, arg_max(id, (us, id)) AS last_id,
    count(*) AS n, max(us) - min(us) AS us
  FROM (SELECT *, sum(CASE WHEN gap IS NULL OR gap > CAST({s} AS BIGINT) * 1000000 THEN 1 ELSE 0 END) OVER (PARTITION BY record_set, account ORDER BY us, id) AS k FROM gaps)
  GROUP BY record_set, account, k"""

SQL = {
    "p2_found": f"""WITH {_LATEST}, {names_sql('SELECT user_id FROM messages')}, {_PER_PAIR}
SELECT account_id AS user_id, event_type, first_message_id, last_message_id FROM per_pair JOIN names USING (account)""",
    "p2_feature_table": f"""WITH {_LATEST}, {names_sql('SELECT user_id FROM messages')}, {_PER_PAIR}
SELECT account_id AS user_id, CAST(sum(n) AS BIGINT) AS n_messages, CAST(sum(chars) AS BIGINT) AS n_chars, min(first_us) AS first_us, max(last_us) AS last_us,
  array_to_string(list_sort(list(event_type || '=' || n)), ',') AS by_type
FROM per_pair JOIN names USING (account) GROUP BY account_id""",
    "p2_maintained": f"""WITH {_LATEST}, {names_sql('SELECT user_id FROM messages')}, {_PER_PAIR}
SELECT account_id AS user_id, event_type, n AS n_messages, CAST(chars AS BIGINT) AS n_chars, first_message_id, last_message_id FROM per_pair JOIN names USING (account)""",
    "p4_found": f"""WITH {_LATEST}, {names_sql('SELECT user_id FROM messages UNION ALL SELECT user_id FROM message_records')}, {_EVENTS},
found AS ({_SESSIONS.format(s=1800)})
SELECT record_set, account_id AS user_id, first_id, last_id FROM found JOIN names USING (account)""",
    "p4_sessions": f"""WITH {_LATEST}, {_EVENTS}, found AS ({' UNION ALL '.join(_SESSIONS.format(s=s) for s in (300, 1800, 7200))})
SELECT record_set, CAST(gap_seconds AS BIGINT) AS gap_seconds, count(*) AS n_sessions, CAST(sum(n) AS BIGINT) AS n_messages,
  CAST(sum(us) AS BIGINT) AS total_us, max(n) AS longest FROM found GROUP BY record_set, gap_seconds""",
}
