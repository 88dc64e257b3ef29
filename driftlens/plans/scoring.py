"""Queries that score messages, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from driftlens.functions import ladders as L
from driftlens.functions import lexicons as X
from driftlens.functions import text as T
from driftlens.functions.encoders import WIDTH, hashed_bag
from driftlens.operators import detectors, explain, ordered, profiles, scoring
from driftlens.operators.profiles import COLD_START
from driftlens.plans.events import instant_sql, key_sql
from driftlens.plans.features import PROFILE_SQL, TOPICS_SQL, any_sql, count_sql, risk_sql, words_sql
from driftlens.sources.tables import spread, table, tables
from driftlens.storage import cut

SCORES = ["semantic", "linguistic", "temporal", "score"]


def content_safety(spark: SparkSession, folder: str) -> DataFrame:
    """The latest delivery of each message; only the verdict moves."""
    t = F.coalesce("message_text", F.lit(""))
    rows = spread(table(spark, folder, "messages").where("message_id IS NOT NULL").select("message_id", "ingested_at", "user_id", "timestamp", "message_text")).select("message_id", F.col("ingested_at").alias("version"), F.xxhash64("user_id", "timestamp", "message_text").alias("tie"), detectors.hazard_verdict(t).alias("found"))
    rows = scoring.latest(rows, "message_id", "version", "tie")
    found = {c: F.col(f"found.{c}") for c in ("score", "is_anomaly", "categories", "category_scores")}
    listed = F.transform(F.array_sort(F.map_entries(found["category_scores"])), lambda e: F.format_string("%s=%.3f", e["key"], e["value"]))
    return rows.select(
        "message_id", F.round(found["score"], 3).alias("score"), found["is_anomaly"].alias("is_anomaly"), F.array_join(found["categories"], ",").alias("categories"),
        F.size(found["categories"]).cast("long").alias("n_categories"), F.array_join(listed, ",").alias("category_scores"),
    )


def rate_limit_window(spark: SparkSession, folder: str) -> DataFrame:
    rows = scoring.timed(table(spark, folder, "messages"))
    rows = ordered.with_recent(ordered.with_recent(rows, "account", "us", 60, "last_minute"), "account", "us", 6 * 3600, "last_six_hours")
    return rows.select(F.col("id").alias("message_id"), "last_minute", "last_six_hours")


def rule_based_detect(spark: SparkSession, folder: str) -> DataFrame:
    signs = detectors.rule_signs(F.coalesce("message_text", F.lit("")))
    rows = ordered.with_recent(scoring.timed(table(spark, folder, "messages"), signs=signs), "account", "us", 60, "recent")
    found = {c: F.col(f"found.{c}") for c in ("score", "rules")}
    return rows.withColumn("found", detectors.rule_sum(F.col("signs"), F.col("recent"))).select(F.col("id").alias("message_id"), F.round(found["score"], 6).alias("score"), (found["score"] > 0.5).alias("is_anomaly"), F.size(found["rules"]).cast("long").alias("n_rules"), F.array_join(found["rules"], "; ").alias("rules"))


def built(spark: SparkSession, folder: str, centroids: bool = False) -> DataFrame:
    """Profiles, written once: the planner then knows whether they are small enough to be sent to all."""
    records, users = tables(spark, folder, "message_records", "users")
    return cut(profiles.build(records, users, hashed_bag if centroids else None), "profiles")


def _told(rows: DataFrame, *more: str) -> DataFrame:
    """The columns of an evaluation; lists as one string each."""
    lists = [F.array_join(c, "; ").alias(c) for c in ("red_flags", "mitigating", "primary_factors", "semantic_factors", "linguistic_factors", *(m for m in more if m.endswith("factors")))]
    said = [F.col(f"{p}_said").alias(f"{p}_reasoning") for p in ("semantic", "linguistic", "temporal")]
    return rows.select(
        F.col("id").alias("message_id"), *[F.round(c, 6).alias(c) for c in SCORES], "mechanism", "confidence", "risk_level", *lists, *said, "operation_risk_assessment", "overall_summary",
        *[F.col(m) for m in more if not m.endswith("factors")],
    )


def evaluate_rule(spark: SparkSession, folder: str) -> DataFrame:
    rows = scoring.evaluate(table(spark, folder, "messages"), built(spark, folder))
    return _told(explain.confidence_factors(rows), "temporal_factors", "sufficient_history", "clear_patterns", "high_signal_quality")


def evaluate_ml(spark: SparkSession, folder: str) -> DataFrame:
    rows = scoring.evaluate_learned(table(spark, folder, "messages"), built(spark, folder, centroids=True))
    parts = {c: F.round(c, 6) for c in ("cosine", "distance", "hour_p", "a_hour", "a_gap", "a_frequency", "a_duration")}
    return _told(rows.withColumns(parts), *parts)


def evaluation_json(spark: SparkSession, folder: str) -> DataFrame:
    """Results as JSON, without the id and the time of the run."""
    rows = scoring.evaluate(table(spark, folder, "messages"), built(spark, folder))
    return explain.as_json(explain.result(rows)).select(F.col("id").alias("message_id"), "json")


def composite_sweep(spark: SparkSession, folder: str) -> DataFrame:
    """Every setting of ``system_configs`` over all messages, in one pass: scores don't depend on the setting, so they are worked out once."""
    messages, configs = tables(spark, folder, "messages", "system_configs")
    rows = scoring.components(scoring.prepared(messages, built(spark, folder)))
    narrow = rows.select("id", "semantic", "linguistic", "temporal", "risk", "p_sensitive", "ato", "context_change", "n_tokens", "formality", "question", "n_history", "n_typical_all", "p_lex_std", "p_formality_std", "n_hours", "p_diversity", "p_tokens", "p_frequency")
    settings = configs.select(
        "config_id", F.col("sensitivity_level").alias("sensitivity"), F.coalesce("enable_semantic_scoring", F.lit(True)).alias("use_semantic"), F.coalesce("enable_linguistic_scoring", F.lit(True)).alias("use_linguistic"),
        F.coalesce("enable_temporal_scoring", F.lit(True)).alias("use_temporal"), F.coalesce("overrides_enabled", F.lit(True)).alias("overrides"),
    )
    return scoring.sweep(narrow, settings)


QUERIES = {f.__name__: f for f in (content_safety, rate_limit_window, rule_based_detect, evaluate_rule, evaluate_ml, evaluation_json, composite_sweep)}

_HITS = ", ".join(f"({count_sql('t', patterns)}) AS h{i}" for i, (_, _, patterns) in enumerate(X.HAZARDS))
_SCORES = ", ".join(f"CASE WHEN h{i} > 0 THEN {w}e0 * least(1e0, 5e-1 + 25e-2 * h{i}) END AS s{i}" for i, (_, w, _) in enumerate(X.HAZARDS))
_N = len(X.HAZARDS)
_ABUSE = [n for n, *_ in X.HAZARDS].index("S2_account_abuse")
_CATS = ", ".join([*(f"CASE WHEN h{i} > 0 THEN '{n}' END" for i, (n, *_) in enumerate(X.HAZARDS)), f"CASE WHEN ops > 0 AND h{_ABUSE} = 0 THEN 'high_risk_operation' END"])
_CATMAP = ", ".join([*(f"CASE WHEN h{i} > 0 THEN '{n}=' || printf('%.3f', round(s{i}, 3)) END" for i, (n, *_) in enumerate(X.HAZARDS)), f"CASE WHEN ops > 0 AND h{_ABUSE} = 0 THEN 'high_risk_operation=' || printf('%.3f', round(15e-2 * ops, 3)) END"])
SAFETY_CTES = f"""hits AS (SELECT message_id, t, {_HITS}, ({count_sql('t', X.HIGH_RISK_OPS)}) AS ops FROM {{source}}),
scored AS (SELECT *, {_SCORES}, {' + '.join(f'(h{i} > 0)::INT' for i in range(_N))} AS k FROM hits),
best AS (SELECT *, coalesce(greatest({', '.join(f's{i}' for i in range(_N))}), 0e0) AS b FROM scored),
summed AS (SELECT *, CASE WHEN k > 1 THEN least(1e0, b + 1e-1 * (k - 1)) ELSE b END AS c FROM best),
final AS (SELECT *, CASE WHEN ops > 0 THEN least(1e0, c + 15e-2 * ops) ELSE c END AS f, list_filter([{_CATS}], lambda x: x IS NOT NULL) AS cats, list_filter([{_CATMAP}], lambda x: x IS NOT NULL) AS each FROM summed)"""
_SAFETY = "WITH " + SAFETY_CTES.replace("{source}", "(SELECT message_id, coalesce(message_text, '') AS t FROM (SELECT *, row_number() OVER (PARTITION BY message_id ORDER BY ingested_at DESC) AS rn FROM messages) WHERE rn = 1)") + """
SELECT message_id, round(f, 3) AS score, f > 5e-1 AS is_anomaly, array_to_string(cats, ',') AS categories, len(cats) AS n_categories, array_to_string(list_sort(each), ',') AS category_scores FROM final"""
_CURRENT = f"""cur AS (SELECT *, coalesce(given_gap, CASE WHEN lag(session) OVER w = session THEN (us - lag(us) OVER w) / 1e6 END, 30e0) AS gap FROM (
  SELECT message_id AS id, {key_sql('user_id')} AS account, {instant_sql('timestamp')} AS us, coalesce(session_id, 'session_0') AS session, t AS text, lower(t) AS low, coalesce(sequence_in_session, 1) AS seq,
    time_since_last_message_seconds AS given_gap, coalesce(time_since_last_session_hours, 24e0) AS since_h, coalesce(message_length_tokens, len(ws))::DOUBLE AS n_tokens, coalesce(language, 'en') AS language,
    CASE WHEN lower(trim(operation_risk)) IN ('low', 'medium', 'high', 'critical') THEN lower(trim(operation_risk)) ELSE {risk_sql('t')} END AS risk, CASE WHEN operation_type IN ('read', 'write', 'delete', 'export', 'auth_change', 'permission_change', 'financial', 'admin', 'none') THEN operation_type ELSE 'read' END AS operation,
    coalesce(contains_code, {any_sql('t', ['def ', '```'])}) AS code, coalesce(contains_urls, contains(t, 'http')) AS urls, CAST(len(list_distinct(ws)) AS DOUBLE) / greatest(len(ws), 1) AS lex, 5e-1 AS formality, 6e-1 AS polite,
    CAST(substr(regexp_replace(trim(timestamp), '^([0-9]{{4}})([0-9]{{2}})([0-9]{{2}})[Tt ]([0-9]{{2}})', '\\1-\\2-\\3T\\4'), 12, 2) AS INT) AS hour, {TOPICS_SQL.format(t='t')} AS said,
    coalesce(should_flag, false) AS should_flag, anomaly_type, attack_phase
  FROM (SELECT *, coalesce(message_text, '') AS t, {words_sql("coalesce(message_text, '')")} AS ws, row_number() OVER (PARTITION BY message_id ORDER BY ingested_at DESC) AS rn FROM messages) WHERE rn = 1 AND {instant_sql('timestamp')} IS NOT NULL)
  WHERE account IS NOT NULL WINDOW w AS (PARTITION BY account ORDER BY us, id))"""
_COLD = ", ".join(f"coalesce(p.{c}, {str(v).lower() if isinstance(v, (bool, int)) else f'{v}e0'}) AS {c}" for c, v in COLD_START.items() if c not in ("p_chars", "p_question", "p_session_minutes", "p_longest_minutes", "p_polite_std"))
FACTS_SQL = f"""{PROFILE_SQL}, {_CURRENT},
joined AS (SELECT cur.*, {_COLD}, coalesce(p.p_polite_std, 15e-2) AS p_polite_std, string_split(coalesce(p.topics, 'general'), ',') AS typ, list_transform(string_split(coalesce(p.hours, '9,10,11,12,13,14,15,16,17'), ','), lambda x: CAST(x AS INT)) AS hrs
  FROM cur LEFT JOIN (SELECT *, {key_sql('user_id')} AS account FROM prof) p ON p.account = cur.account),
facts AS (SELECT *, len(list_distinct(typ)) AS n_typical, len(typ) AS n_typical_all, len(said) AS n_topics, len(list_intersect(said, typ)) AS n_both, len(list_distinct(list_concat(said, typ))) AS n_either, (code OR length(text) > 200) AS mismatch,
  language = 'en' AS known_language, 1 AS n_languages, (code OR urls) AS technical, (p_tech OR p_code) AS p_technical, len(hrs) AS n_hours, list_contains(hrs, hour) AS hour_known, list_contains(hrs, hour) AS typical,
  {any_sql('low', X.ATO_PHRASES)} AS ato, {any_sql('low', X.CONTEXT_CHANGE)} AS context_change, contains(text, '?') AS question FROM joined)"""


def _chain(source: str, steps: list[tuple[str, str]], prefix: str) -> tuple[str, str]:
    """CTEs that add one column each; the name of the last."""
    out = []
    for i, (name, sql) in enumerate(steps):
        out.append(f"{prefix}{i} AS (SELECT *, {sql} AS {name} FROM {source})")
        source = f"{prefix}{i}"
    return ", ".join(out), source


_PARTS = [("o", L.OVERLAP), ("sem0", L.SEMANTIC_BASE), *L.SEMANTIC_STEPS, *L.LINGUISTIC.items(), *L.TEMPORAL.items(), ("linguistic", L.bounded_sum(L.LINGUISTIC)), ("temporal", L.bounded_sum(L.TEMPORAL))]
_C1, COMPONENTS = _chain("facts", _PARTS, "c")
_VERDICT = [*L.COMPOSITE, ("confidence", L.CONFIDENCE), *L.RISK]
_C2, VERDICT = _chain(f"(SELECT *, 'medium' AS sensitivity, true AS use_semantic, true AS use_linguistic, true AS use_temporal, true AS overrides FROM {COMPONENTS})", _VERDICT, "v")
EVALUATED_SQL = f"{FACTS_SQL}, {_C1}, {_C2}"
_FLAG_CONDITIONS = [
    "semantic > 85e-2",
    "risk = 'critical' AND NOT p_sensitive",
    any_sql("low", X.DESTINATIONS),
    any_sql("low", X.INJECTION),
    f"({any_sql('low', X.URGENCY)} AND {any_sql('low', X.AUTHORITY)}) OR (polite > 8e-1 AND risk IN ('high', 'critical'))",
    "temporal > 9e-1",
    f"{any_sql('low', X.RECON)} AND (NOT typical OR n_history < 50)",
    "since_h < 1",
    f"NOT p_tech AND (code OR length(text) > 200 OR {any_sql('low', X.SOPHISTICATED)})",
]
_MITIGATING_CONDITIONS = [
    any_sql("low", X.TOPIC_CHANGE),
    "risk = 'low'",
    "p_diversity > 6e-1",
    any_sql("low", X.SECURITY),
    f"(n_tokens < 30 AND question) OR {any_sql('low', X.CLARIFICATION)}",
    f"p_diversity > 5e-1 AND (question OR {any_sql('low', X.EXPLORATION)}) AND risk IN ('low', 'medium')",
]


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _list_sql(rules: list[tuple[str, str]]) -> str:
    """The texts (SQL) whose condition holds, in order."""
    return f"list_filter([{', '.join(f'CASE WHEN {c} THEN {t} END' for c, t in rules)}], lambda x: x IS NOT NULL)"


_FLAGS = _list_sql([(c, _quoted(t)) for c, t in zip(_FLAG_CONDITIONS, detectors.RED_FLAGS, strict=True)])
_MITIGATING = _list_sql([(c, _quoted(t)) for c, t in zip(_MITIGATING_CONDITIONS, detectors.MITIGATING, strict=True)])


def _two(x: str) -> str:
    return f"printf('%.2f', round({x}, 2))"


def _sum_sql(parts: list[tuple[str, str, str]], calm: str) -> tuple[str, str]:
    factors = _list_sql([(f"{c} > 0", f"{_quoted(f + ' (')} || {_two(c)} || ')'") for c, f, _ in parts])
    said = _list_sql([(f"{c} > 0", _quoted(t)) for c, _, t in parts])
    return f"CASE WHEN len({said}) > 0 THEN array_to_string({said}, '. ') || '.' ELSE {_quoted(calm)} END", factors


_SAID = "CASE WHEN len({s}) > 0 THEN array_to_string({s}[1:2], '. ') || '.' ELSE '' END"


def _first(text: str) -> str:
    return _SAID.format(s=f"list_filter(list_transform(string_split({text}, '.'), lambda x: trim(x)), lambda x: x <> '')")


_BANDS = explain.SEMANTIC_BANDS
_SEM_REASON = "CASE " + " ".join(f"WHEN o >= {e}e0 THEN {_quoted(t)}" for e, t, _ in _BANDS) + f" ELSE {_quoted(explain.SEMANTIC_ELSE[0])} END"
_SEM_FACTORS = _list_sql(
    [
        ("o >= 5e-1 AND o < 8e-1", _quoted(_BANDS[1][2])), ("o >= 2e-1 AND o < 5e-1", _quoted(_BANDS[2][2])), ("o < 2e-1", _quoted(explain.SEMANTIC_ELSE[1])), ("mismatch", _quoted(explain.SEMANTIC_MORE["mismatch"])),
        ("seq > 1 AND o < 3e-1", _quoted(explain.SEMANTIC_MORE["midway"])), ("sem2 >= 85e-2 AND risk = 'critical'", _quoted(explain.SEMANTIC_MORE["critical"])),
    ]
)
_LING_REASON, _LING_FACTORS = _sum_sql(explain.LINGUISTIC, explain.CALM["linguistic"])
_TEMP_REASON, _TEMP_FACTORS = _sum_sql(explain.TEMPORAL, explain.CALM["temporal"])
_RULE_TOLD = f"*, {_SEM_REASON} AS r_sem, {_SEM_FACTORS} AS f_sem, {_LING_REASON} AS r_lin, {_LING_FACTORS} AS f_lin, {_TEMP_REASON} AS r_tem, {_TEMP_FACTORS} AS f_tem"
_BANDS_ML = explain.SEMANTIC_ML
_Z = [("message_length", "(n_tokens - p_tokens) / greatest(p_lex_std * p_tokens, 1e0)"), ("lexical_diversity", "(lex - p_lex) / greatest(p_lex_std, 1e-2)"), ("formality", "(formality - p_formality) / greatest(p_formality_std, 1e-2)"), ("politeness", "(polite - p_polite) / greatest(p_polite_std, 1e-2)")]
_ML_SEM_REASON = "CASE " + " ".join(f"WHEN sem_ml0 > {e}e0 THEN {_quoted(t)}" for e, t, _ in _BANDS_ML) + f" ELSE {_quoted(explain.SEMANTIC_ML_CALM)} END"
_ML_SEM_FACTORS = _list_sql(
    [
        ("sem_ml0 > 3e-1", "'Cosine distance: ' || printf('%.3f', round(1 - cosine, 3))"), ("sem_ml0 > 8e-1", _quoted(_BANDS_ML[0][2])), ("sem_ml0 > 6e-1 AND sem_ml0 <= 8e-1", _quoted(_BANDS_ML[1][2])),
        ("seq > 1 AND sem_ml0 > 5e-1", _quoted(explain.SEMANTIC_ML_MIDWAY)),
    ]
)
_FAR = _list_sql([(f"abs({z}) > 2", f"'{n}: ' || {_two(f'abs({z})')} || ' standard deviations from mean'") for n, z in _Z])
_DRIFT = "(1e0 / (1e0 + exp(-5e-1 * (distance - 3e0))))"
_ML_LING_REASON = f"CASE WHEN {_DRIFT} > 7e-1 THEN replace({_quoted(explain.LINGUISTIC_ML[0])}, '%.2f', {_two('distance')}) WHEN {_DRIFT} > 4e-1 THEN replace({_quoted(explain.LINGUISTIC_ML[1])}, '%.2f', {_two('distance')}) ELSE {_quoted(explain.LINGUISTIC_ML[2])} END || CASE WHEN known_language THEN '.' ELSE {_quoted('. ' + explain.LINGUISTIC_ML[3] + '.')} END"
_ML_LING_FACTORS = f"list_concat({_FAR}[1:3], CASE WHEN known_language THEN [] ELSE ['Language switch detected: ' || language || ' not in primary languages'] END)"
_ML_TEMP_REASON = f"CASE WHEN temporal_ml > 7e-1 THEN {_quoted(explain.TEMPORAL_ML[0])} WHEN temporal_ml > 4e-1 THEN {_quoted(explain.TEMPORAL_ML[1])} ELSE {_quoted(explain.TEMPORAL_ML[2])} END"
_ML_TOLD = f"*, {_ML_SEM_REASON} AS r_sem, {_ML_SEM_FACTORS} AS f_sem, {_ML_LING_REASON} AS r_lin, {_ML_LING_FACTORS} AS f_lin, {_ML_TEMP_REASON} AS r_tem"
_TOP = "list_transform(list_filter(list_sort([(-semantic, 0, 'Semantic anomaly'), (-linguistic, 1, 'Linguistic anomaly'), (-temporal, 2, 'Temporal anomaly')])[1:2], lambda x: -x[1] > 3e-1), lambda x: x[3] || ' (score: ' || printf('%.2f', round(-x[1], 2)) || ')')"
_OPERATION = "CASE risk " + " ".join(f"WHEN '{r}' THEN replace({_quoted(t)}, '%s', operation)" for r, t in explain.OPERATION.items()) + " END"
_MEAN = "((semantic + linguistic + temporal) / 3e0)"
_SUMMARY = f"""CASE WHEN {_MEAN} > 7e-1 THEN {_quoted(explain.SUMMARY[0])} WHEN {_MEAN} > 4e-1 THEN {_quoted(explain.SUMMARY[1])} ELSE {_quoted(explain.SUMMARY[2])} END
  || CASE WHEN len(flags) > 0 THEN 'Detected ' || len(flags) || ' red flag(s) including suspicious indicators. ' WHEN len(mit) > 0 THEN 'Identified ' || len(mit) || ' mitigating factor(s) suggesting legitimate use. ' ELSE '' END
  || CASE WHEN risk IN ('critical', 'high') THEN {_quoted(explain.SENSITIVE[0])} ELSE {_quoted(explain.SENSITIVE[1])} END"""


def _told_sql(verdict: str, told: str) -> str:
    """CTEs from a verdict to what is told of it; the last is ``told``."""
    return f"""flagged AS (SELECT *, {_FLAGS} AS flags, {_MITIGATING} AS mit FROM {verdict}), reasoned AS (SELECT {told} FROM flagged),
told AS (SELECT *, list_concat({_TOP}, flags[1:1])[1:3] AS top, {_first('r_sem')} AS s_sem, {_first('r_lin')} AS s_lin, {_first('r_tem')} AS s_tem, {_OPERATION} AS op, {_SUMMARY} AS summ FROM reasoned)"""


_OUT = f"""id AS message_id, {', '.join(f'round({c}, 6) AS {c}' for c in SCORES)}, mechanism, confidence, risk_level, array_to_string(flags, '; ') AS red_flags, array_to_string(mit, '; ') AS mitigating,
  array_to_string(top, '; ') AS primary_factors, array_to_string(f_sem, '; ') AS semantic_factors, array_to_string(f_lin, '; ') AS linguistic_factors, s_sem AS semantic_reasoning, s_lin AS linguistic_reasoning, s_tem AS temporal_reasoning,
  op AS operation_risk_assessment, summ AS overall_summary"""


def slots_sql(t: str) -> str:
    return f"list_transform({words_sql(f'lower({t})')}, lambda w: CAST('0x' || substr(md5(w), 1, 2) AS INT) % {WIDTH})"


#: Each message's cosine to its account's centroid: sums over words in place of vectors.
_COSINE = f"""bag AS (SELECT id, account, slot, count(*)::DOUBLE AS c FROM (SELECT id, account, unnest({slots_sql('text')}) AS slot FROM cur) GROUP BY ALL),
ranked AS (SELECT user_id, {slots_sql("array_to_string(ws, ' ')")} AS bins, row_number() OVER w AS i, count(*) OVER (PARTITION BY user_id) AS n FROM hist WINDOW w AS (PARTITION BY user_id ORDER BY us, id)),
cents AS (SELECT {key_sql('user_id')} AS account, slot, sum(CASE WHEN i = 1 THEN power(95e-2, n - 1) ELSE (1e0 - 95e-2) * power(95e-2, n - i) END) AS x FROM (SELECT user_id, unnest(bins) AS slot, i, n FROM ranked) GROUP BY ALL),
have AS (SELECT DISTINCT {key_sql('user_id')} AS account FROM prof),
dots AS (SELECT b.id, sum(b.c * coalesce(CASE WHEN h.account IS NULL THEN (b.slot = CAST('0x' || substr(md5('general'), 1, 2) AS INT) % {WIDTH})::INT::DOUBLE ELSE k.x END, 0)) AS dot, sqrt(sum(b.c * b.c)) AS norm, any_value(b.account) AS account, any_value(h.account) AS held
  FROM bag b LEFT JOIN have h ON h.account = b.account LEFT JOIN cents k ON k.account = b.account AND k.slot = b.slot GROUP BY b.id),
sizes AS (SELECT account, sqrt(sum(x * x)) AS size FROM cents GROUP BY account),
cosines AS (SELECT id, greatest(-1e0, least(1e0, dot / (norm * CASE WHEN held IS NULL THEN 1e0 ELSE size END))) AS cosine FROM dots LEFT JOIN sizes USING (account)),
learnt AS (SELECT f.*, coalesce(c.cosine, 0e0) AS cosine FROM facts f LEFT JOIN cosines c USING (id))"""

_KEYWORDS = " + ".join(f"contains(lower(text), '{k}')::INT" for k in X.RISK_KEYWORDS)
RULES_SQL = [(f"({_KEYWORDS}) > 0", f"least(({_KEYWORDS}) * 15e-2, 4e-1)", f"'high_risk_keywords: ' || ({_KEYWORDS})")]
for _p in X.RULE_PATTERNS:
    _name = ("suspicious_pattern: " + _p[:30]).replace("'", "''")
    RULES_SQL.append((f"regexp_matches(text, '{T.sql_regex(_p)}', '{'i' if _p.startswith('(?i)') else 'c'}')", "25e-2", f"'{_name}'"))
_MARKS = "(length(text) - length(regexp_replace(text, '[!?.]', '', 'g')))"
RULES_SQL += [
    ("recent > 10", "3e-1", "'rate_limit_exceeded: ' || recent || ' msg/min'"),
    ("length(text) < 10", "1e-1", "'message_too_short: ' || length(text) || ' chars'"),
    ("length(text) > 500", "15e-2", "'message_too_long: ' || length(text) || ' chars'"),
    (r"length(text) > 20 AND regexp_matches(text, '\p{Lu}') AND NOT regexp_matches(text, '[\p{Ll}\p{Lt}]')", "1e-1", "'all_caps_message'"),
    (f"{_MARKS} > 10", "1e-1", f"'excessive_punctuation: ' || {_MARKS}"),
]
_RECENT = "count(*) OVER (PARTITION BY account ORDER BY us RANGE BETWEEN {s}000000 PRECEDING AND CURRENT ROW)"
_ML_STEPS = [
    ("distance", L.MAHALANOBIS),
    ("hour_p", "CASE WHEN len(hrs) = 0 THEN 1 / 24e0 ELSE list_sum(list_transform(hrs, lambda h: exp(-power(least(abs(h - hour), 24 - abs(h - hour))::DOUBLE, 2) / 8e0))) / len(hrs) END"),
    ("linguistic_ml", L.LINGUISTIC_ML),
    *L.TEMPORAL_ML,
    *L.SEMANTIC_ML,
]
_M, LEARNED = _chain("learnt", _ML_STEPS, "m")
_CONFIG = "'medium' AS sensitivity, true AS use_semantic, true AS use_linguistic, true AS use_temporal, true AS overrides"
_MV, LEARNED_VERDICT = _chain(f"(SELECT *, semantic_ml AS semantic, linguistic_ml AS linguistic, temporal_ml AS temporal, {_CONFIG} FROM {LEARNED})", _VERDICT, "y")
_SET = f"""(SELECT c.*, s.config_id, s.sensitivity_level AS sensitivity, coalesce(s.enable_semantic_scoring, true) AS use_semantic, coalesce(s.enable_linguistic_scoring, true) AS use_linguistic,
  coalesce(s.enable_temporal_scoring, true) AS use_temporal, coalesce(s.overrides_enabled, true) AS overrides FROM {COMPONENTS} c CROSS JOIN system_configs s)"""
_S, SWEPT = _chain(_SET, _VERDICT, "w")
SQL = {
    "content_safety": _SAFETY,
    "rate_limit_window": f"WITH {_CURRENT} SELECT id AS message_id, {_RECENT.format(s=60)} AS last_minute, {_RECENT.format(s=21600)} AS last_six_hours FROM cur",
    "rule_based_detect": f"""WITH {_CURRENT}, rated AS (SELECT id, text, {_RECENT.format(s=60)} AS recent FROM cur),
summed AS (SELECT id, least({' + '.join(f'CASE WHEN {c} THEN {s} ELSE 0e0 END' for c, s, _ in RULES_SQL)}, 1e0) AS score, list_filter([{', '.join(f'CASE WHEN {c} THEN {n} END' for c, _, n in RULES_SQL)}], lambda x: x IS NOT NULL) AS rules FROM rated)
SELECT id AS message_id, round(score, 6) AS score, score > 5e-1 AS is_anomaly, len(rules) AS n_rules, array_to_string(rules, '; ') AS rules FROM summed""",
    "evaluate_rule": f"""WITH {EVALUATED_SQL}, {_told_sql(VERDICT, _RULE_TOLD)} SELECT {_OUT}, array_to_string(f_tem, '; ') AS temporal_factors, n_history >= 20 AS sufficient_history,
  n_typical_all >= 3 AND p_lex_std < 2e-1 AND p_formality_std < 2e-1 AND n_hours >= 3 AS clear_patterns, p_diversity BETWEEN 3e-1 AND 8e-1 AND p_tokens BETWEEN 10 AND 500 AND p_frequency >= 1 AS high_signal_quality FROM told""",
    "evaluate_ml": f"""WITH {FACTS_SQL}, {_COSINE}, {_M}, {_MV}, {_told_sql(LEARNED_VERDICT, _ML_TOLD)}
SELECT {_OUT}, {', '.join(f'round({c}, 6) AS {c}' for c in ('cosine', 'distance', 'hour_p', 'a_hour', 'a_gap', 'a_frequency', 'a_duration'))} FROM told""",
    "composite_sweep": f"""WITH {FACTS_SQL}, {_C1}, {_S} SELECT config_id, count(*) AS n_messages, round(avg(score), 6) AS mean_score, CAST(count_if(risk_level = 'HIGH_RISK') AS BIGINT) AS n_high, CAST(count_if(risk_level = 'SUSPICIOUS') AS BIGINT) AS n_suspicious,
  CAST(count_if(mechanism = 'normal_override') AS BIGINT) AS n_normal_override, CAST(count_if(starts_with(mechanism, 'override_')) AS BIGINT) AS n_high_override FROM {SWEPT} GROUP BY config_id""",
}
