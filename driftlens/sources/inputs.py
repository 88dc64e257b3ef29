"""Evaluation inputs and profiles as nested JSON: parsing, what is wrong with each, and flat rows for ``operators.scoring``.

An input has a profile, a message and a configuration. Lines are read as text and parsed with a declared schema; a line that is no
JSON, lacks a field, or has one of another type or outside its set is kept apart with its errors. Extra fields are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from driftlens.functions import lexicons as X

_RISKS = ["low", "medium", "high", "critical"]
#: (path, type of a flat column, its name, permitted values)
PROFILE: list[tuple[str, str, str, list[str] | None]] = [
    ("user_id", "string", "user_id", None), ("account_age_days", "int", "age", None), ("total_interactions", "bigint", "n_history", None),
    ("semantic_profile.typical_topics", "array<string>", "topics", None), ("semantic_profile.primary_domains", "array<string>", "domains", None), ("semantic_profile.topic_diversity_score", "double", "p_diversity", None),
    ("linguistic_profile.avg_message_length_tokens", "double", "p_tokens", None), ("linguistic_profile.avg_message_length_chars", "double", "p_chars", None), ("linguistic_profile.lexical_diversity_mean", "double", "p_lex", None),
    ("linguistic_profile.lexical_diversity_std", "double", "p_lex_std", None), ("linguistic_profile.formality_score_mean", "double", "p_formality", None), ("linguistic_profile.formality_score_std", "double", "p_formality_std", None),
    ("linguistic_profile.politeness_score_mean", "double", "p_polite", None), ("linguistic_profile.politeness_score_std", "double", "p_polite_std", None), ("linguistic_profile.question_ratio_mean", "double", "p_question", None),
    ("linguistic_profile.uses_technical_vocabulary", "boolean", "p_tech", None), ("linguistic_profile.uses_code_blocks", "boolean", "p_code", None), ("linguistic_profile.primary_languages", "array<string>", "languages", None),
    ("linguistic_profile.typical_sentence_complexity", "string", "complexity", ["simple", "moderate", "complex"]), ("temporal_profile.typical_session_duration_minutes", "double", "p_session_minutes", None),
    ("temporal_profile.typical_inter_message_gap_seconds", "double", "p_gap", None), ("temporal_profile.most_active_hours_utc", "array<int>", "hours", None), ("temporal_profile.most_active_days_of_week", "array<string>", "days", None),
    ("temporal_profile.average_messages_per_session", "double", "p_per_session", None), ("temporal_profile.longest_session_duration_minutes", "double", "p_longest_minutes", None),
    ("temporal_profile.typical_session_frequency_per_week", "double", "p_frequency", None), ("operational_profile.has_requested_sensitive_ops", "boolean", "p_sensitive", None),
]
MESSAGE: list[tuple[str, str, str, list[str] | None]] = [
    ("text", "string", "message_text", None), ("timestamp", "string", "timestamp", None), ("session_id", "string", "session_id", None), ("message_sequence_in_session", "int", "sequence_in_session", None),
    ("time_since_last_message_seconds", "double", "time_since_last_message_seconds", None), ("requested_operation.type", "string", "operation_type", X.OPERATION_TYPES),
    ("requested_operation.risk_classification", "string", "operation_risk", _RISKS), ("requested_operation.requires_auth", "boolean", "requires_auth", None), ("linguistic_features.message_length_tokens", "int", "message_length_tokens", None),
    ("linguistic_features.contains_code", "boolean", "contains_code", None), ("linguistic_features.contains_urls", "boolean", "contains_urls", None), ("linguistic_features.language", "string", "language", None),
    ("temporal_context.hour_of_day_utc", "int", "hour_of_day_utc", None), ("temporal_context.time_since_last_session_hours", "double", "time_since_last_session_hours", None),
]
CONFIG: list[tuple[str, str, str, list[str] | None]] = [
    ("sensitivity_level", "string", "sensitivity", ["low", "medium", "high", "maximum"]), ("deployment_context", "string", "deployment_context", None), ("enable_semantic_scoring", "boolean", "use_semantic", None),
    ("enable_linguistic_scoring", "boolean", "use_linguistic", None), ("enable_temporal_scoring", "boolean", "use_temporal", None),
]
PARTS = {"user_profile": PROFILE, "current_message": MESSAGE, "system_config": CONFIG}
_WANTED = {"string": "string", "int": "integer", "bigint": "integer", "double": "number", "boolean": "boolean", "array<string>": "list", "array<int>": "list"}


def _value(json: Column, path: str, kind: str) -> tuple[Column, Column]:
    """(raw text, typed value) at a path."""
    raw = F.get_json_object(json, f"$.{path}")
    if kind.startswith("array"):
        return raw, F.from_json(raw, kind)
    if kind == "boolean":
        return raw, F.when(raw.isin("true", "false"), raw == "true")
    return raw, raw if kind == "string" else raw.try_cast(kind)


def _field(json: Column, part: str, spec: tuple[str, str, str, list[str] | None]) -> tuple[Column, Column]:
    """(error or null, value) of one field."""
    path, kind, _, allowed = spec
    raw, value = _value(json, f"{part}.{path}" if part else path, kind)
    named = " -> ".join(filter(None, [part, *path.split(".")]))
    error = F.when(raw.isNull(), F.lit(f"{named}: Field required")).when(value.isNull(), F.lit(f"{named}: Input should be a valid {_WANTED[kind]}"))
    if allowed:
        error = error.when(~value.isin(*allowed), F.lit(f"{named}: Input should be {', '.join(repr(a) for a in allowed[:-1])} or {allowed[-1]!r}"))
    return error, value


def parse(lines: DataFrame, text: str = "value") -> tuple[DataFrame, DataFrame]:
    """(good inputs, bad ones) of JSON texts: flat structs ``user_profile``, ``current_message``, ``system_config``; or the text with its ``errors``."""
    json = F.col(text)
    broken = F.from_json(json, "_x string, _corrupt_record string", {"columnNameOfCorruptRecord": "_corrupt_record"})["_corrupt_record"].isNotNull() | ~F.trim(json).startswith("{")
    errors, fields = [], {}
    for part, specs in PARTS.items():
        made = [(_field(json, part, s), s[2]) for s in specs]
        errors += [e for (e, _), _ in made]
        fields[part] = F.struct(*[v.alias(n) for (_, v), n in made])
    rows = lines.where(F.trim(json) != "").select(json.alias("input"), F.when(broken, F.array(F.lit("Invalid JSON"))).otherwise(F.array_compact(F.array(*errors))).alias("errors"), *[v.alias(k) for k, v in fields.items()])
    return rows.where(F.size("errors") == 0).select(*PARTS), rows.where(F.size("errors") > 0).select("input", "errors")


def read_inputs(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    return parse(spark.read.text(path))


def read_profiles(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(profiles, bad documents): a nested JSON document per file or line."""
    texts = spark.read.text(path, wholetext=True)
    made = [(_field(F.col("value"), "", s), s[2]) for s in PROFILE]
    rows = texts.select("value", F.array_compact(F.array(*[e for (e, _), _ in made])).alias("errors"), *[v.alias(n) for (_, v), n in made])
    return rows.where(F.size("errors") == 0).drop("value", "errors"), rows.where(F.size("errors") > 0).select("value", "errors")


def nested_profiles(profiles: DataFrame) -> DataFrame:
    """``(user_id, json)``: profiles as the nested documents that ``read_profiles`` takes; what a profile lacks has its default."""
    defaults: dict[str, Column] = {"age": F.lit(0), "topics": F.array(F.lit("general")), "domains": F.array(F.lit("learned_from_history")), "languages": F.array(F.lit("en")), "complexity": F.lit("moderate"), "hours": F.array().cast("array<int>"), "days": F.array().cast("array<string>")}
    tree: dict[str, list[Column]] = {}
    for path, kind, name, _ in PROFILE:
        value = F.coalesce(F.col(name).cast(kind), defaults.get(name, F.lit(None)).cast(kind)) if name in profiles.columns else defaults.get(name, F.lit(None)).cast(kind)
        head, _, leaf = path.rpartition(".")
        tree.setdefault(head, []).append(value.alias(leaf))
    top = [*tree[""], *[F.struct(*fields).alias(head) for head, fields in tree.items() if head]]
    return profiles.select("user_id", F.to_json(F.struct(*top)).alias("json"))


def as_rows(inputs: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(messages, profiles, settings) in the form of the tables; messages are numbered by a hash of their content."""
    message = inputs.select(F.col("user_profile.user_id").alias("user_id"), "current_message.*", "system_config.*").withColumn("message_id", F.xxhash64("user_id", "message_text", "timestamp", "session_id", "sequence_in_session"))
    empty = {"source": "string", "should_flag": "boolean", "anomaly_type": "string", "attack_phase": "string", "ingested_at": "timestamp"}
    messages = message.withColumns({c: F.lit(None).cast(t) for c, t in empty.items()})
    profiles = inputs.select("user_profile.*").dropDuplicates(["user_id"])
    return messages, profiles, message.select("message_id", *[n for _, _, n, _ in CONFIG])
