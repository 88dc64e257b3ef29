"""Messages scored against their authors' profiles: semantic, linguistic and temporal parts, composite, risk.

What a message says is worked out where it is read: signs, counts and topics. The profile is joined there too - it is a
small table, written before, so that the planner knows its size - and only numbers and flags move after that: once by message,
to find the latest delivery, and once by account and hour, to find the gap to the message before. No text is shuffled, and
no account has to fit into one task.

Defined results: the latest delivery of a message counts; messages without account or readable timestamp aren't
scored; null text counts as empty. Users without a profile are scored against the cold-start profile. Of profiles, ``domains``,
``languages`` and ``centroid`` are used where the table has them; else there are no domains, English, and no centroid.
"""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from driftlens.functions import ladders as L
from driftlens.functions import lexicons as X
from driftlens.functions import text as T
from driftlens.functions.accounts import account_key
from driftlens.functions.encoders import Encoder, hashed_bag
from driftlens.functions.timestamps import iso_instant, iso_wall
from driftlens.operators import detectors, explain, vectors
from driftlens.operators.ordered import with_previous
from driftlens.operators.profiles import COLD_HOURS, COLD_START, COLD_TOPICS
from driftlens.sources.tables import spread

DEFAULT_CONFIG = {"sensitivity": "medium", "use_semantic": True, "use_linguistic": True, "use_temporal": True, "overrides": True}


#: Columns of messages that scores are made of.
OBSERVED = (
    "message_id user_id source message_text timestamp session_id sequence_in_session should_flag anomaly_type attack_phase operation_type operation_risk "
    "time_since_last_message_seconds time_since_last_session_hours message_length_tokens contains_code contains_urls language ingested_at"
).split()
#: Settings that a pass of ``sweep`` takes at most.
SETTINGS = 1000


def latest(messages: DataFrame, id_: str = "message_id", version: str = "ingested_at", tie: str | None = None) -> DataFrame:
    """One row per message: its latest delivery; equal arrival times fall back on the row's content (or the column ``tie``)."""
    last = F.xxhash64("user_id", "timestamp", "message_text") if tie is None else F.col(tie)
    order = Window.partitionBy(id_).orderBy(F.col(version).desc_nulls_last(), last)
    return messages.where(F.col(id_).isNotNull()).withColumn("_rn", F.row_number().over(order)).where("_rn = 1").drop("_rn")


def observed(messages: DataFrame, texts: bool = False) -> DataFrame:
    """What each delivery says of itself: supplied values win, else they are derived. Nothing is shuffled.

    With ``texts`` the text is kept, for an encoder.
    """
    t = F.coalesce("message_text", F.lit(""))
    rows = spread(messages.where("message_id IS NOT NULL").select(*OBSERVED)).select(
        F.col("message_id").alias("id"), F.col("ingested_at").alias("version"), F.xxhash64("user_id", "timestamp", "message_text").alias("tie"), account_key(F.col("user_id")).alias("account"),
        F.unix_micros(iso_instant(F.col("timestamp"))).alias("us"), iso_wall(F.col("timestamp")).alias("wall"), F.coalesce("session_id", F.lit("session_0")).alias("session"), t.alias("text"), F.lower(t).alias("low"),
        T.words(t).alias("ws"), F.coalesce("sequence_in_session", F.lit(1)).alias("seq"), F.col("time_since_last_message_seconds").alias("given_gap"),
        F.coalesce("time_since_last_session_hours", F.lit(24.0)).alias("since_h"), F.col("message_length_tokens").alias("given_tokens"), F.coalesce("language", F.lit("en")).alias("language"),
        F.coalesce(T.valid_risk(F.col("operation_risk")), T.operation_risk(t)).alias("risk"), F.when(F.col("operation_type").isin(*X.OPERATION_TYPES), F.col("operation_type")).otherwise("read").alias("operation"),
        F.coalesce("contains_code", T.contains_any(t, ["def ", "```"])).alias("code"), F.coalesce("contains_urls", F.contains(t, F.lit("http"))).alias("urls"),
        F.coalesce("should_flag", F.lit(False)).alias("should_flag"), F.col("anomaly_type"), F.col("attack_phase"), F.col("source"),
    )
    signs = {name: T.contains_any(F.col("low"), phrases) for name, phrases in X.SIGNS.items()}
    return rows.withColumns(
        signs
        | {
            "n_tokens": F.coalesce("given_tokens", F.size("ws")).cast("double"), "lex": T.lexical_diversity(F.col("ws"), fold=False), "formality": F.lit(0.5), "polite": F.lit(0.6), "hour": F.hour("wall"),
            "said": T.topics(F.col("text")), "question": F.contains("text", F.lit("?")), "long_text": F.length("text") > 200,
        }
    ).drop("low", "ws", "wall", "given_tokens", *(() if texts else ("text",)))


def _counted(rows: DataFrame) -> DataFrame:
    """The latest delivery of each message that has an account and an instant."""
    return latest(rows, "id", "version", "tie").where("account IS NOT NULL AND us IS NOT NULL").drop("version", "tie")


def timed(messages: DataFrame, **more: Column) -> DataFrame:
    """``(id, account, us)`` of each message, and ``more`` of what its text says."""
    rows = spread(messages.select("message_id", "user_id", "timestamp", "message_text", "ingested_at")).select(
        F.col("message_id").alias("id"), F.col("ingested_at").alias("version"), F.xxhash64("user_id", "timestamp", "message_text").alias("tie"), account_key(F.col("user_id")).alias("account"),
        F.unix_micros(iso_instant(F.col("timestamp"))).alias("us"), *[c.alias(n) for n, c in more.items()],
    )
    return _counted(rows)


def gapped(rows: DataFrame) -> DataFrame:
    """``gap``: the supplied one, else that to the account's previous message of the same session, else 30 seconds."""
    near = with_previous(rows, "account", ["us", "id"], ["session", "us"])
    derived = F.when(F.col("before.session") == F.col("session"), (F.col("us") - F.col("before.us")) / 1e6)
    return near.withColumn("gap", F.coalesce("given_gap", derived, F.lit(30.0))).drop("before", "given_gap")


def with_profile(messages: DataFrame, profiles: DataFrame) -> DataFrame:
    """Messages joined to profiles by account, with the cold-start profile where there is none."""
    known = {"hours": F.array(*[F.lit(h) for h in COLD_HOURS]), "topics": F.array(*[F.lit(x) for x in COLD_TOPICS]), "domains": F.array().cast("array<string>"), "languages": F.array(F.lit("en"))}
    known |= {c: F.lit(v) for c, v in COLD_START.items()}
    have = [c for c in [*known, "centroid"] if c in profiles.columns]
    joined = messages.join(profiles.select(account_key(F.col("user_id")).alias("account"), *have), "account", "left")
    return joined.withColumns({c: F.coalesce(F.col(c), v) if c in have else v for c, v in known.items()})


def typical_hour(hour: Column, hours: Column) -> Column:
    """Whether the hour is one of the profile's; of 9 to 21 for a profile without hours."""
    return F.array_contains(F.when(F.size(hours) > 0, hours).otherwise(F.sequence(F.lit(9), F.lit(21))), hour)


def office_hour(hour: Column) -> Column:
    """The fixed rule of single messages: 9 to 17."""
    return hour.between(9, 17)


def facts(joined: DataFrame) -> DataFrame:
    """The columns that the ladders read; sets of words and hours are used up here."""
    typical = F.array_distinct("topics")
    around = F.transform("hours", lambda h: F.abs(h - F.col("hour")))
    near = F.transform(around, lambda d: F.exp(-F.pow(F.least(d, 24 - d).cast("double"), F.lit(2.0)) / 8.0))
    hour_p = F.when(F.size("hours") == 0, F.lit(1 / 24)).otherwise(F.aggregate(near, F.lit(0.0), lambda a, x: a + x) / F.size("hours"))
    expert = F.arrays_overlap("domains", F.array(*[F.lit(d) for d in X.TECH_DOMAINS]))
    return joined.withColumns(
        {
            "n_typical": F.size(typical), "n_typical_all": F.size("topics"), "n_topics": F.size("said"), "n_both": F.size(F.array_intersect("said", typical)), "n_either": F.size(F.array_union("said", typical)),
            "mismatch": (F.col("code") | F.col("long_text")) & ~expert, "known_language": F.array_contains("languages", F.col("language")), "n_languages": F.size("languages"),
            "technical": F.col("code") | F.col("urls"), "p_technical": F.col("p_tech") | F.col("p_code"), "n_hours": F.size("hours"), "hour_known": F.array_contains("hours", F.col("hour")),
            "typical": typical_hour(F.col("hour"), F.col("hours")), "hour_p": hour_p,
        }
    ).drop("said", "topics", "hours", "domains", "languages")


def prepared(messages: DataFrame, profiles: DataFrame, encoder: Encoder | None = None) -> DataFrame:
    """A row per scored message with all that scores are made of; with an encoder, ``cosine`` to the profile's centroid too."""
    rows = with_profile(observed(messages, texts=encoder is not None), profiles)
    if encoder is not None:
        # Vectors become columns before they are used, as expressions name them more than once.
        rows = rows.withColumns({"_v": encoder(F.col("text")), "_cold": encoder(F.lit(COLD_TOPICS[0]))})
        rows = rows.withColumn("_held", F.coalesce("centroid", "_cold") if "centroid" in rows.columns else F.col("_cold"))
        rows = rows.withColumn("cosine", F.coalesce(vectors.cosine(F.col("_v"), F.col("_held")), F.lit(0.0))).drop("text", "centroid", "_v", "_cold", "_held")
    return gapped(_counted(facts(rows)))


def components(rows: DataFrame) -> DataFrame:
    """``semantic``, ``linguistic`` and ``temporal``, by rules."""
    rows = rows.withColumn("o", F.expr(L.OVERLAP)).withColumn("sem0", F.expr(L.SEMANTIC_BASE))
    for name, sql in L.SEMANTIC_STEPS:
        rows = rows.withColumn(name, F.expr(sql))
    rows = rows.withColumns({k: F.expr(v) for k, v in (L.LINGUISTIC | L.TEMPORAL).items()})
    return rows.withColumns({"linguistic": F.expr(L.bounded_sum(L.LINGUISTIC)), "temporal": F.expr(L.bounded_sum(L.TEMPORAL))})


def learned(rows: DataFrame) -> DataFrame:
    """The learned variants: ``distance`` and ``linguistic_ml``, ``temporal_ml`` with its parts and, given ``cosine``, ``semantic_ml``."""
    rows = rows.withColumn("distance", F.expr(L.MAHALANOBIS)).withColumn("linguistic_ml", F.expr(L.LINGUISTIC_ML))
    for name, sql in [*L.TEMPORAL_ML, *(L.SEMANTIC_ML if "cosine" in rows.columns else ())]:
        rows = rows.withColumn(name, F.expr(sql))
    return rows


def composite(rows: DataFrame, config: dict[str, object] | DataFrame | None = None) -> DataFrame:
    """``score``, ``mechanism``, ``confidence`` and ``risk_level``. Settings may be columns already, or a table of them by ``id``."""
    if isinstance(config, DataFrame):
        rows, config = rows.join(config, "id", "left"), None
        rows = rows.withColumns({k: F.coalesce(k, F.lit(v)) for k, v in DEFAULT_CONFIG.items() if k in rows.columns})
    for name, value in (DEFAULT_CONFIG | (config or {})).items():
        if name not in rows.columns:
            rows = rows.withColumn(name, F.lit(value))
    for name, sql in [*L.COMPOSITE, ("confidence", L.CONFIDENCE), *L.RISK]:
        rows = rows.withColumn(name, F.expr(sql))
    return rows


def sweep(rows: DataFrame, settings: DataFrame) -> DataFrame:
    """Every setting over every scored row: by setting, how many and how high the scores are.

    Settings differ in little that counts: rows are joined to the distinct ones, a table whose size is checked, in a join
    on a constant; more than SETTINGS of them go by blocks, so that no block is too large to be sent to all tasks.
    """
    columns = [c for c in settings.columns if c != "config_id"]
    alike = settings.groupBy(*columns).agg(F.count(F.lit(1)).alias("_n")).withColumn("_s", F.struct(*columns)).select("_s")
    n = alike.count()
    block = F.pmod(F.xxhash64("_s"), F.lit(max(1, -(-n // SETTINGS))))
    totals = None
    for k in range(max(1, -(-n // SETTINGS))):
        some = alike.where(block == k).agg(F.collect_list("_s").alias("_all"))  # one row, of about SETTINGS settings
        scored = composite(rows.crossJoin(F.broadcast(some)).select("*", F.explode("_all").alias("_one")).select("*", "_one.*").drop("_all", "_one"))
        counts = scored.groupBy(*columns).agg(
            F.count(F.lit(1)).alias("n_messages"), F.round(F.avg("score"), 6).alias("mean_score"), F.count_if(F.col("risk_level") == "HIGH_RISK").alias("n_high"), F.count_if(F.col("risk_level") == "SUSPICIOUS").alias("n_suspicious"),
            F.count_if(F.col("mechanism") == "normal_override").alias("n_normal_override"), F.count_if(F.col("mechanism").startswith("override_")).alias("n_high_override"),
        )
        totals = counts if totals is None else totals.unionByName(counts)
    same = [settings[c].eqNullSafe(totals[c]) for c in columns]
    return settings.join(totals, reduce(and_, same)).select("config_id", *[c for c in totals.columns if c not in columns])


def flagged(rows: DataFrame) -> DataFrame:
    cols = {c: F.col(c) for c in rows.columns}
    return rows.withColumns({"red_flags": detectors.red_flags(cols), "mitigating": detectors.mitigating(cols)})


def evaluate(messages: DataFrame, profiles: DataFrame, config: dict[str, object] | DataFrame | None = None) -> DataFrame:
    """By rules: a row per scored message, with what the scores are made of and what they are put down to."""
    rows = flagged(composite(components(prepared(messages, profiles)), config))
    return explain.rationale(explain.by_rules(rows))


def evaluate_learned(messages: DataFrame, profiles: DataFrame, config: dict[str, object] | DataFrame | None = None, encoder: Encoder = hashed_bag) -> DataFrame:
    """By the learned parts: cosine to the profile's centroid, distance of the style, z-values of the timing."""
    rows = learned(prepared(messages, profiles, encoder))
    rows = rows.withColumns({"semantic": F.col("semantic_ml"), "linguistic": F.col("linguistic_ml"), "temporal": F.col("temporal_ml")})
    return explain.rationale(explain.learned(flagged(composite(rows, config))))
