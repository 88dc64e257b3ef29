"""Profiles kept current message by message, in batch and in Structured Streaming.

The update is an ordered fold with a small state per user (a few numbers, at most 15 words, 12 hours, 7 days). Batches
are partitioned by user, sorted by instant and id within partitions, and streamed through the fold, so that a
user's messages are never held together. In a stream the state lives in the state store, keyed by user; late messages
are applied in order of arrival between micro-batches, as the fold has no way back, and by instant within one.

An anomalous message leaves the profile as it is. Null text counts as empty; rows without user or readable timestamp
are left out. A message that comes twice is applied twice; drop repeats by id before.
"""

from __future__ import annotations

import json
import math
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from driftlens.functions import lexicons as X
from driftlens.functions.timestamps import iso_instant, iso_wall
from driftlens.operators.profiles import COLD_HOURS, COLD_START, COLD_TOPICS

#: Bounds of what a profile lists.
MAX_TOPICS, MAX_HOURS, MAX_DAYS, NEW_WORDS = 15, 12, 7, 3
COLD_DAYS = ["Monday", "Tuesday", "Wednesday", "Thursday", "Friday"]
_MEANS = {"p_tokens": None, "p_chars": None, "p_lex": "p_lex_std", "p_formality": "p_formality_std", "p_polite": "p_polite_std", "p_question": None}
OUT = (
    "user_id string, n_history long, p_tokens double, p_chars double, p_lex double, p_lex_std double, p_formality double, p_formality_std double, p_polite double, "
    "p_polite_std double, p_question double, p_tech boolean, p_code boolean, topics array<string>, hours array<int>, days array<string>, last_us long"
)
_COLUMNS = [c.split()[0] for c in OUT.split(", ")]
_ALPHA = re.compile(r"[^\W\d_]+")


def cold() -> dict:
    """The state of a user without history."""
    state = {k: v for k, v in COLD_START.items() if k in _COLUMNS}
    return state | {"topics": list(COLD_TOPICS), "hours": list(COLD_HOURS), "days": list(COLD_DAYS), "last_us": None}


def step(state: dict, text: str, hour: int, day: str, us: int) -> dict:
    """The state after one normal message."""
    words, low, n = text.split(), text.lower(), state["n_history"]
    now = {
        "p_tokens": float(len(words)),
        "p_chars": float(len(text)),
        "p_lex": len({w.lower() for w in words}) / max(len(words), 1),
        "p_formality": min(1.0, len(words) / 50.0),
        "p_polite": float(any(p in low for p in X.POLITE_UPDATE)),
        "p_question": text.count("?") / (text.count(".") + 1),
    }
    out = dict(state)
    for mean, spread in _MEANS.items():
        before = now[mean] - state[mean]
        out[mean] = state[mean] + before / (n + 1)
        if spread:
            squares = state[spread] ** 2 * max(n - 1, 1) + abs(before * (now[mean] - out[mean]))
            out[spread] = max(math.sqrt(squares / max(n, 1)), 0.001)
    topics = list(state["topics"])
    for w in [w.lower() for w in words if len(w) > 4 and _ALPHA.fullmatch(w)][:NEW_WORDS]:
        if w not in topics:
            topics.append(w)
    out["topics"] = topics[:MAX_TOPICS]
    out["hours"] = [*state["hours"], hour] if hour not in state["hours"] and len(state["hours"]) < MAX_HOURS else state["hours"]
    out["days"] = [*state["days"], day] if day not in state["days"] and len(state["days"]) < MAX_DAYS else state["days"]
    out["p_tech"] = bool(state["p_tech"] or any(k in low for k in X.TECH_WORDS))
    out["p_code"] = bool(state["p_code"] or "def " in text or "```" in text)
    out["n_history"], out["last_us"] = n + 1, us
    return out


def arriving(records: DataFrame) -> DataFrame:
    """Normal records with what the fold needs."""
    id_ = F.col("record_id") if "record_id" in records.columns else F.lit(0)
    return records.select(
        "user_id", id_.cast("long").alias("id"), F.coalesce("text", F.lit("")).alias("text"), F.hour(iso_wall(F.col("timestamp"))).alias("hour"), F.date_format(iso_wall(F.col("timestamp")), "EEEE").alias("day"),
        F.unix_micros(iso_instant(F.col("timestamp"))).alias("us"), F.coalesce("is_anomaly", F.lit(False)).alias("is_anomaly"),
    ).where("user_id IS NOT NULL AND us IS NOT NULL AND NOT is_anomaly").drop("is_anomaly")


def _row(user: str, state: dict) -> dict:
    return {"user_id": user, **{c: state[c] for c in _COLUMNS[1:]}}


def _fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    user, state = None, None
    for b in batches:
        done = []
        for u, text, hour, day, us, held in zip(b["user_id"], b["text"], b["hour"], b["day"], b["us"], b["held"], strict=True):
            if u != user:
                if user is not None:
                    done.append(_row(user, state))
                user, state = u, cold()
            if held is not None:
                state = {k: v for k, v in (cold() | json.loads(held)).items() if k in _COLUMNS}
            else:
                state = step(state, text, int(hour), day, int(us))
        if done:
            yield pd.DataFrame(done, columns=_COLUMNS)
    if user is not None:
        yield pd.DataFrame([_row(user, state)], columns=_COLUMNS)


def replay(records: DataFrame, profiles: DataFrame | None = None) -> DataFrame:
    """Profiles after all records, from the cold start; or from ``profiles``, of those users that have one.

    A user's profile comes first in the user's rows, as a state to start from.
    """
    rows = arriving(records.dropDuplicates(["record_id"]) if "record_id" in records.columns else records).withColumn("held", F.lit(None).cast("string"))
    if profiles is not None:
        have = [c for c in _COLUMNS[1:] if c in profiles.columns]
        touched = profiles.join(rows.select("user_id").distinct(), "user_id", "left_semi")
        state = F.to_json(F.struct(*have), {"ignoreNullFields": "true"})
        first = {"id": F.lit(-(1 << 63)).cast("long"), "text": F.lit(""), "hour": F.lit(0), "day": F.lit(""), "us": F.lit(-(1 << 63)).cast("long"), "held": state}
        rows = rows.unionByName(touched.select("user_id", *[v.alias(k) for k, v in first.items()]))
    return rows.repartition("user_id").sortWithinPartitions("user_id", "us", "id").mapInPandas(_fold, OUT)


def live(stream: DataFrame) -> DataFrame:
    """A streaming DataFrame of profiles: a row for each user that a micro-batch touches (update mode)."""

    def update(key: tuple, batches: Iterator[pd.DataFrame], held: GroupState) -> Iterator[pd.DataFrame]:
        state = json.loads(held.get[0]) if held.exists else cold()
        rows = pd.concat(list(batches)).sort_values(["us", "id"])  # of one micro-batch
        for text, hour, day, us in zip(rows["text"], rows["hour"], rows["day"], rows["us"], strict=True):
            state = step(state, text, int(hour), day, int(us))
        held.update((json.dumps(state),))
        yield pd.DataFrame([_row(key[0], state)], columns=_COLUMNS)

    return arriving(stream).groupBy("user_id").applyInPandasWithState(update, OUT, "state string", "update", GroupStateTimeout.NoTimeout)


def live_sessions(stream: DataFrame, gap: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    """Sessions of a stream by a gap in event time; a session is final, and put out, once the watermark has passed it."""
    rows = stream.select("user_id", iso_instant(F.col("timestamp")).alias("at")).where("user_id IS NOT NULL AND at IS NOT NULL")
    grouped = rows.withWatermark("at", late).groupBy("user_id", F.session_window("at", gap).alias("s")).agg(F.count(F.lit(1)).alias("n"))
    return grouped.select("user_id", F.col("s.start").alias("started_at"), F.col("s.end").alias("gap_ends_at"), "n")


def live_rates(stream: DataFrame, window: str = "60 seconds", slide: str = "10 seconds", late: str = "5 minutes", threshold: int = 10) -> DataFrame:
    """Users and sliding windows with more than ``threshold`` messages."""
    rows = stream.select("user_id", iso_instant(F.col("timestamp")).alias("at")).where("user_id IS NOT NULL AND at IS NOT NULL")
    grouped = rows.withWatermark("at", late).groupBy("user_id", F.window("at", window, slide).alias("w")).agg(F.count(F.lit(1)).alias("n"))
    return grouped.where(F.col("n") > threshold).select("user_id", F.col("w.start").alias("started_at"), "n")
