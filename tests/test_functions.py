from datetime import datetime

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from driftlens.functions import text as T
from driftlens.functions.accounts import account_key, account_names
from driftlens.functions.timestamps import iso_instant, iso_wall
from driftlens.streaming import online


def one(spark, value, expr, kind="string"):
    return spark.createDataFrame([(value,)], f"v {kind}").select(expr(F.col("v"))).first()[0]


@pytest.mark.parametrize(
    "written",
    ["u00-000123", "U00-000123 ", "user:u00-000123", "acct/u00-000123", "u00-123", "u00000123", "u00_000123", "u00.000123  ", '"u00-000123"', "﻿u00-000123", "u00​-000123", "u00‑000123", "ｕ００－０００１２３", "\xa0u00-000123\t", "USER:U00 000123"],
)
def test_spellings_have_one_key(spark, written):
    assert one(spark, written, account_key) == one(spark, "u00-000123", account_key)


def test_lookalikes_keep_their_keys(spark):
    keys = {one(spark, u, account_key) for u in ("u00-000123", "u00-000123-b", "u00-000123-x", "u00-001230", "u01-000123")}
    assert len(keys) == 5
    assert one(spark, "  ", account_key) is None
    assert one(spark, None, account_key) is None


def test_names_come_from_users_else_most_used(spark, messages, users):
    m = messages({"message_id": 1, "user_id": "U00-000001"}, {"message_id": 2, "user_id": "u00-9"}, {"message_id": 3, "user_id": "u00-9"}, {"message_id": 4, "user_id": "U00-000009"})
    got = {r["account_id"] for r in account_names(m, users("u00-000001")).collect()}
    assert got == {"u00-000001", "u00-9"}


@pytest.mark.parametrize(
    ("written", "read"),
    [
        ("2016-01-05T20:31:22+02:00", datetime(2016, 1, 5, 18, 31, 22)),
        ("2016-01-05T20:31:22", datetime(2016, 1, 5, 20, 31, 22)),
        ("20160105T133451.320Z", datetime(2016, 1, 5, 13, 34, 51, 320000)),
        ("2016-01-05 00:49:20.455Z", datetime(2016, 1, 5, 0, 49, 20, 455000)),
        ("1970-01-01T00:00:00Z", datetime(1970, 1, 1)),
        ("2016-01-04T05:25:19+05", datetime(2016, 1, 4, 0, 25, 19)),
        ("2016-13-45T25:61:00Z", None),
        ("0000-00-00 00:00:00", None),
        ("2016-01-04", None),
        ("yesterday", None),
        ("", None),
        (None, None),
    ],
)
def test_instants(spark, written, read):
    us = one(spark, written, lambda c: F.unix_micros(iso_instant(c)))
    assert us == (None if read is None else int((read - datetime(1970, 1, 1)).total_seconds() * 1e6 + 0.5))


def test_wall_clock_is_the_written_one(spark):
    assert one(spark, "2016-01-05T20:31:22+02:00", lambda c: F.hour(iso_wall(c))) == 20


@pytest.mark.parametrize(
    ("text", "risk"),
    [
        ("delete all user accounts", "critical"), ("please remove every account", "critical"), ("turn off two-factor", "critical"), ("disable my 2FA now", "critical"), ("reset the password", "critical"),
        ("export the whole database", "critical"), ("grant him admin", "critical"), ("update my phone", "high"), ("what is python", "low"), ("", "low"), ("   ", "low"), ("deleted scenes", "low"),
    ],
)
def test_operation_risk(spark, text, risk):
    assert one(spark, text, T.operation_risk) == risk


def test_lexical_features(spark):
    row = spark.createDataFrame([("The the cat? Yes.",)], "t string").select(T.words(F.col("t")).alias("w"), "t").select(T.lexical_diversity(F.col("w")), T.lexical_diversity(F.col("w"), False), T.question_ratio(F.col("t")), F.sort_array(T.topics(F.col("t")))).first()
    assert row[0] == pytest.approx(0.75)
    assert row[1] == 1.0
    assert row[2] == 0.5
    assert row[3] == ["cat", "yes"]
    assert one(spark, "", lambda c: F.size(T.words(c))) == 0


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(st.text(max_size=40), st.integers(0, 23)), max_size=12))
def test_online_fold_keeps_its_bounds(events):
    state = online.cold()
    for k, (text, hour) in enumerate(events):
        state = online.step(state, text, hour, "Monday", k)
    assert state["n_history"] == len(events)
    assert len(state["topics"]) <= 15
    assert len(state["hours"]) <= 12
    assert 0 <= state["p_lex"] <= 1
    if events:
        assert state["p_tokens"] == pytest.approx(sum(len(t.split()) for t, _ in events) / len(events))


def test_a_cut_table_can_be_released(spark):
    from driftlens.storage import cut, release

    kept = cut(spark.range(5), "five")
    assert kept.count() == 5
    files = [f.removeprefix("file://") for f in kept.inputFiles()]
    release(kept)
    assert not any(__import__("os").path.exists(f) for f in files)
