import random

import pytest
from pyspark.sql import functions as F

from driftlens.operators import entity_features as E
from driftlens.operators import sessions as S


def at(seconds):
    return f"2016-01-05T{seconds // 3600:02d}:{seconds // 60 % 60:02d}:{seconds % 60:02d}Z"


def row(i, user="u00-000001", s=0, intent="a.b", risk="low", text="hello", **more):
    return {"message_id": i, "user_id": user, "timestamp": at(s), "detected_intent": intent, "operation_risk": risk, "message_text": text, **more}


def found(m, u):
    return {tuple(r) for r in E.p2_found(m, u).collect()}


def test_counts_first_and_last(messages, users):
    m = messages(row(1, s=10), row(2, s=5, user="U00-1"), row(3, s=10), row(3, s=10), row(4, s=7, intent=" A.B ", risk=" LOW"), row(5, s=1, intent=None, risk="n/a"))
    assert found(m, users("u00-000001")) == {("u00-000001", "a.b:low", 2, 3), ("u00-000001", "unknown:unset", 5, 5)}
    r = E.features(m, users("u00-000001")).where("event_type = 'a.b:low'").first()
    assert (r["n"], r["total_chars"]) == (4, 20)


def test_retraction_of_the_extremes(messages, users):
    # the last event's later delivery has another type; the pair's last is worked out again
    m = messages(row(1, s=10), row(2, s=20), row(3, s=30), row(3, s=30, intent="c.d"), row(1, s=15))
    assert found(m, users()) == {("u00-000001", "a.b:low", 1, 2), ("u00-000001", "c.d:low", 3, 3)}


def test_retraction_to_nothing(messages, users):
    m = messages(row(1, s=10), row(1, s=10, user=None), row(2, s=11), row(2, timestamp="n/a"))
    assert found(m, users()) == set()


def test_merge_of_states_equals_one_state(messages):
    a, b = [row(i, s=i) for i in range(6)], [row(2, s=50), row(7, s=3, intent="x.y"), row(0, s=0, intent="x.y")]
    whole = E.event_deltas(E.deliveries(messages(*a, *b)))
    cols = ["account", "event_type", "n", "total_chars", "first", "last", "first_gone", "last_gone"]
    parts = whole.where("event_id < 3"), whole.where("event_id >= 3")
    assert sorted(map(str, E.merge(E.fold(parts[0]), E.fold(parts[1])).select(cols).collect())) == sorted(map(str, E.fold(whole).select(cols).collect()))


def test_nulls_empty_and_extra_columns(messages, users):
    assert found(messages(), users()) == set()
    m = messages(row(None), row(1, user=None), row(2, user="  "), row(3, timestamp=None), row(4, text=None)).withColumn("account", F.lit("x")).withColumn("n", F.lit(1)).withColumn("sign", F.lit(3))
    assert found(m, users()) == {("u00-000001", "a.b:low", 4, 4)}
    assert E.features(m, users()).first()["total_chars"] == 0
    wide = E.feature_table(m, users()).first()
    assert list(wide["by_type"]) == ["a.b:low"]


def brute(events, gap):
    out, by = set(), {}
    for s, a, i, us in events:
        by.setdefault((s, a), []).append((us, i))
    for (s, a), rows in by.items():
        rows.sort()
        start = 0
        for k in range(1, len(rows) + 1):
            if k == len(rows) or rows[k][0] - rows[k - 1][0] > gap * 1_000_000:
                out.add((s, a, rows[start][1], rows[k - 1][1], k - start))
                start = k
    return out


@pytest.mark.parametrize("parts", [1, 3, 17])
def test_sessions_equal_brute_force_whatever_the_chunks(spark, parts):
    rng = random.Random(parts)
    events, us = [], 0
    for i in range(700):
        a = rng.choice(["hot"] * 6 + ["b", "c", "d"])
        us = rng.choice([us, us + rng.choice([1, 5, 60, 600, 1800, 1801, 5000, 90000]) * 1_000_000, rng.randrange(10**10)])
        events.append((rng.choice(["m", "r"]), a, i, us))
    df = spark.createDataFrame(events, "record_set string, account string, event_id long, us long")
    spark.conf.set("spark.sql.shuffle.partitions", str(parts))
    try:
        tree = S.gap_tree(df)
        for gap in (0, 5, 600, 1800, 100000):
            got = {(r["record_set"], r["account"], r["first_id"], r["last_id"], r["n"]) for r in S.cut(tree, gap).collect()}
            assert got == brute(events, gap)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")


def test_sessions_of_tables(messages, records, users):
    m = messages(row(1, s=0), row(2, s=1800), row(3, s=3601), row(3, s=3601), row(4, timestamp="yesterday"), row(5, user=None), row(6, s=0, user="user:U00-1"))
    r = records({"record_id": 9, "user_id": "u00-000001", "timestamp": at(5)}, {"record_id": 9, "user_id": "u00-000001", "timestamp": at(5)}, {"record_id": None, "user_id": "u00-000001", "timestamp": at(5)})
    got = {tuple(x) for x in S.p4_found(m, r, users("u00-000001")).collect()}
    assert got == {("messages", "u00-000001", 1, 2), ("messages", "u00-000001", 3, 3), ("message_records", "u00-000001", 9, 9)}
    assert S.p4_found(messages(), records(), users()).count() == 0


def test_redelivery_in_a_later_batch_counts_once(spark):
    from datetime import UTC, datetime

    from driftlens.operators import entity_features as ef

    day = lambda n: datetime(2016, 1, n, tzinfo=UTC)
    first = [(1, day(1), "a", "x:low", day(1), 5), (2, day(1), "a", "x:low", day(2), 7), (3, day(3), "a", "x:low", day(3), 9)]
    second = [(1, day(4), "b", "y:low", day(1), 6), (2, day(1), "a", "x:low", day(2), 7), (3, day(2), "a", "x:low", day(9), 1), (4, day(4), "a", "x:low", day(4), 1), (4, day(5), "a", "x:low", day(4), 2)]
    schema = "event_id long, version timestamp, account string, event_type string, at timestamp, chars long"
    one, two = spark.createDataFrame(first, schema), spark.createDataFrame(second, schema)
    whole = ef.event_deltas(one.unionByName(two))
    old = ef.event_deltas(one)
    new = ef.event_deltas(two, ef.current(one))
    merged = ef.settle(ef.merge(ef.fold(old), ef.fold(new)), old.unionByName(new))
    got = sorted(merged.collect(), key=lambda r: r["account"])
    assert got == sorted(ef.settle(ef.fold(whole), whole).collect(), key=lambda r: r["account"])
    assert [(r["account"], r["n"], r["total_chars"]) for r in got] == [("a", 3, 18), ("b", 1, 6)]
    assert sorted(ef.current(two, ef.current(one)).collect()) == sorted(ef.current(one.unionByName(two)).collect())
