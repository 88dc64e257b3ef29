import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

from driftlens.session import get_session  # noqa: E402

MESSAGE = (
    "message_id long, user_id string, source string, message_text string, timestamp string, session_id string, sequence_in_session int, is_anomaly boolean, should_flag boolean, anomaly_type string, "
    "attack_phase string, operation_type string, operation_risk string, detected_intent string, targets array<string>, requires_auth boolean, time_since_last_message_seconds double, "
    "time_since_last_session_hours double, message_length_tokens int, message_length_chars int, contains_code boolean, contains_urls boolean, language string, ingested_at timestamp"
)
RECORD = "record_id long, user_id string, text string, timestamp string, session_id string, is_anomaly boolean, operation_risk string"
USER = "user_id string, account_age_days int, typical_topics array<string>, updated_at timestamp"


@pytest.fixture(scope="session")
def spark():
    made = get_session("local[4]", "tests", spark__sql__shuffle__partitions="4", spark__ui__enabled="false", spark__driver__memory="3g", spark__sql__adaptive__coalescePartitions__enabled="true")
    made.sparkContext.setLogLevel("ERROR")
    yield made
    made.stop()


@pytest.fixture()
def messages(spark):
    from datetime import UTC, datetime, timedelta

    names = [c.split()[0] for c in MESSAGE.split(", ")]

    def make(*rows):
        start = datetime(2016, 1, 1, tzinfo=UTC)
        full = [{"ingested_at": start + timedelta(seconds=k), "source": "a", **r} for k, r in enumerate(rows)]
        return spark.createDataFrame([tuple(r.get(n) for n in names) for r in full], MESSAGE)

    return make


@pytest.fixture()
def records(spark):
    names = [c.split()[0] for c in RECORD.split(", ")]
    return lambda *rows: spark.createDataFrame([tuple(r.get(n) for n in names) for r in rows], RECORD)


@pytest.fixture()
def users(spark):
    return lambda *ids: spark.createDataFrame([(i, 70, None, None) for i in ids], USER)
