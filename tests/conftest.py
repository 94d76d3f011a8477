import os
import sys
from datetime import datetime, timedelta

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from actilens.session import build_session  # noqa: E402

SMALL = "/root/testdata/sf0.001"
LOG_SCHEMA = (
    "id string, ts timestamp, user_name string, activity_type string, risk_level string, description string, "
    "details string, ip_address string, location string, activity_summary string"
)


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = build_session(
        "tests", "local[8]",
        **{
            "spark.sql.shuffle.partitions": "4", "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false",
            "spark.checkpoint.dir": str(tmp_path_factory.mktemp("checkpoints")),
        },
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture
def make_logs(spark):
    """Build logs from dicts; missing fields get plain defaults, one minute apart."""

    def make(rows):
        start = datetime(2026, 1, 1)
        out = []
        for i, r in enumerate(rows):
            out.append(
                (
                    r.get("id", f"l{i}"), r.get("ts", start + timedelta(minutes=i)), r.get("user_name", "ann"),
                    r.get("activity_type", "LOGIN"), r.get("risk_level", "INFO"), r.get("description", "hello"),
                    r.get("details", ""), r.get("ip_address", "10.0.0.1"), r.get("location", "Internal"),
                    r.get("activity_summary"),
                )
            )
        return spark.createDataFrame(out, LOG_SCHEMA)

    return make


@pytest.fixture(scope="session")
def small_folder():
    if not os.path.isdir(SMALL):
        pytest.skip("driver tables are not here")
    return SMALL
