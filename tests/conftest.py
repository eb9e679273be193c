import sys
from datetime import datetime
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from opsmetrics.schema import METRIC_EVENT  # noqa: E402
from opsmetrics.session import local_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = local_session("opsmetrics-tests", cores="8", partitions=4)
    yield session
    session.stop()


@pytest.fixture(scope="session")
def events(spark):
    """Event frame from short dicts; unset fields get plain defaults."""

    def build(rows):
        full = []
        for i, r in enumerate(rows):
            d = {
                "event_key": f"k{i:06d}", "pipeline_name": "p", "metric_name": "m.rows", "metric_value": 1.0,
                "severity": "info", "run_id": None, "payload": None, "occurred_at": datetime(2026, 7, 1),
                "is_alert": False, "sent": False, "sent_at": None, "environment": "prod", **r,
            }
            full.append(tuple(d[f.name] for f in METRIC_EVENT.fields))
        return spark.createDataFrame(full, METRIC_EVENT)

    return build
