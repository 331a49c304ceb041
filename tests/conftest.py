import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))
sys.path.insert(0, str(Path(__file__).resolve().parent.parent / "tools"))

from murmur.session import local_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    return local_session("4", 2)


@pytest.fixture
def feedback(spark):
    """Build a feedback table from dicts; rows are numbered in order."""

    def build(rows, analyzed=True, **defaults):
        base = {"feedback_id": None, "date": "2026-01-01 00:00:00", "location": "Hall", "feedback": "x"}
        if analyzed:
            base |= {"category": "Safety", "sentiment": "Negative", "severity": "Low"}
        base |= defaults
        filled = [{**base, "feedback_id": str(i), **row, "_ord": i} for i, row in enumerate(rows)]
        names = list(dict.fromkeys(k for row in filled for k in row)) or [*base, "_ord"]
        schema = ", ".join(f"{n} {'long' if n == '_ord' else 'string'}" for n in names)
        df = spark.createDataFrame([tuple(row.get(n) for n in names) for row in filled], schema)
        return df.withColumn("date", df["date"].cast("timestamp_ntz"))

    return build
