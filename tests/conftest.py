import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)


@pytest.fixture(scope="session")
def spark():
    from tidemeter.session import build_session

    session = build_session("tests", cores=os.environ.get("TEST_CPUS", "8"))
    yield session
    session.stop()


def tap_frame(spark, rows):
    """Taps from (station, time text) or (station, time text, card, exits) tuples."""
    from pyspark.sql import functions as F

    full = [(i, *r, *([None, None][len(r) - 2 :] if len(r) < 4 else [])) for i, r in enumerate(rows)]
    raw = spark.createDataFrame(full, "event_id bigint, station string, t string, card string, exits double")
    return raw.withColumn("ts", F.to_timestamp("t")).drop("t")


@pytest.fixture()
def taps(spark):
    return lambda rows: tap_frame(spark, rows)
