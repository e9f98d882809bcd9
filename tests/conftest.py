import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from sensorloom.session import build_session  # noqa: E402
from sensorloom.sources.events import TRAIN_SCHEMA  # noqa: E402


@pytest.fixture(scope="session")
def sf_dir():
    """The smallest of the supplied data sets."""
    return "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = build_session(
        "sensorloom-tests",
        master="local[8]",
        shuffle_partitions=8,
        extra={
            "spark.ui.enabled": "false",
            "spark.ui.showConsoleProgress": "false",
            "spark.driver.memory": "6g",
            "spark.checkpoint.dir": str(tmp_path_factory.mktemp("checkpoints")),
        },
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def make_events(spark):
    """Event rows from (timestamp, sensor, field_0..2, session, user); other fields 0."""

    def make(rows):
        full = [
            (f"e{i}", ts, sensor, f0, f1, f2, 0.0, 0.0, 0.0, 0.0, 0.0, session, user)
            for i, (ts, sensor, f0, f1, f2, session, user) in enumerate(rows)
        ]
        return spark.createDataFrame(full, TRAIN_SCHEMA)

    return make


@pytest.fixture(scope="session")
def walk_events(make_events):
    """Three walks of two people: sensors 4 and 11 in the first, 4 alone in the others."""
    return make_events(
        [
            (500, "4", 2.0, 3.0, 6.0, "walk-a", "ada"),
            (740, "4", 0.0, 3.0, 4.0, "walk-a", "ada"),
            (980, "4", 7.0, 4.0, 4.0, "walk-a", "ada"),
            (510, "11", -1.5, 0.0, 2.0, "walk-a", "ada"),
            (60, "4", 8.0, 1.0, 4.0, "walk-b", "bo"),
            (61, "4", 9.0, 2.0, 6.0, "walk-b", "bo"),
            (90, "4", 6.0, 6.0, 7.0, "walk-c", "bo"),
        ]
    )


@pytest.fixture(scope="session")
def plan_text():
    """The physical plan of a DataFrame, after adaptive execution if it has run."""

    def text(df):
        return df._jdf.queryExecution().executedPlan().toString()

    return text
