import datetime as dt
import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from daybook.session import build_session  # noqa: E402

START = dt.date(2024, 1, 1)


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = build_session("*", 4, **{"spark.checkpoint.dir": str(tmp_path_factory.mktemp("shared"))})
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def make_panel(spark):
    """A panel from {series: values}, one value per day from the start date."""

    def make(series, column="total", kind="bigint", start=START):
        rows = [
            (s, start + dt.timedelta(days=i), v) for s, values in series.items() for i, v in enumerate(values)
        ]
        return spark.createDataFrame(rows, f"series_id bigint, date date, {column} {kind}")

    return make
