import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

from cuesheet.session import build_session  # noqa: E402


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = build_session(
        "tests", "local[8]", spark__sql__shuffle__partitions="4", spark__driver__memory="6g", spark__ui__enabled="false",
        spark__ui__showConsoleProgress="false", spark__checkpoint__dir=str(tmp_path_factory.mktemp("checkpoints")),
        spark__sql__warehouse__dir=str(tmp_path_factory.mktemp("warehouse")))
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture
def cues(spark):
    """Five invented cues: the third is blank and the last ends before the one before it."""
    rows = [
        ("d", 1, 1_000, 3_000, "Run away!"),
        ("d", 2, 5_000, 7_000, "Why?\nWho is it?"),
        ("d", 3, 10_000, 11_000, "  "),
        ("d", 4, 25_000, 130_000, "Run away!"),
        ("d", 5, 90_000, 120_000, "No! Never. Stop"),
    ]
    return spark.createDataFrame(rows, "doc_id string, pos bigint, start_ms bigint, end_ms bigint, text string")


@pytest.fixture
def by_id():
    """Rows as a dict from the first column to the second, or to the rest."""
    def collect(df):
        return {r[0]: (r[1] if len(r) == 2 else tuple(r[1:])) for r in df.collect()}
    return collect
