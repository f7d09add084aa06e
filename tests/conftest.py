from __future__ import annotations

import datetime as dt
import pathlib
import sys

import pytest

ROOT = pathlib.Path(__file__).resolve().parent.parent
sys.path[:0] = [str(ROOT), str(ROOT / "tools")]

from branchlore import new_session  # noqa: E402
from branchlore.operators.enrich import commit_trailers, enrich  # noqa: E402
from branchlore.operators.reconcile import reconcile  # noqa: E402
from branchlore.schema import COMMIT_SCHEMA  # noqa: E402
from branchlore.sources import testdata  # noqa: E402

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = new_session(
        "tests",
        "local[8]",
        spark__ui__enabled="false",
        spark__sql__shuffle__partitions="4",
        spark__driver__memory="4g",
        spark__checkpoint__dir=str(tmp_path_factory.mktemp("staging")),
        spark__sql__warehouse__dir=str(tmp_path_factory.mktemp("warehouse")),
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def config():
    return testdata.FIXTURE_CONFIG


@pytest.fixture(scope="session")
def tables(spark):
    return testdata.branch_tables(spark, SF)


@pytest.fixture(scope="session")
def commits(tables, config):
    return enrich(reconcile(tables, config)).cache()


@pytest.fixture(scope="session")
def trailers(commits):
    return commit_trailers(commits)


@pytest.fixture
def make_commits(spark):
    """Commit tables from short dicts; columns left out are NULL."""

    def make(*rows: dict):
        return spark.createDataFrame([tuple(row.get(n) for n in COMMIT_SCHEMA.fieldNames()) for row in rows], COMMIT_SCHEMA)

    return make


def at(day: int, second: int = 0) -> dt.datetime:
    return dt.datetime(2024, 1, day, 0, 0, second)
