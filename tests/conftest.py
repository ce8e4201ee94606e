from __future__ import annotations

import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from pyspark import SparkConf  # noqa: E402
from pyspark.sql import SparkSession  # noqa: E402

from verbarium.session import SCRATCH_SETTING, build_session  # noqa: E402
from verbarium.sources.tables import Store  # noqa: E402


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    # Only where no shared folder is named.
    settings = SparkConf()
    if not settings.contains(SCRATCH_SETTING):
        folder = str(tmp_path_factory.mktemp("scratch"))
        SparkSession.builder.config(SCRATCH_SETTING, folder)
    session = build_session("tests", "local[4]", 4)
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture
def store(spark, tmp_path):
    return Store(spark, str(tmp_path / "store"))


@pytest.fixture(scope="session")
def make_pages(spark):
    def make(*rows: tuple[int, str, str]):
        return spark.createDataFrame(list(rows), "page_id long, title string, text string")

    return make


def rows_of(df, *columns):
    """Sorted tuples of the given columns, or of all."""
    chosen = df.select(*columns) if columns else df
    return sorted((tuple(row) for row in chosen.collect()), key=repr)
