from __future__ import annotations

import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))


@pytest.fixture(scope="session")
def spark():
    from duskline.session import get_session, ship_package

    s = get_session("local[*]", "duskline-tests", spark__sql__shuffle__partitions="8", spark__driver__memory="8g",
                    spark__ui__showConsoleProgress="false", spark__log__level="ERROR")
    ship_package(s)
    yield s
    s.stop()


@pytest.fixture(scope="session")
def frame(spark):
    """frame('a long, b double', [(1, 2.0), ...])"""
    return lambda schema, rows: spark.createDataFrame(rows, schema)
