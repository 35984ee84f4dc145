from __future__ import annotations

import pytest


@pytest.fixture(scope="session")
def docs_of(spark):
    """docs_of([(id, text), ...]) or with further named columns."""
    from duskline.llm.common import prepare

    prepare(spark)

    def build(rows, schema="doc_id long, text string"):
        return spark.createDataFrame(rows, schema)

    return build


@pytest.fixture(scope="session")
def sf():
    return "/root/testdata/sf0.001"
