"""Shared parts of the corpus tests: one local session, the small test tables."""
import os
import sys

import pytest

sys.path[:0] = [os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))]

SF = "/root/testdata/sf0.01"
DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def spark():
    from panelspark.session import local_session

    return local_session("4", 4, "4g")


@pytest.fixture(scope="session")
def sf():
    if not os.path.isdir(SF):
        pytest.skip("no test tables here")
    return SF


@pytest.fixture
def make_docs(spark):
    def build(rows):
        return spark.createDataFrame([(*r, "en", "s", len(r[1] or "")) for r in rows], DOCS)
    return build
