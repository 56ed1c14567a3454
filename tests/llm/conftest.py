import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__)))))


@pytest.fixture(scope="session", autouse=True)
def shipped(spark):
    from catalog.ship import ship_package

    ship_package(spark)


@pytest.fixture(scope="session")
def docs_of(spark):
    """Documents from (doc_id, text[, source]) with further columns that share names with operators' own."""

    def make(rows):
        rows = [(*r, "s0")[:3] if len(r) == 2 else r for r in rows]
        schema = "doc_id long, text string, source string, lang string, n_chars long, score string, part string, rank string"
        return spark.createDataFrame([(i, t, s, "en", len(t) if t is not None else None, "x", "y", "z") for i, t, s in rows], schema)

    return make
