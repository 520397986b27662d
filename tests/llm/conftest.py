import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(__file__))


@pytest.fixture
def make_docs(spark):
    """Documents from ``(doc_id, text)`` pairs, with the other columns of the table."""
    def build(rows, extra=""):
        data = [(i, t, "en", "s", len(t or "")) for i, t in rows]
        df = spark.createDataFrame(data, "doc_id long, text string, lang string, source string, n_chars long")
        return df.selectExpr("*", *[x for x in [extra] if x])
    return build
