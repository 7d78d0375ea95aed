import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__)))))

#: Columns that operators use inside: a table may have them too.
CLASHES = {"row": "int", "n": "string", "digest": "string", "token": "int", "rep": "int", "cell": "string", "ids2": "int", "host": "string",
           "grp": "int", "rest": "string", "start": "int", "key": "string", "label": "int"}


@pytest.fixture(scope="session")
def docs_of(spark):
    """Documents table of (doc_id, text) pairs with further columns of clashing names, stored as Parquet."""
    from tallyspark.session import stage_table

    def make(pairs):
        schema = "doc_id long, text string, " + ", ".join(f"{c} {t}" for c, t in CLASHES.items())
        rows = [(i, t, *(1 if k == "int" else "x" for k in CLASHES.values())) for i, t in pairs]
        return stage_table(spark.createDataFrame(rows, schema).coalesce(2), "test-docs")

    return make


def edge_pairs():
    """Nulls in any column, empty and very long texts, ties and repeated rows."""
    long = " ".join(f"word{i % 977}" for i in range(60_000))
    return [(1, None), (2, ""), (2, ""), (3, "same text here"), (4, "same text here"), (4, "same text here"), (None, "same text here"),
            (None, None), (5, long), (6, long), (7, "   \n\t "), (8, "überlänge ▁ naïve 😀 text"), (9, "a")]
