import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from odd_rows import CLASHES, ROWS  # noqa: E402


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls in every column, empty, blank and very long texts, ties, repeated rows, and extra columns whose names clash with those of the operators."""
    return spark.createDataFrame([(*r, *["clash"] * len(CLASHES)) for r in ROWS], "doc_id long, text string, lang string, source string, " + ", ".join(f"{c} string" for c in CLASHES)).repartition(3)


@pytest.fixture(scope="session")
def none(odd):
    return odd.limit(0)
