from __future__ import annotations

import pytest


@pytest.fixture(scope="session")
def documents(spark):
    """A function from rows to documents with extra columns whose names the operators use."""

    def make(rows, source=None):
        values = [
            (i, text, None, source[k] if source else f"s{k % 3}", len(text or ""), "x", 7, -1)
            for k, (i, text) in enumerate(rows)
        ]
        return spark.createDataFrame(
            values,
            "doc_id long, text string, lang string, source string, n_chars long, "
            "keep_id string, _row int, score int",
        )

    return make
