from __future__ import annotations

import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent))

DOCS = "doc_id long, text string, lang string, source string, n_chars long, h string, n_words string"


@pytest.fixture
def docs(spark):
    """Rows (id, text) as a table of documents with null columns and two columns of clashing names."""

    def make(rows: list[tuple[int | None, str | None]]):
        return spark.createDataFrame([(i, t, None, None, None, "x", None) for i, t in rows], DOCS)

    return make
