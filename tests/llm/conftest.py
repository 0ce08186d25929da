from __future__ import annotations

import pytest

DOC = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture()
def documents(spark):
    """A documents table from texts: doc_ids count up; an extra column clashes with names that operators use."""

    def make(texts, ids=None, sources=None, langs=None):
        rows = [(i if ids is None else ids[i], t, "en" if langs is None else langs[i], "s" if sources is None else sources[i], len(t) if t else None, "x") for i, t in enumerate(texts)]
        return spark.createDataFrame(rows, DOC + ", size string")

    return make
