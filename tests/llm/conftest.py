from __future__ import annotations

import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture
def docs_of(spark):
    def make(rows, extra=False):
        """rows: (doc_id, text) or (doc_id, text, lang)."""
        full = [(r[0], r[1], r[2] if len(r) > 2 else "en", "src0", len(r[1] or "")) for r in rows]
        df = spark.createDataFrame(full, DOCS)
        if extra:
            for name in ("fp", "root", "a", "b", "t", "k", "least", "component_id", "h", "id", "n", "key", "words"):
                df = df.selectExpr("*", f"'x' AS {name}")
        return df

    return make
