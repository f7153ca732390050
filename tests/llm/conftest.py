from __future__ import annotations

import pytest

from costurero.llm.common import prepare

DOCUMENTS = "doc_id bigint, text string, lang string, source string, n_chars bigint"


@pytest.fixture(scope="session")
def documents(spark):
    """Documents of (doc_id, text) pairs, with the other columns of the table and some with clashing names."""
    prepare(spark)

    def make(rows):
        full = [(d, t, "en", "s", len(t) if t is not None else None) for d, t in rows]
        df = spark.createDataFrame(full, DOCUMENTS)
        for name in ("fp", "key", "places", "line", "score", "again", "rank"):
            df = df.withColumn(name, df["lang"])
        return df

    return make


@pytest.fixture(scope="session")
def odd(documents):
    """Nulls, empties, white space, repeated rows, equal texts, a very long text."""
    long = " ".join(f"word{i % 997}" for i in range(60_000))
    rows = [(1, None), (2, ""), (3, " \n\t "), (None, "a b c d"), (4, "a b c d"), (4, "a b c d"), (5, long), (6, long), (None, None), (7, "é ü x")]
    return documents(rows)
