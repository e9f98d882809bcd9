from __future__ import annotations

import random

import pytest
from pyspark.sql import SparkSession

DOCUMENTS = "doc_id bigint, text string, lang string, source string, n_chars bigint"


@pytest.fixture
def documents(spark: SparkSession):
    """Builds a table of documents from (doc_id, text) pairs."""

    def build(rows):
        full = [(i, t, "en", "s", None if t is None else len(t)) for i, t in rows]
        return spark.createDataFrame(full, DOCUMENTS)

    return build


@pytest.fixture
def sentence():
    """A generator of invented sentences that do not repeat each other."""

    def build(seed: int, words: int) -> str:
        rng = random.Random(seed)
        syllables = ["ka", "lo", "mi", "tu", "re", "san", "vel", "dor", "é", "ñu"]
        return " ".join(
            "".join(rng.choice(syllables) for _ in range(rng.randint(1, 4))) for _ in range(words)
        )

    return build


@pytest.fixture
def odd_rows(sentence):
    """Nulls, empty and blank texts, a very long text, ties and repeated rows."""
    plain = sentence(1, 60)
    return [
        (1, plain),
        (2, plain),
        (2, plain),
        (3, None),
        (4, ""),
        (5, " \n\t "),
        (6, "one"),
        (None, sentence(2, 40)),
        (None, None),
        (7, "\n".join(sentence(100 + i, 50) for i in range(80))),
        (8, plain.upper()),
        (9, "ключ 中文 ﬁ ́ x y z"),
    ]


@pytest.fixture
def with_clashes(documents, odd_rows):
    """The odd rows with extra columns named like columns that operators use inside."""
    from pyspark.sql import functions as F

    names = ["n", "token", "node", "row", "chunk", "spans", "rank", "length", "piece", "ids"]
    return documents(odd_rows).withColumns({name: F.lit(f"extra {name}") for name in names})
