import random

import pytest
from pyspark.sql import functions as F

DOC = "doc_id long, text string, lang string, source string, n_chars long, words string, vector string, spans string"


@pytest.fixture
def documents(spark):
    """Documents from (doc_id, text[, lang, source]), with extra columns whose names operators use inside."""

    def make(rows):
        full = [(r[0], r[1], r[2] if len(r) > 2 else "en", r[3] if len(r) > 3 else "s0", len(r[1] or ""), "x", "y", "z") for r in rows]
        return spark.createDataFrame(full, DOC).withColumns({c: F.lit("clash") for c in ("content", "minimizer", "label", "cell", "blob", "topic")})

    return make


def prose(rng: random.Random, n: int, vocabulary: int = 400) -> str:
    return " ".join(f"w{rng.randrange(vocabulary)}" for _ in range(n))


AWKWARD = [(1, None), (2, ""), (3, " \t\n\x0b\f\r "), (4, "one"), (5, "ein Ünïcode ß text 😀 " * 3), (6, "no-break space\x00nul"), (6, "no-break space\x00nul"), (None, "null id row of some words here")]
