import random

import pytest

from answerscope.llm.common import prepare


@pytest.fixture()
def session(spark):
    return prepare(spark)


@pytest.fixture()
def edge(session):
    """Documents with every hard case: NULLs in any column, empty and long texts, ties, repeated rows, and columns whose names the operators use."""
    rng = random.Random(3)
    long = " ".join(rng.choice(["alpha", "beta.", "gamma\n", "delta", "ω", "日本", "token=abcdef123"]) for _ in range(60_000))
    rows = [
        (1, "one two three four five six", "en", "a", 27), (2, "one  two three\nfour five six", "en", "a", 28), (3, None, "en", "b", None),
        (4, "", None, None, 0), (5, "   ", "de", "b", 3), (6, long, "en", "a", len(long)), (7, long, "en", "b", len(long)), (7, long, "en", "b", len(long)),
        (None, "no id at all here now", "fr", "c", 21), (None, None, None, None, None), (8, "x", "en", "c", 1), (9, "ünïcödé 🎉 text.\n\nSecond part. Third part!", "de", None, 40),
    ]
    extra = "n, size, token, block, row_id, keep_id, score, node, first, g, blob, findings, removed, n_tokens, word, comp, turn, tree, rare, fingerprint".split(", ")
    schema = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"{c} string" for c in extra)
    return session.createDataFrame([(*r, *["x"] * len(extra)) for r in rows], schema)


@pytest.fixture()
def docs_of(session):
    return lambda rows: session.createDataFrame(rows, "doc_id long, text string")
