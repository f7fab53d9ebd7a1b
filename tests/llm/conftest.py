"""The session comes from tests/conftest.py; here only what the llm tests share."""

from __future__ import annotations

import random

import pytest

WORDS = "river stone green light paper table window garden silver morning".split()


@pytest.fixture(scope="session")
def vocab():
    from sensorquery.llm.queries import vocabulary

    return vocabulary()


@pytest.fixture(scope="session")
def awkward():
    """(doc_id, text, doc_id again under another name): null, empty, blank, long, tied and repeated rows."""
    rng = random.Random(5)
    say = lambda n: " ".join(rng.choice(WORDS) + str(rng.randrange(40)) for _ in range(n))
    base, passage = say(60), say(30)
    rows = [
        (1, base), (2, base.upper()), (3, base + " tail"), (4, None), (5, ""), (6, " \n\t "), (7, "one two"),
        (8, "one two"), (9, say(20) + " " + passage), (10, passage + "\n" + say(15)), (11, say(4000)),
        (12, "naïve 日本 ß   x y <|endoftext|> end"), (13, passage + " " + passage), (14, base),
        (15, "password = 'hunter2hunter2' AKIA" + "Z9" * 9 + " " + "0f" * 16), (15, "another text of the same id"),
        (16, say(12)), (16, say(12)), (None, base), (None, None), (17, passage), (17, passage),
    ]
    return rows


@pytest.fixture(scope="session")
def awkward_docs(spark, awkward):
    """With extra columns whose names clash with those the operators make."""
    more = ("host", "path", "n", "s", "log_odds", "base", "spans", "_id", "_sha", "row", "site", "quality")
    rows = [(i, t, "en", "s", len(t or ""), 7, "x", *[f"{c} {k}" for c in more]) for k, (i, t) in enumerate(awkward)]
    return spark.createDataFrame(
        rows, "doc_id long, text string, lang string, source string, n_chars long, size int, label string, "
        + ", ".join(f"{c} string" for c in more)
    ).repartition(3)


@pytest.fixture(scope="session")
def no_docs(awkward_docs):
    return awkward_docs.where("doc_id > 1000000")
