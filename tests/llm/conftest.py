import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def awkward(spark):
    """Nulls in every column, empty and very long texts, exact and near copies, repeated rows."""
    r = random.Random(7)
    words = [f"wort{i}x" for i in range(400)]
    prose = lambda n: " ".join(r.choice(words) for _ in range(n))
    long = prose(30_000)
    base = prose(120)
    near = base.split()
    near[60] = "anders"
    passage = prose(90)
    texts = {1: None, 2: "", 3: " \n\t ", 4: "one", 5: base, 6: base, 7: " ".join(near), 8: long,
             9: prose(40) + ". " + passage + " " + prose(30), 10: prose(50) + "\n" + passage, 11: "x" * 5000,
             12: "Größe, naïve 日本語 \U0001f600 'll don't", 13: "\n\n" + "same line\n" * 40}
    rows = [(i, t, "de" if i % 2 else None, None if i == 4 else f"s{i}", None) for i, t in texts.items()]
    rows += [rows[3], (14, "   one   ", "fr", "s", 1)]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="session")
def unnamed(spark):
    """Documents without an id: (lang, text), beside two with ids. Near copies differ in one word of 120."""
    r = random.Random(9)
    a, b, c, d = (" ".join(f"{x}{r.randrange(900)}" for _ in range(120)) for x in "abcd")
    near = lambda t: t.rsplit(" ", 1)[0] + " anders"
    rows = [(7, a, "a7"), (None, a, "a"), (None, near(a), "a'"), (None, b, "b"), (None, b, "b"), (None, near(b), "b'"),
            (None, c, "c"), (-5, near(d), "d-5"), (None, d, "d"), (None, "", "empty"), (None, "", "empty"), (None, None, "null"), (None, " \n", "blank"), (None, "one", "one")]
    return spark.createDataFrame([(i, t, x, "s", None) for i, t, x in rows], SCHEMA)


@pytest.fixture(scope="session")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def clashing(awkward):
    """Extra columns whose names operators use inside."""
    from pyspark.sql import functions as F
    return awkward.select("*", *(F.lit(1).alias(c) for c in (
        "rid", "bands", "n_tokens", "score", "words", "places", "kept", "component_id", "label", "ids", "part", "hits")))


def texts_of(df):
    return [(r["doc_id"], r["text"] or "") for r in df.select("doc_id", "text").collect()]
