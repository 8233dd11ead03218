import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size string, row string, fp double, doc string, tag string, pos string, part string, rank string, _t string, score string"
PASSAGE = " ".join(f"passage{i}" for i in range(40))


def fill(rows):
    return [(*r, len(r[1] or ""), "s", "r", 1.5, "d", "t", "p", "q", "k", "x", "y") for r in rows]


ODD = [
    (1, None, None, None),
    (2, "", "en", "a"),
    (3, "  \t\n\x0b\x0c\r ", "en", "b"),
    (4, "word", "en", None),
    (5, PASSAGE + " alpha beta", "en", "a"),
    (6, "gamma " + PASSAGE, "en", "c"),
    (7, PASSAGE + " alpha beta", "de", "a"),
    (None, PASSAGE, "fr", "b"),
    (8, "née Ünïcode \U0001f600 text mail a.b@c.org and 10.0.0.1", "fr", "b"),
    (9, "x" * 30_000 + " " + "long words here " * 4000, "en", "a"),
    (10, "repeated row of words " * 5, "en", "d"),
    (10, "repeated row of words " * 5, "en", "d"),
    (11, "\x00 \x1c null-like \x85 bytes   and    spaces", "en", "e"),
]


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls in any column, empty, blank, very long and repeated rows, and columns whose names clash."""
    return spark.createDataFrame(fill(ODD), SCHEMA).repartition(3)


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], SCHEMA)
