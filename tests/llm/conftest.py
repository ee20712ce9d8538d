import pytest

LONG = "word " * 9000 + "é" * 2000 + " end\nThe same line of words stands here again.\n" * 3
NEAR = " ".join(f"w{i}" for i in range(60))
ROWS = [
    (1, None, "en", "a", 0), (2, "", "en", "a", 0), (3, " \t\n", None, None, None), (4, "Hello, world! a@b.example.com +1 (555) 555-0199", "en", "b", 1),
    (5, "hello, WORLD! a@b.example.com +1 (555) 555-0199", "en", "b", 1), (6, LONG, "fr", "c", 5), (7, LONG, "fr", "c", 5), (8, NEAR, "en", "a", 9), (9, NEAR + " extra", "en", None, 9),
    (10, NEAR.replace("w59", "x"), "de", "b", 9), (11, "日本語 テキスト 10.0.0.255 4111 1111 1111 1111", None, "c", 2), (12, "one", "en", "a", 1), (12, "one", "en", "a", 1), (None, "no id here", "en", "b", 1),
    (13, "'s don't <|endoftext|> we'RE 1234567890 İΣ", "en", "a", 1),
]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, _id long, _text string, kept boolean, _score double, keep_id string, _key long, block string"


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls, empty and long texts, ties, repeated rows, and further columns with names that operators use."""
    return spark.createDataFrame([(*r, 1, "x", True, 0.5, "k", 2, "b") for r in ROWS], SCHEMA).repartition(3).persist()


@pytest.fixture(scope="session")
def none(odd):
    return odd.limit(0)


@pytest.fixture(scope="session")
def texts():
    return [(r[0], r[1] or "") for r in ROWS]
