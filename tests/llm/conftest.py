import pytest

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, rep string, node string, block int, digest string"
LONG = " ".join(f"w{i}" for i in range(120))
NEAR = LONG.replace("w60", "x60")


@pytest.fixture(scope="session")
def messy_rows():
    """Nulls, empty and blank texts, ties, repeated rows, long runs and a very long text."""
    texts = [
        (1, LONG), (2, LONG), (3, None), (4, ""), (5, "  \t\n"), (6, NEAR), (7, LONG + " tail"), (7, LONG + " tail"),
        (8, "a"), (9, "a b"), (10, "the " * 300), (11, "the " * 170 + "end"), (12, "é " * 90 + "ü"), (13, "start " + LONG),
        (14, " ".join(f"q{i % 977}" for i in range(30_000))), (15, "A B C a b c"), (16, "a b c A B C"), (17, "日本語のテキスト 🤦🏼 " * 30),
        (18, "日本語のテキスト 🤦🏼 " * 29), (None, LONG), (None, "lonely text without id"), (19, "a\x1cb c\x0bd"),
    ]
    return [(i, t, "en" if (i or 0) % 2 else None, f"src{(i or 0) % 4}" if i != 4 else None, len(t) if t else None, "x", "y", 1, "z")
            for i, t in texts]


@pytest.fixture(scope="session")
def messy(spark, messy_rows):
    return spark.createDataFrame(messy_rows, SCHEMA).repartition(3)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)
