import random

import pytest

DOCUMENTS = "doc_id long, text string, lang string, source string, n_chars long, id string, value double"


@pytest.fixture(scope="session")
def sf_dir():
    return "/root/testdata/sf0.001"


def prose(seed: int, n: int) -> str:
    r = random.Random(seed)
    words = ["".join(r.choice(["ka", "lo", "mi", "ren", "to", "é", "sch"]) for _ in range(r.randint(1, 4))) for _ in range(300)]
    return "\n".join(" ".join(r.choice(words) for _ in range(12)) + "." for _ in range(max(1, n // 12)))


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Nulls in every column, empty and wordless and long texts, repeated rows, a repeated id, clashing column names."""
    shared = prose(1, 60)
    texts = [None, "", " \n\t ", "one", "two words", prose(2, 120), prose(2, 120), shared + "\n" + prose(3, 60), prose(4, 60) + "\n" + shared, prose(5, 30_000), "x " * 400, "x" * 5000, "Αs Σ <|endoftext|>  Ünï\x1cx", prose(6, 200), prose(6, 200)]
    rows = [(i if i != 4 else None, t, None if i % 5 == 0 else "en", None if i % 7 == 0 else "s", len(t) if t is not None else None, "clash", 1.0) for i, t in enumerate(texts)]
    rows += [rows[5], rows[5], (5, prose(9, 90), None, None, None, None, None), ((1 << 62) + 1, prose(10, 80), "en", "s", 1, None, None)]
    return spark.createDataFrame(rows, DOCUMENTS)


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], DOCUMENTS)


@pytest.fixture(scope="session")
def no_labels(spark):
    return spark.createDataFrame([], "doc_id long, quality int, toxic int")


@pytest.fixture(scope="session")
def labels(spark):
    return spark.createDataFrame([(5, 1, 0), (7, 0, 1), (8, None, None), (None, 1, 1), (5, 1, 0), (10, 0, 0)], "doc_id long, quality int, toxic int")
