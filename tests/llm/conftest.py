import pytest

from kpilane.llm.common import ship_package

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score double, part string"


@pytest.fixture(scope="session", autouse=True)
def _package(spark):
    ship_package(spark)


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls in every column, empty and long texts, ties, repeated rows, and columns named like internal ones."""
    text = "the cat sat on the mat and looked at the dog\nin the garden"
    rows = [(1, text, "en", "a", 1, 0.5, "x"), (1, text, "en", "a", 1, 0.5, "x"), (2, text, None, None, None, None, None),
            (3, None, "de", "b", 0, 0.1, "y"), (4, "", "de", "b", 0, 0.1, "y"), (None, "no id here", "en", "c", 3, None, None),
            (5, "word " * 30_000, "en", "a", 9, 0.2, "z"), (6, "x" * 100_000, None, "a", 9, 0.2, "z"),
            (7, " \n\t ", "en", "a", 9, 0.2, "z"), (8, "ÄÖ é 中文 😀 ", "de", "a", 9, 0.2, "z")]
    return spark.createDataFrame(rows, SCHEMA)
