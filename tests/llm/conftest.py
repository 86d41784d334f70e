"""Small tables with every odd case: nulls, empty and long texts, ties, clashing columns."""

import pytest

DOCS = "doc_id long, text string, lang string, source string, n_words long, length long, copies string"


def words(n, start=0):
    return " ".join(f"w{i}" for i in range(start, start + n))


@pytest.fixture(scope="session")
def odd_rows():
    long_text = " ".join(f"x{i % 977} the" for i in range(30_000))
    return [
        (1, words(60), "en", "a", 1, 1, "c"),
        (2, words(60), "en", "a", None, 1, None),
        (2, words(60), "en", "a", None, 1, None),  # a repeated row
        (3, None, "en", "b", 1, None, "c"),
        (4, "", "de", None, 1, 1, "c"),
        (5, " \t\n ", None, "b", 1, 1, "c"),
        (6, words(60, 1), "de", "", 1, 1, "c"),
        (None, "no id", None, None, None, None, None),
        (None, None, None, None, None, None, None),
        (7, "über ÄÖ Größe 𝄞 #$ " * 30, "de", "b", 1, 1, "c"),
        (8, long_text, "en", "a", 1, 1, "c"),
        (9, "ab " * 400, "en", "a", 1, 1, "c"),
    ]


@pytest.fixture(scope="session")
def odd(spark, odd_rows, tmp_path_factory):
    """As files, like all inputs: row ids follow from the place of a row."""
    path = str(tmp_path_factory.mktemp("odd") / "documents.parquet")
    spark.createDataFrame(odd_rows, DOCS).repartition(3).write.parquet(path)
    return spark.read.parquet(path)


@pytest.fixture(scope="session")
def none(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("none") / "documents.parquet")
    spark.createDataFrame([], DOCS).write.parquet(path)
    return spark.read.parquet(path)


def by_row(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)
