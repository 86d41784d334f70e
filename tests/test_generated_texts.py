"""Text queries on generated texts that mix everything the rules react to, against SQL.

The SQL is written from the rules as set operations and shares no code with the engine.
"""

import random

import duckdb
import pytest

import __spark_entry__ as contract
from tests.test_queries import rows

TOKENS = [
    "a", "b", "Z", "Q", "9", "0", ".", ",", ";", ":", "(", ")", "=", "<", ">", "%", "-", "--",
    "_", "__", "*", "**", "\\(", "\\)", "\\[", "\\]", "^", " ", "  ", "\n", "\n\n", "aaaa", "...",
    "!!!", "Section 5 3", "Fig", "e.g", "App", "â€™", "Ã©", "âˆ†", "âˆž", "Chapter  3  4", "$x$", "$",
    "et al", "\\begin{align}x\\end{align}", "∑", "=3", "é", "ß", "_ 1", " ^ 2", "Introduction",
    "ABC DEF", "1.2 Ab", "1.2.3 Cd", "Â±", "CHAPTER 3\n", "12\n", "xiv\n", ". ", "? Z", "alpha beta ",
]
NAMES = [
    "clean_missing_spaces", "clean_encoding", "clean_math_symbols", "clean_artifacts",
    "clean_abbreviations", "clean_whitespace", "clean_text_full", "clean_text_expression",
    "protect_math", "extract_equations", "clean_for_chunking", "section_boundaries",
    "strip_headings", "split_paragraphs", "split_sentences", "char_windows", "chunk_documents",
    "chunk_plain_documents", "clean_text_fixed", "clean_for_chunking_fixed",
]


@pytest.fixture(scope="module")
def generated(spark, tmp_path_factory):
    rng = random.Random(5)
    folder = tmp_path_factory.mktemp("generated")
    texts = [
        "".join(rng.choice(TOKENS) for _ in range(rng.choice([0, 5, 40, 40, 120, 400]))) for _ in range(250)
    ]
    docs = [(i, t, f"s{i % 3}") for i, t in enumerate(texts)]
    path = f"{folder}/documents.parquet"
    spark.createDataFrame(docs, "doc_id long, text string, source string").coalesce(1).write.parquet(path)
    duck = duckdb.connect()
    duck.execute(f"CREATE VIEW documents AS SELECT * FROM '{path}/*.parquet'")
    return str(folder), duck


@pytest.mark.parametrize("name", NAMES)
def test_same_result(spark, generated, name):
    folder, duck = generated
    got = contract.queries()[name](spark, folder).toPandas()
    want = duck.sql(contract.oracle_sql()[name]).df()
    columns = sorted(got.columns)
    assert columns == sorted(want.columns)
    assert rows(got, columns) == rows(want, columns)
