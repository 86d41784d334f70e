import random

import pytest
from pyspark.sql import functions as F

from folioforge.operators.books import documents_from_pages
from folioforge.session import shared_dir
from folioforge.operators import adjacency
from folioforge.operators.adjacency import adjacent_pairs
from folioforge.operators.ranks import number_rows, size_profile

PS = {"p10": 0.1, "p50": 0.5, "p90": 0.9, "p99": 0.99}


@pytest.mark.parametrize("n, top", [(0, 9), (1, 9), (10, 9), (100, 5), (5000, 9000), (3000, 3)])
def test_nearest_rank(spark, n, top):
    rng = random.Random(n)
    values = [rng.randint(0, top) for _ in range(n)]
    df = spark.createDataFrame([(v,) for v in values], "v int")
    rows = size_profile(df, {"a": F.col("v"), "b": F.col("v") * 2}, PS).collect()
    assert len(rows) == (2 if n else 0)
    for r in rows:
        s = sorted(v * (2 if r.measure == "b" else 1) for v in values)
        assert (r.n, r["min"], r["max"]) == (n, s[0], s[-1])
        assert r["mean"] == pytest.approx(sum(s) / n)
        for name, p in PS.items():
            assert r[name] == s[min(int(n * p), n - 1)]


def test_hot_value(spark):
    """One value with most of the rows is one histogram row."""
    df = spark.range(100_000).select(F.when(F.col("id") % 3 < 2, 7).otherwise(F.col("id")).alias("v"))
    r = size_profile(df, {"v": F.col("v")}, PS).first()
    s = sorted(7 if i % 3 < 2 else i for i in range(100_000))
    assert [r[k] for k in PS] == [s[min(int(len(s) * p), len(s) - 1)] for p in PS.values()]


def test_number_rows(spark):
    rows = [(f"b{i % 3}", i) for i in range(500)]
    random.Random(1).shuffle(rows)
    df = spark.createDataFrame(rows, "book string, page int").repartition(7)
    got = [(r.book, r.page) for r in number_rows(df, ["book", "page"]).orderBy("row").collect()]
    assert got == sorted(rows)
    numbers = [r.row for r in number_rows(df, ["book", "page"]).collect()]
    assert sorted(numbers) == list(range(500))


@pytest.mark.parametrize("span", [8192, 2])
def test_adjacent_pairs(spark, monkeypatch, span):
    monkeypatch.setattr(adjacency, "_SPAN", span)
    rng = random.Random(3)
    rows = []
    for doc in range(120):
        page = rng.choice([0, 0, 0, 1, 2])  # page 0 is hot and shared by many documents
        for i in range(rng.randint(1, 4)):
            start = rng.randint(0, 6)
            rows.append(("b", page, i, doc, start, start + rng.randint(0, 4)))
    schema = "book_title string, page_number int, chunk_index int, doc_seq long, start_char int, end_char int"
    got = adjacent_pairs(spark.createDataFrame(rows, schema)).first()
    over = gap = 0
    pages = {}
    for r in sorted(rows, key=lambda r: (r[2], r[3])):
        pages.setdefault(r[:2], []).append(r)
    for page in pages.values():
        for a, b in zip(page, page[1:]):
            over += b[4] < a[5]
            gap += b[4] > a[5]
    assert (got.overlap_pairs, got.gap_pairs) == (over, gap)


def test_documents_have_one_order(spark):
    """Two files with the same page numbers."""
    pages = spark.createDataFrame(
        [(f, p, 3, f"text of {f} {p}", []) for f in ("b.pdf", "a.pdf") for p in (2, 0, 1)],
        "file string, page0 int, total_pages int, text string, images array<struct<path:string>>",
    )
    docs = documents_from_pages(pages).orderBy("doc_seq").collect()
    assert [d.content for d in docs] == [f"text of {f} {p}" for f in ("a. pdf", "b. pdf") for p in range(3)]
    assert len({d.doc_seq for d in docs}) == 6


def test_shared_folder_or_an_error():
    """Beyond one process, a folder of the driver is no shared folder."""
    class Session:
        class conf:
            get = staticmethod(lambda key, default=None: {"spark.master": master}.get(key, default))

        class sparkContext:
            applicationId = "app"

    for master in ("local-cluster[3,2,900]", "yarn", "spark://host:7077", "k8s://x"):
        with pytest.raises(ValueError, match="spark.checkpoint.dir"):
            shared_dir(Session)
    for master in ("local", "local[*]", "local[8]", "local[4,2]"):
        assert shared_dir(Session)


def test_adjacent_pairs_empty(spark):
    schema = "book_title string, page_number int, chunk_index int, doc_seq long, start_char int, end_char int"
    got = adjacent_pairs(spark.createDataFrame([], schema)).first()
    assert (got.overlap_pairs, got.gap_pairs) == (0, 0)
