import random
import re
import time

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from folioforge import schemas
from folioforge.operators import chunking
from folioforge.operators.chunking import ChunkSettings, chunk_documents

TOKENS = [
    "alpha ", "Beta ", "gam", "é", "x" * 30, ". ", "! ", "? Z", "\n", "\n\n", "\n \n", "CHAPTER 3\n",
    "3.1 Title\n", "12\n", "xiv\n", "  ", ". (", "\xa0", "y" * 7 + " ", ". 9", "\r", "\n\n\n",
]


def documents(spark, texts):
    rows = [
        (f"d{i}", t, {"page": "1"}, i, "book", "", "", [], i) for i, t in enumerate(texts)
    ]
    return spark.createDataFrame(rows, schemas.DOCUMENT)


def chunked(spark, texts, cfg):
    got = {i: [] for i in range(len(texts))}
    for r in chunk_documents(documents(spark, texts), ChunkSettings(*cfg)).collect():
        got[r.doc_seq].append(
            (r.id, r.content, r.chunk_index, r.total_chunks, r.start_char, r.end_char,
             r.section, r.headings)
        )
    return [sorted(got[i], key=lambda c: c[2]) for i in range(len(texts))]


def contents(spark, text, cfg):
    return [c[1] for c in chunked(spark, [text], cfg)[0]]


def test_short_text_is_one_chunk(spark):
    assert contents(spark, "Some body.", (40, 5, 5)) == ["Some body."]
    assert contents(spark, "abc", (40, 5, 5)) == []  # below the least size
    assert contents(spark, " \n ", (40, 5, 5)) == contents(spark, "", (40, 5, 5)) == []
    assert contents(spark, "x" * 40, (40, 5, 5)) == ["x" * 40]


def test_paragraphs_are_packed(spark):
    text = "\n\n".join(["alpha beta", "gamma delta", "epsilon zeta", "eta theta iota"])
    # Two fit in 25 characters with their separator; nothing is repeated without overlap.
    assert contents(spark, text, (25, 0, 5)) == ["alpha beta\n\ngamma delta", "epsilon zeta", "eta theta iota"]


def test_long_sentences_become_windows(spark):
    got = contents(spark, "".join(chr(97 + i % 26) for i in range(250)), (100, 20, 30))
    assert [len(c) for c in got[:2]] == [100, 100] and got[0][-20:] == got[1][:20]
    assert len(contents(spark, "z" * 1000, (1000, 200, 100))) == 1


@pytest.mark.parametrize("cfg", [(100, 20, 10), (100, 90, 1), (40, 0, 5), (1000, 200, 100)])
def test_invariants(spark, cfg):
    """Whatever the text: numbering, bounds, order, and no word lost that is long enough."""
    size, _, least = cfg
    rng = random.Random(7)
    texts = [
        "".join(rng.choice(TOKENS) for _ in range(rng.choice([0, 3, 20, 60, 200, 500])))
        for _ in range(120)
    ]
    for t, got in zip(texts, chunked(spark, texts, cfg)):
        for i, c in enumerate(got):
            assert c[2] == i and c[3] == len(got)
            assert least <= len(c[1]) <= 2 * size and c[5] - c[4] == len(c[1])
            assert c[1] == c[1].strip()
            # Chunks are made of the text: each of their words is in it.
            assert all(w in t for w in c[1].split())
        assert len({c[0] for c in got}) == len(got)


def test_window_tail_inside_previous(spark):
    texts = ["z" * 1000]
    lengths = documents(spark, texts).select(
        F.transform(chunking.char_windows("content"), lambda w: F.length(w)).alias("w")
    )
    assert lengths.first().w == [1000, 200]


@pytest.mark.parametrize(
    "text, headings, body",
    [
        ("12\nBody", [], "Body"),
        ("xiv\nBody", [], "Body"),
        ("CHAPTER 3\n3.1 Title\nBody\n4.1 Later", ["CHAPTER 3", "3.1 Title"], "Body\n4.1 Later"),
        ("\n".join(f"{i}.1 Title" for i in range(14)), [f"{i}.1 Title" for i in range(12)],
         "12.1 Title\n13.1 Title"),
        ("CHAPTER 3\n\n7", ["CHAPTER 3"], ""),
        ("CHAPTER 3b\nBody", [], "CHAPTER 3b\nBody"),
        ("mix\nBody", [], "Body"),
        ("  Body only ", [], "Body only"),
    ],
)
def test_headings(spark, text, headings, body):
    h = documents(spark, [text]).select(chunking.strip_headings("content").alias("h")).first().h
    assert (h.headings, h.body, h.section) == (headings, body, headings[0] if headings else "")


def test_chunk_metadata(spark):
    text = "CHAPTER 3\n3.1 Title\n" + "Body words here. " * 20
    chunk = chunk_documents(documents(spark, [text])).first()
    assert chunk.metadata == {
        "page": "1", "headings": "CHAPTER 3; 3.1 Title", "section": "CHAPTER 3",
    }
    plain = chunk_documents(documents(spark, ["Body words here. " * 20])).first()
    assert plain.metadata == {"page": "1"}


def test_overlap_must_be_smaller():
    with pytest.raises(ValueError, match="overlap"):
        ChunkSettings(100, 100)


@settings(max_examples=6, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(st.text(alphabet="ab .\nXé", max_size=400), min_size=1, max_size=30))
def test_properties(spark, texts):
    for t, got in zip(texts, chunked(spark, texts, (60, 15, 5))):
        for i, c in enumerate(got):
            assert c[2] == i and c[3] == len(got)
            assert 5 <= len(c[1]) <= 120 and c[5] - c[4] == len(c[1])
            assert i == 0 or c[4] >= got[i - 1][5]


def placed(body, texts):
    pos, out = 0, []
    for t in texts:
        hit = body.find(t, pos)
        start = hit if hit >= 0 else pos
        out.append((t, start, start + len(t)))
        pos = start + len(t)
    return out


def test_chunks_are_placed_from_the_cursor_on(spark):
    rng = random.Random(4)
    cases = [("", ["a"]), ("abc", ["abcd", "c"]), ("é1é1é1", ["é1", "1é", "é1", "é1", "x" * 9, "é"]), ("ab ab", [])]
    for _ in range(200):
        body = "".join(rng.choices("ab é", k=rng.choice([5, 40])))
        cuts = [sorted(rng.choices(range(len(body) + 1), k=2)) for _ in range(6)]
        cases.append((body, [body[i:j] or "b" for i, j in cuts] + ["a\nb"]))
    df = spark.createDataFrame(cases, "body string, texts array<string>")
    got = df.select(chunking.place_chunks("body", "texts").alias("x")).collect()
    for (body, texts), row in zip(cases, got, strict=True):
        assert [tuple(p) for p in row.x] == placed(body, texts), (body, texts)


def test_chunk_rows_do_not_carry_their_text(spark):
    """Each chunk carried the struct with its whole text up to the encoder, which queues rows."""
    chunks = chunk_documents(documents(spark, ["Some words. " * 400])).select("id", "content", "section", "headings")
    assert chunks.count() > 1
    plan = chunks._jdf.queryExecution().executedPlan().toString()
    (kept,) = re.findall(r"\), \[([^\]]*)\], true, \[chunk_index", plan)
    assert "section" in kept and "headings" in kept
    assert "head#" not in kept and "body" not in kept


def test_placing_does_not_search_what_is_passed(spark):
    """Overlapping chunks of one text take less time than twice a search of it for each.

    They were searched from the start, and then stepped over up to the cursor.
    """
    body = " ".join(f"Sentence {i} of this body says that {i * 7919 % 1000003} is not {i * 31}." for i in range(3000))
    texts = [body[max(0, i - 200) : i + 800] for i in range(0, len(body), 800)]
    df = spark.createDataFrame([(body, texts)], "body string, texts array<string>").cache()

    def seconds(expr):
        times = []
        for _ in range(6):
            start = time.perf_counter()
            df.select(expr).write.format("noop").mode("overwrite").save()
            times.append(time.perf_counter() - start)
        return min(times)

    searches = seconds(F.expr("size(filter(texts, t -> contains(body, concat(t, '#'))))"))
    assert seconds(chunking.place_chunks("body", "texts")) < 1.7 * searches
    df.unpersist()
