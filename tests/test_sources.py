import json
import os

import pytest
from pyspark.sql import functions as F

from folioforge import cli, schemas
from folioforge.operators.books import documents_from_pages
from folioforge.operators.chunking import chunk_documents
from folioforge.operators.embedding import HashingEncoder
from folioforge.plans import chunk_report, diagnostics, reports
from folioforge.sources import pdf, splits, tables
from folioforge.streaming.ingest import stream_chunks


def fake_parse(data):
    """A 'PDF' of this test: pages separated by form feeds, ``IMG``/``BAD`` mark images."""
    pages = data.decode().split("\f")
    for text in pages:
        images = []
        if "IMG" in text:
            images.append(lambda: pdf.ParsedImage(9, b"png", "png", 3, 4))
        if "BAD" in text:
            images.insert(0, lambda: 1 / 0)
        yield pdf.ParsedPage(text, len(pages), images)


@pytest.fixture
def pdfs(tmp_path):
    (tmp_path / "pdfs").mkdir()
    (tmp_path / "pdfs" / "one.pdf").write_bytes(b"wordWord here IMG BAD\f \n \fLast page")
    (tmp_path / "pdfs" / "two.pdf").write_bytes(b"Other")
    (tmp_path / "pdfs" / "skip.txt").write_bytes(b"no")
    books = [
        {"file": "one.pdf", "title": "One: A Book", "author": "X", "year": 2016, "level": "l"},
        {"file": "one.pdf", "title": "Second entry"},
    ]
    (tmp_path / "books.json").write_text(json.dumps({"books": books}, indent=1))
    return tmp_path


def test_pdf_to_documents(spark, pdfs):
    books = tables.read_books(spark, str(pdfs / "books.json"))
    pages = pdf.read_pdf_pages(
        spark, str(pdfs / "pdfs"), str(pdfs / "img"), fake_parse, books
    )
    docs = {(r.metadata["book_file"], r.page_number): r
            for r in documents_from_pages(pages, books).collect()}
    assert set(docs) == {("one.pdf", 1), ("one.pdf", 3), ("two.pdf", 1)}
    first, other = docs["one.pdf", 1], docs["two.pdf", 1]
    assert first.content == "word Word here IMG BAD" and first.book_title == "One: A Book"
    assert first.metadata["year"] == "2016" and "domain" not in first.metadata
    assert first.metadata["has_images"] == "true" and first.metadata["total_pages"] == "3"
    image = first.images[0]
    assert image.path.endswith(os.path.join("One_A_Book", "page_0001_img_002.png"))
    assert open(image.path, "rb").read() == b"png" and (image.width, image.page) == (3, 1)
    assert other.book_title == "two" and other.metadata["author"] == "Unknown"
    assert other.metadata["domain"] == "machine_learning" and other.images == []
    assert first.id == spark.sql("select substr(md5('one.pdf_0'), 1, 12)").first()[0]


def test_missing_metadata_file(spark, pdfs):
    assert tables.read_books(spark, str(pdfs / "none.json")) is None
    pages = pdf.read_pdf_pages(spark, str(pdfs / "pdfs"), parse=fake_parse)
    titles = {r.book_title for r in documents_from_pages(pages, None).collect()}
    assert titles == {"one", "two"}


def test_json_array_documents(spark, tmp_path):
    path = tmp_path / "documents.json"
    path.write_text(json.dumps(
        [{"id": "a", "content": "x\ny", "metadata": {"year": 2016, "has_images": False},
          "page_number": 1, "book_title": "B", "images": []}], indent=2))
    d = tables.read_documents(spark, str(path), array=True).first()
    assert (d.content, d.metadata["year"], d.metadata["has_images"]) == ("x\ny", "2016", "false")


def test_golden(spark, tmp_path):
    good = {"id": "q1", "book": "B", "query": "why", "difficulty": "easy"}
    path = tmp_path / "golden.jsonl"
    path.write_text(json.dumps(good) + "\n\n" + json.dumps({**good, "id": "q2", "notes": "n"}) + "\n")
    rows = {r.id: r for r in tables.read_golden(spark, str(path)).collect()}
    assert rows["q1"].expected_answer_summary == "" and rows["q1"].notes == ""
    assert rows["q2"].notes == "n"
    path.write_text('{"id": "q1", broken\n')
    with pytest.raises(Exception, match="Invalid JSONL at line 1: "):
        tables.read_golden(spark, str(path)).collect()
    path.write_text('{"id": "q1", "book": "B"}\n')
    with pytest.raises(Exception, match="lacks keys at line 1: query, difficulty"):
        tables.read_golden(spark, str(path)).collect()


@pytest.fixture
def small_splits(spark):
    """Files of a few kilobytes are read by several tasks."""
    spark.conf.set("spark.sql.files.maxPartitionBytes", "700")
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    yield
    spark.conf.unset("spark.sql.files.maxPartitionBytes")
    spark.conf.unset("spark.sql.files.openCostInBytes")


def test_line_numbers_over_splits(spark, tmp_path, small_splits):
    lines = [("" if i % 7 == 3 else f"line {i} " + "x" * (i % 50)) for i in range(400)]
    for name, own in (("a.txt", lines), ("b.txt", lines[:123]), ("c.txt", [])):
        (tmp_path / name).write_text("\n".join(own) + ("\n" if own else ""))
    got = splits.read_lines(spark, str(tmp_path))
    assert got.rdd.getNumPartitions() > 5
    by_file = {}
    for r in got.collect():
        by_file.setdefault(os.path.basename(r.file), {})[r.line] = r.value
    assert by_file == {n: {i + 1: v for i, v in enumerate(own)} for n, own in (("a.txt", lines), ("b.txt", lines[:123]))}


def test_broken_line_is_named_by_its_number(spark, tmp_path, small_splits):
    good = [json.dumps({"id": f"q{i}", "book": "B", "query": "why " * 9, "difficulty": "easy"}) for i in range(60)]
    lines = [x for g in good for x in (g, "  ")]
    lines[87] = '{"id": "q", oops'
    (tmp_path / "golden.jsonl").write_text("\n".join(lines))
    with pytest.raises(Exception, match="Invalid JSONL at line 88: .*oops"):
        tables.read_golden(spark, str(tmp_path / "golden.jsonl")).collect()


ODD = ['a}{"b', 'quote " and \\', "[{]}", "\\\\", "ü 𝄞 \n\t", "", "}" * 30, '\\"}', "{" * 5, "," * 4]


@pytest.mark.parametrize("indent", [None, 2])
def test_array_records_over_splits(spark, tmp_path, small_splits, indent):
    """One array in many byte ranges: brackets, quotes and escapes at the seams."""
    rows = [{"id": i, "t": ODD[i % len(ODD)] * (i % 5 + 1), "in": {"x": [{"y": "}"}, i]}} for i in range(300)]
    rows[150]["t"] = 'long } " \\ { ' * 300  # over several ranges
    (tmp_path / "a.json").write_text(json.dumps(rows, indent=indent, ensure_ascii=False), encoding="utf-8")
    (tmp_path / "b.json").write_text(json.dumps(rows[:1], indent=indent) + "\n")
    (tmp_path / "c.json").write_text(" [ ]\n")
    got = splits.json_array_records(spark, str(tmp_path))
    assert splits._pieces(spark, str(tmp_path), "}").rdd.getNumPartitions() > 10
    by_file = {}
    for r in got.collect():
        by_file.setdefault(os.path.basename(r.file), []).append(json.loads(r.text))
    key = lambda r: r["id"]
    assert sorted(by_file["a.json"], key=key) == rows and by_file["b.json"] == rows[:1] and "c.json" not in by_file


@pytest.mark.parametrize("text", ['[{"a": 1}', '[{"a": "x}]', '[{"a": 1}}]', '[{"a": [1}]'])
def test_broken_arrays_are_errors(spark, tmp_path, text):
    (tmp_path / "a.json").write_text(text)
    with pytest.raises(Exception, match="whole JSON array|Invalid record"):
        tables.read_documents(spark, str(tmp_path / "a.json"), array=True).collect()


def test_array_parts_make_one_array(spark, tmp_path):
    docs = documents(spark, [f"text {i} }} \" ," for i in range(200)]).repartition(7)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    tables.write_documents(docs, str(tmp_path / "d"), array=True)
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    parts = sorted((tmp_path / "d").glob("part-*"))
    whole = "".join(p.read_text() for p in parts)
    assert len(parts) > 1 and [r["doc_seq"] for r in json.loads(whole)] == list(range(200))
    (tmp_path / "whole.json").write_text(whole)
    back = tables.read_documents(spark, str(tmp_path / "whole.json"), array=True)
    assert sorted(map(str, back.collect())) == sorted(map(str, docs.collect()))
    tables.write_documents(docs.limit(0), str(tmp_path / "e"), array=True)
    assert json.loads("".join(p.read_text() for p in (tmp_path / "e").glob("part-*"))) == []


def test_parts_are_read_as_one(spark, tmp_path, small_splits):
    """What several tasks have written: one array, and one sequence of lines."""
    docs = documents(spark, [o * (i % 4 + 1) for i, o in enumerate(ODD * 20)]).repartition(5)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    tables.write_documents(docs, str(tmp_path / "d"), array=True)
    lines = [("" if i % 3 else f"line {i} " + "x" * (i % 50)) for i in range(300)]
    rows = spark.createDataFrame(list(enumerate(lines)), "i long, value string")
    rows.repartitionByRange(6, "i").sortWithinPartitions("i").select("value").write.text(str(tmp_path / "l"))
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert len(list((tmp_path / "d").glob("part-*"))) > 1 and len(list((tmp_path / "l").glob("part-*"))) == 6
    back = tables.read_documents(spark, str(tmp_path / "d"), array=True, parts=True)
    assert sorted(map(str, back.collect())) == sorted(map(str, docs.collect()))
    got = splits.read_lines(spark, str(tmp_path / "l"), parts=True)
    assert {r.line: r.value for r in got.collect()} == {i + 1: v for i, v in enumerate(lines)}
    (tmp_path / "d" / "part-99999.txt").write_text('{"id": "more"\n')
    with pytest.raises(Exception, match="whole JSON array"):
        tables.read_documents(spark, str(tmp_path / "d"), array=True, parts=True).collect()


def documents(spark, texts):
    rows = [(f"d{i}", t, {"page": str(i)}, i, f"b{i % 2}", "", "", [], i) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, schemas.DOCUMENT)


TEXTS = ["CHAPTER 1\nSome words go here. " * 60, "short", "Ã© Figure 3 and Table 4. " * 30, ""]


def test_chunk_files(spark, tmp_path):
    chunks = chunk_documents(documents(spark, TEXTS))
    tables.write_chunks(chunks, str(tmp_path / "c"))
    back = tables.read_chunks(spark, str(tmp_path / "c"))
    assert sorted(map(str, back.collect())) == sorted(map(str, chunks.collect()))
    tables.write_chunks_parquet(back, str(tmp_path / "p"))
    flat = spark.read.parquet(str(tmp_path / "p"))
    assert {"metadata_page", "metadata_headings", "content_length"} <= set(flat.columns)
    assert "metadata" not in flat.columns
    with pytest.raises(ValueError, match="No 'embedding' column"):
        tables.read_embeddings(spark, str(tmp_path / "p"))


def test_stream_in_two_arrivals(spark, tmp_path):
    source, out, state = (str(tmp_path / n) for n in ("in", "out", "state"))
    docs = documents(spark, TEXTS)
    docs.filter("doc_seq < 2").write.parquet(source)
    stream_chunks(spark, source, out, state).awaitTermination()
    docs.filter("doc_seq >= 2").write.mode("append").parquet(source)
    stream_chunks(spark, source, out, state).awaitTermination()
    stream_chunks(spark, source, out, state).awaitTermination()  # nothing new
    got = sorted(r.id for r in spark.read.parquet(out).collect())
    assert got == sorted(r.id for r in chunk_documents(docs).collect())


def test_reports(spark, tmp_path):
    docs = documents(spark, TEXTS)
    report = diagnostics.run(docs)
    text = "\n".join(reports.head(reports.extraction(report)))
    assert "n_documents=4" in text and "figure=30" in text and "book=b0" in text
    reports.save_json(report, str(tmp_path / "r"))
    assert spark.read.json(str(tmp_path / "r" / "overall")).first().n_documents == 4
    text = "\n".join(reports.head(reports.chunks(chunk_report.run(chunk_documents(docs)))))
    assert "overlap_pairs=0" in text and "== samples ==" in text
    empty = diagnostics.run(docs.limit(0))
    assert empty["overall"].first().avg_chars_per_chunk == 0.0
    assert empty["mojibake"].first().chunks_with_mojibake_pct == 0.0


def test_command_line(spark, pdfs, tmp_path, monkeypatch, capsys):
    monkeypatch.setattr(pdf.read_pdf_pages, "__defaults__", (None, fake_parse, None))
    encoder = lambda *a, **k: lambda: HashingEncoder(384)
    monkeypatch.setattr(cli, "sentence_encoder", encoder)
    (pdfs / "pdfs" / "three.pdf").write_bytes(("Gradients point uphill always. " * 60).encode())
    at = lambda name: str(tmp_path / name)
    run = lambda *argv: cli.main(list(argv), spark)
    run("ingest", "--pdfs", str(pdfs / "pdfs"), "--metadata", str(pdfs / "books.json"), "--out", at("docs"))
    run("chunk", "--documents", at("docs"), "--out", at("chunks"), "--parquet", at("flat"))
    run("embed", "--chunks", at("chunks"), "--out", at("vec.parquet"), "--cache", at("cache"))
    run("index", "--embeddings", at("vec.parquet"), "--out", at("index"))
    run("query", "--query", "gradients uphill", "--index", at("index"), "--k", "2")
    out = capsys.readouterr().out
    assert "self check: True" in out and "book=three  page=1" in out
    run("diagnose-chunks", "--chunks", at("chunks"))
    run("check-extraction", "--documents", at("docs"), "--sample", "2", "--out", at("report"))
    assert "n_documents=2" in capsys.readouterr().out
    client = lambda *a: lambda: (lambda system, user: "YES, uphill.")
    monkeypatch.setattr(cli, "gemini_client", client)
    run("answer", "--query", "gradients?", "--index", at("index"), "--show-chunks")
    assert "YES, uphill." in capsys.readouterr().out
    (tmp_path / "golden.jsonl").write_text(
        '{"id": "q1", "book": "three", "query": "uphill", "difficulty": "easy"}\n')
    monkeypatch.setattr(cli, "judge_with_cache",
                        lambda p, c, path, **_: judge(p, c, path, min_interval=0.0))
    run("evaluate", "--golden", at("golden.jsonl"), "--index", at("index"),
        "--judge-cache", at("judge"), "--out", at("eval"))
    assert "recall_at_1=1.0000" in capsys.readouterr().out


from folioforge.operators.model_calls import judge_with_cache as judge  # noqa: E402
