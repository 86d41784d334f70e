"""Command line: each stage reads the tables of the one before it.

``spark-submit`` a script that calls ``main()``, or run ``python -m folioforge <stage>``.
"""

from __future__ import annotations

import argparse
import time
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from folioforge.functions import fixed_values as fv
from folioforge.operators import evaluation, generation
from folioforge.operators.books import documents_from_pages
from folioforge.operators.chunking import ChunkSettings, chunk_documents
from folioforge.operators.embedding import (
    EmbeddingCache,
    embed_chunks,
    embedding_model,
    embedding_rows,
    sentence_encoder,
)
from folioforge.operators.index import Retriever, VectorIndex
from folioforge.operators.model_calls import gemini_client, judge_with_cache
from folioforge.operators.ranks import number_rows
from folioforge.plans import chunk_report, diagnostics, reports
from folioforge.session import cut_lineage
from folioforge.sources import pdf, tables


def _show(lines) -> None:
    for line in lines:
        print(line)


def _report(sections: list[reports.Section], path: str | None) -> None:
    """The first lines for the console, all of them in files."""
    _show(reports.head(sections))
    if path:
        reports.write(sections, path)


def ingest(spark: SparkSession, a: argparse.Namespace) -> None:
    books = tables.read_books(spark, a.metadata)
    pages = pdf.read_pdf_pages(spark, a.pdfs, a.images, titles=books if a.images else None)
    tables.write_documents(documents_from_pages(pages, books), a.out)
    back = tables.read_documents(spark, a.out)
    chunk_report.corpus_totals(back).show(truncate=False)
    chunk_report.per_book_totals(back).show(truncate=False)


def chunk(spark: SparkSession, a: argparse.Namespace) -> None:
    cfg = ChunkSettings(a.chunk_size, a.overlap, a.min_chunk_size)
    tables.write_chunks(chunk_documents(tables.read_documents(spark, a.documents), cfg), a.out)
    back = tables.read_chunks(spark, a.out)
    if a.parquet:
        tables.write_chunks_parquet(back, a.parquet)
    chunk_report.chunk_totals(back).show(truncate=False)


def embed(spark: SparkSession, a: argparse.Namespace) -> None:
    start = time.monotonic()
    chunks = tables.read_chunks(spark, a.chunks)
    cache = EmbeddingCache(spark, a.cache, model_key=a.model) if a.cache else None
    batch = a.batch_size or embedding_model(a.model)["batch_size"]
    rows = embed_chunks(chunks, sentence_encoder(a.model), cache, batch)
    tables.write_embeddings(embedding_rows(rows), a.out)
    n = spark.read.parquet(a.out).count() if a.out.endswith(".parquet") else chunks.count()
    seconds = time.monotonic() - start
    print(f"{n:,} chunks in {seconds:.1f}s ({n / seconds:.1f} chunks/s)")


def build(spark: SparkSession, a: argparse.Namespace) -> None:
    start = time.monotonic()
    rows = tables.read_embeddings(spark, a.embeddings).drop("embedding_dim")
    dimension = embedding_model(a.model)["dimension"]
    index = VectorIndex(dimension).build(
        rows, ["book_title", "page_number", "chunk_index", "chunk_id"], model_key=a.model
    )
    index.save(a.out)
    saved = VectorIndex.load(spark, a.out)
    saved.stats().show(truncate=False)
    print(f"built in {time.monotonic() - start:.1f}s; self check: {saved.self_check()}")


def _retriever(spark: SparkSession, a: argparse.Namespace) -> Retriever:
    return Retriever(
        VectorIndex.load(spark, a.index), sentence_encoder(a.model, normalize=True), a.model
    )


def search(spark: SparkSession, a: argparse.Namespace) -> None:
    _show(reports.head(reports.hits(_retriever(spark, a).search_text(a.query, a.k), a.preview_chars)))


def answer(spark: SparkSession, a: argparse.Namespace) -> None:
    queries = spark.createDataFrame([(0, a.query)], "query_id long, query string")
    hits = _retriever(spark, a).search(queries, a.k)
    client = gemini_client(a.generator, fv.GENERATE_TEMPERATURE)
    # Stored: the sections read it one after the other, and no answer is asked for twice.
    found = cut_lineage(generation.answer(queries, hits, client), "answers")
    _show(reports.head(reports.answers(found, a.show_chunks)))


def _numbered_golden(spark: SparkSession, path: str) -> DataFrame:
    return number_rows(tables.read_golden(spark, path), ["id"], "query_id")


def evaluate(spark: SparkSession, a: argparse.Namespace) -> None:
    golden = _numbered_golden(spark, a.golden)
    hits = _retriever(spark, a).search(golden.select("query_id", "query"), a.k)
    prompts = evaluation.judge_prompts(golden.drop("book"), hits)
    judge = gemini_client(a.judge, fv.JUDGE_TEMPERATURE)
    judged = evaluation.decide(judge_with_cache(prompts, judge, a.judge_cache, model_key=a.judge))
    results = evaluation.query_results(golden, judged)
    results.write.parquet(f"{a.out}/results")
    results = spark.read.parquet(f"{a.out}/results")
    if results.isEmpty():
        raise ValueError("No query results to report")
    _report(reports.evaluated(results, a.k), f"{a.out}/report")
    config = {
        "k": a.k, "model_key": a.model, "judge_model_key": a.judge,
        "index": a.index, "golden_file": a.golden,
    }
    evaluation.write_summary(results, a.k, config, f"{a.out}/summary")


def diagnose_chunks(spark: SparkSession, a: argparse.Namespace) -> None:
    _report(reports.chunks(chunk_report.run(tables.read_chunks(spark, a.chunks))), a.out)


def check_extraction(spark: SparkSession, a: argparse.Namespace) -> None:
    docs = tables.read_documents(spark, a.documents, a.array)
    if a.sample:
        docs = tables.first_documents(docs, a.sample)
    report = diagnostics.run(docs)
    _report(reports.extraction(report), f"{a.out}/text" if a.out else None)
    if a.out:
        reports.save_json(report, a.out)


def _parser() -> argparse.ArgumentParser:
    parser = argparse.ArgumentParser(prog="folioforge", description=__doc__)
    stages = parser.add_subparsers(dest="stage", required=True)

    def stage(name: str, run: Callable, *required: str, **options) -> None:
        p = stages.add_parser(name)
        for r in required:
            p.add_argument(f"--{r.replace('_', '-')}", required=True)
        for o, default in options.items():
            flag = f"--{o.replace('_', '-')}"
            if default is False:
                p.add_argument(flag, action="store_true")
            else:
                kind = str if default is None else type(default)
                p.add_argument(flag, default=default, type=kind)
        p.set_defaults(run=run)

    stage("ingest", ingest, "pdfs", "metadata", "out", images=None)
    stage(
        "chunk", chunk, "documents", "out", parquet=None, chunk_size=fv.CHUNK_SIZE,
        overlap=fv.CHUNK_OVERLAP, min_chunk_size=fv.MIN_CHUNK_SIZE,
    )
    stage("embed", embed, "chunks", "out", cache=None, model="bge-small", batch_size=32)
    stage("index", build, "embeddings", "out", model="bge-small")
    stage("query", search, "query", "index", model="bge-small", k=5, preview_chars=300)
    stage(
        "answer", answer, "query", "index", model="bge-small", generator="gemini-flash", k=5,
        show_chunks=False,
    )
    stage(
        "evaluate", evaluate, "golden", "index", "judge_cache", "out", model="bge-small",
        judge="gemini-flash-lite", k=5,
    )
    stage("diagnose-chunks", diagnose_chunks, "chunks", out=None)
    stage("check-extraction", check_extraction, "documents", array=False, sample=0, out=None)
    return parser


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> None:
    args = _parser().parse_args(argv)
    args.run(spark or SparkSession.builder.appName("folioforge").getOrCreate(), args)
