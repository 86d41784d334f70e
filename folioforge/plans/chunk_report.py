"""Chunk-structure report and corpus statistics."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioforge.functions import fixed_values as fv
from folioforge.functions.charclass import word_count
from folioforge.functions.structure import ends_clean, preview, starts_clean
from folioforge.operators.adjacency import adjacent_pairs
from folioforge.operators.ranks import size_profile


def corpus_totals(docs: DataFrame) -> DataFrame:
    """Pages, words, images and whole words per page (null for no pages)."""
    pages, words = F.count("*"), F.coalesce(F.sum("words"), F.lit(0))
    return _sized(docs).agg(
        pages.alias("total_pages"),
        words.alias("total_words"),
        F.coalesce(F.sum("n_images"), F.lit(0)).alias("total_images"),
        F.when(pages > 0, F.floor(words / pages)).alias("avg_words_per_page"),
    )


def per_book_totals(docs: DataFrame) -> DataFrame:
    return _sized(docs).groupBy("book_title").agg(
        F.count("*").alias("pages"),
        F.sum("words").alias("words"),
        F.sum("n_images").alias("images"),
    )


def _sized(docs: DataFrame) -> DataFrame:
    images = F.size("images") if "images" in docs.columns else F.lit(0)
    return docs.select(
        "book_title",
        word_count(F.col("content")).alias("words"),
        F.greatest(F.coalesce(images, F.lit(0)), F.lit(0)).alias("n_images"),
    )


def chunk_totals(chunks: DataFrame) -> DataFrame:
    return chunks.agg(
        F.count("*").alias("chunks"),
        F.coalesce(F.sum(F.length("content")), F.lit(0)).alias("total_chars"),
        F.avg(F.length("content")).alias("mean_chars"),
    )


def chunks_per_book(chunks: DataFrame) -> DataFrame:
    return (
        chunks.groupBy("book_title")
        .agg(F.count("*").alias("chunks"))
        .orderBy(F.desc("chunks"), "book_title")
    )


def size_distribution(chunks: DataFrame) -> DataFrame:
    return size_profile(
        chunks,
        {"chars": F.length("content"), "words": word_count(F.col("content"))},
        {"p10": 0.10, "p50": 0.50, "p90": 0.90, "p99": 0.99},
    )


def chunks_per_page(chunks: DataFrame) -> DataFrame:
    """How many pages have how many chunks."""
    return (
        chunks.groupBy("book_title", "page_number")
        .agg(F.count("*").alias("chunks_on_page"))
        .groupBy("chunks_on_page")
        .agg(F.count("*").alias("pages"))
    )


def boundary_quality(chunks: DataFrame) -> DataFrame:
    n = F.count("*")
    starts = F.count_if(~starts_clean(F.col("content")))
    ends = F.count_if(~ends_clean(F.col("content")))
    return chunks.agg(
        n.alias("chunks"),
        starts.alias("mid_start"),
        (starts / n * 100.0).alias("mid_start_pct"),
        ends.alias("mid_end"),
        (ends / n * 100.0).alias("mid_end_pct"),
    )


def residue(chunks: DataFrame) -> DataFrame:
    c = F.col("content")
    return chunks.agg(
        F.count_if(c.rlike(fv.HEADING_START)).alias("heading_hits"),
        F.count_if(c.rlike(fv.CHAPTER_START)).alias("chapter_hits"),
        F.count_if(F.substring(c, 1, 150).rlike(fv.PAGE_NUMBER_RESIDUE)).alias(
            "page_number_hits"
        ),
    )


def duplicate_groups(chunks: DataFrame) -> DataFrame:
    """Contents that occur more than once, by hash, with their number of copies."""
    return (
        chunks.groupBy(F.md5("content").alias("content_md5"))
        .agg(F.count("*").alias("copies"))
        .filter(F.col("copies") > 1)
    )


def sample_chunks(chunks: DataFrame) -> DataFrame:
    return (
        chunks.orderBy("doc_seq", "chunk_index")
        .limit(fv.SAMPLE_LIMIT)
        .select(
            "book_title",
            "page_number",
            (F.col("chunk_index") + 1).alias("chunk_no"),
            "total_chunks",
            F.length("content").alias("chars"),
            preview(F.col("content"), 150).alias("preview"),
        )
    )


def run(chunks: DataFrame) -> dict[str, DataFrame]:
    return {
        "totals": chunk_totals(chunks),
        "books": chunks_per_book(chunks),
        "sizes": size_distribution(chunks),
        "pages": chunks_per_page(chunks),
        "boundaries": boundary_quality(chunks),
        "residue": residue(chunks),
        "adjacent": adjacent_pairs(chunks),
        "duplicates": duplicate_groups(chunks).agg(F.count("*").alias("duplicate_groups")),
        "samples": sample_chunks(chunks),
    }
