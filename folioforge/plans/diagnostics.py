"""Extraction-quality report: ten sections over documents or chunks.

Every section selects from one lazily computed feature row per document: a section alone
pays only for the features it uses, the full report computes them once for all.
"""

from __future__ import annotations


from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folioforge.functions import fixed_values as fv
from folioforge.functions.charclass import let, word_count
from folioforge.functions.structure import preview
from folioforge.operators.ranks import size_profile
from folioforge.session import cut_lineage

_MOJIBAKE_LEADS = "[ŌŽ╬âÃÂ√]"


def _mojibake(content: Column) -> Column:
    """Per pattern: number of matches and of matched characters; empty for clean text."""
    kind = "array<struct<pattern:string,n:int,chars:int>>"

    def count(published: str, java: str) -> Column:
        matches = F.regexp_extract_all(content, F.lit(java), F.lit(0))
        return let(
            matches,
            lambda m: F.struct(
                F.lit(published).alias("pattern"),
                F.size(m).alias("n"),
                F.length(F.array_join(m, "")).alias("chars"),
            ),
        )

    found = F.array(*[count(*p) for p in fv.MOJIBAKE_PATTERNS]).cast(kind)
    hits = F.filter(found, lambda f: f["n"] > 0)
    # A cheap test for the lead characters spares clean texts the seven patterns.
    return F.when(content.rlike(_MOJIBAKE_LEADS), hits).otherwise(F.array().cast(kind))


def features(docs: DataFrame) -> DataFrame:
    """Documents ``(doc_seq, book_title, page_number, content[, images])`` with features."""
    c = F.col("content")
    first_line = F.substring_index(c, "\n", 1)
    n_images = F.size("images") if "images" in docs.columns else F.lit(0)
    return docs.select(
        "doc_seq",
        F.coalesce("book_title", F.lit("?")).alias("book"),
        F.coalesce(F.col("page_number").cast("long"), F.lit(-1)).alias("page"),
        F.substring(first_line, 1, 80).alias("first_line"),
        F.substring(c, 1, 80).alias("lead"),
        preview(c, 120).alias("preview"),
        F.length(c).alias("chars"),
        word_count(c).alias("words"),
        F.coalesce(n_images, F.lit(0)).alias("n_images"),
        _mojibake(c).alias("mojibake"),
        c.rlike(fv.HEADING_START).alias("is_heading"),
        c.rlike(fv.CHAPTER_START).alias("is_chapter"),
        first_line.rlike(fv.ALLCAPS_HEADING).alias("is_allcaps"),
        F.substring(c, 1, 120).rlike(fv.LEADING_PAGE_NUMBER).alias("is_page_leak"),
        *[
            F.regexp_count(c, F.lit(p)).alias(f"caption_{name}")
            for name, p in fv.CAPTION_PATTERNS
        ],
        F.regexp_count(c, F.lit(fv.UNICODE_MATH)).alias("math"),
        c.rlike(fv.REPEATED_LETTER).alias("has_repeats"),
        c.rlike(fv.MISSING_SPACE).alias("has_missing_space"),
        c.rlike(fv.TRAILING_WHITESPACE).alias("has_trailing_ws"),
    )


def _share(part: Column, whole: Column, scale: float = 1.0) -> Column:
    """``part / whole * scale``, and 0 for an empty corpus."""
    return F.when(whole > 0, part / whole * scale).otherwise(0.0)


def overall(f: DataFrame) -> DataFrame:
    n = F.count("*")
    chars = F.coalesce(F.sum("chars"), F.lit(0))
    words = F.coalesce(F.sum("words"), F.lit(0))
    return f.agg(
        n.alias("n_documents"),
        chars.alias("total_chars"),
        words.alias("total_words"),
        _share(chars, n).alias("avg_chars_per_chunk"),
        _share(words, n).alias("avg_words_per_chunk"),
    )


def mojibake_totals(f: DataFrame) -> DataFrame:
    n = F.count("*")
    hit = F.count_if(F.size("mojibake") > 0)
    chars = F.aggregate("mojibake", F.lit(0), lambda acc, m: acc + m["chars"])
    return f.agg(
        hit.alias("chunks_with_mojibake"),
        _share(hit, n, 100.0).alias("chunks_with_mojibake_pct"),
        F.coalesce(F.sum(chars), F.lit(0)).alias("total_mojibake_chars"),
    )


def first_per_group(df: DataFrame, group: str, order: str, n: int) -> DataFrame:
    """The first n rows of each group.

    Spark applies the limit per group before the shuffle, so a hot group sends n rows per
    task at most.
    """
    w = Window.partitionBy(group).orderBy(order)
    return df.withColumn("_r", F.row_number().over(w)).filter(F.col("_r") <= n)


def mojibake_patterns(f: DataFrame) -> DataFrame:
    """Per pattern: matches, and pages of the first documents that have it."""
    # Outer explode: the inner one has the optimizer infer a filter that repeats the
    # pattern matching below the projection.
    found = f.select("doc_seq", "page", F.inline_outer("mojibake"))
    # Stored: counted and sampled below, but matched once.
    hits = cut_lineage(found.filter(F.col("pattern").isNotNull()), "mojibake")
    counts = hits.groupBy("pattern").agg(F.sum("n").alias("matches"))
    pages = first_per_group(hits, "pattern", "doc_seq", fv.SAMPLE_LIMIT)
    examples = pages.groupBy("pattern").agg(
        F.transform(
            F.array_sort(F.collect_list(F.struct("_r", "page"))), lambda x: x["page"]
        ).alias("example_pages")
    )
    return counts.join(examples, "pattern")


def size_sections(f: DataFrame) -> DataFrame:
    """Distribution of characters and words, one row each."""
    return size_profile(
        f,
        {"chars": F.col("chars"), "words": F.col("words")},
        {"p10": 0.10, "p50": 0.50, "p90": 0.90, "p99": 0.99},
    )


def page_counts(f: DataFrame) -> DataFrame:
    per_page = f.groupBy("book", "page").agg(F.count("*").alias("c"))
    return per_page.agg(
        F.count("*").alias("unique_pages"),
        F.count_if(F.col("c") == 1).alias("pages_with_one_chunk"),
        F.count_if(F.col("c") > 1).alias("pages_with_multiple_chunks"),
        F.coalesce(F.max("c"), F.lit(0)).alias("max_chunks_per_page"),
    )


_HEADING_KINDS = {
    "heading": "is_heading",
    "chapter": "is_chapter",
    "allcaps": "is_allcaps",
    "page_number_leak": "is_page_leak",
}


def heading_counts(f: DataFrame) -> DataFrame:
    return f.agg(
        F.count_if("is_heading").alias("chunks_starting_with_heading"),
        F.count_if("is_chapter").alias("chunks_starting_with_chapter"),
        F.count_if("is_allcaps").alias("chunks_starting_with_allcaps"),
        F.count_if("is_page_leak").alias("chunks_with_leading_page_number"),
        F.count("*").alias("total_chunks"),
    )


def heading_samples(f: DataFrame) -> DataFrame:
    """The first few examples of each kind: ``(kind, position, sample)``."""
    kinds = F.array(
        *[
            F.struct(
                F.lit(kind).alias("kind"),
                F.col(flag).alias("found"),
                F.col("lead" if kind == "page_number_leak" else "first_line").alias("sample"),
            )
            for kind, flag in _HEADING_KINDS.items()
        ]
    )
    found = f.select("doc_seq", F.inline_outer(F.filter(kinds, lambda k: k["found"]))).filter(
        F.col("kind").isNotNull()
    )
    return first_per_group(found, "kind", "doc_seq", fv.SAMPLE_LIMIT).select(
        "kind", F.col("_r").alias("position"), "sample"
    )


def captions(f: DataFrame) -> DataFrame:
    return f.agg(
        *[
            F.coalesce(F.sum(f"caption_{name}"), F.lit(0)).alias(name)
            for name, _ in fv.CAPTION_PATTERNS
        ]
    )


def equations(f: DataFrame) -> DataFrame:
    n = F.count("*")
    with_math = F.count_if(F.col("math") > 0)
    dense = F.count_if(
        F.when(F.col("chars") > 0, F.col("math") / F.col("chars")) > fv.HIGH_MATH_DENSITY
    )
    return f.agg(
        with_math.alias("chunks_with_math_symbols"),
        _share(with_math, n, 100.0).alias("chunks_with_math_symbols_pct"),
        dense.alias("chunks_with_high_math_density"),
        F.coalesce(F.sum("math"), F.lit(0)).alias("total_math_symbols"),
    )


def text_hygiene(f: DataFrame) -> DataFrame:
    return f.agg(
        F.count_if("has_repeats").alias("chunks_with_repeated_chars"),
        F.count_if("has_missing_space").alias("chunks_with_missing_spaces"),
        F.count_if("has_trailing_ws").alias("chunks_with_trailing_whitespace"),
        F.count("*").alias("chunks_total"),
    )


def empty_pages(f: DataFrame) -> DataFrame:
    return f.filter(F.col("chars") < fv.EMPTY_PAGE_CHARS).select(
        "doc_seq", "book", "page", "chars", "n_images"
    )


def per_book(f: DataFrame) -> DataFrame:
    n = F.count("*")
    hit = F.count_if(F.size("mojibake") > 0)
    return f.groupBy("book").agg(
        n.alias("chunks"),
        F.avg("chars").alias("chars_mean"),
        F.max("chars").alias("chars_max"),
        hit.alias("chunks_with_mojibake"),
        (hit / n * 100.0).alias("chunks_with_mojibake_pct"),
    )


def worst_chunks(f: DataFrame) -> DataFrame:
    """The documents with most mojibake, in order of badness."""
    count = F.aggregate("mojibake", F.lit(0), lambda acc, m: acc + m["n"])
    # The limit comes before the filter, which then cannot be pushed below the matching.
    return (
        f.withColumn("mojibake_count", count)
        .orderBy(F.desc("mojibake_count"), "doc_seq")
        .limit(fv.WORST_LIMIT)
        .filter(F.col("mojibake_count") > 0)
        .select("doc_seq", "book", "page", "mojibake_count", "chars", "preview")
    )


def run(docs: DataFrame) -> dict[str, DataFrame]:
    """All sections of the report.

    The texts are read once: features, a small row per document, are written as a table
    and the sections work on that.
    """
    f = cut_lineage(features(docs), "features")
    return {
        "overall": overall(f),
        "mojibake": mojibake_totals(f),
        "mojibake_patterns": mojibake_patterns(f),
        "chunk_size": size_sections(f),
        "pages": page_counts(f),
        "headings": heading_counts(f),
        "heading_samples": heading_samples(f),
        "captions": captions(f),
        "equations": equations(f),
        "text_hygiene": text_hygiene(f),
        "empty_pages": empty_pages(f),
        "per_book": per_book(f),
        "worst_chunks": worst_chunks(f),
    }
