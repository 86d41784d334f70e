"""Raw pages to documents: metadata lookup, cleaning, identifiers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioforge.functions import fixed_values as fv
from folioforge.functions.charclass import is_blank
from folioforge.functions.cleaning import clean_column
from folioforge.functions.structure import document_id
from folioforge.operators.ranks import sum_before
from folioforge.session import cut_lineage


def with_book_metadata(pages: DataFrame, books: DataFrame | None) -> DataFrame:
    """Left-join book metadata on ``file``; the first entry of a file wins.

    ``books`` has the columns of ``schemas.BOOK`` plus ``ordinal``.  No broadcast is
    forced: Spark broadcasts the metadata while it is below its threshold and otherwise
    joins by shuffle, splitting a hot book's pages.
    """
    fields = ["title", "author", "year", "domain", "level"]
    default_title = F.replace(F.col("file"), F.lit(".pdf"), F.lit(""))
    if books is None:
        joined = pages.withColumn("book", F.lit(None).cast("struct<title:string>"))
        values: list[Column] = [default_title] + [F.lit(fv.DEFAULT_BOOK[f]) for f in fields[1:]]
    else:
        first = books.groupBy("file").agg(
            F.min_by(F.struct(*fields), F.col("ordinal")).alias("book")
        )
        joined = pages.join(first, "file", "left")
        values = []
        for f in fields:
            # A listed book without a title is called by its file's stem.
            missing = default_title if f == "title" else F.lit(None).cast("string")
            default = default_title if f == "title" else F.lit(fv.DEFAULT_BOOK[f])
            listed = F.coalesce(F.col(f"book.{f}"), missing)
            values.append(F.when(F.col("book").isNull(), default).otherwise(listed))
    return joined.select("*", *[v.alias(f) for v, f in zip(values, fields)]).drop("book")


def documents_from_pages(pages: DataFrame, books: DataFrame | None = None) -> DataFrame:
    """Pages ``(file, page0, total_pages, text, images)`` to ``schemas.DOCUMENT``.

    Text is cleaned, pages left blank are dropped, and each page carries its book.
    ``doc_seq`` orders the corpus by file and page and is unique: a file's pages follow the
    ones of the files before it.
    """
    # Cleaning removes no visible character, so a page is blank after it exactly when it
    # is blank before; filtering first keeps the predicate at the scan.
    cleaned = clean_column(pages.filter(~is_blank(F.col("text"))), "text")
    known = with_book_metadata(cleaned, books)
    n_images = F.size("images")
    metadata = F.map_filter(
        F.create_map(
            *[
                part
                for name, value in {
                    "title": F.col("title"),
                    "author": F.col("author"),
                    "year": F.col("year"),
                    "domain": F.col("domain"),
                    "level": F.col("level"),
                    "page": (F.col("page0") + 1).cast("string"),
                    "total_pages": F.col("total_pages").cast("string"),
                    "book_file": F.col("file"),
                    "has_images": (n_images > 0).cast("string"),
                    "image_count": n_images.cast("string"),
                }.items()
                for part in (F.lit(name), value)
            ]
        ),
        lambda _, v: v.isNotNull(),
    )
    documents = known.select(
        "file",
        document_id(F.col("file"), F.col("page0")).alias("id"),
        F.col("text").alias("content"),
        metadata.alias("metadata"),
        (F.col("page0") + 1).cast("long").alias("page_number"),
        F.col("title").alias("book_title"),
        F.lit("").alias("chapter"),
        F.lit("").alias("section"),
        "images",
        F.col("page0").cast("long").alias("_page"),
    )
    # Stored: numbering files takes a pass over all pages, and pages must not be parsed twice.
    documents = cut_lineage(documents, "documents")
    # One row per file, however many pages.
    lengths = documents.groupBy("file").agg((F.max("_page") + 1).alias("_n"))
    before = sum_before(lengths, ["file"], "_n", "_before").drop("_n")
    numbered = documents.join(before, "file")
    return numbered.withColumn("doc_seq", F.col("_before") + F.col("_page")).drop(
        "file", "_page", "_before"
    )
