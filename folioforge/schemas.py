"""Schemas of the records that stages exchange.  Reads never infer."""

from __future__ import annotations

from pyspark.sql import types as T

IMAGE = T.StructType(
    [
        T.StructField("path", T.StringType()),
        T.StructField("xref", T.IntegerType()),
        T.StructField("width", T.IntegerType()),
        T.StructField("height", T.IntegerType()),
        T.StructField("format", T.StringType()),
        T.StructField("page", T.IntegerType()),
    ]
)

BOOK = T.StructType(
    [
        T.StructField("file", T.StringType()),
        T.StructField("title", T.StringType()),
        T.StructField("author", T.StringType()),
        T.StructField("year", T.StringType()),
        T.StructField("domain", T.StringType()),
        T.StructField("level", T.StringType()),
    ]
)
BOOKS_FILE = T.StructType([T.StructField("books", T.ArrayType(BOOK))])

METADATA = T.MapType(T.StringType(), T.StringType())

DOCUMENT = T.StructType(
    [
        T.StructField("id", T.StringType()),
        T.StructField("content", T.StringType()),
        T.StructField("metadata", METADATA),
        T.StructField("page_number", T.LongType()),
        T.StructField("book_title", T.StringType()),
        T.StructField("chapter", T.StringType()),
        T.StructField("section", T.StringType()),
        T.StructField("images", T.ArrayType(IMAGE)),
        T.StructField("doc_seq", T.LongType()),
    ]
)

CHUNK = T.StructType(
    [
        T.StructField("id", T.StringType()),
        T.StructField("content", T.StringType()),
        T.StructField("metadata", METADATA),
        T.StructField("book_title", T.StringType()),
        T.StructField("page_number", T.LongType()),
        T.StructField("chunk_index", T.IntegerType()),
        T.StructField("total_chunks", T.IntegerType()),
        T.StructField("start_char", T.IntegerType()),
        T.StructField("end_char", T.IntegerType()),
        T.StructField("section", T.StringType()),
        T.StructField("headings", T.ArrayType(T.StringType())),
        T.StructField("doc_seq", T.LongType()),
    ]
)

VECTOR = T.ArrayType(T.FloatType())

EMBEDDING = T.StructType(
    [
        T.StructField("chunk_id", T.StringType()),
        T.StructField("book_title", T.StringType()),
        T.StructField("page_number", T.LongType()),
        T.StructField("chunk_index", T.IntegerType()),
        T.StructField("content", T.StringType()),
        T.StructField("embedding", VECTOR),
        T.StructField("embedding_dim", T.IntegerType()),
    ]
)

EMBEDDING_CACHE = T.StructType(
    [T.StructField("cache_key", T.StringType()), T.StructField("embedding", VECTOR)]
)

JUDGE_CACHE = T.StructType(
    [
        T.StructField("cache_key", T.StringType()),
        T.StructField("prompt", T.StringType()),
        T.StructField("response", T.StringType()),
    ]
)

GOLDEN = T.StructType(
    [
        T.StructField("id", T.StringType()),
        T.StructField("book", T.StringType()),
        T.StructField("query", T.StringType()),
        T.StructField("difficulty", T.StringType()),
        T.StructField("expected_answer_summary", T.StringType()),
        T.StructField("notes", T.StringType()),
    ]
)
