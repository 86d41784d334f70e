"""Record sources and sinks: JSON array, JSON lines, Parquet, caches."""

from __future__ import annotations

import warnings

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from folioforge import schemas
from folioforge.functions.charclass import is_blank
from folioforge.sources.splits import read_json_array, read_lines, write_json_array


# --- reading ----------------------------------------------------------------------


def read_books(spark: SparkSession, path: str) -> DataFrame | None:
    """Book metadata with its position in the file; None when the file is missing."""
    try:
        raw = spark.read.schema(schemas.BOOKS_FILE).json(path, multiLine=True)
    except AnalysisException as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return None
    return raw.select(F.posexplode("books").alias("ordinal", "book")).select(
        "ordinal", "book.*"
    )


def read_documents(spark: SparkSession, path: str, array: bool = False, parts: bool = False) -> DataFrame:
    """Documents from JSON lines, or with ``array`` from files that hold one JSON array each, or
    with ``parts`` as well one together.

    Either is read by several tasks, however large a file is.
    """
    if array:
        return read_json_array(spark, path, schemas.DOCUMENT, parts)
    return spark.read.schema(schemas.DOCUMENT).json(path)


def read_chunks(spark: SparkSession, path: str) -> DataFrame:
    """Chunks from JSON lines; blank lines are skipped."""
    return spark.read.schema(schemas.CHUNK).json(path)


def read_golden(spark: SparkSession, path: str) -> DataFrame:
    """Golden queries from JSON lines.

    A broken line or a missing required key is an error that names the line by its number in
    the file, blank lines counted, and shows it; summary and notes default to ``''``.
    """
    bad = "_bad"
    schema = StructType(list(schemas.GOLDEN.fields)).add(bad, "string")
    lines = read_lines(spark, path).filter(~is_blank(F.col("value")))
    options = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": bad}
    rows = lines.select("line", "value", F.from_json("value", schema, options).alias("r")).select("line", "value", "r.*")
    required = ["id", "book", "query", "difficulty"]
    missing = F.concat_ws(", ", *[F.when(F.col(c).isNull(), F.lit(c)) for c in required])

    def error(what: str, shown) -> Column:
        return F.raise_error(F.concat(F.lit(what), F.col("line").cast("string"), F.lit(": "), shown)).cast("string")

    checked = F.when(F.col(bad).isNotNull(), error("Invalid JSONL at line ", F.col("value"))).when(
        missing != "", error("Golden entry lacks keys at line ", missing)
    )
    return rows.select(
        F.coalesce(checked, F.col("id")).alias("id"),
        *required[1:],
        F.coalesce("expected_answer_summary", F.lit("")).alias("expected_answer_summary"),
        F.coalesce("notes", F.lit("")).alias("notes"),
    )


def read_embeddings(spark: SparkSession, path: str) -> DataFrame:
    df = spark.read.parquet(path)
    if "embedding" not in df.columns:
        raise ValueError(f"No 'embedding' column in {path}; found {df.columns}")
    return df


def read_or_empty(
    spark: SparkSession, path: str, schema: StructType, skip_broken: bool = False
) -> DataFrame:
    """A cache table, or no rows where none has been written yet.

    A broken file is an error, unless the caller repairs the table and skips it.
    """
    broken = str(skip_broken).lower()
    try:
        return spark.read.schema(schema).option("ignoreCorruptFiles", broken).parquet(path)
    except AnalysisException as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return spark.createDataFrame([], schema)


def repair_cache(spark: SparkSession, path: str, schema: StructType, repaired: str) -> int:
    """Copy what can be read of a cache to ``repaired``; the number of entries saved.

    Entries of broken files are lost and will be computed again, which a warning says.
    """
    read_or_empty(spark, path, schema, skip_broken=True).write.parquet(repaired)
    saved = spark.read.schema(schema).parquet(repaired).count()
    warnings.warn(f"{path}: {saved} cache entries saved, those of broken files are lost", stacklevel=2)
    return saved


def one_per_key(table: DataFrame, key: str, value: str) -> DataFrame:
    """One row per key, the smallest value: two writers may both have stored a key."""
    return table.groupBy(key).agg(F.min(value).alias(value))


def first_documents(documents: DataFrame, n: int) -> DataFrame:
    """The first n documents in corpus order."""
    return documents.orderBy("doc_seq").limit(n)


# --- writing ----------------------------------------------------------------------


def write_documents(documents: DataFrame, path: str, array: bool = False, one_file: bool = False) -> None:
    """JSON lines, or with ``array`` one JSON array in corpus order, in parts or in one file."""
    if array:
        write_json_array(documents, path, ["doc_seq"], one_file)
    else:
        documents.write.json(path)


def write_chunks(chunks: DataFrame, path: str) -> None:
    """JSON lines."""
    chunks.write.json(path)


def flatten_chunks(chunks: DataFrame, metadata_keys: list[str]) -> DataFrame:
    """Chunk rows for Parquet: joined headings, content length, one column per key."""
    return chunks.select(
        *[c for c in chunks.columns if c not in ("metadata", "headings")],
        F.array_join("headings", "; ").alias("headings"),
        F.length("content").alias("content_length"),
        *[F.col("metadata").getItem(k).alias(f"metadata_{k}") for k in metadata_keys],
    )


def metadata_keys(chunks: DataFrame) -> list[str]:
    """All metadata keys in use; a handful of names, whatever the number of chunks."""
    keys = chunks.select(F.explode(F.map_keys("metadata")).alias("k")).distinct()
    return sorted(r.k for r in keys.collect())


def write_chunks_parquet(
    chunks: DataFrame, path: str, keys: list[str] | None = None
) -> None:
    flatten_chunks(chunks, metadata_keys(chunks) if keys is None else keys).write.parquet(path)


def write_embeddings(rows: DataFrame, path: str) -> None:
    """Parquet or JSON lines, by the suffix of the path."""
    if path.endswith(".parquet"):
        rows.write.parquet(path)
    else:
        rows.write.json(path)


def append_rows(rows: DataFrame, path: str) -> None:
    rows.write.mode("append").parquet(path)


