"""The vector index: a table of unit vectors with their metadata, and text retrieval on it."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioforge.functions.charclass import is_blank
from folioforge.functions.vectors import l2_normalize
from folioforge.operators.embedding import Encoder, embedding_model, encode_column
from folioforge.operators.knn import BROADCAST_BYTES, top_k
from folioforge.operators.ranks import stored_in_order, with_numbers
from folioforge.session import cut_lineage

INDEX_TYPE = "exact inner product"
# A hit in memory: query, rank, row and score, and what a row has besides.
HIT_BYTES = 64


class Files:
    """Where rows lie: files with ranges of rows that do not overlap; a file may have several."""

    def __init__(self, ranges: DataFrame, read: Callable[[list[str]], DataFrame]) -> None:
        """From ``(file, first_row, last_row)``, a row for each range, and what reads files."""
        found = ranges.orderBy("first_row").collect()
        self.files = [r.file for r in found]
        self.firsts = np.array([r.first_row for r in found], dtype=np.int64)
        self.read = read

    def holding(self, rows: DataFrame) -> list[str]:
        """The files that any of ``(row)`` lies in; file numbers are what reaches the driver."""
        firsts = self.firsts

        def numbers(batches):
            for batch in batches:
                at = np.searchsorted(firsts, batch.column("row").to_numpy(zero_copy_only=False), "right") - 1
                yield pa.RecordBatch.from_arrays([pa.array(np.unique(at).astype(np.int32))], names=["file"])

        asked = rows.select("row").mapInArrow(numbers, "file int").distinct().collect()
        return sorted({self.files[r.file] for r in asked})


class VectorIndex:
    """Exact inner-product index over a DataFrame ``(row, vec, <metadata>)``.

    Rows lie in files by range.  A search reads ``vec`` of all of them, and the metadata of the
    files that hits lie in.  Saved beside the rows is a manifest: a row for each range of each
    file, and the dimension and model of the index.
    """

    def __init__(self, dimension: int) -> None:
        self.dimension = dimension
        self.table: DataFrame | None = None
        # The table with ``_part``, the partition in which a row was numbered.
        self.stored: DataFrame | None = None
        self.files: Files | None = None
        self.manifest: DataFrame | None = None

    def build(
        self,
        rows: DataFrame,
        order: list[str],
        vector: str = "embedding",
        normalize: bool = True,
        model_key: str | None = None,
    ) -> VectorIndex:
        """Number the rows in ``order`` and scale vectors to unit length.

        Rows that come in order stay where they are; only their keys are looked at.
        Dimensions are checked in the same pass that normalises: a vector of another
        length fails the job with its size.
        """
        vec = F.col(vector)
        size = F.coalesce(F.size(vec), F.lit(-1))
        problem = F.concat(
            F.lit("Embedding dim "), size.cast("string"),
            F.lit(f" != declared dimension {self.dimension}"),
        )
        values = l2_normalize(vec) if normalize else vec
        # NaN is not below infinity either.
        finite = F.forall(vec, lambda x: F.abs(x) < F.lit(float("inf")))
        named = F.concat_ws(", ", *[F.coalesce(F.col(c).cast("string"), F.lit("null")) for c in order])
        endless = F.concat(F.lit("Vector of row "), named, F.lit(" is not finite"))
        checked = (
            F.when(size != self.dimension, F.raise_error(problem).cast("array<float>"))
            .when(~finite, F.raise_error(endless).cast("array<float>"))
            .otherwise(values.cast("array<float>"))
        )
        if model_key is not None:
            rows = rows.withColumn("model_key", F.lit(model_key))
        kept = rows.withColumn("vec", checked).drop(*([vector] if vector != "vec" else []))
        stored, before = stored_in_order(kept, order)
        self.stored = with_numbers(stored, before, keep_part=True)
        self.table = self.stored.drop("_part")
        ranges = with_numbers(stored.select("_id", F.col("_metadata.file_path").alias("file")), before)
        spark, schema = rows.sparkSession, stored.schema
        self.files = Files(
            _ranges(ranges), lambda files: with_numbers(spark.read.schema(schema).parquet(*files), before)
        )
        return self

    def save(self, path: str) -> None:
        if self.table is None:
            raise RuntimeError("Cannot save: index has not been built.")
        # Where it lies, a table need not be moved to be written: a task writes several
        # partitions to one file, each of which is a range of rows.
        self.stored.write.parquet(f"{path}/rows")
        rows = self.stored.sparkSession.read.parquet(f"{path}/rows")
        model = F.first("model_key") if "model_key" in rows.columns else F.lit(None).cast("string")
        named = rows.withColumn("file", F.element_at(F.split("_metadata.file_path", "/"), -1))
        known = named.groupBy("file", "_part").agg(
            F.min("row").alias("first_row"), F.max("row").alias("last_row"), F.count("*").alias("n"),
            model.alias("model_key"),
        ).drop("_part")
        known.withColumn("dimension", F.lit(self.dimension)).coalesce(1).write.parquet(f"{path}/manifest")

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> VectorIndex:
        """By the manifest, without a look at the rows."""
        try:
            manifest = spark.read.parquet(f"{path}/manifest")
        except AnalysisException as e:
            if "PATH_NOT_FOUND" not in str(e):
                raise
            raise FileNotFoundError(f"Index not found: {path}") from e
        first = manifest.select("dimension").first()
        index = cls(first.dimension if first else 0)
        index.stored, index.manifest = spark.read.parquet(f"{path}/rows"), manifest
        index.table, schema = index.stored.drop("_part"), index.stored.schema
        paths = manifest.withColumn("file", F.concat(F.lit(f"{path}/rows/"), "file"))
        index.files = Files(paths, lambda files: spark.read.schema(schema).parquet(*files).drop("_part"))
        return index

    def model_key(self) -> str | None:
        """The model that the index was built with, from the manifest if there is one."""
        source = self.manifest if self.manifest is not None else self.table
        if source is None or "model_key" not in source.columns:
            return None
        first = source.select("model_key").first()
        return first.model_key if first else None

    def rows_of(self, found: DataFrame) -> DataFrame:
        """The table, or those of its files that the rows of ``found`` lie in."""
        if self.files is None or not self.files.files:
            return self.table
        asked = self.files.holding(found)
        return self.files.read(asked) if asked else self.table.limit(0)

    def search(
        self, queries: DataFrame, k: int = 5, normalize: bool = True
    ) -> DataFrame:
        """Best k rows for each query ``(query_id, vec)`` with their metadata."""
        if self.table is None:
            raise RuntimeError("Cannot search: index has not been built or loaded.")
        hits = top_k(
            self.table,
            queries,
            k,
            unit_queries=normalize,
            unit_index=False,
            dimension=self.dimension,
        )
        # Stored, and with that known: k rows a query, broadcast if they are as few as to fit,
        # so that the texts stay where they are.
        found = cut_lineage(hits, "hits")
        few = found.count() * HIT_BYTES <= BROADCAST_BYTES
        return self.rows_of(found).drop("vec").join(F.broadcast(found) if few else found, "row")

    def stats(self) -> DataFrame:
        """One row: built, ntotal, dimension, metadata_rows, index_type."""
        if self.table is None:
            return SparkSession.active().range(1).select(F.lit(False).alias("built"))
        return index_stats(self.table if self.manifest is None else self.manifest)

    def self_check(self) -> bool:
        """True when row 0 finds itself first."""
        query = self.table.filter(F.col("row") == 0).select(F.lit(0).alias("query_id"), "vec")
        best = self.search(query, k=1).first()
        return best is not None and best.row == 0


def _ranges(rows: DataFrame) -> DataFrame:
    return rows.groupBy("file").agg(F.min("row").alias("first_row"), F.max("row").alias("last_row"))


def index_stats(table: DataFrame) -> DataFrame:
    """Of an index table, or of a manifest, which has the numbers of each file."""
    saved = "first_row" in table.columns
    n = F.coalesce(F.sum("n"), F.lit(0)).cast("long") if saved else F.count("*")
    dimension = F.col("dimension") if saved else F.size("vec")
    return table.agg(
        F.lit(True).alias("built"),
        n.alias("ntotal"),
        F.coalesce(F.max(dimension), F.lit(0)).alias("dimension"),
        n.alias("metadata_rows"),
        F.lit(INDEX_TYPE).alias("index_type"),
    )


def hit_rows(hits: DataFrame) -> DataFrame:
    """Hits as the retriever reports them, with defaults for missing metadata."""
    section = F.col("section") if "section" in hits.columns else F.lit("")
    return hits.select(
        "query_id",
        "rank",
        "score",
        "row",
        F.coalesce("chunk_id", F.lit("")).alias("chunk_id"),
        F.coalesce("book_title", F.lit("")).alias("book"),
        F.coalesce("page_number", F.lit(0)).alias("page"),
        F.coalesce("content", F.lit("")).alias("content"),
        F.coalesce(section, F.lit("")).alias("section"),
    )


class Retriever:
    """Text queries to ranked chunks."""

    def __init__(
        self,
        index: VectorIndex,
        make_encoder: Callable[[], Encoder],
        model_key: str = "bge-small",
    ) -> None:
        embedding_model(model_key)
        built_with = index.model_key()
        if built_with not in (None, model_key):
            raise ValueError(
                f"Model mismatch: index was built with '{built_with}', "
                f"but Retriever is configured with '{model_key}'."
            )
        self.index, self.make_encoder, self.model_key = index, make_encoder, model_key

    def search(self, queries: DataFrame, k: int = 5) -> DataFrame:
        """Hits for ``(query_id, query)`` rows; blank queries have none."""
        asked = queries.filter(~is_blank(F.col("query")))
        encoded = encode_column(asked, "query", self.make_encoder, out="vec")
        return hit_rows(self.index.search(encoded.select("query_id", "vec"), k))

    def search_text(self, query: str, k: int = 5) -> DataFrame:
        spark = SparkSession.active()
        return self.search(
            spark.createDataFrame([(0, query)], "query_id long, query string"), k
        ).orderBy("rank")

    def stats(self) -> DataFrame:
        return self.index.stats()
