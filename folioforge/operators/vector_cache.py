"""Persistent cache of vectors: an append-only log, bucketed by key, in generations.

A generation is a folder of batches; every writer adds batches of its own, so writers do not
disturb each other, and files of all batches are bucketed alike by key.  Looking keys up joins
bucket to bucket: what is in the cache is read where it lies and is never exchanged.  Clearing
and compacting start a new generation by adding one row to a small table, after the folder it
names is complete; whoever reads the old one goes on reading it.
"""

from __future__ import annotations

import hashlib
import time
import uuid
import warnings

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioforge import schemas
from folioforge.functions.structure import embedding_cache_key
from folioforge.sources.tables import read_or_empty

_GENERATION = "number long, name string, buckets int"
_ROW = "cache_key STRING, embedding ARRAY<FLOAT>, written BIGINT"


class EmbeddingCache:
    """Vectors by key in the folder ``path``.

    ``key="content"`` keys on model and text, so that changed texts and other models do not
    get stale vectors; ``key="chunk"`` keys on the chunk id as published, whose 48 bits are
    not unique in corpora of many millions of chunks.  A broken file is an error.

    ``buckets`` holds for the first generation and defaults to the session's number of shuffle
    partitions, so that the other side of a lookup is exchanged into as many.
    """

    def __init__(
        self, spark: SparkSession, path: str, key: str = "content", model_key: str = "", buckets: int | None = None
    ) -> None:
        self.spark, self.path, self.key, self.model_key = spark, path.rstrip("/"), key, model_key
        self.buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))

    # --- generations ------------------------------------------------------------------

    def _generations(self) -> DataFrame:
        schema = self.spark.createDataFrame([], _GENERATION).schema
        return read_or_empty(self.spark, f"{self.path}/generations", schema)

    def _current(self):
        """The newest generation ``(number, name, buckets)``, or None before the first vector.

        Two that were started at once have one number; all sessions choose the same of them.
        """
        return self._generations().orderBy(F.desc("number"), F.desc("name")).first()

    def _start(self, number: int, name: str, buckets: int) -> None:
        row = self.spark.createDataFrame([(number, name, buckets)], _GENERATION)
        row.coalesce(1).write.mode("append").parquet(f"{self.path}/generations")

    def _folder(self, number: int, name: str) -> str:
        return f"{self.path}/vectors-{number:06d}-{name}"

    def _table_of(self, generation) -> DataFrame:
        """The log of a generation as Spark's bucketed table: ``(cache_key, embedding, written)``."""
        folder = self._folder(generation.number, generation.name)
        table = "vector_cache_" + hashlib.md5(folder.encode()).hexdigest()[:24]
        location = folder.replace("\\", "\\\\").replace("'", "\\'")
        self.spark.sql(
            f"CREATE TABLE IF NOT EXISTS {table} ({_ROW}, batch STRING) USING parquet PARTITIONED BY (batch) "
            f"CLUSTERED BY (cache_key) INTO {generation.buckets} BUCKETS LOCATION '{location}'"
        )
        # Batches of other writers become known.
        self.spark.sql(f"ALTER TABLE {table} RECOVER PARTITIONS")
        self.spark.catalog.refreshTable(table)
        return self.spark.table(table).drop("batch")

    def _append(self, rows: DataFrame, number: int, name: str, buckets: int) -> None:
        batch = uuid.uuid4().hex
        # A table of its own for each batch: Spark's writer clears what others have begun in
        # the folder that it commits to.  Dropping the table leaves the files.
        table = f"vector_batch_{batch}"
        written = rows.select("cache_key", F.col("embedding").cast("array<float>"), F.lit(time.time_ns()).alias("written"))
        folder = f"{self._folder(number, name)}/batch={batch}"
        written.write.format("parquet").bucketBy(buckets, "cache_key").option("path", folder).saveAsTable(table)
        self.spark.sql(f"DROP TABLE {table}")

    # --- entries ----------------------------------------------------------------------

    def _key(self):
        if self.key == "chunk":
            return embedding_cache_key(F.col("id"))
        return F.sha2(F.concat_ws("\n", F.lit(self.model_key), F.col("content")), 256)

    def keyed(self, chunks: DataFrame) -> DataFrame:
        return chunks.withColumn("cache_key", self._key())

    def log(self) -> DataFrame:
        """All entries of the current generation, keys as often as they were written."""
        current = self._current()
        if current is None:
            return self.spark.createDataFrame([], schemas.EMBEDDING_CACHE).withColumn("written", F.lit(0).cast("long"))
        return self._table_of(current)

    def table(self) -> DataFrame:
        """One vector per key, the one written first, whoever has written it how often."""
        return self.log().groupBy("cache_key").agg(F.min_by("embedding", "written").alias("embedding"))

    def hits(self, chunks: DataFrame) -> DataFrame:
        """Chunks with a cached vector."""
        return self.keyed(chunks).join(self.table(), "cache_key")

    def misses(self, chunks: DataFrame) -> DataFrame:
        """One row per key without a vector; of the cache, only keys are read."""
        known = self.log().select("cache_key")
        return self.keyed(chunks).join(known, "cache_key", "left_anti").dropDuplicates(["cache_key"])

    def add(self, rows: DataFrame) -> None:
        """Append ``(cache_key, embedding)`` to the current generation."""
        current = self._current()
        if current is None:
            # The first one has a fixed name, so writers that start at once share it.
            self._begin(0, f"first-{self.buckets}", self.buckets)
            current = self._current()
        self._append(rows, *current)

    # --- upkeep -----------------------------------------------------------------------

    def clear(self) -> None:
        """An empty generation; readers of the one before are not disturbed."""
        if (current := self._current()) is not None:
            self._begin(current.number + 1, uuid.uuid4().hex, current.buckets)

    def _begin(self, number: int, name: str, buckets: int, rows: DataFrame | None = None) -> None:
        """Make a generation current after its first batch, which may be empty, is there."""
        rows = self.spark.createDataFrame([], schemas.EMBEDDING_CACHE) if rows is None else rows
        self._append(rows, number, name, buckets)
        self._start(number, name, buckets)

    def _replace(self, rows: DataFrame, buckets: int | None) -> None:
        current = self._current()
        self._begin(current.number + 1, uuid.uuid4().hex, buckets or current.buckets, rows)

    def compact(self, buckets: int | None = None) -> None:
        """One batch with one entry per key, dealt over ``buckets`` anew if that is given.

        What others add meanwhile goes to the old generation: they will compute it again.
        """
        if self._current() is not None:
            self._replace(self.table(), buckets)

    def repair(self) -> int:
        """A generation of what can be read; the number of entries saved.

        Entries of broken files are lost and will be computed again, which a warning says.
        """
        current = self._current()
        if current is None:
            return 0
        folder = self._folder(current.number, current.name)
        readable = self.spark.read.schema(schemas.EMBEDDING_CACHE).option("ignoreCorruptFiles", "true").parquet(folder)
        one = readable.groupBy("cache_key").agg(F.min("embedding").alias("embedding"))
        self._replace(one, None)
        saved = self.log().count()
        warnings.warn(f"{self.path}: {saved} cache entries saved, those of broken files are lost", stacklevel=2)
        return saved

    def vacuum(self) -> int:
        """Delete the folders of older generations, once nobody reads them; how many."""
        current = self._current()
        old = [] if current is None else self._generations().filter(F.col("number") < current.number).collect()
        deleted = 0
        for g in old:  # a row for each clearing or compaction
            folder = self.spark._jvm.org.apache.hadoop.fs.Path(self._folder(g.number, g.name))
            system = folder.getFileSystem(self.spark._jsc.hadoopConfiguration())
            deleted += bool(system.exists(folder) and system.delete(folder, True))
        return deleted

    def stats(self) -> DataFrame:
        """Entries, vector bytes and dimension; 8 bytes per component as published."""
        sizes = self.log().select("cache_key", F.size("embedding").alias("n"), "written")
        one = sizes.groupBy("cache_key").agg(F.min_by("n", "written").alias("n"))
        return one.agg(
            F.count("*").alias("total_embeddings"),
            (
                F.coalesce(F.sum(F.length("cache_key") + 8 * F.col("n")), F.lit(0)) / (1024 * 1024)
            ).alias("cache_size_mb"),
            F.coalesce(F.max("n"), F.lit(0)).alias("model_dimension"),
        )
