"""Exact top-k search with pruning: vectors in balls, queries sent to balls that can win.

Vectors are stored by the nearest of a bounded number of centres.  No vector of a ball scores
higher than the centre does plus the radius times the query's length, by the triangle
inequality.  A query first visits the balls of the nearest centres until they hold k vectors;
its k-th score there is a bar that later balls have to be able to reach.  So there are two
rounds for any number of queries, each reads the folders of the balls that somebody asks for,
and a task holds one part of a ball and streams the queries past it.

Centres come from a bounded sample (``SAMPLE_PER_BALL`` rows for each ball).  They only decide
how much is pruned: every vector is in a ball, and every ball that may hold a hit is searched.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioforge.operators.knn import HIT, Block, _as_hits, _matrix, _unit, keep_top
from folioforge.session import cut_lineage, new_table_path

#: Vectors of a part, about: what a task holds at once.
PART_ROWS = 4096
#: Balls at most, and bytes of their centres, which every task gets.
MAX_BALLS, CENTRE_BYTES = 1024, 16 << 20
SAMPLE_PER_BALL, CENTRE_ROUNDS = 16, 5
#: Distances to centres that a task holds at once.
_CELLS = 1 << 17
#: Relative error that rounding may put into a bound.
_SLACK = 1e-9
_SPREAD = 0x9E3779B97F4A7C15


def _centres(sample: np.ndarray, balls: int) -> np.ndarray:
    """Means of the sample's groups after a few rounds of reassignment."""
    centres = sample[np.linspace(0, len(sample) - 1, balls).astype(int)]
    for _ in range(CENTRE_ROUNDS):
        own = _nearest(sample, centres)[0]
        counts = np.bincount(own, minlength=len(centres))
        sums = np.zeros_like(centres)
        np.add.at(sums, own, sample)
        centres = np.where(counts[:, None] > 0, sums / np.maximum(counts, 1)[:, None], centres)
    return centres


def _slices(n: int, balls: int) -> list[slice]:
    """Of ``n`` vectors, so many at a time that their distances to all centres are few."""
    step = max(1, _CELLS // max(balls, 1))
    return [slice(i, i + step) for i in range(0, n, step)]


def _nearest(vectors: np.ndarray, centres: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nearest centre of each vector, and how far it is."""
    half, own = (centres**2).sum(axis=1) / 2, np.zeros(len(vectors), np.int64)
    for some in _slices(len(vectors), len(centres)):
        own[some] = (half - vectors[some] @ centres.T).argmin(axis=1)
    return own, np.linalg.norm(vectors - centres[own], axis=1)


class BallIndex:
    """Vectors ``(ball, part, row, vec, far)`` in folders by ball, and what bounds the balls."""

    def __init__(self, table: DataFrame, centres: np.ndarray, parts: list[int], unit_index: bool) -> None:
        self.table, self.centres, self.parts, self.unit_index = table, centres, parts, unit_index
        sizes = table.groupBy("ball").agg(F.max("far").alias("radius"), F.count("*").alias("n")).collect()
        self.radii, self.sizes = np.full(len(centres), -np.inf), np.zeros(len(centres), np.int64)
        for r in sizes:  # a row for each ball
            self.radii[r.ball], self.sizes[r.ball] = r.radius, r.n

    @classmethod
    def build(cls, index: DataFrame, unit_index: bool = True, part_rows: int = PART_ROWS) -> BallIndex:
        """From ``(row, vec)``; every vector is read once for the sample and once to be stored."""
        spark = index.sparkSession
        index = index.select(F.col("row").cast("long").alias("row"), "vec")
        n, dim = index.agg(F.count("*"), F.max(F.size("vec"))).first()
        dim = max(dim or 0, 1)
        balls = max(1, min(MAX_BALLS, CENTRE_BYTES // (8 * dim), -(-n // part_rows)))
        some = index.orderBy(F.xxhash64("row"), "row").limit(SAMPLE_PER_BALL * balls).toArrow()
        scale = _unit if unit_index else (lambda m: m)
        sample = scale(_matrix(some.column("vec"), dim, some.column("row"), "row").astype("float64"))
        centres = _centres(sample, min(balls, len(sample))) if len(sample) else np.zeros((1, dim))
        share = np.bincount(_nearest(sample, centres)[0], minlength=len(centres)) if len(sample) else np.ones(1)
        parts = np.maximum(1, -(-share * n // (max(share.sum(), 1) * part_rows))).astype(np.int64)

        def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                vecs = scale(_matrix(batch.column("vec"), dim, batch.column("row"), "row").astype("float64"))
                rows = batch.column("row").to_numpy(zero_copy_only=False).astype(np.int64)
                ball, far = _nearest(vecs, centres)
                part = ((rows.astype(np.uint64) * np.uint64(_SPREAD)) >> np.uint64(33)).astype(np.int64) % parts[ball]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(ball.astype(np.int32)), pa.array(part.astype(np.int32)), batch.column("row"), batch.column("vec"), pa.array(far)],
                    names=["ball", "part", "row", "vec", "far"],
                )

        vec_type = index.schema["vec"].dataType.simpleString()
        schema = f"ball int, part int, row long, vec {vec_type}, far double"
        path = new_table_path(spark, "balls")
        dealt = index.mapInArrow(placed, schema).repartition("ball", "part")
        dealt.write.partitionBy("ball").parquet(path)
        stored = spark.read.schema(schema).parquet(path)
        return cls(stored, centres, parts.tolist(), unit_index)

    def _routed(self, queries: DataFrame, k: int, unit_queries: bool, second: bool) -> DataFrame:
        """``(query_id, ball, vec)`` of one round; the second one has ``bar`` in ``queries``."""
        centres, radii, sizes = self.centres, self.radii, self.sizes

        def asked_of(vecs: np.ndarray, bar: np.ndarray | None) -> np.ndarray:
            near = np.where(sizes > 0, vecs @ centres.T, -np.inf)
            order = np.argsort(-near, axis=1, kind="stable")
            before = np.cumsum(sizes[order], axis=1) - sizes[order]
            asked = np.zeros(near.shape, bool)
            np.put_along_axis(asked, order, before < k, axis=1)
            asked &= sizes > 0
            if bar is None:
                return asked
            length = np.linalg.norm(vecs, axis=1, keepdims=True)
            reach = length * (np.linalg.norm(centres, axis=1) + np.maximum(radii, 0))
            bound = near + length * np.maximum(radii, 0) + _SLACK * reach
            # Fewer than k hits so far: nothing is out of the question.
            bar = np.where(np.isnan(bar), -np.inf, bar)
            return ~asked & (sizes > 0) & (bound >= bar[:, None])

        def routed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                ids, vec = batch.column("query_id"), batch.column("vec")
                vecs = _matrix(vec, centres.shape[1], ids, "query").astype("float64")
                vecs = _unit(vecs) if unit_queries else vecs
                bar = batch.column("bar").to_numpy(zero_copy_only=False) if second else None
                for some in _slices(len(vecs), len(centres)):
                    at, ball = np.nonzero(asked_of(vecs[some], bar[some] if second else None))
                    picked = pa.array(at + some.start)
                    yield pa.RecordBatch.from_arrays(
                        [ids.take(picked), pa.array(ball.astype(np.int32)), vec.take(picked)],
                        names=["query_id", "ball", "vec"],
                    )

        vec_type = queries.schema["vec"].dataType.simpleString()
        return queries.mapInArrow(routed, f"query_id long, ball int, vec {vec_type}")

    def _visited(self, asked: DataFrame, k: int, unit_queries: bool) -> DataFrame:
        """``HIT`` rows: the best k of each part that a query is sent to."""
        balls = [r.ball for r in asked.select("ball").distinct().collect()]  # MAX_BALLS at most
        unit_index, dim = self.unit_index, self.centres.shape[1]

        def visited(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            here, rows, vecs, block = None, [], [], None
            for batch in batches:
                key = batch.column("ball").to_numpy() * np.int64(1 << 32) + batch.column("part").to_numpy()
                asks = batch.column("asks").to_numpy(zero_copy_only=False)
                starts = np.flatnonzero(np.diff(key * 2 + asks, prepend=-1))
                for a, b in zip(starts, np.append(starts[1:], len(key)), strict=True):
                    if key[a] != here:
                        here, rows, vecs, block = key[a], [], [], None
                    ids = batch.column("id").slice(a, b - a)
                    name = "query" if asks[a] else "row"
                    own = _matrix(batch.column("vec").slice(a, b - a), dim, ids, name)
                    ids = ids.to_numpy(zero_copy_only=False)
                    if not asks[a]:
                        rows.append(ids)
                        vecs.append(own)
                    elif rows:
                        block = block or Block(np.concatenate(rows), np.concatenate(vecs), unit_index)
                        for hits in block.best(own.astype("float64"), k, unit_queries):
                            yield _as_hits(ids, hits)

        vec_type = asked.schema["vec"].dataType.simpleString()
        # An index of few parts is held by several tasks each, which share its queries.
        wanted = int(asked.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        shares = max(1, -(-wanted // sum(self.parts)))
        copies = F.sequence(F.col("part") * shares, F.col("part") * shares + (shares - 1))
        held = self.table.filter(F.col("ball").isin(balls)).select(
            "ball", F.explode(copies).alias("part"), F.lit(False).alias("asks"),
            F.col("row").alias("id"), F.col("vec").cast(vec_type).alias("vec"),
        )
        parts = F.element_at(F.array(*map(F.lit, self.parts)), F.col("ball") + 1)
        share = F.pmod(F.xxhash64("query_id"), F.lit(shares)).cast("int")
        asking = asked.withColumn("part", F.explode(F.sequence(F.lit(0), (parts - 1).cast("int")))).select(
            "ball", (F.col("part") * shares + share).alias("part"),
            F.lit(True).alias("asks"), F.col("query_id").alias("id"), "vec",
        )
        both = held.unionByName(asking).repartition("ball", "part")
        return both.sortWithinPartitions("ball", "part", "asks").mapInArrow(visited, HIT)

    def routes(self, queries: DataFrame, k: int = 5, unit_queries: bool = True) -> tuple[DataFrame, DataFrame]:
        """Hits as ``search`` gives them, and ``(round, query_id, ball)`` of every visit."""
        first = cut_lineage(self._routed(queries, k, unit_queries, False), "visits")
        hits = cut_lineage(keep_top(self._visited(first, k, unit_queries), k), "hits")
        bars = hits.filter(F.col("rank") == k).select("query_id", F.col("score").alias("bar"))
        with_bar = queries.join(bars, "query_id", "left")
        second = cut_lineage(self._routed(with_bar, k, unit_queries, True), "visits")
        more = self._visited(second, k, unit_queries)
        visits = [x.select(F.lit(i + 1).alias("round"), "query_id", "ball") for i, x in enumerate((first, second))]
        return keep_top(hits.drop("rank").unionByName(more), k), visits[0].unionByName(visits[1])

    def search(self, queries: DataFrame, k: int = 5, unit_queries: bool = True) -> DataFrame:
        """``(query_id, rank, row, score)``, the same rows as a search of everything."""
        return self.routes(queries, k, unit_queries)[0]

    def report(self, visits: DataFrame) -> DataFrame:
        """One row a round: visits, queries, and the share of all query-vector pairs scored."""
        sizes = F.element_at(F.array(*[F.lit(int(n)) for n in self.sizes]), F.col("ball") + 1)
        every = int(self.sizes.sum())
        return visits.groupBy("round").agg(
            F.count("*").alias("visits"),
            F.countDistinct("query_id").alias("queries"),
            F.countDistinct("ball").alias("balls_read"),
            F.lit(int((self.sizes > 0).sum())).alias("balls"),
            (F.sum(sizes) / (F.countDistinct("query_id") * F.lit(max(every, 1)))).alias("share_scored"),
        )
