"""Exact top-k inner-product search, one matrix product per Arrow batch.

Top-k decomposes: the best k of every index block contain the best k overall.  Each task
multiplies the query matrix with its share of the index and hands on k rows per query, so
vectors never move and the shuffle carries results only.  More queries than fit a matrix of
bounded size, or whose hits do not, are answered from balls (``balls.py``), in two rounds
whatever their number.  Where many hits are asked for they would be far more than the vectors;
then a small index is shipped instead, and a task ranks whole queries, so no hit is exchanged.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from folioforge.session import cut_lineage

HIT = "query_id long, row long, score double"
_HIT_ARROW = pa.schema(
    [("query_id", pa.int64()), ("row", pa.int64()), ("score", pa.float64())]
)

# Bytes of queries up to which they are shipped to every task.
BROADCAST_BYTES = 64 << 20
# Bytes of a hit while it is merged with others, which a task holds for all queries shipped to it.
_MERGED_BYTES = 96
# Scores held at once in a task.
_TILE = 1 << 20
_MERGE_SALTS = 64
# Hits of a query from which on a small index is shipped to the queries, and hits stay in their task.
_MANY_HITS = 256
# Hits that leave such a task at once, where all vectors are hits.
_RANK_TILE = 1 << 17
# Bytes of a shipped vector in a task, as ``Block`` holds it: of each coordinate, and besides.
_HELD_COORDINATE, _HELD_VECTOR = 12, 24
# Pairs of a query and a vector that a task scores, about.
_TASK_PAIRS = 1 << 26

RANKED = "query_id long, rank int, row long, score double"
_RANKED_ARROW = pa.schema(
    [("query_id", pa.int64()), ("rank", pa.int32()), ("row", pa.int64()), ("score", pa.float64())]
)


def _matrix(column: pa.Array, dim: int | None, names: pa.Array, what: str) -> np.ndarray:
    """List column to a float32 matrix; every vector must have the same length.

    A vector that is not finite compares with nothing, so it is an error that names its row.
    """
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    flat = column.flatten().to_numpy(zero_copy_only=False).astype("float32", copy=False)
    n = len(column)
    d = dim if dim is not None else (len(flat) // n if n else 0)
    lengths = np.diff(np.asarray(column.offsets))
    if column.null_count or (lengths != d).any():
        found = sorted(set(lengths.tolist()) - {d}) or ["null"]
        raise ValueError(f"Query dim {d} != index dimension {found[0]}")
    matrix = flat.reshape(n, d)
    broken = np.flatnonzero(~np.isfinite(matrix).all(axis=1))
    if len(broken):
        raise ValueError(f"Vector of {what} {names[int(broken[0])].as_py()} is not finite")
    return matrix


def _unit(m: np.ndarray) -> np.ndarray:
    norms = np.linalg.norm(m.astype("float64"), axis=1, keepdims=True)
    return m / np.where(norms == 0, 1.0, norms)


class Block:
    """Vectors of one block, made ready for scoring."""

    def __init__(self, rows: np.ndarray, vecs: np.ndarray, unit_index: bool) -> None:
        self.rows = rows
        self.vecs = vecs.astype("float64")
        squares = (self.vecs**2).sum(axis=1)
        self.squares = np.where(squares == 0, 1.0, squares) if unit_index else None
        scaled = _unit(vecs) if unit_index else self.vecs
        self.single = scaled.astype("float32").T
        longest = max(np.linalg.norm(scaled, axis=1).max(), 1e-30)
        self.error = 4 * vecs.shape[1] * np.finfo("float32").eps * longest

    def _exact(self, picked: np.ndarray, part: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """Scores of pairs.  A cosine is the root of a quotient of squares: of vectors of whole
        numbers all of these are exact, so that multiples of a vector tie as they should."""
        score = (self.vecs[picked] * part).sum(axis=1)
        if self.squares is not None:
            square = score * np.abs(score) / self.squares[picked]
            score = np.sign(square) * np.sqrt(np.abs(square))
        return score / lengths

    def best(self, queries: np.ndarray, k: int, unit_queries: bool) -> Iterator[Hits]:
        """The best k vectors of each query, by score and then the lower row; tile by tile.

        The float32 product only picks candidates; everything within its rounding error of
        the k-th best is scored again in double precision, so the outcome is exact.
        """
        tile = max(1, _TILE // len(self.vecs))
        for start in range(0, len(queries), tile):
            part = queries[start : start + tile]
            scaled = _unit(part) if unit_queries else part
            coarse = scaled.astype("float32") @ self.single
            if coarse.shape[1] > k:
                kth = np.partition(coarse, -k, axis=1)[:, -k]
                bar = kth - self.error * np.linalg.norm(scaled, axis=1)
                at, picked = np.nonzero(coarse >= bar[:, None])
            else:
                at, picked = np.indices(coarse.shape).reshape(2, -1)
            lengths = np.linalg.norm(part, axis=1) if unit_queries else np.ones(len(part))
            lengths[lengths == 0] = 1.0
            exact = np.empty(len(at))
            step = max(1, _TILE // (4 * max(queries.shape[1], 1)))
            for i in range(0, len(at), step):
                own = slice(i, i + step)
                exact[own] = self._exact(picked[own], part[at[own]], lengths[at[own]])
            yield _ranked(Hits(at + start, self.rows[picked], exact), k)

    def every(self, queries: np.ndarray, unit_queries: bool) -> Iterator[Hits]:
        """All vectors, whose rows have to ascend, in the order ``best`` gives them; tile by tile."""
        n = len(self.vecs)
        tile = max(1, _RANK_TILE // n)
        for start in range(0, len(queries), tile):
            part = queries[start : start + tile]
            # Not a matrix product, in which the place of a vector decides how it is rounded: equal
            # vectors have to tie.
            score = np.einsum("ij,qj->qi", self.vecs, part)
            if self.squares is not None:
                square = score * np.abs(score) / self.squares
                score = np.sign(square) * np.sqrt(np.abs(square))
            if unit_queries:
                lengths = np.linalg.norm(part, axis=1, keepdims=True)
                score /= np.where(lengths == 0, 1.0, lengths)
            order = np.argsort(-score, axis=1)
            score = np.take_along_axis(score, order, axis=1)
            _order_ties(order, score)
            query = np.repeat(np.arange(start, start + len(part)), n)
            yield Hits(query, self.rows[order.ravel()], score.ravel())


def _order_ties(order: np.ndarray, score: np.ndarray) -> None:
    """Puts the places of equal scores, which are neighbours in a line of ``score``, in order."""
    same = np.zeros((len(score), score.shape[1] + 1), bool)
    same[:, 1:-1] = score[:, 1:] == score[:, :-1]
    at = np.flatnonzero(same[:, 1:] | same[:, :-1])
    if len(at):
        run = np.cumsum(~same[:, :-1].ravel()[at])
        tied = order.ravel()[at]
        np.put(order, at, tied[np.lexsort((tied, run))])


class Hits(NamedTuple):
    """Parallel arrays: the place of a query, a row of the index, their score."""

    query: np.ndarray
    row: np.ndarray
    score: np.ndarray


def _ranked(hits: Hits, k: int) -> Hits:
    """The first k hits of each query, by score and then the lower row."""
    order = np.lexsort((hits.row, -hits.score, hits.query))
    query = hits.query[order]
    first = np.flatnonzero(np.diff(query, prepend=-1))
    place = np.arange(len(query)) - np.repeat(first, np.diff(np.append(first, len(query))))
    order = order[place < k]
    return Hits(*(x[order] for x in hits))


def _as_hits(ids: np.ndarray, hits: Hits) -> pa.RecordBatch:
    arrays = ids[hits.query].astype("int64"), hits.row.astype("int64"), hits.score
    return pa.RecordBatch.from_arrays([pa.array(x) for x in arrays], schema=_HIT_ARROW)


def _joined(parts: list[Hits]) -> Hits:
    return Hits(*map(np.concatenate, zip(*parts, strict=True)))


def _scan_with(ids: np.ndarray, queries: np.ndarray, k: int, unit_index: bool, unit_queries: bool):
    """Task body of the broadcast path: a running top-k over the partition's batches."""

    def scan(batches):
        kept: Hits | None = None
        for batch in batches:
            if batch.num_rows == 0:
                continue
            vecs = _matrix(batch.column("vec"), queries.shape[1], batch.column("row"), "row")
            rows = batch.column("row").to_numpy(zero_copy_only=False)
            found = _joined(list(Block(rows, vecs, unit_index).best(queries, k, unit_queries)))
            kept = found if kept is None else _ranked(_joined([kept, found]), k)
        if kept is not None:
            yield _as_hits(ids, kept)

    return scan


def _rank_with(rows: pa.Array, vecs: np.ndarray, k: int, unit_index: bool, unit_queries: bool):
    """Task body of the shipped index, whose rows ascend: ranks of queries that come in the order
    of their ids.  Vectors of one id are one query, whose running best is all that is held."""

    def as_ranked(names: pa.Array, hits: Hits) -> pa.RecordBatch:
        first = np.flatnonzero(np.diff(hits.query, prepend=-1))
        counts = np.diff(np.append(first, len(hits.query)))
        rank = np.arange(1, len(hits.query) + 1) - np.repeat(first, counts)
        named, found = names.take(pa.array(hits.query)), rows.take(pa.array(hits.row))
        return pa.RecordBatch.from_arrays(
            [named, pa.array(rank.astype("int32")), found, pa.array(hits.score)], schema=_RANKED_ARROW
        )

    def ranks(batches):
        block, last, held = None, None, None
        for batch in batches:
            if batch.num_rows == 0:
                continue
            block = block or Block(np.arange(len(rows)), vecs, unit_index)
            ids = batch.column("query_id")
            queries = _matrix(batch.column("vec"), vecs.shape[1], ids, "query").astype("float64")
            value, known = ids.fill_null(0).to_numpy(), ids.is_valid().to_numpy(zero_copy_only=False)
            other = (value[1:] != value[:-1]) | (known[1:] != known[:-1])
            group = np.append(0, np.cumsum(other))
            names = ids.take(pa.array(np.append(0, np.flatnonzero(other) + 1)))
            if held is not None and last[0].as_py() == names[0].as_py():
                held = held._replace(query=np.zeros_like(held.query))
            elif held is not None:
                yield as_ranked(last, held._replace(query=np.zeros_like(held.query)))
                held = None
            many = len(rows) > k
            for hits in block.best(queries, k, unit_queries) if many else block.every(queries, unit_queries):
                hits = hits._replace(query=group[hits.query])
                if held is not None and held.query[0] != hits.query[0]:
                    yield as_ranked(names, held)
                    held = None
                if held is not None:
                    hits = _joined([held, hits])
                if held is not None or len(names) < len(ids):
                    hits = _ranked(hits, k)
                # The last id may go on in what comes next.
                end = np.searchsorted(hits.query, hits.query[-1])
                if end:
                    yield as_ranked(names, Hits(*(x[:end] for x in hits)))
                held = Hits(*(x[end:] for x in hits))
            last = names[-1:]
        if held is not None:
            yield as_ranked(last, held._replace(query=np.zeros_like(held.query)))

    return ranks


def _rank_queries(
    index: DataFrame, n: int, queries: DataFrame, size, k: int, unit_queries: bool, unit_index: bool
) -> DataFrame:
    """``(query_id, rank, row, score)`` from an index of ``n`` vectors that each task holds.

    An id with more vectors than a task should score is dealt over several, whose best are merged.
    """
    table = index.toArrow()
    table = table.take(pc.sort_indices(table, [("row", "ascending")], null_placement="at_start"))
    rows = table.column("row").combine_chunks()
    vecs = _matrix(table.column("vec"), size.hi, rows, "row")
    wanted = int(queries.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    tasks = max(wanted, -(-size.n * n // _TASK_PAIRS))

    def ranked(some: DataFrame, *keys: str) -> DataFrame:
        dealt = some.repartition(tasks, *keys).sortWithinPartitions("query_id").select("query_id", "vec")
        return dealt.mapInArrow(_rank_with(rows, vecs, k, unit_index, unit_queries), RANKED)

    shares = F.ceil(F.count("*") * n / _TASK_PAIRS)
    hot = queries.groupBy(F.col("query_id").alias("hot_id")).agg(shares.alias("shares")).filter("shares > 1")
    hot = cut_lineage(hot, "hot-ids")
    if hot.isEmpty():
        return ranked(queries, "query_id")
    same = F.col("query_id").eqNullSafe(F.col("hot_id"))
    place = F.pmod(F.col("place"), F.col("shares"))
    placed = queries.withColumn("place", F.monotonically_increasing_id())
    parts = ranked(placed.join(F.broadcast(hot), same).withColumn("place", place), "query_id", "place")
    rest = ranked(queries.join(F.broadcast(hot), same, "left_anti"), "query_id")
    return rest.unionByName(keep_top(parts.drop("rank"), k))


def keep_top(hits: DataFrame, k: int) -> DataFrame:
    """Merge per-task winners to k ranked rows per query, in two steps.

    One query has k rows per index partition, which is a hot group when queries are few;
    the salted first step spreads it.
    """
    order = [F.desc("score"), F.asc("row")]
    salted = Window.partitionBy("query_id", "salt").orderBy(*order)
    final = Window.partitionBy("query_id").orderBy(*order)
    return (
        hits.withColumn("salt", F.pmod(F.xxhash64("row"), F.lit(_MERGE_SALTS)))
        .withColumn("r", F.row_number().over(salted))
        .filter(F.col("r") <= k)
        .withColumn("rank", F.row_number().over(final))
        .filter(F.col("rank") <= k)
        .select("query_id", "rank", "row", "score")
    )


def top_k(
    index: DataFrame,
    queries: DataFrame,
    k: int = 5,
    unit_queries: bool = True,
    unit_index: bool = True,
    broadcast_bytes: int = BROADCAST_BYTES,
    dimension: int | None = None,
) -> DataFrame:
    """Best k index rows per query: ``(query_id, rank, row, score)``.

    ``index`` has ``row`` and ``vec``, ``queries`` has ``query_id`` and ``vec``; the flags
    scale either side to unit length, which makes the score the cosine.  Ties go to the
    lower row; fewer than k rows come back when the index is smaller.  With
    ``dimension`` queries of another length are refused before the index is read.
    """
    index = index.select(F.col("row").cast("long").alias("row"), "vec")
    queries = queries.select(F.col("query_id").cast("long").alias("query_id"), "vec")
    queries.persist()  # sized, then fetched: encoded queries must not be encoded twice
    size = queries.agg(
        F.count("*").alias("n"),
        F.min(F.size("vec")).alias("lo"),
        F.max(F.size("vec")).alias("hi"),
    ).first()
    if size.n == 0:
        empty = index.select("row").limit(0)
        return empty.select(
            F.lit(0).cast("long").alias("query_id"),
            F.lit(0).alias("rank"),
            "row",
            F.lit(0.0).alias("score"),
        )
    if size.lo != size.hi:
        raise ValueError(f"Queries differ in dimension: {size.lo} and {size.hi}")
    if dimension is not None and size.hi != dimension:
        raise ValueError(f"Query dim {size.hi} != index dimension {dimension}")
    if size.n * max(8 * size.hi, _MERGED_BYTES * k) > broadcast_bytes:
        from folioforge.operators.balls import BallIndex

        # Stored before the cache is given up; balls then send a query to where it can win.
        stored = cut_lineage(queries, "queries")
        queries.unpersist()
        if k >= _MANY_HITS:
            n = index.count()
            if 0 < n * (_HELD_COORDINATE * size.hi + _HELD_VECTOR) <= broadcast_bytes:
                return _rank_queries(index, n, stored, size, k, unit_queries, unit_index)
        return BallIndex.build(index, unit_index).search(stored, k, unit_queries)
    table = queries.toArrow()
    queries.unpersist()
    ids = table.column("query_id")
    matrix = _matrix(table.column("vec"), size.hi, ids, "query").astype("float64")
    scan = _scan_with(ids.to_numpy(), matrix, k, unit_index, unit_queries)
    return keep_top(index.mapInArrow(scan, HIT), k)
