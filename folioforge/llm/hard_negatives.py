"""Hard negatives of anchors by coordinate pruning.

Rows are ordered by label and falling length and cut into blocks; a block is searched by one
task and divided into buckets of similar length.  A bucket lists, for every coordinate, its
rows by the value of their unit vector there.  An anchor that asks for inner products of at
least ``t`` can, in a bucket of length up to ``l``, only be answered by rows whose angle to it
is at most ``acos(t / (|anchor| l))``.  That bounds the value of every coordinate; the ranges
of the anchor's largest coordinates, its focus, are cut out of the sorted lists and
intersected, and what is left is scored exactly.  ``t`` rises as results are found.

Anchors are sent to the blocks in one exchange, sorted behind the rows of their block, so a
task holds one block and streams the anchors past it.  It hands on no more than the best few
of each anchor; these are merged by a ranking that Spark limits before it exchanges rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folioforge.operators.ranks import number_rows
from folioforge.session import cut_lineage, ship_package

#: Bytes of the vectors of a block, which one task holds with three times as much beside them.
BLOCK_BYTES = 32 << 20
#: Rows of a bucket, and of a block at least.
BUCKET_ROWS = 4096
#: Coordinates of an anchor that are looked up in sorted lists.
FOCUS = 4
#: Share of a bucket above which a range of a list is not worth cutting out.
DENSE = 0.5
#: Anchors whose scores against one bucket are held at once.
ANCHORS_AT_ONCE = 256
#: What rounding may move an angle's cosine by.
_SLACK = 1e-7
#: Scores beyond 64 bits count as the largest or smallest number of 64 bits.
_LONGEST = (1 << 63) - 1


def quantized(vector: Column, scale: int = 256) -> Column:
    """``floor(scale * x)`` of every component as doubles."""

    def floor(x: Column) -> Column:
        # Doubles from 2^53 on are whole; the floor of larger ones would not fit a long.
        return F.when(F.abs(x) < 1 << 53, F.floor(x).cast("double")).otherwise(x)

    return F.transform(vector, lambda x: floor(x.cast("double") * scale))


def finite(vector: Column, scale: int = 256) -> Column:
    """Whether a vector is there and no component, ``scale`` times, is null, NaN or infinite."""
    good = F.forall(vector, lambda x: F.coalesce(F.abs(x.cast("double") * scale) < float("inf"), F.lit(False)))
    return F.coalesce(good, F.lit(False))


def scores(rows: np.ndarray, anchors: np.ndarray) -> np.ndarray:
    """Exact inner products of whole-numbered rows with anchors, anchors along axis 0.

    No partial sum exceeds the product of the two lengths, so floats of sufficient precision
    give the exact integer; beyond that, Python's integers do.
    """
    most = np.sqrt((rows**2).sum(1).max(initial=0) * (anchors**2).sum(1).max(initial=0))
    if most < 1 << 23:
        return (anchors.astype(np.float32) @ rows.astype(np.float32).T).astype(np.int64)
    if most < 1 << 52:
        return (anchors @ rows.T).astype(np.int64)
    as_ints = [[int(x) for x in r] for r in rows]
    exact = [[sum(map(int.__mul__, map(int, a), r)) for r in as_ints] for a in anchors]
    held = [[max(-_LONGEST - 1, min(_LONGEST, s)) for s in line] for line in exact]
    return np.array(held, dtype=np.int64).reshape(len(anchors), len(rows))


class Bucket:
    """Rows of similar length with a sorted list for every coordinate."""

    def __init__(self, at: np.ndarray, ids: np.ndarray, labels: np.ndarray, vectors: np.ndarray):
        self.at, self.ids, self.labels, self.vectors = at, ids, labels, vectors
        lengths = np.sqrt((vectors**2).sum(1))
        self.longest = float(lengths.max(initial=0))
        self.unit = vectors / np.maximum(lengths, 1e-300)[:, None]
        order = np.argsort(self.unit, axis=0, kind="stable").T
        self.sorted = np.take_along_axis(self.unit.T, order, axis=1)
        self.order = order.astype(np.int32)
        self.labels_here = np.unique(labels)

    def may_reach(self, anchor: np.ndarray, at_least: float) -> np.ndarray | None:
        """The rows, by index, whose score with the anchor may be ``at_least``; None for all."""
        reach = np.sqrt((anchor**2).sum()) * self.longest
        if at_least > reach * (1 + _SLACK):
            return np.empty(0, np.int64)
        if at_least <= 0 or not reach:
            # No angle is excluded, or none is defined.
            return None
        unit = anchor / np.sqrt((anchor**2).sum())
        focus = np.argsort(-np.abs(unit), kind="stable")[:FOCUS]
        widest = np.arccos(min(at_least / reach, 1.0))
        own = np.arccos(np.clip(unit[focus], -1, 1))
        low = np.cos(np.minimum(own + widest, np.pi)) - _SLACK
        high = np.cos(np.maximum(own - widest, 0)) + _SLACK
        first = np.array([np.searchsorted(self.sorted[f], x, "left") for f, x in zip(focus, low, strict=True)])
        last = np.array([np.searchsorted(self.sorted[f], x, "right") for f, x in zip(focus, high, strict=True)])
        best = int(np.argmin(last - first))
        if last[best] - first[best] > DENSE * len(self.ids):
            return None
        rows = self.order[focus[best], first[best] : last[best]]
        values = self.unit[np.ix_(rows, focus)]
        return rows[((values >= low) & (values <= high)).all(1)]


class Best:
    """The first ``k`` of what an anchor has been offered within a band of scores."""

    def __init__(self, k: int, low: int, high: int):
        self.k, self.low, self.high = k, low, high
        self.score, self.id, self.at = (np.empty(0, np.int64) for _ in range(3))

    def at_least(self) -> int:
        """What a score has to reach to get in; equal ones may, by their id."""
        return max(self.low, int(self.score[-1])) if len(self.score) == self.k else self.low

    def offer(self, score: np.ndarray, ids: np.ndarray, at: np.ndarray) -> None:
        good = (score >= self.at_least()) & (score <= self.high)
        score, ids, at = score[good], ids[good], at[good]
        if not len(score):
            return
        if len(score) > 4 * self.k:
            bar = np.partition(score, len(score) - self.k)[len(score) - self.k]
            score, ids, at = score[score >= bar], ids[score >= bar], at[score >= bar]
        score, ids, at = (np.concatenate(x) for x in ((self.score, score), (self.id, ids), (self.at, at)))
        # Highest first; np.lexsort sorts by its last key first, and ~score cannot overflow.
        first = np.lexsort((ids, ~score))[: self.k]
        self.score, self.id, self.at = score[first], ids[first], at[first]


def search(buckets: list[Bucket], anchors: pd.DataFrame, k: int, same: bool) -> Iterator[tuple]:
    """``(anchor, slot, id, at, score)`` of the first ``k`` rows in each band of each anchor.

    ``anchors`` has ``at``, ``label``, ``vector`` and lists ``low`` and ``high`` of bands.
    ``same`` takes rows of the anchor's label other than itself, else rows of other labels.
    """
    for start in range(0, len(anchors), ANCHORS_AT_ONCE):
        some = anchors.iloc[start : start + ANCHORS_AT_ONCE]
        width = buckets[0].vectors.shape[1]
        vectors, labels, own = _matrix(some["vector"], width), some["label"].to_numpy(), some["at"].to_numpy()
        found = [[Best(k, lo, hi) for lo, hi in zip(a, b, strict=True)] for a, b in zip(some["low"], some["high"], strict=True)]
        for bucket in buckets:
            asked, dense = [], []
            for i, bands in enumerate(found):
                alone = len(bucket.labels_here) == 1 and bucket.labels_here[0] == labels[i]
                if not bands or (same and labels[i] not in bucket.labels_here) or (not same and alone):
                    continue
                rows = bucket.may_reach(vectors[i], min(b.at_least() for b in bands))
                if rows is None:
                    dense.append(i)
                elif len(rows):
                    asked.append((i, rows, scores(bucket.vectors[rows], vectors[i : i + 1])[0]))
            if dense:
                every = np.arange(len(bucket.ids))
                asked += [(i, every, s) for i, s in zip(dense, scores(bucket.vectors, vectors[dense]), strict=True)]
            for i, rows, score in asked:
                good = bucket.labels[rows] == labels[i]
                good = good & (bucket.at[rows] != own[i]) if same else ~good
                for band in found[i]:
                    band.offer(score[good], bucket.ids[rows[good]], bucket.at[rows[good]])
        for i, bands in enumerate(found):
            for slot, band in enumerate(bands):
                for x in zip(band.id.tolist(), band.at.tolist(), band.score.tolist(), strict=True):
                    yield (int(own[i]), slot, *x)


def _matrix(vectors: pd.Series, width: int) -> np.ndarray:
    """Vectors as rows; shorter ones end in zeros, what exceeds ``width`` meets only zeros."""
    out = np.zeros((len(vectors), width))
    for row, v in zip(out, vectors, strict=True):
        row[: len(v)] = v[:width]
    return out


def _dealt(rows: DataFrame, anchors: DataFrame, k: int, same: bool) -> DataFrame:
    """``(anchor, slot, id, at, score)``: the best of each block for each anchor.

    ``rows`` has ``(block, at, id, label, vector)``, ``anchors`` the same columns with the block
    that each is sent to, ``low`` and ``high``.
    """
    ship_package(rows.sparkSession)
    schema = "anchor long, slot int, id long, at long, score long"
    columns = ["block", "at", "id", "label", "vector"]
    both = rows.select(*columns, F.lit(False).alias("asks")).unionByName(
        anchors.select(*columns, "low", "high", F.lit(True).alias("asks")), allowMissingColumns=True
    )
    # A row of no id comes last among equal scores.
    both = both.withColumn("id", F.coalesce("id", F.lit(_LONGEST)))

    def searched(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        block, parts, buckets = None, [], []
        for batch in batches:
            for this, own in batch.groupby("block", sort=True):
                if this != block:
                    block, parts, buckets = this, [], []
                if len(held := own[~own["asks"]]):
                    parts.append(held)
                if len(asking := own[own["asks"]]) and parts:
                    buckets = buckets or _buckets(pd.concat(parts))
                    out = list(search(buckets, asking, k, same))
                    yield pd.DataFrame(out, columns=["anchor", "slot", "id", "at", "score"])

    sorted_ = both.repartition("block").sortWithinPartitions("block", "asks", "at")
    return sorted_.mapInPandas(searched, schema).withColumn("id", F.when(F.col("id") != _LONGEST, F.col("id")))


def _buckets(rows: pd.DataFrame) -> list[Bucket]:
    width = max(int(rows["vector"].map(len).max()), 1)
    vectors, at = _matrix(rows["vector"], width), rows["at"].to_numpy()
    ids, labels = rows["id"].to_numpy(np.int64), rows["label"].to_numpy()
    cuts = [slice(i, i + BUCKET_ROWS) for i in range(0, len(rows), BUCKET_ROWS)]
    return [Bucket(at[c], ids[c], labels[c], vectors[c]) for c in cuts]


def _first(found: DataFrame, k: int) -> DataFrame:
    """Add ``rank`` from 1 for each anchor and slot, and keep the first ``k``."""
    order = Window.partitionBy("anchor", "slot").orderBy(F.desc("score"), F.asc_nulls_last("id"), "at")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def mine(
    rows: DataFrame,
    positives: int = 5,
    negatives: int = 10,
    low: int = 30,
    high: int = 90,
    block_rows: int | None = None,
) -> DataFrame:
    """``(anchor_id, positive_id, rank, negative_id, positive_score, negative_score)``.

    ``rows`` has ``id``, ``label``, ``vector`` of whole-numbered doubles, and ``anchor``, which
    tells whether negatives are wanted for the row.  Its first ``positives`` other rows of the
    same label, by inner product and then the smaller id, are the positives of an anchor; for
    each of them the first ``negatives`` rows of other labels are taken whose score is from
    ``low`` to ``high`` percent of the positive's.

    Rows with a null label or vector take no part.  Repeated rows are rows of their own: copies
    of an anchor have each other among their positives and give the same results again.  A null
    id comes last among equal scores.  Vectors of different lengths are filled up with zeros;
    scores beyond 64 bits count as the largest or smallest number there is.  Anchors without a
    positive or negative give no rows, and so does an empty table.
    """
    part = rows.filter("label IS NOT NULL AND vector IS NOT NULL").select("id", "label", "vector", "anchor")
    squares = F.aggregate("vector", F.lit(0.0), lambda s, x: s + x * x)
    placed = number_rows(part.withColumn("shorter", -squares), ["label", "shorter", "id"], "at")
    placed = cut_lineage(placed.drop("shorter"), "negatives-rows")
    n, width = placed.agg(F.count(F.lit(1)), F.max(F.size("vector"))).first()
    if block_rows is None:
        tasks = 4 * rows.sparkSession.sparkContext.defaultParallelism
        block_rows = max(1, min(BLOCK_BYTES // (8 * max(width or 0, 1)), max(BUCKET_ROWS, n // tasks)))
    placed = placed.withColumn("block", F.expr(f"at div {block_rows}L"))
    anchors = placed.filter("anchor").drop("block", "anchor")
    # The blocks of a label follow each other.
    homes = placed.groupBy("label").agg(F.min("block").alias("b0"), F.max("block").alias("b1"))
    all_scores = F.array(F.lit(-_LONGEST - 1)), F.array(F.lit(_LONGEST))
    asking = anchors.join(homes, "label").select(
        "at", "id", "label", "vector", F.explode(F.sequence("b0", "b1")).alias("block"),
        all_scores[0].alias("low"), all_scores[1].alias("high"),
    )
    found = cut_lineage(_first(_dealt(placed, asking, positives, True), positives), "positives")
    # One list of bands for each anchor; a band that no whole number lies in has low > high.
    bands = found.groupBy(F.col("anchor").alias("at")).agg(
        F.sort_array(F.collect_list(F.struct("rank", "id", "score"))).alias("p")
    )
    percent = F.transform("p", lambda p: p["score"].cast("decimal(38,0)"))
    # div rounds towards zero; a band with negative ends holds nothing, so that is no matter.
    low_end = F.transform(percent, lambda s: F.when(s < 0, _LONGEST).otherwise(F.ceil(s * low / 100)).cast("long"))
    high_end = F.transform(percent, lambda s: F.when(s < 0, -_LONGEST).otherwise(F.floor(s * high / 100)).cast("long"))
    known = cut_lineage(anchors.join(bands.withColumn("low", low_end).withColumn("high", high_end), "at"), "anchors")
    asking = known.filter(F.exists("p", lambda p: p["score"] >= 0)).select(
        "at", "id", "label", "vector", "low", "high",
        F.explode(F.sequence(F.lit(0).cast("long"), F.lit(max(n - 1, 0) // block_rows).cast("long"))).alias("block"),
    )
    negative = _first(_dealt(placed, asking, negatives, False), negatives)
    positive = known.select(
        F.col("at").alias("anchor"), F.col("id").alias("anchor_id"), F.posexplode("p").alias("slot", "p")
    )
    return positive.join(negative, ["anchor", "slot"]).select(
        "anchor_id",
        F.col("p.id").alias("positive_id"),
        "rank",
        F.col("id").alias("negative_id"),
        F.col("p.score").alias("positive_score"),
        F.col("score").alias("negative_score"),
    )
