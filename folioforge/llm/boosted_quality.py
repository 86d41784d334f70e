"""Quality classifier: histogram gradient-boosted trees over document statistics.

Statistics are computed where the texts are, in Arrow batches.  Trees are fitted on a bounded
sample of labelled rows, level by level from histograms of binned statistics, and flattened
into arrays, so that a batch walks all nodes of a level in a few numpy calls.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioforge.llm.rows import bounded_sample, held_out, text_of
from folioforge.session import ship_package

#: About so many labelled documents are fitted on if there are more, chosen by a hash of their
#: ids.  Scores are given to all documents.
SAMPLE = 40_000

FEATURES = (
    "words", "word_length", "upper", "lower", "digit", "space", "line_end", "sentence_marks",
    "exclamation", "symbols", "other_marks", "beyond_ascii", "different_words", "next_same",
    "most_frequent", "lines", "line_length", "repeated_lines", "capital_words", "short_words",
)


def _byte_classes() -> np.ndarray:
    """For each of the classes in their order, which bytes belong to it."""
    classes = [
        range(65, 91), range(97, 123), range(48, 58), b" \t\r\x0b\x0c", b"\n", b".,;:?", b"!",
        b"#*$%&|<>@^~=+_\\/{}[]", b"\"'()-`", range(128, 256),
    ]
    table = np.zeros((len(classes), 256))
    for row, members in enumerate(classes):
        table[row, list(members)] = 1
    return table


_CLASSES = _byte_classes()


def statistics(text: str) -> list[float]:
    """The ``FEATURES`` of one text; all are 0 if it is empty."""
    data = text.encode("utf-8", "surrogatepass")
    if not data:
        return [0.0] * len(FEATURES)
    shares = _CLASSES @ np.bincount(np.frombuffer(data, np.uint8), minlength=256) / len(data)
    words, lines = data.split(), [x for x in data.split(b"\n") if x.strip()]
    n, n_lines = max(len(words), 1), max(len(lines), 1)
    counts = Counter(words)
    same = sum(a == b for a, b in zip(words, words[1:], strict=False))
    return [
        np.log1p(len(words)),
        sum(map(len, words)) / n,
        *shares,
        len(counts) / n,
        same / n,
        max(counts.values(), default=0) / n,
        np.log1p(len(lines)),
        np.log1p(len(data) / n_lines),
        1 - len(set(lines)) / n_lines,
        sum(w[:1].isupper() for w in words) / n,
        sum(len(w) <= 3 for w in words) / n,
    ]


@dataclass
class Trees:
    """Complete binary trees of one depth as arrays ``[tree, node]``; a node's children are at
    ``2 * node + 1`` and ``2 * node + 2``, and a value above the threshold goes to the second."""

    feature: np.ndarray
    threshold: np.ndarray
    leaf: np.ndarray
    base: float

    def scores(self, x: np.ndarray) -> np.ndarray:
        """Probabilities of label 1, for rows of statistics."""
        total, rows = np.full(len(x), self.base), np.arange(len(x))
        inner = self.feature.shape[1]
        for feature, threshold, leaf in zip(self.feature, self.threshold, self.leaf, strict=True):
            node = np.zeros(len(x), np.int64)
            while len(node) and node[0] < inner:  # all rows are on one level
                node = 2 * node + 1 + (x[rows, feature[node]] > threshold[node])
            total += leaf[node - inner]
        return 1 / (1 + np.exp(-total))


def fit(
    x: np.ndarray, y: np.ndarray, trees: int = 40, depth: int = 4, rate: float = 0.2,
    bins: int = 64, smooth: float = 1.0, least: float = 1.0,
) -> Trees:
    """Boost ``trees`` trees on the logistic loss.  Without rows, every score is 0.5.

    ``bins``: quantile bins of each statistic.  ``smooth`` is added to the curvature of each
    leaf; a split leaves a curvature of ``least`` on either side.
    """
    inner, leaves = 2**depth - 1, 2**depth
    rate_of_ones = (y.sum() + 1) / (len(y) + 2)
    base = float(np.log(rate_of_ones / (1 - rate_of_ones)))
    model = Trees(
        np.zeros((0, inner), np.int64), np.zeros((0, inner)), np.zeros((0, leaves)), base
    )
    if not len(x):
        return model
    cuts = [np.unique(np.quantile(c, np.linspace(0, 1, bins + 1)[1:-1], method="lower")) for c in x.T]
    # A row's bin is the number of cuts below its value, so "bin > b" says "value > cuts[b]".
    codes = np.stack([np.searchsorted(c, v, "left") for c, v in zip(cuts, x.T, strict=True)], 1)
    d, total = x.shape[1], np.full(len(x), base)
    features, thresholds, values = [], [], []
    for _ in range(trees):
        p = 1 / (1 + np.exp(-total))
        grad, curve = y - p, p * (1 - p)
        feature, threshold = np.zeros(inner, np.int64), np.full(inner, np.inf)
        node = np.zeros(len(x), np.int64)
        for level in range(depth):
            width, first = 2**level, 2**level - 1
            slot = ((node - first)[:, None] * d + np.arange(d)) * bins + codes
            g, h = (
                np.bincount(slot.ravel(), np.repeat(v, d), width * d * bins).reshape(width, d, bins)
                for v in (grad, curve)
            )
            gl, hl = g.cumsum(2), h.cumsum(2)
            ga, ha = gl[:, :, -1:], hl[:, :, -1:]
            gain = gl**2 / (hl + smooth) + (ga - gl) ** 2 / (ha - hl + smooth) - ga**2 / (ha + smooth)
            gain = np.where((hl >= least) & (ha - hl >= least), gain, 0).reshape(width, -1)
            best = gain.argmax(1)
            for w in np.flatnonzero(gain[np.arange(width), best] > 1e-9):
                f, b = divmod(int(best[w]), bins)
                if b < len(cuts[f]):
                    feature[first + w], threshold[first + w] = f, cuts[f][b]
            node = 2 * node + 1 + (x[np.arange(len(x)), feature[node]] > threshold[node])
        leaf_g = np.bincount(node - inner, grad, leaves)
        leaf = rate * leaf_g / (np.bincount(node - inner, curve, leaves) + smooth)
        total = total + leaf[node - inner]
        features.append(feature), thresholds.append(threshold), values.append(leaf)
    return Trees(np.array(features), np.array(thresholds), np.array(values), base)


def training_sample(docs: DataFrame, labels: DataFrame, bound: int = SAMPLE) -> DataFrame:
    """``(quality, statistics)`` of the sample; no row of the held-out fold is in it.

    ``labels`` may repeat ids: the larger label counts.  Null ids and labels don't.
    """
    usable = labels.filter(
        F.col("doc_id").isNotNull() & F.col("quality").isNotNull() & ~held_out(F.col("doc_id"))
    )
    labelled = usable.groupBy("doc_id").agg(F.max("quality").cast("double").alias("quality"))
    # About ``bound`` rows of two numbers: safe to broadcast.
    chosen = bounded_sample(labelled, bound, "doc_id")
    texts = docs.select("doc_id", text_of(docs).alias("text")).join(F.broadcast(chosen), "doc_id")

    def measure(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame(
                {"quality": batch["quality"], "statistics": [statistics(t) for t in batch["text"]]}
            )

    return texts.select("quality", "text").mapInPandas(measure, "quality double, statistics array<double>")


def fit_quality(docs: DataFrame, labels: DataFrame, bound: int = SAMPLE) -> Trees:
    """Fit on a sample of about ``bound`` labels."""
    ship_package(docs.sparkSession)
    # Several documents may share an id, so the sample's rows are bounded once more.
    sample = training_sample(docs, labels, bound).limit(2 * bound).toPandas()
    sample = sample.iloc[np.lexsort(np.array([*sample["statistics"]]).reshape(len(sample), -1).T)] if len(sample) else sample
    x = np.array([*sample["statistics"]]).reshape(-1, len(FEATURES))
    return fit(x, sample["quality"].to_numpy(float))


def score(docs: DataFrame, model: Trees, least: float = 0.3) -> DataFrame:
    """``(doc_id, held_out, score, predicted)`` of every document; null texts are empty ones."""
    ship_package(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def walk(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            x = np.array([statistics(t) for t in batch["text"]]).reshape(-1, len(FEATURES))
            batch["score"] = shared.value.scores(x)
            yield batch[["doc_id", "held_out", "score"]]

    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), held_out(F.col("doc_id")).alias("held_out"), text_of(docs).alias("text")
    )
    # Ids stay integers where some are null: Arrow-backed columns keep them apart from floats.
    ids = rows.withColumn("doc_id", F.col("doc_id").cast("string"))
    scored = ids.mapInPandas(walk, "doc_id string, held_out boolean, score double")
    return scored.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        "held_out",
        "score",
        (F.col("score") >= least).cast("int").alias("predicted"),
    )
