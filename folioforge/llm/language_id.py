"""Language identification with interpolated Kneser-Ney character models.

Runs of four characters are counted for each language over all training texts, in Spark.
From the counts come a model of order 4 for each language and, by the number of different
characters seen before a run, those of the lower orders.  Models are sorted arrays of run
hashes with their probabilities.  A text gets the language under which its characters cost
the fewest nats on average; how sure that is, and when a text is like no language, is
calibrated on a bounded sample of rows that the counts have not seen.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioforge.llm.rows import FOLDS, HELD_OUT, ROW, held_out, text_of, with_row_id
from folioforge.session import ship_package

ORDER = 4
#: Numbers in the table of all languages' probabilities; runs beyond it take longer, not less.
TABLE_CELLS = 20_000_000
#: Rows of the fold that calibrate, about, if it has more; by a hash of their places.
CALIBRATION_FOLD, CALIBRATION_ROWS = 1, 4_000
#: Characters whose runs are held at once.
SLICE = 1 << 18
UNKNOWN = "und"
SPACE = 32
_P = np.uint64(0x9E3779B97F4A7C15)


@lru_cache
def _letters() -> np.ndarray:
    """For every code point its lower-case letter, or 0 if it is no letter."""
    table = np.zeros(0x110000, np.uint32)
    for c in range(0x110000):
        x = chr(c)
        if x.isalpha():
            low = x.lower()
            table[c] = ord(low) if len(low) == 1 else c
    return table


def characters(text: str) -> np.ndarray:
    """Lower-case letters, one space for anything between them, and ``ORDER - 1`` spaces
    before; empty if there is no letter."""
    codes = _letters()[np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)]
    letter = codes != 0
    if not letter.any():
        return np.zeros(0, np.uint64)
    start = letter.copy()
    start[1:] |= letter[:-1]  # a letter, or the first of what follows one
    out = np.where(letter, codes, SPACE)[start].astype(np.uint64)
    return np.concatenate([np.full(ORDER - 1, SPACE, np.uint64), out])


def hashes(runs: np.ndarray) -> np.ndarray:
    """A hash for each row of characters."""
    h = np.zeros(len(runs), np.uint64)
    for column in runs.T:
        h = h * _P + column
    return h


def runs_of(codes: np.ndarray) -> np.ndarray:
    """The runs of ``ORDER`` characters, one for each character after the first spaces."""
    return np.lib.stride_tricks.sliding_window_view(codes, ORDER)


def slices(codes: np.ndarray) -> Iterator[np.ndarray]:
    """Parts of the characters that together have the same runs, of bounded length."""
    for i in range(0, max(len(codes) - ORDER + 1, 0), SLICE):
        yield codes[i : i + SLICE + ORDER - 1]


def count_runs(texts: DataFrame) -> DataFrame:
    """``(lang, run, n)`` for ``(lang, text)``: summed in each task, then over all."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for lang, own in batch.groupby("lang"):
                waiting, size = [], 0
                for part in (p for t in own["text"] for p in slices(characters(t))):
                    waiting.append(runs_of(part))
                    size += len(part)
                    if size >= SLICE:
                        yield counted(lang, waiting)
                        waiting, size = [], 0
                if waiting:
                    yield counted(lang, waiting)

    def counted(lang: str, parts: list[np.ndarray]) -> pd.DataFrame:
        runs = np.concatenate(parts)
        _, at, n = np.unique(hashes(runs), return_index=True, return_counts=True)
        text = runs[at].astype("<u4").tobytes().decode("utf-32-le", "surrogatepass")
        cut = [text[i : i + ORDER] for i in range(0, len(text), ORDER)]
        return pd.DataFrame({"lang": lang, "run": cut, "n": n})

    runs = texts.select("lang", "text").mapInPandas(count, "lang string, run string, n long")
    return runs.groupBy("lang", "run").agg(F.sum("n").alias("n"))


@dataclass
class SortedHashes:
    """Values by hash, in sorted arrays."""

    keys: np.ndarray
    values: np.ndarray

    @classmethod
    def of(cls, keys: np.ndarray, values: np.ndarray) -> SortedHashes:
        order = np.argsort(keys)
        return cls(keys[order], values[order])

    def places(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where each key is, and whether it is there."""
        if not len(self.keys):
            return np.zeros(len(keys), np.int64), np.zeros(len(keys), bool)
        at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        return at, self.keys[at] == keys

    def get(self, keys: np.ndarray, missing: float) -> np.ndarray:
        at, there = self.places(keys)
        return np.where(there, self.values[at], missing) if len(self.keys) else np.full(len(keys), missing)


class KneserNey:
    """The interpolated model of one language, from runs ``[n, ORDER]`` and their counts.

    ``own[k]``: the discounted probability of a run of k characters, by the run's hash.
    ``rest[k]``: what its first k - 1 characters leave to the next lower order.
    """

    def __init__(self, runs: np.ndarray, counts: np.ndarray, alphabet: int):
        self.own: dict[int, SortedHashes] = {}
        self.rest: dict[int, SortedHashes] = {}
        self.floor = 1.0 / alphabet
        counts = counts.astype(float)
        for k in range(ORDER, 0, -1):
            # Smoothed by the share of runs seen once, as usual; small corpora may lack them.
            once, twice = (counts == 1).sum(), (counts == 2).sum()
            cut = min(max(once / (once + 2 * twice), 0.1), 0.9) if once + twice else 0.5
            contexts, group = np.unique(hashes(runs[:, :-1]), return_inverse=True)
            total = np.bincount(group, counts)
            kinds = np.bincount(group)
            self.own[k] = SortedHashes.of(hashes(runs), np.maximum(counts - cut, 0) / total[group])
            self.rest[k] = SortedHashes.of(contexts, cut * kinds / total)
            # The next order counts how many characters come before each shorter run.
            _, at, counts = np.unique(hashes(runs[:, 1:]), return_index=True, return_counts=True)
            runs, counts = runs[at][:, 1:], counts.astype(float)

    def probability(self, runs: np.ndarray) -> np.ndarray:
        """Of the last character of each run, given those before it."""
        p = np.full(len(runs), self.floor)
        for k in range(1, ORDER + 1):
            part = runs[:, ORDER - k :]
            p = self.own[k].get(hashes(part), 0.0) + self.rest[k].get(hashes(part[:, :-1]), 1.0) * p
        return p


@dataclass
class Identifier:
    """``table``: log probabilities ``[run, language]`` of the most frequent runs, by hash.
    Runs beyond it go through the models themselves."""

    languages: list[str]
    models: list[KneserNey]
    table: SortedHashes
    slope: float = 1.0
    limits: np.ndarray | None = None

    def costs(self, codes: np.ndarray) -> np.ndarray:
        """Nats per character under each language."""
        total, n = np.zeros(len(self.models)), 0
        for runs in map(runs_of, slices(codes)):
            at, there = self.table.places(hashes(runs))
            total += self.table.values[at[there]].sum(0, dtype=float)
            n += len(runs)
            if not there.all():
                other = runs[~there]
                total += [np.log(m.probability(other)).sum() for m in self.models]
        return -total / n

    def judge(self, text: str) -> tuple[str, float, bool]:
        """Language, confidence and whether the text is like none of the languages."""
        codes = characters(text)
        if not len(codes) or not self.languages:
            return UNKNOWN, 0.0, True
        costs = self.costs(codes)
        best = int(costs.argmin())
        # Average costs are closer to their mean in longer texts.
        weight = self.slope * np.sqrt(len(codes))
        sure = 1 / np.exp(-weight * (costs - costs[best])).sum()
        beyond = self.limits is not None and costs[best] > self.limits[best]
        return self.languages[best], float(sure), bool(beyond)


def build(counts: pd.DataFrame) -> Identifier:
    """From ``(lang, run, n)``, languages in the order of their names."""
    languages, runs, numbers = sorted(counts["lang"].unique()), [], []
    for lang in languages:
        own = counts[counts["lang"] == lang].sort_values("run")
        codes = np.frombuffer("".join(own["run"]).encode("utf-32-le", "surrogatepass"), np.uint32)
        runs.append(codes.reshape(-1, ORDER).astype(np.uint64))
        numbers.append(own["n"].to_numpy())
    if not languages:
        return Identifier([], [], SortedHashes(np.zeros(0, np.uint64), np.zeros((0, 0))))
    everything = np.concatenate(runs)
    alphabet = len(np.unique(everything)) + 1
    models = [KneserNey(r, n, alphabet) for r, n in zip(runs, numbers, strict=True)]
    keys, at, own = np.unique(hashes(everything), return_index=True, return_inverse=True)
    size = max(TABLE_CELLS // len(languages), 1)
    if len(keys) > size:
        often = np.sort(np.argpartition(-np.bincount(own, np.concatenate(numbers)), size - 1)[:size])
        keys, at = keys[often], at[often]
    logs = np.stack([np.log(m.probability(everything[at])) for m in models], 1)
    return Identifier(languages, models, SortedHashes(keys, logs.astype(np.float32)))


def costs_of(identifier: Identifier, sample: DataFrame) -> pd.DataFrame:
    """``(lang, n, costs)`` of the texts of ``(lang, text)`` that have letters: the characters
    of each and its nats per character under each language, found in the tasks."""
    shared = sample.sparkSession.sparkContext.broadcast(identifier)

    def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            coded = [(lang, characters(t)) for lang, t in zip(batch["lang"], batch["text"], strict=True)]
            out = [(lang, len(c), shared.value.costs(c).tolist()) for lang, c in coded if len(c)]
            yield pd.DataFrame(out, columns=["lang", "n", "costs"])

    return sample.select("lang", "text").mapInPandas(score, "lang string, n long, costs array<double>").toPandas()


def calibrate(identifier: Identifier, scored: pd.DataFrame) -> Identifier:
    """Fit the slope of the confidence, and each language's limit, on ``(lang, n, costs)``."""
    places = {lang: i for i, lang in enumerate(identifier.languages)}
    scored = scored[scored["lang"].isin(places)]
    if not len(scored):
        return identifier
    costs, n = np.stack(scored["costs"].map(np.asarray).to_list()), scored["n"].to_numpy()
    lang = scored["lang"].map(places).to_numpy()
    spread = (costs - costs.min(1, keepdims=True)) * np.sqrt(n)[:, None]

    def loss(slope: float) -> float:
        z = -slope * spread
        own = z[np.arange(len(z)), lang] - np.log(np.exp(z).sum(1))
        return -own.mean() + 1e-4 * slope

    identifier.slope = float(min(np.geomspace(0.05, 20, 40), key=loss))
    limits = [costs[lang == i, i] for i in range(len(identifier.languages))]
    identifier.limits = np.array([c.mean() + 4 * max(c.std(), 0.05) if len(c) else np.inf for c in limits])
    return identifier


def fit(docs: DataFrame, calibration_rows: int = CALIBRATION_ROWS) -> Identifier:
    """Learn from all documents with a language outside the held-out fold.

    About ``calibration_rows`` of one fold calibrate and are not counted; all others are, and
    all documents of a language that would have none to count.
    """
    ship_package(docs.sparkSession)
    fold = F.crc32(F.col("doc_id").cast("string").cast("binary")) % FOLDS
    known = docs.select("doc_id", "lang", text_of(docs).alias("text"), F.coalesce(fold, F.lit(-1)).alias("fold"))
    known = with_row_id(known).filter(F.col("lang").isNotNull() & (F.col("fold") != HELD_OUT))
    in_fold = F.col("fold") == CALIBRATION_FOLD
    n = known.filter(in_fold).count()
    bound = int((1 << 30) * min(calibration_rows / max(n, 1), 1))
    drawn = in_fold & (F.pmod(F.xxhash64(ROW), F.lit(1 << 30)) < bound)
    rest = F.max(~drawn & F.col("text").rlike("\\p{L}"))
    alone = [r["lang"] for r in known.groupBy("lang").agg(rest.alias("rest")).filter("NOT rest").collect()]
    drawn = drawn & ~F.col("lang").isin(alone)
    identifier = build(count_runs(known.filter(~drawn)).toPandas())
    return calibrate(identifier, costs_of(identifier, known.filter(drawn)))


def identify(docs: DataFrame, identifier: Identifier) -> DataFrame:
    """``(doc_id, held_out, lang_pred, score, rejected)`` of every document.

    ``lang_pred`` is ``und`` with score 0 where there is no letter.  ``rejected``: the text
    costs more than those of its language do; it still gets the nearest language.
    """
    ship_package(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(identifier)

    def judge(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            judged = [shared.value.judge(t) for t in batch["text"]]
            lang, score, rejected = zip(*judged, strict=True) if judged else ((), (), ())
            yield pd.DataFrame(
                {
                    "doc_id": batch["doc_id"],
                    "held_out": batch["held_out"],
                    "lang_pred": list(lang),
                    "score": list(score),
                    "rejected": list(rejected),
                }
            )

    rows = docs.select(
        F.col("doc_id").cast("string").alias("doc_id"),
        held_out(F.col("doc_id")).alias("held_out"),
        text_of(docs).alias("text"),
    )
    schema = "doc_id string, held_out boolean, lang_pred string, score double, rejected boolean"
    return rows.mapInPandas(judge, schema).withColumn("doc_id", F.col("doc_id").cast("long"))
