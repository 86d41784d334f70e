"""Quality rules: a table of thresholds, compiled into one projection.

A rule bounds a ratio of two counts.  Counts and rules are column expressions, so a text is
read, counted and judged in one pass that neither shuffles nor leaves the JVM.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioforge.llm.rows import WORD, text_of

SPACE = " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"

#: Frequent words of English, German, French and Spanish.
STOP_WORDS = (
    "the of and to in is that it was for on with as at by from be this not are or an "
    "der die und das ist von zu den mit dem des ein eine im auf für nicht sich als auch "
    "le la les et de du est un une dans que pour pas sur au qui en "
    "el los las y del con por no su lo se es"
).split()


@dataclass(frozen=True)
class Bound:
    """``low <= 1000 * part / whole <= high``; a null bound does not bind.

    A whole of zero meets a lower bound only if that is zero, and every upper bound.
    """

    name: str
    part: str
    whole: str
    low: int | None = None
    high: int | None = None

    def holds(self) -> Column:
        part, whole = F.col(self.part) * 1000, F.col(self.whole)
        tests = [part >= whole * self.low] if self.low is not None else []
        tests += [part <= whole * self.high] if self.high is not None else []
        return reduce(lambda a, b: a & b, tests)


#: In thousandths.
RULES = (
    Bound("word length", "word_chars", "n_words", 2_000, 15_000),
    Bound("words", "n_words", "one", 50_000, 1_000_000_000),
    Bound("symbols to words", "n_symbols", "n_words", high=100),
    Bound("stop words", "n_stop_words", "n_words", low=20),
    Bound("repeated lines", "n_dup_lines", "n_lines", high=500),
    Bound("repeated words", "n_repeat_words", "n_words", high=500),
)


def measured(docs: DataFrame, *keep: str) -> DataFrame:
    """The columns ``keep`` and the counts of every text; null texts have no words."""
    t = F.col("_text")
    stop = sorted({f for w in STOP_WORDS for f in (w, w[0].upper() + w[1:])})
    words = docs.select(*keep, text_of(docs).alias("_text")).select(
        *keep, "_text", F.regexp_extract_all("_text", F.lit(WORD), 0).alias("_words")
    )
    n = F.size("_words")
    lines = F.filter(F.split(t, "\n"), lambda x: F.translate(x, SPACE, "") != "")
    windows = F.transform(
        F.sequence(F.lit(0), n - 3),
        lambda i: F.xxhash64(F.get("_words", i), F.get("_words", i + 1), F.get("_words", i + 2)),
    )
    counted = words.select(
        *keep,
        n.cast("long").alias("n_words"),
        F.length(F.translate(t, SPACE, "")).cast("long").alias("word_chars"),
        (F.length(t) - F.length(F.translate(t, SYMBOLS, ""))).cast("long").alias("n_symbols"),
        F.size(F.filter("_words", lambda w: w.isin(*stop))).cast("long").alias("n_stop_words"),
        lines.alias("_lines"),
        F.when(n >= 3, windows).otherwise(F.expr("array()").cast("array<bigint>")).alias("_windows"),
    )
    # Only texts in which a window is repeated get their windows sorted.
    repeats = F.size(F.array_distinct("_windows")) < F.size("_windows")
    marked = F.transform("_windows", lambda h, i: F.struct(h.alias("h"), i.alias("i")))
    nothing = F.expr("array()").cast("array<struct<h:bigint,i:int>>")
    ordered = counted.withColumn("_sorted", F.when(repeats, F.sort_array(marked)).otherwise(nothing))

    def repeated(x: Column, k: Column) -> Column:
        after = F.get("_sorted", k + 1)["h"] == x["h"]
        before = F.get("_sorted", k - 1)["h"] == x["h"]
        return F.coalesce(after, F.lit(False)) | F.coalesce(before, F.lit(False))

    found = ordered.withColumn(
        "_starts", F.sort_array(F.transform(F.filter("_sorted", repeated), lambda x: x["i"]))
    )
    covered = F.aggregate(
        F.transform(
            "_starts", lambda p, k: F.least(F.lit(3), F.coalesce(F.get("_starts", k + 1) - p, F.lit(3)))
        ),
        F.lit(0).cast("long"),
        lambda total, x: total + x,
    )
    return found.select(
        *keep,
        "n_words",
        "word_chars",
        "n_symbols",
        F.size("_lines").cast("long").alias("n_lines"),
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"),
        covered.alias("n_repeat_words"),
        "n_stop_words",
    )


def judged(docs: DataFrame, *keep: str, rules: tuple[Bound, ...] = RULES) -> DataFrame:
    """The columns ``keep``, the counts, ``base_failed`` and ``kept`` of every document.

    ``base_failed``: under 50 words, or over half of the words in 3-word windows that the
    text repeats.  ``kept``: the base and all rules hold.
    """
    base = (F.col("n_words") < 50) | (F.col("n_repeat_words") * 100 > F.col("n_words") * 50)
    counts = measured(docs, *keep).withColumn("one", F.lit(1)).withColumn("base_failed", base)
    holds = reduce(lambda a, b: a & b, [r.holds() for r in rules], ~F.col("base_failed"))
    return counts.withColumn("kept", holds).drop("one")


def keep_good(docs: DataFrame, rules: tuple[Bound, ...] = RULES) -> DataFrame:
    """The documents that are kept, with all their columns."""
    whole = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("_doc"), docs["text"])
    verdicts = judged(whole, "_doc", rules=rules)
    # A filter would be pushed below the counts, and each of its terms would count again.
    stays = verdicts.select(F.explode_outer(F.when(F.col("kept"), F.array("_doc"))).alias("_kept"))
    return stays.filter(F.col("_kept").isNotNull()).select("_kept.*")
