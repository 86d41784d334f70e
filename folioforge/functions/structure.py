"""Structure of a text: section offsets, size and math statistics, identifiers."""

from __future__ import annotations

from functools import reduce
from operator import add

from pyspark.sql import Column
from pyspark.sql import functions as F

from folioforge.functions import fixed_values as fv
from folioforge.functions.charclass import S, WORD, WS, let, strip, word_count, words


def _section_offsets(text: Column) -> Column:
    """Start offsets of lines that look like section openers."""
    ints = "array<int>"
    return F.aggregate(
        F.split(text, "\n", -1),
        F.struct(F.lit(0).alias("pos"), F.array().cast(ints).alias("out")),
        lambda acc, line: F.struct(
            (acc["pos"] + F.length(line) + 1).alias("pos"),
            F.when(
                strip(line).rlike(fv.SECTION_LINE),
                F.concat(acc["out"], F.array(acc["pos"])),
            )
            .otherwise(acc["out"])
            .alias("out"),
        ),
        lambda acc: acc["out"],
    )


def _word_marks(text: Column) -> Column:
    """One offset per full stride of words, counting each word plus one blank."""
    n = fv.WORDS_PER_MARK

    def marks(w: Column) -> Column:
        strides = F.transform(
            F.sequence(F.lit(0), F.floor((F.size(w) - 1) / n).cast("int") - 1),
            lambda i: F.length(F.array_join(F.slice(w, i * n + 1, F.lit(n)), " ")) + 1,
        )
        total = F.aggregate(
            strides,
            F.array().cast("array<int>"),
            lambda acc, d: F.concat(
                acc, F.array(F.coalesce(F.try_element_at(acc, F.lit(-1)), F.lit(0)) + d)
            ),
        )
        return F.when(F.size(w) > n, total).otherwise(F.array().cast("array<int>"))

    return let(words(text), marks)


def detect_section_boundaries(text: Column) -> Column:
    """Sorted distinct character offsets of section openers and word-stride marks."""
    return F.array_sort(F.array_distinct(F.concat(_section_offsets(text), _word_marks(text))))


def chunking_stats(text: Column) -> Column:
    """Struct of word and character counts, math density and equation count."""
    n_words = word_count(text)
    n_chars = F.length(text)
    math_chars = F.regexp_count(text, F.lit(fv.MATH_CHARACTER))
    equations = reduce(
        add, [F.regexp_count(text, F.lit(p)) for p in fv.COUNTED_EQUATION_PATTERNS]
    )
    letters = F.length(F.regexp_replace(text, f"{S}+", ""))
    return F.struct(
        n_words.alias("word_count"),
        n_chars.alias("char_count"),
        F.when(n_chars > 0, math_chars / n_chars).otherwise(0.0).alias("math_density"),
        equations.alias("equation_count"),
        F.when(n_words > 0, letters / n_words).otherwise(0.0).alias("avg_word_length"),
        ((equations > 0) | (math_chars > 0)).alias("has_math"),
    )


def sanitize_title(title: Column) -> Column:
    """Title as a folder name: word characters, blanks and hyphens; blanks become ``_``."""
    kept = F.regexp_replace(title, rf"[^{WORD}{WS}\-]", "")
    return F.replace(strip(kept), F.lit(" "), F.lit("_"))


def document_id(file: Column, page0: Column) -> Column:
    return F.substring(F.md5(F.concat_ws("_", file, page0.cast("string"))), 1, 12)


def chunk_id(doc_id: Column, chunk_index: Column) -> Column:
    return F.substring(F.md5(F.concat_ws("_", doc_id, chunk_index.cast("string"))), 1, 12)


def embedding_cache_key(chunk: Column) -> Column:
    return F.md5(chunk)


def judge_cache_key(prompt: Column) -> Column:
    return F.substring(F.sha2(prompt, 256), 1, 24)


def starts_clean(content: Column) -> Column:
    return content.rlike(fv.CLEAN_START)


def ends_clean(content: Column) -> Column:
    return content.rlike(fv.CLEAN_END)


def preview(content: Column, n: int) -> Column:
    """First ``n`` characters on one line."""
    return F.replace(F.substring(content, 1, n), F.lit("\n"), F.lit(" "))


def cut_preview(content: Column, n: int) -> Column:
    """Whole content on one line, cut at ``n`` with an ellipsis."""
    line = strip(F.replace(content, F.lit("\n"), F.lit(" ")))
    return F.when(F.length(line) > n, F.concat(F.substring(line, 1, n), F.lit("..."))).otherwise(
        line
    )
