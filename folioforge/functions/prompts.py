"""Prompts, citations and judge decisions as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from folioforge.functions import fixed_values as fv
from folioforge.functions.charclass import strip


def context_block(chunks: Column) -> Column:
    """Ranked chunk structs ``<book, page, section, content>`` as numbered passages."""

    def passage(c: Column, i: Column) -> Column:
        section = F.coalesce(c["section"], F.lit(""))
        return F.concat(
            F.lit("["),
            (i + 1).cast("string"),
            F.lit("] "),
            F.coalesce(c["book"], F.lit("Unknown")),
            F.lit(", page "),
            F.coalesce(c["page"].cast("string"), F.lit("?")),
            F.when(section != "", F.concat(F.lit(", "), section)).otherwise(""),
            F.lit("\n"),
            strip(F.coalesce(c["content"], F.lit(""))),
        )

    return F.array_join(F.transform(chunks, passage), fv.CONTEXT_SEPARATOR)


def user_prompt(query: Column, chunks: Column) -> Column:
    before, between, after = fv.USER_PROMPT_PARTS
    return F.concat(F.lit(before), context_block(chunks), F.lit(between), query, F.lit(after))


def citations(chunks: Column) -> Column:
    return F.transform(
        chunks,
        lambda c, i: F.struct(
            (i + 1).alias("index"),
            F.coalesce(c["book"], F.lit("")).alias("book"),
            F.coalesce(c["page"].cast("int"), F.lit(0)).alias("page"),
            F.coalesce(c["section"], F.lit("")).alias("section"),
        ),
    )


def judge_prompt(query: Column, expected: Column, chunk: Column) -> Column:
    intro, reference, retrieved, closing = fv.JUDGE_PROMPT_PARTS
    return F.concat(
        F.lit(intro),
        query,
        F.lit(reference),
        expected,
        F.lit(retrieved),
        F.substring(chunk, 1, fv.JUDGE_CHUNK_CHARS),
        F.lit(closing),
    )


def judged_relevant(response: Column) -> Column:
    return F.upper(strip(response)).startswith("YES")
