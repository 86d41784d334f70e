"""Answers with citations from retrieved chunks."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioforge.functions import fixed_values as fv
from folioforge.functions.charclass import is_blank
from folioforge.functions.prompts import citations, user_prompt
from folioforge.operators.model_calls import Client, call_model
from folioforge.operators.ranks import number_rows

_CHUNK = "struct<rank:int,score:double,row:bigint,chunk_id:string,book:string,page:bigint,section:string,content:string>"


def with_chunks(queries: DataFrame, hits: DataFrame) -> DataFrame:
    """Queries with their hits (at most k) as one ranked array, empty without hits."""
    fields = ["rank", "score", "row", "chunk_id", "book", "page", "section", "content"]
    ranked = hits.groupBy("query_id").agg(
        F.array_sort(F.collect_list(F.struct(*fields).cast(_CHUNK))).alias("chunks")
    )
    empty = F.array().cast(f"array<{_CHUNK}>")
    chunks = F.when(is_blank(F.col("query")), empty).otherwise(F.coalesce("chunks", empty))
    return queries.join(ranked, "query_id", "left").withColumn("chunks", chunks)


def prompts(queries: DataFrame) -> DataFrame:
    return queries.withColumn("prompt", user_prompt(F.col("query"), F.col("chunks")))


def settle(queries: DataFrame) -> DataFrame:
    """Answer and citations from ``reply`` or ``error`` of the model call.

    No query text: no answer.  No chunks: the fixed refusal.  A failed call: the failure,
    with the chunks kept and no citations.
    """
    none = F.array().cast("array<struct<index:int,book:string,page:int,section:string>>")
    failed = F.concat(F.lit("[generation failed: "), F.col("error"), F.lit("]"))
    answered = F.col("error").isNull() & (F.size("chunks") > 0)
    return queries.select(
        "query_id",
        "query",
        F.when(is_blank(F.col("query")), "")
        .when(F.size("chunks") == 0, fv.NO_ANSWER)
        .when(F.col("error").isNotNull(), failed)
        .otherwise(F.col("reply"))
        .alias("answer"),
        F.when(answered, citations(F.col("chunks"))).otherwise(none).alias("citations"),
        "chunks",
    )


def answer(
    queries: DataFrame, hits: DataFrame, connect: Callable[[], Client], retry: dict | None = None
) -> DataFrame:
    """Generated answers for ``(query_id, query)``; only queries with chunks are asked."""
    asked = prompts(with_chunks(queries, hits)).withColumn(
        "prompt", F.when(F.size("chunks") > 0, F.col("prompt"))
    )
    replied = call_model(asked, "prompt", connect, system=fv.SYSTEM_PROMPT, retry=retry)
    return settle(replied)


# --- chat history -----------------------------------------------------------------


def append_messages(messages: DataFrame, path: str) -> None:
    """Add messages as files that hold a range of conversations each, turns in their order."""
    ranges = messages.repartitionByRange("conv_id").sortWithinPartitions("conv_id", "turn")
    ranges.write.mode("append").parquet(path)


def clear_history(history: DataFrame, path: str) -> None:
    history.limit(0).write.mode("overwrite").parquet(path)


def compact_history(history: DataFrame, path: str) -> None:
    """All conversations as files of disjoint ranges with the place of each message.

    ``place`` counts messages in display order from 0.  After this, any stretch of the
    history is a filter on ``place`` that reads the files it lies in, and no reader sorts.
    """
    number_rows(history, ["conv_id", "turn"], "place").write.parquet(path)


def transcript(history: DataFrame, conv_id: int | None = None) -> DataFrame:
    """Messages of one conversation in display order, or all with the ``place`` of each.

    One conversation is read from the row groups whose range it is in, and only its turns are
    sorted.  All of them are given by place, for any number of readers to take stretches of.
    """
    if conv_id is not None:
        return history.filter(F.col("conv_id") == conv_id).orderBy("turn")
    return history if "place" in history.columns else number_rows(history, ["conv_id", "turn"], "place")


def stretch(history: DataFrame, start: int, end: int) -> DataFrame:
    """Messages from place ``start`` to before ``end`` of a compacted history, in order."""
    return history.filter((F.col("place") >= start) & (F.col("place") < end)).orderBy("place")
