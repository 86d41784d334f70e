"""Judged retrieval metrics: per query, overall, by book and by difficulty."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioforge.functions.prompts import judge_prompt, judged_relevant


def judge_prompts(golden: DataFrame, hits: DataFrame) -> DataFrame:
    """One prompt per golden entry and hit: ``(query_id, rank, ..., prompt)``."""
    return golden.join(hits, "query_id").withColumn(
        "prompt",
        judge_prompt(F.col("query"), F.col("expected_answer_summary"), F.col("content")),
    )


def decide(responses: DataFrame) -> DataFrame:
    return responses.withColumn("relevant", judged_relevant(F.col("response")))


def query_results(golden: DataFrame, judged: DataFrame) -> DataFrame:
    """One row per golden entry from its (at most k) judged hits.

    ``id`` is the golden entry's own, ``query_id`` its number.  ``rank`` and ``best_score`` belong to the first relevant hit; an entry without hits
    stays in with no judgments.
    """
    first = F.when(F.col("relevant"), F.col("rank"))
    ranked = F.array_sort(
        F.collect_list(F.struct("rank", "relevant", "book", "page", "score"))
    )
    per_query = judged.groupBy("query_id").agg(
        F.min(first).alias("rank"),
        F.min_by("score", first).alias("first_score"),
        ranked.alias("hits"),
    )
    no_bools = F.array().cast("array<boolean>")
    retrieved = F.transform(
        "hits",
        lambda h: F.struct(
            h["book"].alias("book"), h["page"].alias("page"), h["score"].alias("score")
        ),
    )
    named = F.col("id") if "id" in golden.columns else F.col("query_id")
    keys = golden.select(
        "query_id", named.cast("string").alias("id"), F.col("book").alias("golden_book"), "difficulty", "query"
    )
    return keys.join(per_query, "query_id", "left").select(
        "query_id",
        "id",
        F.col("golden_book").alias("book"),
        "difficulty",
        "query",
        F.col("rank").isNotNull().alias("hit"),
        "rank",
        F.when(F.col("rank").isNotNull(), F.col("first_score")).otherwise(0.0).alias("best_score"),
        F.coalesce(F.transform("hits", lambda h: h["relevant"]), no_bools).alias(
            "chunk_judgments"
        ),
        F.coalesce(
            retrieved, F.array().cast("array<struct<book:string,page:bigint,score:double>>")
        ).alias("retrieved"),
    )


def _metrics(k: int) -> list:
    n = F.count("*")
    judged = F.sum(F.size("chunk_judgments"))
    relevant = F.sum(F.size(F.filter("chunk_judgments", lambda j: j)))
    return [
        n.alias("n"),
        F.lit(k).alias("k"),
        (F.count_if(F.col("rank") == 1) / n).alias("recall_at_1"),
        (F.count_if("hit") / n).alias("recall_at_k"),
        (F.coalesce(F.sum(1.0 / F.col("rank")), F.lit(0.0)) / n).alias("mrr"),
        F.when(judged > 0, relevant / judged).otherwise(0.0).alias("precision_at_k"),
    ]


def summarize(results: DataFrame, k: int) -> DataFrame:
    """One row of metrics; no row for no queries."""
    return results.agg(*_metrics(k)).filter(F.col("n") > 0)


def breakdown(results: DataFrame, k: int) -> DataFrame:
    """Metrics overall, by book and by difficulty, from one aggregation.

    ``slice`` is ``overall``, ``book`` or ``difficulty`` and ``name`` the group.
    """
    grouped = results.groupingSets(
        [[], [F.col("book")], [F.col("difficulty")]], F.col("book"), F.col("difficulty")
    ).agg(F.grouping_id().alias("gid"), *_metrics(k))
    # grouping_id has a bit per key that is rolled up: 3 both, 1 difficulty, 2 book.
    return (
        grouped.filter(F.col("n") > 0)
        .withColumn(
            "slice",
            F.when(F.col("gid") == 3, "overall").when(F.col("gid") == 1, "book").otherwise(
                "difficulty"
            ),
        )
        .withColumn(
            "name",
            F.when(F.col("gid") == 1, F.col("book").cast("string"))
            .when(F.col("gid") == 2, F.col("difficulty").cast("string"))
            .otherwise(""),
        )
        .select("slice", "name", "n", "k", "recall_at_1", "recall_at_k", "mrr", "precision_at_k")
    )


def failures(results: DataFrame) -> DataFrame:
    """Queries without a relevant hit and what came first instead."""
    top = F.try_element_at("retrieved", F.lit(1))
    return results.filter(~F.col("hit")).select(
        "query_id",
        "id",
        "difficulty",
        F.coalesce(top["book"], F.lit("?")).alias("top_book"),
        F.coalesce(top["page"].cast("string"), F.lit("?")).alias("top_page"),
    )


def per_entry(results: DataFrame) -> DataFrame:
    """Printable columns of the per-query table."""
    return results.select(
        "query_id",
        "id",
        "difficulty",
        F.when(F.col("hit"), "yes").otherwise("no").alias("hit"),
        F.coalesce(F.col("rank").cast("string"), F.lit("-")).alias("rank"),
        F.when(F.col("hit"), F.format_string("%.3f", "best_score")).otherwise("-").alias("score"),
        F.substring("query", 1, 60).alias("query"),
    )


def record(results: DataFrame, k: int, config: dict[str, str]) -> DataFrame:
    """The evaluation record in one table: ``section`` is ``config``, ``overall``, ``book``,
    ``difficulty`` or ``query``, and ``name`` the parameter, group or golden id."""
    spark = results.sparkSession
    settings = spark.createDataFrame(
        [("config", n, str(v)) for n, v in config.items()], "section string, name string, value string"
    )
    metrics = breakdown(results, k).withColumnRenamed("slice", "section")
    queries = results.select(
        F.lit("query").alias("section"),
        F.col("id").alias("name"),
        "book",
        "difficulty",
        "query",
        "hit",
        "rank",
        "best_score",
        "chunk_judgments",
        F.col("retrieved").alias("top_retrieved"),
    )
    both = settings.unionByName(metrics, allowMissingColumns=True)
    return both.unionByName(queries, allowMissingColumns=True)


def write_summary(results: DataFrame, k: int, config: dict[str, str], path: str) -> None:
    """The record as one folder of JSON lines; columns a line has no use for are left out."""
    record(results, k, config).write.json(path)
