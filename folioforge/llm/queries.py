"""The operators of this subpackage as queries over whole tables."""

from __future__ import annotations

from collections.abc import Callable

import corpus_pipeline
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioforge.llm import (
    block_naming,
    boosted_quality,
    hard_negatives,
    language_id,
    license_scan,
    merkle_manifest,
    mixing,
    packing,
    quality_rules,
    secret_scan,
    simhash,
    suffix_dedup,
    url_reputation,
)
from folioforge.llm.rows import ROW
from folioforge.llm.sql import OP1, OP2, OP6, OP7, OP9, OP11, OP12

Query = Callable[[SparkSession, str], DataFrame]

URL_RULES = [
    url_reputation.Rule("block", "net", "/"),
    url_reputation.Rule("allow", "example.net", "/en/"),
    url_reputation.Rule("block", "example.com", "/de/"),
    url_reputation.Rule("allow", "org", "/fr/"),
]


def _load(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def _op1(spark, sf_dir):
    """The last part of a page's path names the document that its labels are about."""
    pages, labels = _load(spark, sf_dir, "pages"), _load(spark, sf_dir, "labels")
    bad = labels.groupBy("doc_id").agg(
        F.max((F.col("quality") == 0) | (F.col("toxic") == 1)).alias("bad")
    )
    named = url_reputation.with_host_and_path(pages.select("page_id", "url")).select(
        "host", F.regexp_extract("path", r"/([0-9]{1,18})(?:\.html)?/?$", 1).alias("number")
    )
    seen = named.filter("number != ''").withColumn("doc_id", F.col("number").cast("long"))
    outcomes = seen.join(bad, "doc_id").select("host", "bad")
    return url_reputation.judge_urls(pages, outcomes, URL_RULES).select(
        "page_id", "host", "path", "rule", "verdict"
    )


def _op2(spark, sf_dir):
    found = block_naming.exact_duplicates(_load(spark, sf_dir, "documents"))
    return found.select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


def _op3(spark, sf_dir):
    return simhash.linked(_load(spark, sf_dir, "documents"))


def _op4(spark, sf_dir):
    docs = _load(spark, sf_dir, "documents")
    found = language_id.identify(docs, language_id.fit(docs))
    return found.select("doc_id", "held_out", "lang_pred", "score", "rejected")


def _op5(spark, sf_dir):
    return packing.packed(_load(spark, sf_dir, "documents"))


def _op6(spark, sf_dir):
    return mixing.copies(_load(spark, sf_dir, "documents")).select(
        "doc_id",
        "size",
        "source_size",
        "target",
        (F.col("copies") * F.col("size")).alias("taken"),
    )


def _op7(spark, sf_dir):
    return quality_rules.judged(_load(spark, sf_dir, "documents"), "doc_id").select(
        "doc_id",
        "n_words",
        "word_chars",
        "n_symbols",
        "n_dup_lines",
        "n_repeat_words",
        "base_failed",
        "kept",
    )


def _op8(spark, sf_dir):
    return suffix_dedup.cleaned(_load(spark, sf_dir, "documents"))


def _op9(spark, sf_dir):
    return license_scan.scan(_load(spark, sf_dir, "documents")).drop(ROW)


def _op10(spark, sf_dir):
    docs = _load(spark, sf_dir, "documents")
    model = boosted_quality.fit_quality(docs, _load(spark, sf_dir, "labels"))
    return boosted_quality.score(docs, model)


def _op11(spark, sf_dir):
    """Labels are made noisy first; every hundredth id is an anchor."""
    rows, vector = _load(spark, sf_dir, "embeddings"), F.col("embedding")
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    anchor = F.coalesce(F.col("vec_id") % 100 == 0, F.lit(False))
    return hard_negatives.mine(
        rows.filter(hard_negatives.finite(vector)).select(
            F.col("vec_id").alias("id"),
            label.alias("label"),
            hard_negatives.quantized(vector).alias("vector"),
            anchor.alias("anchor"),
        )
    )


def _op12(spark, sf_dir):
    """Every seventh id, by hash, is tampered with."""
    docs = _load(spark, sf_dir, "documents")
    return merkle_manifest.verified(docs, F.crc32(docs["doc_id"].cast("string")) % 7 == 0)


def _op13(spark, sf_dir):
    found = secret_scan.scan(_load(spark, sf_dir, "documents"))
    counts = ["n_assign", "n_access", "n_hex"]
    return found.select("doc_id", *counts, F.sha2("base_spans", 256).alias("base_sha256"), "spans")


QUERIES: dict[str, Query] = {
    "op1_url_filter": _op1,
    "op2_exact_dedup": _op2,
    "op3_simhash": _op3,
    "op4_language_id": _op4,
    "op5_packing": _op5,
    "op6_mixing": _op6,
    "op7_quality_rules": _op7,
    "op8_suffix_dedup": _op8,
    "op9_license_scan": _op9,
    "op10_quality_boosting": _op10,
    "op11_hard_negatives": _op11,
    "op12_merkle_manifest": _op12,
    "op13_secret_scan": _op13,
    "pipeline": corpus_pipeline.run,
}

ORACLE: dict[str, str] = {
    "op1_url_filter": OP1,
    "op2_exact_dedup": OP2,
    "op6_mixing": OP6,
    "op7_quality_rules": OP7,
    "op9_license_scan": OP9,
    "op11_hard_negatives": OP11,
    "op12_merkle_manifest": OP12,
}
