"""Measures of ranked results against expectations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def first_hits(results: DataFrame, golden: DataFrame) -> DataFrame:
    """``(qid, cat, hit_rank)``: the first rank (qid, rank, file_path) that one of an item's expected paths (qid, cat, expected) is
    part of; null without a hit."""
    wanted = golden.select("qid", "cat", F.explode_outer("expected").alias("path"))
    joined = wanted.join(results.select("qid", "rank", "file_path"), "qid", "left")
    hit = F.when(F.contains("file_path", F.col("path")), F.col("rank"))
    return joined.groupBy("qid", "cat").agg(F.min(hit).alias("hit_rank"))


def metrics(hits: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Items, top-1 rate, recall at 5 and mean reciprocal rank, over all or by group."""
    rate = lambda c: F.round(F.avg(F.coalesce(c, F.lit(False)).cast("double")), 6)
    return hits.groupBy(*(by or [])).agg(
        F.count("*").alias("items"), rate(F.col("hit_rank") == 1).alias("top1"), rate(F.col("hit_rank") <= 5).alias("recall5"),
        F.round(F.avg(F.coalesce(1 / F.col("hit_rank"), F.lit(0.0))), 6).alias("mrr"),
    )


def agreement(a: DataFrame, b: DataFrame, k: int = 5) -> DataFrame:
    """``(qid, shared)``: how many of the first ``k`` ids two runs (qid, id, rank) share."""
    left, right = a.filter(F.col("rank") <= k).select("qid", "id"), b.filter(F.col("rank") <= k).select("qid", "id").withColumn("both", F.lit(1))
    return left.join(right, ["qid", "id"], "left").groupBy("qid").agg(F.sum(F.coalesce("both", F.lit(0))).alias("shared"))
