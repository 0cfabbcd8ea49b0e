"""Weighted reciprocal-rank fusion of rankings, hybrid and federated retrieval."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import top

K = 60
#: Candidates at each level are this many times what the level above asks for.
PARTITION_FACTOR, FEDERATED_FACTOR, SERVICE_FACTOR = 3, 3, 2
# Weights of the partitions.
PARTITION_WEIGHTS = {"code": 1.35, "test": 1.20, "design": 1.00, "history": 0.80, "official": 0.90}


def fuse(rankings: DataFrame, by: list[str], item: str, k: int = K, top_k: int | None = None, weight: Column | None = None) -> DataFrame:
    """(by, item, fused, contributors, best_list, best_score, rank) of rows (by, list_no, retriever, item, rank, score).

    Each appearance adds weight / (k + rank), twice in one ranking counts twice. The
    representative is the appearance with the largest score, the first of equal ones;
    equal sums are ordered by the first appearance. top_k 0 or less gives no rows.
    """
    if k < 0:
        raise ValueError("k must not be negative")
    seen = F.struct("list_no", "rank")
    rows = rankings.withColumn("part", (weight if weight is not None else F.lit(1.0)) / (F.lit(k) + F.col("rank")))
    summed = rows.groupBy(*by, item).agg(
        F.round(F.sum("part"), 9).alias("fused"),
        F.array_distinct(F.transform(F.array_sort(F.collect_list(F.struct("list_no", "rank", "retriever"))), lambda x: x["retriever"])).alias("contributors"),
        F.min(seen).alias("first"),
        F.max_by("list_no", F.struct(F.col("score"), -F.col("list_no"), -F.col("rank"))).alias("best_list"),
        F.max("score").alias("best_score"),
    )
    order = [F.desc("fused"), F.asc("first.list_no"), F.asc("first.rank"), F.asc(item)]
    limit = 2**31 - 1 if top_k is None else top_k
    return top(summed, by, order, limit).drop("first")


def arm(ranked: DataFrame, list_no: int, name: str) -> DataFrame:
    """A ranking as ``fuse`` takes it."""
    return ranked.withColumn("list_no", F.lit(list_no)).withColumn("retriever", F.lit(name))


def hybrid(dense: DataFrame, lexical: DataFrame, by: list[str], item: str, top_k: int, k: int = K, dense_weight: float = 1.0, lexical_weight: float = 1.0) -> DataFrame:
    """Fuse a dense and a lexical ranking; a missing arm (no rows) leaves the other one's order."""
    if dense_weight < 0 or lexical_weight < 0:
        raise ValueError("weights must not be negative")
    rows = arm(dense, 0, "dense").unionByName(arm(lexical, 1, "bm25"))
    weight = F.when(F.col("list_no") == 0, F.lit(dense_weight)).otherwise(F.lit(lexical_weight))
    return fuse(rows, by, item, k, top_k, weight)


def federate(partitioned: DataFrame, by: list[str], partition: str, item: str, weight: Column, top_k: int, k: int = K) -> DataFrame:
    """Fuse one ranking a partition, each with its weight; partitions are taken in name order."""
    numbered = partitioned.withColumn("list_no", F.dense_rank().over(Window.partitionBy(*by).orderBy(partition))).withColumn("retriever", F.col(partition))
    return fuse(numbered, by, item, k, top_k, weight)
