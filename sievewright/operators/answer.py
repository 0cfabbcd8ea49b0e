"""From ranked results to an answer: reranking, live fusion, support slots, anchors, the guard and the answer states."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import tokens
from . import fusion
from .common import top

LIVE_WEIGHT, INDEXED_WEIGHT = 2.0, 1.0
# Anchors of a query, and words that are too general to be one.
ANCHOR = r"\b(?:[A-Za-z][A-Za-z0-9_-]*[._/][A-Za-z0-9_./-]+|[A-Z][A-Za-z0-9]*(?:[A-Z][A-Za-z0-9]*)+|[A-Z]{2,}|Redis|Kafka|PostgreSQL|Kubernetes|OAuth|CQRS)\b"
TICKED = r"`([^`\r\n]{1,96})`"
GENERIC = (
    "api", "cli", "rag", "agent", "python", "json", "http", "url", "cpu", "mcp", "langgraph", "docker", "queryengine", "agentstate", "what", "is", "are", "how", "why", "does", "do", "use", "uses", "using",
    "define", "explain", "tell", "about", "the", "and", "for", "with", "from", "project", "system", "framework", "library", "tool", "official", "docs", "documentation", "current", "implementation", "design", "architecture",
)
# Claims that no indexed source can support, in the order in which they are looked for.
UNSUPPORTED = [
    ("missing_production_telemetry", r"(?:生产环境|生产客户|真实用户|线上).{0,60}(?:SLA|P99|延迟|故障率|月均故障|活跃订单|库存预占失败率|客户影响)"),
    ("missing_independent_verification", r"独立.*审计|不存在.*逃逸|SOC\s*2|认证|审计报告"),
    ("missing_empirical_evidence", r"(?:(?:成功率|准确率|转化率|失败率|活跃订单|Recall@\d+|吞吐量|失败恢复时间|月均故障率|P(?:50|90|95|99)|峰值内存|并发).{0,30}(?:多少|是多少|分别|精确)|(?:是否|能否).{0,30}(?:独立.*审计|不存在.*逃逸)|(?:真实模型|大型仓库).{0,40}(?:成功率|吞吐量|恢复时间))"),
]


def overlap(query_tokens: Column, content_tokens: Column) -> Column:
    """Share of the query's different tokens that the content has: the offline stand-in for a cross-encoder."""
    asked = F.array_distinct(query_tokens)
    return F.coalesce(F.try_divide(F.size(F.array_intersect(asked, content_tokens)).cast("double"), F.size(asked).cast("double")), F.lit(0.0))


def rerank(results: DataFrame, k: int, by: str = "qid", query: str = "query", content: str = "content", scorer: Callable[[pd.Series, pd.Series], pd.Series] | None = None) -> DataFrame:
    """Reorder results (by, query, content, score, rank); the first score is kept, ties keep their order."""
    if scorer:
        score = F.pandas_udf(scorer, "double")(F.col(query), F.col(content))
    else:
        score = overlap(tokens(F.col(query)), tokens(F.col(content)))
    rows = results.withColumnsRenamed({"score": "first_score", "rank": "first_rank"}).withColumn("score", F.round(score, 6))
    return top(rows, [by], [F.desc("score"), F.asc("first_rank")], k)


def with_live(live: DataFrame, indexed: DataFrame, by: str, item: str, k: int) -> DataFrame:
    """Live hits (scored 1 / rank) fused with indexed ones, live ones weighing double."""
    hits = live.withColumn("score", 1.0 / F.col("rank"))
    return fusion.hybrid(hits, indexed, [by], item, k, dense_weight=LIVE_WEIGHT, lexical_weight=INDEXED_WEIGHT)


def both_sides(results: DataFrame, by: str, side: str, sides: tuple[str, str]) -> DataFrame:
    """For comparisons: the first result of each side goes to the front, the others follow in their order."""
    first = F.row_number().over(Window.partitionBy(by, side).orderBy("rank")) == 1
    front = F.when(first & F.col(side).isin(*sides), 0).otherwise(1)
    rows = results.withColumn("_front", front)
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy(by).orderBy("_front", "rank"))).drop("_front")


def place_support(results: DataFrame, support: DataFrame, by: str, k: int) -> DataFrame:
    """The support result takes the last of k places; with fewer than two places there is none."""
    if k < 2:
        return results.where(F.col("rank") <= k)
    has = support.select(by).distinct().withColumn("_s", F.lit(True))
    kept = results.join(has, by, "left").where(F.col("rank") <= F.when(F.col("_s"), k - 1).otherwise(k)).drop("_s")
    return kept.unionByName(support.withColumn("rank", F.lit(k)).select(kept.columns))


def anchors(query: Column) -> Column:
    """Names that an answer must be about: back-ticked terms and identifiers, without general words."""
    found = F.concat(F.regexp_extract_all(query, F.lit(TICKED), F.lit(1)), F.regexp_extract_all(query, F.lit(ANCHOR), F.lit(0)))
    return F.array_distinct(F.filter(F.transform(found, lambda x: F.lower(F.trim(x))), lambda x: ~x.isin(*GENERIC) & (x != "")))


def missing(wanted: Column, evidence_text: Column) -> Column:
    """Anchors that no evidence mentions."""
    low = F.lower(evidence_text)
    return F.filter(wanted, lambda a: ~F.contains(low, a))


def guard(query: Column, missing_anchors: Column) -> Column:
    """Why the evidence cannot support an answer: claims that nothing indexed can prove first, then missing anchors; null if it can."""
    out = F.when(F.size(missing_anchors) > 0, "unsupported_anchor")
    for code, pattern in reversed(UNSUPPORTED):
        out = F.when(query.rlike(f"(?i)(?:{pattern})"), code).otherwise(out)
    return out


def state(sufficient: Column, generated: Column, valid: Column) -> Column:
    """The answer's state: refused, evidence_only (nothing generated), model, or fallback (citations that do not hold)."""
    return F.when(~sufficient, "refused").when(generated.isNull(), "evidence_only").when(F.trim(generated) == "", "fallback_empty_response").when(valid, "model").otherwise("fallback_invalid_citations")


def claim_recall(claims: DataFrame, retrieved: DataFrame, qid: str = "qid") -> DataFrame:
    """(qid, n_claims, n_supported, claim_recall): claims (qid, claim_id, sources) that some retrieved source supports."""
    options = claims.select(qid, "claim_id", F.explode_outer("sources").alias("source"))
    hits = options.join(retrieved.select(qid, "source").distinct(), [qid, "source"], "left_semi").select(qid, "claim_id").distinct().withColumn("hit", F.lit(1))
    rows = claims.select(qid, "claim_id").distinct().join(hits, [qid, "claim_id"], "left")
    return rows.groupBy(qid).agg(F.count(F.lit(1)).alias("n_claims"), F.count("hit").alias("n_supported"), F.round(F.count("hit") / F.count(F.lit(1)), 9).alias("claim_recall"))


def publishable(summary: DataFrame) -> Column:
    """Runs, judge executions and deterministic metrics complete, and judge scores for 95 % at least."""
    return (F.col("run_coverage") == 1) & (F.col("execution_coverage") == 1) & (F.col("deterministic_coverage") == 1) & (F.col("score_coverage") >= 0.95)
