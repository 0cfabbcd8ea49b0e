"""Evidence: roles, contracts, citations, near-duplicates, budgets, support selection, verification terms."""

from __future__ import annotations

from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType

from ..functions.text import casefold
from .common import top

ITEM_CHARS, TOTAL_CHARS = 3500, 16_000
CONTAINED, CONTAINED_CHARS, OVERLAP, OVERLAP_CHARS, SHINGLE = 0.55, 100, 0.82, 80, 7


def role(live: Column, corpus: Column, authority: Column) -> Column:
    """The evidence role of a result."""
    return (
        F.when(live, "current_implementation").when(corpus == "official", "external_normative").when(authority == "design", "internal_design")
        .when(authority == "history", "internal_history").otherwise("indexed_implementation")
    )


def contract(found_intent: Column, roles: Column) -> Column:
    """Null if the roles at hand satisfy the intent, else the refusal code."""
    has = lambda *names: F.arrays_overlap(roles, F.array(*map(F.lit, names)))
    live, design, official = has("current_implementation"), has("internal_design", "internal_history"), has("external_normative")
    return (
        F.when((found_intent == "implementation") & ~live, "missing_current_implementation_evidence")
        .when((found_intent == "design") & ~design, "missing_internal_design_evidence")
        .when((found_intent == "official") & ~official, "missing_official_evidence")
        .when((found_intent == "comparison") & ~(live & official), "missing_comparison_evidence")
    )


def citations(answer: Column, known: Column) -> tuple[Column, Column]:
    """(cited ids in order of first mention, whether there is one and all are known)."""
    cited = F.array_distinct(F.regexp_extract_all(answer, F.lit(r"\[(E[0-9]+)\]"), F.lit(1)))
    return F.filter(cited, lambda c: F.array_contains(known, c)), (F.size(cited) > 0) & (F.size(F.array_except(cited, known)) == 0)


def within_budget_blocked(rows: DataFrame, by: str, order: str, block: Column, text: str, item: int = ITEM_CHARS, total: int = TOTAL_CHARS) -> DataFrame:
    """``within_budget`` for groups of any size: ``block`` cuts each group into ranges of ``order``, whose sums tell which ranges the budget reaches."""
    sized = rows.withColumns({"size": F.least(F.length(text), F.lit(item)), "block": block})
    earlier = lambda w: F.coalesce(F.sum("size").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    blocks = sized.groupBy(by, "block").agg(F.sum("size").alias("size")).withColumn("base", earlier(Window.partitionBy(by).orderBy("block"))).where(F.col("base") < total).drop("size")
    before = F.col("base") + earlier(Window.partitionBy(by, "block").orderBy(order))
    # rows with a null key or order are a group and a block of their own
    b = blocks.select(F.col(by).alias("_by"), F.col("block").alias("_block"), "base")
    kept = sized.join(b, F.col(by).eqNullSafe(F.col("_by")) & F.col("block").eqNullSafe(F.col("_block"))).drop("_by", "_block").withColumn("before", before).where(F.col("before") < total)
    return kept.withColumn("used", F.least(F.col("size"), F.lit(total) - F.col("before"))).drop("before", "base", "block", "size")


def within_budget(rows: DataFrame, by: str, order: list[Column], text: str, item: int = ITEM_CHARS, total: int = TOTAL_CHARS) -> DataFrame:
    """Rows with ``used`` characters of each, those before a row cut to ``item``, until ``total`` is used up."""
    size = F.least(F.length(text), F.lit(item))
    before = F.coalesce(F.sum(size).over(Window.partitionBy(by).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return rows.withColumn("before", before).where(F.col("before") < total).withColumn("used", F.least(size, F.lit(total) - F.col("before"))).drop("before")


def per_page(rows: DataFrame, by: str, page: str, order: list[Column], most: int = 2) -> DataFrame:
    """At most ``most`` rows of each page of a query."""
    return top(rows, [by, page], order, most, "in_page")


def near_duplicate_pairs(rows: DataFrame, keys: list[str], item: str, text: str) -> DataFrame:
    """(keys, a, b) of redundant items within the same keys (a query's results: a few dozen rows a key).

    Contained texts, or texts that share most shingles of the shorter one.
    """
    bare = F.regexp_replace(casefold(F.col(text)), r"\s+", "")
    each = rows.select(*keys, F.col(item).alias("i"), bare.alias("t"))
    pair = each.select(*keys, *(F.col(c).alias(f"{c}1") for c in "it")).join(each.select(*keys, *(F.col(c).alias(f"{c}2") for c in "it")), keys).where("i1 < i2")
    short, long_ = F.least(F.length("t1"), F.length("t2")), F.greatest(F.length("t1"), F.length("t2"))
    inside = (short >= CONTAINED_CHARS) & (short >= CONTAINED * long_) & (F.contains("t1", "t2") | F.contains("t2", "t1"))
    plain = F.when((F.col("t1") == F.col("t2")) | inside, True).when(short < OVERLAP_CHARS, False)
    # runs of characters are made where they are compared, for the pairs that nothing simpler decides
    first = F.when(plain.isNull(), F.col("t1"))
    pair = pair.withColumn("same", F.coalesce(plain, _share_most(first, F.when(first.isNotNull(), F.col("t2")))))
    return pair.where("same").select(*keys, F.col("i1").alias("a"), F.col("i2").alias("b"))


@F.pandas_udf(BooleanType())
def _share_most(left: pd.Series, right: pd.Series) -> pd.Series:
    """Whether two texts share most of the runs of SHINGLE characters of the one with fewer; null texts do not."""

    @lru_cache(256)
    def runs(t: str) -> frozenset[str]:
        return frozenset(t[i : i + SHINGLE] for i in range(max(1, len(t) - SHINGLE + 1)))

    def most(a: str | None, b: str | None) -> bool:
        return a is not None and len(runs(a) & runs(b)) >= OVERLAP * min(len(runs(a)), len(runs(b)))

    return pd.Series([most(a, b) for a, b in zip(left, right, strict=True)], dtype=bool)


def selected(results: DataFrame, by: str, keys: list[str], text: str, order: str) -> DataFrame:
    """Results of each query without those that repeat one kept before them: (.., place), places counted anew.

    A result repeats another of the same keys (role and page, say) if their texts without blanks are equal, if one
    holds the other and is not much longer, or if they share most runs of SHINGLE characters. Results are taken in
    their order, and only those kept count; so what repeats a dropped one alone stays. Pairs that repeat one another
    are found by a join, and a fold over the places of a query's results, a few dozen, keeps them one by one. A null
    key is one like any other; ``order`` is different for each result of a query.
    """
    key = F.to_json(F.struct(*(F.col(k).cast("string").alias(k) for k in keys)))
    rows = results.select(by, key.alias("_k"), F.col(order).alias("_o"), F.coalesce(F.col(text), F.lit("")).alias("_t"))
    near = near_duplicate_pairs(rows, [by, "_k"], "_o", "_t").groupBy(by, F.col("b").alias("_o")).agg(F.collect_list("a").alias("earlier"))
    none = F.array().cast(f"array<{dict(results.dtypes)[order]}>")
    listed = results.select(by, F.col(order).alias("_o")).join(near, [by, "_o"], "left").groupBy(by).agg(F.array_sort(F.collect_list(F.struct("_o", F.coalesce("earlier", none).alias("earlier")))).alias("rows"))
    kept = F.aggregate("rows", none, lambda acc, r: F.when(F.arrays_overlap(acc, r["earlier"]), acc).otherwise(F.concat(acc, F.array(r["_o"]))))
    places = listed.select(by, F.posexplode(kept).alias("place", order)).withColumn("place", F.col("place") + 1)
    return results.join(places, [by, order])


def support_score(query_tokens: Column, symbol_tokens: Column, path_tokens: Column, content_tokens: Column, taken: Column, rank: Column) -> Column:
    """10 for each query token in the symbol, 2 in the path, 0.5 in the content, 3 for each new against the taken ones, and 1 / rank."""
    hit = lambda x: F.size(F.array_intersect(query_tokens, x))
    new = F.size(F.array_intersect(query_tokens, F.array_except(F.array_union(symbol_tokens, path_tokens), taken)))
    return 10 * hit(symbol_tokens) + 2 * hit(path_tokens) + 0.5 * hit(content_tokens) + 3 * new + 1 / rank


def grep(rows: DataFrame, key: str, text: str, needle: str) -> DataFrame:
    """(key, line_no, column, line) of every line that holds a fixed string; both numbers from 1."""
    lines = rows.where(F.contains(text, F.lit(needle))).select(key, F.posexplode(F.split(F.col(text), "\n")).alias("n", "line"))
    return lines.where(F.contains("line", F.lit(needle))).select(key, (F.col("n") + 1).alias("line_no"), F.locate(needle, F.col("line")).alias("column"), "line")
