"""The older strategies: keyword routing with a fall-back, filters and rewrites by an injected writer, table summaries."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import top

DEFAULT = "HybridSearch"
# Words that choose a strategy, in the order in which they are looked for.
RULES = [
    ("Text2SQL", ("多少", "对比", "排名", "查询", "统计", "最大", "最小", "平均", "几个")),
    ("MetadataFilter", ("文档", "API", "教程", "如何", "怎么", "配置")),
    ("MultimodalSearch", ("图", "架构", "流程", "截图", "图片")),
]


def strategy(query: Column, known: tuple[str, ...] | None = None, otherwise: Column | None = None) -> Column:
    """The strategy of a query by its words, else ``otherwise`` (as a model says), and the default for one that is not known."""
    out = otherwise if otherwise is not None else F.lit(DEFAULT)
    for name, words in reversed(RULES):
        out = F.when(query.rlike("|".join(words)), name).otherwise(out)
    return out if known is None else F.when(out.isin(*known), out).otherwise(DEFAULT)


def with_fallback(primary: DataFrame, default: DataFrame, queries: DataFrame, key: str = "qid") -> DataFrame:
    """Results of each query's own strategy; queries that it gives nothing take those of the default one."""
    empty = queries.select(key).join(primary.select(key).distinct(), key, "left_anti")
    return primary.withColumn("fell_back", F.lit(False)).unionByName(default.join(empty, key, "left_semi").withColumn("fell_back", F.lit(True)))


def condition_filter(lines: str) -> str:
    """The filter of conditions that a model wrote, a line each; empty for NONE."""
    found = [x.strip() for x in lines.split("\n") if x.strip()]
    return "" if lines.strip() == "NONE" else " and ".join(found)


def rewritten(queries: DataFrame, expand: Callable[[Column], Column], most: int = 3, key: str = "qid", text: str = "query") -> DataFrame:
    """(key, number, query): the query itself, and up to ``most`` expansions that are not blank."""
    more = F.slice(F.filter(F.transform(expand(F.col(text)), lambda x: F.trim(x)), lambda x: x != ""), 1, most)
    return queries.select(key, F.posexplode(F.concat(F.array(text), more)).alias("number", "query"))


def merged(results: DataFrame, k: int, key: str = "qid", text: str = "content") -> DataFrame:
    """Results of all rewrites (key, number, rank, content) one after the other, the first of each text, and the first k of them."""
    once = results.withColumn("_n", F.row_number().over(Window.partitionBy(key, text).orderBy("number", "rank"))).where("_n = 1").drop("_n")
    return top(once, [key], [F.asc("number"), F.asc("rank")], k, "place")


def confidence(results: DataFrame, key: str = "qid") -> DataFrame:
    """(key, confidence): the mean score of a query's documents, to 2 places."""
    return results.groupBy(key).agg(F.round(F.avg("score"), 2).alias("confidence"))


def no_media(queries: DataFrame, key: str = "qid") -> DataFrame:
    """The media strategy has no store behind it: it answers no query, and the fall-back does."""
    return queries.where("false").select(key, F.lit("").alias("content"), F.lit(0.0).alias("score"))


def table_summary(table: DataFrame, name: str, first: int = 100, order: str | None = None) -> DataFrame:
    """(kind, content): what a table holds and how many rows it has, then its first rows as text."""
    columns = ", ".join(f"{c} ({t})" for c, t in table.dtypes)
    head = table.agg(F.count(F.lit(1)).alias("n")).select(F.lit("table").alias("kind"), F.concat(F.lit(f"{name}: {columns}; rows: "), F.col("n").cast("string")).alias("content"))
    text = F.concat_ws(" | ", *(F.concat(F.lit(f"{c}: "), F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("None"))) for c in table.columns))
    rows = (table.orderBy(order) if order else table).limit(first)
    return head.unionByName(rows.select(F.lit("table_row").alias("kind"), text.alias("content")))
