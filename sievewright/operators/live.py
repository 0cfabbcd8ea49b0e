"""Live verification and the choice of evidence around it: symbol and text hits, commits, support slots, parents, definition order, report paths."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import casefold
from . import fusion, patterns
from .common import dealt, top

SYMBOL_WEIGHT, TEXT_WEIGHT = 1.5, 1.0
MAX_COMMITS = 50
#: Bytes of subjects of a task.
SUBJECT_BYTES = 1 << 20
# What a definition is asked with, what shows an overview or code.
DEFINITION = r"(?i)(?:什么是|是什[么麼]|介绍|简介|概述|定义|what\s+is|define|overview)"
OVERVIEW = r"(?i)(?:overview|introduction|getting[-_ ]started|readme|简介|概述|介绍)"
CODE = r"(?i)(?:```|\b(?:def|class|import|from|const|function)\s+|pip\s+install|\b(?:async\s+)?def\b|\{\s*[\"'])"
# Words of a query that name nothing.
PLAIN = ("a", "an", "and", "are", "do", "does", "for", "from", "how", "in", "is", "of", "or", "the", "to", "what", "when", "where", "which", "who", "why", "with")
IDENTIFIER = r"[A-Za-z_][A-Za-z0-9_.-]*"


def symbol_score(symbol: Column, term: Column) -> Column:
    """4 for the whole name, 3 for its last part if the term has no dot, else 0."""
    leaf = F.substring_index(symbol, ".", -1)
    return F.when(symbol == term, 4).when(~F.contains(term, F.lit(".")) & (leaf == term), 3).otherwise(0)


def symbol_hits(symbols: DataFrame, terms: DataFrame, k: int) -> DataFrame:
    """(qid, path, symbol, line_start, score, rank): symbols (path, symbol, line_start) that a query's terms (qid, term) name.

    Two equi-joins, on the name and on its last part; best score first, then by path and line.
    """
    leaf = symbols.withColumn("leaf", F.substring_index("symbol", ".", -1))
    whole = leaf.join(terms, F.col("symbol") == F.col("term"))
    part = leaf.join(terms, (F.col("leaf") == F.col("term")) & ~F.contains("term", F.lit(".")))
    rows = whole.unionByName(part).withColumn("score", symbol_score(F.col("symbol"), F.col("term")))
    best = rows.groupBy("qid", "path", "symbol", "line_start").agg(F.max("score").alias("score"))
    return top(best, ["qid"], [F.desc("score"), F.asc("path"), F.asc("line_start"), F.asc("symbol")], k)


def merged_hits(symbol_rows: DataFrame, text_rows: DataFrame, k: int, item: str = "path") -> DataFrame:
    """Ranked symbol and text hits (qid, item, rank, score) fused, symbols weighing more; one kind alone keeps its order."""
    return fusion.hybrid(symbol_rows, text_rows, ["qid"], item, k, dense_weight=SYMBOL_WEIGHT, lexical_weight=TEXT_WEIGHT)


def commits(history: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """(qid, commit_sha, content, score, rank): commits (commit_sha, committed_at, subject) whose subject holds a query's text, the last first.

    Texts are matched whatever the case, by the runs of their characters. Commits are dealt out, so a task ranks the
    matches of SUBJECT_BYTES of subjects.
    """
    asked = queries.where((F.trim("query") != "") & (F.length("query") <= 512) & ~F.col("query").rlike("[\\x00\\r\\n]")).select("qid", F.trim("query").alias("query"))
    rows = dealt(history.select("commit_sha", "committed_at", "subject"), "commit_sha", "subject", SUBJECT_BYTES)
    found = patterns.holding(rows, "commit_sha", "subject", asked, ("committed_at", "subject"))
    rows = top(found, ["qid"], [F.desc("committed_at"), F.asc("commit_sha")], min(k, MAX_COMMITS))
    content = F.concat(F.lit("Commit "), "commit_sha", F.lit(": "), "subject", F.lit(" ("), F.col("committed_at").cast("string"), F.lit(")"))
    return rows.select("qid", "commit_sha", content.alias("content"), (1.0 / F.col("rank")).alias("score"), "rank")


def path_states(changes: DataFrame) -> DataFrame:
    """(path, last_sha, last_at, n_commits) of paths from (commit_sha, committed_at, path)."""
    last = F.max(F.struct("committed_at", "commit_sha"))
    return changes.groupBy("path").agg(last["commit_sha"].alias("last_sha"), last["committed_at"].alias("last_at"), F.count_distinct("commit_sha").alias("n_commits"))


def with_official(indexed: DataFrame, official: DataFrame, item: str = "doc_id") -> DataFrame:
    """Indexed results of comparisons, then the official candidates that are not among them."""
    more = official.join(indexed.select("qid", item), ["qid", item], "left_anti")
    rows = indexed.withColumn("_o", F.lit(0)).unionByName(more.withColumn("_o", F.lit(1)))
    return rows.withColumn("place", F.row_number().over(Window.partitionBy("qid").orderBy("_o", "rank"))).drop("_o")


def name_tokens(text: Column) -> Column:
    """Different identifiers of a text and their parts, in lower case, without plain words and single letters."""
    raw = F.transform(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(IDENTIFIER), F.lit(0)), lambda t: F.lower(F.regexp_replace(t, "^[._-]+|[._-]+$", "")))
    both = F.flatten(F.transform(raw, lambda t: F.concat(F.array(t), F.split(t, "[._-]+"))))
    return F.array_distinct(F.filter(both, lambda t: (F.length(t) >= 2) & ~t.isin(*PLAIN)))


def file_key(path: Column) -> Column:
    """The file of a result: without a fragment and line numbers, in lower case."""
    bare = F.replace(F.substring_index(F.trim(path), "#", 1), F.lit("\\"), F.lit("/"))
    return casefold(F.regexp_replace(F.regexp_replace(bare, r":\d+(?:-\d+)?$", ""), "/+", "/"))


def first_support(primary: DataFrame, support: DataFrame) -> DataFrame:
    """Of each query the first support result (qid, item, rank, role) that is not a primary one, if its role is new."""
    other = support.join(primary.select("qid", "item"), ["qid", "item"], "left_anti")
    return top(other, ["qid"], [F.asc("rank"), F.asc("item")], 1, "_p").drop("_p").join(primary.select("qid", "role").distinct(), ["qid", "role"], "left_anti")


def diverse_support(queries: DataFrame, primary: DataFrame, support: DataFrame) -> DataFrame:
    """Of each query the best support result by the names it shares with the query: (qid, item, role, support).

    primary and support: (qid, item, rank, role, path, symbol, content). Candidates have another item, file and
    role than all primary results, and are the first of their file. 10 for each name in the symbol, 2 in the path,
    0.5 in the text, 3 for each that no primary symbol or path has, and 1 / rank. Queries without names take the
    first support result.
    """
    asked = queries.select("qid", name_tokens(F.col("query")).alias("asked"))
    own = name_tokens(F.concat_ws(" ", "symbol", "path"))
    known = primary.groupBy("qid").agg(F.array_distinct(F.flatten(F.collect_list(own))).alias("known"))  # a few results a query
    free = support.withColumn("file", file_key(F.col("path"))).join(primary.select("qid", "item"), ["qid", "item"], "left_anti")
    free = free.join(primary.select("qid", file_key(F.col("path")).alias("file")).distinct(), ["qid", "file"], "left_anti").join(primary.select("qid", "role").distinct(), ["qid", "role"], "left_anti")
    free = top(free, ["qid", "file"], [F.asc("rank")], 1, "_f").drop("_f")
    rows = free.join(asked.where(F.size("asked") > 0), "qid").join(known, "qid", "left")
    hit = lambda *cs: F.array_intersect("asked", name_tokens(F.concat_ws(" ", *cs)))
    symbol, path, content = hit("symbol"), hit("path"), hit("content")
    new = F.array_except(F.array_union(F.array_union(symbol, path), content), F.coalesce("known", F.array().cast("array<string>")))
    score = 10 * F.size(symbol) + 2 * F.size(path) + 0.5 * F.size(content) + 3 * F.size(new) + 1.0 / F.col("rank")
    best = top(rows.withColumn("support", F.round(score, 6)), ["qid"], [F.desc("support"), F.asc("rank")], 1, "_p").select("qid", "item", "role", "support")
    nameless = first_support(primary, support.join(asked.where(F.size("asked") == 0).select("qid"), "qid", "left_semi"))
    return best.unionByName(nameless.select("qid", "item", "role", F.lit(None).cast("double").alias("support")))


def with_parents(results: DataFrame, symbols: DataFrame) -> DataFrame:
    """Results (.., symbol) whose symbol is a member get its class (symbol, path, line_start) in its place, if there is one, and say so."""
    classes = symbols.where(~F.contains("symbol", F.lit("."))).groupBy("symbol").agg(F.min(F.struct("path", "line_start")).alias("at"))
    parent = F.when(F.contains("symbol", F.lit(".")), F.substring_index("symbol", ".", 1))
    rows = results.withColumn("_parent", parent).join(classes.select(F.col("symbol").alias("_parent"), "at"), "_parent", "left")
    found = F.col("at").isNotNull()
    return rows.withColumn("expanded_from", F.when(found, F.col("symbol"))).withColumn("symbol", F.when(found, F.col("_parent")).otherwise(F.col("symbol"))).withColumn("path", F.when(found, F.col("at.path")).otherwise(F.col("path"))).drop("_parent", "at")


def definition_priority(authority: Column, record_kind: Column, content: Column, *named: Column) -> Column:
    """How late a result comes in the answer to a definition: overviews and documents first, code last."""
    shown = F.concat_ws(" ", *named, F.substring(content, 1, 500))
    return (
        F.when(shown.rlike(OVERVIEW), -5).otherwise(0) + F.when(authority.isin("official", "design", "documentation"), -2).otherwise(0)
        + F.when(F.coalesce(record_kind, F.lit("")).isin("document", "documentation"), -1).otherwise(0) + F.when(authority.isin("code", "test") | content.rlike(CODE), 5).otherwise(0)
    )


def definition_order(results: DataFrame, priority: Column) -> DataFrame:
    """Results (qid, query, rank, page) of definitions by priority, at most two of a page, or three if there is one page; others keep their order."""
    asked = F.col("query").rlike(DEFINITION)
    rows = results.withColumn("_d", asked).withColumn("_p", F.when(asked, priority).otherwise(0))
    pages = results.groupBy("qid").agg(F.count_distinct("page").alias("_pages"))
    rows = rows.join(pages, "qid").withColumn("_n", F.row_number().over(Window.partitionBy("qid", "page").orderBy("_p", "rank")))
    kept = rows.where(~F.col("_d") | (F.col("_n") <= F.when(F.col("_pages") > 1, 2).otherwise(3)))
    return kept.withColumn("place", F.row_number().over(Window.partitionBy("qid").orderBy("_p", "rank"))).drop("_d", "_p", "_n", "_pages")


def plain_fusion(dense: DataFrame, sparse: DataFrame, item: str, k: int = fusion.K) -> DataFrame:
    """(qid, item, fused, shown): both rankings with equal weights; shown is the list whose row stands for an item, the last one that has it."""
    rows = fusion.arm(dense, 0, "dense").unionByName(fusion.arm(sparse, 1, "sparse"))
    return rows.groupBy("qid", item).agg(F.round(F.sum(1.0 / (F.lit(k) + F.col("rank"))), 9).alias("fused"), F.max_by("retriever", F.struct("list_no", "rank")).alias("shown"))


def profile_runs(arms: DataFrame, profiles: DataFrame, item: str, top_k: int, k: int = fusion.K) -> DataFrame:
    """(name, qid, item, fused, rank): one index under every profile (name, dense_weight, bm25_weight, multiplier) of a grid.

    arms: (qid, item, retriever, rank) with dense and bm25 rankings. A profile takes multiplier x top_k candidates
    of each arm; profiles are a handful, and a further grouping key.
    """
    rows = arms.crossJoin(F.broadcast(profiles)).where(F.col("rank") <= F.col("multiplier") * top_k)
    weight = F.when(F.col("retriever") == "dense", F.col("dense_weight")).otherwise(F.col("bm25_weight"))
    summed = rows.groupBy("name", "qid", item).agg(F.round(F.sum(weight / (F.lit(k) + F.col("rank"))), 9).alias("fused"))
    return top(summed, ["name", "qid"], [F.desc("fused"), F.asc(item)], top_k)


def one_arm(arms: DataFrame, mode: str, top_k: int) -> DataFrame:
    """The view of an index with one kind of retriever."""
    if mode not in ("dense", "bm25"):
        raise ValueError(f"unsupported mode: {mode}")
    return arms.where((F.col("retriever") == mode) & (F.col("rank") <= top_k))


def oracle_results(samples: DataFrame, results: DataFrame, k: int) -> DataFrame:
    """Results (qid, item, rank, corpus, authority, degraded) that a sample's labelled route (qid, route) allows, the first k.

    A benchmark refuses results of a degraded retrieval: their queries get an error and no rows.
    """
    internal = F.col("authority").isin("code", "test", "design", "history") & (F.col("corpus") == "internal")
    official = (F.col("corpus") == "official") & (F.col("authority") == "official")
    allowed = F.when(F.col("route").isin("design", "implementation"), internal).when(F.col("route") == "official", official).when(F.col("route") == "comparison", internal | official).otherwise(False)
    rows = results.join(samples.select("qid", "route"), "qid").where(allowed)
    bad = rows.where("degraded").select("qid").distinct()
    kept = top(rows.join(bad, "qid", "left_anti"), ["qid"], [F.asc("rank")], k, "place").select("qid", "item", "place", F.lit(None).cast("string").alias("error"))
    return kept.unionByName(bad.select("qid", F.lit(None).cast(dict(results.dtypes)["item"]).alias("item"), F.lit(None).cast("int").alias("place"), F.lit("degraded retrieval").alias("error")))


def judge_summary(scores: DataFrame) -> DataFrame:
    """(metric, mean, successful, failed, coverage) of judged values (id, metric, value); a missing one is a failure, never a zero."""
    rows = scores.groupBy("metric").agg(F.round(F.avg("value"), 9).alias("mean"), F.count("value").alias("successful"), F.count_if(F.col("value").isNull()).alias("failed"))
    return rows.withColumn("coverage", F.round(F.col("successful") / (F.col("successful") + F.col("failed")), 9))


def report_lines(summary: DataFrame, key: str, metrics: list[str]) -> DataFrame:
    """(line_no, line) of a Markdown table of a summary, 4 places a number, n/a for none, rows by key."""
    cell = lambda c: F.coalesce(F.format_string("%.4f", F.col(c).cast("double")), F.lit("n/a"))
    number = lambda c: F.when(F.col(c).isNull(), F.lit("n/a")).otherwise(cell(c))
    body = summary.select((F.row_number().over(Window.orderBy(key)) + 2).alias("line_no"), F.concat(F.lit("| "), F.concat_ws(" | ", key, *map(number, metrics)), F.lit(" |")).alias("line"))  # a row a strategy
    head = summary.sparkSession.createDataFrame([(1, "| " + " | ".join([key, *metrics]) + " |"), (2, "| " + " | ".join(["---"] * (1 + len(metrics))) + " |")], "line_no int, line string")
    return head.unionByName(body)


def published_path(source: Column, folders: list[str], names: list[str]) -> Column:
    """A local absolute path from the last of the named folders on, or a named file alone; other absolute ones are an error; relative paths and URLs stay."""
    text = F.replace(source, F.lit("\\"), F.lit("/"))
    absolute = text.rlike("^[A-Za-z]:/") | text.startswith("/")
    inside = F.coalesce(*(F.when(F.contains(F.lower(text), F.lit(f"/{f.lower()}/")), F.substring(text, F.length(text) - F.length(F.substring_index(F.lower(text), f"/{f.lower()}/", -1)) - len(f), F.length(text))) for f in folders), F.lit(None))
    name = F.substring_index(text, "/", -1)
    return F.when(~absolute, text).when(inside.isNotNull(), inside).when(name.isin(*names), name)


def migrated_labels(samples: DataFrame, code_folder: str, implementation_intents: list[str]) -> DataFrame:
    """Samples (sample_id, answerable, scope, category, intent, sources) with their route, primary and supporting sources."""
    category = F.col("category")
    route = (
        F.when(F.col("scope") == "official_specifications", "official").when(category == "design_architecture", "design").when(category == "code_symbol_call_chain", "implementation")
        .when(category.isin("security_permissions", "checkpoint_context_memory"), F.when(F.col("intent").isin(*implementation_intents), "implementation").otherwise("design"))
    )
    sources = F.array_distinct("sources")
    first = lambda test: F.slice(F.concat(F.filter(sources, test), sources), 1, 1)
    docs, code = first(lambda s: (s == "README.md") | s.startswith("docs/")), first(lambda s: s.startswith(f"{code_folder}/") & s.endswith(".py"))
    none = F.array().cast("array<string>")
    primary = F.when(~F.col("answerable"), none).when(route == "design", docs).when(route == "implementation", code).otherwise(F.slice(sources, 1, 1))
    rows = samples.withColumn("route", route).withColumn("primary", primary)
    return rows.withColumn("supporting", F.when(F.col("answerable"), F.array_except(sources, "primary")).otherwise(none))
