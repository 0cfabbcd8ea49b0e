"""Retrieval end to end for a batch of queries, over a stored index and the files as they are now.

For each query: checks and route; candidates of the dense and the lexical arm in each partition that the route
allows, fused there and over the partitions; lines of the current files that hold what the query names, fused
with the indexed results; both sides of a comparison, or a supporting result of another role; the evidence
contract and the guard; citations. Each level asks the one below for a multiple of what it returns.

A query that may not be run has an error and no results; one out of scope has a reason and none. An index
without one of its arms gives the results of the other and says so, or is refused (``fail_open=False``).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import evidence, fusion, guards, inverted, live, manifest, patterns, routing
from .common import top
from .workspace import written

INTERNAL = ("code", "test", "design", "history")
#: Of each intent, the partitions of the results, and those of a supporting result.
SUPPORT = {"design": ("code", "test"), "implementation": ("design", "history")}
LIVE_POOL = 8
_none = lambda: F.array().cast("array<string>")


class Unavailable(RuntimeError):
    """An arm is missing and the index is not to be used without it."""


def routed(queries: DataFrame, k: int, projects: tuple[str, ...] = ()) -> DataFrame:
    """(qid, query, [vector,] error, intent, rule, text): text is the query with known misspellings put right; intents of queries with an error are null."""
    rows = manifest.query_errors(queries.withColumn("top_k", F.lit(k))).drop("top_k")
    intent = F.when(F.col("error").isNull(), routing.intent(F.col("query"), projects))
    rows = rows.withColumn("intent", intent).withColumn("text", routing.normalised(F.col("query")))
    return rows.withColumn("rule", routing.route(F.col("intent"))[2])


def partitions(asked: DataFrame) -> DataFrame:
    """(qid, grp, corpus, authority): the partitions that each query's results, its support and its official side are taken from."""
    part = lambda grp, *names: [F.struct(F.lit(grp).alias("grp"), F.lit("official" if n == "official" else "internal").alias("corpus"), F.lit(n).alias("authority")) for n in names]
    wanted = {
        "implementation": part("main", "code", "test") + part("support", *SUPPORT["implementation"]), "design": part("main", "design", "history") + part("support", *SUPPORT["design"]),
        "official": part("main", "official"), "comparison": part("main", *INTERNAL, "official") + part("official", "official"),
    }
    listed = F.coalesce(*(F.when(F.col("intent") == name, F.array(*parts)) for name, parts in wanted.items()))
    return asked.select("qid", F.explode(listed).alias("p")).select("qid", "p.*")


def candidates(index: inverted.Index, asked: DataFrame, k: int, fail_open: bool = True) -> tuple[DataFrame, list[str]]:
    """((qid, grp, doc_id, corpus, authority, score, rank), names of the arms that are missing).

    asked: (qid, text, intent[, vector]). A group's k results are fused from its partitions' results, three times as
    many each, and those from three times as many of each arm; the results that a query starts with are 2 k.
    """
    parts = partitions(asked)
    by = ("corpus", "authority")
    wide = k * fusion.SERVICE_FACTOR * fusion.FEDERATED_FACTOR * fusion.PARTITION_FACTOR
    seen = parts.select("qid", *by).distinct()
    arms, missing = [], []
    if "vectors" in index.tables and "vector" in asked.columns:
        found = index.nearest(asked.select("qid", F.col("vector").alias("query")), wide, by)
        arms.append(fusion.arm(found.join(seen, ["qid", *by], "left_semi"), 0, "dense"))
    else:
        missing.append("dense")
    if "postings" in index.tables:
        terms = inverted.query_terms(asked.where("intent <> 'out_of_scope'").select("qid", F.col("text").alias("query")))
        arms.append(fusion.arm(index.ranked(terms, wide, by, allowed=seen), 1, "bm25"))
    else:
        missing.append("bm25")
    if missing and not fail_open or not arms:
        raise Unavailable(f"arms of the index are missing: {', '.join(missing)}")
    rows = arms[0] if len(arms) == 1 else arms[0].unionByName(arms[1])
    own = F.when(F.col("grp") == "main", k * fusion.SERVICE_FACTOR).otherwise(max(2, k))  # what a group returns
    rows = rows.join(parts, ["qid", *by]).where(F.col("rank") <= own * fusion.FEDERATED_FACTOR * fusion.PARTITION_FACTOR)
    fused = fusion.fuse(rows, ["qid", "grp", *by], "doc_id", top_k=k * fusion.SERVICE_FACTOR * fusion.FEDERATED_FACTOR).where(F.col("rank") <= own * fusion.FEDERATED_FACTOR)
    named = fused.select("qid", "grp", "doc_id", "rank", F.col("fused").alias("score"), "authority", F.concat_ws("/", *by).alias("part"))
    weight = F.coalesce(*(F.when(F.substring_index("part", "/", -1) == a, F.lit(w)) for a, w in fusion.PARTITION_WEIGHTS.items()), F.lit(1.0))
    whole = fusion.federate(named.drop("authority"), ["qid", "grp"], "part", "doc_id", weight, k * fusion.SERVICE_FACTOR).where(F.col("rank") <= own)
    return whole.select("qid", "grp", "doc_id", F.col("fused").alias("score"), "rank"), missing


def live_lines(asked: DataFrame, indexed: DataFrame, files: DataFrame, k: int, allowed: str | None = None) -> tuple[DataFrame, DataFrame]:
    """((qid, terms), (qid, item, source, content, rank)): what is looked for in the files, and the lines found, the first of max(k, LIVE_POOL)."""
    paths = indexed.where("grp = 'main'").groupBy("qid").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "path"))), lambda x: x["path"]).alias("paths"))  # 2 k a query
    rows = asked.where(F.col("intent").isin("implementation", "comparison")).join(paths, "qid", "left")
    terms = written(rows.select("qid", guards.verification_terms(F.col("text"), _none(), F.coalesce("paths", _none())).alias("terms")), "live-terms")
    each = terms.select("qid", F.posexplode("terms").alias("place", "term"))
    hits = patterns.query_hits(files, each, max(k, LIVE_POOL), allowed)
    at = F.concat_ws(":", "path", "line_no")
    return terms, hits.select("qid", F.concat(F.lit("live:"), at).alias("item"), at.alias("source"), F.col("line").alias("content"), "rank")


def fused_with_live(asked: DataFrame, indexed: DataFrame, lines: DataFrame, k: int) -> DataFrame:
    """(qid, item, role, source, content, place): the first k of the live lines and the indexed results, both sides of a comparison in front.

    indexed: (qid, grp, item, role, source, content, rank). A comparison's official candidates follow its results.
    """
    base = indexed.where("grp = 'main'").drop("grp")
    more = indexed.where("grp = 'official'").drop("grp")
    joined = live.with_official(base, more, "item").withColumn("rank", F.col("place")).drop("place")
    cols = ["qid", "item", "role", "source", "content", "rank"]
    shown = lines.withColumn("role", F.lit("current_implementation")).select(*cols).withColumn("list_no", F.lit(0)).unionByName(joined.select(*cols).withColumn("list_no", F.lit(1)))
    ranking = shown.select("qid", "item", "rank", "list_no", F.when(F.col("list_no") == 0, "live").otherwise("indexed").alias("retriever"), (1.0 / F.col("rank")).alias("score"))
    fused = fusion.fuse(ranking, ["qid"], "item", weight=F.when(F.col("list_no") == 0, F.lit(2.0)).otherwise(F.lit(1.0))).select("qid", "item", F.col("rank").alias("fused_rank"))
    rows = shown.join(fused, ["qid", "item"]).join(asked.select("qid", "intent"), "qid")
    side = F.when(F.col("list_no") == 0, 0).when(F.col("role") == "external_normative", 1)
    inside = F.col("fused_rank") <= k
    first = F.row_number().over(Window.partitionBy("qid", side).orderBy(F.desc(inside), F.when(inside, F.col("fused_rank")).otherwise(F.col("rank")))) == 1
    rows = rows.withColumn("side", side).withColumn("picked", (F.col("intent") == "comparison") & side.isNotNull() & first).where(F.col("picked") | inside)
    order = [F.when(F.col("picked"), F.col("side")).otherwise(2), F.col("fused_rank")]
    return top(rows, ["qid"], order, k, "place").select("qid", "item", "role", "source", "content", "place")


def with_support(results: DataFrame, support: DataFrame, k: int) -> DataFrame:
    """Results with the first supporting result of a new role in the last of k places, or behind them if there are fewer."""
    if k < 2:
        return results
    primary = results.withColumn("rank", F.col("place"))
    chosen = live.first_support(primary, support.select("qid", "item", "rank", "role")).join(support.drop("rank", "role"), ["qid", "item"]).select("qid", "item", "role", "source", "content")
    has = chosen.select("qid").withColumn("_s", F.lit(1))
    kept = results.join(has, "qid", "left").where(F.col("_s").isNull() | (F.col("place") < k)).drop("_s")
    rows = kept.unionByName(chosen.withColumn("place", F.lit(k + 1)))
    return rows.withColumn("place", F.row_number().over(Window.partitionBy("qid").orderBy("place")))


def retrieve(
    index: inverted.Index, queries: DataFrame, texts: DataFrame, files: DataFrame, k: int = 5, scope: tuple[list[str], list[str]] = ((), ()), projects: tuple[str, ...] = (),
    allowed: str | None = None, fail_open: bool = True, build_id: str | None = None,
) -> DataFrame:
    """(qid, error, intent, rule, sufficient, refusal_reason, terms, warnings, results), a row a query.

    queries: (qid, query[, vector]); texts: (doc_id, text) of the index's documents; files: (path, text) of the current
    code; scope: aliases and topics of the official sources; build_id: the build that the index should be of.
    results are (rank, citation, item, source, role) in order, k at most.
    """
    asked = written(routed(queries, k, projects), "asked")
    found, missing = candidates(index, asked, k, fail_open)
    documents = index.tables["documents"].select("doc_id", "source", "path", "corpus", "authority")
    indexed = found.join(documents, "doc_id").join(texts.select("doc_id", F.col("text").alias("content")), "doc_id")
    indexed = written(indexed.withColumn("item", F.concat(F.lit("doc:"), "doc_id")).withColumn("role", evidence.role(F.lit(False), F.col("corpus"), F.col("authority"))).select("qid", "grp", "item", "role", "source", "path", "content", "rank"), "indexed")
    terms, lines = live_lines(asked, indexed, files, k, allowed)
    results = fused_with_live(asked, indexed.drop("path"), lines, k)
    support = indexed.where("grp = 'support'").select("qid", "item", "role", "source", "content", "rank")
    results = written(with_support(results, support, k), "results")

    facts = results.select("qid", "role", "source", F.lit(None).cast("string").alias("symbol"), "content", F.array(*map(F.lit, scope[0])).cast("array<string>").alias("aliases"), F.array(*map(F.lit, scope[1])).cast("array<string>").alias("topics"))
    guarded = guards.verdicts(asked.where("error is null and intent <> 'out_of_scope'").select("qid", F.col("text").alias("query"), "intent"), facts)
    shown = F.struct(F.col("place").alias("rank"), F.concat(F.lit("E"), "place").alias("citation"), "item", "source", "role")
    listed = results.groupBy("qid").agg(F.array_sort(F.collect_list(shown)).alias("results"), F.collect_set("role").alias("roles"))  # k a query
    rows = asked.join(listed, "qid", "left").join(guarded.select("qid", "verdict"), "qid", "left").join(terms, "qid", "left")
    broken = evidence.contract(F.col("intent"), F.coalesce("roles", _none()))
    reason = F.when(F.col("error").isNotNull(), F.lit(None)).when(F.col("intent") == "out_of_scope", routing.refusal_reason(F.col("query"))).otherwise(F.coalesce(broken, F.col("verdict")))
    rows = rows.withColumn("refusal_reason", reason)
    notes: list[Column] = [F.when(F.col("text") != F.col("query"), F.lit("query normalised"))]
    if missing:
        notes.append(F.when(F.size("results") > 0, F.lit("retrieval degraded: " + ", ".join(missing))))
    if build_id is not None and build_id != index.facts["build_id"]:
        notes.append(F.lit("stale index"))
    empty = F.array().cast(listed.schema["results"].dataType)
    return rows.select(
        "qid", "error", "intent", "rule", (F.col("error").isNull() & F.col("refusal_reason").isNull()).alias("sufficient"), "refusal_reason", F.coalesce("terms", _none()).alias("terms"),
        F.array_compact(F.array(*notes)).alias("warnings"), F.coalesce("results", empty).alias("results"),
    )
