"""Scores of ranked predictions against labelled questions, and their aggregation for each strategy.

Tables are in long form: ``truth`` (sample_id, kind, source) with kind primary or
supporting, ``results`` (strategy, sample_id, rank, source, symbol, live) and
``samples`` with a row for each question. A path is matched by every end of it, so sources
meet by an equi-join of the ends with what is expected.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import casefold
from .common import small
from .evaluate import percentiles, ratio
from .workspace import written

RAW_FACTOR = 3
# Other names of the routes.
ROUTE_NAMES = {"internal": "implementation", "code": "implementation", "project_design": "design", "external": "official", "spec": "official", "abstain": "out_of_scope", "unanswerable": "out_of_scope"}
# What an intent's name holds if it asks for design.
DESIGN_MARKS = ("architecture", "boundary", "maturity", "differentiate", "inventory_current")
SYMBOL_CATEGORY = "code_symbol_call_chain"
IDENTIFIER = r"[A-Za-z_][A-Za-z0-9_]*(?:\.[A-Za-z_][A-Za-z0-9_]*)*"


def route_name(x: Column) -> Column:
    """A route's one name: trimmed, case folded, dashes as underscores, other names replaced."""
    text = F.replace(casefold(F.trim(F.coalesce(x, F.lit("")))), F.lit("-"), F.lit("_"))
    return F.coalesce(*(F.when(text == k, F.lit(v)) for k, v in ROUTE_NAMES.items()), text)


def expected_route(label: Column, intent: Column, scope: Column, category: Column, answerable: Column) -> Column:
    """The route that a question should take; empty if it has none."""
    intent, scope = casefold(F.coalesce(intent, F.lit(""))), casefold(F.coalesce(scope, F.lit("")))
    design = F.lit(False)
    for mark in DESIGN_MARKS:
        design |= F.contains(intent, F.lit(mark))
    return (
        F.when(F.coalesce(label, F.lit("")) != "", route_name(label)).when(~answerable | F.contains(intent, F.lit("unanswerable")), "")
        .when(F.contains(intent, F.lit("comparison")), "comparison").when(scope.startswith("official") | category.startswith("official_"), "official")
        .when(design, "design").otherwise("implementation")
    )


def source_key(x: Column) -> Column:
    """One spelling of a source: of a URL scheme and host in lower case, path without end slash, query, no fragment; of a path its parts in lower case."""
    text = F.replace(F.trim(x), F.lit("\\"), F.lit("/"))
    part = lambda k: F.regexp_extract(text, r"^([A-Za-z][A-Za-z0-9+.-]*)://([^/?#]*)([^?#]*)(\?[^#]+)?", k)
    path = F.regexp_replace(part(3), "/+$", "")
    url = F.concat(F.lower(part(1)), F.lit("://"), F.lower(part(2)), F.when(path == "", "/").otherwise(path), part(4))
    parts = F.filter(F.split(text, "/"), lambda p: (p != "") & (p != "."))
    return F.when(F.lower(part(1)).isin("http", "https"), url).otherwise(casefold(F.array_join(parts, "/")))


def source_match(expected: Column, actual: Column) -> Column:
    """Whether two source keys name one source: equal, or a path that ends in the expected one."""
    return (expected == actual) | ~expected.rlike("^https?://") & actual.endswith(F.concat(F.lit("/"), expected))


def logical_source(x: Column) -> Column:
    """One spelling of a source whose place in a file does not matter: of a path its parts in lower case without a fragment; a URL keeps query and fragment."""
    text = F.replace(F.trim(x), F.lit("\\"), F.lit("/"))
    part = lambda k: F.regexp_extract(text, r"^([A-Za-z][A-Za-z0-9+.-]*)://([^/?#]*)([^?#]*)(\?[^#]+)?(#.+)?", k)
    path = F.regexp_replace(part(3), "/+$", "")
    url = F.concat(F.lower(part(1)), F.lit("://"), F.lower(part(2)), F.when(path == "", "/").otherwise(path), part(4), part(5))
    parts = F.filter(F.split(F.substring_index(text, "#", 1), "/"), lambda p: (p != "") & (p != "."))
    return F.when(F.lower(part(1)).isin("http", "https"), url).otherwise(casefold(F.array_join(parts, "/")))


def suffixes(key: Column) -> Column:
    """The expected keys that a source key matches: itself and every end of whole parts, none of which is a URL."""
    parts = F.split(key, "/")
    return F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, i, F.size(parts)), "/"))


def symbol_match(expected: Column, actual: Column) -> Column:
    """Whether a symbol is the expected one, or a member of that name."""
    e, a = F.trim(expected), F.trim(actual)
    return (e == a) | a.endswith(F.concat(F.lit("."), e))


def report_source(source: Column, relative: Column) -> Column:
    """The source as a report may show it: relative to the repository, or a URL; null for a local absolute path, which must not be shown."""
    shown = F.replace(F.trim(source), F.lit("\\"), F.lit("/"))
    bare = F.replace(F.trim(relative), F.lit("\\"), F.lit("/"))
    return F.when(bare != "", bare).when(shown.rlike("(?i)^https?://"), shown).when(shown.rlike("^[A-Za-z]:/") | shown.startswith("/"), F.lit(None)).otherwise(shown)


def explicit_symbols(question: Column, category: Column, labelled: Column) -> Column:
    """Symbols that a question asks for: the labelled ones, else of a symbol question its dotted, underscored and camel-case names."""
    named = F.filter(F.regexp_extract_all(question, F.lit(IDENTIFIER), F.lit(0)), lambda t: F.contains(t, F.lit(".")) | F.contains(t, F.lit("_")) | t.rlike("[a-z]") & t.rlike("^.+[A-Z]"))
    return F.when(F.size(labelled) > 0, labelled).when(category == SYMBOL_CATEGORY, F.array_distinct(named)).otherwise(F.array().cast("array<string>"))


def first_of_each_source(results: DataFrame, k: int) -> DataFrame:
    """(.., key, place): of the first 3 k raw results the first of each source, then the first k of them with their new rank."""
    by = ["strategy", "sample_id"]
    raw = results.where(F.col("rank") <= k * RAW_FACTOR).withColumn("key", source_key(F.col("source")))
    once = raw.withColumn("_n", F.row_number().over(Window.partitionBy(*by, "key").orderBy("rank"))).where("_n = 1").drop("_n")
    return once.withColumn("place", F.row_number().over(Window.partitionBy(*by).orderBy("rank"))).where(F.col("place") <= k)


def scored(samples: DataFrame, truth: DataFrame, results: DataFrame, strategies: DataFrame, k: int) -> DataFrame:
    """Metrics of each strategy and sample; those that do not apply are null.

    strategies: (strategy). samples: (sample_id, ..). primary_recall, hit, supporting_recall, reciprocal_rank,
    ndcg (gains 2 ^ grade - 1 with grade 2 for primary and 1 for supporting sources), citation_precision, live_hit.
    """
    by = ["strategy", "sample_id"]
    found = first_of_each_source(results, k)
    wanted = truth.select("sample_id", "kind", source_key(F.col("source")).alias("want")).distinct()
    ends = found.withColumn("want", F.explode(suffixes(F.col("key"))))  # a match is one of its ends, so the join is on equal keys
    pairs = ends.join(wanted, ["sample_id", "want"])
    graded = pairs.groupBy(*by, "place").agg(F.max(F.when(F.col("kind") == "primary", 2).otherwise(1)).alias("grade"), F.max("live").alias("live"))
    gain = (F.pow(F.lit(2.0), F.col("grade")) - 1) / F.log2(F.col("place") + 1.0)
    got = graded.groupBy(*by).agg(
        F.sum(gain).alias("dcg"), F.min(F.when(F.col("grade") == 2, F.col("place"))).alias("first"), F.count(F.lit(1)).alias("cited"),
        F.coalesce(F.bool_or((F.col("grade") == 2) & F.col("live")), F.lit(False)).alias("live_hit"),
    )
    of = lambda kind: F.count_distinct(F.when(F.col("kind") == kind, F.col("want")))
    matched = pairs.groupBy(*by).agg(of("primary").alias("m1"), of("supporting").alias("m2"))
    sizes = wanted.groupBy("sample_id").agg(F.count_if(F.col("kind") == "primary").alias("n1"), F.count_if(F.col("kind") == "supporting").alias("n2"))
    shown = found.groupBy(*by).agg(F.count(F.lit(1)).alias("shown"))
    rows = samples.crossJoin(small(strategies)).join(sizes, "sample_id", "left")  # a handful of strategies
    for part in (matched, got, shown):
        rows = rows.join(part, by, "left")
    rows = rows.fillna(0, ["n1", "n2", "m1", "m2", "dcg", "cited", "shown"]).fillna(False, ["live_hit"])
    n1, n2 = F.col("n1"), F.col("n2")
    discount = lambda lo, hi: F.aggregate(F.when(hi >= lo, F.sequence(lo, hi)).otherwise(F.array().cast("array<bigint>")), F.lit(0.0), lambda s, i: s + 1 / F.log2(i + 1.0))
    top1, top2 = F.least(n1, F.lit(k).cast("long")), F.least(n1 + n2, F.lit(k).cast("long"))
    ideal = 3 * discount(F.lit(1).cast("long"), top1) + discount(top1 + 1, top2)
    primary = lambda x: F.when(n1 > 0, x)
    return rows.select(
        *by, *[c for c in samples.columns if c != "sample_id"],
        primary(ratio(F.col("m1"), n1)).alias("primary_recall"), primary(F.when(F.col("m1") > 0, 1.0).otherwise(0.0)).alias("hit"),
        F.when(n2 > 0, ratio(F.col("m2"), n2)).alias("supporting_recall"), primary(F.coalesce(1.0 / F.col("first"), F.lit(0.0))).alias("reciprocal_rank"),
        primary(F.round(ratio(F.col("dcg"), ideal), 9)).alias("ndcg"), F.when(F.col("shown") > 0, ratio(F.col("cited"), F.col("shown"))).alias("citation_precision"), primary(F.col("live_hit")).alias("live_hit"),
    )


def symbol_recall(symbols: DataFrame, results: DataFrame, k: int) -> DataFrame:
    """(strategy, sample_id, n_symbols, n_matched): asked symbols (sample_id, symbol) that the first k results name."""
    named = results.where((F.col("rank") <= k) & F.col("symbol").isNotNull()).select("strategy", "sample_id", F.col("symbol").alias("has"))
    asked = symbols.distinct().join(small(results.select("strategy").distinct()))
    hits = asked.join(named, ["strategy", "sample_id"]).where(symbol_match(F.col("symbol"), F.col("has"))).select("strategy", "sample_id", "symbol").distinct().withColumn("hit", F.lit(1))
    return asked.join(hits, ["strategy", "sample_id", "symbol"], "left").groupBy("strategy", "sample_id").agg(F.count(F.lit(1)).alias("n_symbols"), F.count("hit").alias("n_matched"))


def strategy_summary(rows: DataFrame) -> DataFrame:
    """One row of aggregates for each strategy, of the rows of ``scored`` with predictions.

    Beside the metrics: answerable, refused, wanted_route, found_route, oracle_route, wanted_reason, found_reason, latency_ms,
    symbol_recall. A metric that does not apply to a question is left out of its mean; percentiles are
    exact and interpolated.
    """
    rows = written(rows, "scored")  # the percentiles read it several times
    mean = lambda c: F.round(F.coalesce(F.avg(F.col(c).cast("double")), F.lit(0.0)), 9)
    answerable, refused = F.col("answerable"), F.col("refused")
    routed = ~F.col("oracle_route") & (F.col("wanted_route") != "")
    tp, fp, un, an = F.count_if(~answerable & refused), F.count_if(answerable & refused), F.count_if(~answerable), F.count_if(answerable)
    right = F.count_if(~answerable & refused & F.coalesce(F.col("wanted_reason") == F.col("found_reason"), F.lit(False)))
    live = F.when(F.col("wanted_route").isin("implementation", "comparison"), F.col("live_hit").cast("double"))
    rounded = lambda x: F.round(x, 9)
    summed = rows.groupBy("strategy").agg(
        rounded(F.avg(F.when(routed, (F.col("wanted_route") == F.col("found_route")).cast("double")))).alias("routing_accuracy"),
        *(mean(c).alias(c) for c in ("primary_recall", "hit", "supporting_recall", "ndcg", "citation_precision", "symbol_recall")),
        rounded(F.coalesce(F.avg(live), F.lit(0.0))).alias("live_hit"), mean("reciprocal_rank").alias("mrr"),
        rounded(ratio(tp, un)).alias("refusal_recall"), rounded(ratio(fp, an)).alias("answerable_refusal_rate"), rounded(ratio(tp, tp + fp)).alias("refusal_precision"),
        rounded(ratio(2 * tp, tp + fp + un)).alias("refusal_f1"), rounded(ratio(right, tp)).alias("refusal_reason_accuracy"), rounded(ratio(right, un)).alias("refusal_reason_recall"),
        mean("latency_ms").alias("mean_latency_ms"),
        F.count(F.lit(1)).alias("question_count"), F.count_if(routed).alias("routing_eligible"), F.count("primary_recall").alias("file_eligible"), F.count("symbol_recall").alias("symbol_eligible"), un.alias("unanswerable_count"),
    )
    latency = percentiles(rows, "latency_ms", ["strategy"]).select("strategy", "p50", "p95", "p99")
    out = summed.join(latency, "strategy", "left")
    return out.withColumnsRenamed({p: f"{p}_latency_ms" for p in ("p50", "p95", "p99")}).fillna(0.0, [f"{p}_latency_ms" for p in ("p50", "p95", "p99")])


def route_macro_f1(rows: DataFrame) -> DataFrame:
    """(strategy, routing_macro_f1): mean F1 over the routes that are expected somewhere; counted by pairs first."""
    pairs = rows.where(~F.col("oracle_route") & (F.col("wanted_route") != "")).groupBy("strategy", F.col("wanted_route").alias("t"), F.col("found_route").alias("s")).agg(F.count(F.lit(1)).alias("n"))
    own = pairs.groupBy("strategy", F.col("t").alias("label")).agg(F.sum("n").alias("expected"), F.sum(F.when(F.col("t") == F.col("s"), F.col("n")).otherwise(0)).alias("tp"))
    said = pairs.groupBy("strategy", F.col("s").alias("label")).agg(F.sum("n").alias("said"))
    each = own.join(said, ["strategy", "label"], "left")
    return each.groupBy("strategy").agg(F.round(F.avg(ratio(2 * F.col("tp"), F.col("expected") + F.coalesce("said", F.lit(0)))), 9).alias("routing_macro_f1"))


def contract_violations(runs: DataFrame) -> DataFrame:
    """(check, violations) of a suite's runs (strategy, build_id, embedding_model, top_k, n_questions, failed): runs that are compared share all of these, and each ran."""
    one = lambda c: F.greatest(F.count_distinct(c) - 1, F.lit(0))
    row = runs.agg(*(one(c).alias(c) for c in ("build_id", "embedding_model", "top_k", "n_questions")), F.count_if("failed").alias("failed"), (F.count(F.lit(1)) - F.count_distinct("strategy")).alias("strategy"))
    return row.unpivot([], row.columns, "check", "violations")
