"""Evaluation of generated answers: coverage, failures, tokens, judge slots, retries, pairing, sampling of questions.

``records`` has a row for each question: id, answerable, refused, generated, attempted,
failure_code, retrieval_error, tokens and latencies. ``scores`` (id, family, metric, value)
and ``attempts`` (id, metric, number, code, attempted_at) are long. A value that is
missing is never a zero.
"""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .evaluate import bootstrap, ratio
from .scoring import logical_source, suffixes

# Metrics that a judge gives, and those computed from retrieval alone.
JUDGED = ("faithfulness", "answer_relevancy", "context_precision", "context_recall", "answer_correctness")
COMPUTED = ("hit", "required_claim_recall", "mrr", "source_precision", "option_recall")
LEAST_COVERAGE = 0.95


def eligible(family: str) -> Column:
    """Questions that a family of metrics counts: answerable ones, and for a judge those answered."""
    return F.col("answerable") & (F.col("generated") & ~F.col("refused") if family == "judged" else F.lit(True))


def metric_coverage(records: DataFrame, scores: DataFrame) -> DataFrame:
    """(family, metric, mean, n, eligible, coverage) of every metric that is asked for, also of one nobody has."""
    wanted = records.sparkSession.createDataFrame([("judged", m) for m in JUDGED] + [("computed", m) for m in COMPUTED], "family string, metric string")
    sizes = records.agg(F.count_if(eligible("judged")).alias("judged"), F.count_if(eligible("computed")).alias("computed"))
    ok = records.select("id", eligible("judged").alias("judged"), eligible("computed").alias("computed"))
    held = scores.where("value is not null").join(ok, "id").where(F.when(F.col("family") == "judged", F.col("judged")).otherwise(F.col("computed")))
    got = held.groupBy("family", "metric").agg(F.avg("value").alias("mean"), F.count("value").alias("n"))
    rows = wanted.join(got, ["family", "metric"], "left").crossJoin(F.broadcast(sizes))  # ten rows and one
    of = F.when(F.col("family") == "judged", F.col("judged")).otherwise(F.col("computed"))
    n = F.coalesce("n", F.lit(0))
    return rows.select("family", "metric", F.round("mean", 9).alias("mean"), n.alias("n"), of.alias("eligible"), F.round(ratio(n, of), 9).alias("coverage"))


def failure_histogram(records: DataFrame, attempts: DataFrame) -> DataFrame:
    """(kind, code, n): failures of runs, of retrieval metrics, and of judge calls."""
    runs = records.where("failure_code is not null").select(F.lit("run").alias("kind"), F.col("failure_code").alias("code"))
    retrieval = records.where("retrieval_error is not null").select(F.lit("retrieval").alias("kind"), F.col("retrieval_error").alias("code"))
    judge = attempts.where("code is not null").select(F.lit("judge").alias("kind"), F.when(F.col("code") == "", "unknown_judge_error").otherwise(F.col("code")).alias("code"))
    return runs.unionByName(retrieval).unionByName(judge).groupBy("kind", "code").agg(F.count(F.lit(1)).alias("n"))


def token_totals(records: DataFrame, fields: list[str]) -> DataFrame:
    """(field, total, mean_per_call, n) over calls that report the field; negative numbers are no report."""
    cols = [x for f in fields for x in (F.lit(f), F.when(F.col("attempted") & (F.col(f) >= 0), F.col(f).cast("long")))]
    long = records.select(F.stack(F.lit(len(fields)), *cols).alias("field", "tokens"))
    return long.groupBy("field").agg(F.sum("tokens").alias("total"), F.round(F.avg("tokens"), 9).alias("mean_per_call"), F.count("tokens").alias("n"))


def run_coverage(records: DataFrame, scores: DataFrame, attempts: DataFrame, least: float = LEAST_COVERAGE) -> DataFrame:
    """One row: coverage of runs, judge executions, computed and judged metrics, and whether they may be published.

    A judge slot (question, metric) is executed if it has a value or an attempt.
    """
    metrics = metric_coverage(records, scores)
    lows = metrics.agg(*(F.min(F.when(F.col("family") == f, F.col("coverage"))).alias(f"{f}_coverage") for f in ("judged", "computed")))
    ran = F.col("failure_code").isNull() & (F.col("refused") | F.col("generated") | F.col("attempted"))
    runs = records.agg(F.round(F.avg(ran.cast("double")), 9).alias("run_coverage"), (F.count_if(eligible("judged")) * len(JUDGED)).alias("judge_slots"))
    tried = scores.where("family = 'judged' and value is not null").select("id", "metric").unionByName(attempts.select("id", "metric")).where(F.col("metric").isin(*JUDGED)).distinct()
    done = tried.join(records.where(eligible("judged")).select("id"), "id", "left_semi").agg(F.count(F.lit(1)).alias("judge_executed"))
    rows = runs.crossJoin(done).crossJoin(lows)  # one row each
    share = F.when(F.col("judge_slots") == 0, 1.0).otherwise(F.round(F.col("judge_executed") / F.col("judge_slots"), 9))
    rows = rows.withColumn("execution_coverage", share)
    complete = (F.col("run_coverage") == 1) & (F.col("execution_coverage") == 1) & (F.col("computed_coverage") == 1)
    return rows.withColumn("complete", complete).withColumn("publishable", complete & (F.col("judged_coverage") >= least))


def retrieval_scores(samples: DataFrame, claims: DataFrame, results: DataFrame) -> DataFrame:
    """(id, status, hit, required_claim_recall, mrr, source_precision, option_recall) of each sample; null where it is not scored.

    samples: (id, answerable, retrieval_failed); claims: (id, claim_id, required, sources); results: (id, rank, source).
    A claim is supported by any of its sources; a source is matched by itself or by a path that ends in it. Only required
    claims count. Results of one logical source are one, the first. A sample is not_applicable if it cannot be answered,
    failed if its retrieval failed, it has no required claim, or a required claim has no source; else scored.
    """
    first = results.groupBy("id", logical_source(F.col("source")).alias("key")).agg(F.min("rank").alias("rank"))
    found = first.withColumn("place", F.row_number().over(Window.partitionBy("id").orderBy("rank", "key")))
    shown = found.groupBy("id").agg(F.count(F.lit(1)).alias("n_shown"))
    required = claims.where("required")
    options = required.select("id", "claim_id", F.explode("sources").alias("source")).select("id", "claim_id", logical_source(F.col("source")).alias("key"))
    wanted = required.groupBy("id").agg(F.count_distinct("claim_id").alias("n_claims"), F.bool_or(F.coalesce(F.size("sources"), F.lit(0)) <= 0).alias("bare"))
    asked = options.groupBy("id").agg(F.count_distinct("key").alias("n_options"))
    met = options.join(found.select("id", "place", F.explode(suffixes(F.col("key"))).alias("key")), ["id", "key"])
    got = met.groupBy("id").agg(F.count_distinct("claim_id").alias("m_claims"), F.count_distinct("key").alias("m_options"), F.count_distinct("place").alias("m_shown"), F.min("place").alias("first"))
    rows = samples.select("id", "answerable", "retrieval_failed")
    for part in (wanted, asked, shown, got):
        rows = rows.join(part, "id", "left")
    rows = rows.fillna(0, ["n_claims", "n_options", "n_shown", "m_claims", "m_options", "m_shown"])
    bad = F.coalesce("retrieval_failed", F.lit(False)) | (F.col("n_claims") == 0) | F.coalesce("bare", F.lit(False))
    status = F.when(~F.coalesce("answerable", F.lit(False)), "not_applicable").when(bad, "failed").otherwise("scored")
    only = lambda x: F.when(status == "scored", F.round(x, 9))
    return rows.select(
        "id", status.alias("status"), only(F.when(F.col("m_shown") > 0, 1.0).otherwise(0.0)).alias("hit"), only(ratio(F.col("m_claims"), F.col("n_claims"))).alias("required_claim_recall"),
        only(F.coalesce(1.0 / F.col("first"), F.lit(0.0))).alias("mrr"), only(ratio(F.col("m_shown"), F.col("n_shown"))).alias("source_precision"), only(ratio(F.col("m_options"), F.col("n_options"))).alias("option_recall"),
    )


def numbered_attempts(attempts: DataFrame) -> DataFrame:
    """Attempts with their number for each question and metric, by time."""
    return attempts.drop("number").withColumn("number", F.row_number().over(Window.partitionBy("id", "metric").orderBy("attempted_at", "code")))


def to_retry(records: DataFrame, scores: DataFrame, attempts: DataFrame, most: int = 3) -> DataFrame:
    """(id, metric, tries): judge slots without a value whose attempts are not used up; scores that are there never change."""
    slots = records.where(eligible("judged")).select("id").crossJoin(F.broadcast(records.sparkSession.createDataFrame([(m,) for m in JUDGED], "metric string")))  # five metrics a question
    open_ = slots.join(scores.where("family = 'judged' and value is not null").select("id", "metric"), ["id", "metric"], "left_anti")
    tries = attempts.groupBy("id", "metric").agg(F.count(F.lit(1)).alias("tries"))
    return open_.join(tries, ["id", "metric"], "left").fillna(0, ["tries"]).where(F.col("tries") < most)


def resume(questions: DataFrame, done: DataFrame, experiment: str, key: str = "id") -> DataFrame:
    """Questions that an experiment's finished records (experiment_id, key) do not have yet."""
    return questions.join(done.where(F.col("experiment_id") == experiment).select(key), key, "left_anti")


def paired(baseline: DataFrame, candidate: DataFrame, metrics: list[str], key: str = "id") -> DataFrame:
    """(metric, n, mean_delta, ci_low, ci_high, n_better, n_worse) of candidate - baseline over questions where both have a value."""
    b = baseline.select(key, *(F.col(m).alias(f"_{m}") for m in metrics))
    rows = candidate.join(b, key)
    cols = [x for m in metrics for x in (F.lit(m), (F.col(m) - F.col(f"_{m}")).cast("double"))]
    long = rows.select(key, F.stack(F.lit(len(metrics)), *cols).alias("metric", "delta"))
    summed = long.groupBy("metric").agg(F.count("delta").alias("n"), F.round(F.avg("delta"), 9).alias("mean_delta"), F.count_if(F.col("delta") > 0).alias("n_better"), F.count_if(F.col("delta") < 0).alias("n_worse"))
    return summed.join(bootstrap(long, key, "delta", ["metric"]), "metric", "left")


def unpaired(baseline: DataFrame, candidate: DataFrame, key: str = "id") -> DataFrame:
    """(key, only_in): questions of one side only; two runs are comparable if there are none."""
    one, two = baseline.select(key).distinct(), candidate.select(key).distinct()
    return one.exceptAll(two).withColumn("only_in", F.lit("baseline")).unionByName(two.exceptAll(one).withColumn("only_in", F.lit("candidate")))


def difficulty(route: Column, points: Column, sources: Column) -> Column:
    return F.when((route == "comparison") | (points >= 4) | (sources >= 3), "hard").when((points >= 2) | (sources >= 2), "medium").otherwise("easy")


def variant(answerable: Column, route: Column) -> Column:
    return F.when(~answerable, "boundary").when(route == "comparison", "multi_hop").otherwise("canonical")


def folded_question(text: Column) -> Column:
    """A question for leakage checks: compatibility forms joined, case folded, without punctuation and separators."""

    @F.pandas_udf("string")
    def joined(values: pd.Series) -> pd.Series:
        return values.map(lambda t: None if t is None else unicodedata.normalize("NFKC", t).casefold())

    # nothing but ASCII has only one form, so most texts never leave the JVM
    plain = ~text.rlike(r"[^\x00-\x7F]")
    return F.regexp_replace(F.when(plain, F.lower(text)).otherwise(joined(F.when(~plain, text))), r"[\p{P}\p{Z}]", "")


def leaks(questions: DataFrame) -> DataFrame:
    """(kind, value, n, n_splits) of ids and folded questions (id, question, split) that stand more than once."""
    of = lambda kind, value: questions.select(F.lit(kind).alias("kind"), value.alias("value"), "split")
    rows = of("id", F.col("id").cast("string")).unionByName(of("question", folded_question(F.col("question"))))
    return rows.groupBy("kind", "value").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("split").alias("n_splits")).where("n > 1")


def inside_corpus(paths: DataFrame, roots: list[str]) -> DataFrame:
    """Evaluation files (path) that lie in an indexed folder, and would leak their answers."""
    bad = F.lit(False)
    for root in roots:
        bad |= (F.col("path") == root.rstrip("/")) | F.col("path").startswith(root.rstrip("/") + "/")
    return paths.where(bad)
