"""Evaluation: ranking metrics, refusals, macro F1, percentiles, deltas, paired bootstrap."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import few, small

BOOTSTRAP_ROUNDS, BOOTSTRAP_SEED = 2000, 20260813


def ratio(a: Column, b: Column) -> Column:
    """a / b, 0.0 if b is 0."""
    return F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(0.0))


def ranking_metrics(queries: DataFrame, results: DataFrame, relevant: DataFrame, k: int, qid: str = "qid", item: str = "doc_id") -> DataFrame:
    """(qid, n_relevant, hit, recall, precision, reciprocal_rank, ndcg) at k for every query.

    ``relevant``: (qid, item, grade); gains are 2^grade - 1, the ideal order is by grade. A query
    without relevant items has null metrics, so it never counts as a miss.
    """
    found = results.where(F.col("rank") <= k).join(relevant, [qid, item])
    gain = F.pow(F.lit(2.0), F.col("grade")) - 1
    got = found.groupBy(qid).agg(F.count(F.lit(1)).alias("n_hit"), F.min("rank").alias("first"), F.sum(gain / F.log2(F.col("rank") + 1.0)).alias("dcg"))
    ranked = relevant.withColumn("r", F.row_number().over(Window.partitionBy(qid).orderBy(F.desc("grade"), F.asc(item))))
    ideal = ranked.groupBy(qid).agg(F.count(F.lit(1)).alias("n_relevant"), F.sum(F.when(F.col("r") <= k, gain / F.log2(F.col("r") + 1.0))).alias("ideal"))
    returned = results.where(F.col("rank") <= k).groupBy(qid).agg(F.count(F.lit(1)).alias("n_returned"))
    rows = queries.select(qid).join(ideal, qid, "left").join(got, qid, "left").join(returned, qid, "left")
    has = F.col("n_relevant") > 0
    hits = F.coalesce("n_hit", F.lit(0))
    return rows.select(
        qid, F.coalesce("n_relevant", F.lit(0)).alias("n_relevant"),
        F.when(has, F.when(hits > 0, 1.0).otherwise(0.0)).alias("hit"),
        F.when(has, ratio(hits, F.col("n_relevant"))).alias("recall"),
        F.when(has, ratio(hits, F.coalesce("n_returned", F.lit(0)))).alias("precision"),
        F.when(has, F.coalesce(1.0 / F.col("first"), F.lit(0.0))).alias("reciprocal_rank"),
        F.when(has, F.round(ratio(F.coalesce("dcg", F.lit(0.0)), F.col("ideal")), 9)).alias("ndcg"),
    )


ANCHOR = 5


def holders(docs: DataFrame, passages: DataFrame) -> DataFrame:
    """(qid, doc_id) of every document (doc_id, text) that holds a passage (qid, query) verbatim.

    The words of a passage but its first and last are whole words of a text that holds it, so the second to
    sixth are looked up by their hash among all runs of five words; only what meets there is compared. Passages
    of fewer words, a stated set, are held against every text.
    """
    asked = passages.where("query is not null").withColumn("w", F.split("query", " "))
    long_ = asked.where(F.size("w") >= ANCHOR + 2).select("qid", "query", F.xxhash64(F.array_join(F.slice("w", 2, ANCHOR), " ")).alias("h"))
    words = docs.where("text is not null").select("doc_id", F.split("text", " ").alias("w")).where(F.size("w") >= ANCHOR + 2)
    runs = F.transform(F.sequence(F.lit(1), F.size("w") - ANCHOR + 1), lambda i: F.xxhash64(F.array_join(F.slice("w", i, F.lit(ANCHOR)), " ")))
    met = words.select("doc_id", F.explode(F.array_distinct(runs)).alias("h")).join(small(long_.select("qid", "h")), "h").select("qid", "doc_id").distinct()
    held = met.join(docs.select("doc_id", "text"), "doc_id").join(small(long_.select("qid", "query")), "qid").where(F.contains("text", "query")).select("qid", "doc_id")
    short = asked.where(F.size("w") < ANCHOR + 2).select("qid", "query")
    return held.unionByName(docs.join(F.broadcast(short) if few(short) else short, F.contains("text", "query")).select("qid", "doc_id"))


def mean_present(x: str) -> Column:
    """Mean of the values that are there; 0.0 if none is."""
    return F.coalesce(F.avg(x), F.lit(0.0))


def binary_scores(rows: DataFrame, truth: Column, said: Column, by: list[str] | None = None) -> DataFrame:
    """(by, tp, fp, fn, precision, recall, f1) with 0.0 where a denominator is 0."""
    counted = rows.groupBy(*(by or [])).agg(F.count_if(truth & said).alias("tp"), F.count_if(~truth & said).alias("fp"), F.count_if(truth & ~said).alias("fn"))
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    return counted.select(*(by or []), "tp", "fp", "fn", F.round(ratio(tp, tp + fp), 9).alias("precision"), F.round(ratio(tp, tp + fn), 9).alias("recall"), F.round(ratio(2 * tp, 2 * tp + fp + fn), 9).alias("f1"))


def macro_f1(rows: DataFrame, truth: str, said: str) -> DataFrame:
    """(n_labels, macro_f1): the mean F1 over the labels that are expected somewhere.

    Counted by (truth, said) pairs first, so the rest works on a few rows.
    """
    pairs = rows.where(F.col(truth).isNotNull()).groupBy(F.col(truth).alias("t"), F.col(said).alias("s")).agg(F.count(F.lit(1)).alias("n"))
    own = pairs.groupBy(F.col("t").alias("label")).agg(F.sum("n").alias("expected"), F.sum(F.when(F.col("t") == F.col("s"), F.col("n")).otherwise(0)).alias("tp"))
    predicted = pairs.groupBy(F.col("s").alias("label")).agg(F.sum("n").alias("predicted"))
    each = own.join(predicted, "label", "left").select(ratio(2 * F.col("tp"), F.col("expected") + F.coalesce("predicted", F.lit(0))).alias("f1"))
    return each.agg(F.count(F.lit(1)).alias("n_labels"), F.round(F.coalesce(F.avg("f1"), F.lit(0.0)), 9).alias("macro_f1"))


QUANTILES = {"p50": 0.5, "p95": 0.95, "p99": 0.99}
BLOCKS = 200


def percentiles(rows: DataFrame, value: str, by: list[str]) -> DataFrame:
    """(by, n, mean, p50, p95, p99): exact, linearly interpolated.

    Approximate edges cut each group into BLOCKS ranges whose sizes are counted; only the ranges that hold a
    wanted rank are sorted, so no buffer ever holds a group's values. Equal values are counted first.
    """
    counted = rows.where(F.col(value).isNotNull()).groupBy(*by, F.col(value).alias("v")).agg(F.count(F.lit(1)).alias("c"))
    whole = rows.where(F.col(value).isNotNull()).groupBy(*by).agg(
        F.count(value).alias("n"), F.round(F.avg(value), 6).alias("mean"), F.percentile_approx(value, F.array(*(F.lit(k / BLOCKS) for k in range(1, BLOCKS))), 10 * BLOCKS).alias("edges")
    )
    blocked = counted.join(whole.select(*by, "edges"), by).withColumn("block", F.size(F.filter("edges", lambda e: e < F.col("v")))).drop("edges")
    earlier = lambda w: F.coalesce(F.sum("c").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    sizes = blocked.groupBy(*by, "block").agg(F.sum("c").alias("c")).withColumn("base", earlier(Window.partitionBy(*by).orderBy("block")))  # BLOCKS rows a group
    sides = [(f"{name}{side}", f((F.col("n") - 1) * F.lit(q)).cast("long")) for name, q in QUANTILES.items() for side, f in (("l", F.floor), ("h", F.ceil))]
    wanted = whole.select(*by, F.explode(F.array(*(F.struct(F.lit(side).alias("side"), at.alias("at")) for side, at in sides))).alias("x")).select(*by, "x.*")
    target = sizes.join(wanted, by).where((F.col("at") >= F.col("base")) & (F.col("at") < F.col("base") + F.col("c"))).select(*by, "block", "base", "side", "at")
    inside = blocked.join(target.select(*by, "block", "base").distinct(), [*by, "block"]).withColumn("first", F.col("base") + earlier(Window.partitionBy(*by, "block").orderBy("v"))).drop("base")
    found = inside.join(target.drop("base"), [*by, "block"]).where((F.col("at") >= F.col("first")) & (F.col("at") < F.col("first") + F.col("c")))
    ends = found.groupBy(*by).agg(*(F.max(F.when(F.col("side") == side, F.col("v"))).cast("double").alias(side) for side, _ in sides))
    part = lambda q: (F.col("n") - 1) * F.lit(q) - F.floor((F.col("n") - 1) * F.lit(q))
    return whole.drop("edges").join(ends, by).select(*by, "n", "mean", *(F.round(F.col(f"{name}l") + (F.col(f"{name}h") - F.col(f"{name}l")) * part(q), 6).alias(name) for name, q in QUANTILES.items()))


def deltas(summary: DataFrame, strategy: str, baseline: str, metrics: list[str]) -> DataFrame:
    """Each strategy's metrics with their difference from the baseline row."""
    base = summary.where(F.col(strategy) == baseline).select(*(F.col(m).alias(f"_{m}") for m in metrics))
    rows = summary.crossJoin(F.broadcast(base))  # one row
    return rows.select(strategy, *metrics, *(F.round(F.col(m) - F.col(f"_{m}"), 9).alias(f"delta_{m}") for m in metrics))


#: Shares below which a Poisson variable of mean 1 is 0, at most 1, and so on, in units of 2**-32.
POISSON = tuple(int(c * 2**32) for c in (0.36787944117, 0.73575888234, 0.91969860293, 0.98101184312, 0.99634015317, 0.99940581518))
_DRAWN = 128


def mixed(x: np.ndarray) -> np.ndarray:
    """A 32-bit integer hash of 32-bit integers, held as 64-bit ones."""
    low = np.uint64(0xFFFFFFFF)
    x = ((x ^ (x >> np.uint64(16))) * np.uint64(0x7FEB352D)) & low
    x = ((x ^ (x >> np.uint64(15))) * np.uint64(0x846CA68B)) & low
    return x ^ (x >> np.uint64(16))


def bootstrap(rows: DataFrame, key: str, value: str, by: list[str], rounds: int = BOOTSTRAP_ROUNDS, seed: int = BOOTSTRAP_SEED) -> DataFrame:
    """(by, ci_low, ci_high): the 95 % interval of the mean of a value over resampled questions, rounded to 6 places.

    A question's weight in a round is a Poisson variable made of a hash of (seed, round, question), so it is the same
    wherever the question lies. Each task sums up its questions, a block at a time, and sends ``rounds`` sums a group.
    Null values take no part.
    """
    number = F.conv(F.substring(F.sha2(F.col(key).cast("string"), 256), 1, 8), 16, 10).cast("long")
    each = rows.where(F.col(value).isNotNull()).select(*by, number.alias("i"), F.col(value).cast("double").alias("d"))
    kinds = dict(each.dtypes)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        offsets = (np.arange(1, rounds + 1, dtype=np.uint64) * np.uint64(0x9E3779B9) + np.uint64(seed)) & np.uint64(0xFFFFFFFF)
        sums: dict[tuple, np.ndarray] = {}
        for frame in frames:
            for group, some in frame.groupby(by, dropna=False) if by else [((), frame)]:
                total = sums.setdefault(tuple(group), np.zeros((2, rounds)))
                i, d = some.i.to_numpy().astype(np.uint64), some.d.to_numpy()
                for at in range(0, len(i), _DRAWN):
                    u = mixed((i[at : at + _DRAWN, None] + offsets) & np.uint64(0xFFFFFFFF))
                    weight = np.searchsorted(np.array(POISSON, np.uint64), u.ravel(), "right").reshape(u.shape)
                    total += np.stack([d[at : at + _DRAWN] @ weight, weight.sum(axis=0)])
        for group, total in sums.items():
            yield pd.DataFrame(dict(zip(by, group, strict=True)) | {"round": np.arange(1, rounds + 1), "wd": total[0], "w": total[1]})

    schema = ", ".join([*(f"{c} {kinds[c]}" for c in by), "round int, wd double, w double"])
    means = each.mapInPandas(run, schema).groupBy(*by, "round").agg(ratio(F.sum("wd"), F.sum("w")).alias("m"))
    at = lambda q: F.round(F.percentile("m", F.lit(q)), 6)  # noqa: E731  ``rounds`` values a group
    return means.groupBy(*by).agg(at(0.025).alias("ci_low"), at(0.975).alias("ci_high"))


def paired_bootstrap(pairs: DataFrame, key: str, base: str, candidate: str, rounds: int = BOOTSTRAP_ROUNDS, seed: int = BOOTSTRAP_SEED) -> DataFrame:
    """(n, mean_delta, ci_low, ci_high) of candidate - base over questions with both values."""
    rows = pairs.select(key, (F.col(candidate) - F.col(base)).alias("d")).where("d is not null")
    total = rows.agg(F.count(F.lit(1)).alias("n"), F.avg("d").alias("mean_delta"))
    return total.crossJoin(F.broadcast(bootstrap(rows, key, "d", [], rounds, seed)))  # one row each


def stratified(rows: DataFrame, stratum: str, key: str, n: int, seed: str) -> DataFrame:
    """(stratum, key, turn): n rows taken in turn from the strata, each in the order of SHA-256(seed NUL key)."""
    order = F.sha2(F.concat_ws("\0", F.lit(seed), F.col(key).cast("string")), 256)
    # no stratum can give more than n rows, so each is limited before they are put in turn
    each = rows.select(stratum, key).withColumn("turn", F.row_number().over(Window.partitionBy(stratum).orderBy(order, key))).where(F.col("turn") <= n)
    return each.orderBy("turn", stratum).limit(n)
