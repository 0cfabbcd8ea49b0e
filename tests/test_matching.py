"""Look-ups without nested loops: runs of characters, ends of paths; draws of the bootstrap; scores of retrieval."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from sievewright.operators import evaluate, live, patterns, responses, scoring


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_holding_is_containment(spark):
    rng = random.Random(6)
    word = lambda k: "".join(rng.choice("abC é") for _ in range(rng.randrange(k)))
    texts = [(i, word(30)) for i in range(150)] + [(200, None), (201, ""), (202, "ABC"), (203, "ABC")]
    asked = [(i, word(6)) for i in range(60)] + [(90, None), (91, ""), (92, "zzz"), (93, "x" * 40), (94, "abc"), (95, "É")]
    rows, queries = spark.createDataFrame(texts, "id long, subject string").repartition(3), spark.createDataFrame(asked, "qid long, query string")
    got = patterns.holding(rows, "id", "subject", queries)
    want = {(q, i) for q, a in asked for i, t in texts if a and t is not None and a.lower() in t.lower()}
    pairs = [(r.qid, r.id) for r in got.collect()]
    assert set(pairs) == want and len(pairs) == len(want) and len(want) > 100
    assert "NestedLoop" not in plan_of(got) and "Cartesian" not in plan_of(got)
    assert patterns.holding(rows, "id", "subject", queries.where("false")).count() == 0


def test_commits(spark):
    history = spark.createDataFrame([("a", 1, "Fix the Loader"), ("b", 3, "fix loader again"), ("c", 2, "docs")], "commit_sha string, committed_at long, subject string")
    asked = spark.createDataFrame([(1, " LOADER "), (2, "x\ny"), (3, ""), (4, "do")], "qid long, query string")
    got = live.commits(history, asked, 5)
    assert [(r.qid, r.commit_sha, r["rank"], r.score) for r in got.orderBy("qid", "rank").collect()] == [(1, "b", 1, 1.0), (1, "a", 2, 0.5), (4, "c", 1, 1.0)]
    assert "NestedLoop" not in plan_of(got)


def test_ends_of_paths_are_what_a_path_matches(spark):
    keys = ["a/b/c.py", "c.py", "b/c.py", "xb/c.py", "a/b/c.py/c.py", "https://h/b/c.py", "https://h/c.py", "", "h/c.py"]
    df = spark.createDataFrame([(k,) for k in keys], "key string")
    ends = {r.key: set(r.ends) for r in df.select("key", scoring.suffixes(F.col("key")).alias("ends")).collect()}
    pairs = df.crossJoin(df.withColumnRenamed("key", "want")).withColumn("m", scoring.source_match(F.col("want"), F.col("key"))).where("want <> ''").collect()
    for r in pairs:
        assert (r.want in ends[r.key]) == r.m, (r.want, r.key)


def test_logical_sources(spark):
    cases = {"./Docs\\A.md#symbol:X.y": "docs/a.md", "HTTPS://Ex.org/Doc/#part": "https://ex.org/Doc#part", "https://ex.org": "https://ex.org/", "a//b/./C.py": "a/b/c.py", " https://ex.org/a?q=1#f ": "https://ex.org/a?q=1#f"}
    df = spark.createDataFrame([(k,) for k in cases], "s string")
    assert {r.s: r.k for r in df.select("s", scoring.logical_source(F.col("s")).alias("k")).collect()} == cases


def test_retrieval_scores(spark):
    samples = spark.createDataFrame([(1, True, False), (2, True, True), (3, False, False), (4, True, False), (5, True, False), (6, True, None), (7, None, None)], "id long, answerable boolean, retrieval_failed boolean")
    claims = spark.createDataFrame(
        [(1, "a", True, ["docs/a.md", "b.md"]), (1, "b", True, ["gone.md"]), (1, "c", False, ["x.md"]), (2, "a", True, ["a.md"]), (4, "a", False, ["a.md"]), (5, "a", True, []), (5, "b", True, ["a.md"]), (6, "a", True, ["https://h/p#two"])],
        "id long, claim_id string, required boolean, sources array<string>",
    )
    results = spark.createDataFrame(
        [(1, 1, "other.md"), (1, 2, "Repo/docs/A.md#symbol:F"), (1, 3, "repo/docs/a.md"), (1, 4, "y/b.md"), (1, 5, "x.md"), (2, 1, "a.md"), (6, 1, "https://h/p#one")],
        "id long, rank int, source string",
    )
    got = {r.id: tuple(r)[1:] for r in responses.retrieval_scores(samples, claims, results).collect()}
    assert got[1] == ("scored", 1.0, 0.5, 0.5, 0.5, pytest.approx(2 / 3, abs=1e-8))
    assert [got[k][0] for k in (2, 3, 4, 5, 7)] == ["failed", "not_applicable", "failed", "failed", "not_applicable"] and all(got[k][1:] == (None,) * 5 for k in (2, 3, 4, 5, 7))
    assert got[6] == ("scored", 0.0, 0.0, 0.0, 0.0, 0.0)


def test_bootstrap_against_one_draw_at_a_time(spark):
    import hashlib

    rows = [(f"q{i}", g, ((i * 7) % 11) / 10 - 0.4) for i in range(300) for g in ("m", "n") if g == "m" or i % 3]
    df = spark.createDataFrame([*rows, ("none", "m", None)], "id string, metric string, delta double").repartition(5)
    got = {r.metric: (r.ci_low, r.ci_high) for r in evaluate.bootstrap(df, "id", "delta", ["metric"], 50, 7).collect()}

    def weight(key, r):
        x = (int(hashlib.sha256(key.encode()).hexdigest()[:8], 16) + r * 0x9E3779B9 + 7) % 2**32
        x = (x ^ x >> 16) * 0x7FEB352D % 2**32
        x = (x ^ x >> 15) * 0x846CA68B % 2**32
        x ^= x >> 16
        return sum(x >= t for t in evaluate.POISSON)

    for g in ("m", "n"):
        own = [(k, d) for k, m, d in rows if m == g]
        means = []
        for r in range(1, 51):
            w = [weight(k, r) for k, _ in own]
            means.append(sum(x * d for x, (_, d) in zip(w, own, strict=True)) / sum(w))
        assert got[g] == pytest.approx(tuple(np.percentile(means, [2.5, 97.5])), abs=2e-6)
    # the weights are those of a Poisson variable of mean 1
    w = [weight(f"k{i}", r) for i in range(100) for r in range(50)]
    assert abs(np.mean(w) - 1) < 0.05 and abs(np.var(w) - 1) < 0.1


def test_commits_with_several_rows(spark):
    """A commit's row whose own subject holds the text is a match, as in SQL; no match is shuffled before the ranking."""
    history = spark.createDataFrame([("a", 1, "Fix the Loader"), ("a", 1, "docs"), ("b", 3, "fix loader"), ("b", 3, "fix loader")], "commit_sha string, committed_at long, subject string")
    asked = spark.createDataFrame([(1, "loader"), (2, "fix")], "qid long, query string")
    got = sorted((r.qid, r.commit_sha, r.content) for r in live.commits(history, asked, 5).collect())
    held = [("a", "Commit a: Fix the Loader (1)"), ("b", "Commit b: fix loader (3)"), ("b", "Commit b: fix loader (3)")]
    assert got == [(q, *h) for q in (1, 2) for h in held]
    plan = plan_of(patterns.holding(history, "commit_sha", "subject", asked, ("committed_at",)))
    assert "SortMergeJoin" not in plan and "Aggregate" not in plan
