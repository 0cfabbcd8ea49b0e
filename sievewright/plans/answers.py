"""Queries of the answer operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.text import tokens
from ..operators import answer, evidence
from ..operators.common import top
from . import corpus, retrieval
from .corpus import _t


def _results(spark, d, k):
    docs = _t(spark, d, "documents").select("doc_id", "source", "lang", F.col("text").alias("content"))
    asked = _t(spark, d, "benchmark").select(F.col("item_id").alias("qid"), F.col("text").alias("query"))
    return retrieval.bm25_topk(spark, d, k=k).join(docs, "doc_id").join(asked, "qid")


def rerank_topk(spark, d):
    return answer.rerank(_results(spark, d, 10), 5).select("qid", "doc_id", "first_score", "score", "rank")


def comparison_sides(spark, d):
    return answer.both_sides(_results(spark, d, 10), "qid", "lang", ("en", "fr")).select("qid", "doc_id", "rank")


def support_select(spark, d):
    """The best support result after the first: of another source, by shared tokens and novelty."""
    rows = _results(spark, d, 10)
    first = rows.where("rank = 1").select("qid", F.col("source").alias("taken_source"), tokens(F.col("source")).alias("taken"))
    others = rows.where("rank > 1").join(first, "qid").where("source <> taken_source")
    score = evidence.support_score(F.array_distinct(tokens(F.col("query"))), tokens(F.col("source")), tokens(F.col("lang")), tokens(F.col("content")), F.col("taken"), F.col("rank").cast("double"))
    best = top(others.withColumn("support", F.round(score, 6)).withColumnRenamed("rank", "was"), ["qid"], [F.desc("support"), F.asc("was")], 1)
    return best.select("qid", "doc_id", "support")


def guard_check(spark, d):
    rows = corpus._questions(spark, d).withColumn("anchors", answer.anchors(F.col("query")))
    gone = answer.missing(F.col("anchors"), F.lit("the mcp server loads query.engine"))
    return rows.select("conv_id", "turn", F.array_join(F.array_sort("anchors"), ",").alias("anchors"), F.coalesce(answer.guard(F.col("query"), gone), F.lit("ok")).alias("verdict"))


def answer_states(spark, d):
    rows = _t(spark, d, "conversations").where("role = 'assistant'").withColumn("said", F.when(F.length("text") % 5 > 0, F.concat("text", F.lit(" [E"), F.col("turn"), F.lit("]"))))
    kept, valid = evidence.citations(F.coalesce("said", F.lit("")), F.array(F.lit("E1"), F.lit("E3")))
    return rows.select("conv_id", "turn", answer.state(F.length("text") % 7 > 0, F.col("said"), valid).alias("state"))


def claim_recall(spark, d):
    """Each document that holds a passage is a claim, supported by any retrieved document of its source."""
    docs = _t(spark, d, "documents").select("doc_id", "source")
    claims = retrieval._relevant(spark, d).join(docs, "doc_id").select("qid", F.col("doc_id").alias("claim_id"), F.array("source").alias("sources"))
    return answer.claim_recall(claims, retrieval.bm25_topk(spark, d).join(docs, "doc_id"))


QUERIES = {f.__name__: f for f in (rerank_topk, comparison_sides, support_select, guard_check, answer_states, claim_recall)}

_TOP10 = f"WITH {retrieval._BM25}, t AS ({corpus._TOP.format(k=10)})"
_SHARE = "qset AS (SELECT DISTINCT k AS qid, term FROM qt), dset AS (SELECT DISTINCT k AS doc_id, term FROM dt), nq AS (SELECT qid, count(*) AS n FROM qset GROUP BY 1), hits AS (SELECT qid, doc_id, count(*) AS h FROM t JOIN qset USING (qid) JOIN dset USING (doc_id, term) GROUP BY 1, 2)"
SQL = {
    "rerank_topk": f"{_TOP10}, {_SHARE}, s AS (SELECT qid, doc_id, t.score AS first_score, t.rank AS r, round(coalesce(h, 0)::DOUBLE / n, 6) AS score FROM t JOIN nq USING (qid) LEFT JOIN hits USING (qid, doc_id)) SELECT * EXCLUDE (r) FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, r)::INTEGER AS rank FROM s) WHERE rank <= 5",
    "comparison_sides": f"{_TOP10}, s AS (SELECT qid, doc_id, t.rank AS r, CASE WHEN lang IN ('en', 'fr') AND row_number() OVER (PARTITION BY qid, lang ORDER BY t.rank) = 1 THEN 0 ELSE 1 END AS f FROM t JOIN documents USING (doc_id)) SELECT qid, doc_id, row_number() OVER (PARTITION BY qid ORDER BY f, r)::INTEGER AS rank FROM s",
    "support_select": f"""{_TOP10}, {_SHARE}, x AS (SELECT qid, doc_id, t.rank AS r, source, lang FROM t JOIN documents USING (doc_id)), f AS (SELECT qid, source AS taken FROM x WHERE r = 1),
s AS (SELECT x.qid, doc_id, r, round(10 * (SELECT count(*) FROM qset WHERE qset.qid = x.qid AND term = lower(x.source)) + 2 * (SELECT count(*) FROM qset WHERE qset.qid = x.qid AND term = lower(x.lang)) + 0.5 * coalesce(h, 0)
 + 3 * (SELECT count(*) FROM qset WHERE qset.qid = x.qid AND term IN (lower(x.source), lower(x.lang)) AND term <> lower(f.taken)) + 1.0::DOUBLE / r, 6) AS support FROM x JOIN f USING (qid) LEFT JOIN hits USING (qid, doc_id) WHERE r > 1 AND x.source <> f.taken)
SELECT qid, doc_id, support FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY support DESC, r) AS p FROM s) WHERE p = 1""",
    # guard_check has no SQL: word boundaries of RE2 know ASCII letters only; it is held against Python's re in tests/test_answers.py
    "answer_states": "SELECT conv_id, turn, CASE WHEN length(text) % 7 = 0 THEN 'refused' WHEN length(text) % 5 = 0 THEN 'evidence_only' WHEN turn IN (1, 3) THEN 'model' ELSE 'fallback_invalid_citations' END AS state FROM conversations WHERE role = 'assistant'",
    "claim_recall": f"WITH {retrieval._BM25}, t AS ({corpus._TOP.format(k=5)}), {retrieval._REL}, got AS (SELECT DISTINCT qid, source FROM t JOIN documents USING (doc_id)), c AS (SELECT qid, rel.doc_id, (qid, source) IN (SELECT (qid, source) FROM got) AS hit FROM rel JOIN documents d ON d.doc_id = rel.doc_id) SELECT qid, count(*) AS n_claims, count(*) FILTER (hit) AS n_supported, round(count(*) FILTER (hit)::DOUBLE / count(*), 9) AS claim_recall FROM c GROUP BY 1",
}
