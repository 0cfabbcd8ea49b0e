"""Okapi BM25 over an inverted index, for a whole batch of queries.

Index tables: ``postings`` (doc_id, term, tf, dl) and ``corpus_stats`` (n_docs, avgdl).
Documents without tokens count in both figures. Only postings of query terms reach the
scoring join, and the query side is broadcast behind a size check.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import tokens
from .common import few, top

K1, B = 1.5, 0.75


def tokenised(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """(id, tokens, dl, kept columns). The tokens come out of a generator, so whatever reads them twice has them made once."""
    rows = docs.select(F.col(id_col).alias("doc_id"), *keep, F.explode(F.array(tokens(F.col(text_col)))).alias("tokens"))
    return rows.withColumn("dl", F.size("tokens"))


def corpus_stats(rows: DataFrame, by: list[str] | None = None) -> DataFrame:
    """(n_docs, avgdl), for each partition if ``by`` is given."""
    return rows.groupBy(*(by or [])).agg(F.count(F.lit(1)).alias("n_docs"), F.avg("dl").alias("avgdl"))


def postings(rows: DataFrame, terms: DataFrame | None = None, by: tuple[str, ...] = ()) -> DataFrame:
    """(by, doc_id, term, tf, dl), of the given terms only if there are any."""
    each = rows.select(*by, "doc_id", "dl", F.explode("tokens").alias("term"))
    if terms is not None:
        each = each.join(terms, "term", "left_semi")
    return each.groupBy(*by, "doc_id", "dl", "term").agg(F.count(F.lit(1)).alias("tf"))


def term_stats(post: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """(by, term, df). It looks at ``tf``, so the postings below are the very plan of their other use, whose exchange Spark reuses."""
    return post.groupBy(*by, "term").agg(F.count_if(F.col("tf") > 0).alias("df"))


def query_terms(queries: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(qid, term, qtf)."""
    each = queries.select(F.col(id_col).alias("qid"), F.explode(tokens(F.col(text_col))).alias("term"))
    return each.groupBy("qid", "term").agg(F.count(F.lit(1)).alias("qtf"))


def scores(rows: DataFrame, terms: DataFrame, k1: float = K1, b: float = B, by: tuple[str, ...] = (), keep: Column | None = None) -> DataFrame:
    """(by, qid, doc_id, score) with score above 0, rounded to 6 places.

    The statistics are those of the whole collection, or of each partition named by ``by``. keep: a
    condition on columns of ``rows``; postings of other documents count in the statistics and are not scored.
    """
    if k1 <= 0 or not 0 <= b <= 1:
        raise ValueError("k1 must be above 0 and b between 0 and 1")
    # one check, of the queries alone: the query side, and the statistics of its terms (a row for each term and partition), are as small
    side = F.broadcast if few(terms) else lambda x: x
    wanted = side(terms.select("term").distinct())
    if keep is None:
        post = scored = postings(rows, wanted, by)
    else:
        post = postings(rows.withColumn("_keep", F.coalesce(keep, F.lit(False))), wanted, (*by, "_keep"))
        scored = post.where(F.when(F.col("_keep"), F.col("tf")).otherwise(0) > 0).drop("_keep")  # on the counts, so that it stays above them
    stats = corpus_stats(rows, list(by))
    weighed = scored.join(side(term_stats(post, by)), [*by, "term"])
    weighed = weighed.join(F.broadcast(stats), list(by)) if by else weighed.crossJoin(F.broadcast(stats))  # one row for each partition
    idf = F.log1p((F.col("n_docs") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    part = idf * F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("dl") / F.col("avgdl")))
    found = weighed.withColumn("part", part).join(side(terms), "term")
    summed = found.groupBy(*by, "qid", "doc_id").agg(F.round(F.sum(F.col("part") * F.col("qtf")), 6).alias("score"))
    return summed.where("score > 0")


def search(docs: DataFrame, queries: DataFrame, k: int, id_col: str = "doc_id", text_col: str = "text", qid_col: str = "qid", query_col: str = "query", k1: float = K1, b: float = B) -> DataFrame:
    """(qid, doc_id, score, rank): the k best documents of each query, ties by doc_id."""
    found = scores(tokenised(docs, id_col, text_col), query_terms(queries, qid_col, query_col), k1, b)
    return top(found, ["qid"], [F.desc("score"), F.asc("doc_id")], k)
