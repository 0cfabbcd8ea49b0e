"""Queries of the retrieval operators: tokens, BM25, dense search, fusion, evaluation of rankings."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import Known, casefold, tokens
from ..operators import bm25, common, dense, evaluate, fusion, ingest, inverted, workspace
from ..operators.common import dealt, spread
from . import sqltext

TOP = 5


def _t(spark: SparkSession, d: str, name: str) -> DataFrame:
    table = spark.read.parquet(f"{d}/{name}.parquet")
    return spread(table) if name == "documents" else table


def _bench(spark, d):
    return _t(spark, d, "benchmark").select(F.col("item_id").alias("qid"), F.col("text").alias("query"))


KEYS = ("corpus", "authority", "lang")


def placed(spark, d):
    """The documents with the keys of the index: corpus and authority by source and path, and language, ? if it is not known."""
    kind = F.when(F.col("lang") == "fr", ".py").when(F.col("lang") == "de", "_test.py").otherwise(".md")
    path = F.concat("source", F.when(F.col("lang") == "es", "/tests/").otherwise("/lib/"), F.lit("doc_"), "doc_id", kind)
    rows = _t(spark, d, "documents").withColumn("path", path).withColumn("source_type", F.when(F.col("source") == "src9", "official_web").otherwise("directory"))
    corpus, authority = ingest.partition(F.col("source_type"), F.lit(None), F.lit(None), F.col("path"), F.lit(None))
    return rows.withColumns({"corpus": corpus, "authority": authority, "lang": F.coalesce("lang", F.lit("?"))})


def index(spark, d):
    """The stored index of the documents, built once for each state of their files."""
    source = f"{d}/documents.parquet"

    def make(root):
        rows = placed(spark, d).select("doc_id", "text", *KEYS, "source", "path")
        inverted.publish(hash_embedding(rows, "doc_id", "text", "vector", rows.columns[1:]), root, "documents", KEYS, ("source", "path"), "vector")

    root = workspace.kept(spark, "index", [source], make)
    if root not in _OPEN:
        _OPEN[root] = inverted.Index(spark, root)
    return _OPEN[root]


_OPEN: dict[str, inverted.Index] = {}


def _terms(spark, d):
    return inverted.query_terms(_bench(spark, d))


def index_tables(spark, d):
    """Rows of the stored index by partition."""
    made = index(spark, d).tables
    by = list(KEYS)
    posted = made["postings"].groupBy(*by).agg(F.count(F.lit(1)).alias("n_postings"), F.sum("tf").alias("n_tokens"), F.max("dl").alias("longest"))
    figures = made["terms"].groupBy(*by).agg(F.count(F.lit(1)).alias("n_terms"), F.max("df").alias("most_documents"))
    return made["totals"].join(posted, by, "left").join(figures, by, "left").join(made["vectors"].groupBy(*by).agg(F.count("vector").alias("n_vectors")), by)


def tokenize_terms(spark, d):
    docs = dealt(spark.read.parquet(f"{d}/documents.parquet").select("doc_id", "text"), "doc_id", "text")
    return docs.select("doc_id", F.explode(tokens(F.col("text"))).alias("term")).groupBy("doc_id", "term").agg(F.count(F.lit(1)).alias("tf"))


def doc_stats(spark, d):
    return bm25.tokenised(_t(spark, d, "documents")).select("doc_id", F.col("dl").cast("long").alias("dl"))


def corpus_stats(spark, d):
    rows = bm25.tokenised(_t(spark, d, "documents"), keep=("lang",))
    return bm25.corpus_stats(rows, ["lang"]).select("lang", "n_docs", F.round("avgdl", 6).alias("avgdl"))


def term_stats_df(spark, d):
    each = _t(spark, d, "documents").select("doc_id", F.explode(F.array_distinct(tokens(F.col("text")))).alias("term"))
    return each.groupBy("term").agg(F.count(F.lit(1)).alias("df"))


def bm25_topk(spark, d, k1=bm25.K1, b=bm25.B, k=TOP):
    return index(spark, d).ranked(_terms(spark, d), k, k1=k1, b=b)


def bm25_filtered(spark, d):
    """Only documents that pass the filter are scored; the statistics are those of all."""
    return index(spark, d).ranked(_terms(spark, d), TOP, keep=F.col("lang") == "en")


def _asked(spark, d):
    return _t(spark, d, "embeddings").where("vec_id % 100 = 0").select(F.col("vec_id").alias("qid"), F.col("embedding").alias("query"))


def dense_topk(spark, d):
    return dense.search(_t(spark, d, "embeddings"), _asked(spark, d), 10, "vec_id", "embedding", "qid", "query").withColumnRenamed("id", "vec_id")


def dense_filtered(spark, d):
    return dense.search(_t(spark, d, "embeddings").where("label = 3"), _asked(spark, d), 10, "vec_id", "embedding", "qid", "query").withColumnRenamed("id", "vec_id")


BUCKETS = 12


def hash_embedding(rows, id_col, text_col, out, keep=()):
    """(id, kept columns, out): unit vector of token counts over BUCKETS; a text without tokens has only the first bucket.

    Words are folded by the engine and counted in Python workers, which keep the buckets of those they have met.
    """
    common.bounded_batches(rows.sparkSession)
    folded = casefold(F.coalesce(F.col(text_col), F.lit(""))).cast("binary")
    return rows.select(F.col(id_col), *keep, F.arrow_udf(_bucketed, "array<double>")(folded).alias(out))


#: Different words whose buckets a worker keeps.
KNOWN_WORDS = 200_000
_BUCKET_OF = Known(lambda word: hashlib.sha256(word).digest()[0] % BUCKETS, KNOWN_WORDS)


def _bucketed(texts: pa.Array) -> pa.Array:
    out = np.zeros((len(texts), BUCKETS))
    for k, text in enumerate(texts.to_pylist()):
        words = text.split()  # at blanks of ASCII
        out[k] = np.bincount(np.fromiter(map(_BUCKET_OF.__getitem__, words), np.int64, len(words)), minlength=BUCKETS)
    out[~out.any(axis=1), 0] = 1
    out /= np.sqrt((out * out).sum(axis=1))[:, None]
    return pa.ListArray.from_arrays(pa.array(np.arange(len(out) + 1) * BUCKETS, pa.int32()), pa.array(out.ravel()))


def document_embeddings(spark, d):
    rows = hash_embedding(_t(spark, d, "documents"), "doc_id", "text", "v")
    return rows.select("doc_id", *(F.round(F.col("v")[k], 6).alias(f"v{k}") for k in range(BUCKETS)))


def _dense_documents(spark, d, k):
    asked = hash_embedding(_t(spark, d, "benchmark"), "item_id", "text", "query").withColumnRenamed("item_id", "qid")
    return index(spark, d).nearest(asked, k)


def rrf_fuse(spark, d):
    a, b = bm25_topk(spark, d, k=10), bm25_topk(spark, d, 0.9, 0.4, k=10)
    rows = fusion.arm(a, 0, "wide").unionByName(fusion.arm(b, 1, "flat"))
    return _fused(fusion.fuse(rows, ["qid"], "doc_id", top_k=TOP))


def _fused(rows):
    return rows.select("qid", "doc_id", "fused", F.array_join("contributors", ",").alias("contributors"), "rank")


def hybrid_topk(spark, d):
    n = TOP * fusion.PARTITION_FACTOR
    return _fused(fusion.hybrid(_dense_documents(spark, d, n), bm25_topk(spark, d, k=n), ["qid"], "doc_id", TOP))


LANG_WEIGHTS = {"en": 1.35, "fr": 1.2, "de": 1.0, "es": 0.8}


def federated_topk(spark, d):
    ranked = index(spark, d).ranked(_terms(spark, d), TOP * fusion.FEDERATED_FACTOR, by=("lang",))
    weight = F.coalesce(*(F.when(F.col("lang") == lang, F.lit(w)) for lang, w in LANG_WEIGHTS.items()), F.lit(1.0))
    return _fused(fusion.federate(ranked, ["qid"], "lang", "doc_id", weight, TOP))


def _relevant(spark, d):
    return evaluate.holders(_t(spark, d, "documents"), _bench(spark, d)).withColumn("grade", F.lit(1))


def eval_per_query(spark, d):
    return evaluate.ranking_metrics(_bench(spark, d), bm25_topk(spark, d), _relevant(spark, d), TOP)


def eval_summary(spark, d):
    rows = eval_per_query(spark, d)
    names = ("hit", "recall", "precision", "reciprocal_rank", "ndcg")
    return rows.agg(F.count(F.lit(1)).alias("n"), F.count("hit").alias("eligible"), *(F.round(evaluate.mean_present(m), 6).alias(f"mean_{m}") for m in names))


def eval_refusals(spark, d):
    """A query is refused if its best score is under 40; it should be if no document holds the passage."""
    best = bm25_topk(spark, d, k=1).select("qid", "score")
    has = _relevant(spark, d).select("qid").distinct().withColumn("has", F.lit(True))
    rows = _bench(spark, d).join(best, "qid", "left").join(has, "qid", "left")
    return evaluate.binary_scores(rows, F.col("has").isNull(), F.coalesce(F.col("score") < 40, F.lit(True)))


def ablation_deltas(spark, d):
    rel = _relevant(spark, d)
    runs = {"baseline": bm25_topk(spark, d), "flat": bm25_topk(spark, d, 0.9, 0.4), "dense": _dense_documents(spark, d, TOP)}
    rows = None
    for name, found in runs.items():
        m = evaluate.ranking_metrics(_bench(spark, d), found, rel, TOP).select(F.lit(name).alias("strategy"), "hit", "reciprocal_rank", "ndcg")
        rows = m if rows is None else rows.unionByName(m)
    summary = rows.groupBy("strategy").agg(*(F.round(evaluate.mean_present(m), 6).alias(m) for m in ("hit", "reciprocal_rank", "ndcg")))
    return evaluate.deltas(summary, "strategy", "baseline", ["hit", "reciprocal_rank", "ndcg"])


QUERIES = {
    f.__name__: f
    for f in (index_tables, tokenize_terms, doc_stats, corpus_stats, term_stats_df, bm25_topk, bm25_filtered, dense_topk, dense_filtered, document_embeddings, rrf_fuse, hybrid_topk, federated_topk, eval_per_query, eval_summary, eval_refusals, ablation_deltas)
}

_RANKED = "SELECT {cols}, row_number() OVER (PARTITION BY {by} ORDER BY score DESC, doc_id)::INTEGER AS rank FROM {table}"


def _topk(table: str, k: int, by: str = "qid", cols: str = "qid, doc_id, score") -> str:
    return f"SELECT * FROM ({_RANKED.format(cols=cols, by=by, table=table)}) WHERE rank <= {k}"


def _dense_sql(where: str) -> str:
    return f"""WITH q AS (SELECT vec_id AS qid, embedding AS query FROM embeddings WHERE vec_id % 100 = 0),
s AS (SELECT qid, vec_id, round(list_inner_product(embedding::DOUBLE[], query::DOUBLE[]), 6) AS score FROM embeddings, q WHERE {where})
SELECT * FROM (SELECT qid, vec_id, score, row_number() OVER (PARTITION BY qid ORDER BY score DESC, vec_id)::INTEGER AS rank FROM s) WHERE rank <= 10"""


def _hash_vectors(table: str, key: str, name: str, text: str = "text") -> str:
    w = f"list_filter(regexp_split_to_array({sqltext.fold(f"coalesce({text}, '')")}, '[ \\t\\n\\r\\f\\x0b]+'), lambda x: x <> '')"
    raw = f"list_transform(range(0, {BUCKETS}), lambda k: len(list_filter(b, lambda c: c = k))::DOUBLE)"
    return f"""{name}_b AS (SELECT {key}, list_transform({w}, lambda x: ('0x' || substr(sha256(x), 1, 2))::INTEGER % {BUCKETS}) AS b FROM {table}),
{name}_r AS (SELECT {key}, CASE WHEN len(b) = 0 THEN list_concat([1.0::DOUBLE], list_transform(range(1, {BUCKETS}), lambda k: 0.0::DOUBLE)) ELSE {raw} END AS r FROM {name}_b),
{name} AS (SELECT {key}, list_transform(r, lambda x: x / sqrt(list_inner_product(r, r))) AS v FROM {name}_r)"""


_DENSE_DOCS = f"""{_hash_vectors('documents', 'doc_id', 'dv')}, {_hash_vectors('benchmark', 'item_id', 'qv')},
dense_s AS (SELECT item_id AS qid, doc_id, round(list_inner_product(dv.v, qv.v), 6) AS score FROM dv, qv)"""

_FUSE = """sums AS (SELECT qid, doc_id, round(sum(w / (60 + rank)), 9) AS fused, min(list_no * 1000000 + rank) AS first FROM lists GROUP BY 1, 2),
con AS (SELECT qid, doc_id, string_agg(retriever, ',' ORDER BY seen) AS contributors FROM (SELECT qid, doc_id, retriever, min(list_no * 1000000 + rank) AS seen FROM lists GROUP BY 1, 2, 3) GROUP BY 1, 2)
SELECT * FROM (SELECT qid, doc_id, fused, contributors, row_number() OVER (PARTITION BY qid ORDER BY fused DESC, first, doc_id)::INTEGER AS rank FROM sums JOIN con USING (qid, doc_id)) WHERE rank <= 5"""

_BM25 = sqltext.bm25()
_REL = "rel AS (SELECT item_id AS qid, doc_id FROM benchmark b, documents d WHERE contains(d.text, b.text))"


def _metrics(results: str) -> str:
    """SELECT of the per-query metrics for a ranking table (qid, doc_id, rank)."""
    return f"""SELECT item_id AS qid, coalesce(n_rel, 0) AS n_relevant,
 CASE WHEN n_rel > 0 THEN CASE WHEN n_hit > 0 THEN 1.0::DOUBLE ELSE 0.0 END END AS hit,
 CASE WHEN n_rel > 0 THEN coalesce(n_hit, 0)::DOUBLE / n_rel END AS recall,
 CASE WHEN n_rel > 0 THEN coalesce(coalesce(n_hit, 0)::DOUBLE / nullif(n_ret, 0), 0.0) END AS precision,
 CASE WHEN n_rel > 0 THEN coalesce(1.0::DOUBLE / first, 0.0) END AS reciprocal_rank,
 CASE WHEN n_rel > 0 THEN round(coalesce(dcg, 0.0) / ideal, 9) END AS ndcg
FROM benchmark
LEFT JOIN (SELECT qid, count(*) AS n_rel FROM rel GROUP BY 1) r ON r.qid = item_id
LEFT JOIN (SELECT qid, sum(1 / log2(i + 1.0)) AS ideal FROM (SELECT qid, row_number() OVER (PARTITION BY qid) AS i FROM rel) WHERE i <= 5 GROUP BY 1) i ON i.qid = item_id
LEFT JOIN (SELECT qid, count(*) AS n_hit, min(rank) AS first, sum(1 / log2(rank + 1.0)) AS dcg FROM {results} JOIN rel USING (qid, doc_id) GROUP BY 1) h ON h.qid = item_id
LEFT JOIN (SELECT qid, count(*) AS n_ret FROM {results} GROUP BY 1) n ON n.qid = item_id"""


_FLAT = sqltext.bm25(0.9, 0.4, "flat_s").rsplit("\nflat_s AS", 1)[1]
#: The partition of a document in the index, as SQL.
PLACED = """CASE WHEN source = 'src9' THEN 'official' ELSE 'internal' END AS corpus, CASE WHEN source = 'src9' THEN 'official' WHEN lang IN ('es', 'de') THEN 'test' WHEN lang = 'fr' THEN 'code' ELSE 'design' END AS authority, coalesce(lang, '?') AS lang"""
SQL = {
    "index_tables": f"""WITH {sqltext.tokens('documents', 'doc_id', 'text')}, pl AS (SELECT doc_id, {PLACED} FROM documents), po AS (SELECT k AS doc_id, term, count(*) AS tf FROM toks GROUP BY 1, 2),
dl AS (SELECT doc_id, sum(tf)::BIGINT AS dl FROM po GROUP BY 1), df AS (SELECT corpus, authority, lang, term, count(*) AS df FROM po JOIN pl USING (doc_id) GROUP BY ALL),
a AS (SELECT corpus, authority, lang, count(*) AS n_docs, sum(coalesce(dl, 0))::BIGINT AS sum_dl, max(dl) AS longest, count(*) AS n_vectors FROM pl LEFT JOIN dl USING (doc_id) GROUP BY ALL),
b AS (SELECT corpus, authority, lang, count(*) AS n_postings, sum(tf)::BIGINT AS n_tokens FROM po JOIN pl USING (doc_id) GROUP BY ALL), c AS (SELECT corpus, authority, lang, count(*) AS n_terms, max(df) AS most_documents FROM df GROUP BY ALL)
SELECT * FROM a LEFT JOIN b USING (corpus, authority, lang) LEFT JOIN c USING (corpus, authority, lang)""",
    "tokenize_terms": f"WITH {sqltext.tokens('documents', 'doc_id', 'text')} SELECT k AS doc_id, term, count(*) AS tf FROM toks GROUP BY 1, 2",
    "doc_stats": f"WITH {sqltext.tokens('documents', 'doc_id', 'text')} SELECT doc_id, count(term) AS dl FROM documents LEFT JOIN toks ON k = doc_id GROUP BY 1",
    "corpus_stats": f"WITH {sqltext.tokens('documents', 'doc_id', 'text')}, dl AS (SELECT doc_id, lang, count(term) AS dl FROM documents LEFT JOIN toks ON k = doc_id GROUP BY 1, 2) SELECT lang, count(*) AS n_docs, round(avg(dl), 6) AS avgdl FROM dl GROUP BY 1",
    "term_stats_df": f"WITH {sqltext.tokens('documents', 'doc_id', 'text')} SELECT term, count(DISTINCT k) AS df FROM toks GROUP BY 1",
    "bm25_topk": f"WITH {_BM25} {_topk('scored', 5)}",
    "bm25_filtered": f"WITH {_BM25} {_topk('(SELECT scored.* FROM scored JOIN documents USING (doc_id) WHERE lang = chr(101) || chr(110))', 5)}".replace("chr(101) || chr(110)", "'en'"),
    "dense_topk": _dense_sql("true"),
    "dense_filtered": _dense_sql("label = 3"),
    "document_embeddings": f"WITH {_hash_vectors('documents', 'doc_id', 'dv')} SELECT doc_id, " + ", ".join(f"round(v[{k + 1}], 6) AS v{k}" for k in range(BUCKETS)) + " FROM dv",
    "rrf_fuse": f"WITH {_BM25}, flat_s AS {_FLAT}, lists AS (SELECT *, 0 AS list_no, 'wide' AS retriever, 1.0::DOUBLE AS w FROM ({_topk('scored', 10)}) UNION ALL SELECT *, 1, 'flat', 1.0 FROM ({_topk('flat_s', 10)})), {_FUSE}",
    "hybrid_topk": f"WITH {_BM25}, {_DENSE_DOCS}, lists AS (SELECT *, 0 AS list_no, 'dense' AS retriever, 1.0::DOUBLE AS w FROM ({_topk('dense_s', 15)}) UNION ALL SELECT *, 1, 'bm25', 1.0 FROM ({_topk('scored', 15)})), {_FUSE}",
    "federated_topk": f"WITH {sqltext.bm25(by="coalesce(lang, '?')")}, ranked AS ({_topk('scored', 15, 'qid, p', 'p, qid, doc_id, score')}), lists AS (SELECT qid, doc_id, rank, dense_rank() OVER (PARTITION BY qid ORDER BY p) AS list_no, p AS retriever, CASE p "
    + " ".join(f"WHEN '{k}' THEN {w}" for k, w in LANG_WEIGHTS.items())
    + f" ELSE 1.0 END::DOUBLE AS w FROM ranked), {_FUSE}",
    "eval_per_query": f"WITH {_BM25}, res AS ({_topk('scored', 5)}), {_REL} {_metrics('res')}",
    "eval_summary": f"WITH {_BM25}, res AS ({_topk('scored', 5)}), {_REL}, m AS ({_metrics('res')}) SELECT count(*) AS n, count(hit) AS eligible, "
    + ", ".join(f"round(coalesce(avg({m}), 0.0), 6) AS mean_{m}" for m in ("hit", "recall", "precision", "reciprocal_rank", "ndcg"))
    + " FROM m",
    "eval_refusals": f"""WITH {_BM25}, {_REL}, best AS (SELECT qid, max(score) AS score FROM scored GROUP BY 1),
t AS (SELECT item_id NOT IN (SELECT qid FROM rel) AS truth, coalesce(score < 40, true) AS said FROM benchmark LEFT JOIN best ON qid = item_id),
c AS (SELECT count(*) FILTER (truth AND said) AS tp, count(*) FILTER (NOT truth AND said) AS fp, count(*) FILTER (truth AND NOT said) AS fn FROM t)
SELECT tp, fp, fn, round(coalesce(tp::DOUBLE / nullif(tp + fp, 0), 0.0), 9) AS precision, round(coalesce(tp::DOUBLE / nullif(tp + fn, 0), 0.0), 9) AS recall, round(coalesce(2.0::DOUBLE * tp / nullif(2 * tp + fp + fn, 0), 0.0), 9) AS f1 FROM c""",
    "ablation_deltas": f"""WITH {_BM25}, flat_s AS {_FLAT}, {_DENSE_DOCS}, {_REL},
r1 AS ({_topk('scored', 5)}), r2 AS ({_topk('flat_s', 5)}), r3 AS ({_topk('dense_s', 5)}),
m AS (SELECT 'baseline' AS strategy, * FROM ({_metrics('r1')}) UNION ALL SELECT 'flat', * FROM ({_metrics('r2')}) UNION ALL SELECT 'dense', * FROM ({_metrics('r3')})),
s AS (SELECT strategy, round(coalesce(avg(hit), 0.0), 6) AS hit, round(coalesce(avg(reciprocal_rank), 0.0), 6) AS reciprocal_rank, round(coalesce(avg(ndcg), 0.0), 6) AS ndcg FROM m GROUP BY 1)
SELECT s.strategy, s.hit, s.reciprocal_rank, s.ndcg, round(s.hit - b.hit, 9) AS delta_hit, round(s.reciprocal_rank - b.reciprocal_rank, 9) AS delta_reciprocal_rank, round(s.ndcg - b.ndcg, 9) AS delta_ndcg FROM s, s b WHERE b.strategy = 'baseline'""",
}
