"""A stored inverted index: postings, document lengths, term and collection figures in Parquet.

Tables of a build, each partitioned by the index keys (corpus and authority, say):

* ``documents`` (doc_id, dl, kept columns): every document, those without tokens included;
* ``postings`` (bucket, h, term, doc_id, tf, dl): also partitioned by ``bucket``, a part of the term's hash h,
  and sorted by h in each file;
* ``terms`` (bucket, h, term, df) and ``totals`` (n_docs, sum_dl): all additive, so figures of several partitions
  are their sums;
* ``vectors`` (doc_id, vector), if there are any.

A query reads the buckets of its terms only, of the partitions that it is routed to only. A batch of queries
whose terms make a small matrix is scored by document: the postings of its terms meet by document, and each
task multiplies its documents with the query matrix and keeps the k best of each query and partition. A larger
batch is scored by a join, whose sums are aggregated before they are shuffled.

A term of a third of all postings is spread over many files and tasks: postings are written in ranges of about
SORTED_ROWS rows. Terms are counted text by text in Python workers and sent on in batches of SENT_ROWS, so no task
grows with the collection and nothing is shuffled for it.
Documents with a null id or null key are refused by the checks, as are repeated ids.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import KNOWN_TOKENS, Known, expanded, raw_tokens, token_counts, token_list
from ..sources import catalog
from . import dense
from .bm25 import B, K1
from .common import BROADCAST_ROWS, SORTED_ROWS, bounded_batches, few, top

KEYS = ("corpus", "authority")
#: Postings a bucket is to hold; the number of buckets follows from it.
BUCKET_ROWS, BUCKETS = 8_000_000, 4096
#: Cells of the matrix of query terms and queries with which tasks multiply; larger batches are joined.
MATRIX_CELLS = 4 << 20
#: Values of a task's block of documents, and scores that it holds before it cuts them to the k best or sends them on.
BLOCK_VALUES, HELD_ROWS = 4 << 20, 1 << 18
#: Rows of counted terms that a worker sends on at once.
SENT_ROWS = 100_000


def counted(docs: DataFrame, keep: list[str]) -> DataFrame:
    """(doc_id, keep, raw, n): the raw tokens of each document with their number, equal ones counted before they are cut into terms."""
    each = docs.select("doc_id", *keep, F.explode(raw_tokens(F.col("text"))).alias("raw"))
    return each.groupBy("doc_id", *keep, "raw").agg(F.count(F.lit(1)).alias("n"))


def term_counts(docs: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """(doc_id, keys, term, tf, dl) of docs (doc_id, keys, text): the index tokens of each row, counted in one pass over its text."""
    bounded_batches(docs.sparkSession)
    names, kinds = ["doc_id", *keys], dict(docs.dtypes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Known(token_list, KNOWN_TOKENS)
        for batch in batches:
            place, terms, tfs, sizes, dls = [], [], [], [], []

            def sent() -> pa.RecordBatch:
                at = pa.array(np.repeat(place, sizes).astype(np.int64))
                own = [batch.column(k).take(at) for k in range(len(names))]  # noqa: B023
                return pa.RecordBatch.from_arrays([*own, pa.array(terms, pa.string()), pa.array(tfs, pa.int64()), pa.array(np.repeat(dls, sizes).astype(np.int64))], [*names, "term", "tf", "dl"])  # noqa: B023

            for i, text in enumerate(batch.column(len(names)).to_pylist()):
                if not text:
                    continue
                counts = token_counts(text.decode("utf-8", "replace"), known)
                place.append(i)
                sizes.append(len(counts))
                dls.append(sum(counts.values()))
                terms += counts.keys()
                tfs += counts.values()
                if len(terms) >= SENT_ROWS:
                    yield sent()
                    place, terms, tfs, sizes, dls = [], [], [], [], []
            if terms:
                yield sent()

    schema = ", ".join(f"{c} {kinds[c]}" for c in names) + ", term string, tf long, dl long"
    return docs.select(*names, F.col("text").cast("string").cast("binary").alias("text")).mapInArrow(run, schema)


def _hash(term: Column) -> Column:
    return F.xxhash64(term)


def tables(docs: DataFrame, keys: tuple[str, ...] = KEYS, keep: tuple[str, ...] = (), vector: str | None = None) -> tuple[dict[str, DataFrame], dict[str, tuple[str, ...]], int]:
    """(the tables of an index, by what each is partitioned, the number of buckets) of docs (doc_id, text, keys, keep[, vector]).

    The postings are read from a written table by the others.
    """
    from .workspace import written

    posted = written(term_counts(docs.select("doc_id", *keys, "text"), keys).withColumn("h", _hash(F.col("term"))), "counts")
    lengths = posted.groupBy("doc_id").agg(F.max("dl").alias("dl"))
    documents = docs.select("doc_id", *keys, *keep).join(lengths, "doc_id", "left").withColumn("dl", F.coalesce("dl", F.lit(0).cast("long")))
    rows = posted.count()
    buckets = int(min(BUCKETS, max(1, -(-rows // BUCKET_ROWS))))
    bucket = F.pmod("h", F.lit(buckets)).cast("int").alias("bucket")
    files = -(-rows // SORTED_ROWS)

    def laid(df: DataFrame, *order: str) -> DataFrame:
        """Sorted rows in files of about SORTED_ROWS: ranges of the order, so a frequent term is split and small buckets share a task."""
        order = (*keys, "bucket", "h", *order)
        return df.repartitionByRange(max(1, files), *order).sortWithinPartitions(*order)

    postings = laid(posted.select(*keys, bucket, "h", "term", "doc_id", "tf", "dl"), "term", "doc_id")
    each = posted.groupBy(*keys, "h", "term").agg(F.count(F.lit(1)).alias("df"))
    dfs = each.select(*keys, bucket, "h", "term", "df").hint("rebalance", *keys, "bucket").sortWithinPartitions(*keys, "bucket", "h", "term")
    totals = documents.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_docs"), F.sum("dl").alias("sum_dl"))
    out = {"documents": documents, "postings": postings, "terms": dfs, "totals": totals.coalesce(1)}
    by = {"documents": keys, "postings": (*keys, "bucket"), "terms": (*keys, "bucket")}
    if vector:
        out["vectors"] = docs.select("doc_id", *keys, F.col(vector).cast("array<double>").alias("vector"))
        by["vectors"] = keys
    return out, by, buckets


def violations(staged: dict[str, DataFrame], keys: tuple[str, ...], docs: DataFrame) -> DataFrame:
    """(check, detail) of what is wrong with the staged tables of an index of ``docs``."""
    documents, postings, terms, totals = (staged[n] for n in ("documents", "postings", "terms", "totals"))
    per = [
        totals.select(*keys, F.col("n_docs").alias("docs"), F.col("sum_dl").alias("dl"), *(F.lit(0).cast("long").alias(c) for c in ("tf", "rows", "df"))),
        documents.groupBy(*keys).agg((-F.count(F.lit(1))).alias("docs"), (-F.sum("dl")).alias("dl")).withColumns({c: F.lit(0).cast("long") for c in ("tf", "rows", "df")}),
        postings.groupBy(*keys).agg(F.sum("tf").alias("tf"), F.count(F.lit(1)).alias("rows")).withColumns({c: F.lit(0).cast("long") for c in ("docs", "dl", "df")}),
        terms.groupBy(*keys).agg(F.sum("df").alias("df")).withColumns({c: F.lit(0).cast("long") for c in ("docs", "dl", "tf", "rows")}),
        documents.groupBy(*keys).agg((-F.sum("dl")).alias("tf")).withColumns({c: F.lit(0).cast("long") for c in ("docs", "dl", "rows", "df")}),
    ]
    sums = per[0]
    for other in per[1:]:
        sums = sums.unionByName(other)
    summed = sums.groupBy(*keys).agg(*(F.sum(c).alias(c) for c in ("docs", "dl", "tf", "rows", "df")))
    part = F.concat_ws("/", *(F.coalesce(F.col(k).cast("string"), F.lit("null")) for k in keys))
    said = lambda rows, name, detail: rows.select(F.lit(name).alias("check"), detail.cast("string").alias("detail"))
    wrong = [
        said(summed.where("docs <> 0"), "documents against totals", part),
        said(summed.where("dl <> 0"), "lengths against totals", part),
        said(summed.where("tf <> 0"), "term frequencies against lengths", part),
        said(summed.where("rows <> df"), "postings against document frequencies", part),
        said(documents.where(F.col("doc_id").isNull() | part.contains("null")), "null id or key", F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))),
        said(documents.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1"), "repeated id", F.col("doc_id")),
        said(terms.where(F.col("h") != _hash(F.col("term"))), "hash of a term", F.col("term")),
        said(documents.select(F.lit(1).alias("n")).unionAll(docs.select(F.lit(-1))).agg(F.sum("n").alias("n")).where("n <> 0"), "number of documents", F.col("n")),
    ]
    if "vectors" in staged:
        sizes = staged["vectors"].where("vector is not null").groupBy(F.size("vector").alias("dim")).count()
        wrong.append(said(sizes.agg(F.count(F.lit(1)).alias("n")).where("n > 1"), "different dimensions", F.col("n")))
    out = wrong[0]
    for other in wrong[1:]:
        out = out.unionByName(other)
    return out


def publish(docs: DataFrame, root: str, build_id: str, keys: tuple[str, ...] = KEYS, keep: tuple[str, ...] = (), vector: str | None = None) -> str:
    """Build, stage, check and make current an index; a build that breaks a check raises ``catalog.Rejected`` and changes nothing."""
    made, by, buckets = tables(docs, keys, keep, vector)
    return catalog.publish(made, root, build_id, by, lambda staged: violations(staged, keys, docs), {"keys": ",".join(keys), "buckets": str(buckets)})


class Index:
    """The current build under a root, for search; a later build is seen by a new ``Index`` only."""

    def __init__(self, spark: SparkSession, root: str):
        self.facts, self.tables = catalog.opened(spark, root)
        self.keys = tuple(self.facts["keys"].split(","))

    def weights(self, terms: DataFrame, buckets: list[int], side, by: tuple[str, ...] = (), keep: Column | None = None, k1: float = K1, b: float = B) -> DataFrame:
        """(keys, doc_id, the columns of terms, w) of the postings of the query terms (term, ..), which lie in ``buckets``.

        w is the share of one query token in the score. The figures are those of the whole index, or of each
        partition that ``by``, some of the keys, makes; keep: a condition on the keys for what is scored; side:
        what marks the terms for a broadcast if they are few.
        """
        own = F.col("bucket").isin(*buckets) if buckets else F.lit(False)
        more = [c for c in terms.columns if c != "term"]
        figures = self.tables["terms"].where(own).join(side(terms), "term").groupBy(*by, "term", *more).agg(F.sum("df").alias("df"))
        totals = self.tables["totals"].groupBy(*by).agg(F.sum("n_docs").alias("n_docs"), (F.sum("sum_dl") / F.sum("n_docs")).alias("avgdl"))
        known = figures.join(F.broadcast(totals), list(by)) if by else figures.crossJoin(F.broadcast(totals))  # a row a partition
        idf = F.log1p((F.col("n_docs") - F.col("df") + 0.5) / (F.col("df") + 0.5))
        known = known.select(*by, "term", *more, idf.alias("idf"), "avgdl")
        postings = self.tables["postings"].where(own)
        met = (postings if keep is None else postings.where(keep)).join(side(known), [*by, "term"])
        part = F.col("idf") * F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("dl") / F.col("avgdl")))
        return met.select(*self.keys, "doc_id", "term", *more, part.alias("w"))

    def nearest(self, queries: DataFrame, k: int, by: tuple[str, ...] = (), keep: Column | None = None) -> DataFrame:
        """(by, qid, doc_id, score, rank): the k documents of each query (qid, query: vector) with the largest inner products, of each partition if ``by`` is given."""
        vectors = self.tables["vectors"] if keep is None else self.tables["vectors"].where(keep)
        return dense.search(vectors, queries, k, "doc_id", "vector", "qid", "query", by=by).withColumnRenamed("id", "doc_id")

    def ranked(self, terms: DataFrame, k: int, by: tuple[str, ...] = (), keep: Column | None = None, k1: float = K1, b: float = B, allowed: DataFrame | None = None) -> DataFrame:
        """(by, qid, doc_id, score, rank): the k best documents of each query (qid, term, qtf), of each partition if ``by`` is given.

        allowed: (qid, by) of the partitions that a query may see; without it all. Scores are rounded to 6 places and above 0; ties by doc_id.
        """
        if k1 <= 0 or not 0 <= b <= 1:
            raise ValueError("k1 must be above 0 and b between 0 and 1")
        if not set(by) <= set(self.keys):
            raise ValueError(f"figures are kept by {self.keys}")
        n_buckets, spark = int(self.facts["buckets"]), terms.sparkSession
        bucket = F.pmod(_hash(F.col("term")), F.lit(n_buckets)).cast("int").alias("bucket")
        rows = terms.select("qid", "term", "qtf", bucket).limit(BROADCAST_ROWS + 1).collect()  # a batch of more is not held here
        small = len(rows) <= BROADCAST_ROWS
        side = F.broadcast if small else lambda x: x
        limited = lambda df: df if allowed is None else df.join(F.broadcast(allowed) if few(allowed) else allowed, ["qid", *by], "left_semi")
        order = [F.desc("score"), F.asc("doc_id")]
        ids, words = sorted({r.qid for r in rows}), sorted({r.term for r in rows})
        if small and 0 < len(ids) * len(words) <= MATRIX_CELLS:
            named = spark.createDataFrame(list(zip(words, range(len(words)), strict=True)), "term string, number int")
            weights = self.weights(named, sorted({r.bucket for r in rows}), side, by, keep, k1, b)
            # a query sees all of a partition or none of it, so the k best may be taken first
            found = self._multiplied(weights, rows, ids, words, dict(terms.dtypes)["qid"], by, k)
            return top(limited(found), ["qid", *by], order, k)
        buckets = sorted({r.bucket for r in rows}) if small else [r.bucket for r in terms.select(bucket).distinct().orderBy("bucket").collect()]  # at most BUCKETS
        weights = self.weights(terms.select("term").distinct(), buckets, side, by, keep, k1, b)
        met = limited(weights.join(side(terms), "term"))
        found = met.groupBy(*by, "qid", "doc_id").agg(F.round(F.sum(F.col("w") * F.col("qtf")), 6).alias("score")).where("score > 0")
        return top(found, ["qid", *by], order, k)

    def _multiplied(self, weights: DataFrame, rows: list, ids: list, words: list, kind: str, by: tuple[str, ...], k: int) -> DataFrame:
        """(by, qid, doc_id, score) of what each task's documents score, its k best of each query and partition.

        They are kept over all blocks of a task; where they are more than HELD_ROWS / 2, each run of blocks sends its own.
        """
        number = {w: i for i, w in enumerate(words)}
        place = {q: i for i, q in enumerate(ids)}
        matrix = np.zeros((len(words), len(ids)))
        for r in rows:
            matrix[number[r.term], place[r.qid]] += r.qtf
        shared = weights.sparkSession.sparkContext.broadcast(matrix)
        names = np.array(ids, object)
        parts = list(by)
        doc_kind = dict(weights.dtypes)["doc_id"]

        def cut(held: dict[tuple, list]) -> dict[tuple, list]:
            return {key: [dense.k_best(*(np.concatenate(x) for x in zip(*found, strict=True)), k)] for key, found in held.items()}

        def sent(held: dict[tuple, list]) -> Iterator[pd.DataFrame]:
            for key, found in held.items():
                for j, score, own in found:
                    yield pd.DataFrame(dict(zip(parts, key, strict=True)) | {"qid": names[j], "doc_id": own, "score": score})

        def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            queries = shared.value
            step = max(1, BLOCK_VALUES // max(1, max(queries.shape)))
            held: dict[tuple, list] = {}  # of each partition the number of the query, score and id
            rows_held = 0
            for frame in frames:
                for at in range(0, len(frame), step):
                    some = frame.iloc[at : at + step]
                    sizes = some.n.map(len).to_numpy()
                    block = np.zeros((len(some), len(queries)))
                    block[np.repeat(np.arange(len(some)), sizes), np.concatenate(some.n.to_list())] = np.concatenate(some.w.to_list())
                    scores = np.round(block @ queries, 6)
                    groups = [((), np.arange(len(some)))] if not parts else [(key, np.flatnonzero(rows_)) for key, rows_ in _groups(some, parts)]
                    for key, own in groups:
                        mine = scores[own]
                        if len(own) > k:
                            least = np.partition(mine, len(own) - k, axis=0)[len(own) - k]
                            i, j = np.nonzero((mine >= least) & (mine > 0))
                        else:
                            i, j = np.nonzero(mine > 0)
                        held.setdefault(key, []).append((j, mine[i, j], some.doc_id.to_numpy()[own[i]]))
                        rows_held += len(i)
                    if rows_held > HELD_ROWS:
                        held = cut(held)
                        rows_held = sum(len(j) for found in held.values() for j, _, _ in found)
                        if rows_held > HELD_ROWS // 2:
                            yield from sent(held)
                            held, rows_held = {}, 0
            yield from sent(cut(held))

        gathered = weights.groupBy(*by, "doc_id").agg(F.collect_list("number").alias("n"), F.collect_list("w").alias("w"))  # at most the query terms a document
        schema = ", ".join([*(f"{c} {dict(weights.dtypes)[c]}" for c in by), f"qid {kind}", f"doc_id {doc_kind}", "score double"])
        return gathered.mapInPandas(run, schema)


def _groups(rows: pd.DataFrame, parts: list[str]) -> Iterator[tuple[tuple, np.ndarray]]:
    codes, keys = pd.factorize(pd.MultiIndex.from_frame(rows[parts]))
    for k, key in enumerate(keys):
        yield tuple(key), codes == k


def query_terms(queries: DataFrame, id_col: str = "qid", text_col: str = "query") -> DataFrame:
    """(qid, term, qtf), equal raw tokens counted before they are cut into terms."""
    rows = counted(queries.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")), [])
    each = rows.select(F.col("doc_id").alias("qid"), "n", F.explode(expanded(F.col("raw"))).alias("term"))
    return each.groupBy("qid", "term").agg(F.sum("n").alias("qtf"))
