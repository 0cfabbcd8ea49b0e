"""Exact dense search: inner products of unit vectors, for a batch of query vectors."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, top
from .workspace import new_path

#: Scores that a task holds at once, and values of query vectors that one pass over the collection carries.
CELLS = 1 << 20
PASS_VALUES = 8 << 20


def dot(a: Column, b: Column) -> Column:
    """Inner product of two arrays, in double."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def normalised(v: Column) -> Column:
    """The vector at unit length; a zero vector stays."""
    length = F.sqrt(dot(v, v))
    return F.when(length > 0, F.transform(v, lambda x: x / length)).otherwise(v)


def k_best(query: np.ndarray, score: np.ndarray, own: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The k rows of each query with the largest scores, NaN above all as in Spark's order, ties by id."""
    ties = np.unique(own, return_inverse=True)[1] if own.dtype == object else own
    order = np.lexsort((ties, np.where(np.isnan(score), -np.inf, -score), query))
    sorted_ = query[order]
    starts = np.flatnonzero(np.concatenate([[True], sorted_[1:] != sorted_[:-1]])) if len(order) else order
    nth = np.arange(len(order)) - np.repeat(starts, np.diff(np.append(starts, len(order))))
    order = order[nth < k]
    return query[order], score[order], own[order]


def _scored(batches: Iterator[pd.DataFrame], ids: list, matrix: np.ndarray, k: int, digits: int, parts: list[str]) -> Iterator[pd.DataFrame]:
    """(parts, qid, id, score): the k best rows (parts, id, v) of a task for each query, of each partition."""
    names = np.array(ids)
    best: dict[tuple, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}  # of each partition the number of the query, score and id, k a query
    for batch in batches:
        batch = batch.dropna(subset=["id", "v"])
        groups = [((), batch)] if not parts else batch.groupby(parts, dropna=False)
        for key, some in groups:
            if not len(some):
                continue
            own, mine = some.id.to_numpy(), np.array(some.v.tolist(), np.float64)
            new = []
            step = max(1, CELLS // len(own))
            for at in range(0, len(ids), step):
                score = np.round(mine @ matrix[at : at + step].T, digits)
                if len(own) > k:
                    i, j = np.nonzero(~(score < np.partition(score, len(own) - k, axis=0)[len(own) - k]))  # NaN is last there
                else:
                    i, j = (x.ravel() for x in np.indices(score.shape))
                new.append(k_best(j + at, score[i, j], own[i], k))
            held = [best[key]] if key in best else []
            best[key] = k_best(*(np.concatenate(x) for x in zip(*held, *new, strict=True)), k)
    for key, (j, score, own) in best.items():
        for at in range(0, len(j), CELLS):
            part = slice(at, at + CELLS)
            yield pd.DataFrame(dict(zip(parts, key, strict=True)) | {"qid": names[j[part]], "id": own[part], "score": score[part]})


def search(vectors: DataFrame, queries: DataFrame, k: int, id_col: str, vec_col: str, qid_col: str, query_col: str, digits: int = 6, by: tuple[str, ...] = ()) -> DataFrame:
    """(by, qid, id, score, rank): the k best vectors of each query, of each partition if ``by``, columns of ``vectors``, is given.

    Each task multiplies its batches with blocks of queries, CELLS scores at once, and keeps its own k best, so k rows a
    query, partition and task are held and shuffled. Query vectors are a stated set. Sets of up to PASS_VALUES values are sent to the tasks at
    once; a larger one takes several passes over the collection, whose results are written one after another, so the
    driver never holds more than one pass.
    """
    bounded_batches(vectors.sparkSession)
    kinds, qkind = dict(vectors.dtypes), dict(queries.dtypes)[qid_col]
    parts = list(by)
    asked = queries.where(F.col(query_col).isNotNull()).select(F.col(qid_col).alias("qid"), F.col(query_col).cast("array<double>").alias("query"))
    schema = ", ".join([*(f"{c} {kinds[c]}" for c in parts), f"qid {qkind}", f"id {kinds[id_col]}", "score double"])

    def searched(rows: list) -> DataFrame:
        rows = sorted(rows, key=lambda r: r.qid)
        ids, matrix = [r.qid for r in rows], np.array([r.query for r in rows], np.float64)

        run = lambda batches: _scored(batches, ids, matrix, k, digits, parts)
        return vectors.select(*parts, F.col(id_col).alias("id"), F.col(vec_col).alias("v")).mapInPandas(run, schema)

    values = asked.agg(F.coalesce(F.sum(F.size("query").cast("long")), F.lit(0))).first()[0]
    passes = -(-values // PASS_VALUES)
    if passes <= 1:
        found = searched(asked.collect()) if values else vectors.sparkSession.createDataFrame([], schema)
    else:
        path = new_path(vectors.sparkSession, "passes")
        for n in range(passes):
            some = asked.where(F.pmod(F.xxhash64("qid"), F.lit(passes)) == n).collect()  # about PASS_VALUES values
            if some:
                searched(some).write.mode("append").parquet(path)
        found = vectors.sparkSession.read.schema(schema).parquet(path)
    return top(found, [*parts, "qid"], [F.desc("score"), F.asc("id")], k)
