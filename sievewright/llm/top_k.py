"""Exact top-k search by inner product, pruned by segment statistics from coarse to fine.

Every vector is cut into 1, 4 and 16 segments, and for each segment of L components its mean m
and deviation s are kept. Two vectors are at least as far apart as
``sum L * ((m - m')**2 + (s - s')**2)`` (squared distance), and the finer the segments the closer
that comes to the truth. Since |q - x|**2 = |q|**2 + |x|**2 - 2 q.x, a candidate whose distance
is surely above |q|**2 + |x|**2 - 2 * (the k-th best score so far) cannot be among the first k. A block
of candidates goes through the levels one after another; rows and columns without a survivor are
left out of the next, and the exact scores are computed for what survives all.

A query starts with the k-th best score among the other queries of its block, which are
candidates too, so the first block is pruned already. Each task sends on at most k candidates a
query, and a window takes the first k of them: results are those of comparing all pairs.

Vectors that are null or hold null or non-finite components take no part, nor do rows with a
null id. Rows that share a query's id are not its candidates; of such rows one asks (that with
the least vector), and all are candidates of others. Ties go to the smaller id; fewer than k
candidates are returned all; vectors of other lengths go on with zeros; an empty table gives no
rows. Only the id and the vector are read, so other columns may have any name.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .vector_blocks import LEAST, Best, Block, dealt, exact, once, packed, participating, passes, products

K = 5
#: Every row whose id is divisible by it asks.
EVERY = 50
#: Segments of a level, from coarse to fine; a level with segments of fewer than two components is left out.
SEGMENTS = (1, 4, 16)
#: Pairs of a block below which survivors are multiplied one by one, as a share of the block.
SPARSE = 0.1
_SCHEMA = "query_id long, vec_id long, score long"


def levels(dim: int) -> list[int]:
    return [s for s in SEGMENTS if 2 * s <= dim]


def statistics(vectors: np.ndarray) -> np.ndarray:
    """The square of each vector's length, then, level by level, sqrt(L) times the mean and the deviation of each segment."""
    dim = vectors.shape[1]
    out = [(vectors**2).sum(axis=1, keepdims=True)]
    for number in levels(dim):
        edges = np.linspace(0, dim, number + 1).astype(int)
        sizes = np.diff(edges)
        means = np.add.reduceat(vectors, edges[:-1], axis=1) / sizes
        spread = np.add.reduceat((vectors - np.repeat(means, sizes, axis=1)) ** 2, edges[:-1], axis=1) / sizes
        out += [np.sqrt(sizes) * means, np.sqrt(sizes * spread)]
    return np.concatenate(out, axis=1)


def lower_bounds(left: np.ndarray, right: np.ndarray, squares: np.ndarray) -> np.ndarray:
    """The least squared distance that statistics of one level allow; squares are the sums of the squared lengths.

    The statistics of a level are vectors of the same lengths as the vectors themselves, so the bound is the
    squared distance of the statistics.
    """
    return squares - 2 * (left @ right.T)


def survivors(query: Block, block: Block, kth: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, column, score) of pairs that no bound excludes, ids that are the query's own left out; kth is the score to reach."""
    rows, cols = np.arange(len(query.ids)), np.arange(len(block.ids))
    alive = query.ids[:, None] != block.ids[None, :]
    known = kth > LEAST
    if query.dim == block.dim and query.dim and exact(query.vectors, query.vectors) and exact(block.vectors, block.vectors):
        of_q, of_b = (np.frombuffer(b.more, np.float64).reshape(len(b.ids), -1) for b in (query, block))
        at, aim = 1, np.where(known, kth.astype(np.float64), -np.inf)
        for number in levels(query.dim):
            a, b = of_q[rows, at : at + 2 * number], of_b[cols, at : at + 2 * number]
            at += 2 * number
            squares = of_q[rows, :1] + of_b[cols, 0]
            # scores are whole numbers, so 1 in the squared distance covers the rounding of the bound
            alive &= lower_bounds(a, b, squares) <= squares - 2 * aim[rows][:, None] + 1 + 1e-9 * squares
            r, c = alive.any(axis=1), alive.any(axis=0)
            rows, cols, alive = rows[r], cols[c], alive[np.ix_(r, c)]
            if not len(rows):
                break
    i, j = np.nonzero(alive)
    if len(i) > SPARSE * alive.size or not exact(query.vectors, block.vectors):
        score = products(query.vectors[rows], block.vectors[cols])[i, j]
    else:
        dim, score = min(query.dim, block.dim), np.zeros(len(i), np.int64)
        step = max(1, (1 << 22) // max(1, dim))
        for lo in range(0, len(i), step):
            x, y = rows[i[lo : lo + step]], cols[j[lo : lo + step]]
            score[lo : lo + step] = np.einsum("ij,ij->i", query.vectors[x, :dim], block.vectors[y, :dim]).astype(np.int64)
    hit = score >= kth[rows[i]]
    return rows[i][hit], cols[j][hit], score[hit]


def _start(k: int):
    """For packed query blocks: the k-th best score of each query among the others of its block, and its statistics."""

    def more(ids: np.ndarray, vectors: np.ndarray) -> np.ndarray:
        first = Best(len(ids), k)
        scores = products(vectors, vectors)
        if len(ids) > k:
            low = np.partition(np.where(ids[:, None] != ids, scores, LEAST), len(ids) - k, axis=1)[:, len(ids) - k]
            first.kth = low
        # as two halves, each exact in a float64
        return np.concatenate([np.column_stack([first.kth >> 32, first.kth & 0xFFFFFFFF]).astype(np.float64), statistics(vectors)], axis=1)

    return more


def _meet(k: int):
    def run(pairs: Iterator) -> Iterator[pa.RecordBatch]:
        held: dict[tuple, tuple[Block, Best]] = {}
        for key, query, block in pairs:
            if key not in held:
                both = np.frombuffer(query.more, np.float64).reshape(len(query.ids), -1)
                best = Best(len(query.ids), k)
                best.kth = (both[:, 0].astype(np.int64) << 32) | both[:, 1].astype(np.int64)
                query.more = both[:, 2:].tobytes()
                held[key] = query, best
            query, best = held[key]
            row, col, score = survivors(query, block, best.kth)
            best.add(row, score, block.ids[col])
        for query, best in held.values():
            yield pa.RecordBatch.from_arrays([pa.array(query.ids[best.row]), pa.array(best.id), pa.array(best.score)], ["query_id", "vec_id", "score"])

    return run


def search(queries: DataFrame, candidates: DataFrame, k: int = K) -> DataFrame:
    """(query_id, rank, vec_id, score): the k best candidates of each query; both are (id, label, vector) of ``participating``."""
    found = passes(dealt(once(queries), _start(k)), packed(candidates, lambda _, vectors: statistics(vectors)), _meet(k), _SCHEMA)
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), F.asc("vec_id")))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op12_top_k(embeddings: DataFrame, asks: Column | None = None) -> DataFrame:
    rows = participating(embeddings)
    return search(rows.where(F.col("id") % EVERY == 0 if asks is None else asks), rows)
