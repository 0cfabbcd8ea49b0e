"""Blocks of whole-number vectors: a bounded query set against all rows, block by block.

``participating`` takes the rows that have a vector of finite numbers and turns each component x
into floor(SCALE * x). ``packed`` packs rows into blocks of at most BLOCK_BYTES, as matrices in
binaries. ``passes`` holds every block of a query set against every block of the candidates: the
query blocks are a written table, and each pass broadcasts at most GROUP of its parts (a proven
bound), so the driver never holds the query set, whatever its size.

Scores are inner products of whole numbers. Where no sum can reach 2**53 a float64 product is
exact; blocks that might go beyond are multiplied with Python's integers, and a score that does
not fit a long becomes the nearest long. Vectors of different lengths are compared as if the
shorter one went on with zeros. Rows without an id take no part.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import new_path, prepare, written

SCALE = 256
#: Rows and bytes of a block's matrix.
BLOCK_ROWS, BLOCK_BYTES = 1024, 1 << 20
#: Parts of the query set that one pass broadcasts; a part is one block, or few.
GROUP = 32
EXACT = 2.0**53
LEAST, MOST = np.iinfo(np.int64).min, np.iinfo(np.int64).max
BLOCK = "part int, number int, dim int, ids binary, labels binary, vectors binary, more binary"


def participating(table: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label: Column | None = None) -> DataFrame:
    """(id, label, vector): rows with an id and a vector of finite numbers, and with a label if one is asked for."""
    finite = F.forall("vector", lambda x: x.isNotNull() & (x > float("-inf")) & (x < float("inf")))  # NaN is above infinity
    rows = table.select(F.col(id_col).cast("long").alias("id"), (F.lit(0) if label is None else label).cast("long").alias("label"), F.col(vector_col).cast("array<double>").alias("vector"))
    return rows.where(F.col("id").isNotNull() & F.col("label").isNotNull() & F.col("vector").isNotNull()).where(finite)


def once(rows: DataFrame) -> DataFrame:
    """One row an id: of rows that repeat one, that with the least label and vector."""
    one = rows.groupBy("id").agg(F.min(F.struct("label", "vector")).alias("row"))
    return one.select("id", "row.label", "row.vector")


def packed(rows: DataFrame, more: Callable[[np.ndarray, np.ndarray], np.ndarray] | None = None) -> DataFrame:
    """Blocks (BLOCK) of rows (id, label, vector[, extra array<long>]) of one length each.

    ``more`` makes a float64 matrix from (ids, vectors), with a row each, that travels with the block; without
    it, the arrays of ``extra`` do.
    """
    prepare(rows.sparkSession)

    def block(part: int, number: int, ids: np.ndarray, labels: np.ndarray, vectors: np.ndarray, extra: np.ndarray | None) -> tuple:
        beside = more(ids, vectors) if more else extra
        return part, number, vectors.shape[1], ids.tobytes(), labels.tobytes(), vectors.tobytes(), b"" if beside is None else beside.tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, number = TaskContext.get().partitionId(), 0
        for batch in batches:
            ids, labels = (np.asarray(batch.column(k)) for k in (0, 1))
            lists = batch.column(2)
            sizes, flat = np.asarray(lists.value_lengths()), np.floor(SCALE * np.asarray(lists.flatten(), np.float64))
            starts = np.cumsum(sizes) - sizes
            extra = np.asarray(batch.column(3).flatten()).reshape(len(ids), -1) if batch.num_columns > 3 and len(ids) else None
            out = []
            for dim in np.unique(sizes).tolist():
                own = np.flatnonzero(sizes == dim)
                step = min(BLOCK_ROWS, max(1, BLOCK_BYTES // max(1, 8 * dim)))
                for at in range(0, len(own), step):
                    some = own[at : at + step]
                    vectors = flat[starts[some][:, None] + np.arange(dim)] if dim else np.zeros((len(some), 0))
                    out.append(block(part, number, ids[some], labels[some], vectors, None if extra is None else extra[some]))
                    number += 1
            if out:
                kinds = (pa.int32(), pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.binary(), pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(c, kind) for c, kind in zip(zip(*out, strict=True), kinds, strict=True)], ["part", "number", "dim", "ids", "labels", "vectors", "more"])

    return rows.mapInArrow(run, BLOCK)


def dealt(rows: DataFrame, more: Callable[[np.ndarray, np.ndarray], np.ndarray] | None = None) -> tuple[DataFrame, int]:
    """(the blocks of a query set, written; the number of their parts), in parts of about one block."""
    kept = written(rows, "queries")
    wide = kept.agg(F.coalesce(F.sum(F.size("vector").cast("long")), F.lit(0)).alias("w"), F.count(F.lit(1)).alias("n")).first()
    parts = max(1, -(-wide.n // BLOCK_ROWS), -(-wide.w * 8 // BLOCK_BYTES))
    return written(packed(kept.repartition(parts), more), "query-blocks"), parts


def passes(queries: tuple[DataFrame, int], candidates: DataFrame, meet: Callable[[Iterator], Iterator[pa.RecordBatch]], schema: str, group: int = GROUP) -> DataFrame:
    """What ``meet`` makes, in each task, of pairs of a query block and a candidate block.

    ``meet`` gets an iterator of (key of the query block, query block, candidate block), each a ``Block``.
    A pass reads the candidates once for ``group`` parts of the query set; the results of several passes are
    written to the shared folder one after another, so each is lost or made as a whole.
    """
    blocks, parts = queries

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def pairs():
            for batch in batches:
                columns = [c.to_pylist() for c in batch.columns]
                for row in zip(*columns, strict=True):
                    yield row[:2], Block(*row[2:7]), Block(*row[7:])

        return meet(pairs())

    cols = ["dim", "ids", "labels", "vectors", "more"]
    asked = blocks.select("part", "number", *(F.col(c).alias(f"q_{c}") for c in cols))
    against = candidates.select(*cols)

    def one(some: DataFrame) -> DataFrame:
        # every pair of blocks is wanted; the broadcast side has at most ``group`` parts
        pairs = against.crossJoin(F.broadcast(some))
        return pairs.select("part", "number", *(f"q_{c}" for c in cols), *cols).mapInArrow(run, schema)

    if parts <= group:
        return one(asked)
    path = new_path(blocks.sparkSession, "passes")
    for first in range(0, parts, group):
        one(asked.where(F.col("part").between(first, first + group - 1))).write.mode("append").option("compression", "zstd").parquet(path)
    return blocks.sparkSession.read.schema(schema).parquet(path)


class Block:
    """A block's rows as arrays; ``more`` is read by those who packed it."""

    def __init__(self, dim: int, ids: bytes, labels: bytes, vectors: bytes, more: bytes):
        self.dim, self.more = dim, more
        self.ids, self.labels = np.frombuffer(ids, np.int64), np.frombuffer(labels, np.int64)
        self.vectors = np.frombuffer(vectors, np.float64).reshape(len(self.ids), dim)


def exact(left: np.ndarray, right: np.ndarray) -> bool:
    """Whether float64 products of the rows are exact."""
    dim = min(left.shape[1], right.shape[1])
    return not dim or not len(left) or not len(right) or dim * np.abs(left).max() * np.abs(right).max() < EXACT


def products(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Inner products of all rows of two matrices of whole numbers, as longs."""
    dim = min(left.shape[1], right.shape[1])
    left, right = left[:, :dim], right[:, :dim]
    if exact(left, right):
        return (left @ right.T).astype(np.int64)
    whole = [[int(x) for x in row] for row in right.tolist()]
    rows = [[min(MOST, max(LEAST, sum(x * y for x, y in zip(a, b, strict=True)))) for b in whole] for a in ([int(x) for x in row] for row in left.tolist())]
    return np.array(rows, np.int64).reshape(len(left), len(right))


class Best:
    """The first k of the hits of each of n rows so far: highest scores first, ties by smaller id."""

    def __init__(self, n: int, k: int):
        self.k, self.n = k, n
        self.row, self.score, self.id = (np.zeros(0, np.int64) for _ in range(3))
        self.kth = np.full(n, LEAST, np.int64)  # a hit below it cannot be among the first k

    def add(self, row: np.ndarray, score: np.ndarray, ids: np.ndarray) -> None:
        if not len(row):
            return
        row, score, ids = (np.concatenate(x) for x in ((self.row, row), (self.score, score), (self.id, ids)))
        order = np.lexsort((ids, ~score, row))  # ~ turns the order round and cannot overflow
        row, score, ids = row[order], score[order], ids[order]
        counts = np.bincount(row, minlength=self.n)
        place = np.arange(len(row)) - np.repeat(np.cumsum(counts) - counts, counts)
        keep = place < self.k
        self.row, self.score, self.id = row[keep], score[keep], ids[keep]
        last = place == self.k - 1
        self.kth[row[last]] = np.maximum(self.kth[row[last]], score[last])
