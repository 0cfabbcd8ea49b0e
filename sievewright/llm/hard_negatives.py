"""Hard negatives for contrastive training: blocked matrix products in two passes.

Anchors are packed into blocks that are broadcast against blocks of all rows; a pair of blocks is
one float64 product (exact below 2**53). The first pass keeps, for each anchor and task, the first
rows of its own label: five positives, which a window merges. The second holds the anchors, with the
scores of their positives, against all rows again, and keeps for each anchor and positive the first rows
of other labels whose score lies between two shares of the positive's. Either way a task keeps and
sends on at most k rows for each, so nothing grows with a label's rows.

Rows with a null label, a null vector or null or non-finite components take no part, nor do rows
with a null id. Rows that share an anchor's id are not among its positives or negatives; of such rows
one is the anchor (that with the least label and vector), and each counts as a row of others. Ties go to
the smaller id. A positive score below zero allows no negative, and one of zero only scores of zero.
An anchor without positives, or a positive without negatives in its window, gives no rows; an
empty table gives none. Vectors of other lengths go on with zeros. Other columns may have any name.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import written
from .vector_blocks import LEAST, MOST, Best, Block, dealt, once, packed, participating, passes, products

POSITIVES, NEGATIVES = 5, 10
#: A negative's score in hundredths of the positive's.
LOW, HIGH = 30, 90
#: Every row whose id is divisible by it is an anchor; labels of rows divisible by RELABELLED are moved on, modulo LABELS.
EVERY, RELABELLED, LABELS = 100, 7, 10


def window(score: int) -> tuple[int, int]:
    """The least and the highest score that a negative of a positive with ``score`` may have."""
    return -(-LOW * score // 100), HIGH * score // 100


def _positives(k: int):
    def run(pairs: Iterator) -> Iterator[pa.RecordBatch]:
        held: dict[tuple, tuple[Block, Best]] = {}
        for key, anchor, block in pairs:
            _, best = held.setdefault(key, (anchor, Best(len(anchor.ids), k)))
            scores = products(anchor.vectors, block.vectors)
            row, col = np.nonzero((anchor.labels[:, None] == block.labels) & (anchor.ids[:, None] != block.ids) & (scores >= best.kth[:, None]))
            best.add(row, scores[row, col], block.ids[col])
        for anchor, best in held.values():
            yield pa.RecordBatch.from_arrays([pa.array(anchor.ids[best.row]), pa.array(best.id), pa.array(best.score)], ["anchor_id", "positive_id", "positive_score"])

    return run


def _negatives(slots: int, k: int):
    def run(pairs: Iterator) -> Iterator[pa.RecordBatch]:
        held: dict[tuple, tuple] = {}
        for key, anchor, block in pairs:
            if key not in held:
                extra = np.frombuffer(anchor.more, np.int64).reshape(len(anchor.ids), -1)  # number, ids and scores of the positives
                number, of = extra[:, 0], extra[:, 1 + slots :]
                low, high = np.full(of.shape, MOST), np.full(of.shape, LEAST)
                for i, n in enumerate(number.tolist()):
                    for s in range(n):
                        low[i, s], high[i, s] = window(int(of[i, s]))
                held[key] = anchor, extra, low, high, [Best(len(anchor.ids), k) for _ in range(slots)]
            anchor, _, low, high, found = held[key]
            scores = products(anchor.vectors, block.vectors)
            others = anchor.labels[:, None] != block.labels
            for s, best in enumerate(found):
                row, col = np.nonzero(others & (scores >= np.maximum(low[:, s], best.kth)[:, None]) & (scores <= high[:, s, None]) & (anchor.ids[:, None] != block.ids))
                best.add(row, scores[row, col], block.ids[col])
        for anchor, extra, _, _, found in held.values():
            for s, best in enumerate(found):
                columns = [anchor.ids[best.row], np.full(len(best.row), s + 1, np.int32), extra[best.row, 1 + s], best.id, extra[best.row, 1 + slots + s], best.score]
                yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(c)) for c in columns], ["anchor_id", "positive_rank", "positive_id", "negative_id", "positive_score", "negative_score"])

    return run


def positives(anchors: DataFrame, rows: DataFrame, k: int = POSITIVES) -> DataFrame:
    """(anchor_id, positive_rank, positive_id, positive_score): the first k other rows of an anchor's label."""
    found = passes(dealt(anchors), packed(rows), _positives(k), "anchor_id long, positive_id long, positive_score long")
    rank = F.row_number().over(Window.partitionBy("anchor_id").orderBy(F.desc("positive_score"), F.asc("positive_id")))
    return found.withColumn("positive_rank", rank).where(F.col("positive_rank") <= k)


def mined(anchors: DataFrame, rows: DataFrame, n_positives: int = POSITIVES, n_negatives: int = NEGATIVES) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score, positive_rank): the first negatives of each anchor and positive."""
    anchors = written(once(anchors), "anchors")
    of = positives(anchors, rows, n_positives)
    each = of.groupBy("anchor_id").agg(F.array_sort(F.collect_list(F.struct("positive_rank", "positive_id", "positive_score"))).alias("p"))  # at most n_positives
    slot = lambda name: F.transform(F.sequence(F.lit(1), F.lit(n_positives)), lambda i: F.coalesce(F.get(F.col(f"p.{name}"), i - 1), F.lit(0).cast("long")))
    extra = F.concat(F.array(F.size("p").cast("long")), slot("positive_id"), slot("positive_score"))
    asked = anchors.join(each, anchors.id == each.anchor_id).select("id", "label", "vector", extra.alias("extra"))
    schema = "anchor_id long, positive_rank int, positive_id long, negative_id long, positive_score long, negative_score long"
    found = passes(dealt(asked), packed(rows), _negatives(n_positives, n_negatives), schema)
    rank = F.row_number().over(Window.partitionBy("anchor_id", "positive_rank").orderBy(F.desc("negative_score"), F.asc("negative_id")))
    return found.withColumn("rank", rank).where(F.col("rank") <= n_negatives).select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score", "positive_rank")


def label_of() -> Column:
    """The label of a row of ``embeddings``, moved on where the id asks for it."""
    moved = (F.col("label").cast("long") + 1) % LABELS
    return F.when(F.col("vec_id") % RELABELLED == 0, moved).otherwise(F.col("label").cast("long"))


def op13_hard_negatives(embeddings: DataFrame) -> DataFrame:
    rows = participating(embeddings, label=label_of())
    return mined(rows.where(F.col("id") % EVERY == 0), rows)
