"""Helpers of the operators: broadcasts behind a size check, top-k."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Rows that a table may have to be broadcast.
BROADCAST_ROWS = 200_000


def few(df: DataFrame, rows: int = BROADCAST_ROWS) -> bool:
    """Whether a table has at most ``rows`` rows; reads no more than one beyond."""
    return df.limit(rows + 1).count() <= rows


def small(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """Mark a table for broadcast if it has at most ``rows`` rows; a larger one is joined by a shuffle."""
    return F.broadcast(df) if few(df, rows) else df


#: Bytes of files for each core below which a table is dealt out, if it has fewer files than there are cores.
SPREAD_BYTES = 32 << 20


def spread(df: DataFrame) -> DataFrame:
    """A small table of fewer files than there are cores, dealt over the cores; a larger one, which its scan splits, stays as it is."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    size = int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    return df.repartition(cores) if size <= cores * SPREAD_BYTES and 0 < len(df.inputFiles()) < cores else df


#: Bytes of text that a task cuts into terms and counts, and rows that it sorts for a file.
DEALT_BYTES, SORTED_ROWS = 4 << 20, 1_000_000


def dealt(df: DataFrame, item: str, text: str, limit: int | None = None) -> DataFrame:
    """Texts dealt by ``item`` into as many parts as they have ``limit`` bytes (DEALT_BYTES), so a task that counts their terms holds no more, whatever the table.

    What is grouped by ``item`` and more is not shuffled again.
    """
    limit = limit or DEALT_BYTES
    size = df.agg(F.sum(F.octet_length(text))).first()[0] or 0
    return df.repartition(max(df.sparkSession.sparkContext.defaultParallelism, -(-size // limit)), F.col(item))


#: Rows and bytes of a batch of texts or vectors that a Python worker holds.
BATCH_ROWS, BATCH_BYTES = 2000, 32 << 20


def bounded_batches(spark: SparkSession) -> None:
    """Bound the batches that Python workers get, so that those of long texts are small."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def top(df: DataFrame, by: list[str], order: list[Column], k: int, rank: str = "rank") -> DataFrame:
    """The first k rows of each group with their rank from 1; Spark limits each task's groups before the shuffle."""
    return df.withColumn(rank, F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col(rank) <= k)
