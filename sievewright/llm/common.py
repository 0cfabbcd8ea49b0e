"""Helpers shared by the training-data operators: tables, work folders, batches."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.common import spread

#: Rows and bytes of one Arrow batch handed to a Python worker; long texts make small batches.
BATCH_ROWS = 2000
BATCH_BYTES = 32 << 20

#: A join broadcasts the keys with more than 1 / HOT_KEYS of all rows, and more than HOT_ROWS.
HOT_KEYS = 10_000
HOT_ROWS = 1000

_left: dict[str, list[str]] = {}


def prepare(spark: SparkSession) -> None:
    """Bound the Arrow batches, so that a batch of very long texts fits a worker."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir.

    Where it is unset, a temporary folder serves a local session, as in tests; a cluster's executors
    could not read one, so there it is an error.
    """
    where = spark.conf.get("spark.checkpoint.dir", None)
    if where:
        return where.rstrip("/")
    context = spark.sparkContext
    if context._jsc.sc().getCheckpointDir().isEmpty():
        if not context.master.split("[")[0] == "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        context.setCheckpointDir("file://" + tempfile.mkdtemp(prefix="sievewright-"))
    return context._jsc.sc().getCheckpointDir().get().rstrip("/")


def new_path(spark: SparkSession, what: str) -> str:
    """A path in the shared folder that ``sweep`` deletes, at the latest when the program ends."""
    path = f"{shared_dir(spark)}/sievewright-{what}-{uuid.uuid4().hex}"
    if not _left:
        atexit.register(_sweep_at_exit)
    _left.setdefault(spark.sparkContext.applicationId, []).append(path)
    return path


def written(df: DataFrame, what: str) -> DataFrame:
    """Write a table to the shared folder and read it back: lineage ends there, and no executor holds it."""
    path = new_path(df.sparkSession, what)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def stored(df: DataFrame, what: str) -> DataFrame:
    """As ``written``, but ``sweep`` leaves the table: for results that a caller still reads."""
    path = f"{shared_dir(df.sparkSession)}/sievewright-{what}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def drop_path(spark: SparkSession, path: str) -> None:
    jvm = spark._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


def sweep(spark: SparkSession) -> None:
    """Delete the tables that earlier operators left; call it once their results are stored."""
    for path in _left.pop(spark.sparkContext.applicationId, []):
        drop_path(spark, path)


def _sweep_at_exit() -> None:
    spark = SparkSession.getActiveSession()
    if spark is not None and spark.sparkContext._jsc is not None:
        sweep(spark)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents; a table of fewer files than there are cores is dealt over the cores."""
    return spread(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def id_and_text(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, text) with the text as UTF-8 bytes; null stays null, other columns are left out."""
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").cast("binary").alias("text"))


def hash_bound(rows: int, wanted: int) -> int:
    """A 64-bit hash that about four times as many of ``rows`` rows lie under as are wanted; the largest one if there are few."""
    return (1 << 63) - 1 if rows <= 8 * wanted else -(1 << 63) + (4 * wanted << 64) // rows


def dealt_join(left: DataFrame, right: DataFrame, key: str, how: str = "inner") -> DataFrame:
    """``left`` joined with ``right``, which has a row a key, without a task for all rows of a hot key.

    Keys with more than 1 / HOT_KEYS of the rows of ``left`` are at most HOT_KEYS; their rows of ``right`` are
    broadcast, and the others shuffled. ``left`` is read three times, so it should be a written table.
    """
    rows = left.count()
    hot = left.groupBy(key).agg(F.count(F.lit(1)).alias("n")).where((F.col("n") > max(rows // HOT_KEYS, HOT_ROWS)) & F.col(key).isNotNull())
    keys = written(hot.select(key), "hot-keys")  # at most HOT_KEYS rows
    if keys.isEmpty():
        return left.join(right, key, how)
    few = F.broadcast(keys)
    return left.join(few, key, "left_semi").join(F.broadcast(right.join(few, key, "left_semi")), key, how).unionByName(left.join(few, key, "left_anti").join(right, key, how))
