"""Structured Streaming: incremental document sync and event windows."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.types import StructType

from ..operators import ingest

#: Parts of the state of documents: a batch rewrites those that its keys fall into.
PARTS = 64
EVENTS = "event_id long, ts timestamp, user_id long, event_type string, value double, props string"


def latest(rows: DataFrame, key: str, order: str) -> DataFrame:
    """The last version of each key of a batch."""
    return rows.withColumn("_r", F.row_number().over(Window.partitionBy(key).orderBy(F.desc(order)))).where("_r = 1").drop("_r")


def _pointers(spark: SparkSession, state: str, number: int) -> dict[int, int]:
    """{part: batch that wrote it last} as of a batch; empty before the first one."""
    if number < 0:
        return {}
    return {r.part: r.at for r in spark.read.schema("part int, at long").json(f"{state}/pointers/batch={number}").collect()}  # at most PARTS rows


def _read(spark: SparkSession, state: str, schema: StructType, where: dict[int, int]) -> DataFrame:
    """The rows of parts, each as the batch that wrote it last left it."""
    paths = [f"{state}/data/batch={at}/part={part}" for part, at in sorted(where.items())]
    return spark.read.schema(schema).parquet(*paths) if paths else spark.createDataFrame([], schema)


def current(spark: SparkSession, state: str, schema: StructType | str, number: int) -> DataFrame:
    """The state table after a batch."""
    return _read(spark, state, spark.createDataFrame([], schema).schema, _pointers(spark, state, number))


def sync(versions: DataFrame, state: str, changes: str, checkpoint: str, key: str = "doc_id", rev: str = "rev", order: str = "version", parts: int = PARTS) -> StreamingQuery:
    """Apply a stream of document versions to a state table, and append what each batch changed.

    A version whose revision is null is a tombstone: its key goes, if it is there. ``changes`` gets (key, outcome,
    before, after) of keys that a batch added, updated or deleted, with their revisions; see ``net_changes``.

    The state lies in parts by the hash of the key. A batch rewrites the parts that its keys fall into, beside
    those before it (``state``/data/batch=n/part=k), and then says which batch wrote each part last
    (``state``/pointers/batch=n). One that is run again after a failure reads what the batch before it left
    and writes the same, and a query that is started anew goes on where its checkpoint ends: the result is
    exactly once. Parts that neither this batch nor the one before it points to are deleted.
    """

    def apply(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        mine = latest(batch, key, order).select(key, rev).withColumn("part", F.pmod(F.xxhash64(key), F.lit(parts)).cast("int"))
        rows = mine.schema
        before = _pointers(spark, state, number - 1)
        touched = sorted(r.part for r in mine.select("part").distinct().collect())
        old = _read(spark, state, StructType([f for f in rows if f.name != "part"]), {p: before[p] for p in touched if p in before})
        gone = mine.where(F.col(rev).isNull()).select(key)
        merged = ingest.upsert(old, mine.drop("part").where(F.col(rev).isNotNull()), key, rev)
        was = old.select(F.col(key).alias("_key"), F.col(rev).alias("before"))
        merged = merged.join(was, F.col(key) == F.col("_key"), "left").drop("_key").join(gone.withColumn("_gone", F.lit(True)), key, "left")
        merged = merged.withColumn("part", F.pmod(F.xxhash64(key), F.lit(parts)).cast("int")).withColumn("outcome", F.when(F.col("_gone"), "deleted").otherwise(F.col("outcome")))
        merged.where("_gone is null").select(key, rev, "part").write.mode("overwrite").partitionBy("part").parquet(f"{state}/data/batch={number}")
        changed = merged.where("outcome in ('added', 'updated', 'deleted')").select(key, "outcome", "before", F.when(F.col("_gone").isNull(), F.col(rev)).alias("after"))
        changed.write.mode("overwrite").parquet(f"{changes}/batch={number}")
        filled = {r.part for r in merged.where("_gone is null").select("part").distinct().collect()}  # a part that lost all its rows has no folder
        after = {part: at for part, at in before.items() if part not in touched} | dict.fromkeys(sorted(filled), number)
        spark.createDataFrame(sorted(after.items()), "part int, at long").coalesce(1).write.mode("overwrite").json(f"{state}/pointers/batch={number}")
        for part, at in _pointers(spark, state, number - 2).items() if number > 1 else ():
            if before.get(part) != at and after.get(part) != at:
                path = spark._jvm.org.apache.hadoop.fs.Path(f"{state}/data/batch={at}/part={part}")
                path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)

    return versions.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def as_versions(now: DataFrame, before: DataFrame, version: int, key: str = "doc_id", rev: str = "rev") -> DataFrame:
    """(key, rev, version): what a snapshot says anew against the one before it, with tombstones for the keys that it lacks."""
    changed = ingest.diff(now, before, key, rev)
    return changed.join(now.select(key, rev), key, "left").select(key, rev, F.lit(version).cast("long").alias("version"))


def net_changes(feed: DataFrame, key: str = "doc_id", after: int = -1, until: int | None = None) -> DataFrame:
    """(key, change): what the batches of a feed (key, outcome, before, after, batch) came to, those behind ``after`` up to ``until``: added, modified or deleted.

    A key that was changed and changed back, or added and deleted again, has no row.
    """
    some = feed.where(F.col("batch") > after) if until is None else feed.where((F.col("batch") > after) & (F.col("batch") <= until))
    ends = some.groupBy(key).agg(F.min_by("before", "batch").alias("b"), F.max_by("after", "batch").alias("a"))
    change = F.when(F.col("b").isNull() & F.col("a").isNotNull(), "added").when(F.col("b").isNotNull() & F.col("a").isNull(), "deleted").when(F.col("a") != F.col("b"), "modified")
    return ends.select(key, change.alias("change")).where("change is not null")


def running(stream: DataFrame, key: str, value: str, idle: str = "1 hour") -> DataFrame:
    """(key, n, total) of each key so far, as each batch changes it: keyed state that is dropped after a key has been idle."""
    kind = dict(stream.dtypes)[key]
    milliseconds = int(pd.Timedelta(idle).total_seconds() * 1000)

    def update(keys: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        n, total = state.get if state.exists else (0, 0.0)
        for batch in batches:
            n, total = n + len(batch), total + float(batch[value].sum())
        state.update((n, total))
        state.setTimeoutDuration(milliseconds)
        yield pd.DataFrame({key: [keys[0]], "n": [n], "total": [total]})

    return stream.groupBy(key).applyInPandasWithState(update, f"{key} {kind}, n long, total double", "n long, total double", "update", GroupStateTimeout.ProcessingTimeTimeout)


def events(spark: SparkSession, path: str) -> DataFrame:
    return spark.readStream.schema(EVENTS).parquet(path)


def tumbling(stream: DataFrame, width: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Counts and sums of each window and type; rows later than the watermark are left out."""
    rows = stream.withWatermark("ts", late).groupBy(F.window("ts", width), "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))
    return rows.select(F.col("window.start").alias("start"), "event_type", "n", "total")


def sessions(stream: DataFrame, gap: str = "30 minutes", late: str = "10 minutes") -> DataFrame:
    """Sessions of each user."""
    rows = stream.withWatermark("ts", late).groupBy(F.session_window("ts", gap), "user_id").agg(F.count(F.lit(1)).alias("n"))
    return rows.select(F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "user_id", "n")


def unique(stream: DataFrame, key: str, late: str = "10 minutes") -> DataFrame:
    """The first row of each key within the watermark: idempotent upserts of a stream that repeats itself."""
    return stream.withWatermark("ts", late).dropDuplicatesWithinWatermark([key])
