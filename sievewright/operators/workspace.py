"""Tables that queries derive from the given ones and keep for one another: where they lie, and when they go."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_made: dict[str, list[str]] = {}
_kept: dict[tuple, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, from spark.checkpoint.dir.

    Where it is unset, a temporary folder serves a local session, as in tests; on a cluster that is an error.
    """
    where = spark.conf.get("spark.checkpoint.dir", None)
    if where:
        return where.rstrip("/")
    context = spark.sparkContext
    if context._jsc.sc().getCheckpointDir().isEmpty():
        if context.master.split("[")[0] != "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        context.setCheckpointDir("file://" + tempfile.mkdtemp(prefix="sievewright-"))
    return context._jsc.sc().getCheckpointDir().get().rstrip("/")


def new_path(spark: SparkSession, what: str) -> str:
    """A path in the shared folder, deleted when the program ends."""
    if not _made:
        atexit.register(_clear)
    path = f"{shared_dir(spark)}/sievewright-{what}-{uuid.uuid4().hex}"
    _made.setdefault(spark.sparkContext.applicationId, []).append(path)
    return path


def written(df: DataFrame, what: str) -> DataFrame:
    """A table in the shared folder, read back: it is computed once, and a lost executor costs a task."""
    path = new_path(df.sparkSession, what)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def state_of(spark: SparkSession, path: str) -> tuple:
    """Names, sizes and times of the files of a table: another state gives another value."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = target.getFileSystem(spark._jsc.hadoopConfiguration())
    return tuple(sorted((f.getPath().toString(), f.getLen(), f.getModificationTime()) for f in (fs.listStatus(target) if fs.exists(target) else [])))


def kept(spark: SparkSession, what: str, inputs: list[str], make) -> str:
    """The path of a derived table: ``make(path)`` writes it once for each state of the input tables' files."""
    key = (spark.sparkContext.applicationId, what, *((p, state_of(spark, p)) for p in inputs))
    if key not in _kept:
        path = new_path(spark, what)
        make(path)
        _kept[key] = path
    return _kept[key]


def _clear() -> None:
    spark = SparkSession.getActiveSession()
    if spark is not None and spark.sparkContext._jsc is not None:
        for path in _made.pop(spark.sparkContext.applicationId, []):
            target = spark._jvm.org.apache.hadoop.fs.Path(path)
            target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)
