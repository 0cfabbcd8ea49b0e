"""Judged scores as a stream: an append-only table of attempts, from which the scores follow.

Each micro-batch asks for the slots (question, metric) that it brings and that have no score yet, and appends
its attempts as a folder of its own. A batch that is run again after a failure writes that folder anew, so an
attempt is in the table once; a run that is stopped and started again goes on where its checkpoint ends. A
score is the value of the first attempt that has one and never changes: later attempts do not move it.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

ATTEMPTS = "id long, metric string, number int, value double, code string, batch long"
_MADE = "id long, metric string, number int, value double, code string"


def attempts(spark: SparkSession, root: str) -> DataFrame:
    """All attempts so far; none before the first batch."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{root}/attempts")
    if not path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path):
        return spark.createDataFrame([], ATTEMPTS)
    return spark.read.schema(ATTEMPTS).parquet(f"{root}/attempts")


def scores(tried: DataFrame) -> DataFrame:
    """(id, metric, value, number) of the slots that have a value: that of the first attempt with one."""
    first = F.row_number().over(Window.partitionBy("id", "metric").orderBy("batch", "number"))
    return tried.where("value is not null").withColumn("_n", first).where("_n = 1").select("id", "metric", "value", "number")


def audit(tried: DataFrame) -> DataFrame:
    """(id, metric, n_attempts, n_values, last_code): slots by what was tried, also those without a value."""
    return tried.groupBy("id", "metric").agg(F.count(F.lit(1)).alias("n_attempts"), F.count("value").alias("n_values"), F.max_by("code", F.struct("batch", "number")).alias("last_code"))


def judge(slots: DataFrame, root: str, checkpoint: str, scorer: Callable[[pd.DataFrame], pd.Series], most: int = 3) -> StreamingQuery:
    """Judge a stream of slots (id, metric, ..): ``scorer`` gives a value from 0 to 1 for each row, or null, or raises.

    A value out of range is none, with the code out_of_range; a missing one has no_value; if ``scorer`` raises, its rows
    have the name of the error. A slot that has a score, or ``most`` attempts, is not tried again.
    """

    def tried(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            try:
                value, code = pd.to_numeric(pd.Series(list(scorer(frame)), index=frame.index), errors="coerce"), ""
            except Exception as e:  # a judge that fails is an attempt without a value
                value, code = pd.Series(float("nan"), index=frame.index), type(e).__name__
            bad = value.notna() & ~value.between(0, 1)
            said = pd.Series(code, index=frame.index).mask(value.isna() & (code == ""), "no_value").mask(bad, "out_of_range")
            yield pd.DataFrame({"id": frame.id, "metric": frame.metric, "number": frame.number + 1, "value": value.mask(bad), "code": said.where(said != "")})

    def apply(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        before = attempts(spark, root).where(F.col("batch") < number)  # what this batch wrote in a run that failed does not count
        state = before.groupBy("id", "metric").agg(F.count(F.lit(1)).cast("int").alias("number"), F.count("value").alias("values"))
        one = batch.dropDuplicates(["id", "metric"]).join(state, ["id", "metric"], "left").fillna(0, ["number", "values"])
        open_ = one.where((F.col("values") == 0) & (F.col("number") < most)).drop("values")
        open_.mapInPandas(tried, _MADE).write.mode("overwrite").parquet(f"{root}/attempts/batch={number}")

    return slots.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
