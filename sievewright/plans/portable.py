"""Inputs of queries stated once, in SQL that Spark and DuckDB both read."""

from __future__ import annotations

import re
import zlib

from pyspark.sql import DataFrame, SparkSession

NAMES = re.compile(r"\{(\w+)\}")


def table(spark: SparkSession, d: str, text: str) -> DataFrame:
    """The rows of a SELECT whose table names stand in braces."""

    def view(name: re.Match) -> str:
        path = f"{d}/{name[1]}.parquet"
        own = f"{name[1]}_{zlib.crc32(path.encode())}"
        spark.read.parquet(path).createOrReplaceTempView(own)
        return own

    return spark.sql(NAMES.sub(view, text))


def duck(text: str) -> str:
    """The same SELECT over DuckDB's views."""
    return NAMES.sub(r"\1", text)


def ctes(**texts: str) -> str:
    """``WITH`` entries of such SELECTs."""
    return ", ".join(f"{name} AS ({duck(text)})" for name, text in texts.items())
