"""Guarded SQL over registered tables, row rendering, table summaries."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Statements that the guard rejects.
FORBIDDEN = ("drop", "delete", "update", "insert", "alter", "truncate", "exec", "create", "merge", "grant", "set", "use", "load", "refresh")
_STRING = re.compile(r"'(?:[^']|'')*'")


def guard(sql: str) -> str:
    """The statement, if it is one SELECT or WITH; words inside string literals and identifiers like updated_at do not count."""
    bare = _STRING.sub("''", sql).strip().rstrip(";").strip()
    if not re.match(r"(?i)(select|with)\b", bare):
        raise ValueError("only SELECT statements are allowed")
    if ";" in bare:
        raise ValueError("one statement at a time")
    word = next((w for w in FORBIDDEN if re.search(rf"(?i)\b{w}\b", bare)), None)
    if word:
        raise ValueError(f"{word} is not allowed")
    return sql.strip().rstrip(";")


def register(spark: SparkSession, sf_dir: str, tables: list[str], prefix: str = "") -> None:
    for t in tables:
        spark.read.parquet(f"{sf_dir}/{t}.parquet").createOrReplaceTempView(prefix + t)


def execute(spark: SparkSession, sql: str) -> DataFrame:
    return spark.sql(guard(sql))


def text_to_sql(spark: SparkSession, question: str, generate, tries: int = 3) -> DataFrame:
    """Run what ``generate(question, error)`` writes; a failing statement is given back with its error."""
    error = None
    for _ in range(tries):
        try:
            found = execute(spark, generate(question, error))
            found.schema  # noqa: B018  resolves names before rows are asked for
            return found
        except Exception as e:
            error = str(e)
    raise ValueError(f"no statement worked: {error}")


def rendered(df: DataFrame, name: str = "row_text") -> Column:
    """A row as ``key: value | key: value``; nulls as None."""
    return F.concat_ws(" | ", *(F.concat(F.lit(f"{c}: "), F.coalesce(F.col(c).cast("string"), F.lit("None"))) for c in df.columns)).alias(name)


def schema_text(spark: SparkSession, tables: list[str]) -> str:
    return "\n".join(f"{t}({', '.join(f'{c.name} {c.dataType}' for c in spark.catalog.listColumns(t))})" for t in tables)


def lookup(rows: DataFrame, name_col: str, name: str, task_col: str | None = None, task: str | None = None) -> DataFrame:
    """Rows whose name (and task) contains a text, whatever its case."""
    hit = F.contains(F.lower(name_col), F.lit(name.lower()))
    if task_col and task:
        hit &= F.contains(F.lower(task_col), F.lit(task.lower()))
    return rows.where(hit)


def matches(filter_text: str, columns: list[str]) -> Column:
    """Metadata filter ``key == value and key == value``: parts without == are ignored, unknown keys never match."""
    out = F.lit(True)
    for part in re.split(r"(?i)\s+and\s+", filter_text.strip()):
        if "==" in part:
            key, value = (x.strip() for x in part.split("==", 1))
            value = value.strip("\"'")
            out &= F.coalesce(F.col(key).cast("string") == value, F.lit(False)) if key in columns else F.lit(False)
    return out


def filter_text(**values) -> str:
    """The filter that ``matches`` reads; empty texts and other kinds are left out."""
    parts = [f"{k} == {str(v).lower()}" if isinstance(v, bool) else f'{k} == "{v}"' for k, v in values.items() if isinstance(v, bool) or isinstance(v, str) and v]
    return " and ".join(parts)
