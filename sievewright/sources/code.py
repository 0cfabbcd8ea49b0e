"""Python symbols of source files, and look-ups by name."""

from __future__ import annotations

import ast
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SCHEMA = "path string, symbol string, kind string, line_start int, line_end int, docstring string"


def symbols_of(text: str) -> list[tuple[str, str, int, int, str | None]]:
    """(qualified name, kind, first line with decorators, last line, docstring); none if the text has a syntax error."""
    try:
        tree = ast.parse(text)
    except (SyntaxError, ValueError, RecursionError):
        return []
    found = []

    def walk(node: ast.AST, owner: tuple[str, ...]) -> None:
        for child in ast.iter_child_nodes(node):
            if isinstance(child, ast.ClassDef | ast.FunctionDef | ast.AsyncFunctionDef):
                name = (*owner, child.name)
                kind = {ast.ClassDef: "class", ast.FunctionDef: "function"}.get(type(child), "async_function")
                found.append((".".join(name), kind, min([child.lineno, *(d.lineno for d in child.decorator_list)]), child.end_lineno or child.lineno, ast.get_docstring(child)))
                walk(child, name)
            else:
                walk(child, owner)

    walk(tree, ())
    return found


def symbols(files: DataFrame, path_col: str = "relative_path", text_col: str = "content") -> DataFrame:
    """SCHEMA of every Python file."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [(p, *s) for p, t in zip(batch.path, batch.text, strict=True) if t for s in symbols_of(t)]
            yield pd.DataFrame(rows, columns=["path", "symbol", "kind", "line_start", "line_end", "docstring"])

    return files.where(F.col(path_col).endswith(".py")).select(F.col(path_col).alias("path"), F.col(text_col).alias("text")).mapInPandas(run, SCHEMA)


def lookup(table: DataFrame, terms: DataFrame) -> DataFrame:
    """Symbols that a term names: by the whole name, or by the last part if the term has no dot. Two equi-joins."""
    t = terms.select("term")
    exact = table.join(t, F.col("symbol") == F.col("term"))
    leaf = table.withColumn("leaf", F.element_at(F.split("symbol", r"\."), -1)).where(F.col("leaf") != F.col("symbol"))
    return exact.unionByName(leaf.join(t.where(~F.contains("term", F.lit("."))), F.col("leaf") == F.col("term")).drop("leaf"))
