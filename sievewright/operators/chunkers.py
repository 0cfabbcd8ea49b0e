"""Chunkers beside the character-boundary one: recursive splits, Markdown sections, top-level code, and their choice by document type."""

from __future__ import annotations

import ast
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SIZE, OVERLAP = 512, 64
SEPARATORS = ("\n\n", "\n", " ", "")
HEADING = r"^(#{1,3})\s+(.*\S)\s*$"


def recursive(text: str, size: int = SIZE, overlap: int = OVERLAP, separators: tuple[str, ...] = SEPARATORS) -> list[str]:
    """Pieces of at most ``size`` characters: cut at the coarsest separator that the text has, too long pieces at the next one, and neighbours put together again, each with an end of the one before of at most ``overlap``."""
    at = next((k for k, s in enumerate(separators) if not s or s in text), len(separators) - 1)
    separator, finer = separators[at], separators[at + 1 :]
    # a separator stays at the head of the piece that it begins
    parts = list(text) if not separator else [x for k, x in enumerate(text.split(separator)) for x in ([separator + x] if k else [x])]
    out: list[str] = []
    group: list[str] = []

    def close() -> None:
        """Put what is gathered together into pieces."""
        held: list[str] = []
        total = 0
        for part in group:
            if total + len(part) > size and held:
                if joined := "".join(held).strip():
                    out.append(joined)
                while held and (total > overlap or total + len(part) > size):
                    total -= len(held.pop(0))
            held.append(part)
            total += len(part)
        if joined := "".join(held).strip():
            out.append(joined)
        group.clear()

    for part in parts:
        if not part:
            continue
        if len(part) < size or not finer:
            group.append(part)
        else:
            close()
            out.extend(recursive(part, size, overlap, finer))
    close()
    return out


def code_blocks(text: str) -> list[str]:
    """Top-level classes and functions of Python text; the whole text if it has none or does not parse."""
    try:
        tree = ast.parse(text)
    except (SyntaxError, ValueError, RecursionError):
        return [text]
    lines = text.split("\n")
    return ["\n".join(lines[n.lineno - 1 : n.end_lineno]) for n in ast.iter_child_nodes(tree) if isinstance(n, ast.FunctionDef | ast.AsyncFunctionDef | ast.ClassDef)] or [text]


def _exploded(rows: DataFrame, key: str, text: str, cut) -> DataFrame:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = [(k, n, c) for k, t in zip(batch[key], batch[text], strict=True) if t for n, c in enumerate(cut(t))]
            yield pd.DataFrame(found, columns=[key, "ordinal", "content"])

    return rows.select(key, text).mapInPandas(run, f"{key} {dict(rows.dtypes)[key]}, ordinal int, content string")


def recursive_chunks(rows: DataFrame, key: str, text: str, size: int = SIZE, overlap: int = OVERLAP) -> DataFrame:
    return _exploded(rows, key, text, lambda t: recursive(t, size, overlap))


def code_chunks(rows: DataFrame, key: str, text: str) -> DataFrame:
    return _exploded(rows, key, text, code_blocks)


def sections(rows: DataFrame, key: str, text: str) -> DataFrame:
    """(key, ordinal, title, section, subsection, body) of Markdown texts: the lines under each heading of levels 1 to 3, those in code fences included.

    A heading ends the deeper ones before it. Sections without any line are left out. Lines of one text are
    numbered in one window, so a text is the unit of work.
    """
    line = rows.select(key, F.posexplode(F.split(F.col(text), "\n")).alias("n", "line"))
    w = Window.partitionBy(key).orderBy("n").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    fenced = (F.sum(F.when(F.ltrim("line").startswith("```"), 1).otherwise(0)).over(w) % 2 == 1) | F.ltrim("line").startswith("```")
    line = line.withColumn("level", F.when(~fenced, F.length(F.regexp_extract("line", HEADING, 1))).otherwise(0)).withColumn("name", F.regexp_extract("line", HEADING, 2))
    # the last heading of a level counts unless a higher one stands after it
    last = lambda level: F.max(F.when((F.col("level") > 0) & (F.col("level") <= level), F.struct("n", "level", "name"))).over(w)
    named = line.withColumns({f"h{k}": F.when(last(k)["level"] == k, last(k)["name"]) for k in (1, 2, 3)}).withColumn("part", F.sum(F.when(F.col("level") > 0, 1).otherwise(0)).over(w))
    body = named.where((F.col("level") == 0) & (F.trim("line") != "")).groupBy(key, "part", "h1", "h2", "h3").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n", "line"))), lambda x: x["line"]), "\n").alias("body"))
    return body.select(key, (F.row_number().over(Window.partitionBy(key).orderBy("part")) - 1).alias("ordinal"), F.col("h1").alias("title"), F.col("h2").alias("section"), F.col("h3").alias("subsection"), "body")


def headed(rows: DataFrame) -> Column:
    """A section's text under its headings."""
    mark = lambda c, hashes: F.when(F.col(c).isNotNull(), F.concat(F.lit(hashes + " "), c))
    heads = F.concat_ws("\n", mark("title", "#"), mark("section", "##"), mark("subsection", "###"))
    return F.when(heads == "", F.col("body")).otherwise(F.concat_ws("\n", heads, "body"))


def by_type(rows: DataFrame, key: str, text: str, doc_type: str, size: int = 1000) -> DataFrame:
    """(key, chunker, ordinal, content): code by its blocks, technical documents by their sections (cut again if longer than ``size``), others by recursive splits."""
    code = rows.where(F.col(doc_type) == "code")
    technical = rows.where(F.col(doc_type).isin("technical_doc", "api_ref"))
    rest = rows.where(~F.col(doc_type).isin("code", "technical_doc", "api_ref") | F.col(doc_type).isNull())
    parts = sections(technical, key, text)
    headed_rows = parts.select(key, "ordinal", headed(parts).alias("content"))
    cut = F.udf(lambda t: recursive(t, size, OVERLAP), "array<string>")
    split = headed_rows.select(key, F.col("ordinal").alias("o"), F.posexplode(F.when(F.length("content") > size, cut("content")).otherwise(F.array("content"))).alias("p", "content"))
    numbered = split.select(key, (F.row_number().over(Window.partitionBy(key).orderBy("o", "p")) - 1).alias("ordinal"), "content")
    named = lambda df, name: df.select(key, F.lit(name).alias("chunker"), "ordinal", "content")
    return named(code_chunks(code, key, text), "code").unionByName(named(numbered, "sections")).unionByName(named(recursive_chunks(rest, key, text), "recursive"))
