"""Ingestion: stable ids, chunks with line spans, partitions, manifests, diffs, upserts."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import hashed_id, line_of

CHUNK_SIZE, CHUNK_OVERLAP = 1200, 120
CHUNKER = "character-boundary-v1"
# Code suffixes and partition weights of the index.
CODE_SUFFIXES = ("py", "pyi", "js", "ts", "tsx", "go", "rs", "java")


def spans(text: str, size: int = CHUNK_SIZE, overlap: int = CHUNK_OVERLAP) -> list[tuple[int, int]]:
    """Half-open chunk spans: a chunk ends after the last paragraph, line or word break of its second half."""
    if len(text) <= size:
        return [(0, len(text))]
    out, start = [], 0
    while True:
        end = hard = min(len(text), start + size)
        if hard < len(text):
            half = start + max(1, size // 2)
            end = next((at + len(mark) for mark in ("\n\n", "\n", " ") if (at := text.rfind(mark, half, hard)) >= half), hard)
        out.append((start, end))
        if end >= len(text):
            return out
        start = end - overlap if end - overlap > start else end


def chunks(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = CHUNK_SIZE, overlap: int = CHUNK_OVERLAP) -> DataFrame:
    """(doc_id, ordinal, char_start, char_end, content, chunk_id, line_start, line_end); blank texts have none."""

    @F.pandas_udf("array<struct<s:int,e:int>>")
    def cut(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: [{"s": s, "e": e} for s, e in spans(t, size, overlap)] if t and t.strip() else [])

    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).withColumn("spans", cut("text"))
    each = rows.select("doc_id", "text", F.posexplode("spans").alias("ordinal", "x"))
    start, end = F.col("x.s"), F.col("x.e")
    return each.select(
        "doc_id", "ordinal", start.alias("char_start"), end.alias("char_end"),
        F.substring(F.col("text"), start + 1, end - start).alias("content"),
        hashed_id("chunk_", 24, F.col("doc_id"), F.col("ordinal"), F.lit(CHUNKER)).alias("chunk_id"),
        line_of(F.col("text"), start).alias("line_start"), line_of(F.col("text"), end).alias("line_end"),
    )


def partition(source_type: Column, corpus: Column, authority: Column, path: Column, record_kind: Column) -> tuple[Column, Column]:
    """(corpus, authority) of a chunk from its merged metadata and path."""
    given = F.lower(F.trim(F.coalesce(corpus, F.lit(""))))
    official_source = F.lower(F.coalesce(source_type, F.lit(""))) == "official_web"
    own_corpus = F.when(given != "", given).when(official_source, "official").otherwise("internal")
    official = (own_corpus == "official") | official_source
    said = F.lower(F.trim(F.coalesce(authority, F.lit(""))))
    bare = F.lower(F.replace(F.regexp_replace(F.coalesce(path, F.lit("")), "#.*$", ""), F.lit("\\"), F.lit("/")))
    rooted = F.concat(F.lit("/"), F.regexp_replace(bare, "^/+", ""))
    name = F.element_at(F.split(rooted, "/"), -1)
    test = rooted.contains("/tests/") | name.startswith("test_") | name.endswith("_test.py")
    code = F.regexp_extract(name, r"[^.]\.([^.]+)$", 1).isin(*CODE_SUFFIXES) | F.coalesce(path, F.lit("")).contains("#symbol:")
    by_path = F.when(F.lower(F.coalesce(record_kind, F.lit(""))) == "git_commit", "history").when(test, "test").when(code, "code").otherwise("design")
    return F.when(official, "official").otherwise(own_corpus), F.when(official, "official").when(said.isin("code", "test", "design", "history"), said).otherwise(by_path)


def revision(*parts: Column) -> Column:
    """Content hash over the parts that make a revision."""
    return F.sha2(F.concat_ws("\0", *(F.coalesce(p.cast("string"), F.lit("")) for p in parts)), 256)


def set_hash(df: DataFrame, by: list[str], hash_col: str) -> DataFrame:
    """(by, n, set_hash): a hash of a set of hashes that no order changes: sums of their 60-bit parts, and the count.

    Sums up in each task, so a group of any size is never gathered; repeated hashes count as often as they stand.
    """
    parts = [F.sum(F.conv(F.substring(hash_col, 15 * k + 1, 15), 16, 10).cast("decimal(20,0)")).cast("string").alias(f"x{k}") for k in range(4)]
    summed = df.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), *parts)
    return summed.select(*by, "n", F.sha2(F.concat_ws(":", "n", "x0", "x1", "x2", "x3"), 256).alias("set_hash"))


def diff(current: DataFrame, previous: DataFrame, key: str, rev: str) -> DataFrame:
    """(key, change): added, modified or deleted; unchanged keys are left out."""
    old = previous.select(F.col(key), F.col(rev).alias("old"), F.lit(True).alias("had"))
    new = current.select(F.col(key), F.col(rev).alias("new"), F.lit(True).alias("has"))
    change = F.when(F.col("had").isNull(), "added").when(F.col("has").isNull(), "deleted").when(~F.col("old").eqNullSafe(F.col("new")), "modified")
    return new.join(old, key, "full_outer").select(key, change.alias("change")).where("change is not null")


def upsert(existing: DataFrame, incoming: DataFrame, key: str, rev: str, order: str | None = None) -> DataFrame:
    """Rows after an upsert with their ``outcome``: added, updated, skipped (same revision) or kept.

    Of incoming rows with one key the last by ``order`` (the revision if there is none) counts.
    """
    columns = existing.columns
    mine = existing.withColumn("_e", F.lit(True)).select("_e", F.struct(*columns).alias("e"), F.col(key).alias("_k"))
    theirs = incoming.groupBy(F.col(key).alias("_k")).agg(F.max_by(F.struct(*columns), order or rev).alias("i"), F.lit(True).alias("_i"))
    both = mine.join(theirs, "_k", "full_outer")
    same = F.col(f"e.{rev}").eqNullSafe(F.col(f"i.{rev}"))
    outcome = F.when(F.col("_e").isNull(), "added").when(F.col("_i").isNull(), "kept").when(same, "skipped").otherwise("updated")
    row = F.when(outcome.isin("added", "updated"), F.col("i")).otherwise(F.col("e"))
    return both.select(row.alias("r"), outcome.alias("outcome")).select("r.*", "outcome")


def delete(existing: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    return existing.join(ids.select(key).distinct(), key, "left_anti")


def keep_last(rows: DataFrame, key: list[str], order: str) -> DataFrame:
    """One row for each key: the position of the first, the values of the last (by ``order``), and how many there were.

    Two aggregates with partial sums; no key is sorted or gathered.
    """
    rest = [c for c in rows.columns if c not in (*key, order)]
    return rows.groupBy(*key).agg(F.min(order).alias("first_position"), *(F.max_by(c, order).alias(c) for c in rest), F.count(F.lit(1)).alias("n"))


def orphans(chunks_table: DataFrame, documents: DataFrame, key: str = "doc_id") -> DataFrame:
    """Chunks whose document is missing: the referential check before publishing."""
    return chunks_table.join(documents.select(key), key, "left_anti")


def duplicates(rows: DataFrame, key: list[str]) -> DataFrame:
    """Keys that occur more than once."""
    return rows.groupBy(*key).agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def bounded_running(rows: DataFrame, by: list[str], order: list[Column], value: Column, budget: int) -> DataFrame:
    """Rows of each group while the running sum before them stays under the budget."""
    before = F.sum(value).over(Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1))
    return rows.withColumn("used_before", F.coalesce(before, F.lit(0))).where(F.col("used_before") < budget)
