"""Loaders: checked text, JSON, TOML and YAML, layout blocks of parsed documents, strict JSON lines, table summaries."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

BLOCK = "struct<type:string,category:string,page_idx:int,page_number:int,block_id:string,table_id:string,text:string,content:string,html:string,markdown:string,table_body:string,table_caption:array<string>,table_footnote:array<string>>"
LAYOUT = f"struct<content_list:array<{BLOCK}>,pages:array<struct<page_number:int,blocks:array<{BLOCK}>>>>"


def parse_error(kind: str, text: str | None) -> str | None:
    """Why a text is none of its kind, or null; kinds without a grammar, or whose parser is not installed, have no error."""
    if text is None:
        return "no text"
    if not text.strip():
        return "empty"
    try:
        if kind == "json":
            json.loads(text)
        elif kind == "toml":
            import tomllib

            tomllib.loads(text)
        elif kind == "yaml":
            try:
                import yaml
            except ImportError:  # optional dependency
                return None
            yaml.safe_load(text)
    except ValueError as e:
        return type(e).__name__
    except Exception as e:  # yaml has errors of its own
        return type(e).__name__
    return None


def checked(files: DataFrame) -> DataFrame:
    """Files (relative_path, file_type, content) with a parse error: null for those that may be loaded."""

    @F.pandas_udf("string")
    def check(kinds: pd.Series, texts: pd.Series) -> pd.Series:
        return pd.Series([parse_error(k, t) for k, t in zip(kinds, texts, strict=True)], dtype=object)

    return files.withColumn("error", check("file_type", "content"))


def coordinate(x: Column) -> Column:
    """A short name as it is, any other by its hash."""
    bare = F.trim(x)
    return F.when(bare.rlike("^[A-Za-z0-9_.-]{1,80}$"), bare).otherwise(F.concat(F.lit("sha256-"), F.substring(F.sha2(bare, 256), 1, 16)))


def layout_units(artifacts: DataFrame) -> DataFrame:
    """Units of layout JSON (artifact, json): one for each block with text, with its page, block and table; repeated units once.

    (artifact, page_number, kind, block_id, table_id, identity, content_format, title, content).
    """
    parsed = artifacts.select("artifact", F.from_json("json", LAYOUT).alias("j"), F.from_json("json", f"array<{BLOCK}>").alias("l"))
    flat = lambda xs, page: F.transform(xs, lambda b, i: F.struct(b.alias("b"), page.alias("page"), (i + 1).alias("n")))
    none, empty = F.lit(None).cast("int"), F.array().cast(f"array<struct<b:{BLOCK},page:int,n:int>>")
    pages = F.flatten(F.transform("j.pages", lambda p, k: flat(p["blocks"], F.coalesce(p["page_number"], k + 1))))
    blocks = F.concat(*(F.coalesce(x, empty) for x in (flat(F.col("l"), none), flat(F.col("j.content_list"), none), pages)))
    rows = parsed.select("artifact", F.posexplode(blocks).alias("at", "x")).select("artifact", "at", "x.*")
    b = lambda c: F.col(f"b.{c}")
    kind = F.lower(F.trim(F.coalesce(b("type"), b("category"), F.lit("text"))))
    table = F.contains(kind, F.lit("table"))
    fields = F.when(table, F.concat(F.coalesce(b("table_caption"), F.array().cast("array<string>")), F.array(*map(b, ("table_body", "html", "markdown", "text", "content"))), F.coalesce(b("table_footnote"), F.array().cast("array<string>"))))
    texts = F.coalesce(fields, F.array(*map(b, ("text", "content", "markdown"))))
    content = F.array_join(F.array_distinct(F.filter(F.transform(texts, lambda t: F.trim(t)), lambda t: t.isNotNull() & (t != ""))), "\n\n")
    page = F.coalesce(b("page_idx") + 1, b("page_number"), F.col("page"))
    rows = rows.select("artifact", "at", page.alias("page_number"), kind.alias("kind"), table.alias("is_table"), coordinate(F.coalesce(F.when(b("block_id") != "", b("block_id")), F.format_string("block-%04d", "n"))).alias("block_id"), b("table_id").alias("given"), content.alias("content")).where("content <> ''")
    place = F.coalesce(F.col("page_number").cast("string"), F.lit("unknown"))
    number = F.when(F.col("is_table"), F.sum(F.col("is_table").cast("int")).over(Window.partitionBy("artifact", "page_number").orderBy("at").rowsBetween(Window.unboundedPreceding, 0)))
    rows = rows.withColumns({"place": place, "number": number})
    table_id = F.when(F.col("is_table"), coordinate(F.coalesce(F.when(F.col("given") != "", F.col("given")), F.format_string("page-%s-table-%04d", "place", "number"))))
    rows = rows.withColumn("table_id", table_id)
    identity = F.when(F.col("is_table"), F.concat_ws(":", F.lit("page"), "place", F.lit("table"), "table_id")).otherwise(F.concat_ws(":", F.lit("page"), "place", F.lit("block"), "block_id"))
    form = F.when(~F.col("is_table"), "json-structured-text").when(F.lower(F.ltrim("content")).startswith("<table"), "html-table").when(F.contains("content", F.lit("|")), "markdown-table").otherwise("structured-table")
    title = F.concat(F.lit("page "), "place", F.lit(" / "), F.when(F.col("is_table"), F.concat(F.lit("table "), "number")).otherwise(F.col("kind")))
    units = rows.select("artifact", "at", "page_number", "kind", "block_id", "table_id", identity.alias("identity"), form.alias("content_format"), title.alias("title"), "content")
    # the first of equal units stays; another text under the same identity gets its hash
    once = units.groupBy("artifact", "identity", "content").agg(F.min_by(F.struct("at", "page_number", "kind", "block_id", "table_id", "content_format", "title"), "at").alias("u")).select("artifact", "identity", "content", "u.*")
    other = F.row_number().over(Window.partitionBy("artifact", "identity").orderBy("at")) > 1
    return once.withColumn("identity", F.when(other, F.concat("identity", F.lit(":content-"), F.substring(F.sha2("content", 256), 1, 12))).otherwise(F.col("identity"))).drop("at")


def records(units: DataFrame, source_id: str, path: str = "relative_path") -> DataFrame:
    """Document records of parsed units: the path with the unit's identity, blank ones left out, ids by path and identity."""
    name = F.when(F.coalesce("identity", F.lit("")) != "", F.concat_ws("#", path, "identity")).otherwise(F.col(path))
    rows = units.where(F.trim(F.coalesce("content", F.lit(""))) != "").withColumns({"source_id": F.lit(source_id), "name": name})
    return rows.withColumns({"doc_id": F.concat(F.lit("doc_"), F.substring(F.sha2(F.concat_ws("\0", "source_id", "name"), 256), 1, 24)), "content_hash": F.sha2("content", 256)})


def json_lines(spark: SparkSession, path: str, schema: StructType | str, key: str = "id") -> DataFrame:
    """Strict JSON lines: a malformed line, a missing key or a repeated key is an error when the rows are read."""
    rows = spark.read.schema(schema).option("mode", "FAILFAST").json(path)
    repeated = rows.groupBy(key).agg(F.count(F.lit(1)).alias("n")).where((F.col("n") > 1) | F.col(key).isNull())
    bad = [r[0] for r in repeated.limit(5).collect()]
    if bad:
        raise ValueError(f"missing or repeated {key}: {bad}")
    return rows
