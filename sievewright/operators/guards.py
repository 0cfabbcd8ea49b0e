"""The sufficiency guard: anchors that evidence must hold, the official scope, and the terms that live sources are asked for."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import casefold
from .answer import GENERIC, UNSUPPORTED

# What asks for a topic before and after its name, identifiers and products that are anchors, and plain words.
TOPIC = r"(?i)(?:什么是|介绍(?:一下)?|解释(?:一下)?|如何(?:使用|配置)|怎么(?:使用|配置)|what\s+is|define|explain|how\s+to\s+(?:use|configure))\s*[`\"'“”]?\s*([A-Za-z][A-Za-z0-9_.\-/]{2,})"
TOPIC_BEFORE = r"(?i)(?<![A-Za-z0-9_])([A-Za-z][A-Za-z0-9_.\-/]{2,})(?![A-Za-z0-9_])\s*[`\"'“”]?\s*(?:是什么|是什[么麼]|怎么(?:使用|配置)|如何(?:使用|配置)|what\s+is|definition)"
NAMED = r"`[^`\r\n]{1,96}`|\b(?:[A-Za-z][A-Za-z0-9_-]*[._/][A-Za-z0-9_./-]+|[A-Z][A-Za-z0-9]*(?:[A-Z][A-Za-z0-9]*)+|[A-Z]{2,}|Redis|Kafka|PostgreSQL|Kubernetes|OAuth|CQRS)\b"
WORD = r"(?<![A-Za-z0-9_])[A-Za-z][A-Za-z0-9_-]{2,}(?![A-Za-z0-9_])"
SLASHED = r"^[A-Za-z][A-Za-z0-9-]{2,}(?:/[A-Za-z][A-Za-z0-9-]{2,})+$"
# First parts of paths, which are never split into concepts.
ROOTS = ("app", "bin", "config", "data", "docs", "examples", "include", "lib", "packages", "scripts", "src", "static", "templates", "tests")
# Terms that a caller names, plain words of six characters or more, and words that say nothing.
TICKED = r"`([^`\r\n]{1,128})`"
IDENTIFIER = r"\b(?:[A-Za-z_][A-Za-z0-9_]*(?:\.[A-Za-z_][A-Za-z0-9_]*)+|[A-Z][A-Za-z0-9_]{2,}|[a-z][a-z0-9]*_[a-z0-9_]+)\b"
LONG_WORD = r"\b[A-Za-z][A-Za-z0-9_]{5,}\b"
STOPWORDS = ("current", "source", "implementation", "implemented", "function", "method", "class", "module", "project", "official", "documentation", "where", "which", "compare", "difference", "between")


def _first_of_each(names: Column) -> Column:
    """Names without empty ones and repeats, whatever their case: the first spelling stays."""
    low = F.transform(names, casefold)
    return F.filter(names, lambda x, i: (x != "") & (F.array_position(low, casefold(x)) == i + 1))


def hard_anchors(query: Column, split: bool = False) -> Column:
    """What an answer must be about: topics, back-ticked terms and identifiers, or else the one distinctive word.

    split: bare ``context/checkpoint`` are two concepts, not one identifier; paths and quoted terms stay whole.
    """
    of = lambda pattern, group: F.regexp_extract_all(query, F.lit(pattern), F.lit(group))
    named = of(NAMED, 0)
    if split:
        concept = lambda x: x.rlike(SLASHED) & ~F.lower(F.substring_index(x, "/", 1)).isin(*ROOTS)
        named = F.flatten(F.transform(named, lambda x: F.when(concept(x), F.split(x, "/")).otherwise(F.array(x))))
    bare = F.transform(named, lambda x: F.trim(F.when(x.startswith("`"), F.substring(x, F.lit(2), F.length(x) - 2)).otherwise(x)))
    special = lambda x: ~casefold(x).isin(*GENERIC)
    anchors = _first_of_each(F.filter(F.concat(of(TOPIC, 1), of(TOPIC_BEFORE, 1), bare), special))
    words = _first_of_each(F.filter(of(WORD, 0), special))
    return F.when(F.size(anchors) > 0, anchors).when(F.size(words) == 1, words).otherwise(F.array().cast("array<string>"))


def _held(anchors: Column, hay: Column) -> Column:
    return F.filter(anchors, lambda a: F.contains(hay, casefold(a)))


def verdicts(questions: DataFrame, evidence: DataFrame, split: bool = False) -> DataFrame:
    """(qid, anchors, verdict): null if the evidence may support an answer, else the reason.

    questions: (qid, query, intent). evidence: (qid, role, source, symbol, content, aliases, topics), a few
    dozen rows a question, which are strung together by role.
    """
    text = casefold(F.concat_ws("\n", "source", F.coalesce("symbol", F.lit("")), "content"))
    of = lambda *roles: F.concat_ws("\n", F.collect_list(F.when(F.col("role").isin(*roles), text)))
    asked = casefold(F.col("query"))
    names = lambda c: F.exists(F.coalesce(F.col(c), F.array().cast("array<string>")), lambda a: (F.trim(a) != "") & F.contains(asked, casefold(F.trim(a))))
    known = (F.col("role") == "external_normative") & names("aliases")
    rows = questions.select("qid", "query", "intent").join(evidence, "qid", "left").groupBy("qid", "query", "intent").agg(
        of("current_implementation").alias("live"), of("internal_design", "internal_history").alias("design"), of("external_normative").alias("official"),
        F.coalesce(F.bool_or(known), F.lit(False)).alias("in_scope"), F.coalesce(F.bool_or(known & names("topics")), F.lit(False)).alias("on_topic"),
    )
    rows = rows.withColumn("anchors", hard_anchors(F.col("query"), split))
    intent, anchors = F.col("intent"), F.col("anchors")
    lacks = lambda hay: F.size(_held(anchors, F.col(hay))) < F.size(anchors)
    out = (
        F.when(intent.isin("official", "comparison") & ~F.col("in_scope"), "source_not_catalogued")
        .when(intent.isin("official", "comparison") & ~F.col("on_topic"), "topic_not_indexed")
        .when((intent == "official") & lacks("official"), "source_not_catalogued")
        .when((intent == "design") & lacks("design") | (intent == "implementation") & lacks("live"), "unsupported_anchor")
        .when((intent == "comparison") & (F.size(_held(anchors, F.col("live"))) == 0), "missing_current_implementation_evidence")
    )
    for code, pattern in reversed(UNSUPPORTED):
        out = F.when(F.col("query").rlike(f"(?i)(?:{pattern})"), code).otherwise(out)
    return rows.select("qid", "anchors", out.alias("verdict"))


def verification_terms(query: Column, symbols: Column, paths: Column, most: int = 6) -> Column:
    """What live sources are searched for: terms that the caller names, or else plain words and the first five results' symbols and file stems."""
    of = lambda pattern, group: F.regexp_extract_all(query, F.lit(pattern), F.lit(group))
    direct = F.concat(of(TICKED, 1), of(IDENTIFIER, 0))
    stem = lambda p: F.regexp_extract(p, r"([^/#]*?)(?:\.[^./#]*)?(?:#.*)?$", 1)
    stems = F.filter(F.transform(F.slice(paths, 1, 5), lambda p: stem(p)), lambda s: F.length(s) >= 4)
    found = F.when(F.size(direct) > 0, direct).otherwise(F.concat(of(LONG_WORD, 0), F.slice(symbols, 1, 5), stems))
    clean = F.transform(found, lambda x: F.regexp_replace(F.trim(x), "^['\"]+|['\"]+$", ""))
    return F.slice(_first_of_each(F.filter(clean, lambda x: x.isNotNull() & (F.length(x) <= 128) & ~casefold(x).isin(*STOPWORDS))), 1, most)
