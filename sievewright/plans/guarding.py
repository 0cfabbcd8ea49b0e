"""Queries of the guard, the verification terms and the older strategies."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import guards, legacy, sqltool
from ..operators.answer import GENERIC
from .portable import ctes, table

QUESTIONS = """SELECT conv_id * 100 + turn AS qid, CASE turn % 4 WHEN 0 THEN 'design' WHEN 1 THEN 'implementation' WHEN 2 THEN 'official' ELSE 'comparison' END AS intent, CASE (conv_id + turn) % 10
 WHEN 0 THEN 'What is tool_registry' || CAST(turn AS STRING) || ' and why' WHEN 1 THEN 'Explain context/checkpoint handling of `Engine.run' || CAST(turn AS STRING) || '` in Redis'
 WHEN 2 THEN 'compare the TurnRunner with MCP tools specification' WHEN 3 THEN 'mcp definition for scheduler' WHEN 4 THEN 'is there an official MCP page about sampling or tools' WHEN 5 THEN 'does the agent use kubelet'
 WHEN 6 THEN 'SOC 2 audit of the agent' WHEN 7 THEN 'how to use src/app/main.py safely with checkpoint/resume' WHEN 8 THEN 'why does the system keep history of conversations' ELSE 'where is snake_case_name and MyClass' END AS query FROM {conversations}"""
EVIDENCE = """SELECT conv_id * 100 + turn AS qid, CASE (conv_id + k) % 4 WHEN 0 THEN 'current_implementation' WHEN 1 THEN 'internal_design' WHEN 2 THEN 'external_normative' ELSE 'internal_history' END AS role,
 CASE WHEN k = 0 THEN 'src/app/main.py' ELSE 'docs/context.md' END AS source, CASE WHEN conv_id % 3 = 0 THEN 'TurnRunner.run' WHEN conv_id % 3 = 1 THEN 'Engine.run' || CAST(turn AS STRING) END AS symbol,
 CASE conv_id % 5 WHEN 0 THEN 'Redis keeps the context/checkpoint' WHEN 1 THEN 'kubelet and MyClass and snake_case_name' WHEN 2 THEN 'MCP scheduler, TOOL_REGISTRY' || CAST(turn AS STRING) ELSE text END AS content,
 CASE WHEN conv_id % 2 = 0 THEN 'mcp,Model Context' ELSE '' END AS aliases, CASE WHEN conv_id % 4 = 0 THEN 'tools, sampling' ELSE 'prompts' END AS topics FROM {conversations} CROSS JOIN (SELECT 0 AS k UNION ALL SELECT 1) AS ks"""
ASKED = """SELECT conv_id * 100 + turn AS qid, CASE (conv_id + turn) % 7 WHEN 0 THEN '系统平均延迟是多少' WHEN 1 THEN '如何配置 API' WHEN 2 THEN '系统架构图' WHEN 3 THEN 'plain question' WHEN 4 THEN '教程和流程' WHEN 5 THEN '' ELSE text END AS query FROM {conversations}"""
HITS = "SELECT doc_id % 40 AS qid, CAST(doc_id % 3 AS INT) AS number, CAST(row_number() OVER (PARTITION BY doc_id % 40, doc_id % 3 ORDER BY doc_id) AS INT) AS rank, substr(text, 1, 6) AS content, CAST(doc_id % 17 AS DOUBLE) / 7 AS score FROM {documents}"


def _guarded(spark, d, split):
    evidence = table(spark, d, EVIDENCE).withColumns({c: F.split(c, ",") for c in ("aliases", "topics")})
    return guards.verdicts(table(spark, d, QUESTIONS), evidence, split)


def guard_verdicts(spark, d):
    return _guarded(spark, d, False).select("qid", F.array_join(F.array_sort(F.transform("anchors", F.lower)), ",").alias("anchors"), F.coalesce("verdict", F.lit("ok")).alias("verdict"))


def guard_concepts(spark, d):
    return _guarded(spark, d, True).select("qid", F.array_join(F.array_sort(F.transform("anchors", F.lower)), ",").alias("anchors"), F.coalesce("verdict", F.lit("ok")).alias("verdict"))


def live_terms(spark, d):
    rows = table(spark, d, QUESTIONS)
    symbols, paths = F.array(F.lit("pkg.Loader"), F.lit("run")), F.array(F.lit("src/pipeline.py#L3"), F.lit("a/b.md"))
    return rows.select("qid", F.array_join(guards.verification_terms(F.col("query"), symbols, paths), "|").alias("terms"))


def legacy_route(spark, d):
    return table(spark, d, ASKED).select("qid", legacy.strategy(F.col("query"), ("Text2SQL", "MetadataFilter", DEFAULT)).alias("strategy"))


DEFAULT = legacy.DEFAULT


def legacy_fallback(spark, d):
    hits = table(spark, d, HITS).select("qid", "content", "score")
    return legacy.with_fallback(hits.where("qid % 3 = 0"), hits.where("qid % 2 = 0"), hits.select("qid").distinct())


def rewrite_queries(spark, d):
    return legacy.rewritten(table(spark, d, ASKED), lambda q: F.split(q, "和|的|, "), 3)


def rewrite_merge(spark, d):
    return legacy.merged(table(spark, d, HITS), 5).select("qid", "content", "place")


def answer_confidence(spark, d):
    return legacy.confidence(table(spark, d, HITS))


def region_summary(spark, d):
    return legacy.table_summary(table(spark, d, "SELECT CAST(n_nationkey AS BIGINT) AS key, n_name AS name FROM {nation}"), "nation", 100, "key")


def filtered_documents(spark, d):
    rows = table(spark, d, "SELECT doc_id, lang, source FROM {documents}")
    return rows.where(sqltool.matches(legacy.condition_filter('lang == "en"\n\nsource == "src3"\n'), rows.columns)).select("doc_id")


QUERIES = {f.__name__: f for f in (guard_verdicts, guard_concepts, live_terms, legacy_route, legacy_fallback, rewrite_queries, rewrite_merge, answer_confidence, region_summary, filtered_documents)}

_GENERIC = "(" + ", ".join(f"'{x}'" for x in GENERIC) + ")"
_IN = "WITH " + ctes(q=QUESTIONS, e=EVIDENCE)


def _anchors(split: bool) -> str:
    named = "regexp_extract_all(query, '`[^`\\r\\n]{1,96}`|\\b(?:[A-Za-z][A-Za-z0-9_-]*[._/][A-Za-z0-9_./-]+|[A-Z][A-Za-z0-9]*(?:[A-Z][A-Za-z0-9]*)+|[A-Z]{2,}|Redis|Kafka|PostgreSQL|Kubernetes|OAuth|CQRS)\\b')"
    if split:
        roots = ", ".join(f"'{x}'" for x in guards.ROOTS)
        named = f"flatten(list_transform({named}, lambda x: CASE WHEN regexp_matches(x, '{guards.SLASHED}') AND lower(split_part(x, '/', 1)) NOT IN ({roots}) THEN string_split(x, '/') ELSE [x] END))"
    return f"""n AS (SELECT qid, unnest(list_concat(regexp_extract_all(query, '(?i)(?:what\\s+is|define|explain|how\\s+to\\s+(?:use|configure))\\s*[`"]?\\s*([A-Za-z][A-Za-z0-9_.\\-/]{{2,}})', 1), regexp_extract_all(query, '(?i)(?:^|[^A-Za-z0-9_])([A-Za-z][A-Za-z0-9_.\\-/]{{2,}})\\s+(?:what\\s+is|definition)', 1), list_transform({named}, lambda x: trim(x, '` ')))) AS a FROM q),
w AS (SELECT qid, unnest(regexp_extract_all(query, '(?:^|[^A-Za-z0-9_])([A-Za-z][A-Za-z0-9_-]{{2,}})', 1)) AS a FROM q),
na AS (SELECT qid, lower(a) AS a FROM n WHERE lower(a) NOT IN {_GENERIC} GROUP BY ALL), wa AS (SELECT qid, lower(a) AS a FROM w WHERE lower(a) NOT IN {_GENERIC} GROUP BY ALL),
anch AS (SELECT * FROM na UNION ALL SELECT qid, any_value(a) FROM wa WHERE qid NOT IN (SELECT qid FROM na) GROUP BY qid HAVING count(*) = 1)"""


def _verdicts(split: bool) -> str:
    hay = lambda name, roles: f"string_agg(CASE WHEN role IN ({roles}) THEN lower(source || chr(10) || coalesce(symbol, '') || chr(10) || content) END, chr(10)) AS {name}"
    return f"""{_IN}, {_anchors(split)},
h AS (SELECT q.qid, query, intent, {hay('live', "'current_implementation'")}, {hay('design', "'internal_design', 'internal_history'")}, {hay('official', "'external_normative'")},
 bool_or(role = 'external_normative' AND aliases <> '' AND (contains(lower(query), 'mcp') OR contains(lower(query), 'model context'))) AS in_scope,
 bool_or(role = 'external_normative' AND aliases <> '' AND (contains(lower(query), 'mcp') OR contains(lower(query), 'model context')) AND CASE topics WHEN 'prompts' THEN contains(lower(query), 'prompts') ELSE contains(lower(query), 'tools') OR contains(lower(query), 'sampling') END) AS on_topic FROM q JOIN e USING (qid) GROUP BY 1, 2, 3),
c AS (SELECT h.qid, count(a) AS n, string_agg(a, ',' ORDER BY a) AS anchors, count(*) FILTER (contains(coalesce(live, ''), a)) AS in_live, count(*) FILTER (contains(coalesce(design, ''), a)) AS in_design, count(*) FILTER (contains(coalesce(official, ''), a)) AS in_official FROM h LEFT JOIN anch USING (qid) GROUP BY 1)
SELECT h.qid, coalesce(anchors, '') AS anchors, CASE WHEN regexp_matches(query, '(?i)SOC\\s*2') THEN 'missing_independent_verification' WHEN intent IN ('official', 'comparison') AND NOT in_scope THEN 'source_not_catalogued' WHEN intent IN ('official', 'comparison') AND NOT on_topic THEN 'topic_not_indexed'
 WHEN intent = 'official' AND in_official < n THEN 'source_not_catalogued' WHEN intent = 'design' AND in_design < n OR intent = 'implementation' AND in_live < n THEN 'unsupported_anchor' WHEN intent = 'comparison' AND in_live = 0 THEN 'missing_current_implementation_evidence' ELSE 'ok' END AS verdict FROM h JOIN c USING (qid)"""


_STOP = "(" + ", ".join(f"'{x}'" for x in guards.STOPWORDS) + ")"
SQL = {
    "guard_verdicts": _verdicts(False),
    "guard_concepts": _verdicts(True),
    "live_terms": f"""{_IN}, d AS (SELECT qid, list_concat(regexp_extract_all(query, '`([^`\\r\\n]{{1,128}})`', 1), regexp_extract_all(query, '\\b(?:[A-Za-z_][A-Za-z0-9_]*(?:\\.[A-Za-z_][A-Za-z0-9_]*)+|[A-Z][A-Za-z0-9_]{{2,}}|[a-z][a-z0-9]*_[a-z0-9_]+)\\b')) AS t, regexp_extract_all(query, '\\b[A-Za-z][A-Za-z0-9_]{{5,}}\\b') AS w FROM q),
a AS (SELECT qid, unnest(CASE WHEN len(t) > 0 THEN t ELSE list_concat(w, ['pkg.Loader', 'run', 'pipeline']) END) AS x, generate_subscripts(CASE WHEN len(t) > 0 THEN t ELSE list_concat(w, ['pkg.Loader', 'run', 'pipeline']) END, 1) AS i FROM d),
b AS (SELECT qid, lower(x) AS l, min(i) AS i, arg_min(x, i) AS x FROM a WHERE lower(x) NOT IN {_STOP} GROUP BY 1, 2), c AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY i) AS n FROM b)
SELECT q.qid, coalesce(string_agg(x, '|' ORDER BY i) FILTER (n <= 6), '') AS terms FROM q LEFT JOIN c USING (qid) GROUP BY 1""",
    "legacy_route": f"WITH {ctes(a=ASKED)} SELECT qid, CASE WHEN regexp_matches(query, '多少|对比|排名|查询|统计|最大|最小|平均|几个') THEN 'Text2SQL' WHEN regexp_matches(query, '文档|API|教程|如何|怎么|配置') THEN 'MetadataFilter' ELSE 'HybridSearch' END AS strategy FROM a",
    "legacy_fallback": f"WITH {ctes(h=HITS)} SELECT qid, content, score, qid % 3 <> 0 AS fell_back FROM h WHERE qid % 3 = 0 OR qid % 2 = 0",
    "rewrite_queries": f"WITH {ctes(a=ASKED)}, s AS (SELECT qid, list_concat([query], list_slice(list_filter(list_transform(regexp_split_to_array(query, '和|的|, '), lambda x: trim(x)), lambda x: x <> ''), 1, 3)) AS l FROM a) SELECT qid, (generate_subscripts(l, 1) - 1)::INTEGER AS number, unnest(l) AS query FROM s",
    "rewrite_merge": f"WITH {ctes(h=HITS)}, o AS (SELECT *, row_number() OVER (PARTITION BY qid, content ORDER BY number, rank) AS n FROM h) SELECT * FROM (SELECT qid, content, row_number() OVER (PARTITION BY qid ORDER BY number, rank)::INTEGER AS place FROM o WHERE n = 1) WHERE place <= 5",
    "answer_confidence": f"WITH {ctes(h=HITS)} SELECT qid, round(avg(score), 2) AS confidence FROM h GROUP BY 1",
    "region_summary": "SELECT 'table' AS kind, 'nation: key (bigint), name (string); rows: ' || count(*) AS content FROM nation UNION ALL SELECT 'table_row', 'key: ' || n_nationkey || ' | name: ' || n_name FROM (SELECT * FROM nation ORDER BY n_nationkey LIMIT 100)",
    "filtered_documents": "SELECT doc_id FROM documents WHERE lang = 'en' AND source = 'src3'",
}
