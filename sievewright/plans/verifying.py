"""Queries of live verification, support slots, definition order, profiles, reports and label migration."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import values
from ..operators import live
from .judge import SCORES
from .portable import ctes, table

SYMBOLS = "SELECT 'src/f' || CAST(doc_id % 37 AS STRING) || '.py' AS path, CASE WHEN doc_id % 3 = 0 THEN 'Mod' || CAST(doc_id % 11 AS STRING) WHEN doc_id % 3 = 1 THEN 'Mod' || CAST(doc_id % 11 AS STRING) || '.run' ELSE 'run' || CAST(doc_id % 5 AS STRING) END AS symbol, CAST(doc_id AS INT) AS line_start FROM {documents}"
TERMS = "SELECT item_id AS qid, CASE item_id % 4 WHEN 0 THEN 'run' WHEN 1 THEN 'Mod' || CAST(item_id % 11 AS STRING) || '.run' WHEN 2 THEN 'Mod' || CAST(item_id % 11 AS STRING) ELSE 'run' || CAST(item_id % 5 AS STRING) END AS term FROM {benchmark} UNION ALL SELECT item_id, 'Mod3' FROM {benchmark} WHERE item_id % 2 = 0"
HISTORY = "SELECT md5(CAST(doc_id AS STRING)) AS commit_sha, CAST(doc_id * 7919 % 100003 AS BIGINT) AS committed_at, 'Fix ' || source || ' of part ' || CAST(doc_id % 9 AS STRING) AS subject, 'src/p' || CAST(doc_id % 23 AS STRING) AS path FROM {documents}"
ASKED = "SELECT item_id AS qid, CASE item_id % 3 WHEN 0 THEN ' PART ' || CAST(item_id % 9 AS STRING) WHEN 1 THEN 'src1' ELSE '  ' END AS query FROM {benchmark}"
RANKED = """SELECT qid, item, CAST(row_number() OVER (PARTITION BY qid, side ORDER BY item) AS INT) AS rank, side, role, path, symbol, content, authority, kind FROM (SELECT doc_id % 40 AS qid, doc_id AS item, CASE WHEN doc_id % 80 < 40 THEN 'primary' ELSE 'support' END AS side,
 CASE doc_id % 3 WHEN 0 THEN 'current_implementation' WHEN 1 THEN 'internal_design' ELSE 'internal_history' END AS role, CASE WHEN doc_id % 7 = 0 THEN 'SRC//App.py:' || CAST(doc_id AS STRING) ELSE 'docs/p' || CAST(doc_id % 11 AS STRING) || '.md#x' END AS path,
 CASE WHEN doc_id % 5 = 0 THEN 'Engine.run_' || source END AS symbol, CASE WHEN doc_id % 4 = 0 THEN 'overview of the engine' WHEN doc_id % 4 = 1 THEN 'def run(): import x' ELSE 'the loader of ' || source END AS content,
 CASE doc_id % 4 WHEN 0 THEN 'code' WHEN 1 THEN 'design' WHEN 2 THEN 'official' ELSE 'history' END AS authority, CASE WHEN doc_id % 6 = 0 THEN 'document' END AS kind FROM {documents}) AS x"""
NAMED = "SELECT item_id AS qid, CASE item_id % 5 WHEN 0 THEN 'how does Engine.run_src1 load' WHEN 1 THEN 'what is the loader in docs' WHEN 2 THEN '为什么' WHEN 3 THEN 'Define app.py and engine' ELSE 'the loader of src3 in p4.md' END AS query FROM {benchmark}"
PROFILES = "SELECT 'd' || CAST(a AS STRING) || 'b' || CAST(b AS STRING) AS name, CAST(a AS DOUBLE) AS dense_weight, CAST(b AS DOUBLE) / 2 AS bm25_weight, a + 1 AS multiplier FROM (SELECT 0 AS a UNION ALL SELECT 1 UNION ALL SELECT 2) AS x CROSS JOIN (SELECT 1 AS b UNION ALL SELECT 2) AS y"
ARMS = "SELECT doc_id % 40 AS qid, doc_id AS item, r AS retriever, CAST(row_number() OVER (PARTITION BY doc_id % 40, r ORDER BY doc_id * CASE r WHEN 'dense' THEN 31 ELSE 17 END % 101, doc_id) AS INT) AS rank FROM {documents} CROSS JOIN (SELECT 'dense' AS r UNION ALL SELECT 'bm25') AS rs"
ROUTED = "SELECT doc_id % 40 AS qid, doc_id AS item, CAST(row_number() OVER (PARTITION BY doc_id % 40 ORDER BY doc_id) AS INT) AS rank, CASE WHEN doc_id % 3 = 0 THEN 'official' ELSE 'internal' END AS corpus, CASE WHEN doc_id % 3 = 0 THEN 'official' WHEN doc_id % 3 = 1 THEN 'code' ELSE 'design' END AS authority, doc_id % 97 = 5 AS degraded FROM {documents}"
ROUTES = "SELECT item_id AS qid, CASE item_id % 5 WHEN 0 THEN 'design' WHEN 1 THEN 'official' WHEN 2 THEN 'comparison' WHEN 3 THEN 'implementation' ELSE '' END AS route FROM {benchmark}"
PATHS = "SELECT doc_id, CASE doc_id % 6 WHEN 0 THEN 'C:' || chr(92) || 'Work' || chr(92) || 'Docs' || chr(92) || source || '.md' WHEN 1 THEN '/home/x/docs/y/tests/' || source WHEN 2 THEN 'docs/' || source WHEN 3 THEN 'https://h/' || source WHEN 4 THEN '/srv/README.md' ELSE '/srv/' || source END AS raw FROM {documents}"
LABELS = "SELECT doc_id AS sample_id, doc_id % 6 > 0 AS answerable, CASE WHEN doc_id % 7 = 0 THEN 'official_specifications' ELSE 'internal' END AS scope, CASE doc_id % 4 WHEN 0 THEN 'design_architecture' WHEN 1 THEN 'code_symbol_call_chain' WHEN 2 THEN 'security_permissions' ELSE 'other' END AS category, CASE WHEN doc_id % 5 = 0 THEN 'trace' ELSE 'explain' END AS intent, 'x/' || source || ',pkg/a.py,docs/' || source || ',pkg/a.py' AS listed FROM {documents}"
VALUES = "SELECT doc_id, lang, source, 'q\"' || chr(92) || chr(10) || source AS note FROM {documents}"


def live_symbols(spark, d):
    return live.symbol_hits(table(spark, d, SYMBOLS), table(spark, d, TERMS), 4)


def live_merge(spark, d):
    ranked = live_symbols(spark, d).groupBy("qid", "path").agg(F.min("rank").alias("rank")).withColumn("score", 1.0 / F.col("rank"))
    text = table(spark, d, RANKED).where("side = 'support'").select("qid", F.concat(F.lit("src/f"), (F.col("item") % 37).cast("string"), F.lit(".py")).alias("path"), "rank").groupBy("qid", "path").agg(F.min("rank").alias("rank")).withColumn("score", 1.0 / F.col("rank"))
    return live.merged_hits(ranked, text, 5).select("qid", "path", "fused")


def commit_search(spark, d):
    return live.commits(table(spark, d, HISTORY).drop("path"), table(spark, d, ASKED), 6)


def path_states(spark, d):
    return live.path_states(table(spark, d, HISTORY))


def _sides(spark, d):
    rows = table(spark, d, RANKED)
    return rows.where("side = 'primary' and rank <= 2"), rows.where("side = 'support'")


def support_first(spark, d):
    primary, support = _sides(spark, d)
    return live.first_support(primary, support).select("qid", "item", "role")


def support_diverse(spark, d):
    primary, support = _sides(spark, d)
    return live.diverse_support(table(spark, d, NAMED), primary, support)


def parent_classes(spark, d):
    rows = table(spark, d, SYMBOLS).where("symbol like '%.%'").withColumn("symbol", F.when(F.col("line_start") % 5 == 0, "Gone.run").otherwise(F.col("symbol")))
    return live.with_parents(rows, table(spark, d, SYMBOLS)).select("line_start", "symbol", "path", "expanded_from")


def comparison_candidates(spark, d):
    rows = table(spark, d, RANKED).select("qid", F.col("item").alias("doc_id"), "rank", "side")
    return live.with_official(rows.where("side = 'primary' and rank <= 3").drop("side"), rows.where("side = 'primary' and rank between 2 and 5").drop("side")).select("qid", "doc_id", "place")


def definition_order(spark, d):
    rows = table(spark, d, RANKED).where("side = 'primary'").join(table(spark, d, NAMED), "qid").withColumn("page", live.file_key(F.col("path")))
    priority = live.definition_priority(F.col("authority"), F.col("kind"), F.col("content"), F.col("path"))
    return live.definition_order(rows, priority).select("qid", "item", "page", "place")


def plain_fusion(spark, d):
    arms = table(spark, d, ARMS).where("rank <= 10").withColumn("score", F.lit(0.0))
    return live.plain_fusion(arms.where("retriever = 'dense'").drop("retriever"), arms.where("retriever = 'bm25'").drop("retriever"), "item")


def profile_runs(spark, d):
    return live.profile_runs(table(spark, d, ARMS), table(spark, d, PROFILES), "item", 3)


def dense_view(spark, d):
    return live.one_arm(table(spark, d, ARMS), "dense", 5)


def oracle_results(spark, d):
    return live.oracle_results(table(spark, d, ROUTES), table(spark, d, ROUTED), 3)


def judge_summary(spark, d):
    return live.judge_summary(table(spark, d, SCORES).where("family = 'judged'"))


def report_table(spark, d):
    return live.report_lines(judge_summary(spark, d), "metric", ["mean", "coverage"])


def published_paths(spark, d):
    return table(spark, d, PATHS).select("doc_id", live.published_path(F.col("raw"), ["docs", "tests"], ["README.md"]).alias("shown"))


def migrated_labels(spark, d):
    rows = live.migrated_labels(table(spark, d, LABELS).withColumn("sources", F.split("listed", ",")), "pkg", ["trace"])
    return rows.select("sample_id", "route", F.array_join("primary", ",").alias("primary_sources"), F.array_join("supporting", ",").alias("supporting_sources"))


def canonical_hashes(spark, d):
    rows = table(spark, d, VALUES)
    return rows.select("doc_id", values.canonical_hash(F.create_map(*(x for c in ("source", "lang", "note") for x in (F.lit(c), F.col(c))))).alias("hash"))


def iso_dates(spark, d):
    rows = table(spark, d, "SELECT event_id, ts FROM {events}")
    text = values.iso(F.col("ts").cast("timestamp"))
    return rows.select("event_id", text.alias("iso"), (values.from_iso(text) == F.col("ts").cast("timestamp")).alias("round_trip"), values.from_iso(F.concat(F.lit("x"), text)).isNull().alias("bad_is_null"))


QUERIES = {
    f.__name__: f
    for f in (
        live_symbols, live_merge, commit_search, path_states, support_first, support_diverse, parent_classes, comparison_candidates, definition_order, plain_fusion, profile_runs, dense_view, oracle_results, judge_summary,
        report_table, published_paths, migrated_labels, canonical_hashes, iso_dates,
    )
}

_SYM = "WITH " + ctes(s=SYMBOLS, t=TERMS, r=RANKED, q=NAMED)
_HITS = "hits AS (SELECT qid, path, symbol, line_start, max(CASE WHEN symbol = term THEN 4 ELSE 3 END) AS score FROM s JOIN t ON symbol = term OR (NOT contains(term, '.') AND split_part(symbol, '.', -1) = term) GROUP BY 1, 2, 3, 4), ranked AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, path, line_start, symbol)::INTEGER AS rank FROM hits)"
_PLAIN = "(" + ", ".join(f"'{x}'" for x in live.PLAIN) + ")"
_FILE = "lower(regexp_replace(regexp_replace(split_part(path, '#', 1), ':\\d+$', ''), '/+', '/', 'g'))"
_CODE = "(?i)(?:```|\\b(?:def|class|import|from|const|function)\\s+|pip\\s+install|\\b(?:async\\s+)?def\\b)"


def _names(text: str) -> str:
    raw = f"list_transform(regexp_extract_all(coalesce({text}, ''), '[A-Za-z_][A-Za-z0-9_.-]*'), lambda t: lower(trim(t, '._-')))"
    return f"list_distinct(list_filter(flatten(list_transform({raw}, lambda t: list_concat([t], regexp_split_to_array(t, '[._-]+')))), lambda t: length(t) >= 2 AND t NOT IN {_PLAIN}))"


_JUDGED = f"WITH {ctes(x=SCORES)}, j AS (SELECT metric, round(avg(value), 9) AS mean, count(value) AS successful, count(*) - count(value) AS failed, round(count(value)::DOUBLE / count(*), 9) AS coverage FROM x WHERE family = 'judged' GROUP BY 1)"
SQL = {
    "live_symbols": f"{_SYM}, {_HITS} SELECT * FROM ranked WHERE rank <= 4",
    "live_merge": f"{_SYM}, {_HITS}, a AS (SELECT qid, path, min(rank) AS rank FROM ranked WHERE rank <= 4 GROUP BY 1, 2), b AS (SELECT qid, 'src/f' || item % 37 || '.py' AS path, min(rank) AS rank FROM r WHERE side = 'support' GROUP BY 1, 2), u AS (SELECT qid, path, 1.5::DOUBLE / (60 + rank) AS w, 0 AS l, rank FROM a UNION ALL SELECT qid, path, 1.0::DOUBLE / (60 + rank), 1, rank FROM b), f AS (SELECT qid, path, round(sum(w), 9) AS fused, min(l * 100000 + rank) AS first FROM u GROUP BY 1, 2) SELECT qid, path, fused FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY fused DESC, first, path) AS n FROM f) WHERE n <= 5",
    "commit_search": f"WITH {ctes(h=HISTORY, a=ASKED)}, m AS (SELECT qid, h.*, row_number() OVER (PARTITION BY qid ORDER BY committed_at DESC, commit_sha)::INTEGER AS rank FROM h JOIN a ON trim(query) <> '' AND contains(lower(subject), lower(trim(query)))) SELECT qid, commit_sha, 'Commit ' || commit_sha || ': ' || subject || ' (' || committed_at || ')' AS content, 1.0::DOUBLE / rank AS score, rank FROM m WHERE rank <= 6",
    "path_states": f"WITH {ctes(h=HISTORY)} SELECT path, arg_max(commit_sha, (committed_at, commit_sha)) AS last_sha, max(committed_at) AS last_at, count(DISTINCT commit_sha) AS n_commits FROM h GROUP BY 1",
    "support_first": f"{_SYM}, p AS (SELECT * FROM r WHERE side = 'primary' AND rank <= 2), f AS (SELECT * FROM r WHERE side = 'support' AND rank = 1) SELECT qid, item, role FROM f WHERE NOT EXISTS (SELECT 1 FROM p WHERE p.qid = f.qid AND p.role = f.role)",
    "support_diverse": f"""{_SYM}, n AS (SELECT qid, {_names('query')} AS asked FROM q), p AS (SELECT *, {_FILE} AS file FROM r WHERE side = 'primary' AND rank <= 2), f AS (SELECT * FROM (SELECT *, {_FILE} AS file FROM r WHERE side = 'support') x WHERE NOT EXISTS (SELECT 1 FROM p WHERE p.qid = x.qid AND (p.file = x.file OR p.role = x.role))),
one AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY qid, file ORDER BY rank) AS k FROM f) WHERE k = 1), known AS (SELECT qid, list_distinct(flatten(list({_names("concat_ws(' ', symbol, path)")}))) AS known FROM p GROUP BY 1),
h AS (SELECT one.*, list_intersect(asked, {_names('symbol')}) AS hs, list_intersect(asked, {_names('path')}) AS hp, list_intersect(asked, {_names('content')}) AS hc, coalesce(known, []) AS known FROM one JOIN n USING (qid) LEFT JOIN known USING (qid) WHERE len(asked) > 0),
c AS (SELECT qid, item, role, rank, round(10 * len(hs) + 2 * len(hp) + 0.5 * len(hc) + 3 * len(list_filter(list_distinct(flatten([hs, hp, hc])), lambda t: NOT list_contains(known, t))) + 1.0::DOUBLE / rank, 6) AS support FROM h),
b AS (SELECT qid, item, role, support FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY support DESC, rank) AS k FROM c) WHERE k = 1), z AS (SELECT r.* FROM r JOIN n USING (qid) WHERE len(asked) = 0 AND side = 'support' AND rank = 1)
SELECT * FROM b UNION ALL SELECT qid, item, role, NULL FROM z WHERE NOT EXISTS (SELECT 1 FROM p WHERE p.qid = z.qid AND p.role = z.role)""",
    "parent_classes": f"{_SYM}, m AS (SELECT line_start, path, CASE WHEN line_start % 5 = 0 THEN 'Gone.run' ELSE symbol END AS symbol FROM s WHERE contains(symbol, '.')), c AS (SELECT symbol AS parent, min({{'p': path, 'l': line_start}}) AS hit FROM s WHERE NOT contains(symbol, '.') GROUP BY 1) SELECT line_start, coalesce(parent, symbol) AS symbol, coalesce(hit.p, path) AS path, CASE WHEN parent IS NOT NULL THEN symbol END AS expanded_from FROM m LEFT JOIN c ON parent = split_part(symbol, '.', 1)",
    "comparison_candidates": f"{_SYM}, i AS (SELECT qid, item, rank, 0 AS o FROM r WHERE side = 'primary' AND rank <= 3), e AS (SELECT qid, item, rank, 1 AS o FROM r WHERE side = 'primary' AND rank BETWEEN 2 AND 5 AND (qid, item) NOT IN (SELECT (qid, item) FROM i)) SELECT qid, item AS doc_id, row_number() OVER (PARTITION BY qid ORDER BY o, rank)::INTEGER AS place FROM (SELECT * FROM i UNION ALL SELECT * FROM e)",
    "definition_order": f"""{_SYM}, x AS (SELECT r.*, regexp_matches(query, '(?i)(?:what\\s+is|define|overview)') AS d, {_FILE} AS page, CASE WHEN regexp_matches(query, '(?i)(?:what\\s+is|define|overview)') THEN CASE WHEN regexp_matches(path || ' ' || substr(content, 1, 500), '(?i)(?:overview|introduction|readme)') THEN -5 ELSE 0 END + CASE WHEN authority IN ('official', 'design') THEN -2 ELSE 0 END + CASE WHEN kind = 'document' THEN -1 ELSE 0 END + CASE WHEN authority = 'code' OR regexp_matches(content, '{_CODE}') THEN 5 ELSE 0 END ELSE 0 END AS p FROM r JOIN q USING (qid) WHERE side = 'primary'),
y AS (SELECT *, row_number() OVER (PARTITION BY qid, page ORDER BY p, rank) AS n, (SELECT count(DISTINCT page) FROM x z WHERE z.qid = x.qid) AS pages FROM x) SELECT qid, item, page, row_number() OVER (PARTITION BY qid ORDER BY p, rank)::INTEGER AS place FROM y WHERE NOT d OR n <= CASE WHEN pages > 1 THEN 2 ELSE 3 END""",
    "plain_fusion": f"WITH {ctes(a=ARMS)} SELECT qid, item, round(sum(1.0::DOUBLE / (60 + rank)), 9) AS fused, CASE WHEN bool_or(retriever = 'bm25') THEN 'sparse' ELSE 'dense' END AS shown FROM a WHERE rank <= 10 GROUP BY 1, 2",
    "profile_runs": f"WITH {ctes(a=ARMS, p=PROFILES)}, s AS (SELECT name, qid, item, round(sum(CASE retriever WHEN 'dense' THEN dense_weight ELSE bm25_weight END / (60 + rank)), 9) AS fused FROM a, p WHERE rank <= multiplier * 3 GROUP BY 1, 2, 3) SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY name, qid ORDER BY fused DESC, item)::INTEGER AS rank FROM s) WHERE rank <= 3",
    "dense_view": f"WITH {ctes(a=ARMS)} SELECT * FROM a WHERE retriever = 'dense' AND rank <= 5",
    "oracle_results": f"""WITH {ctes(a=ROUTED, b=ROUTES)}, x AS (SELECT a.* FROM a JOIN b USING (qid) WHERE CASE WHEN route IN ('design', 'implementation') THEN corpus = 'internal' WHEN route = 'official' THEN corpus = 'official' ELSE route = 'comparison' END), bad AS (SELECT DISTINCT qid FROM x WHERE degraded),
k AS (SELECT qid, item, row_number() OVER (PARTITION BY qid ORDER BY rank)::INTEGER AS place FROM x WHERE qid NOT IN (SELECT qid FROM bad)) SELECT qid, item, place, NULL::VARCHAR AS error FROM k WHERE place <= 3 UNION ALL SELECT qid, NULL, NULL, 'degraded retrieval' FROM bad""",
    "judge_summary": f"{_JUDGED} SELECT * FROM j",
    "report_table": f"{_JUDGED} SELECT (row_number() OVER (ORDER BY metric) + 2)::INTEGER AS line_no, '| ' || metric || ' | ' || coalesce(printf('%.4f', mean), 'n/a') || ' | ' || coalesce(printf('%.4f', coverage), 'n/a') || ' |' AS line FROM j UNION ALL SELECT 1, '| metric | mean | coverage |' UNION ALL SELECT 2, '| --- | --- | --- |'",
    "published_paths": f"WITH {ctes(p=PATHS)} SELECT doc_id, CASE doc_id % 6 WHEN 0 THEN split_part(replace(raw, '\\', '/'), '/', 3) || '/' || split_part(replace(raw, '\\', '/'), '/', 4) WHEN 1 THEN substr(raw, 9) WHEN 2 THEN raw WHEN 3 THEN raw WHEN 4 THEN 'README.md' END AS shown FROM p",
    "migrated_labels": f"""WITH {ctes(l=LABELS)}, x AS (SELECT *, CASE WHEN scope = 'official_specifications' THEN 'official' WHEN category = 'design_architecture' THEN 'design' WHEN category = 'code_symbol_call_chain' THEN 'implementation' WHEN category = 'security_permissions' THEN CASE intent WHEN 'trace' THEN 'implementation' ELSE 'design' END END AS route, string_split(listed, ',') AS s FROM l),
y AS (SELECT *, CASE WHEN NOT answerable THEN '' WHEN route = 'design' THEN s[3] WHEN route = 'implementation' THEN 'pkg/a.py' ELSE s[1] END AS p FROM x) SELECT sample_id, route, p AS primary_sources, CASE WHEN answerable THEN array_to_string(list_filter([s[1], s[2], s[3]], lambda v: v <> p), ',') ELSE '' END AS supporting_sources FROM y""",
    "canonical_hashes": f"WITH {ctes(v=VALUES)} SELECT doc_id, sha256('{{\"lang\":' || coalesce('\"' || lang || '\"', 'null') || ',\"note\":\"q\\\"\\\\\\n' || source || '\",\"source\":\"' || source || '\"}}') AS hash FROM v",
    "iso_dates": "SELECT event_id, strftime(ts, '%Y-%m-%dT%H:%M:%S') || CASE WHEN microsecond(ts) % 1000000 > 0 THEN '.' || lpad((microsecond(ts) % 1000000)::VARCHAR, 6, '0') ELSE '' END || '+00:00' AS iso, true AS round_trip, true AS bad_is_null FROM events",
}
