"""Queries of the scoring operators: labelled questions, their sources and ranked predictions."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import evaluate, scoring
from .portable import ctes, table

TOP = 5
SAMPLES = """SELECT item_id AS sample_id, item_id % 4 <> 3 AS answerable,
 'Where does Mod' || CAST(item_id % 7 AS STRING) || '.run_once call QueryEngine or plain words in API ' || CAST(item_id AS STRING) AS question,
 CASE WHEN item_id % 5 < 2 THEN 'code_symbol_call_chain' WHEN item_id % 5 = 2 THEN 'official_spec' ELSE 'general' END AS category,
 CASE item_id % 6 WHEN 0 THEN 'Explain_Architecture' WHEN 1 THEN 'symbol' WHEN 2 THEN 'cross_comparison' WHEN 3 THEN 'inventory_current_state' WHEN 4 THEN 'unanswerable_metric' ELSE 'code' END AS intent,
 CASE WHEN item_id % 9 = 0 THEN 'Official_docs' ELSE 'internal' END AS scope, CASE WHEN item_id % 11 = 0 THEN ' Project-Design ' WHEN item_id % 11 = 1 THEN 'spec' END AS label,
 CASE WHEN item_id % 4 = 3 THEN 'topic_not_indexed' END AS wanted_reason FROM {benchmark}"""
TRUTH = """SELECT item_id AS sample_id, 'primary' AS kind, 'src/Mod' || CAST(item_id % 7 AS STRING) || '.py' AS source FROM {benchmark} WHERE item_id % 4 <> 3
UNION ALL SELECT item_id, 'primary', './docs//Page' || CAST(item_id % 3 AS STRING) || '.md' FROM {benchmark} WHERE item_id % 4 < 2
UNION ALL SELECT item_id, 'supporting', 'HTTPS://Example.org/spec/' || CAST(item_id % 4 AS STRING) || '/#top' FROM {benchmark} WHERE item_id % 4 <> 3 AND item_id % 3 > 0"""
RESULTS = """SELECT strategy, sample_id, CAST(row_number() OVER (PARTITION BY strategy, sample_id ORDER BY doc_id) AS INT) AS rank, source, symbol, live FROM (
 SELECT CASE WHEN doc_id % 2 = 0 THEN 'base' ELSE 'other' END AS strategy, doc_id % 40 AS sample_id, doc_id,
 CASE doc_id % 8 WHEN 0 THEN 'src/mod' || CAST(doc_id % 7 AS STRING) || '.py' WHEN 1 THEN 'C:/repo/src/MOD' || CAST(doc_id % 7 AS STRING) || '.py' WHEN 2 THEN 'docs/page' || CAST(doc_id % 3 AS STRING) || '.md'
 WHEN 3 THEN 'https://EXAMPLE.org/spec/' || CAST(doc_id % 4 AS STRING) WHEN 4 THEN '/srv/x/./docs/Page' || CAST(doc_id % 3 AS STRING) || '.md' WHEN 5 THEN 'https://example.org/spec/1?v=2' ELSE 'lib/' || source || '.txt' END AS source,
 CASE WHEN doc_id % 3 = 0 THEN 'pkg.Mod' || CAST(doc_id % 7 AS STRING) || '.run_once' WHEN doc_id % 3 = 1 THEN 'QueryEngine' END AS symbol, doc_id % 5 = 0 AS live FROM {documents} WHERE doc_id % 40 < 40)"""
PREDICTIONS = """SELECT strategy, item_id AS sample_id, CASE (item_id + bump) % 5 WHEN 0 THEN 'Internal' WHEN 1 THEN 'spec' WHEN 2 THEN 'design' WHEN 3 THEN 'comparison' ELSE 'code' END AS intent, (item_id + bump) % 4 = 3 OR item_id % 10 = 0 AS refused,
 item_id % 13 = 0 AS oracle_route, CASE WHEN item_id % 2 = 1 THEN 'topic_not_indexed' ELSE 'unsupported_anchor' END AS found_reason, CAST((item_id * 37 + bump) % 101 AS DOUBLE) / 4 AS latency_ms
 FROM {benchmark} CROSS JOIN (SELECT 'base' AS strategy, 0 AS bump UNION ALL SELECT 'other', 1) AS s"""
KEYS = """SELECT DISTINCT source AS raw FROM (SELECT 'C:' || chr(92) || 'Repo' || chr(92) || 'src' || chr(92) || 'A' || CAST(doc_id % 50 AS STRING) || '.py' AS source FROM {documents} UNION ALL SELECT '././x//y/./' || source FROM {documents}
 UNION ALL SELECT ' HTTP://Host.Example:80/A/b//?q=' || lang || '#f' FROM {documents} WHERE lang IS NOT NULL UNION ALL SELECT 'https://h/#x' FROM {documents} UNION ALL SELECT url FROM {pages}) AS u"""


def source_keys(spark, d):
    rows = table(spark, d, KEYS)
    shown = scoring.report_source(F.col("raw"), F.lit(None).cast("string"))
    key = scoring.source_key(F.col("raw"))
    return rows.select("raw", key.alias("source_key"), shown.alias("shown"), scoring.source_match(F.lit("src/a7.py"), key).alias("is_a7"))


def route_labels(spark, d):
    route = scoring.expected_route(F.col("label"), F.col("intent"), F.col("scope"), F.col("category"), F.col("answerable"))
    return table(spark, d, SAMPLES).select("sample_id", route.alias("route"))


def question_symbols(spark, d):
    symbols = scoring.explicit_symbols(F.col("question"), F.col("category"), F.array().cast("array<string>"))
    return table(spark, d, SAMPLES).select("sample_id", F.explode(symbols).alias("symbol"))


def _scored(spark, d):
    results = table(spark, d, RESULTS)
    return scoring.scored(table(spark, d, SAMPLES).select("sample_id"), table(spark, d, TRUTH), results, spark.createDataFrame([("base",), ("other",)], "strategy string"), TOP)


def scored_samples(spark, d):
    return _scored(spark, d)


def symbol_matches(spark, d):
    return scoring.symbol_recall(question_symbols(spark, d), table(spark, d, RESULTS), TOP)


def _judged(spark, d):
    samples = table(spark, d, SAMPLES)
    route = scoring.expected_route(F.col("label"), F.col("intent"), F.col("scope"), F.col("category"), F.col("answerable"))
    found = table(spark, d, PREDICTIONS).withColumn("found_route", scoring.route_name(F.col("intent"))).drop("intent")
    share = symbol_matches(spark, d).select("strategy", "sample_id", (F.col("n_matched") / F.col("n_symbols")).alias("symbol_recall"))
    rows = _scored(spark, d).join(samples.select("sample_id", "answerable", "wanted_reason", route.alias("wanted_route")), "sample_id").join(found, ["strategy", "sample_id"])
    return rows.join(share, ["strategy", "sample_id"], "left")


def strategy_summary(spark, d):
    return scoring.strategy_summary(_judged(spark, d))


def route_macro_f1(spark, d):
    return scoring.route_macro_f1(_judged(spark, d))


def strategy_deltas(spark, d):
    summary = scoring.strategy_summary(_judged(spark, d)).select("strategy", "hit", "mrr", "ndcg", "refusal_f1")
    return evaluate.deltas(summary, "strategy", "base", ["hit", "mrr", "ndcg", "refusal_f1"])


RUNS = "SELECT source AS strategy, CASE WHEN source = 'src3' THEN 'b2' ELSE 'b1' END AS build_id, 'hash-12' AS embedding_model, 5 AS top_k, CAST(count(*) AS BIGINT) AS n_questions, min(n_chars) < 20 AS failed FROM {documents} GROUP BY source"


def suite_contract(spark, d):
    return scoring.contract_violations(table(spark, d, RUNS))


QUERIES = {f.__name__: f for f in (source_keys, route_labels, question_symbols, scored_samples, symbol_matches, strategy_summary, route_macro_f1, strategy_deltas, suite_contract)}


def _key(x: str) -> str:
    t = f"replace(trim({x}), '\\', '/')"
    part = lambda k: f"regexp_extract({t}, '^([A-Za-z][A-Za-z0-9+.-]*)://([^/?#]*)([^?#]*)(\\?[^#]+)?', {k})"
    url = f"lower({part(1)}) || '://' || lower({part(2)}) || CASE WHEN rtrim({part(3)}, '/') = '' THEN '/' ELSE rtrim({part(3)}, '/') END || {part(4)}"
    return f"CASE WHEN lower({part(1)}) IN ('http', 'https') THEN {url} ELSE lower(array_to_string(list_filter(string_split({t}, '/'), lambda p: p <> '' AND p <> '.'), '/')) END"


def _match(e: str, a: str) -> str:
    return f"({e} = {a} OR (NOT regexp_matches({e}, '^https?://') AND ends_with({a}, '/' || {e})))"


_NAME = "CASE r WHEN 'internal' THEN 'implementation' WHEN 'code' THEN 'implementation' WHEN 'project_design' THEN 'design' WHEN 'external' THEN 'official' WHEN 'spec' THEN 'official' WHEN 'abstain' THEN 'out_of_scope' WHEN 'unanswerable' THEN 'out_of_scope' ELSE r END"


def _named(x: str) -> str:
    return _NAME.replace("r WHEN", f"replace(lower(trim({x})), '-', '_') WHEN", 1).replace("ELSE r", f"ELSE replace(lower(trim({x})), '-', '_')")


_ROUTE = f"""CASE WHEN coalesce(label, '') <> '' THEN {_named('label')} WHEN NOT answerable OR contains(lower(intent), 'unanswerable') THEN '' WHEN contains(lower(intent), 'comparison') THEN 'comparison'
 WHEN starts_with(lower(scope), 'official') OR starts_with(category, 'official_') THEN 'official' WHEN regexp_matches(lower(intent), 'architecture|boundary|maturity|differentiate|inventory_current') THEN 'design' ELSE 'implementation' END"""
_SYMBOLS = "SELECT DISTINCT sample_id, symbol FROM (SELECT sample_id, unnest(regexp_extract_all(question, '[A-Za-z_][A-Za-z0-9_]*(?:\\.[A-Za-z_][A-Za-z0-9_]*)*')) AS symbol FROM samples WHERE category = 'code_symbol_call_chain') WHERE regexp_matches(symbol, '[._]') OR (regexp_matches(symbol, '[a-z]') AND regexp_matches(symbol, '^.+[A-Z]'))"
_SCORED = f"""st AS (SELECT unnest(['base', 'other']) AS strategy),
raw AS (SELECT *, {_key('source')} AS key FROM results WHERE rank <= 15),
once AS (SELECT *, row_number() OVER (PARTITION BY strategy, sample_id ORDER BY rank) AS place FROM (SELECT *, row_number() OVER (PARTITION BY strategy, sample_id, key ORDER BY rank) AS n FROM raw) WHERE n = 1),
shown AS (SELECT * FROM once WHERE place <= 5),
want AS (SELECT DISTINCT sample_id, kind, {_key('source')} AS want FROM truth),
pairs AS (SELECT s.*, w.kind, w.want FROM shown s JOIN want w ON s.sample_id = w.sample_id AND {_match('w.want', 's.key')}),
graded AS (SELECT strategy, sample_id, place, max(CASE WHEN kind = 'primary' THEN 2 ELSE 1 END) AS g, bool_or(live) AS live FROM pairs GROUP BY 1, 2, 3),
got AS (SELECT strategy, sample_id, sum((2 ** g - 1) / log2(place + 1.0)) AS dcg, min(place) FILTER (g = 2) AS first, count(*) AS cited, bool_or(g = 2 AND live) AS live_hit FROM graded GROUP BY 1, 2),
m AS (SELECT strategy, sample_id, count(DISTINCT want) FILTER (kind = 'primary') AS m1, count(DISTINCT want) FILTER (kind = 'supporting') AS m2 FROM pairs GROUP BY 1, 2),
sizes AS (SELECT sample_id, count(*) FILTER (kind = 'primary') AS n1, count(*) FILTER (kind = 'supporting') AS n2 FROM want GROUP BY 1),
num AS (SELECT strategy, sample_id, count(*) AS n FROM shown GROUP BY 1, 2),
ideal AS (SELECT sample_id, sum(g / log2(i + 1.0)) AS ideal FROM (SELECT sample_id, CASE kind WHEN 'primary' THEN 3 ELSE 1 END AS g, row_number() OVER (PARTITION BY sample_id ORDER BY kind) AS i FROM want) WHERE i <= 5 GROUP BY 1),
scored AS (SELECT st.strategy, samples.sample_id, CASE WHEN n1 > 0 THEN coalesce(m1, 0)::DOUBLE / n1 END AS primary_recall, CASE WHEN n1 > 0 THEN CASE WHEN m1 > 0 THEN 1.0::DOUBLE ELSE 0.0 END END AS hit,
 CASE WHEN n2 > 0 THEN coalesce(m2, 0)::DOUBLE / n2 END AS supporting_recall, CASE WHEN n1 > 0 THEN coalesce(1.0::DOUBLE / first, 0.0) END AS reciprocal_rank, CASE WHEN n1 > 0 THEN round(coalesce(dcg, 0.0) / ideal, 9) END AS ndcg,
 coalesce(cited, 0)::DOUBLE / num.n AS citation_precision, CASE WHEN n1 > 0 THEN coalesce(live_hit, false) END AS live_hit
 FROM samples CROSS JOIN st LEFT JOIN sizes USING (sample_id) LEFT JOIN m USING (strategy, sample_id) LEFT JOIN got USING (strategy, sample_id) LEFT JOIN num USING (strategy, sample_id) LEFT JOIN ideal USING (sample_id))"""
_MATCHES = f"""syms AS ({_SYMBOLS}), asked AS (SELECT strategy, sample_id, symbol FROM syms CROSS JOIN (SELECT DISTINCT strategy FROM results)),
matches AS (SELECT a.strategy, a.sample_id, count(*) AS n_symbols, count(*) FILTER (EXISTS (SELECT 1 FROM results r WHERE r.strategy = a.strategy AND r.sample_id = a.sample_id AND r.rank <= 5 AND (r.symbol = a.symbol OR ends_with(r.symbol, '.' || a.symbol)))) AS n_matched FROM asked a GROUP BY 1, 2)"""
_INPUTS = "WITH " + ctes(samples=SAMPLES, truth=TRUTH, results=RESULTS, predictions=PREDICTIONS)
_JUDGED = f"""{_INPUTS}, {_SCORED}, {_MATCHES}, routes AS (SELECT sample_id, answerable, wanted_reason, {_ROUTE} AS wanted FROM samples),
j AS (SELECT scored.*, answerable, wanted_reason, wanted, {_named('predictions.intent')} AS found, refused, oracle_route, found_reason, latency_ms, n_matched::DOUBLE / n_symbols AS symbol_recall
 FROM scored JOIN routes USING (sample_id) JOIN predictions USING (strategy, sample_id) LEFT JOIN matches USING (strategy, sample_id))"""
_C = "count(*) FILTER"
_SUMMARY = f"""summary AS (SELECT strategy, round(avg((wanted = found)::INT) FILTER (NOT oracle_route AND wanted <> ''), 9) AS routing_accuracy,
 {', '.join(f'round(coalesce(avg({c}), 0.0), 9) AS {c}' for c in ('primary_recall', 'hit', 'supporting_recall', 'ndcg', 'citation_precision', 'symbol_recall'))},
 round(coalesce(avg(live_hit::INT) FILTER (wanted IN ('implementation', 'comparison')), 0.0), 9) AS live_hit, round(coalesce(avg(reciprocal_rank), 0.0), 9) AS mrr,
 round(coalesce(tp::DOUBLE / nullif(un, 0), 0.0), 9) AS refusal_recall, round(coalesce(fp::DOUBLE / nullif(an, 0), 0.0), 9) AS answerable_refusal_rate, round(coalesce(tp::DOUBLE / nullif(tp + fp, 0), 0.0), 9) AS refusal_precision,
 round(coalesce(2.0::DOUBLE * tp / nullif(tp + fp + un, 0), 0.0), 9) AS refusal_f1, round(coalesce(ok::DOUBLE / nullif(tp, 0), 0.0), 9) AS refusal_reason_accuracy, round(coalesce(ok::DOUBLE / nullif(un, 0), 0.0), 9) AS refusal_reason_recall,
 round(coalesce(avg(latency_ms), 0.0), 9) AS mean_latency_ms, round(quantile_cont(latency_ms, 0.5), 6) AS p50_latency_ms, round(quantile_cont(latency_ms, 0.95), 6) AS p95_latency_ms, round(quantile_cont(latency_ms, 0.99), 6) AS p99_latency_ms,
 count(*) AS question_count, {_C} (NOT oracle_route AND wanted <> '') AS routing_eligible, count(primary_recall) AS file_eligible, count(symbol_recall) AS symbol_eligible, any_value(un) AS unanswerable_count
 FROM j JOIN (SELECT strategy, {_C} (NOT answerable AND refused) AS tp, {_C} (answerable AND refused) AS fp, {_C} (NOT answerable) AS un, {_C} (answerable) AS an, {_C} (NOT answerable AND refused AND wanted_reason = found_reason) AS ok FROM j GROUP BY 1) USING (strategy) GROUP BY strategy, tp, fp, un, an, ok)"""
SQL = {
    "source_keys": f"WITH {ctes(u=KEYS)} SELECT raw, {_key('raw')} AS source_key, CASE WHEN regexp_matches(trim(raw), '(?i)^https?://') THEN replace(trim(raw), '\\', '/') WHEN regexp_matches(replace(trim(raw), '\\', '/'), '^([A-Za-z]:)?/') THEN NULL ELSE replace(trim(raw), '\\', '/') END AS shown, {_match("'src/a7.py'", _key('raw'))} AS is_a7 FROM u",
    "route_labels": f"WITH {ctes(samples=SAMPLES)} SELECT sample_id, {_ROUTE} AS route FROM samples",
    "question_symbols": f"WITH {ctes(samples=SAMPLES)} {_SYMBOLS}",
    "scored_samples": f"{_INPUTS}, {_SCORED} SELECT * FROM scored",
    "symbol_matches": f"{_INPUTS}, {_MATCHES} SELECT * FROM matches",
    "strategy_summary": f"{_JUDGED}, {_SUMMARY} SELECT * FROM summary",
    "route_macro_f1": f"""{_JUDGED}, e AS (SELECT * FROM j WHERE NOT oracle_route AND wanted <> ''), l AS (SELECT DISTINCT strategy, wanted AS label FROM e),
f AS (SELECT l.strategy, label, 2.0::DOUBLE * {_C} (wanted = label AND found = label) / ({_C} (wanted = label) + {_C} (found = label)) AS f1 FROM l JOIN e ON e.strategy = l.strategy GROUP BY 1, 2) SELECT strategy, round(avg(f1), 9) AS routing_macro_f1 FROM f GROUP BY 1""",
    "strategy_deltas": f"{_JUDGED}, {_SUMMARY} SELECT s.strategy, s.hit, s.mrr, s.ndcg, s.refusal_f1, " + ", ".join(f"round(s.{m} - b.{m}, 9) AS delta_{m}" for m in ("hit", "mrr", "ndcg", "refusal_f1")) + " FROM summary s, summary b WHERE b.strategy = 'base'",
    "suite_contract": f"""WITH {ctes(runs=RUNS)}, c AS (SELECT count(DISTINCT build_id) - 1 AS build_id, count(DISTINCT embedding_model) - 1 AS embedding_model, count(DISTINCT top_k) - 1 AS top_k, count(DISTINCT n_questions) - 1 AS n_questions, {_C} (failed) AS failed, count(*) - count(DISTINCT strategy) AS strategy FROM runs)
SELECT "check", greatest(violations, 0) AS violations FROM (UNPIVOT c ON build_id, embedding_model, top_k, n_questions, failed, strategy INTO NAME "check" VALUE violations)""",
}
