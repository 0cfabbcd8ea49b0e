"""Queries of ingestion, text, routing, evidence, evaluation, SQL and event operators."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions.text import canonical_url, redacted, tidy
from ..operators import evaluate, evidence, guards, ingest, routing, sqltool
from ..operators.common import top
from ..sources import html
from . import retrieval
from .sqltext import fold


def _t(spark, d, name):
    return spark.read.parquet(f"{d}/{name}.parquet")


def chunk_spans(spark, d):
    return ingest.chunks(_t(spark, d, "documents")).select("doc_id", "ordinal", "char_start", "char_end", "chunk_id", "line_start", "line_end", F.sha2("content", 256).alias("content_hash"))


def document_ids(spark, d):
    doc = ingest.hashed_id("doc_", 24, F.col("source"), F.col("doc_id"))
    return _t(spark, d, "documents").select("doc_id", doc.alias("stable_id"), F.sha2("text", 256).alias("content_hash"))


def _versions(spark, d):
    rows = _t(spark, d, "documents").select("doc_id", "source", F.sha2("text", 256).alias("rev"))
    current = rows.where("source <> 'src7'")
    previous = rows.where("source <> 'src3'").withColumn("rev", F.when(F.col("source") == "src5", F.sha2("rev", 256)).otherwise(F.col("rev")))
    return current, previous


def manifest_diff(spark, d):
    return ingest.diff(*_versions(spark, d), "doc_id", "rev")


def upsert_merge(spark, d):
    current, previous = _versions(spark, d)
    return ingest.upsert(previous, current, "doc_id", "rev")


def delete_by_ids(spark, d):
    gone = _t(spark, d, "labels").where("toxic = 1")
    return ingest.delete(_t(spark, d, "documents").select("doc_id", "lang", "source"), gone, "doc_id")


def dedupe_keep_last(spark, d):
    rows = _t(spark, d, "documents").select(F.sha2("text", 256).alias("content_hash"), "doc_id", "lang", "source")
    return ingest.keep_last(rows, ["content_hash"], "doc_id")


def source_hash(spark, d):
    return ingest.set_hash(_t(spark, d, "documents").select("source", F.sha2(F.concat_ws("\0", "doc_id", F.sha2("text", 256)), 256).alias("h")), ["source"], "h")


def _paths(spark, d):
    kind = F.when(F.col("lang") == "fr", ".py").when(F.col("lang") == "de", "_test.py").otherwise(".md")
    return _t(spark, d, "documents").select("doc_id", F.concat("source", F.when(F.col("lang") == "es", "/tests/").otherwise("/lib/"), F.lit("doc_"), "doc_id", kind).alias("path"), F.when(F.col("source") == "src9", "official_web").otherwise("directory").alias("source_type"))


def partition_infer(spark, d):
    corpus, authority = ingest.partition(F.col("source_type"), F.lit(None), F.lit(None), F.col("path"), F.lit(None))
    return _paths(spark, d).select("doc_id", corpus.alias("corpus"), authority.alias("authority"))


def partition_stats(spark, d):
    return partition_infer(spark, d).groupBy("corpus", "authority").agg(F.count(F.lit(1)).alias("n"), F.min("doc_id").alias("first_id"))


def text_normalize(spark, d):
    return _t(spark, d, "documents").select("doc_id", F.sha2(tidy(F.col("text")), 256).alias("tidy_hash"), F.length(tidy(F.col("text"))).alias("n_tidy"))


def url_canonical(spark, d):
    return _t(spark, d, "pages").select("page_id", canonical_url(F.col("url")).alias("canonical"))


def https_allowlist(spark, d):
    host = F.regexp_extract(canonical_url(F.col("url")), "^https://([^/?]*)", 1)
    return _t(spark, d, "pages").select("page_id", host.alias("host")).where(F.col("host").endswith(".example.org") | F.col("host").endswith(".example.com"))


def html_clean(spark, d):
    return html.cleaned(_t(spark, d, "pages"), "page_id", "html")


def enrich_metadata(spark, d):
    text = F.col("text")
    kind = F.when(text.contains("\n|") | text.contains(" | "), "table").when(text.contains("```"), "code").when(text.contains("!["), "image").otherwise("text")
    cjk = F.regexp_count(text, F.lit("[一-鿿]")) / F.greatest(F.length(F.trim(text)), F.lit(1))
    return _t(spark, d, "documents").select("doc_id", text.contains("```").alias("has_code"), kind.alias("chunk_type"), F.when(cjk > 0.1, "zh").otherwise("en").alias("language"))


def diagnostics_redacted(spark, d):
    cut, whole = redacted(F.col("text"), 400), redacted(F.col("text"), None)
    return _t(spark, d, "documents").select("doc_id", F.sha2(cut, 256).alias("redacted_hash"), F.sha2(whole, 256).alias("whole_hash"))


def live_grep(spark, d):
    return evidence.grep(_t(spark, d, "documents"), "doc_id", "text", "token = ").select("doc_id", "line_no", "column", F.length("line").alias("n_line"))


def _questions(spark, d):
    extra = [
        "Where is QueryEngine.submit_message implemented?", "Why was the architecture split?", "What does the official MCP specification say?", "weather forecast tomorrow", "compare the current repo with the official MCP spec",
        "production SLA numbers", "what is langchian", "exact cost of a call", "", "which file holds `load_checkpoint`",
    ]
    asked = spark.createDataFrame([(-k - 1, 0, q) for k, q in enumerate(extra)], "conv_id long, turn long, query string")
    return _t(spark, d, "conversations").where("role = 'user'").select("conv_id", "turn", F.col("text").alias("query")).unionByName(asked)


def intent_route(spark, d):
    rows = _questions(spark, d).withColumn("intent", routing.intent(F.col("query")))
    corpora, authorities, rule = routing.route(F.col("intent"))
    return rows.select("conv_id", "turn", "intent", F.array_join(corpora, ",").alias("corpora"), F.array_join(authorities, ",").alias("authorities"), rule.alias("rule"), routing.refusal_reason(F.col("query")).alias("reason"))


def verification_terms(spark, d):
    return _questions(spark, d).select("conv_id", "turn", F.array_join(guards.verification_terms(F.col("query"), F.array().cast("array<string>"), F.array().cast("array<string>")), ",").alias("terms"))


def evidence_contract(spark, d):
    docs = partition_infer(spark, d).select("doc_id", evidence.role(F.lit(False), F.col("corpus"), F.col("authority")).alias("role"))
    found = retrieval.bm25_topk(spark, d).join(docs, "doc_id").groupBy("qid").agg(F.collect_set("role").alias("roles"))
    return found.select("qid", F.array_join(F.array_sort("roles"), ",").alias("roles"), *(F.coalesce(evidence.contract(F.lit(i), F.col("roles")), F.lit("sufficient")).alias(i) for i in ("implementation", "design", "official", "comparison")))


def citation_check(spark, d):
    """Answers that cite the first results by number; every third conversation cites one that is not there."""
    rows = _t(spark, d, "conversations").where("role = 'assistant'")
    answer = F.concat(F.lit("see [E"), F.col("turn"), F.lit("] and [E"), F.col("turn") + 1, F.lit("], again [E"), F.col("turn"), F.lit("]"))
    kept, valid = evidence.citations(answer, F.array(*[F.lit(f"E{k}") for k in range(1, 6)]))
    return rows.select("conv_id", "turn", F.array_join(kept, ",").alias("cited"), valid.alias("valid"))


def context_budget(spark, d):
    rows = _t(spark, d, "documents").select("source", "doc_id", "text")
    kept = evidence.within_budget_blocked(rows, "source", "doc_id", F.floor(F.col("doc_id") / 1000), "text")
    return kept.select("source", "doc_id", F.col("used").cast("long").alias("used"))


def per_page_cap(spark, d):
    docs = _t(spark, d, "documents").select("doc_id", "source")
    return evidence.per_page(retrieval.bm25_topk(spark, d, k=10).join(docs, "doc_id"), "qid", "source", [F.asc("rank")]).select("qid", "doc_id", "source", "in_page")


def near_dup_pairs(spark, d):
    docs = _t(spark, d, "documents").select("doc_id", "lang", "text")
    found = retrieval.bm25_topk(spark, d).select("qid", "doc_id").join(docs, "doc_id")
    return evidence.near_duplicate_pairs(found, ["qid", "lang"], "doc_id", "text").select("qid", "a", "b")


def quality_scores(spark, d):
    """How well ``long enough and no table`` predicts the quality label, by language."""
    rows = _t(spark, d, "documents").join(_t(spark, d, "labels"), "doc_id")
    return evaluate.binary_scores(rows, F.col("quality") == 1, (F.col("n_chars") >= 100) & ~F.contains("text", F.lit("###")), ["lang"])


def macro_f1(spark, d):
    said = F.when(F.contains("text", F.lit(" und ")), "de").when(F.contains("text", F.lit(" the ")), "en").when(F.contains("text", F.lit(" les ")), "fr").otherwise("es")
    return evaluate.macro_f1(_t(spark, d, "documents").withColumn("said", said), "lang", "said")


def latency_percentiles(spark, d):
    return evaluate.percentiles(_t(spark, d, "events"), "value", ["event_type"])


def judge_coverage(spark, d):
    """Null is not 0: the mean over values that are there, the coverage over all."""
    rows = _t(spark, d, "documents").join(_t(spark, d, "labels"), "doc_id", "left").groupBy("source")
    return rows.agg(F.count(F.lit(1)).alias("eligible"), F.count("quality").alias("scored"), F.round(F.avg("quality"), 6).alias("mean_quality"), F.round(F.count("quality") / F.count(F.lit(1)), 6).alias("coverage"))


def stratified_sample(spark, d):
    return evaluate.stratified(_t(spark, d, "documents"), "lang", "doc_id", 40, "seed-1")


def normalized_dupes(spark, d):
    bare = F.regexp_replace(F.replace(F.lower("text"), F.lit("ß"), F.lit("ss")), r"[\p{P}\p{Z}\n]", "")
    return ingest.duplicates(_t(spark, d, "documents").select(F.sha2(bare, 256).alias("h")), ["h"])


def profile_grid(spark, d):
    grid = spark.createDataFrame([(x,) for x in (0.5, 1.0, 2.0)], "dense_w double").crossJoin(F.broadcast(spark.createDataFrame([(x,) for x in (0.5, 1.0)], "bm25_w double"))).crossJoin(F.broadcast(spark.createDataFrame([(2,), (3,)], "factor int")))  # three short lists of settings
    return grid.withColumn("name", F.concat_ws("-", F.lit("d"), F.col("dense_w").cast("decimal(3,1)"), F.lit("b"), F.col("bm25_w").cast("decimal(3,1)"), F.lit("x"), "factor"))


_SQLS = {
    "text2sql_join": "SELECT n_name, count(*) AS n_orders, round(sum(o_totalprice), 2) AS total FROM customer JOIN orders ON o_custkey = c_custkey JOIN nation ON n_nationkey = c_nationkey GROUP BY n_name",
    "text2sql_rollup": "SELECT l_returnflag, l_linestatus, count(*) AS n, round(sum(l_quantity), 2) AS qty FROM lineitem GROUP BY ROLLUP (l_returnflag, l_linestatus)",
    "text2sql_cube": "SELECT p_brand, p_size, count(*) AS n FROM part GROUP BY CUBE (p_brand, p_size)",
    "text2sql_window": "SELECT * FROM (SELECT o_custkey, o_orderkey, CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS BIGINT) AS place FROM orders) AS t WHERE place <= 3",
    "text2sql_anti": "SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey)",
    "text2sql_setops": "SELECT c_nationkey AS k FROM customer INTERSECT SELECT s_nationkey FROM supplier",
}


def _sql_query(sql):
    tables = ["customer", "orders", "nation", "lineitem", "part", "supplier"]

    def run(spark, d):
        sqltool.register(spark, d, [t for t in tables if t in sql])
        return sqltool.execute(spark, sql)

    return run


def sql_row_render(spark, d):
    rows = _t(spark, d, "nation").select("n_nationkey", "n_name", "n_regionkey")
    return rows.select("n_nationkey", sqltool.rendered(rows))


def model_lookup(spark, d):
    return sqltool.lookup(_t(spark, d, "part"), "p_name", "a", "p_type", "e").select("p_partkey", "p_name")


def metadata_filter(spark, d):
    rows = _t(spark, d, "documents")
    return rows.where(sqltool.matches("lang == en and source == 'src4' and ignored", rows.columns)).select("doc_id")


def events_json(spark, d):
    return _t(spark, d, "events").groupBy(F.get_json_object("props", "$.k").cast("int").alias("k")).agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 4).alias("total"))


def events_tumbling(spark, d):
    rows = _t(spark, d, "events").groupBy(F.window("ts", "1 hour"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 4).alias("total"))
    return rows.select(F.col("window.start").cast("string").alias("hour"), "event_type", "n", "total")


def events_session(spark, d):
    """Sessions of a user with gaps of under 30 minutes."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    ts = F.col("ts").cast("timestamp")
    gap = F.lag(ts).over(w)
    new = F.when(gap.isNull() | (F.unix_micros(ts) - F.unix_micros(gap) >= 1_800_000_000), 1).otherwise(0)
    rows = _t(spark, d, "events").withColumn("new", new).withColumn("session", F.sum("new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return rows.groupBy("user_id", "session").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 4).alias("total"))


_PLAIN = (chunk_spans, document_ids, manifest_diff, upsert_merge, delete_by_ids, dedupe_keep_last, source_hash, partition_infer, partition_stats, text_normalize, url_canonical, https_allowlist, html_clean, enrich_metadata, diagnostics_redacted, live_grep, intent_route, verification_terms, evidence_contract, citation_check, context_budget, per_page_cap, near_dup_pairs, quality_scores, macro_f1, latency_percentiles, judge_coverage, stratified_sample, normalized_dupes, profile_grid, sql_row_render, model_lookup, metadata_filter, events_json, events_tumbling, events_session)
QUERIES = {f.__name__: f for f in _PLAIN} | {name: _sql_query(sql) for name, sql in _SQLS.items()}

_VERSIONS = """cur AS (SELECT doc_id, source, sha256(text) AS rev FROM documents WHERE source <> 'src7'),
prev AS (SELECT doc_id, source, CASE WHEN source = 'src5' THEN sha256(sha256(text)) ELSE sha256(text) END AS rev FROM documents WHERE source <> 'src3')"""
_PART = """paths AS (SELECT doc_id, CASE WHEN source = 'src9' THEN 'official' ELSE 'internal' END AS corpus,
 CASE WHEN source = 'src9' THEN 'official' WHEN lang IN ('es', 'de') THEN 'test' WHEN lang = 'fr' THEN 'code' ELSE 'design' END AS authority FROM documents)"""
_TIDY = "regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(text, '\\r\\n?', '\\n', 'g'), '[ \\t\\f\\x0b\\x{00a0}]+', ' ', 'g'), ' ?\\n ?', '\\n', 'g'), '\\n{3,}', '\\n\\n', 'g'), '^[ \\n]+|[ \\n]+$', '', 'g')".replace("'\\n'", "chr(10)").replace("'\\n\\n'", "chr(10) || chr(10)")
_URL = """u AS (SELECT page_id, regexp_replace(trim(url), '#.*$', '') AS b FROM pages),
v AS (SELECT page_id, lower(regexp_extract(b, '^([A-Za-z][A-Za-z0-9+.-]*)://', 1)) AS scheme, lower(regexp_extract(b, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?]*)', 1)) AS h0, regexp_extract(b, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?]*(.*)$', 1) AS rest FROM u),
c AS (SELECT page_id, scheme, CASE WHEN scheme = 'https' THEN regexp_replace(h0, ':443$', '') ELSE h0 END AS host, CASE WHEN rest = '' OR starts_with(rest, '?') THEN '/' || rest ELSE rest END AS path FROM v)"""


def _rule(name, text="x"):
    return f"regexp_matches({text}, '(?i)(?:{routing.RULES[name]})')".replace("''", "'")


_ASKED = """asked AS (SELECT conv_id, turn, text AS query FROM conversations WHERE role = 'user' UNION ALL SELECT * FROM (VALUES
(-1, 0, 'Where is QueryEngine.submit_message implemented?'), (-2, 0, 'Why was the architecture split?'), (-3, 0, 'What does the official MCP specification say?'), (-4, 0, 'weather forecast tomorrow'), (-5, 0, 'compare the current repo with the official MCP spec'),
(-6, 0, 'production SLA numbers'), (-7, 0, 'what is langchian'), (-8, 0, 'exact cost of a call'), (-9, 0, ''), (-10, 0, 'which file holds `load_checkpoint`')) t(a, b, q))"""
_X = "CASE WHEN query = 'what is langchian' THEN 'what is LangChain' ELSE trim(query) END"
_INTENT_OF = f"""n AS (SELECT conv_id, turn, query, {_X} AS x FROM asked),
f AS (SELECT *, {', '.join(f'{_rule(r)} AS r_{r}' for r in routing.RULES)}, regexp_matches(x, '{routing.IDENTIFIER}') AS r_id FROM n),
g AS (SELECT *, r_project OR r_internal_topic AS hint, r_official_signal OR (r_official_topic AND NOT r_internal) AS off FROM f),
h AS (SELECT *, r_internal OR (r_internal_topic AND NOT off) AS own FROM g),
i AS (SELECT *, CASE WHEN x = '' OR r_out_of_scope OR r_private_claim OR r_future_claim OR r_dynamic_cost OR r_dynamic_external OR ((r_telemetry OR r_external_scope) AND NOT hint) THEN 'out_of_scope'
 WHEN r_official_signal AND NOT r_official_topic AND NOT own THEN 'out_of_scope' WHEN r_comparison AND own AND off THEN 'comparison' WHEN off AND NOT own THEN 'official'
 WHEN (r_id OR r_artifact) AND NOT r_design_override THEN 'implementation' WHEN r_design_override OR r_strong_design THEN 'design' WHEN r_official_signal AND r_official_topic AND own THEN 'comparison'
 WHEN r_implementation OR own THEN 'implementation' ELSE 'design' END AS intent FROM h)"""
_INTENT = f"{_ASKED}, {_INTENT_OF}"
_ROUTES = "(VALUES " + ", ".join(f"('{k}', '{c}', '{a}')" for k, (c, a) in routing.ROUTES.items()) + ") r(name, corpora, authorities)"
_TOP = "SELECT * FROM (SELECT qid, doc_id, score, row_number() OVER (PARTITION BY qid ORDER BY score DESC, doc_id) AS rank FROM scored) WHERE rank <= {k}"
_BM25 = retrieval._BM25
_NORM = f"regexp_replace({fold('text')}, '\\s+', '', 'g')"
_SHINGLE = "list_distinct(list_transform(range(1, length(t) - 5), lambda i: substr(t, i, 7)))"

_REDACTED = "text"
for _pattern, _to in (
    ("(?i)\\b(api[_-]?key|token|secret|password|authorization)(\\s*[=:]\\s*)(?:bearer\\s+)?[\"'']?[^\\s\"'',;]+[\"'']?", "\\1\\2[redacted]"),
    ("(?i)\\bbearer\\s+[A-Za-z0-9._~+/=-]+", "Bearer [redacted]"),
    ("\\b(?:sk-[A-Za-z0-9_-]{8,}|gh[opsur]_[A-Za-z0-9]{8,})", "[redacted]"),
    ("(?:/home/|/Users/|[A-Za-z]:\\\\Users\\\\)[^\\s/\\\\]+", "[home]"),
):
    _REDACTED = f"regexp_replace({_REDACTED}, '{_pattern}', '{_to}', 'g')"
SQL = {
    "chunk_spans": f"""WITH RECURSIVE d AS (SELECT doc_id, text, length(text) AS n FROM documents WHERE trim(text, ' ' || chr(10)) <> ''),
c AS (SELECT doc_id, n, text, 0::BIGINT AS ordinal, 0::BIGINT AS s, ({{FIRST}})::BIGINT AS e FROM d
  UNION ALL SELECT doc_id, n, text, ordinal, s, ({{END}})::BIGINT AS e FROM (SELECT doc_id, n, text, ordinal + 1 AS ordinal, CASE WHEN e - 120 > s THEN e - 120 ELSE e END AS s FROM c WHERE e < n))
SELECT doc_id, ordinal::INTEGER AS ordinal, s::INTEGER AS char_start, e::INTEGER AS char_end, 'chunk_' || substr(sha256(doc_id || chr(0) || ordinal || chr(0) || '{ingest.CHUNKER}'), 1, 24) AS chunk_id,
 (length(substr(text, 1, s)) - length(replace(substr(text, 1, s), chr(10), '')) + 1)::INTEGER AS line_start, (length(substr(text, 1, e)) - length(replace(substr(text, 1, e), chr(10), '')) + 1)::INTEGER AS line_end, sha256(substr(text, s + 1, e - s)) AS content_hash FROM c""",
    "document_ids": "SELECT doc_id, 'doc_' || substr(sha256(source || chr(0) || doc_id), 1, 24) AS stable_id, sha256(text) AS content_hash FROM documents",
    "manifest_diff": f"WITH {_VERSIONS} SELECT * FROM (SELECT doc_id, CASE WHEN prev.rev IS NULL THEN 'added' WHEN cur.rev IS NULL THEN 'deleted' WHEN cur.rev <> prev.rev THEN 'modified' END AS change FROM cur FULL JOIN prev USING (doc_id)) WHERE change IS NOT NULL",
    "upsert_merge": f"WITH {_VERSIONS} SELECT doc_id, coalesce(cur.source, prev.source) AS source, coalesce(cur.rev, prev.rev) AS rev, CASE WHEN prev.rev IS NULL THEN 'added' WHEN cur.rev IS NULL THEN 'kept' WHEN cur.rev = prev.rev THEN 'skipped' ELSE 'updated' END AS outcome FROM cur FULL JOIN prev USING (doc_id)",
    "delete_by_ids": "SELECT doc_id, lang, source FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE toxic = 1)",
    "dedupe_keep_last": "SELECT sha256(text) AS content_hash, min(doc_id) AS first_position, max_by(lang, doc_id) AS lang, max_by(source, doc_id) AS source, count(*) AS n FROM documents GROUP BY 1",
    "diagnostics_redacted": f"SELECT doc_id, sha256(substr({_REDACTED}, 1, 400)) AS redacted_hash, sha256({_REDACTED}) AS whole_hash FROM documents",
    "source_hash": "WITH h AS (SELECT source, sha256(doc_id || chr(0) || sha256(text)) AS h FROM documents), x AS (SELECT source, count(*) AS n, " + ", ".join(f"sum(('0x' || substr(h, {15 * k + 1}, 15))::BIGINT)::VARCHAR AS x{k}" for k in range(4)) + " FROM h GROUP BY 1) SELECT source, n, sha256(concat_ws(':', n, x0, x1, x2, x3)) AS set_hash FROM x",
    "partition_infer": f"WITH {_PART} SELECT * FROM paths",
    "partition_stats": f"WITH {_PART} SELECT corpus, authority, count(*) AS n, min(doc_id) AS first_id FROM paths GROUP BY 1, 2",
    "text_normalize": f"SELECT doc_id, sha256({_TIDY}) AS tidy_hash, length({_TIDY})::INTEGER AS n_tidy FROM documents",
    "url_canonical": f"WITH {_URL} SELECT page_id, scheme || '://' || host || path AS canonical FROM c",
    "https_allowlist": f"WITH {_URL} SELECT page_id, host FROM c WHERE scheme = 'https' AND (ends_with(host, '.example.org') OR ends_with(host, '.example.com'))",
    "enrich_metadata": "SELECT doc_id, contains(text, '```') AS has_code, CASE WHEN contains(text, chr(10) || '|') OR contains(text, ' | ') THEN 'table' WHEN contains(text, '```') THEN 'code' WHEN contains(text, '![') THEN 'image' ELSE 'text' END AS chunk_type, CASE WHEN len(regexp_extract_all(text, '[一-鿿]')) / greatest(length(trim(text)), 1) > 0.1 THEN 'zh' ELSE 'en' END AS language FROM documents",
    "live_grep": "WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS line_no FROM documents) SELECT doc_id, line_no::INTEGER AS line_no, instr(line, 'token = ')::INTEGER AS \"column\", length(line)::INTEGER AS n_line FROM l WHERE contains(line, 'token = ')",
    "intent_route": f"WITH {_INTENT} SELECT conv_id, turn, intent, corpora, authorities, intent || '_rule' AS rule, CASE " + " ".join(f"WHEN {_rule(r, 'query')} THEN '{why}'" for r, why in routing.REASONS) + f" ELSE 'outside_configured_corpus' END AS reason FROM i JOIN {_ROUTES} ON name = intent",
    "evidence_contract": f"WITH {_BM25}, t AS ({_TOP.format(k=5)}), {_PART}, r AS (SELECT DISTINCT qid, CASE WHEN corpus = 'official' THEN 'external_normative' WHEN authority = 'design' THEN 'internal_design' ELSE 'indexed_implementation' END AS role FROM t JOIN paths USING (doc_id)), a AS (SELECT qid, list_sort(list(role)) AS roles FROM r GROUP BY 1) SELECT qid, array_to_string(roles, ',') AS roles, 'missing_current_implementation_evidence' AS implementation, CASE WHEN list_contains(roles, 'internal_design') THEN 'sufficient' ELSE 'missing_internal_design_evidence' END AS design, CASE WHEN list_contains(roles, 'external_normative') THEN 'sufficient' ELSE 'missing_official_evidence' END AS official, 'missing_comparison_evidence' AS comparison FROM a",
    "citation_check": "SELECT conv_id, turn, concat_ws(',', CASE WHEN turn BETWEEN 1 AND 5 THEN 'E' || turn END, CASE WHEN turn BETWEEN 0 AND 4 THEN 'E' || (turn + 1) END) AS cited, turn BETWEEN 1 AND 4 AS valid FROM conversations WHERE role = 'assistant'",
    "context_budget": "WITH r AS (SELECT source, doc_id, least(length(text), 3500) AS n, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS rank FROM documents), b AS (SELECT *, coalesce(sum(n) OVER (PARTITION BY source ORDER BY rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS before FROM r) SELECT source, doc_id, least(n, 16000 - before) AS used FROM b WHERE before < 16000",
    "per_page_cap": f"WITH {_BM25}, t AS ({_TOP.format(k=10)}) SELECT * FROM (SELECT qid, doc_id, source, row_number() OVER (PARTITION BY qid, source ORDER BY rank)::INTEGER AS in_page FROM t JOIN documents USING (doc_id)) WHERE in_page <= 2",
    "near_dup_pairs": f"""WITH {_BM25}, t5 AS ({_TOP.format(k=5)}), n AS (SELECT qid, lang, doc_id, {_NORM} AS t FROM t5 JOIN documents USING (doc_id)),
s AS (SELECT *, CASE WHEN length(t) >= 7 THEN {_SHINGLE} WHEN t = '' THEN [] ELSE [t] END AS s FROM n)
SELECT a.qid, a.doc_id AS a, b.doc_id AS b FROM s a JOIN s b ON a.qid = b.qid AND a.lang = b.lang AND a.doc_id < b.doc_id
WHERE a.t = b.t OR (least(length(a.t), length(b.t)) >= 100 AND least(length(a.t), length(b.t)) >= 0.55 * greatest(length(a.t), length(b.t)) AND (contains(a.t, b.t) OR contains(b.t, a.t)))
 OR (least(length(a.t), length(b.t)) >= 80 AND len(list_intersect(a.s, b.s)) >= 0.82 * least(len(a.s), len(b.s)))""",
    "quality_scores": "WITH c AS (SELECT lang, count(*) FILTER (quality = 1 AND p) AS tp, count(*) FILTER (quality <> 1 AND p) AS fp, count(*) FILTER (quality = 1 AND NOT p) AS fn FROM (SELECT lang, quality, n_chars >= 100 AND NOT contains(text, '###') AS p FROM documents JOIN labels USING (doc_id)) GROUP BY 1) SELECT lang, tp, fp, fn, round(coalesce(tp::DOUBLE / nullif(tp + fp, 0), 0), 9) AS precision, round(coalesce(tp::DOUBLE / nullif(tp + fn, 0), 0), 9) AS recall, round(coalesce(2.0::DOUBLE * tp / nullif(2 * tp + fp + fn, 0), 0), 9) AS f1 FROM c",
    "macro_f1": "WITH p AS (SELECT lang AS t, CASE WHEN contains(text, ' und ') THEN 'de' WHEN contains(text, ' the ') THEN 'en' WHEN contains(text, ' les ') THEN 'fr' ELSE 'es' END AS s FROM documents WHERE lang IS NOT NULL), o AS (SELECT t AS label, count(*) AS expected, count(*) FILTER (t = s) AS tp FROM p GROUP BY 1), q AS (SELECT s AS label, count(*) AS predicted FROM p GROUP BY 1) SELECT count(*) AS n_labels, round(avg(2.0::DOUBLE * tp / (expected + coalesce(predicted, 0))), 9) AS macro_f1 FROM o LEFT JOIN q USING (label)",
    "latency_percentiles": "SELECT event_type, count(value) AS n, round(avg(value), 6) AS mean, " + ", ".join(f"round(quantile_cont(value, {q}), 6) AS p{int(q * 100)}" for q in (0.5, 0.95, 0.99)) + " FROM events GROUP BY 1",
    "judge_coverage": "SELECT source, count(*) AS eligible, count(quality) AS scored, round(avg(quality), 6) AS mean_quality, round(count(quality)::DOUBLE / count(*), 6) AS coverage FROM documents LEFT JOIN labels USING (doc_id) GROUP BY 1",
    "stratified_sample": "SELECT lang, doc_id, turn FROM (SELECT lang, doc_id, row_number() OVER (PARTITION BY lang ORDER BY sha256('seed-1' || chr(0) || doc_id), doc_id)::INTEGER AS turn FROM documents) ORDER BY turn, lang LIMIT 40",
    "normalized_dupes": f"SELECT sha256(regexp_replace({fold('text')}, '[\\pP\\pZ\\n]', '', 'g')) AS h, count(*) AS n FROM documents GROUP BY 1 HAVING count(*) > 1",
    "profile_grid": "SELECT d::DOUBLE AS dense_w, b::DOUBLE AS bm25_w, f AS factor, 'd-' || d || '-b-' || b || '-x-' || f AS name FROM (VALUES (0.5), (1.0), (2.0)) x(d), (VALUES (0.5), (1.0)) y(b), (VALUES (2), (3)) z(f)",
    "sql_row_render": "SELECT n_nationkey, 'n_nationkey: ' || n_nationkey || ' | n_name: ' || n_name || ' | n_regionkey: ' || n_regionkey AS row_text FROM nation",
    "model_lookup": "SELECT p_partkey, p_name FROM part WHERE p_name ILIKE '%a%' AND p_type ILIKE '%e%'",
    "metadata_filter": "SELECT doc_id FROM documents WHERE lang = 'en' AND source = 'src4'",
    "events_json": "SELECT json_extract_string(props, '$.k')::INTEGER AS k, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1",
    "events_tumbling": "SELECT strftime(date_trunc('hour', ts), '%Y-%m-%d %H:%M:%S') AS hour, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2",
    "events_session": "WITH g AS (SELECT *, CASE WHEN lag(ts) OVER w IS NULL OR epoch_us(ts) - epoch_us(lag(ts) OVER w) >= 1800000000 THEN 1 ELSE 0 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)), s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS session FROM g) SELECT user_id, session::BIGINT AS session, count(*) AS n, round(sum(value), 4) AS total FROM s GROUP BY 1, 2",
} | _SQLS
# where a chunk from s ends: after the last break of its second half, by paragraph, line, word; positions by reversed search
_HALF = "substr(text, s + 601, 600)"
_LAST = lambda mark, n: f"CASE WHEN contains({_HALF}, {mark}) THEN s + 600 + length({_HALF}) - instr(reverse({_HALF}), {mark}) + 1 END"
_END = f"CASE WHEN n - s <= 1200 THEN n ELSE coalesce({_LAST('chr(10) || chr(10)', 2)}, {_LAST('chr(10)', 1)}, {_LAST(chr(39) + ' ' + chr(39), 1)}, s + 1200) END"
SQL["chunk_spans"] = SQL["chunk_spans"].replace("{FIRST}", _END.replace("s + ", "0 + ").replace("n - s", "n - 0")).replace("{END}", _END)
