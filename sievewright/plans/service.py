"""Queries of retrieval end to end: questions about passages, answered from the stored index and the current files."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import evidence, patterns, retrieve
from . import corpus, guarding, retrieval, sqltext
from .corpus import _t

K = 5
#: What a question about a passage begins with, by its number.
ASKS = (
    "Which function holds ", "Why does the design say ", "What does the official MCP specification say about ", "compare the current repo with the official MCP specification on ", "weather forecast for ",
    "which module names `{}` in ", None,
)
ALLOWED = r"\.(py|md)$"
SCOPE = (["mcp"], ["specification"])
_LONG = "[A-Za-z]{6,}"


def questions(spark, d):
    """(qid, query): a question for each passage, of every route; letters that are not ASCII are left out, one in seven is empty."""
    bare = F.regexp_replace("text", "[^ -~]", " ")
    n, word = F.col("item_id") % len(ASKS), F.regexp_extract(bare, _LONG, 0)
    heads = [(F.lit("") if a is None else F.concat(F.lit(a.split("{}")[0]), word, F.lit(a.split("{}")[1])) if "{}" in a else F.lit(a)) for a in ASKS]
    text = F.coalesce(*(F.when(n == i, head if ASKS[i] is None else F.concat(head, bare)) for i, head in enumerate(heads)))
    return _t(spark, d, "benchmark").select(F.col("item_id").alias("qid"), F.substring(text, 1, 1000).alias("query"))


def _files(spark, d):
    return retrieval.placed(spark, d).where("corpus = 'internal'").select("path", "text")


def retrieve_answers(spark, d):
    asked = questions(spark, d)
    asked = retrieval.hash_embedding(asked, "qid", "query", "vector", ("query",))
    rows = retrieve.retrieve(retrieval.index(spark, d), asked, _t(spark, d, "documents").select("doc_id", "text"), _files(spark, d), K, SCOPE, allowed=ALLOWED, build_id="documents")
    shown = F.transform("results", lambda r: F.concat_ws(" ", r["citation"], r["item"], r["role"], r["source"]))
    return rows.select("qid", "error", "intent", "rule", "sufficient", "refusal_reason", F.array_join("terms", "|").alias("terms"), F.array_join("warnings", ",").alias("warnings"), F.array_join(shown, "; ").alias("results"))


def term_search(spark, d):
    """The first lines of the documents that hold long words of the passages, a few a passage."""
    words = F.slice(F.array_distinct(F.regexp_extract_all(F.regexp_replace("text", "[^ -~]", " "), F.lit(_LONG), F.lit(0))), 1, 6)
    terms = _t(spark, d, "benchmark").select(F.col("item_id").alias("qid"), F.posexplode(words).alias("place", "term"))
    hits = patterns.query_hits(retrieval.placed(spark, d).select("path", "text"), terms, 20)
    return hits.select("qid", "term", "path", "line_no", "column", F.sha2("line", 256).alias("line_hash"), "rank")


def selected_evidence(spark, d):
    """The best documents of each passage, by their order, without those that repeat one kept before in their language."""
    docs = _t(spark, d, "documents").select("doc_id", "lang", "text")
    found = retrieval.bm25_topk(spark, d, k=8).join(docs, "doc_id")
    return evidence.selected(found, "qid", ["lang"], "text", "rank").select("qid", "doc_id", "rank", "place")


QUERIES = {f.__name__: f for f in (retrieve_answers, term_search, selected_evidence)}

_BARE = "regexp_replace(text, '[^ -~]', ' ', 'g')"
_QUERY = "CASE item_id % 7 " + " ".join(
    f"WHEN {i} THEN " + ("''" if a is None else f"'{a.split('{}')[0]}' || regexp_extract({_BARE}, '{_LONG}') || '{a.split('{}')[1]}' || {_BARE}" if "{}" in a else f"'{a}' || {_BARE}") for i, a in enumerate(ASKS)
) + " END"
_PART = "CASE WHEN source = 'src9' THEN 'official/official' WHEN lang IN ('es', 'de') THEN 'internal/test' WHEN lang = 'fr' THEN 'internal/code' ELSE 'internal/design' END"
_PATH = "source || CASE WHEN lang = 'es' THEN '/tests/' ELSE '/lib/' END || 'doc_' || doc_id || CASE lang WHEN 'fr' THEN '.py' WHEN 'de' THEN '_test.py' ELSE '.md' END"
_OFFICIAL = ("official", "official")
_WANTED = {
    "implementation": [("main", "internal/code"), ("main", "internal/test"), ("support", "internal/design"), ("support", "internal/history")], "design": [("main", "internal/design"), ("main", "internal/history"), ("support", "internal/code"), ("support", "internal/test")],
    "official": [("main", "official/official")], "comparison": [("main", f"internal/{a}") for a in ("code", "test", "design", "history")] + [("main", "official/official"), ("official", "official/official")],
}
_VALUES = ", ".join(f"('{i}', '{g}', '{p}')" for i, rows in _WANTED.items() for g, p in rows)
_WEIGHT = "CASE split_part(p, '/', 2) " + " ".join(f"WHEN '{a}' THEN {w}" for a, w in {"code": 1.35, "test": 1.2, "design": 1.0, "history": 0.8, "official": 0.9}.items()) + " ELSE 1.0 END"


def _rank(by: str, order: str, name: str = "rank") -> str:
    return f"row_number() OVER (PARTITION BY {by} ORDER BY {order})::INTEGER AS {name}"


def _fused(source: str, by: str) -> str:
    """SELECT of reciprocal-rank sums over lists (by, item, list_no, rank, w)."""
    return f"SELECT *, {_rank(by, 'fused DESC, first, item')} FROM (SELECT {by}, item, round(sum(w / (60 + rank)), 9) AS fused, min(list_no * 1000000 + rank) AS first FROM {source} GROUP BY {by}, item)"


_REASON = "CASE " + " ".join(f"WHEN {corpus._rule(r, 'qs.query')} THEN '{why}'" for r, why in corpus.routing.REASONS) + " ELSE 'outside_configured_corpus' END"
_ANCHORS = guarding._anchors(False).replace(" FROM q)", " FROM inq)").replace("n AS (SELECT qid, unnest(list_concat", "an AS (SELECT qid, unnest(list_concat").replace("FROM n WHERE", "FROM an WHERE")
_RETRIEVE = f"""WITH qs AS (SELECT item_id AS qid, trim(substr({_QUERY}, 1, 1000)) AS query FROM benchmark), asked AS (SELECT qid AS conv_id, 0 AS turn, query FROM qs WHERE query <> ''), {corpus._INTENT_OF},
it AS (SELECT conv_id AS qid, query, intent FROM i), inq AS (SELECT * FROM it WHERE intent <> 'out_of_scope'), wanted(intent, grp, p) AS (VALUES {_VALUES}), pq AS (SELECT qid, grp, p, CASE grp WHEN 'main' THEN 10 ELSE 5 END AS own FROM it JOIN wanted USING (intent)),
{sqltext.bm25(by=_PART, queries=('inq', 'qid', 'query'))}, {retrieval._hash_vectors('documents', 'doc_id', 'dv')}, {retrieval._hash_vectors('qs', 'qid', 'qv', 'query')},
lex AS (SELECT * FROM (SELECT qid, p, doc_id AS item, {_rank('qid, p', 'score DESC, doc_id')} FROM scored) WHERE rank <= 90),
den AS (SELECT * FROM (SELECT qid, p, doc_id AS item, {_rank('qid, p', 'score DESC, doc_id')} FROM (SELECT qid, {_PART} AS p, dv.doc_id, round(list_inner_product(dv.v, qv.v), 6) AS score FROM dv JOIN documents USING (doc_id), qv)) WHERE rank <= 90),
l1 AS (SELECT qid, grp, p, item, list_no, rank, 1.0::DOUBLE AS w FROM (SELECT *, 0 AS list_no FROM den UNION ALL SELECT *, 1 FROM lex) JOIN pq USING (qid, p) WHERE rank <= own * 9),
f1 AS (SELECT f.* FROM ({_fused('l1', 'qid, grp, p')}) f JOIN pq USING (qid, grp, p) WHERE rank <= own * 3),
l2 AS (SELECT qid, grp, item, dense_rank() OVER (PARTITION BY qid, grp ORDER BY p) AS list_no, rank, {_WEIGHT}::DOUBLE AS w FROM f1),
ix AS (SELECT f.qid, f.grp, 'doc:' || item AS item, f.rank, d.source, d.text AS content, {_PATH.replace('source', 'd.source').replace('lang', 'd.lang').replace('doc_id', 'd.doc_id')} AS path,
 CASE {_PART.replace('source', 'd.source').replace('lang', 'd.lang')} WHEN 'official/official' THEN 'external_normative' WHEN 'internal/design' THEN 'internal_design' ELSE 'indexed_implementation' END AS role
 FROM ({_fused('l2', 'qid, grp')}) f JOIN documents d ON d.doc_id = f.item WHERE f.rank <= CASE grp WHEN 'main' THEN 10 ELSE 5 END),
ps AS (SELECT qid, list_slice(list(path ORDER BY rank), 1, 5) AS paths FROM ix WHERE grp = 'main' GROUP BY 1),
dt0 AS (SELECT qid, list_concat(regexp_extract_all(query, '`([^`\\r\\n]{{1,128}})`', 1), regexp_extract_all(query, '\\b(?:[A-Za-z_][A-Za-z0-9_]*(?:\\.[A-Za-z_][A-Za-z0-9_]*)+|[A-Z][A-Za-z0-9_]{{2,}}|[a-z][a-z0-9]*_[a-z0-9_]+)\\b')) AS t,
 list_concat(regexp_extract_all(query, '\\b[A-Za-z][A-Za-z0-9_]{{5,}}\\b'), list_filter(list_transform(coalesce(paths, []), lambda x: regexp_replace(split_part(x, '/', -1), '\\.[^.]*$', '')), lambda x: length(x) >= 4)) AS w FROM it LEFT JOIN ps USING (qid) WHERE intent IN ('implementation', 'comparison')),
dt1 AS (SELECT qid, CASE WHEN len(t) > 0 THEN t ELSE w END AS l FROM dt0), dt2 AS (SELECT qid, unnest(l) AS x, generate_subscripts(l, 1) AS i FROM dt1), dt3 AS (SELECT qid, lower(x) AS lo, min(i) AS i, arg_min(x, i) AS x FROM dt2 WHERE lower(x) NOT IN {guarding._STOP} GROUP BY 1, 2),
te AS (SELECT qid, x AS term, row_number() OVER (PARTITION BY qid ORDER BY i) AS place FROM dt3), tt AS (SELECT * FROM te WHERE place <= 6),
fl AS (SELECT {_PATH} AS path, string_split(text, chr(10)) AS ls FROM documents WHERE source <> 'src9' AND text IS NOT NULL AND length(text) <= 1000000), li AS (SELECT path, unnest(ls) AS line, generate_subscripts(ls, 1) AS line_no FROM fl WHERE regexp_matches(path, '\\.(py|md)$')),
hs AS (SELECT * FROM (SELECT term, path, line_no, line, {_rank('term', 'path, line_no', 'n')} FROM (SELECT DISTINCT term FROM tt) JOIN li ON contains(line, term)) WHERE n <= 8),
hq AS (SELECT qid, path, line_no, any_value(line) AS line, min(place) AS place FROM tt JOIN hs USING (term) GROUP BY 1, 2, 3),
lv AS (SELECT * FROM (SELECT qid, 'live:' || path || ':' || line_no AS item, path || ':' || line_no AS source, line AS content, 'current_implementation' AS role, {_rank('qid', 'place, path, line_no')} FROM hq) WHERE rank <= 8),
jo AS (SELECT qid, item, role, source, content, row_number() OVER (PARTITION BY qid ORDER BY o, rank)::INTEGER AS rank FROM (SELECT *, 0 AS o FROM ix WHERE grp = 'main' UNION ALL SELECT *, 1 FROM ix a WHERE grp = 'official' AND NOT EXISTS (SELECT 1 FROM ix b WHERE b.grp = 'main' AND b.qid = a.qid AND b.item = a.item))),
l3 AS (SELECT qid, item, role, source, content, rank, 0 AS list_no, 2.0::DOUBLE AS w FROM lv UNION ALL SELECT qid, item, role, source, content, rank, 1, 1.0 FROM jo),
f3 AS (SELECT l3.*, f.rank AS fr, intent, CASE WHEN list_no = 0 THEN 0 WHEN role = 'external_normative' THEN 1 END AS side FROM l3 JOIN ({_fused('l3', 'qid')}) f USING (qid, item) JOIN it ON it.qid = l3.qid),
pk AS (SELECT *, intent = 'comparison' AND side IS NOT NULL AND row_number() OVER (PARTITION BY qid, side ORDER BY fr <= 5 DESC, CASE WHEN fr <= 5 THEN fr ELSE rank END) = 1 AS picked FROM f3),
re AS (SELECT * FROM (SELECT qid, item, role, source, content, {_rank('qid', 'CASE WHEN picked THEN side ELSE 2 END, fr', 'place')} FROM pk WHERE picked OR fr <= 5) WHERE place <= 5),
su AS (SELECT qid, item, role, source, content FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY rank, item) AS n FROM ix a WHERE grp = 'support' AND NOT EXISTS (SELECT 1 FROM re WHERE re.qid = a.qid AND re.item = a.item)) s WHERE n = 1 AND NOT EXISTS (SELECT 1 FROM re WHERE re.qid = s.qid AND re.role = s.role)),
fi AS (SELECT qid, item, role, source, content, {_rank('qid', 'place', 'place')} FROM (SELECT * FROM re WHERE place < 5 OR qid NOT IN (SELECT qid FROM su) UNION ALL SELECT qid, item, role, source, content, 6 FROM su)),
ag AS (SELECT qid, list(role) AS roles, string_agg('E' || place || ' ' || item || ' ' || role || ' ' || source, '; ' ORDER BY place) AS results FROM fi GROUP BY 1),
{_ANCHORS},
hy AS (SELECT inq.qid, query, intent, {', '.join(f"string_agg(CASE WHEN role IN ({roles}) THEN {sqltext.fold("source || chr(10) || chr(10) || content")} END, chr(10)) AS {name}" for name, roles in (('live', "'current_implementation'"), ('design', "'internal_design', 'internal_history'"), ('official', "'external_normative'")))},
 coalesce(bool_or(role = 'external_normative' AND contains(lower(query), 'mcp')), false) AS in_scope, coalesce(bool_or(role = 'external_normative' AND contains(lower(query), 'mcp') AND contains(lower(query), 'specification')), false) AS on_topic FROM inq LEFT JOIN fi USING (qid) GROUP BY 1, 2, 3),
hc AS (SELECT hy.qid, count(a) AS n, count(*) FILTER (contains(coalesce(live, ''), a)) AS in_live, count(*) FILTER (contains(coalesce(design, ''), a)) AS in_design, count(*) FILTER (contains(coalesce(official, ''), a)) AS in_official FROM hy LEFT JOIN anch USING (qid) GROUP BY 1),
vd AS (SELECT hy.qid, CASE {' '.join(f"WHEN regexp_matches(query, '(?i)(?:{pattern})') THEN '{code}'" for code, pattern in guarding.guards.UNSUPPORTED)} WHEN intent IN ('official', 'comparison') AND NOT in_scope THEN 'source_not_catalogued' WHEN intent IN ('official', 'comparison') AND NOT on_topic THEN 'topic_not_indexed'
 WHEN intent = 'official' AND in_official < n THEN 'source_not_catalogued' WHEN intent = 'design' AND in_design < n OR intent = 'implementation' AND in_live < n THEN 'unsupported_anchor' WHEN intent = 'comparison' AND in_live = 0 THEN 'missing_current_implementation_evidence' END AS verdict FROM hy JOIN hc USING (qid)),
ou AS (SELECT qs.qid, CASE WHEN qs.query = '' THEN 'query is empty' END AS error, intent, intent || '_rule' AS rule, coalesce(results, '') AS results,
 CASE WHEN qs.query = '' THEN NULL WHEN intent = 'out_of_scope' THEN {_REASON} ELSE coalesce(CASE
  WHEN intent = 'implementation' AND NOT list_contains(coalesce(roles, []), 'current_implementation') THEN 'missing_current_implementation_evidence' WHEN intent = 'design' AND NOT list_has_any(coalesce(roles, []), ['internal_design', 'internal_history']) THEN 'missing_internal_design_evidence'
  WHEN intent = 'official' AND NOT list_contains(coalesce(roles, []), 'external_normative') THEN 'missing_official_evidence' WHEN intent = 'comparison' AND NOT list_has_all(coalesce(roles, []), ['current_implementation', 'external_normative']) THEN 'missing_comparison_evidence' END, verdict) END AS refusal_reason
 FROM qs LEFT JOIN it USING (qid) LEFT JOIN ag USING (qid) LEFT JOIN vd USING (qid))
SELECT ou.qid, error, intent, rule, error IS NULL AND refusal_reason IS NULL AS sufficient, refusal_reason, coalesce(terms, '') AS terms, '' AS warnings, results FROM ou LEFT JOIN (SELECT qid, string_agg(term, '|' ORDER BY place) AS terms FROM tt GROUP BY 1) USING (qid)"""
_SHINGLES = corpus._SHINGLE
SQL = {
    "retrieve_answers": _RETRIEVE,
    "term_search": f"""WITH w AS (SELECT item_id AS qid, list_distinct(regexp_extract_all({_BARE}, '{_LONG}')) AS u, regexp_extract_all({_BARE}, '{_LONG}') AS l FROM benchmark), x AS (SELECT qid, unnest(l) AS term, generate_subscripts(l, 1) AS i FROM w),
y AS (SELECT qid, term, min(i) AS i FROM x GROUP BY 1, 2), t AS (SELECT * FROM (SELECT qid, term, row_number() OVER (PARTITION BY qid ORDER BY i) AS place FROM y) WHERE place <= 6),
fl AS (SELECT {_PATH} AS path, string_split(text, chr(10)) AS ls FROM documents WHERE text IS NOT NULL AND length(text) <= 1000000), li AS (SELECT path, unnest(ls) AS line, generate_subscripts(ls, 1) AS line_no FROM fl),
hs AS (SELECT * FROM (SELECT term, path, line_no, line, {_rank('term', 'path, line_no', 'n')} FROM (SELECT DISTINCT term FROM t) JOIN li ON contains(line, term)) WHERE n <= 20),
hq AS (SELECT qid, path, line_no, any_value(line) AS line, min(place) AS place FROM t JOIN hs USING (term) GROUP BY 1, 2, 3)
SELECT * FROM (SELECT qid, term, path, line_no::INTEGER AS line_no, instr(line, term)::INTEGER AS "column", sha256(line) AS line_hash, {_rank('qid', 'place, path, line_no')} FROM hq JOIN t USING (qid, place)) WHERE rank <= 20""",
    "selected_evidence": f"""WITH RECURSIVE {retrieval._BM25}, t8 AS ({corpus._TOP.format(k=8)}), n AS (SELECT qid, lang, doc_id, rank, {corpus._NORM} AS t FROM t8 JOIN documents USING (doc_id)),
s AS MATERIALIZED (SELECT *, CASE WHEN length(t) >= 7 THEN {_SHINGLES} WHEN t = '' THEN [] ELSE [t] END AS s FROM n),
near AS MATERIALIZED (SELECT a.qid, a.rank AS ra, b.rank AS rb FROM s a JOIN s b ON a.qid = b.qid AND a.lang IS NOT DISTINCT FROM b.lang AND a.rank < b.rank WHERE a.t = b.t OR (least(length(a.t), length(b.t)) > 0
 AND ((least(length(a.t), length(b.t)) >= 100 AND least(length(a.t), length(b.t)) >= 0.55 * greatest(length(a.t), length(b.t)) AND (contains(a.t, b.t) OR contains(b.t, a.t))) OR (least(length(a.t), length(b.t)) >= 80 AND len(list_intersect(a.s, b.s)) >= 0.82 * least(len(a.s), len(b.s)))))),
red AS MATERIALIZED (SELECT qid, rb AS rank, list(ra) AS earlier FROM near GROUP BY 1, 2), steps AS MATERIALIZED (SELECT qid, rank, coalesce(earlier, []) AS earlier FROM s LEFT JOIN red USING (qid, rank)),
fold AS (SELECT DISTINCT qid, 0::BIGINT AS rank, []::BIGINT[] AS kept FROM s UNION ALL SELECT fold.qid, steps.rank, CASE WHEN list_has_any(fold.kept, steps.earlier) THEN fold.kept ELSE list_append(fold.kept, steps.rank) END FROM fold JOIN steps ON steps.qid = fold.qid AND steps.rank = fold.rank + 1),
last AS (SELECT qid, max_by(kept, rank) AS kept FROM fold GROUP BY 1)
SELECT qid, doc_id, rank::INTEGER AS rank, list_position(kept, rank)::INTEGER AS place FROM s JOIN last USING (qid) WHERE list_contains(kept, rank)""",
}
