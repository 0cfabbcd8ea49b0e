"""Queries of manifests, index rows, citations and artifacts; a manifest is derived from the documents."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import manifest
from .portable import ctes, table

SOURCES = """SELECT DISTINCT source AS source_id, CASE WHEN source IN ('src1', 'src2') THEN 'official_web' WHEN source = 'src9' THEN 'directory' ELSE 'git' END AS source_type, 'https://host/' || source AS uri, 'v' || substr(source, 4) AS version,
 CASE WHEN source > 'src3' THEN md5(source) END AS commit_sha, CASE WHEN source = 'src4' THEN 'history' ELSE '' END AS authority, CASE WHEN source = 'src5' THEN 'Partner' ELSE '' END AS corpus FROM {documents} WHERE source <> 'src7'"""
DOCUMENTS = """SELECT CASE WHEN doc_id % 97 = 0 THEN 0 ELSE doc_id END AS doc_id, source AS source_id, CASE doc_id % 7 WHEN 0 THEN 'src/Mod' || CAST(doc_id AS STRING) || '.PY' WHEN 1 THEN 'pkg/tests/t' || CAST(doc_id AS STRING) || '.py' WHEN 2 THEN 'docs/a' || CAST(doc_id % 5 AS STRING) || '.md'
 WHEN 3 THEN 'https://site/p' || CAST(doc_id AS STRING) WHEN 4 THEN 'web/test_x' || CAST(doc_id AS STRING) || '.js' WHEN 5 THEN 'notes#symbol:run' ELSE 'lib/x_test.py' END AS relative_path, 'title ' || CAST(doc_id AS STRING) AS title, md5(text) AS content_hash, lang AS kind,
 CASE WHEN doc_id % 11 = 0 THEN 'design' ELSE '' END AS authority, CASE WHEN doc_id % 13 = 0 THEN 'git_commit' ELSE '' END AS record_kind FROM {documents}"""
CHUNKS = """SELECT 'c' || CAST(doc_id AS STRING) || '-' || CAST(k AS STRING) AS chunk_id, doc_id, CASE WHEN doc_id % 101 = 0 THEN 'src2' ELSE source END AS source_id, CAST(k AS INT) AS ordinal, substr(text, 1 + k * 40, 40) AS content, CAST(doc_id % 4 AS STRING) AS line_start, CASE WHEN doc_id % 5 = 0 THEN 'x' ELSE CAST(doc_id % 9 AS STRING) END AS line_end,
 CASE WHEN doc_id % 6 = 0 THEN 'Cls.run' || CAST(k AS STRING) ELSE ' ' END AS symbol FROM {documents} CROSS JOIN (SELECT 0 AS k UNION ALL SELECT 1) AS ks"""
RESULTS = """SELECT doc_id % 40 AS qid, CAST(row_number() OVER (PARTITION BY doc_id % 40 ORDER BY doc_id) AS INT) AS rank, CASE WHEN doc_id % 3 = 0 THEN 'HTTPS://h/' || source ELSE 'a/' || source END AS source, CASE WHEN doc_id % 4 = 0 THEN 'official' ELSE 'internal' END AS corpus, CASE doc_id % 3 WHEN 0 THEN 'code' WHEN 1 THEN 'design' ELSE 'history' END AS authority,
 CASE WHEN doc_id % 5 = 0 THEN 'true' ELSE 'false' END AS live, CASE WHEN doc_id % 5 = 0 THEN 'p' || chr(92) || source END AS relative_path, CASE WHEN doc_id % 2 = 0 THEN md5(source) END AS sha, CASE WHEN doc_id % 7 = 0 THEN 'true' WHEN doc_id % 7 = 1 THEN 'false' END AS dirty FROM {documents}"""
QUERIES_IN = "SELECT conv_id * 100 + turn AS qid, CASE (conv_id + turn) % 6 WHEN 0 THEN '   ' WHEN 1 THEN NULL WHEN 2 THEN 'a' || chr(0) || 'b' WHEN 3 THEN repeat('x', 900 + CAST(turn * 40 AS INT)) ELSE ' ' || text || ' ' END AS query, CAST((conv_id * 7 + turn) % 60 AS INT) AS top_k FROM {conversations}"
LABELS = """SELECT item_id AS sample_id, item_id % 3 > 0 AS answerable, CASE WHEN item_id % 5 = 0 THEN '' ELSE 'a' || CAST(item_id % 2 AS STRING) END AS p, CASE WHEN item_id % 4 = 0 THEN 'a1' ELSE '' END AS s, CASE WHEN item_id % 7 = 0 THEN 'zz' END AS extra, CASE WHEN item_id % 2 = 0 THEN 'topic_not_indexed' END AS refusal_reason FROM {benchmark}"""
_MAP = lambda *names: F.map_filter(F.create_map(*(x for n in names for x in (F.lit(n), F.col(n)))), lambda k, v: v.isNotNull() & (v != ""))


def _manifest(spark, d):
    s = table(spark, d, SOURCES).withColumn("metadata", _MAP("authority", "corpus")).drop("authority", "corpus")
    docs = table(spark, d, DOCUMENTS).withColumn("metadata", _MAP("authority", "record_kind"))
    c = table(spark, d, CHUNKS).withColumn("metadata", _MAP("line_start", "line_end", "symbol"))
    return s, docs, c.select("chunk_id", "doc_id", "source_id", "ordinal", "content", "metadata")


def manifest_violations(spark, d):
    return manifest.violations(*_manifest(spark, d))


def _index(spark, d):
    s, docs, c = _manifest(spark, d)
    return manifest.index_rows(s, docs.where("doc_id > 0"), c)


def index_rows(spark, d):
    rows = _index(spark, d)
    return rows.select("chunk_id", "corpus", "authority", manifest.partition_name(F.col("corpus"), F.col("authority")).alias("folder"), "weight", "citation_source", "source_version", "source_commit_sha")


def result_rows(spark, d):
    return manifest.search_result(_index(spark, d)).select("chunk_id", "source", "line_start", "line_end", "symbol")


def index_partitions(spark, d):
    return manifest.partition_summary(_index(spark, d).withColumn("embedding", F.when(F.col("chunk_id") == "c2-0", F.array(F.lit(0.0))).otherwise(F.array(F.lit(0.0), F.lit(1.0)))))


def index_stats(spark, d):
    return manifest.store_stats(_index(spark, d))


def result_citations(spark, d):
    rows = table(spark, d, RESULTS).withColumns({"live_verification": F.col("live"), "source_commit_sha": F.col("sha"), "source_version": F.col("authority"), "source_dirty": F.col("dirty")})
    return manifest.citations(rows.withColumn("metadata", _MAP("live_verification", "relative_path", "source_commit_sha", "source_version", "source_dirty")))


def public_metadata(spark, d):
    rows = table(spark, d, RESULTS).withColumns({"source_version": F.col("authority"), "host_path": F.lit("/srv"), "git_commit_sha": F.col("sha")})
    shown = manifest.public(F.create_map(*(x for n in ("relative_path", "source_version", "host_path", "git_commit_sha") for x in (F.lit(n), F.col(n)))))
    return rows.select("qid", "rank", F.array_join(F.transform(F.array_sort(F.map_entries(shown)), lambda e: F.concat_ws("=", e["key"], e["value"])), ";").alias("shown"))


def query_validation(spark, d):
    return manifest.query_errors(table(spark, d, QUERIES_IN)).select("qid", F.coalesce("error", F.lit("ok")).alias("error"), F.length("query").alias("size"))


def prediction_fields(spark, d):
    rows = table(spark, d, RESULTS).select("qid", "rank", F.col("source").alias("page_content"), F.when(F.col("rank") % 2 == 0, F.col("corpus")).alias("intent"), F.col("authority").alias("route"))
    return manifest.coerced(rows, {"qid": ("qid",), "rank": ("rank",), "content": ("content", "page_content"), "predicted_intent": ("predicted_intent", "intent", "route")})


def _partitions(spark, d, build):
    rows = _index(spark, d).groupBy(F.concat_ws("/", "corpus", "authority").alias("partition")).agg(F.count(F.lit(1)).alias("rows"))
    return rows.withColumns({"dimension": F.lit(64), "build_id": F.lit(build), "owner": F.lit("team")})


def artifact_errors(spark, d):
    there = _partitions(spark, d, "b1").where("partition <> 'internal/test'")
    there = there.withColumn("rows", F.when(F.col("partition") == "internal/code", F.col("rows") + 1).otherwise(F.col("rows"))).withColumn("owner", F.when(F.col("partition") == "official/official", "other").otherwise(F.col("owner")))
    return manifest.artifact_errors(_partitions(spark, d, "b1"), there.withColumn("dimension", F.when(F.col("partition") == "official/official", 32).otherwise(F.col("dimension"))))


def artifact_names(spark, d):
    rows = table(spark, d, "SELECT DISTINCT source, lang FROM {documents}")
    return rows.select("source", "lang", manifest.artifact_name(F.lit("idx"), F.concat(F.lit("build-"), "source"), F.lit("t.1"), F.coalesce("lang", F.lit("né")), F.col("source")).alias("name"))


def stale_artifacts(spark, d):
    rows = table(spark, d, "SELECT 'a' || CAST(doc_id AS STRING) AS name, lang AS owner, source FROM {documents}")
    return manifest.stale(rows, rows.where("source in ('src1', 'src2', 'src3')"), "en")


def build_freshness(spark, d):
    docs = table(spark, d, DOCUMENTS)
    one = manifest.build_id(docs, "v1")
    return manifest.freshness(one, manifest.build_id(docs.repartition(7), "v1")).select("status").unionByName(manifest.freshness(one, manifest.build_id(docs, "v2")).select("status")).unionByName(
        manifest.freshness(one, manifest.build_id(docs.withColumn("content_hash", F.when(F.col("doc_id") == 1, "x").otherwise(F.col("content_hash"))), "v1")).select("status")
    )


def repeated_identities(spark, d):
    return manifest.repeated_identities(table(spark, d, DOCUMENTS).withColumn("identity", F.lit(None).cast("string")))


def source_summary(spark, d):
    return manifest.source_summary(table(spark, d, DOCUMENTS).withColumn("kind", F.coalesce("kind", F.lit("none"))))


def label_errors(spark, d):
    rows = table(spark, d, LABELS)
    full = lambda *cs: F.filter(F.array(*(F.col(c) for c in cs)), lambda x: x.isNotNull() & (x != ""))
    return manifest.label_errors(rows.select("sample_id", "answerable", full("p", "s", "extra").alias("relevant"), full("p").alias("primary"), full("s").alias("supporting"), "refusal_reason"))


QUERIES = {
    f.__name__: f
    for f in (manifest_violations, index_rows, result_rows, index_partitions, index_stats, result_citations, public_metadata, query_validation, prediction_fields, artifact_errors, artifact_names, stale_artifacts, build_freshness, repeated_identities, source_summary, label_errors)
}

_IN = "WITH " + ctes(s=SOURCES, dd=DOCUMENTS, c=CHUNKS)
_INDEX = f"""{_IN}, j AS (SELECT c.*, relative_path, title, uri, version, commit_sha, coalesce(nullif(dd.authority, ''), s.authority) AS auth, s.corpus AS corp, source_type, record_kind, lower(split_part(relative_path, '#', 1)) AS low FROM c JOIN dd ON dd.doc_id = c.doc_id AND dd.source_id = c.source_id JOIN s ON s.source_id = c.source_id WHERE dd.doc_id > 0),
k AS (SELECT *, source_type = 'official_web' OR lower(corp) = 'official' AS official FROM j),
i AS (SELECT *, CASE WHEN official THEN 'official' WHEN corp <> '' THEN lower(corp) ELSE 'internal' END AS corpus, CASE WHEN official THEN 'official' WHEN auth IN ('code', 'test', 'design', 'history') THEN auth WHEN record_kind = 'git_commit' THEN 'history'
 WHEN contains('/' || low, '/tests/') OR starts_with(split_part(low, '/', -1), 'test_') OR ends_with(low, '_test.py') THEN 'test' WHEN regexp_matches(low, '{manifest.CODE_SUFFIX}') OR contains(relative_path, '#symbol:') THEN 'code' ELSE 'design' END AS authority FROM k),
idx AS (SELECT *, CASE corpus || '/' || authority {' '.join(f"WHEN '{k}' THEN {w}" for k, w in manifest.WEIGHTS.items())} ELSE 1.0 END::DOUBLE AS weight, CASE WHEN corpus = 'official' AND NOT regexp_matches(relative_path, '^https?://') THEN uri ELSE relative_path END AS citation_source FROM i)"""
_PARTS = "parts AS (SELECT corpus || '/' || authority AS partition, count(*) AS rows FROM idx GROUP BY 1)"
_R = "WITH " + ctes(r=RESULTS)
SQL = {
    "manifest_violations": f"""{_IN}, v AS (SELECT 'repeated_source' AS violation, source_id AS id, count(*) AS n FROM s GROUP BY 2 HAVING count(*) > 1 UNION ALL SELECT 'repeated_document', doc_id::VARCHAR, count(*) FROM dd GROUP BY doc_id HAVING count(*) > 1 UNION ALL SELECT 'repeated_chunk', chunk_id, count(*) FROM c GROUP BY 2 HAVING count(*) > 1
UNION ALL SELECT 'document_without_source', doc_id::VARCHAR, count(*) FROM dd WHERE source_id NOT IN (SELECT source_id FROM s) GROUP BY doc_id UNION ALL SELECT 'chunk_without_document', chunk_id, count(*) FROM c WHERE doc_id NOT IN (SELECT doc_id FROM dd) GROUP BY 2
UNION ALL SELECT 'chunk_of_other_source', chunk_id, count(*) FROM c JOIN (SELECT DISTINCT doc_id, source_id AS o FROM dd) USING (doc_id) WHERE source_id <> o GROUP BY 2) SELECT * FROM v""",
    "index_rows": f"{_INDEX} SELECT chunk_id, corpus, authority, corpus || '__' || authority AS folder, weight, citation_source, version AS source_version, commit_sha AS source_commit_sha FROM idx",
    "result_rows": f"{_INDEX} SELECT chunk_id, citation_source AS source, CASE WHEN line_start::INTEGER >= 1 THEN line_start::INTEGER END AS line_start, CASE WHEN try_cast(line_end AS INTEGER) >= 1 THEN line_end::INTEGER END AS line_end, nullif(symbol, ' ') AS symbol FROM idx",
    "index_partitions": f"{_INDEX} SELECT corpus, authority, count(*) AS n, count(DISTINCT chunk_id = 'c2-0') AS dims, count(DISTINCT chunk_id = 'c2-0') = 1 AS ok FROM idx GROUP BY 1, 2",
    "index_stats": f"{_INDEX} SELECT count(*) AS num_entities, count(DISTINCT chunk_id) AS unique_chunk_ids, (SELECT string_agg(corpus, ',' ORDER BY corpus) FROM (SELECT DISTINCT corpus FROM idx)) AS corpora FROM idx",
    "result_citations": f"""{_R}, x AS (SELECT *, CASE WHEN live = 'true' THEN replace(relative_path, '\\', '/') ELSE source END AS shown FROM r) SELECT qid, rank, 'E' || rank AS citation_id, shown AS source,
 CASE WHEN live = 'true' THEN 'current_implementation' WHEN corpus = 'official' THEN 'external_normative' WHEN authority = 'design' THEN 'internal_design' WHEN authority = 'history' THEN 'internal_history' ELSE 'indexed_implementation' END AS evidence_role, coalesce(sha, authority) AS revision, NULL::VARCHAR AS branch, dirty = 'true' AS dirty, CASE WHEN regexp_matches(lower(shown), '^https?://') THEN shown END AS url, live = 'true' AS live_verified FROM x""",
    "public_metadata": f"{_R} SELECT qid, rank, concat_ws(';', 'git_commit_sha=' || sha, 'relative_path=' || relative_path, 'source_version=' || authority) AS shown FROM r",
    "query_validation": f"WITH {ctes(q=QUERIES_IN)} SELECT qid, CASE WHEN query IS NULL THEN 'query must be a string' WHEN trim(query) = '' THEN 'query is empty' WHEN length(trim(query)) > 1000 THEN 'query is too long' WHEN contains(query, chr(0)) THEN 'query has a NUL' WHEN top_k NOT BETWEEN 1 AND 50 THEN 'top_k must be between 1 and 50' ELSE 'ok' END AS error, length(trim(query)) AS size FROM q",
    "prediction_fields": f"{_R} SELECT qid, rank, source AS content, CASE WHEN rank % 2 = 0 THEN corpus ELSE authority END AS predicted_intent FROM r",
    "artifact_errors": f"{_INDEX}, {_PARTS} SELECT partition, unnest(CASE partition WHEN 'internal/test' THEN ['missing'] WHEN 'internal/code' THEN ['rows'] WHEN 'official/official' THEN ['dimension', 'owner'] ELSE [] END) AS error FROM parts",
    "artifact_names": "SELECT DISTINCT source, lang, 'idx_' || substr(sha256('build-' || source), 1, 12) || '_t_1_' || regexp_replace(coalesce(lang, 'né'), '[^A-Za-z0-9_]', '_', 'g') || '__' || source AS name FROM documents",
    "stale_artifacts": "SELECT 'a' || doc_id AS name, lang AS owner, source FROM documents WHERE lang = 'en' AND source NOT IN ('src1', 'src2', 'src3')",
    "build_freshness": "SELECT unnest(['ok', 'stale_index', 'stale_index']) AS status",
    "repeated_identities": f"{_IN} SELECT source_id, relative_path AS identity, count(*) AS n FROM dd GROUP BY 1, 2 HAVING count(*) > 1",
    "source_summary": f"{_IN} SELECT source_id, count(*) AS document_count, string_agg(DISTINCT coalesce(kind, 'none'), ',' ORDER BY coalesce(kind, 'none')) AS kinds FROM dd GROUP BY 1",
    "label_errors": f"""WITH {ctes(l=LABELS)}, x AS (SELECT *, list_filter([p], lambda v: v <> '') AS a, list_filter([s], lambda v: v <> '') AS b, list_filter([p, s, extra], lambda v: v <> '') AS r FROM l)
SELECT sample_id, unnest(list_filter([CASE WHEN len(list_intersect(a, b)) > 0 THEN 'source in both roles' END, CASE WHEN list_concat(a, b) <> r THEN 'relevant is not primary and supporting' END, CASE WHEN answerable AND len(r) = 0 THEN 'answerable without sources' END, CASE WHEN NOT answerable AND len(r) > 0 THEN 'unanswerable with sources' END, CASE WHEN answerable = (refusal_reason IS NOT NULL) THEN 'refusal reason' END], lambda v: v IS NOT NULL)) AS error FROM x""",
}
