"""Queries of file types, loaders and chunkers."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import chunkers
from ..sources import files, units
from .portable import ctes, table

PATHS = """SELECT doc_id, CASE doc_id % 14 WHEN 0 THEN 'src/a' WHEN 1 THEN 'Node_Modules/x' WHEN 2 THEN 'docs/b' WHEN 3 THEN '.cache/c' WHEN 4 THEN 'conf/token' WHEN 5 THEN 'k/.env.' || source WHEN 6 THEN '../up' WHEN 7 THEN 'Dist/y' WHEN 8 THEN 'x/Credentials' WHEN 9 THEN 'Makefile' ELSE 'm/' || source END
 || CASE WHEN doc_id % 14 = 9 THEN '' ELSE CASE doc_id % 11 WHEN 0 THEN '.py' WHEN 1 THEN '.MD' WHEN 2 THEN '.json' WHEN 3 THEN '.hpp' WHEN 4 THEN '.PEM' WHEN 5 THEN '.yaml' WHEN 6 THEN '.csv' WHEN 7 THEN '.sql' WHEN 8 THEN '.bin' WHEN 9 THEN '.markdown' ELSE '' END END AS path,
 CASE doc_id % 5 WHEN 0 THEN 'Text/Plain; charset=x' WHEN 1 THEN 'application/x-thing' WHEN 2 THEN 'text/csv' END AS mime, CASE doc_id % 9 WHEN 0 THEN ' Excel ' WHEN 1 THEN 'nope' END AS given FROM {documents}"""
MARKDOWN = """SELECT doc_id, 'intro of ' || source || chr(10) || '# ' || source || chr(10) || 'one' || chr(10) || CASE WHEN doc_id % 3 = 0 THEN '## sec ' || lang || '  ' || chr(10) || 'two' || chr(10) || chr(10) || '### deep' || chr(10) || 'three' || chr(10) ELSE '' END
 || CASE WHEN doc_id % 4 = 0 THEN '```' || chr(10) || '# no heading' || chr(10) || '```' || chr(10) ELSE '' END || '#### four' || chr(10) || '# again' || chr(10) || '   ' || chr(10) || CASE WHEN doc_id % 2 = 0 THEN 'last' || chr(10) || '### skip' || chr(10) || 'end' ELSE '' END AS text FROM {documents} WHERE lang IS NOT NULL"""
LAYOUTS = """SELECT CAST(doc_id AS STRING) || '_content_list.json' AS artifact, '[{"type":"text","page_idx":' || CAST(doc_id % 3 AS STRING) || ',"text":" head "},{"type":"Table","page_idx":0,"table_caption":["cap"],"table_body":"<table>x</table>"},{"type":"table","page_idx":0,"table_id":"bad id","markdown":"|a|"},{"type":"text","text":""},{"category":"list","page_number":4,"block_id":"b1","content":"' || source || '","text":"t"},{"category":"list","page_number":4,"block_id":"b1","content":"other","text":"t"},{"category":"list","page_number":4,"block_id":"b1","content":"other","text":"t"}]' AS json FROM {documents}"""


def path_kinds(spark, d):
    rows = table(spark, d, PATHS)
    return rows.select("doc_id", files.safe_path(F.col("path")).alias("safe"), files.file_type(F.col("path"), F.col("mime"), F.col("given")).alias("file_type"), files.inferred_type(F.col("path"), F.coalesce("mime", F.lit("")), F.coalesce(files.language(F.col("path")), F.lit(""))).alias("inferred"), files.content_format(F.coalesce("mime", F.lit(""))).alias("content_format"))


def markdown_sections(spark, d):
    return chunkers.sections(table(spark, d, MARKDOWN), "doc_id", "text")


def layout_units(spark, d):
    return units.layout_units(table(spark, d, LAYOUTS)).select("artifact", "page_number", "kind", "block_id", "table_id", "identity", "content_format", "title", "content")


def unit_records(spark, d):
    rows = table(spark, d, MARKDOWN).select(F.concat(F.lit("a/"), F.col("doc_id").cast("string")).alias("relative_path"), F.when(F.col("doc_id") % 2 == 0, F.lit("p1")).alias("identity"), F.when(F.col("doc_id") % 5 > 0, F.col("text")).otherwise(F.lit("  ")).alias("content"))
    return units.records(rows, "s1").select("relative_path", "name", "doc_id", "content_hash")


def recursive_chunks(spark, d):
    return chunkers.recursive_chunks(table(spark, d, "SELECT doc_id, text FROM {documents}"), "doc_id", "text").select("doc_id", "ordinal", F.sha2("content", 256).alias("content_hash"), F.length("content").alias("size"))


def typed_chunks(spark, d):
    rows = table(spark, d, MARKDOWN).withColumn("doc_type", F.when(F.col("doc_id") % 3 == 0, "technical_doc").when(F.col("doc_id") % 3 == 1, "code"))
    return chunkers.by_type(rows, "doc_id", "text", "doc_type")


QUERIES = {f.__name__: f for f in (path_kinds, markdown_sections, layout_units, unit_records, recursive_chunks, typed_chunks)}

_CASE = lambda x, t: f"CASE {x} " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in t.items()) + " END"
_SUFFIX = "lower(regexp_extract(path, '[^./]\\.([A-Za-z0-9]+)$', 1))"
_MD = "WITH " + ctes(m=MARKDOWN)
_LANGS = ", ".join(f"'{x}'" for x in sorted({*files.LANGUAGES.values(), *files.SPECIAL}))
SQL = {
    "path_kinds": f"""WITH {ctes(p=PATHS)}, x AS (SELECT doc_id, mime, given, lower(path) AS low, {_SUFFIX} AS suffix, coalesce(lower(mime), '') AS media, string_split(lower(path), '/') AS parts FROM p)
SELECT doc_id, NOT (len(list_intersect(parts, [{', '.join(f"'{x}'" for x in (*files.EXCLUDED_DIRS, '..'))}])) > 0 OR parts[-1] IN ({', '.join(f"'{x}'" for x in files.SECRET_NAMES)}) OR starts_with(parts[-1], '.env.') OR regexp_matches(parts[-1], '[^.]\\.({files.KEY_SUFFIXES})$')) AS safe,
 coalesce({_CASE('lower(trim(given))', files.BY_NAME)}, {_CASE("lower(trim(split_part(mime, ';', 1)))", files.BY_MIME)}, {_CASE('parts[-1]', files.SPECIAL)}, {_CASE('suffix', files.BY_SUFFIX)}, 'binary') AS file_type,
 CASE WHEN suffix = 'pdf' THEN 'pdf' WHEN media = 'text/csv' OR suffix = 'csv' THEN 'csv' WHEN suffix = 'xlsx' THEN 'xlsx' WHEN suffix IN ('md', 'markdown') THEN 'markdown' WHEN suffix = 'json' THEN 'json' WHEN {_CASE('suffix', files.LANGUAGES)} IN ({_LANGS}) THEN 'code' WHEN suffix IN ('yaml', 'yml') THEN 'yaml' WHEN suffix = 'toml' THEN 'toml' ELSE 'text' END AS inferred, 'text' AS content_format FROM x""",
    "markdown_sections": f"""{_MD}, l AS (SELECT doc_id, generate_subscripts(string_split(text, chr(10)), 1) AS n, unnest(string_split(text, chr(10))) AS line FROM m), f AS (SELECT *, sum(starts_with(line, '```')::INT) OVER w % 2 = 1 OR starts_with(line, '```') AS fenced FROM l WINDOW w AS (PARTITION BY doc_id ORDER BY n)),
h AS (SELECT *, CASE WHEN fenced THEN 0 ELSE length(regexp_extract(line, '^(#{{1,3}})\\s+(.*\\S)\\s*$', 1)) END AS level, regexp_extract(line, '^(#{{1,3}})\\s+(.*\\S)\\s*$', 2) AS name FROM f),
p AS (SELECT *, max(CASE WHEN level = 1 THEN n END) OVER w AS n1, max(CASE WHEN level = 2 THEN n END) OVER w AS n2, max(CASE WHEN level = 3 THEN n END) OVER w AS n3, sum((level > 0)::INT) OVER w AS part FROM h WINDOW w AS (PARTITION BY doc_id ORDER BY n)),
b AS (SELECT doc_id, part, n1, CASE WHEN n2 > coalesce(n1, 0) THEN n2 END AS n2, CASE WHEN n3 > coalesce(n2, 0) AND n3 > coalesce(n1, 0) THEN n3 END AS n3, string_agg(line, chr(10) ORDER BY n) AS body FROM p WHERE level = 0 AND trim(line) <> '' GROUP BY ALL)
SELECT b.doc_id, (row_number() OVER (PARTITION BY b.doc_id ORDER BY part) - 1)::INTEGER AS ordinal, x1.name AS title, x2.name AS section, x3.name AS subsection, body FROM b LEFT JOIN h x1 ON x1.doc_id = b.doc_id AND x1.n = n1 LEFT JOIN h x2 ON x2.doc_id = b.doc_id AND x2.n = b.n2 LEFT JOIN h x3 ON x3.doc_id = b.doc_id AND x3.n = b.n3""",
    "layout_units": """WITH u AS (SELECT doc_id::VARCHAR || '_content_list.json' AS artifact, (doc_id % 3 + 1)::INTEGER AS p, source FROM documents), b AS (SELECT substr(sha256('bad id'), 1, 16) AS h)
SELECT artifact, p AS page_number, 'text' AS kind, 'block-0001' AS block_id, NULL AS table_id, 'page:' || p || ':block:block-0001' AS identity, 'json-structured-text' AS content_format, 'page ' || p || ' / text' AS title, 'head' AS content FROM u
UNION ALL SELECT artifact, 1, 'table', 'block-0002', 'page-1-table-0001', 'page:1:table:page-1-table-0001', 'markdown-table', 'page 1 / table 1', 'cap' || chr(10) || chr(10) || '<table>x</table>' FROM u
UNION ALL SELECT artifact, 1, 'table', 'block-0003', 'sha256-' || h, 'page:1:table:sha256-' || h, 'markdown-table', 'page 1 / table 2', '|a|' FROM u, b
UNION ALL SELECT artifact, 4, 'list', 'b1', NULL, 'page:4:block:b1', 'json-structured-text', 'page 4 / list', 't' || chr(10) || chr(10) || source FROM u
UNION ALL SELECT artifact, 4, 'list', 'b1', NULL, 'page:4:block:b1:content-' || substr(sha256('t' || chr(10) || chr(10) || 'other'), 1, 12), 'json-structured-text', 'page 4 / list', 't' || chr(10) || chr(10) || 'other' FROM u""".replace("'markdown-table', 'page 1 / table 1'", "'structured-table', 'page 1 / table 1'"),
    "unit_records": f"{_MD}, r AS (SELECT 'a/' || doc_id AS relative_path, 'a/' || doc_id || CASE WHEN doc_id % 2 = 0 THEN '#p1' ELSE '' END AS name, text FROM m WHERE doc_id % 5 > 0) SELECT relative_path, name, 'doc_' || substr(sha256('s1' || chr(0) || name), 1, 24) AS doc_id, sha256(text) AS content_hash FROM r",
}
