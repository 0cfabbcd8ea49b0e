"""SQL fragments of the oracle queries (DuckDB dialect)."""

from __future__ import annotations


def fold(x: str) -> str:
    return f"replace(lower({x}), 'ß', 'ss')"


def tokens(table: str, key: str, text: str, name: str = "toks") -> str:
    """CTEs ending in ``name`` (key, term), one row for each index token.

    RE2 has no look-ahead, so the camel-case cut is written as two replacements first.
    """
    camel = "regexp_extract_all(regexp_replace(regexp_replace(c, '([A-Z]+)([A-Z][a-z])', '\\1 \\2', 'g'), '[A-Z]([0-9_])', ' \\1', 'g'), '[A-Z]?[a-z]+|[A-Z]+|[0-9]+')"
    return f"""
{name}_raw AS (SELECT {key} AS k, unnest(regexp_extract_all(coalesce({text}, ''), '[A-Za-z_][A-Za-z0-9_]*(?:[.:/\\\\-][A-Za-z0-9_]+)*|[0-9]+(?:\\.[0-9]+)*|[㐀-䶿一-鿿]+')) AS t FROM {table}),
{name}_kind AS (SELECT k, t, regexp_matches(t, '^[㐀-䶿一-鿿]+$') AS cjk FROM {name}_raw),
{name}_comp AS (SELECT k, t, unnest(list_filter(regexp_split_to_array(t, '[.:/\\\\-]+'), lambda x: x <> '')) AS c FROM {name}_kind WHERE NOT cjk),
{name}_camel AS (SELECT k, {camel} AS ps FROM {name}_comp),
{name} AS (
  SELECT k, CASE WHEN cjk THEN t ELSE {fold('t')} END AS term FROM {name}_kind
  UNION ALL SELECT k, substr(t, i, 2) FROM (SELECT k, t, unnest(range(1, length(t))) AS i FROM {name}_kind WHERE cjk)
  UNION ALL SELECT k, {fold('c')} FROM {name}_comp WHERE {fold('c')} <> {fold('t')}
  UNION ALL SELECT k, {fold('p')} FROM (SELECT k, unnest(ps) AS p FROM {name}_camel WHERE len(ps) > 1)
)"""


def bm25(k1: float = 1.5, b: float = 0.75, name: str = "scored", by: str | None = None, queries: tuple[str, str, str] = ("benchmark", "item_id", "text")) -> str:
    """CTEs ending in ``name`` ([by,] qid, doc_id, score) for queries (table, key, text), passages of the benchmark at first, over documents."""
    part = f"{by} AS p" if by else "0 AS p"
    return f"""{tokens('documents', 'doc_id', 'text', 'dt')},
{tokens(*queries, 'qt')},
parts AS (SELECT doc_id, {part} FROM documents),
dl AS (SELECT parts.doc_id, any_value(p) AS p, count(dt.term) AS dl FROM parts LEFT JOIN dt ON dt.k = parts.doc_id GROUP BY parts.doc_id),
st AS (SELECT p, count(*) AS n, avg(dl) AS avgdl FROM dl GROUP BY p),
post AS (SELECT dt.k AS doc_id, term, count(*) AS tf FROM dt GROUP BY 1, 2),
dfs AS (SELECT p, term, count(*) AS df FROM post JOIN dl USING (doc_id) GROUP BY 1, 2),
q AS (SELECT k AS qid, term, count(*) AS qtf FROM qt GROUP BY 1, 2),
{name} AS (SELECT p, qid, doc_id, score FROM (
  SELECT dl.p, qid, post.doc_id, round(sum(qtf * ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * ({k1} + 1) / (tf + {k1} * (1 - {b} + {b} * dl / avgdl))), 6) AS score
  FROM q JOIN post USING (term) JOIN dl ON dl.doc_id = post.doc_id JOIN st ON st.p = dl.p JOIN dfs ON dfs.p = dl.p AND dfs.term = post.term
  GROUP BY 1, 2, 3) WHERE score > 0)"""
