"""Queries of the training-data operators over the standard tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..operators.common import spread
from . import fill_middle, hard_negatives, langid, media, packing, pii, piece_model, quality, simhash, substring, token_files, top_k, toxicity
from .common import documents

_WORDS = "regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')"
_QUALITY = f"""WITH w AS (SELECT doc_id, coalesce(text, '') AS text, {_WORDS} AS ws FROM documents),
words AS (SELECT doc_id, unnest(ws) AS w, generate_subscripts(ws, 1) AS p FROM w),
wins AS (SELECT doc_id, i, array_to_string(ws[i:i + 4], ' ') AS k FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 3)) AS i FROM w WHERE len(ws) >= 5)),
twice AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, k) AS n FROM wins) WHERE n > 1),
covered AS (SELECT doc_id, count(DISTINCT i + j) AS n FROM twice, range(0, 5) r(j) GROUP BY 1),
lines AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM w),
dups AS (SELECT doc_id, count(*) - count(DISTINCT line) AS dup, count(*) AS n FROM lines WHERE regexp_matches(line, '[^\\x20\\x09-\\x0D]') GROUP BY 1),
near AS (SELECT doc_id, count(*) FILTER (w = before) AS n, max(strlen(w)) AS longest FROM (SELECT doc_id, w, lag(w) OVER (PARTITION BY doc_id ORDER BY p) AS before FROM words) GROUP BY 1),
m AS (SELECT w.doc_id, len(ws)::BIGINT AS n_words, length(array_to_string(ws, ''))::BIGINT AS word_chars, length(regexp_replace(text, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols, coalesce(dup, 0)::BIGINT AS n_dup_lines, coalesce(covered.n, 0)::BIGINT AS n_repeat_words,
 coalesce(near.n, 0) AS n_neighbour_words, coalesce(dups.n, 0) AS n_lines, coalesce(longest, 0) AS longest_word
 FROM w LEFT JOIN covered USING (doc_id) LEFT JOIN dups USING (doc_id) LEFT JOIN near USING (doc_id)),
b AS (SELECT *, ({' + '.join(f'CASE WHEN {fails} THEN {1 << k} ELSE 0 END' for k, (_, fails) in enumerate(quality.RULES))})::BIGINT AS failed_bits FROM m)
SELECT doc_id, {', '.join(quality.MEASURES)}, failed_bits & {quality.BASE} <> 0 AS base_failed, failed_bits & {quality.POLICIES[quality.POLICY]} = 0 AS kept, failed_bits, '{quality.POLICY}' AS policy,
 {', '.join(f"failed_bits & {mask} = 0 AS kept_{name.replace('-', '_')}" for name, mask in quality.POLICIES.items())},
 CASE failed_bits & {quality.POLICIES[quality.POLICY]} {' '.join(f"WHEN {bit} THEN '{name}'" for name, bit in quality.BITS.items())} END AS only_rule FROM b"""
_REPEATS = f"""WITH w AS (SELECT doc_id, {_WORDS} AS ws FROM documents),
wins AS (SELECT doc_id, i, sha256(array_to_string(ws[i:i + {substring.WINDOW - 1}], ' ')) AS k FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - {substring.WINDOW - 2})) AS i FROM w WHERE len(ws) >= {substring.WINDOW})),
firsts AS (SELECT k, min(doc_id) AS m FROM wins GROUP BY 1),
gone AS (SELECT DISTINCT wins.doc_id, i + j AS p FROM wins JOIN firsts USING (k), range(0, {substring.WINDOW}) r(j) WHERE m < wins.doc_id),
words AS (SELECT doc_id, unnest(ws) AS w, generate_subscripts(ws, 1) AS p FROM w),
kept AS (SELECT words.doc_id, string_agg(w, ' ' ORDER BY words.p) FILTER (gone.p IS NULL) AS t, count(*) FILTER (gone.p IS NOT NULL) AS n FROM words LEFT JOIN gone ON gone.doc_id = words.doc_id AND gone.p = words.p GROUP BY 1)
SELECT doc_id, len(ws)::BIGINT AS n_words, coalesce(n, 0)::BIGINT AS n_removed, sha256(coalesce(t, '')) AS kept_sha256 FROM w LEFT JOIN kept USING (doc_id)"""
_CUT = "[A-Za-z]+|[^A-Za-z]"
_FIM = f"""WITH u AS (SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '{_CUT}') AS us, sha256('1:' || coalesce(doc_id::VARCHAR, '')) AS h FROM documents),
n AS (SELECT *, len(us)::BIGINT AS n, {', '.join(f"('0x' || substr(h, {1 + 8 * k}, 8))::BIGINT AS h{k + 1}" for k in range(4))} FROM u),
c AS (SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS lo, greatest(h1 % (n + 1), h2 % (n + 1)) AS hi,
 CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR h3 % 100 >= {fill_middle.PLAIN_FROM} THEN 'plain' WHEN h4 % 100 < {fill_middle.SPM_BELOW} THEN 'spm' ELSE 'psm' END AS form FROM n),
p AS (SELECT *, array_to_string(us[1:lo], '') AS pre, array_to_string(us[lo + 1:hi], '') AS mid, array_to_string(us[hi + 1:], '') AS suf FROM c)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(pre) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(mid) END AS middle_chars,
 sha256(CASE form WHEN 'psm' THEN '<P>' || pre || '<S>' || suf || '<M>' || mid WHEN 'spm' THEN '<S>' || suf || '<P>' || pre || '<M>' || mid ELSE text END) AS output_sha256, sha256(text) AS restored_sha256 FROM p"""
_VECTORS = "list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS e FROM embeddings WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0"
_TOP_K = f"""WITH v AS (SELECT vec_id, {_VECTORS}),
s AS (SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.e, c.e)::BIGINT AS score FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % {top_k.EVERY} = 0)
SELECT * FROM (SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank, vec_id, score FROM s) WHERE rank <= {top_k.K}"""
_NEGATIVES = f"""WITH v AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, {_VECTORS} AND label IS NOT NULL),
s AS (SELECT a.vec_id AS anchor_id, c.vec_id, a.label = c.label AS same, list_inner_product(a.e, c.e)::BIGINT AS score FROM v a JOIN v c ON a.vec_id <> c.vec_id WHERE a.vec_id % {hard_negatives.EVERY} = 0),
p AS (SELECT * FROM (SELECT anchor_id, vec_id AS positive_id, score AS positive_score, row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id)::INTEGER AS positive_rank FROM s WHERE same) WHERE positive_rank <= 5)
SELECT * FROM (SELECT anchor_id, positive_id, row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, vec_id)::INTEGER AS rank, vec_id AS negative_id, positive_score, score AS negative_score, positive_rank
 FROM p JOIN s USING (anchor_id) WHERE NOT same AND 30 * positive_score <= 100 * score AND 100 * score <= 90 * positive_score) WHERE rank <= 10"""
#: The others have no SQL: XXH64, CRC-32, tokenizers and learned models are not in DuckDB. They are tested in tests/llm.
SQL: dict[str, str] = {"op3_quality": _QUALITY, "op10_substring": _REPEATS, "op11_fill_middle": _FIM, "op12_top_k": _TOP_K, "op13_hard_negatives": _NEGATIVES}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    vectors = lambda f: lambda spark, sf_dir: f(spread(spark.read.parquet(f"{sf_dir}/embeddings.parquet")))
    over = lambda f: lambda spark, sf_dir: f(documents(spark, sf_dir))
    return {
        "op1_sentencepiece": over(piece_model.op1_sentencepiece),
        "op2_simhash": over(simhash.op2_simhash),
        "op3_quality": over(quality.op3_quality),
        "op4_pii": over(pii.op4_pii),
        "op5_packing": over(packing.op5_packing),
        "op6_token_files": over(token_files.op6_token_files),
        "op7_toxicity": lambda spark, sf_dir: toxicity.op7_toxicity(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet")),
        "op8_media": over(media.op8_media),
        "op9_langid": over(langid.op9_langid),
        "op10_substring": over(substring.op10_substring),
        "op11_fill_middle": over(fill_middle.op11_fill_middle),
        "op12_top_k": vectors(top_k.op12_top_k),
        "op13_hard_negatives": vectors(hard_negatives.op13_hard_negatives),
    }
