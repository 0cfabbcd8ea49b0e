"""Queries of the operators on generated answers; records are derived from conversations."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import evaluate, responses
from . import retrieval
from .corpus import _TOP
from .portable import ctes, table

_ID = "conv_id * 100 + turn"
RECORDS = f"""SELECT {_ID} AS id, turn % 4 <> 3 AS answerable, (conv_id + turn) % 5 = 0 AS refused, (conv_id + turn) % 7 <> 0 AS generated, turn % 6 <> 5 AS attempted,
 CASE WHEN conv_id % 19 = 0 THEN 'provider_timeout' WHEN conv_id % 23 = 0 THEN 'no_build' END AS failure_code, CASE WHEN turn % 8 = 7 THEN 'no_sources' END AS retrieval_error,
 CASE WHEN turn % 3 = 0 THEN CAST(length(text) AS BIGINT) WHEN turn % 3 = 1 THEN -1 END AS prompt_tokens, CAST(length(text) % 97 AS BIGINT) AS completion_tokens,
 CASE WHEN turn % 4 = 0 THEN 'comparison' WHEN turn % 4 = 1 THEN 'design' ELSE 'implementation' END AS route, CAST(turn % 5 AS BIGINT) AS points, CAST(conv_id % 4 AS BIGINT) AS sources FROM {{conversations}}"""
SCORES = "\nUNION ALL ".join(
    f"SELECT {_ID} AS id, '{'judged' if k < 5 else 'computed'}' AS family, '{m}' AS metric, CASE WHEN (conv_id + turn * {k + 2}) % {7 + k} > 0 THEN CAST((conv_id * {k + 3} + turn) % 11 AS DOUBLE) / 10 END AS value FROM {{conversations}}"
    for k, m in enumerate((*responses.JUDGED, *responses.COMPUTED))
)
ATTEMPTS = "\nUNION ALL ".join(
    f"SELECT {_ID} AS id, '{responses.JUDGED[k]}' AS metric, CAST({t} + turn AS BIGINT) AS attempted_at, CASE WHEN (conv_id + {t}) % 3 = 0 THEN 'judge_timeout' WHEN (conv_id + {t}) % 3 = 1 THEN '' END AS code FROM {{conversations}} WHERE (conv_id + turn) % {k + 2 + t} = 0"
    for k in range(3)
    for t in range(2)
)
QUESTIONS = "SELECT conv_id AS id, text AS question, CASE WHEN conv_id % 2 = 0 THEN 'development' ELSE 'holdout' END AS split FROM {conversations} WHERE turn < 2 UNION ALL SELECT conv_id + 1000000, upper(text) || '?!', 'holdout' FROM {conversations} WHERE turn = 0 AND conv_id % 3 = 0"


def _inputs(spark, d):
    return table(spark, d, RECORDS), table(spark, d, SCORES), table(spark, d, ATTEMPTS)


def response_metrics(spark, d):
    records, scores, _ = _inputs(spark, d)
    return responses.metric_coverage(records, scores)


def response_failures(spark, d):
    records, _, attempts = _inputs(spark, d)
    return responses.failure_histogram(records, attempts)


def response_tokens(spark, d):
    return responses.token_totals(_inputs(spark, d)[0], ["prompt_tokens", "completion_tokens"])


def response_coverage(spark, d):
    return responses.run_coverage(*_inputs(spark, d))


def attempt_numbers(spark, d):
    return responses.numbered_attempts(table(spark, d, ATTEMPTS).withColumn("number", F.lit(0))).withColumn("code", F.coalesce("code", F.lit("none")))


def judge_retries(spark, d):
    return responses.to_retry(*_inputs(spark, d))


def resume_questions(spark, d):
    done = table(spark, d, RECORDS).where("generated").select("id", F.when(F.col("id") % 2 == 0, "run-1").otherwise("run-2").alias("experiment_id"))
    return responses.resume(table(spark, d, RECORDS).select("id"), done, "run-1")


def _wide(spark, d, bump):
    return table(spark, d, SCORES).where("family = 'judged'").withColumn("value", F.col("value") * bump).groupBy("id").pivot("metric", list(responses.JUDGED)).agg(F.first("value"))


def paired_metrics(spark, d):
    base = _wide(spark, d, 1.0)
    return responses.paired(base, base.select("id", *(F.when(F.col("id") % 3 > 0, F.col(m) * F.col(m)).alias(m) for m in responses.JUDGED)), list(responses.JUDGED))


def response_sources(spark, d):
    """Passages are questions; each document that holds one is a claim, supported by its path without the folder; the best documents by BM25 are what was retrieved."""
    docs = retrieval.placed(spark, d).select("doc_id", "path")
    n = F.col("doc_id") % 3
    shown = F.when(n == 0, F.concat(F.lit("./"), "path", F.lit("#symbol:x"))).when(n == 1, F.upper("path")).otherwise(F.col("path"))
    results = retrieval.bm25_topk(spark, d, k=10).join(docs, "doc_id").select(F.col("qid").alias("id"), "rank", shown.alias("source"))
    held = retrieval._relevant(spark, d).join(docs, "doc_id")
    sources = F.array(F.concat(F.lit("lib//"), F.substring_index("path", "/", -1)), F.concat(F.lit("gone/"), "doc_id", F.lit(".md")))
    claims = held.select(F.col("qid").alias("id"), F.col("doc_id").alias("claim_id"), (F.col("doc_id") % 5 != 0).alias("required"), sources.alias("sources"))
    asked = spark.read.parquet(f"{d}/benchmark.parquet").select(F.col("item_id").alias("id"))
    samples = asked.join(claims.select("id").distinct().withColumn("answerable", F.lit(True)), "id", "left").withColumn("retrieval_failed", F.col("id") % 11 == 10)
    return responses.retrieval_scores(samples, claims, results)


def unpaired_questions(spark, d):
    rows = table(spark, d, RECORDS)
    return responses.unpaired(rows.where("id % 5 <> 0"), rows.where("id % 7 <> 0"))


def question_strata(spark, d):
    rows = table(spark, d, RECORDS)
    each = rows.select("answerable", "route", responses.difficulty(F.col("route"), F.col("points"), F.col("sources")).alias("difficulty"), responses.variant(F.col("answerable"), F.col("route")).alias("variant"))
    return each.groupBy(*each.columns).agg(F.count(F.lit(1)).alias("n"))


def question_leaks(spark, d):
    return responses.leaks(table(spark, d, QUESTIONS))


QUERIES = {
    f.__name__: f
    for f in (response_metrics, response_failures, response_tokens, response_coverage, attempt_numbers, judge_retries, resume_questions, response_sources, paired_metrics, unpaired_questions, question_strata, question_leaks)
}

_IN = "WITH " + ctes(records=RECORDS, scores=SCORES, attempts=ATTEMPTS)
_WANTED = "wanted AS (SELECT unnest(list_concat(list_transform([" + ", ".join(f"'{m}'" for m in responses.JUDGED) + "], lambda m: {'family': 'judged', 'metric': m}), list_transform([" + ", ".join(f"'{m}'" for m in responses.COMPUTED) + "], lambda m: {'family': 'computed', 'metric': m})), recursive := true))"
_OK = "ok AS (SELECT *, answerable AND generated AND NOT refused AS judged FROM records)"
_METRICS = f"""{_WANTED}, {_OK}, sizes AS (SELECT 'judged' AS family, count(*) FILTER (judged) AS eligible FROM ok UNION ALL SELECT 'computed', count(*) FILTER (answerable) FROM ok),
held AS (SELECT family, metric, value FROM scores JOIN ok USING (id) WHERE value IS NOT NULL AND CASE family WHEN 'judged' THEN judged ELSE answerable END),
metrics AS (SELECT w.family, w.metric, round(avg(value), 9) AS mean, count(value) AS n, any_value(eligible) AS eligible, round(count(value)::DOUBLE / any_value(eligible), 9) AS coverage FROM wanted w JOIN sizes USING (family) LEFT JOIN held USING (family, metric) GROUP BY 1, 2)"""
_J = "(" + ", ".join(f"'{m}'" for m in responses.JUDGED) + ")"
SQL = {
    "response_metrics": f"{_IN}, {_METRICS} SELECT * FROM metrics",
    "response_failures": f"{_IN}, u AS (SELECT 'run' AS kind, failure_code AS code FROM records UNION ALL SELECT 'retrieval', retrieval_error FROM records UNION ALL SELECT 'judge', CASE code WHEN '' THEN 'unknown_judge_error' ELSE code END FROM attempts) SELECT kind, code, count(*) AS n FROM u WHERE code IS NOT NULL GROUP BY 1, 2",
    "response_tokens": f"{_IN}, u AS (SELECT 'prompt_tokens' AS field, prompt_tokens AS t FROM records WHERE attempted UNION ALL SELECT 'completion_tokens', completion_tokens FROM records WHERE attempted) SELECT field, sum(t) FILTER (t >= 0)::BIGINT AS total, round(avg(t) FILTER (t >= 0), 9) AS mean_per_call, count(t) FILTER (t >= 0) AS n FROM u GROUP BY 1",
    "response_coverage": f"""{_IN}, {_METRICS}, tried AS (SELECT DISTINCT id, metric FROM (SELECT id, metric FROM scores WHERE family = 'judged' AND value IS NOT NULL UNION ALL SELECT id, metric FROM attempts) WHERE id IN (SELECT id FROM ok WHERE judged)),
c AS (SELECT (SELECT round(avg((failure_code IS NULL AND (refused OR generated OR attempted))::INT), 9) FROM records) AS run_coverage, (SELECT count(*) * 5 FROM ok WHERE judged) AS judge_slots, (SELECT count(*) FROM tried) AS judge_executed,
 (SELECT min(coverage) FROM metrics WHERE family = 'judged') AS judged_coverage, (SELECT min(coverage) FROM metrics WHERE family = 'computed') AS computed_coverage)
SELECT *, round(judge_executed::DOUBLE / judge_slots, 9) AS execution_coverage, run_coverage = 1 AND judge_executed = judge_slots AND computed_coverage = 1 AS complete, run_coverage = 1 AND judge_executed = judge_slots AND computed_coverage = 1 AND judged_coverage >= 0.95 AS publishable FROM c""",
    "attempt_numbers": f"{_IN} SELECT id, metric, attempted_at, coalesce(code, 'none') AS code, row_number() OVER (PARTITION BY id, metric ORDER BY attempted_at, code NULLS FIRST)::INTEGER AS number FROM attempts",
    "judge_retries": f"{_IN}, {_OK}, s AS (SELECT id, unnest([{_J[1:-1]}]) AS metric FROM ok WHERE judged), t AS (SELECT id, metric, count(*) AS tries FROM attempts GROUP BY 1, 2) SELECT s.id, s.metric, coalesce(tries, 0) AS tries FROM s LEFT JOIN t USING (id, metric) WHERE coalesce(tries, 0) < 3 AND NOT EXISTS (SELECT 1 FROM scores x WHERE x.id = s.id AND x.metric = s.metric AND x.value IS NOT NULL)",
    "resume_questions": f"{_IN} SELECT id FROM records WHERE NOT (generated AND id % 2 = 0)",
    "paired_metrics": f"""{_IN}, p AS (SELECT id, metric, CASE WHEN id % 3 > 0 THEN value * value - value END AS d FROM scores WHERE family = 'judged'),
i AS (SELECT metric, d, ('0x' || substr(sha256(id::VARCHAR), 1, 8))::UBIGINT AS i FROM p WHERE d IS NOT NULL), r AS (SELECT (unnest(range(1, {evaluate.BOOTSTRAP_ROUNDS + 1})))::UBIGINT AS r),
h0 AS (SELECT metric, d, r, (i + r * 2654435769 + {evaluate.BOOTSTRAP_SEED}) % 4294967296 AS x FROM i, r), h1 AS (SELECT metric, d, r, (xor(x, x >> 16) * 2146121005) % 4294967296 AS x FROM h0), h2 AS (SELECT metric, d, r, (xor(x, x >> 15) * 2221713035) % 4294967296 AS x FROM h1),
w AS (SELECT metric, d, r, {' + '.join(f'(u >= {t})::INTEGER' for t in evaluate.POISSON)} AS w FROM (SELECT metric, d, r, xor(x, x >> 16) AS u FROM h2)), m AS (SELECT metric, r, coalesce(sum(w * d) / nullif(sum(w), 0), 0.0) AS m FROM w GROUP BY 1, 2),
c AS (SELECT metric, round(quantile_cont(m, 0.025), 6) AS ci_low, round(quantile_cont(m, 0.975), 6) AS ci_high FROM m GROUP BY 1)
SELECT * FROM (SELECT metric, count(d) AS n, round(avg(d), 9) AS mean_delta, count(*) FILTER (d > 0) AS n_better, count(*) FILTER (d < 0) AS n_worse FROM p GROUP BY 1) LEFT JOIN c USING (metric)""",
    "response_sources": f"""WITH {retrieval._BM25}, {retrieval._REL}, t10 AS ({_TOP.format(k=10)}), pa AS (SELECT doc_id, source || CASE WHEN lang = 'es' THEN '/tests/' ELSE '/lib/' END || 'doc_' || doc_id || CASE lang WHEN 'fr' THEN '.py' WHEN 'de' THEN '_test.py' ELSE '.md' END AS path FROM documents),
fo AS (SELECT qid AS id, lower(path) AS key, row_number() OVER (PARTITION BY qid ORDER BY rank) AS place FROM t10 JOIN pa USING (doc_id)),
cl AS (SELECT qid AS id, doc_id AS claim_id, unnest(['lib/' || split_part(path, '/', -1), 'gone/' || doc_id || '.md']) AS key FROM rel JOIN pa USING (doc_id) WHERE doc_id % 5 <> 0),
al AS (SELECT DISTINCT qid AS id FROM rel), wa AS (SELECT id, count(DISTINCT claim_id) AS n_claims, count(DISTINCT key) AS n_options FROM cl GROUP BY 1),
me AS (SELECT cl.id, count(DISTINCT claim_id) AS m_claims, count(DISTINCT cl.key) AS m_options, count(DISTINCT place) AS m_shown, min(place) AS first FROM cl JOIN fo ON fo.id = cl.id AND (fo.key = cl.key OR ends_with(fo.key, '/' || cl.key)) GROUP BY 1),
sh AS (SELECT id, count(*) AS n_shown FROM fo GROUP BY 1), sta AS (SELECT item_id AS id, CASE WHEN item_id NOT IN (SELECT id FROM al) THEN 'not_applicable' WHEN item_id % 11 = 10 OR item_id NOT IN (SELECT id FROM wa) THEN 'failed' ELSE 'scored' END AS status FROM benchmark)
SELECT id, status, CASE status WHEN 'scored' THEN CASE WHEN m_shown > 0 THEN 1.0 ELSE 0.0 END END::DOUBLE AS hit, CASE status WHEN 'scored' THEN round(coalesce(m_claims, 0)::DOUBLE / n_claims, 9) END AS required_claim_recall,
 CASE status WHEN 'scored' THEN round(coalesce(1.0::DOUBLE / first, 0.0), 9) END AS mrr, CASE status WHEN 'scored' THEN round(coalesce(coalesce(m_shown, 0)::DOUBLE / n_shown, 0.0), 9) END AS source_precision, CASE status WHEN 'scored' THEN round(coalesce(m_options, 0)::DOUBLE / n_options, 9) END AS option_recall
FROM sta LEFT JOIN wa USING (id) LEFT JOIN sh USING (id) LEFT JOIN me USING (id)""",
    "unpaired_questions": f"{_IN} SELECT id, CASE WHEN id % 7 = 0 THEN 'baseline' ELSE 'candidate' END AS only_in FROM records WHERE (id % 5 = 0) <> (id % 7 = 0)",
    "question_strata": f"{_IN} SELECT answerable, route, CASE WHEN route = 'comparison' OR points >= 4 OR sources >= 3 THEN 'hard' WHEN points >= 2 OR sources >= 2 THEN 'medium' ELSE 'easy' END AS difficulty, CASE WHEN NOT answerable THEN 'boundary' WHEN route = 'comparison' THEN 'multi_hop' ELSE 'canonical' END AS variant, count(*) AS n FROM records GROUP BY ALL",
    "question_leaks": f"WITH {ctes(q=QUESTIONS)}, u AS (SELECT 'id' AS kind, id::VARCHAR AS value, split FROM q UNION ALL SELECT 'question', regexp_replace(replace(lower(question), 'ß', 'ss'), '[\\p{{P}}\\p{{Z}}]', '', 'g'), split FROM q) SELECT kind, value, count(*) AS n, count(DISTINCT split) AS n_splits FROM u GROUP BY 1, 2 HAVING count(*) > 1",
}
