"""Manifests and what is served from them: integrity, builds, partitions, index rows, citations, freshness, stale artifacts.

sources: source_id, source_type, uri, version, commit_sha, metadata (map). documents: doc_id,
source_id, relative_path, identity, content, title, metadata. chunks: chunk_id, doc_id, source_id,
ordinal, content, metadata.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .evidence import role as evidence_role

# Metadata that results may show.
PUBLIC = ("git_branch", "git_commit_sha", "source_version", "source_type", "document_title", "relative_path", "evidence_role", "live_verification", "first_stage_score", "rerank_score", "retrieval_degraded_components")
# Suffixes of code, and weights of partitions.
CODE_SUFFIX = r"\.(?:py|pyi|js|ts|tsx|go|rs|java)$"
WEIGHTS = {"internal/code": 1.35, "internal/test": 1.20, "internal/design": 1.00, "internal/history": 0.80, "official/official": 0.90}


def violations(sources: DataFrame, documents: DataFrame, chunks: DataFrame) -> DataFrame:
    """(violation, id, n): repeated ids, orphans, and chunks whose source is not their document's; none in a sound manifest."""
    repeated = lambda df, key, what: df.groupBy(F.col(key).cast("string").alias("id")).agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(F.lit(f"repeated_{what}").alias("violation"), "id", "n")
    orphan = lambda df, key, of, ref, what: df.join(of.select(F.col(ref)).distinct(), ref, "left_anti").groupBy(F.col(key).cast("string").alias("id")).agg(F.count(F.lit(1)).alias("n")).select(F.lit(what).alias("violation"), "id", "n")
    owners = documents.select("doc_id", F.col("source_id").alias("_owner")).distinct()
    wrong = chunks.join(owners, "doc_id").where(F.col("source_id") != F.col("_owner")).groupBy(F.col("chunk_id").cast("string").alias("id")).agg(F.count(F.lit(1)).alias("n"))
    parts = [
        repeated(sources, "source_id", "source"), repeated(documents, "doc_id", "document"), repeated(chunks, "chunk_id", "chunk"),
        orphan(documents, "doc_id", sources, "source_id", "document_without_source"), orphan(chunks, "chunk_id", documents, "doc_id", "chunk_without_document"),
        wrong.select(F.lit("chunk_of_other_source").alias("violation"), "id", "n"),
    ]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def partition(source_type: Column, path: Column, corpus: Column, authority: Column, record_kind: Column) -> tuple[Column, Column]:
    """(corpus, authority) of a record; what its metadata says goes first."""
    given = lambda x: F.lower(F.trim(F.coalesce(x, F.lit(""))))
    web = given(source_type) == "official_web"
    own = F.when(given(corpus) != "", given(corpus)).when(web, "official").otherwise("internal")
    official = web | (own == "official")
    low = F.lower(F.replace(F.substring_index(path, "#", 1), F.lit("\\"), F.lit("/")))
    name = F.substring_index(low, "/", -1)
    tests = F.contains(F.concat(F.lit("/"), F.ltrim(low, F.lit("/"))), F.lit("/tests/")) | name.startswith("test_") | name.endswith("_test.py")
    found = (
        F.when(official, "official").when(given(authority).isin("code", "test", "design", "history"), given(authority)).when(given(record_kind) == "git_commit", "history")
        .when(tests, "test").when(low.rlike(CODE_SUFFIX) | F.contains(path, F.lit("#symbol:")), "code").otherwise("design")
    )
    return F.when(official, "official").otherwise(own), found


def partition_name(corpus: Column, authority: Column) -> Column:
    """The folder of a partition; an error for one with other letters than a-z, 0-9, _ and -."""
    name = F.concat(corpus, F.lit("__"), authority)
    return F.when(name.rlike("^[a-z0-9_-]+$"), name).otherwise(F.raise_error(F.concat(F.lit("unsafe partition name: "), name)))


def index_rows(sources: DataFrame, documents: DataFrame, chunks: DataFrame) -> DataFrame:
    """Chunks with what their document and source say: metadata of the chunk before the document's before the source's, partition, weight and citation."""
    s = sources.select("source_id", "source_type", "uri", F.col("version").alias("source_version"), F.col("commit_sha").alias("_sha"), F.col("metadata").alias("_m1"))
    d = documents.select("doc_id", "source_id", F.col("relative_path").alias("document_path"), F.col("title").alias("document_title"), F.col("metadata").alias("_m2"))
    rows = chunks.withColumnRenamed("metadata", "_m3").join(d, ["doc_id", "source_id"]).join(s, "source_id")
    keys = F.array_distinct(F.concat(*(F.map_keys(m) for m in ("_m1", "_m2", "_m3"))))
    rows = rows.withColumn("metadata", F.map_from_arrays(keys, F.transform(keys, lambda k: F.coalesce(F.col("_m3")[k], F.col("_m2")[k], F.col("_m1")[k]))))
    m = F.col("metadata")
    corpus, authority = partition(F.coalesce(m["source_type"], F.col("source_type")), F.col("document_path"), m["corpus"], m["authority"], m["record_kind"])
    rows = rows.withColumns({"corpus": corpus, "authority": authority, "source_commit_sha": F.coalesce("_sha", m["source_commit_sha"])})
    cited = F.when((F.col("corpus") == "official") & ~F.col("document_path").rlike("(?i)^https?://"), F.col("uri")).otherwise(F.col("document_path"))
    weight = F.coalesce(*(F.when(F.concat_ws("/", "corpus", "authority") == k, F.lit(w)) for k, w in WEIGHTS.items()), F.lit(1.0))
    return rows.select("chunk_id", "doc_id", "source_id", "ordinal", "content", "corpus", "authority", weight.alias("weight"), cited.alias("citation_source"), "document_path", "document_title", "source_version", "source_commit_sha", "metadata")


def search_result(rows: DataFrame) -> DataFrame:
    """What a search shows of index rows: source, lines (null below 1) and symbol from the first metadata key that has one."""
    m = F.col("metadata")
    text = lambda *xs: F.coalesce(*(F.when(F.trim(x) != "", x) for x in xs))
    line = lambda *xs: F.coalesce(*(F.when(F.expr("1") <= x.try_cast("int"), x.try_cast("int")) for x in xs))
    return rows.select(
        "chunk_id", "content", text(F.col("citation_source"), F.col("document_path"), F.lit("unknown-source")).alias("source"), "corpus", "authority",
        line(m["line_start"], m["chunk_line_start"]).alias("line_start"), line(m["line_end"], m["chunk_line_end"]).alias("line_end"), text(m["symbol_qualified_name"], m["symbol"], m["symbol_name"]).alias("symbol"), "metadata",
    )


def citations(results: DataFrame) -> DataFrame:
    """(.., citation_id, evidence_role, revision, branch, dirty, url, live_verified) of ranked results (qid, rank, source, corpus, authority, metadata)."""
    m = F.col("metadata")
    text = lambda *xs: F.coalesce(*(F.when(F.trim(x) != "", x) for x in xs))
    live = F.coalesce(m["live_verification"] == "true", F.lit(False))
    shown = F.when(live & (F.coalesce(m["relative_path"], F.lit("")) != ""), F.replace(m["relative_path"], F.lit("\\"), F.lit("/"))).otherwise(F.col("source"))
    role = F.coalesce(m["evidence_role"], evidence_role(live, F.col("corpus"), F.col("authority")))
    return results.select(
        "qid", "rank", F.concat(F.lit("E"), "rank").alias("citation_id"), shown.alias("source"), role.alias("evidence_role"), text(m["git_commit_sha"], m["source_commit_sha"], m["source_version"]).alias("revision"),
        text(m["git_branch"], m["current_branch"]).alias("branch"), (F.coalesce(m["git_dirty"], m["current_dirty"], m["source_dirty"], m["dirty"]) == "true").alias("dirty"),
        F.when(shown.rlike("(?i)^https?://"), shown).alias("url"), live.alias("live_verified"),
    )


def public(metadata: Column) -> Column:
    """Only the metadata that may be shown, without nulls."""
    return F.map_filter(metadata, lambda k, v: k.isin(*PUBLIC) & v.isNotNull())


def query_errors(queries: DataFrame, most: int = 1000, most_k: int = 50) -> DataFrame:
    """Queries (qid, query, top_k) with the text trimmed and an error: null if they may be run."""
    text = F.trim(F.col("query"))
    error = (
        F.when(text.isNull(), "query must be a string").when(text == "", "query is empty").when(F.length(text) > most, "query is too long").when(F.contains(text, F.lit("\0")), "query has a NUL")
        .when(~F.col("top_k").between(1, most_k) | F.col("top_k").isNull(), f"top_k must be between 1 and {most_k}")
    )
    return queries.withColumn("error", error).withColumn("query", text)


def coerced(predictions: DataFrame, aliases: dict[str, tuple[str, ...]]) -> DataFrame:
    """Each field from the first of its names that a column has and a row fills."""
    has = lambda names: [F.col(n) for n in names if n in predictions.columns]
    return predictions.select(*(F.coalesce(*has(names), F.lit(None)).alias(field) for field, names in aliases.items()))


def partition_summary(rows: DataFrame) -> DataFrame:
    """(corpus, authority, n, dims, ok) of index rows with an embedding: a partition has one dimension."""
    return rows.groupBy("corpus", "authority").agg(F.count(F.lit(1)).alias("n"), F.count_distinct(F.size("embedding")).alias("dims")).withColumn("ok", F.col("dims") == 1)


def store_stats(rows: DataFrame) -> DataFrame:
    """(num_entities, unique_chunk_ids, corpora) of a store."""
    return rows.agg(F.count(F.lit(1)).alias("num_entities"), F.count_distinct("chunk_id").alias("unique_chunk_ids"), F.array_join(F.array_sort(F.collect_set("corpus")), ",").alias("corpora"))


def artifact_errors(expected: DataFrame, artifacts: DataFrame) -> DataFrame:
    """(partition, error): what a published artifact lacks of what its build says (partition, rows, dimension, build_id, owner); a mismatch is never failed over."""
    a = artifacts.select("partition", *(F.col(c).alias(f"_{c}") for c in ("rows", "dimension", "build_id", "owner")), F.lit(True).alias("_there"))
    rows = expected.join(a, "partition", "left")
    differs = [F.when(~F.col(c).eqNullSafe(F.col(f"_{c}")), F.lit(c)) for c in ("rows", "dimension", "build_id", "owner")]
    error = F.when(F.col("_there").isNull(), F.array(F.lit("missing"))).otherwise(F.filter(F.array(*differs), lambda x: x.isNotNull()))
    return rows.select("partition", F.explode(error).alias("error"))


def artifact_name(prefix: Column, build_id: Column, token: Column, corpus: Column, authority: Column, most: int = 255) -> Column:
    """A name of its own for each build and partition: unsafe letters as _, at most ``most`` characters."""
    bare = F.regexp_replace(F.concat_ws("_", prefix, F.substring(F.sha2(build_id, 256), 1, 12), token, F.concat_ws("__", corpus, authority)), "[^A-Za-z0-9_]", "_")
    return F.substring(bare, 1, most)


def stale(listed: DataFrame, active: DataFrame, owner: str) -> DataFrame:
    """Artifacts (name, owner) of an owner that no active build (name) uses; others' are never touched."""
    return listed.where(F.col("owner") == owner).join(active.select("name"), "name", "left_anti")


def freshness(manifest: DataFrame, index: DataFrame) -> DataFrame:
    """(status, manifest_build_id, index_build_id) of one-row tables: ok, stale_index, or what is missing."""
    a, b = manifest.select(F.lit(1).alias("k"), F.col("build_id").alias("manifest_build_id")), index.select(F.lit(1).alias("k"), F.col("build_id").alias("index_build_id"))
    status = F.when(F.col("index_build_id").isNull(), "missing_index").when(F.col("manifest_build_id").isNull(), "missing_manifest").when(F.col("manifest_build_id") == F.col("index_build_id"), "ok").otherwise("stale_index")
    return a.join(b, "k", "full_outer").select(status.alias("status"), "manifest_build_id", "index_build_id")


def build_id(documents: DataFrame, settings: str) -> DataFrame:
    """(build_id): a hash of settings and of every document's identity and revision, whatever their order.

    Each document's hash is added up as two numbers modulo a prime, so any number of rows is summed in the tasks.
    """
    digest = F.sha2(F.concat_ws("\0", F.col("source_id").cast("string"), F.col("doc_id").cast("string"), F.col("content_hash")), 256)
    part = lambda k: F.conv(F.substring(digest, 1 + 12 * k, 12), 16, 10).cast("decimal(20,0)")
    total = lambda k: F.coalesce(F.sum(part(k)).cast("decimal(38,0)") % F.lit(2305843009213693951).cast("decimal(38,0)"), F.lit(0)).cast("string")
    return documents.agg(F.concat(F.lit("build_"), F.substring(F.sha2(F.concat_ws("|", F.lit(settings), F.count(F.lit(1)).cast("string"), total(0), total(1)), 256), 1, 24)).alias("build_id"))


def repeated_identities(documents: DataFrame) -> DataFrame:
    """(source_id, identity, n): documents of one source that would get one id."""
    return documents.groupBy("source_id", F.coalesce("identity", "relative_path").alias("identity")).agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def source_summary(documents: DataFrame) -> DataFrame:
    """(source_id, document_count, kinds) of each source."""
    return documents.groupBy("source_id").agg(F.count(F.lit(1)).alias("document_count"), F.array_join(F.array_sort(F.collect_set("kind")), ",").alias("kinds"))


def label_errors(samples: DataFrame) -> DataFrame:
    """(sample_id, error) of labelled questions (sample_id, answerable, relevant, primary, supporting, refusal_reason): sources in both roles, relevant ones that are not their union, answers without sources or refusals with them."""
    size = lambda c: F.coalesce(F.size(c), F.lit(0))
    checks = [
        (F.arrays_overlap("primary", "supporting"), "source in both roles"), (F.concat("primary", "supporting") != F.col("relevant"), "relevant is not primary and supporting"),
        (F.col("answerable") & (size("relevant") == 0), "answerable without sources"), (~F.col("answerable") & (size("relevant") > 0), "unanswerable with sources"), (F.col("answerable") == F.col("refusal_reason").isNotNull(), "refusal reason"),
    ]
    return samples.select("sample_id", F.explode(F.filter(F.array(*(F.when(F.coalesce(c, F.lit(False)), F.lit(e)) for c, e in checks)), lambda x: x.isNotNull())).alias("error"))
