"""The stored index: contents, scores by either way, checks, swap, roll-back, what is read."""

import math
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from sievewright.operators import bm25, common, dense, inverted, workspace
from sievewright.sources import catalog

DOCS = [
    (1, "QueryEngine.submit_message loads the checkpoint the the", "internal", "code", [1.0, 0.0]),
    (2, "the checkpoint is split into parts, parts and parts", "internal", "design", [0.6, 0.8]),
    (3, "official protocol of the tools", "official", "official", [0.0, 1.0]),
    (4, "", "internal", "code", None),
    (5, None, "internal", "design", [0.8, 0.6]),
    (6, "checkpoint 检查点 query_engine", "internal", "code", [0.0, -1.0]),
]
ASKED = [(1, "Where does submit_message load the checkpoint?"), (2, "parts of the protocol, parts"), (3, "nothing-here"), (4, "检查点 the")]


def docs(spark, rows=DOCS):
    return spark.createDataFrame(rows, "doc_id long, text string, corpus string, authority string, v array<double>")


@pytest.fixture(scope="module")
def root(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("index") / "root")
    inverted.publish(docs(spark), path, "first", vector="v")
    return path


def asked(spark):
    return inverted.query_terms(spark.createDataFrame(ASKED, "qid long, query string"))


def test_tables(spark, root):
    index = inverted.Index(spark, root)
    terms = bm25.tokenised(docs(spark)).select("doc_id", "tokens").collect()
    want = sorted((r.doc_id, t, n, len(r.tokens)) for r in terms for t, n in Counter(r.tokens).items())
    assert sorted(map(tuple, index.tables["postings"].select("doc_id", "term", "tf", "dl").collect())) == want
    assert {r.doc_id: r.dl for r in index.tables["documents"].collect()} == {r.doc_id: len(r.tokens) for r in terms}
    assert index.facts["build_id"] == "first" and index.keys == ("corpus", "authority")
    totals = {(r.corpus, r.authority): (r.n_docs, r.sum_dl) for r in index.tables["totals"].collect()}
    assert totals[("internal", "design")] == (2, next(len(r.tokens) for r in terms if r.doc_id == 2))


def test_tasks_of_a_build_do_not_grow_with_the_collection(spark, tmp_path, monkeypatch):
    """Texts are dealt by their bytes and postings by their rows, also where one term is in every document."""
    from pyspark.sql.functions import spark_partition_id

    monkeypatch.setattr(common, "DEALT_BYTES", 2000)
    monkeypatch.setattr(inverted, "SORTED_ROWS", 200)
    rows = [(i, f"hot words {'w%d ' % i * 9}", "internal", "code", None) for i in range(1200)]
    df = docs(spark, rows)
    size = sum(len(r[1]) for r in rows)
    parts = common.dealt(df, "doc_id", "text").groupBy(spark_partition_id().alias("p")).agg(F.sum(F.octet_length("text")).alias("n"))
    assert parts.count() >= 0.9 * size / 2000 and parts.agg(F.max("n")).first()[0] < 3 * 2000
    path = str(tmp_path / "root")
    inverted.publish(df, path, "one")
    postings = inverted.Index(spark, path).tables["postings"]
    files = {r.f: r.n for r in postings.groupBy(F.input_file_name().alias("f")).count().withColumnRenamed("count", "n").collect()}
    assert sum(files.values()) == postings.count() == 5 * 1200 and max(files.values()) < 2 * 200
    assert postings.where("term = 'hot'").select(F.input_file_name()).distinct().count() > 4


@pytest.mark.parametrize("cells", [inverted.MATRIX_CELLS, 0], ids=["matrix", "join"])
def test_scores_are_those_of_the_collection(spark, root, monkeypatch, cells):
    monkeypatch.setattr(inverted, "MATRIX_CELLS", cells)
    index, key = inverted.Index(spark, root), lambda r: tuple(r)
    whole = bm25.search(docs(spark), spark.createDataFrame(ASKED, "qid long, query string"), 3)
    got = index.ranked(asked(spark), 3).select(whole.columns)
    assert sorted(map(key, got.collect())) == sorted(map(key, whole.collect()))
    rows = bm25.tokenised(docs(spark), keep=("corpus", "authority"))
    terms = bm25.query_terms(spark.createDataFrame(ASKED, "qid long, query string"), "qid", "query")
    parted = bm25.scores(rows, terms, by=("corpus", "authority"))
    by = index.ranked(asked(spark), 9, by=("corpus", "authority")).select(parted.columns)
    assert sorted(map(key, by.collect())) == sorted(map(key, parted.collect()))
    allowed = spark.createDataFrame([(1, "internal", "code"), (2, "official", "official")], "qid long, corpus string, authority string")
    seen = index.ranked(asked(spark), 9, by=("corpus", "authority"), allowed=allowed).select(parted.columns)
    assert sorted(map(key, seen.collect())) == sorted(map(key, parted.join(allowed, ["qid", "corpus", "authority"], "left_semi").select(parted.columns).collect()))
    only = index.ranked(asked(spark), 9, keep=F.col("authority") == "code")
    assert {r.doc_id for r in only.collect()} <= {1, 4, 6} and only.count()
    with pytest.raises(ValueError):
        index.ranked(asked(spark), 3, k1=0)
    with pytest.raises(ValueError):
        index.ranked(asked(spark), 3, by=("lang",))


def test_only_buckets_of_the_terms_are_read(spark, tmp_path, monkeypatch):
    """With many buckets the scan of a query's postings is pruned to those of its terms, and to the partitions asked for."""
    monkeypatch.setattr(inverted, "BUCKET_ROWS", 1)
    inverted.publish(docs(spark), str(tmp_path / "i"), "b", vector="v")
    index = inverted.Index(spark, str(tmp_path / "i"))
    assert int(index.facts["buckets"]) > 10
    one = inverted.query_terms(spark.createDataFrame([(1, "protocol")], "qid long, query string"))
    found = index.ranked(one, 3, keep=F.col("corpus") == "official")
    assert [(r.doc_id, r["rank"]) for r in found.collect()] == [(3, 1)]
    plan = found._jdf.queryExecution().executedPlan().toString()
    filters = re.findall(r"PartitionFilters: \[([^\]]*)\]", plan)
    assert any("bucket" in f and "corpus" in f for f in filters), filters
    whole = inverted.Index(spark, str(tmp_path / "i")).ranked(asked(spark), 3)
    assert sorted(map(tuple, whole.collect())) == sorted(map(tuple, bm25.search(docs(spark), spark.createDataFrame(ASKED, "qid long, query string"), 3).select(whole.columns).collect()))


def test_nearest(spark, root):
    q = spark.createDataFrame([(7, [1.0, 0.0]), (8, None)], "qid long, query array<double>")
    index = inverted.Index(spark, root)
    assert [(r.doc_id, r.score) for r in index.nearest(q, 3).orderBy("rank").collect()] == [(1, 1.0), (5, 0.8), (2, 0.6)]
    by = index.nearest(q, 1, by=("corpus", "authority"))
    assert {(r.authority, r.doc_id) for r in by.collect()} == {("code", 1), ("design", 5), ("official", 3)}


def test_passes_over_the_collection(spark, monkeypatch):
    vectors = spark.createDataFrame([(i, [math.sin(i), math.cos(i)]) for i in range(40)], "id long, v array<double>")
    queries = spark.createDataFrame([(i, [math.cos(i), math.sin(3 * i)]) for i in range(9)], "qid long, query array<double>")
    once = dense.search(vectors, queries, 3, "id", "v", "qid", "query").collect()
    monkeypatch.setattr(dense, "PASS_VALUES", 4)
    assert sorted(map(tuple, dense.search(vectors, queries, 3, "id", "v", "qid", "query").collect())) == sorted(map(tuple, once))


@pytest.mark.parametrize(
    ("bad", "said"),
    [([(1, "again", "internal", "code", None)], "repeated id"), ([(None, "no id", "internal", "code", None)], "null id or key"), ([(9, "no key", None, "code", None)], "null id or key"), ([(9, "x", "internal", "code", [1.0])], "different dimensions")],
)
def test_a_bad_build_leaves_the_old_one(spark, tmp_path, bad, said):
    root = str(tmp_path / "i")
    inverted.publish(docs(spark), root, "good", vector="v")
    with pytest.raises(catalog.Rejected, match=said):
        inverted.publish(docs(spark, DOCS + bad), root, "bad", vector="v")
    assert inverted.Index(spark, root).facts["build_id"] == "good"
    assert [(r.build_id, r.state) for r in catalog.manifest(spark, root).orderBy("number").collect()] == [("good", "active"), ("bad", "rejected")]


def test_swap_roll_back_and_prune(spark, tmp_path):
    root = str(tmp_path / "i")
    with pytest.raises(FileNotFoundError):
        inverted.Index(spark, root)
    for n in (1, 2, 3):
        inverted.publish(docs(spark, DOCS[: n + 1]), root, f"b{n}")
    old = inverted.Index(spark, root)
    assert old.tables["documents"].count() == 4
    assert catalog.roll_back(spark, root) == "b2" and inverted.Index(spark, root).tables["documents"].count() == 3
    assert old.tables["documents"].count() == 4  # a reader keeps what it has opened
    gone = catalog.prune(spark, root, keep=2)
    assert len(gone) == 1 and "/b1-" in gone[0]
    catalog.prune(spark, root, keep=2, dry_run=False)
    assert not (tmp_path / "i" / gone[0].rsplit("/", 1)[1]).exists()
    assert inverted.Index(spark, root).facts["build_id"] == "b2"
    with pytest.raises(ValueError):
        only = str(tmp_path / "j")
        inverted.publish(docs(spark), only, "b")
        catalog.roll_back(spark, only)


def test_kept_tables_follow_their_input(spark, tmp_path):
    made = []

    def make(path):
        made.append(path)
        spark.range(1).write.parquet(path)

    source = str(tmp_path / "t.parquet")
    spark.range(3).write.parquet(source)
    first = workspace.kept(spark, "x", [source], make)
    assert workspace.kept(spark, "x", [source], make) == first and len(made) == 1
    spark.range(4).write.mode("overwrite").parquet(source)
    assert workspace.kept(spark, "x", [source], make) != first and len(made) == 2


def test_empty_collection(spark, tmp_path):
    inverted.publish(docs(spark, []), str(tmp_path / "i"), "none")
    assert inverted.Index(spark, str(tmp_path / "i")).ranked(asked(spark), 3).count() == 0


@pytest.mark.parametrize("held", [1 << 18, 40])
def test_tasks_send_the_best_only(spark, tmp_path, monkeypatch, held):
    """However many documents match, a task sends k a query and partition, also if queries see some partitions only."""
    rows = [(i, f"hot {'word ' * (i % 9)}w{i % 5}", "internal", ("code", "design")[i % 2], None) for i in range(600)]
    where = str(tmp_path / "root")
    inverted.publish(docs(spark, rows), where, "first")
    index, sent, k = inverted.Index(spark, where), [], 3
    terms = inverted.query_terms(spark.createDataFrame([(1, "hot word"), (2, "hot w3")], "qid long, query string"))
    allowed = spark.createDataFrame([(1, "internal", "code"), (2, "internal", "design")], "qid long, corpus string, authority string")
    by = ("corpus", "authority")
    monkeypatch.setattr(inverted, "BLOCK_VALUES", 100)  # blocks of a few documents
    monkeypatch.setattr(inverted, "HELD_ROWS", held)
    multiplied = index._multiplied
    index._multiplied = lambda *a: sent.append(multiplied(*a)) or sent[-1]
    found = sorted(map(tuple, index.ranked(terms, k, by=by, allowed=allowed).select("qid", "authority", "doc_id", "score", "rank").collect()))
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    assert held < 100 or sent[0].count() <= tasks * 2 * 2 * k
    monkeypatch.setattr(inverted, "MATRIX_CELLS", 0)
    joined = index.ranked(terms, k, by=by, allowed=allowed).select("qid", "authority", "doc_id", "score", "rank")
    assert found == sorted(map(tuple, joined.collect())) and len(found) == 2 * k


def test_terms_and_vectors_of_a_build_are_counted_in_one_pass(spark):
    """Counting shuffles nothing and has the tokens, and vectors the words, of the engine's expressions, on odd texts too."""
    from sievewright.functions.text import casefold, tokens
    from sievewright.plans import retrieval

    texts = ["QueryEngine.submit_message a-b HTTP2 HTTPServer2x 1.25 __x__ a//b C:\\\\d\\e", "检查点 检 x检查y", "Straße STRASSE İstanbul ΣΑΣ ſK", "a\x1cb a\u00a0b a\u2028b\x0bc\fd\r\ne", "", None, " \n", "😀x😀 y_Z9-Q:r"]
    rows = [(i, t, "internal", "code", None) for i, t in enumerate(texts)]
    df = docs(spark, rows)
    got = inverted.term_counts(df.select("doc_id", "corpus", "authority", "text"), inverted.KEYS)
    assert "Exchange" not in got._jdf.queryExecution().executedPlan().toString()
    want = sorted((r.doc_id, t, n, len(r.t)) for r in df.select("doc_id", tokens(F.col("text")).alias("t")).collect() for t, n in Counter(r.t).items())
    assert sorted(map(tuple, got.select("doc_id", "term", "tf", "dl").collect())) == want
    words = F.filter(F.split(casefold(F.coalesce("text", F.lit(""))), r"[ \t\n\r\f\x0b]+"), lambda w: w != "")
    bucket = lambda w: F.conv(F.substring(F.sha2(w, 256), 1, 2), 16, 10).cast("int") % retrieval.BUCKETS
    vectors = {r.doc_id: r.v for r in retrieval.hash_embedding(df.drop("v"), "doc_id", "text", "v").collect()}
    for r in df.select("doc_id", F.transform(words, bucket).alias("b")).collect():
        n = [r.b.count(k) for k in range(retrieval.BUCKETS)]
        size = math.sqrt(sum(x * x for x in n))
        assert vectors[r.doc_id] == ([x / size for x in n] if size else [1.0] + [0.0] * (retrieval.BUCKETS - 1))
