import pytest
from pyspark.sql import functions as F

from sievewright.functions.text import canonical_url, redacted, tidy, tokens
from sievewright.operators import bm25, dense, evaluate, evidence, fusion, guards, routing, sqltool


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


def test_tokens(spark):
    cases = {
        "QueryEngine.submit_message": ["queryengine.submit_message", "queryengine", "query", "engine", "submit_message", "submit", "message"],
        "HTTP2 the a-b": ["http2", "htt", "2", "the", "a-b", "a", "b"],
        "检查点": ["检查点", "检查", "查点"],
        "Straße 1.25": ["stra", "e", "1.25", "1", "25"],
        "": [],
    }
    for text, want in cases.items():
        assert one(spark, tokens(F.lit(text))) == want, text
    assert one(spark, tokens(F.lit(None).cast("string"))) == []


def test_bm25_ranks_the_code_line_first(spark):
    docs = spark.createDataFrame(
        [("core/query_engine.py", "QueryEngine.submit_message loads the latest checkpoint"), ("mcp/tools.md", "the official protocol describes tools"), ("zh.md", "检查点保存在文件中"), ("empty", None)], "doc_id string, text string"
    )
    asked = spark.createDataFrame([(1, "Where does submit_message load a checkpoint?"), (2, "保存"), (3, "nothing-here")], "qid long, query string")
    found = bm25.search(docs, asked, 2).orderBy("qid", "rank").collect()
    assert found[0].doc_id == "core/query_engine.py" and found[0].score > 0
    assert [r.doc_id for r in found if r.qid == 2] == ["zh.md"] and not [r for r in found if r.qid == 3]
    with pytest.raises(ValueError):
        bm25.search(docs, asked, 2, k1=0)


def test_fusion(spark):
    rows = [(1, 0, "dense", "a.py", 1, 0.5), (1, 0, "dense", "b.py", 2, 0.4), (1, 1, "bm25", "a.py", 1, 9.0), (1, 1, "bm25", "c.py", 2, 3.0)]
    df = spark.createDataFrame(rows, "qid long, list_no int, retriever string, item string, rank int, score double")
    found = fusion.fuse(df, ["qid"], "item", top_k=3).orderBy("rank").collect()
    assert [r.item for r in found] == ["a.py", "b.py", "c.py"]
    assert found[0].fused == pytest.approx(2 / 61, abs=1e-9) and found[0].contributors == ["dense", "bm25"] and found[0].best_list == 1
    assert fusion.fuse(df, ["qid"], "item", top_k=0).count() == 0
    twice = df.where("list_no = 0").unionByName(df.where("list_no = 0 and item = 'b.py'"))
    assert fusion.fuse(twice, ["qid"], "item").orderBy("rank").first().item == "b.py"


def test_dense(spark):
    v = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.6, 0.8]), (3, [0.6, 0.8]), (4, None)], "id long, v array<float>")
    q = spark.createDataFrame([("x", [0.0, 1.0])], "qid string, query array<float>")
    assert [(r.id, r["rank"]) for r in dense.search(v, q, 2, "id", "v", "qid", "query").orderBy("rank").collect()] == [(2, 1), (3, 2)]
    assert dense.search(v, q.where("false"), 2, "id", "v", "qid", "query").count() == 0


def test_routing(spark):
    cases = {
        "Where is QueryEngine.submit_message implemented?": "implementation", "Why was the architecture split?": "design", "What does the official MCP specification say?": "official", "weather forecast": "out_of_scope",
        "compare the current repo with the official MCP spec": "comparison", "": "out_of_scope", "what is langchian": "official", "hello": "design",
    }
    for q, want in cases.items():
        assert one(spark, routing.intent(F.lit(q))) == want, q
    assert one(spark, routing.normalised(F.lit("what is `langchian`"))) == "what is `langchian`"
    assert one(spark, routing.intent(F.lit("about acme"), ("acme",))) == "implementation"


def test_evidence(spark):
    kept, valid = evidence.citations(F.lit("a [E2] b [E1] [E2] [E9]"), F.array(F.lit("E1"), F.lit("E2")))
    assert one(spark, kept) == ["E2", "E1"] and one(spark, valid) is False
    empty = F.array().cast("array<string>")
    assert one(spark, guards.verification_terms(F.lit("`x.y` or load_it.now"), empty, empty)) == ["x.y", "load_it.now"]
    assert one(spark, evidence.contract(F.lit("comparison"), F.array(F.lit("external_normative")))) == "missing_comparison_evidence"


def test_metrics_fixture(spark):
    queries = spark.createDataFrame([(1,), (2,), (3,)], "qid long")
    found = spark.createDataFrame([(1, "a", 1), (2, "x", 1), (2, "b", 2)], "qid long, doc_id string, rank int")
    relevant = spark.createDataFrame([(1, "a", 2), (2, "b", 2)], "qid long, doc_id string, grade int")
    rows = evaluate.ranking_metrics(queries, found, relevant, 5)
    assert rows.agg(F.avg("reciprocal_rank")).first()[0] == 0.75
    assert rows.where("qid = 3").first().hit is None
    p = evaluate.percentiles(spark.createDataFrame([(2.0, 1), (3.0, 1), (1.0, 1)], "v double, k int"), "v", ["k"]).first()
    assert (p.p50, p.p95, p.p99) == (2.0, 2.9, 2.98)
    pairs = spark.createDataFrame([(k, 0.0 if k < 30 else 1.0, 1.0) for k in range(40)] + [(99, None, 1.0)], "id long, a double, b double")
    ci = evaluate.paired_bootstrap(pairs, "id", "a", "b", 200).first()
    assert ci.n == 40 and ci.mean_delta == 0.75 and 0.5 < ci.ci_low < 0.75 < ci.ci_high < 0.95


def test_sql_guard(spark):
    for bad in ("DROP TABLE t", "select 1; select 2", "with x as (select 1) delete from x", "explain select 1", "insert into t select 1"):
        with pytest.raises(ValueError):
            sqltool.guard(bad)
    assert sqltool.execute(spark, "SELECT 'drop' AS updated_at;").first()[0] == "drop"
    tried = []
    out = sqltool.text_to_sql(spark, "q", lambda q, e: tried.append(e) or ("select nope" if len(tried) < 2 else "select 1 as x"))
    assert out.first().x == 1 and tried[0] is None and tried[1]
    df = spark.createDataFrame([("x", True)], "a string, b boolean")
    assert df.where(sqltool.matches(sqltool.filter_text(a="x", b=True), df.columns)).count() == 1
    assert df.where(sqltool.matches("missing == 1", df.columns)).count() == 0


def test_text(spark):
    assert one(spark, tidy(F.lit(" a \r\n\r\n\r\n b\t c "))) == "a\n\nb c"
    assert one(spark, canonical_url(F.lit("HTTPS://Ex.COM:443#f"))) == "https://ex.com/"
    assert "abc123" not in one(spark, redacted(F.lit("token = abc123 and Bearer zzz in /home/me/x")))


@pytest.mark.parametrize("kind", ["long", "string"])
def test_scores_of_a_task_are_held_in_blocks(monkeypatch, kind):
    """No block of scores has more than CELLS; ties go by id and NaN is the largest, as in SQL."""
    import numpy as np
    import pandas as pd

    monkeypatch.setattr(dense, "CELLS", 600)
    sizes, real = [], np.round
    monkeypatch.setattr(dense.np, "round", lambda x, n: sizes.append(x.size) or real(x, n))
    rng = np.random.default_rng(2)
    vectors = rng.integers(-2, 3, (500, 4)).astype(float)
    vectors[77, 1] = np.nan
    ids = [i if kind == "long" else f"v{i:03}" for i in rng.permutation(500).tolist()]
    asked = rng.integers(-2, 3, (40, 4)).astype(float)
    frames = [pd.DataFrame({"id": ids[at : at + 120], "v": list(vectors[at : at + 120])}) for at in range(0, 500, 120)]
    got = pd.concat(list(dense._scored(iter(frames), list(range(40)), asked, 6, 6, [])))
    for q in range(40):
        score = real(vectors @ asked[q], 6)
        want = sorted(zip(score, ids, strict=True), key=lambda x: (not np.isnan(x[0]), -x[0] if x[0] == x[0] else 0, x[1]))[:6]
        assert got[got.qid == q].id.tolist() == [i for _, i in want]
    assert max(sizes) <= 600 and len(got) == 240
