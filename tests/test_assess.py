import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from sievewright.operators import chunkers, evaluate, guards, ingest, legacy, manifest, responses, scoring
from sievewright.sources import files, html, units


def rows_of(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


def test_scores_of_a_hand_made_suite(spark):
    """Three questions: found second, found first, and one that must be refused."""
    samples = rows_of(spark, [("a",), ("b",), ("c",)], "sample_id string")
    truth = rows_of(spark, [("a", "primary", "core/engine.py"), ("b", "primary", "./Docs/guide.md"), ("b", "supporting", "https://h/x/")], "sample_id string, kind string, source string")
    results = rows_of(
        spark,
        [("s", "a", 1, "other.py", None, False), ("s", "a", 2, "C:\\repo\\Core\\engine.py", "pkg.Engine.run", True), ("s", "a", 3, "c:/repo/core/ENGINE.py", None, False), ("s", "b", 1, "docs/guide.md", None, False), ("s", "b", 2, "HTTPS://H/x#top", None, False)],
        "strategy string, sample_id string, rank int, source string, symbol string, live boolean",
    )
    got = {r.sample_id: r for r in scoring.scored(samples, truth, results, rows_of(spark, [("s",)], "strategy string"), 5).collect()}
    assert (got["a"].primary_recall, got["a"].reciprocal_rank, got["a"].citation_precision, got["a"].live_hit) == (1.0, 0.5, 0.5, True)
    assert got["a"].ndcg == pytest.approx(1 / math.log2(3)) and got["b"].ndcg == 1.0 and got["b"].supporting_recall == 1.0
    assert got["c"].hit is None and got["c"].ndcg is None and got["c"].citation_precision is None
    symbols = rows_of(spark, [("a", "Engine.run"), ("a", "Engine"), ("b", "x.y")], "sample_id string, symbol string")
    assert {r.sample_id: (r.n_symbols, r.n_matched) for r in scoring.symbol_recall(symbols, results, 5).collect()} == {"a": (2, 1), "b": (1, 0)}


def test_percentiles_of_many_values_and_ties(spark):
    rng = random.Random(2)
    values = [("x", rng.choice([rng.random(), 0.25, 3.0])) for _ in range(4000)] + [("y", 1.0), ("y", 2.0), ("y", 10.0), ("z", 5.0), ("w", None)]
    got = {r.g: r for r in evaluate.percentiles(rows_of(spark, values, "g string, v double").repartition(5), "v", ["g"]).collect()}
    assert set(got) == {"x", "y", "z"} and got["y"].p95 == 9.2 and got["z"].p50 == 5.0
    own = np.array([v for g, v in values if g == "x"])
    for name, q in (("p50", 50), ("p95", 95), ("p99", 99)):
        assert got["x"][name] == pytest.approx(np.percentile(own, q), abs=1e-6)


def test_holders_of_passages(spark):
    docs = [(1, "zero one two three four five six seven"), (2, "xzero one two three four five sixth"), (3, "one  two"), (4, None), (5, "a short"), (6, "one two three four five six\nseven")]
    asked = [(1, "zero one two three four five six"), (2, "short"), (3, "one two three four five six\nseven"), (4, "nowhere to be found in any of these"), (5, None), (6, "five six")]
    got = evaluate.holders(rows_of(spark, docs, "doc_id long, text string"), rows_of(spark, asked, "qid long, query string")).collect()
    want = {(q, d) for q, p in asked for d, t in docs if p and t and p in t}
    assert {(r.qid, r.doc_id) for r in got} == want and len(got) == len(want)


def test_bootstrap_draws_depend_on_the_question_alone(spark):
    rows = [(f"q{k}", 0.1 * (k % 7), 0.1 * (k % 7) + (0.3 if k % 3 else -0.1)) for k in range(60)] + [("none", None, 1.0)]
    df = rows_of(spark, rows, "id string, a double, b double")
    one, two = (evaluate.paired_bootstrap(x, "id", "a", "b", rounds=200).first() for x in (df, df.repartition(9)))
    assert one == pytest.approx(two) and one.n == 60 and one.ci_low < one.mean_delta < one.ci_high


def test_upsert_takes_the_last_of_repeated_keys_and_hashes_do_not_cancel(spark):
    old = rows_of(spark, [(1, "a", 0), (2, "b", 0)], "id long, rev string, n int")
    new = rows_of(spark, [(2, "x", 1), (2, "c", 2), (3, "d", 1), (1, "a", 3)], "id long, rev string, n int")
    got = {r.id: (r.rev, r.outcome) for r in ingest.upsert(old, new, "id", "rev", "n").collect()}
    assert got == {1: ("a", "skipped"), 2: ("c", "updated"), 3: ("d", "added")}
    h = lambda *xs: ingest.set_hash(rows_of(spark, [("s", x * 64) for x in xs], "s string, h string"), ["s"], "h").first().set_hash
    assert h("a", "a") != h("b", "b") and h("a", "b") == h("b", "a")


def test_recursive_pieces():
    text = "\n\n".join(" ".join(f"w{k}x{i}" for i in range(40)) for k in range(6))
    pieces = chunkers.recursive(text, 200, 40)
    assert all(0 < len(p) <= 200 for p in pieces) and all(w in " ".join(pieces) for w in text.split())
    assert chunkers.recursive("a" * 500, 100, 10)[0] == "a" * 100 and chunkers.recursive("", 10, 2) == [] and chunkers.recursive("x y", 10, 2) == ["x y"]
    assert chunkers.code_blocks("import a\n\n@b\ndef f():\n    return 1\n\nclass C:\n    x = 1\n") == ["def f():\n    return 1", "class C:\n    x = 1"]
    assert chunkers.code_blocks("def (") == ["def ("] and chunkers.code_blocks("x = 1") == ["x = 1"]


def test_paths_types_and_titles(spark):
    paths = ["src/a.py", "Node_Modules/a.py", "x/.cache/y", "conf/Token.json", ".env.local", "a/id_rsa", "k/site.PEM", "../a", "/abs", "a/token.md", "include/x.hpp", "q.sql", "Makefile", "a.markdown", "b.bin"]
    got = rows_of(spark, [(p,) for p in paths], "p string").select("p", files.safe_path(F.col("p")).alias("s"), files.file_type(F.col("p")).alias("t"), files.language(F.col("p")).alias("l")).collect()
    assert [r.p for r in got if r.s] == ["src/a.py", "a/token.md", "include/x.hpp", "q.sql", "Makefile", "a.markdown", "b.bin"]
    assert {r.p: r.t for r in got if r.s} == {"src/a.py": "code", "a/token.md": "markdown", "include/x.hpp": "code", "q.sql": "code", "Makefile": "code", "a.markdown": "markdown", "b.bin": "binary"}
    assert {r.l for r in got if r.p in ("include/x.hpp", "q.sql")} == {"cpp", "sql"}
    assert html.clean("<title>T x</title><main><p>body</p></main>") == ("T x", "# T x\n\nbody")
    assert html.clean("<title>T</title><main><h1>T</h1>body</main>")[1].startswith("# T\n") and html.clean("<title>T</title>")[1] == "# T"


def test_loaders_report_what_they_cannot_read(spark, tmp_path):
    assert units.parse_error("json", '{"a": 1}') is None and units.parse_error("json", "{") == "JSONDecodeError"
    assert units.parse_error("toml", "a = 1") is None and units.parse_error("toml", "a =") and units.parse_error("text", " ") == "empty" and units.parse_error("code", None) == "no text"
    df = rows_of(spark, [("a.json", "json", "[1"), ("b.md", "markdown", "# x")], "relative_path string, file_type string, content string")
    assert {r.relative_path: r.error for r in units.checked(df).collect()} == {"a.json": "JSONDecodeError", "b.md": None}
    (tmp_path / "ok.jsonl").write_text('{"id": "a", "n": 1}\n{"id": "b", "n": 2}\n')
    assert units.json_lines(spark, str(tmp_path / "ok.jsonl"), "id string, n int").count() == 2
    (tmp_path / "twice.jsonl").write_text('{"id": "a"}\n{"id": "a"}\n')
    with pytest.raises(ValueError, match="repeated"):
        units.json_lines(spark, str(tmp_path / "twice.jsonl"), "id string")


def test_guard_and_terms_by_hand(spark):
    ask = lambda q, split=False: rows_of(spark, [(q,)], "q string").select(guards.hard_anchors(F.col("q"), split).alias("a")).first().a
    assert ask("什么是 kubelet") == ["kubelet"] and ask("explain context/checkpoint handling") == ["context/checkpoint"]
    assert ask("handling of context/checkpoint", True) == ["context", "checkpoint"] and ask("see src/app/main.py", True) == ["src/app/main.py"]
    assert ask("`a/bcd` and `a/bcd`", True) == ["a/bcd"] and ask("one kubelet two widgets") == [] and ask("does the agent use kubelet") == ["kubelet"]
    terms = lambda q: rows_of(spark, [(q,)], "q string").select(guards.verification_terms(F.col("q"), F.array(F.lit("Engine.run")), F.array(F.lit("src/source.py"), F.lit("a/loader.py#x"))).alias("t")).first().t
    assert terms("where is `x_y` and Engine.run and engine.RUN") == ["x_y", "Engine.run"]
    assert terms("describe about system source method where") == ["describe", "system", "Engine.run", "loader"]


def test_builds_and_paths(spark):
    docs = rows_of(spark, [("s", f"d{k}", str(k)) for k in range(50)], "source_id string, doc_id string, content_hash string")
    assert manifest.build_id(docs, "v").first() == manifest.build_id(docs.repartition(6), "v").first() != manifest.build_id(docs, "w").first()
    assert manifest.build_id(docs.where("false"), "v").first().build_id.startswith("build_")
    with pytest.raises(Exception, match="unsafe partition name"):
        rows_of(spark, [("in/ternal", "code")], "c string, a string").select(manifest.partition_name(F.col("c"), F.col("a"))).collect()
    paths = rows_of(spark, [("/data/docs/eval.jsonl",), ("/data/docs2/eval.jsonl",), ("/data/docs",)], "path string")
    assert {r.path for r in responses.inside_corpus(paths, ["/data/docs/"]).collect()} == {"/data/docs/eval.jsonl", "/data/docs"}
    assert responses.leaks(rows_of(spark, [("a", "Ｆｕｌｌ  width?", "x"), ("b", "full width", "y")], "id string, question string, split string")).first().n == 2


def test_older_strategies(spark):
    assert legacy.condition_filter("NONE") == "" and legacy.condition_filter('a == "b"\n\n c == true ') == 'a == "b" and c == true'
    assert legacy.no_media(rows_of(spark, [(1,)], "qid long")).collect() == []
