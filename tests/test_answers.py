import re

from pyspark.sql import functions as F

from sievewright import plans
from sievewright.operators import answer
from sievewright.plans import corpus

DIR = "/root/testdata/sf0.01"


def test_guard_against_python(spark):
    got = {(r.conv_id, r.turn): (r.anchors, r.verdict) for r in plans.queries()["guard_check"](spark, DIR).collect()}
    for r in corpus._questions(spark, DIR).collect():
        found = re.findall(answer.TICKED, r.query) + re.findall(answer.ANCHOR, r.query)
        names = sorted({x.strip().lower() for x in found} - set(answer.GENERIC) - {""})
        gone = [x for x in names if x not in "the mcp server loads query.engine"]
        want = next((c for c, p in answer.UNSUPPORTED if re.search(f"(?i)(?:{p})", r.query)), "unsupported_anchor" if gone else "ok")
        assert got[r.conv_id, r.turn] == (",".join(names), want), r.query[:80]


def test_states_and_slots(spark):
    rows = spark.createDataFrame([(1, "a", 1, "x"), (1, "b", 2, "x"), (1, "c", 3, "y"), (2, "d", 1, "x")], "qid long, doc_id string, rank int, side string")
    moved = answer.both_sides(rows, "qid", "side", ("x", "y")).orderBy("qid", "rank")
    assert [r.doc_id for r in moved.collect()] == ["a", "c", "b", "d"]
    support = spark.createDataFrame([(1, "s", 9, "z")], rows.schema)
    placed = answer.place_support(rows, support, "qid", 2).orderBy("qid", "rank")
    assert [(r.doc_id, r["rank"]) for r in placed.collect()] == [("a", 1), ("s", 2), ("d", 1)]
    assert answer.place_support(rows, support, "qid", 1).count() == 2
    states = spark.createDataFrame([(False, "x", True), (True, None, False), (True, " ", False), (True, "x", True), (True, "x", False)], "s boolean, g string, v boolean")
    assert [r[0] for r in states.select(answer.state(F.col("s"), F.col("g"), F.col("v"))).collect()] == ["refused", "evidence_only", "fallback_empty_response", "model", "fallback_invalid_citations"]


def test_rerank_with_a_scorer(spark):
    rows = spark.createDataFrame([(1, "q", "aa", 5.0, 1), (1, "q", "a", 4.0, 2)], "qid long, query string, content string, score double, rank int")
    import pandas as pd

    def shorter(query: pd.Series, content: pd.Series) -> pd.Series:
        return -content.str.len().astype(float)

    assert answer.rerank(rows, 1, scorer=shorter).first().first_rank == 2
