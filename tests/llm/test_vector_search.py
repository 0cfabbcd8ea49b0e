import math
import random

import duckdb
import numpy as np
import pytest

from sievewright.llm import hard_negatives, queries, top_k, vector_blocks
from sievewright.llm.vector_blocks import LEAST, MOST, participating

DIR = "/root/testdata/sf0.001"
SCHEMA = "vec_id long, embedding array<double>, label int, id long, vector string"


def whole(v):
    return [math.floor(256 * float(x)) for x in v]


def taken(rows):
    return [r for r in rows if r[0] is not None and r[1] is not None and all(x is not None and math.isfinite(x) for x in r[1])]


def score(a, b):
    return min(MOST, max(LEAST, sum(x * y for x, y in zip(whole(a), whole(b), strict=False))))


def asking(rows, every):
    """One row an id: that with the least label and vector."""
    out = {}
    for r in rows:
        if r[0] % every == 0 and (r[0] not in out or (r[2], list(r[1])) < (out[r[0]][2], list(out[r[0]][1]))):
            out[r[0]] = r
    return out.values()


def brute_top(rows, k=5, every=50):
    rows, out = taken(rows), []
    for q in asking([(r[0], r[1], 0) for r in rows], every):
        best = sorted((-score(q[1], r[1]), r[0]) for r in rows if r[0] != q[0])[:k]
        out += [(q[0], n + 1, i, -s) for n, (s, i) in enumerate(best)]
    return sorted(out)


def brute_negatives(rows, every=100):
    rows = [(r[0], r[1], math.fmod(r[2] + 1, 10) if r[0] % 7 == 0 else r[2]) for r in taken(rows) if r[2] is not None]
    out = []
    for a in asking(rows, every):
        scored = sorted((-score(a[1], r[1]), r[0], r[2]) for r in rows if r[0] != a[0])
        for n, (p, i, _) in enumerate([s for s in scored if s[2] == a[2]][:5]):
            fits = [(x, j) for x, j, label in scored if label != a[2] and 30 * -p <= 100 * -x <= 90 * -p][:10]
            out += [(a[0], i, m + 1, j, -p, -x, n + 1) for m, (x, j) in enumerate(fits)]
    return sorted(out)


def frame(spark, rows):
    return spark.createDataFrame([(*r, 7, "x") for r in rows], SCHEMA).repartition(3)


def vectors(n, dim, seed, scale=1.0, grain=None):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, dim)) * scale
    return (np.round(x * grain) / grain if grain else x).tolist()


def odd_rows():
    """Ties in plenty, repeated rows and ids, nulls, non-finite components, other lengths."""
    rows = [(i, v, i % 4 if i % 11 else None) for i, v in enumerate(vectors(330, 6, 1, grain=2))]
    rows += rows[:120] + [(100, [9.0] * 6, 1), (None, [1.0] * 6, 1), (400, None, 1), (450, [1.0, None], 2), (500, [float("nan")] * 6, 2), (550, [float("inf")] + [0.0] * 5, 2), (600, [], 1), (650, [1.0, -1.0], 3), (700, [0.25] * 9, 0), (-700, [0.5] * 6, -3)]
    return rows


@pytest.fixture(params=[(1024, 32), (16, 1)], ids=["one pass", "many blocks and passes"])
def blocks(request, monkeypatch):
    monkeypatch.setattr(vector_blocks, "BLOCK_ROWS", request.param[0])
    real = vector_blocks.passes
    for module in (top_k, hard_negatives):
        monkeypatch.setattr(module, "passes", lambda *a: real(*a, group=request.param[1]))


def test_top_k_odd_rows(spark, blocks):
    rows = odd_rows()
    assert sorted(map(tuple, top_k.op12_top_k(frame(spark, rows)).collect())) == brute_top(rows)


def test_negatives_odd_rows(spark, blocks):
    rows = odd_rows()
    got = sorted(map(tuple, hard_negatives.op13_hard_negatives(frame(spark, rows)).collect()))
    assert got == brute_negatives(rows) and got


def test_pruning_loses_nothing(spark, blocks):
    """Clustered vectors of 64 components: most candidates go by a bound, and results are those of all pairs."""
    rng = random.Random(4)
    centres = vectors(12, 64, 2)
    rows = [(i, [c + rng.gauss(0, 0.2) for c in centres[i % 12]], i % 12) for i in range(600)]
    assert sorted(map(tuple, top_k.op12_top_k(frame(spark, rows)).collect())) == brute_top(rows)
    assert sorted(map(tuple, hard_negatives.op13_hard_negatives(frame(spark, rows)).collect())) == brute_negatives(rows)


@pytest.mark.parametrize("scale", [1e6, 1e12, 1e30])
def test_scores_beyond_doubles(spark, scale):
    """Products past 2**53 are exact; past a long they are the nearest long."""
    rows = [(i, v, i % 3) for i, v in enumerate(vectors(120, 5, 3, scale))]
    assert sorted(map(tuple, top_k.op12_top_k(frame(spark, rows)).collect())) == brute_top(rows)
    if scale < 1e12:
        assert sorted(map(tuple, hard_negatives.op13_hard_negatives(frame(spark, rows)).collect())) == brute_negatives(rows)
    else:
        hard_negatives.op13_hard_negatives(frame(spark, rows)).collect()


def test_empty_and_single(spark):
    for rows in ([], [(0, [1.0, 2.0], 1)], [(0, None, None)]):
        df = spark.createDataFrame([(*r, 7, "x") for r in rows], SCHEMA)
        assert top_k.op12_top_k(df).collect() == [] and hard_negatives.op13_hard_negatives(df).collect() == []


def test_bounds_are_below_distances():
    """Coarse bounds are below fine ones, and those below the distance, for any vectors."""
    for seed, dim in ((1, 64), (2, 50), (3, 7)):
        x = np.floor(256 * np.array(vectors(60, dim, seed)))
        stats = top_k.statistics(x)
        true = ((x[:, None] - x[None]) ** 2).sum(axis=2)
        at, last = 1, np.full(true.shape, -1.0)
        for n in top_k.levels(dim):
            own = stats[:, at : at + 2 * n]
            low = top_k.lower_bounds(own, own, stats[:, :1] + stats[:, 0])
            assert (low <= true + 1).all()
            if dim == 64:
                assert (low >= last - 1).all()
            at, last = at + 2 * n, low
        assert at == stats.shape[1]


def test_bounds_prune():
    """Of clustered vectors few pairs are multiplied."""
    rng = np.random.default_rng(8)
    centres = rng.normal(size=(40, 64)).cumsum(axis=1)
    x = np.floor(256 * (centres[np.arange(800) % 40] + rng.normal(size=(800, 64)) * 0.1))
    block = vector_blocks.Block(64, np.arange(800).tobytes(), np.zeros(800, np.int64).tobytes(), x.tobytes(), top_k.statistics(x).tobytes())
    true = vector_blocks.products(x, x)
    kth = np.sort(true, axis=1)[:, -6]
    row, col, found = top_k.survivors(block, block, kth)
    assert (found == true[row, col]).all()
    want = {(i, j) for i, j in zip(*np.nonzero(true >= kth[:, None]), strict=True) if i != j}
    assert set(zip(row.tolist(), col.tolist(), strict=True)) == want


@pytest.mark.parametrize("name", ["op11_fill_middle", "op12_top_k", "op13_hard_negatives"])
def test_queries_against_sql(spark, name):
    con = duckdb.connect()
    for table in ("documents", "embeddings"):
        con.sql(f"CREATE VIEW {table} AS SELECT * FROM read_parquet('{DIR}/{table}.parquet')")
    want = con.sql(queries.SQL[name])
    got = queries.queries()[name](spark, DIR).select(want.columns).collect()
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, want.fetchall())) and got


def test_other_names_and_no_label(spark):
    df = spark.createDataFrame([(1, [0.5], "a"), (2, [None], "b")], "k long, v array<float>, label string")
    assert [tuple(r) for r in participating(df, "k", "v").collect()] == [(1, 0, [0.5])]
