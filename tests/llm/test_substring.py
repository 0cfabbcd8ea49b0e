import hashlib
import re

import pytest

from sievewright.llm import common, substring
from sievewright.llm.common import documents


def brute(rows, window):
    words = [(i, re.findall(r"[^\x20\x09-\x0D]+", t or "")) for i, t in rows]
    least = {}
    for i, w in words:
        for at in range(len(w) - window + 1):
            key = tuple(w[at : at + window])
            least[key] = min(least.get(key, i), i)
    out = []
    for i, w in words:
        gone = set()
        for at in range(len(w) - window + 1):
            if least[tuple(w[at : at + window])] < i:
                gone.update(range(at, at + window))
        kept = " ".join(x for k, x in enumerate(w) if k not in gone)
        out.append((i, len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return sorted(out)


def test_documents_against_brute_force(spark):
    docs = documents(spark, "/root/testdata/sf0.01")
    expected = brute([(r.doc_id, r.text) for r in docs.collect()], 50)
    assert sorted(map(tuple, substring.op10_substring(docs).collect())) == expected
    assert sum(r[2] > 0 for r in expected) > 20


@pytest.mark.parametrize(("hot", "target"), [(20_000, 20_000), (5, 1), (5, 20_000)])
def test_small_windows_and_hot_minimisers(spark, monkeypatch, hot, target):
    """Minimisers in buckets; dealt by window, known by the join; dealt by window, known by the list."""
    import random

    rng = random.Random(5)
    passage = [f"p{i}" for i in range(40)]
    rows = []
    for i in range(400):
        body = [rng.choice("abcdefgh") * rng.randrange(1, 3) for _ in range(rng.randrange(60))]
        at = rng.randrange(len(body) + 1)
        rows.append((i, " ".join(body[:at] + (passage if i % 2 else []) + body[at:])))
    rng.shuffle(rows)
    real, listed = substring.shared_minimisers, []
    monkeypatch.setattr(substring, "shared_minimisers", lambda t, w, m, *_: (x := real(t, w, m, hot, target), listed.extend(x[1]))[0])
    monkeypatch.setattr(substring, "FLUSH_BYTES", 2000)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(7)
    got = sorted(map(tuple, substring.deduplicated(df, 8, 3).collect()))
    assert got == brute(rows, 8)
    assert bool(listed) == (hot == 5 and target > 1)


def test_batches_of_one_text(spark, monkeypatch):
    """A passage is found though no batch holds it twice."""
    passage = " ".join(f"p{i}" for i in range(60))
    rows = [(i, " ".join(f"w{i}x{k}" for k in range(70)) + " " + passage) for i in range(60)]
    monkeypatch.setattr(common, "BATCH_ROWS", 1)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    assert sorted(map(tuple, substring.deduplicated(df).collect())) == brute(rows, 50)


def test_repeated_ids(spark):
    """Rows of one doc_id do not cover one another; their rows share the ranges found, cut at their length."""
    one, two = (" ".join(f"{c}{k}" for k in range(80)) for c in "ab")
    rows = [(2, one), (2, one), (2, two[:20]), (3, one), (None, one)]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "'x' as key", "1 as cold", "2 as hot")
    got = [(r.doc_id, r.n_words, r.n_removed) for r in substring.op10_substring(df).collect()]
    assert sorted(got, key=str) == [(2, 7, 0), (2, 80, 0), (2, 80, 0), (3, 80, 80), (None, 80, 0)]


def test_odd_rows(spark):
    long = " ".join(f"w{i % 977}" for i in range(60000))
    rows = [(3, None), (1, ""), (2, "a b"), (5, long), (4, long), (9, long[5000:])]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as ranges", "2 as bucket")
    assert sorted(map(tuple, substring.op10_substring(df).collect())) == brute(rows, 50)
    assert substring.op10_substring(df.where("false")).collect() == []
    kept = {r.doc_id: r.text for r in substring.deduplicated(df, keep_text=True).collect()}
    assert kept[3] is None and kept[2] == "a b" and kept[5] == ""


def test_long_repetitive_texts_need_little_memory():
    """Two texts of a million equal words, through what a task sends and what a bucket does with it, within 1 GB."""
    import subprocess
    import sys

    code = """
import resource
import numpy as np, pyarrow as pa
from sievewright.llm import substring as s
n = 1_000_000
text = b"a " * n
keys, first, sizes = s.runs(text.split(), 50, 5)
assert sizes.max() <= 46 and sizes.sum() == n - 49 and len(set(keys.tolist())) == 1
key = int(keys.view(np.int64)[0])
for hot in (True, False):
    part = text if hot else text[: 2 * 46 * 1000]  # cold ones are 2,000 super-k-mers at most
    rows = pa.RecordBatch.from_arrays([pa.array([1, 2]), pa.array([part, part]), pa.array([[] if hot else [key]] * 2, pa.list_(pa.int64())), pa.array([[key] if hot else []] * 2, pa.list_(pa.int64()))], ["doc_id", "text", "cold", "hot"])
    batches = list(s._send(50, 5, [])(iter([rows.slice(0, 1)]))) + list(s._send(50, 5, [])(iter([rows.slice(1, 1)])))
    both = pa.Table.from_batches(batches).sort_by([("key", "ascending"), ("hot", "ascending"), ("tie", "ascending"), ("doc", "ascending")])
    got = {}
    for out in s._meet(50)(iter(both.to_batches())):
        for doc, ranges in zip(*(c.to_pylist() for c in out.columns)):
            got.setdefault(doc, []).extend(map(tuple, np.frombuffer(ranges, np.int64).reshape(-1, 2).tolist()))
    assert {d: s.merged(r) for d, r in got.items()} == {2: [(0, len(part) // 2)]}, {d: r[:3] for d, r in got.items()}
    one = list(s._send(50, 5, [])(iter([rows])))  # both in one task
    known = {}
    for out in one:
        for k, doc, ranges in zip(*(out.column(c).to_pylist() for c in ("key", "doc", "starts"))):
            if k is None:
                known.setdefault(doc, []).extend(map(tuple, np.frombuffer(ranges, np.int64).reshape(-1, 2).tolist()))
print(resource.getrusage(resource.RUSAGE_SELF).ru_maxrss // 1024)
"""
    done = subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, cwd=__file__.rsplit("/tests/", 1)[0], check=False)
    assert done.returncode == 0, done.stderr[-2000:]
    assert int(done.stdout) < 1000


def test_repetitive_texts_against_brute_force(spark, monkeypatch):
    import random

    rng = random.Random(9)
    rows = []
    for i in range(60):
        parts = [rng.choice(["a", "a b", "a b c", "x y"]).split() * rng.randrange(30) for _ in range(rng.randrange(4))]
        rows.append((i % 50, " ".join(w for p in parts for w in p)))
    monkeypatch.setattr(substring, "FLUSH_BYTES", 3000)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    alone = [r for r in rows if sum(x[0] == r[0] for x in rows) == 1]
    for hot in (20_000, 3):
        real = substring.shared_minimisers
        with monkeypatch.context() as m:
            m.setattr(substring, "shared_minimisers", lambda t, w, k, *_, hot=hot: real(t, w, k, hot, 20_000))
            got = {tuple(r) for r in substring.deduplicated(df, 8, 3).collect()}
            single = {tuple(r) for r in substring.deduplicated(spark.createDataFrame(alone, "doc_id long, text string"), 8, 3).collect()}
        assert single == set(brute(alone, 8)) and len(got) > 0
