import random
import zlib

import numpy as np
import pytest

from sievewright.llm import token_files
from sievewright.llm.common import documents

from .test_packing import library


def expected(texts):
    coder, at, rows = library(), 0, []
    for i, text in sorted(texts):
        ids = np.array([*coder.encode(text or "", add_special_tokens=False).ids, 0], "<u4")
        rows.append((i, at, len(ids), zlib.crc32(ids.tobytes())))
        at += len(ids)
    return rows


def test_documents(spark):
    docs = documents(spark, "/root/testdata/sf0.01")
    assert sorted(map(tuple, token_files.op6_token_files(docs).collect())) == expected([(r.doc_id, r.text) for r in docs.collect()])


def test_random_access_and_damage(monkeypatch):
    monkeypatch.setattr(token_files, "FRAME_BYTES", 400)
    rng = random.Random(1)
    docs = [(3 * i, np.array([rng.randrange(50257) for _ in range(rng.randrange(1, 90))], "<u4").tobytes()) for i in range(50)]
    blob = token_files.encode_file((7, 1), docs)
    reads = []
    f = token_files.TokenFile(lambda at, n: reads.append(n) or blob[at : at + n], len(blob))
    assert f.shard == (7, 1)
    del reads[:]
    assert f.find(60)[0].tobytes() == docs[20][1] and f.find(61) == []
    assert len(reads) == 1 and reads[0] < len(blob) / 5
    for k, (_, raw) in enumerate(docs):
        assert f.document(k).tobytes() == raw
    bad = bytearray(blob)
    bad[20] ^= 1
    with pytest.raises(Exception):  # noqa: B017  zstandard's own error or the checksum's
        token_files.opened(bytes(bad)).document(0)


def test_small_files(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(token_files, "FILE_BYTES", 3000)
    rows = [(i, None if i % 7 == 0 else "word " * (i % 50)) for i in range(200)] + [(5, "word " * 5)]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as tie", "'v' as value").repartition(5)
    got = sorted(map(tuple, token_files.op6_token_files(df).collect()))
    assert got == expected(rows)
    assert token_files.op6_token_files(df.where("false")).collect() == []


def test_null_ids_follow_the_others(spark, monkeypatch):
    monkeypatch.setattr(token_files, "FILE_BYTES", 300)
    rows = [(i, "word " * (i % 20 + 1)) for i in range(-20, 40)] + [(2**63 - 1, "last"), (-(2**63), "first")]
    nameless = [None, "", "word", "word", "other words here", *("word " * k for k in range(2, 20))]
    df = spark.createDataFrame(rows + [(None, t) for t in nameless], "doc_id long, text string").repartition(5)
    got = sorted(map(tuple, token_files.op6_token_files(df).collect()), key=lambda r: r[1])
    want = expected(rows)
    assert got[: len(rows)] == want
    rest = got[len(rows) :]
    assert [r[0] for r in rest] == [None] * len(nameless)
    assert sorted(r[2:] for r in rest) == sorted(r[2:] for r in expected([(0, t or "") for t in nameless]))
    assert [r[1] for r in got] == np.cumsum([0, *(r[2] for r in got)])[:-1].tolist()
    only = token_files.op6_token_files(df.where("doc_id is null")).collect()
    assert sorted(r.ids_crc32 for r in only) == sorted(r[3] for r in rest)
    f = token_files.opened(token_files.encode_file((0, 0), [(3, b"abcd"), (None, b"efgh"), (None, b"ijkl")]))
    assert [x.tobytes() for x in f.find(None)] == [b"efgh", b"ijkl"] and f.find(3)[0].tobytes() == b"abcd" and f.find(0) == []
