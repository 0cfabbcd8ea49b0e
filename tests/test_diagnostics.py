import hashlib

import pytest

from sievewright.plans import corpus

FIRST = "x" * 450
SHAPES = [
    ("token = abc123", "token = [redacted]"), ("TOKEN=abc123", "TOKEN=[redacted]"), ("token:\t'abc123'", "token:\t[redacted]"), ('api_key: "abc123"', "api_key: [redacted]"), ("api-key=abc123", "api-key=[redacted]"),
    ("apikey=abc123", "apikey=[redacted]"), ("Secret = abc123", "Secret = [redacted]"), ("password=abc123", "password=[redacted]"), ("Authorization: Bearer abc123", "Authorization: [redacted]"), ("sent bearer abc123.x", "sent Bearer [redacted]"),
    ("key sk-abcd1234efgh", "key [redacted]"), ("key ghp_abcd1234efgh", "key [redacted]"), ("in /home/me/x", "in [home]/x"), ("in /Users/me/x", "in [home]/x"), ("plain words", "plain words"), ("", ""),
]


def digest(text):
    return None if text is None else hashlib.sha256(text.encode()).hexdigest()


@pytest.mark.parametrize("before", ["", FIRST + " "])
def test_every_document_and_secret_shape(spark, tmp_path, before):
    rows = [(k, before + text) for k, (text, _) in enumerate(SHAPES)] + [(-1, None), (0, before + SHAPES[0][0])]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    want = [(k, before + clean) for k, (_, clean) in enumerate(SHAPES)] + [(-1, None), (0, before + SHAPES[0][1])]
    got = sorted(map(tuple, corpus.diagnostics_redacted(spark, str(tmp_path)).collect()), key=str)
    assert got == sorted(((k, digest(t and t[:400] or t), digest(t)) for k, t in want), key=str)
