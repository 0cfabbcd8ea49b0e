import hashlib
import random
import re

import pytest

from sievewright.llm import fill_middle
from sievewright.llm.common import documents

SHA = lambda s: hashlib.sha256(s.encode()).hexdigest()


def brute(doc, text, draw="1"):
    text = text or ""
    units = re.findall(r"[A-Za-z]+|[^A-Za-z]", text)
    digits = SHA(f"{draw}:{'' if doc is None else doc}")
    h = [int(digits[k : k + 8], 16) for k in range(0, 32, 8)]
    n = len(units)
    if not text or any(s in text for s in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 90:
        return doc, n, "plain", None, None, SHA(text), SHA(text)
    lo, hi = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    p, m, s = ("".join(x) for x in (units[:lo], units[lo:hi], units[hi:]))
    form = "spm" if h[3] % 100 < 20 else "psm"
    out = f"<S>{s}<P>{p}<M>{m}" if form == "spm" else f"<P>{p}<S>{s}<M>{m}"
    return doc, n, form, len(p), len(m), SHA(out), SHA(text)


def key(row):
    return tuple((x is not None, x) if x is not None else (False, "") for x in row)


def test_documents_against_brute_force(spark):
    docs = documents(spark, "/root/testdata/sf0.01")
    got = [tuple(r) for r in fill_middle.op11_fill_middle(docs).collect()]
    assert sorted(got, key=key) == sorted((brute(r.doc_id, r.text) for r in docs.collect()), key=key)
    assert {r[2] for r in got} == {"plain", "psm", "spm"}


def test_odd_rows(spark):
    """Nulls, empty, sentinels and near-sentinels, characters beyond the BMP, repeated rows, clashing columns, a very long text."""
    texts = [None, "", "a", "\n", "<P>", "x<S>y", "x<M", "<", "<P", "S>x<", "<<P", "ab\U0001f600cd é\r\n  [`{@", "zz  zz" * 9, "a b" * 300_000, "q" * 700_000]
    rows = [(i if i != 3 else None, t, "x", t, 1) for i, t in enumerate(texts)] * 2 + [(100 + i, f"<{'PSM'[i % 3]}x word {i}<", "y", None, None) for i in range(60)]
    df = spark.createDataFrame(rows, "doc_id long, text string, form string, output string, n long")
    got = [tuple(r) for r in fill_middle.op11_fill_middle(df).collect()]
    assert sorted(got, key=key) == sorted((brute(r[0], r[1]) for r in rows), key=key)
    assert all(r[6] == SHA(t or "") for r, t in zip(sorted(got, key=key), [x[1] for x in sorted(rows, key=lambda r: key(brute(r[0], r[1])))], strict=True))


def test_empty_table(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert fill_middle.op11_fill_middle(empty).columns == ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output_sha256", "restored_sha256"]
    assert fill_middle.op11_fill_middle(empty).count() == 0


def test_every_cut_of_random_texts():
    rng = random.Random(3)
    for _ in range(400):
        text = "".join(rng.choice("ab Z9\n<é") for _ in range(rng.randrange(40)))
        units = re.findall(r"[A-Za-z]+|[^A-Za-z]", text)
        runs = fill_middle.encode(text)
        assert int(runs.units[-1]) == len(units)
        assert [fill_middle.offset(runs, u) for u in range(len(units) + 1)] == [len("".join(units[:u])) for u in range(len(units) + 1)]


def test_several_draws_share_the_runs(spark):
    rows = [(i, f"Some words, of text {i}! and more") for i in range(50)]
    got = fill_middle.transformed(spark.createDataFrame(rows, "doc_id long, text string"), ("1", "epoch 2")).collect()
    assert len(got) == 100
    for r in got:
        assert (r.n, r.form, r.prefix_chars, r.middle_chars, SHA(r.output)) == brute(r.doc_id, dict(rows)[r.doc_id], r.draw)[1:6]


@pytest.mark.parametrize("letters", [True, False])
def test_one_run(letters):
    runs = fill_middle.encode(("a" if letters else "-") * 10)
    assert (runs.letters, len(runs.start), int(runs.units[-1])) == (letters, 2, 1 if letters else 10)
