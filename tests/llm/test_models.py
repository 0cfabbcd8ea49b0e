"""Held-out accuracy and edge cases of the learned operators."""

import itertools
import zlib

import numpy as np

from sievewright.llm import common, langid, toxicity
from sievewright.llm.common import documents

ODD = [(-1, None), (-2, ""), (-3, "1 2 3 !"), (-4, "the " * 30000), (-5, "x" * 5000), (-6, "\n")]


def with_odd(spark, docs):
    odd = spark.createDataFrame([(i, t, None, None, None) for i, t in ODD], docs.schema)
    return docs.unionByName(odd).selectExpr("*", "1 as score", "2 as toxic", "'z' as x")


def test_toxicity_on_held_out_rows(spark):
    sf = "/root/testdata/sf0.1"
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    docs = with_odd(spark, documents(spark, sf))
    rows = {r.doc_id: r for r in toxicity.op7_toxicity(docs, labels).collect()}
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) and r.held_out == (zlib.crc32(str(i).encode()) % 3 == 1) for i, r in rows.items())
    assert all(rows[i].predicted == 0 for i, _ in ODD)
    truth = [(rows[r.doc_id].predicted, r.toxic) for r in labels.collect() if rows[r.doc_id].held_out]
    hits = sum(p and t for p, t in truth)
    assert hits >= 0.85 * sum(t for _, t in truth) and sum(p and not t for p, t in truth) <= 0.01 * len(truth)


def test_toxicity_without_labels(spark):
    docs = spark.createDataFrame([(1, "you are an idiot and a clown"), (2, "a fine day"), (3, None)], "doc_id long, text string")
    none = spark.createDataFrame([(1, None, None)], "doc_id long, quality int, toxic int")
    got = {r.doc_id: r.predicted for r in toxicity.op7_toxicity(docs, none).collect()}
    assert got == {1: 1, 2: 0, 3: 0}
    assert toxicity.op7_toxicity(docs.where("false"), none.where("false")).collect() == []


def test_toxicity_patterns_without_other_hits(spark):
    """Each pattern of address alone, in a short and in a long text, and as a voter of its own in a fitted model."""
    model = toxicity.Model({w: k for k, w in enumerate(toxicity.SEED_WORDS)}, {}, list(toxicity.SEED_PATTERNS))
    for k, text in enumerate(["you're such a clown", "Shut up", "GO TO HELL"]):
        assert model.hits((text + " now" + " fine" * 5000).encode())[0][len(toxicity.SEED_WORDS) + k] == 1
    assert model.hits(b"you are all idiots")[0] == {len(toxicity.SEED_WORDS): 1}  # no word of the lexicon, only the pattern
    assert not model.hits(b"shut upwards, you are here, go to hello")[0] and not model.hits(None)[0]
    texts = ["go to hell", "shut up", "you are all idiots", "go to work", None]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    none = spark.createDataFrame([(1, None, None)], "doc_id long, quality int, toxic int")
    got = {r.doc_id: r.predicted for r in toxicity.op7_toxicity(docs, none).collect()}
    assert got == {0: 1, 1: 1, 2: 1, 3: 0, 4: 0}


def test_label_model_finds_the_accurate_voters():
    rng = np.random.default_rng(1)
    y = rng.random(4000) < 0.1
    good = np.column_stack([np.where(y, rng.random(4000) < 0.6, rng.random(4000) < 0.01) for _ in range(4)])
    copy = np.repeat((rng.random(4000) < 0.05)[:, None], 3, axis=1)  # three voters that only repeat one another
    given = np.where(rng.random(4000) < 0.3, y, -1)
    post = toxicity.label_model(np.column_stack([good, copy]), given, np.ones(4000))
    # a voter that does not fire abstains, so one chance hit weighs much; two of the good ones settle it
    sure = good.sum(axis=1) >= 2
    assert ((post > 0.5) == y)[sure].mean() > 0.97
    alone = copy[:, 0] & ~good.any(axis=1) & (given < 0)
    assert alone.sum() > 50 and post[alone].mean() < 0.5 < post[sure].mean()


def test_language_on_held_out_rows(spark):
    docs = with_odd(spark, documents(spark, "/root/testdata/sf0.01"))
    rows = {r.doc_id: r for r in langid.op9_langid(docs).collect()}
    assert [rows[i].lang_pred for i in (-1, -2, -3, -6)] == ["und"] * 4 and rows[-1].score == 0
    assert rows[-4].lang_pred == "en" and all(0 <= r.score <= 1 for r in rows.values())
    held = [(rows[r.doc_id].lang_pred, r.lang) for r in docs.collect() if r.lang and rows[r.doc_id].held_out]
    assert sum(a == b for a, b in held) >= 0.98 * len(held) > 100


def test_language_without_labels(spark):
    docs = spark.createDataFrame([(1, "hello", None)], "doc_id long, text string, lang string")
    assert [r.lang_pred for r in langid.op9_langid(docs).collect()] == ["und"]
    assert langid.op9_langid(docs.where("false")).collect() == []


def test_forward_sums_all_segmentations():
    names = ["▁", "▁a", "a", "b", "ab", "ba", "▁ab", "aba"]
    known = {p: k for k, p in enumerate(names)}
    p = np.linspace(0.05, 0.2, len(names))[:, None]
    word = "▁ababa"
    total = 0.0
    for cuts in itertools.product([0, 1], repeat=len(word) - 1):
        edges = [0, *(k + 1 for k, c in enumerate(cuts) if c), len(word)]
        parts = [word[a:b] for a, b in itertools.pairwise(edges)]
        if all(x in known for x in parts):
            total += float(np.prod([p[known[x], 0] for x in parts]))
    assert np.isclose(langid.forward(word, known, p)[0], np.log(total))
    scorer = langid.Scorer(names, np.column_stack([p, p[::-1]]), 6)
    for words in ({word, "▁a", "a☃b"}, {"▁a", "ab", "▁", "b", "aba", "ba"}):
        scorer.learn_words(words)
        for w in words:
            assert np.allclose(scorer.total([w, w]), 2 * langid.forward(w, known, np.column_stack([p, p[::-1]])))
    into = {}
    langid.expected(word, known, 4, p[:, 0].tolist(), 1.0, into)
    assert np.isclose(sum(n * len(names[k]) for k, n in into.items()), len(word))
    exact, weights = {}, []
    for cuts in itertools.product([0, 1], repeat=len(word) - 1):
        edges = [0, *(k + 1 for k, c in enumerate(cuts) if c), len(word)]
        parts = [word[a:b] for a, b in itertools.pairwise(edges)]
        if all(x in known for x in parts):
            weights.append(float(np.prod([p[known[x], 0] for x in parts])))
            for x in parts:
                exact[known[x]] = exact.get(known[x], 0) + weights[-1]
    assert all(np.isclose(n, exact[k] / sum(weights)) for k, n in into.items())


def test_long_words_and_long_pieces():
    """Whole words and whole pieces: nothing is cut at a length, and nothing underflows."""
    assert max(map(len, langid.pieces())) > 8
    names = ["▁", "a", "b", "abababababab"]
    known, p = {x: k for k, x in enumerate(names)}, np.array([[0.2, 0.2], [0.3, 0.1], [0.1, 0.3], [0.4, 0.4]])
    for word in ["▁" + "ab" * 40, "▁" + "ab" * 15, "▁" + "☃" * 60 + "a" * 900, "▁" + "b" * 3000]:
        got = langid.forward(word, known, p)
        assert np.isfinite(got).all() and got[0] != got[1] or word.count("a") == word.count("b")
        scorer = langid.Scorer(names, p)
        scorer.learn_words({word})
        assert np.allclose(scorer.total([word]), got)
    a, b = langid.forward("▁" + "☃" * 400 + "a", known, p)
    assert np.isclose(a - b, np.log(0.3 / 0.1))
    assert np.isclose(langid.forward("▁" + "a" * 2000, known, p)[0], np.log(0.2) + 2000 * np.log(0.3))
    into = {}
    langid.expected("▁" + "ab" * 2000, known, 12, p[:, 0].tolist(), 2.0, into)
    assert np.isclose(sum(n * len(names[k]) for k, n in into.items()), 2 * 4001)


def test_words_are_runs_of_letters(spark):
    assert langid.words_of("½ ² Ⅷ 12 a_b x½y") == ["▁a", "▁b", "▁x", "▁y"]
    rows = [(1, "hello there", "en"), (2, "hello there", "en"), (2, "hello there", "en"), (3, "½ ² Ⅷ", None), (4, "bonjour", "fr"), (6, "bonjour", "fr"), (None, "hello", None)]
    got = [(r.doc_id, r.lang_pred) for r in langid.op9_langid(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()]
    assert sorted(got, key=str) == sorted([(1, "en"), (2, "en"), (2, "en"), (3, "und"), (4, "fr"), (6, "fr"), (None, "en")], key=str)


def test_samples_are_the_least_hashes_at_any_size(spark):
    """Bounded numbers, never a share of the table that could round to nothing; ids repeated very often count once or are cut."""
    docs = spark.range(5000).selectExpr("id as doc_id", "concat('w', id) as text", "if(id % 3 = 0, 'aa', 'bb') as lang")
    hot = docs.unionByName(spark.range(3000).selectExpr("7L as doc_id", "'same' as text", "'bb' as lang")).repartition(6)
    want = [r.doc_id for r in docs.selectExpr("doc_id", "xxhash64(doc_id) as h").orderBy("h").limit(20).collect()]
    assert [r.doc_id for r in toxicity.least_hashed(hot, 20).collect()] == want
    assert common.hash_bound(10**11, 10_000) > -(1 << 63) and common.hash_bound(10**15, 800) > -(1 << 63) and common.hash_bound(5, 800) == (1 << 63) - 1
    found = langid.sampled(hot, 30).groupBy("lang").count().collect()
    assert {r.lang: r["count"] for r in found} == {"aa": 30, "bb": 30}
    labels = spark.range(5000).selectExpr("id as doc_id", "0 as quality", "if(id % 2 = 0, 1, null) as toxic")
    rows = toxicity.sampled(hot, labels, 50, 40).collect()
    assert sum(r.toxic == 1 for r in rows) == 50 and 0 < sum(r.toxic == -1 for r in rows) <= 40
    assert all(zlib.crc32(str(r.doc_id).encode()) % 3 != 1 for r in rows) and len({r.doc_id for r in rows}) == len(rows)


def test_unlabelled_texts_reach_the_label_model(spark, monkeypatch):
    seen = []
    real = toxicity.label_model
    monkeypatch.setattr(toxicity, "label_model", lambda fires, given, times: seen.append(times[given < 0].sum()) or real(fires, given, times))
    docs = documents(spark, "/root/testdata/sf0.01")
    toxicity.fit(docs, spark.read.parquet("/root/testdata/sf0.01/labels.parquet"))
    assert seen[0] > 100


def test_toxicity_repeated_rows_and_ties(spark):
    model = toxicity.Model({"fool": 0}, {}, [], np.zeros(5), float(np.log(0.7 / 0.3)))
    rows = [(1, "x"), (1, "x"), (None, "x"), (2, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as toxic", "2 as n")
    assert [round(r.score, 9) for r in toxicity.scored(df, model).collect()] == [0.7] * 4
    out = toxicity.op7_toxicity(df, spark.createDataFrame([(1, None)], "doc_id long, toxic int")).collect()
    assert len(out) == 4 and {r.predicted for r in out} == {0}
