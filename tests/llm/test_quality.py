import re
from collections import Counter

from sievewright.llm import quality
from sievewright.llm.common import documents


def brute(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    seen = Counter(windows)
    covered = {k for i, w in enumerate(windows) if seen[w] > 1 for k in range(i, i + 5)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered)


ODD = [None, "", " \n\n", "a b c d e a b c d e", "x\nx\nx \n\x85y\n\x85y", "é☃\U0001f600 | <b> #", "w " * 30000, "a " * 9, "\x1ca b", "q" * 200_000]


def test_measurements_against_brute_force(spark):
    rows = [(r.doc_id, r.text) for r in documents(spark, "/root/testdata/sf0.01").collect()] + [(-k - 1, t) for k, t in enumerate(ODD)]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as kept", "2 as n_words")
    got = {r.doc_id: r for r in quality.op3_quality(df).collect()}
    assert len(got) == len(rows)
    for i, text in rows:
        want = brute(text)
        r = got[i]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == want, repr(text)[:60]
        assert r.base_failed == (want[0] < 10 or 100 * want[4] > 20 * want[0])
        assert not (r.base_failed and r.kept)
    assert quality.op3_quality(df.where("false")).collect() == []


def test_good_documents_stay_and_bad_ones_go(spark):
    sf = "/root/testdata/sf0.1"
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    rows = quality.op3_quality(documents(spark, sf)).join(labels, "doc_id").where("not base_failed")
    assert rows.where("quality = 1 and not kept").count() == 0
    assert rows.where("quality = 0 and kept").count() <= 0.02 * rows.where("quality = 0").count()


def test_policies_and_ablations(spark):
    table = quality.ledger(documents(spark, "/root/testdata/sf0.01"))
    for policy, mask in quality.POLICIES.items():
        kept = quality.apply(table, policy).where("kept").count()
        for r in quality.ablations(table, policy).collect():
            bit = quality.BITS[r.rule]
            assert r.n_kept == kept
            assert r.n_kept_without == table.where(f"failed_bits & {mask & ~bit} = 0").count()
            assert r.n_failed == table.where(f"failed_bits & {bit} != 0").count()


def test_the_ledger_answers_every_policy(spark):
    docs = documents(spark, "/root/testdata/sf0.01")
    rows = quality.op3_quality(docs).collect()
    for policy, mask in quality.POLICIES.items():
        assert all(r[f"kept_{policy.replace('-', '_')}"] == (r.failed_bits & mask == 0) for r in rows)
    found = {r.rule: r.n_only for r in quality.ablations(quality.ledger(docs)).collect()}
    for rule, n in found.items():
        assert sum(r.only_rule == rule for r in rows) == n


def test_repeated_and_nameless_rows(spark):
    text = " ".join(f"word{k}" for k in range(12))
    df = spark.createDataFrame([(1, text), (1, text), (None, text), (1, "few"), (None, None)], "doc_id long, text string").selectExpr("*", "1 as kept", "2 as n_words")
    got = sorted(((r.doc_id, r.n_words, r.kept) for r in quality.op3_quality(df).collect()), key=str)
    assert got == sorted([(1, 12, True), (1, 12, True), (None, 12, True), (1, 1, False), (None, 0, False)], key=str)
