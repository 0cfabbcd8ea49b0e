import hashlib

import corpus_pipeline
from sievewright.llm import toxicity
from sievewright.llm.common import documents

from .test_packing import holds
from .test_pii import base
from .test_simhash import similar
from .test_substring import brute as cut_words


def test_stages_against_brute_force(spark, tmp_path):
    sf_dir = "/root/testdata/sf0.01"
    docs = documents(spark, sf_dir)
    columns = docs.columns
    seen = []
    for name, stage in corpus_pipeline.STAGES:
        before = {r.doc_id: r for r in docs.collect()}
        stage(spark, docs, sf_dir).write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        rows = docs.collect()
        seen.append(len(rows))
        if name == "toxicity":
            model = toxicity.fit(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))
            assert {r.doc_id for r in rows} == {i for i, r in before.items() if model.score(r.text.encode()) < 0.7}
            assert len(rows) < len(before)
        elif name.startswith("simhash"):
            assert {r.doc_id for r in rows} == set(similar({i: r.text for i, r in before.items()}).values())
            assert len(rows) < len(before)
            assert all(r.text == before[r.doc_id].text for r in rows)
        elif name.startswith("substring"):
            want = {r[0]: r for r in cut_words([(i, r.text) for i, r in before.items()], 50)}
            assert len(rows) == len(before)
            for r in rows:
                if want[r.doc_id][2]:
                    assert hashlib.sha256(r.text.encode()).hexdigest() == want[r.doc_id][3]
                else:
                    assert r.text == before[r.doc_id].text
        elif name == "pii":
            assert len(rows) == len(before)
            for r in rows:
                old = before[r.doc_id].text
                assert not base(r.text)
                assert r.text == old or "[" in r.text
                assert r.text == old or base(old) or 'token = "' in old, old[:300]
        if name != "best-fit packing":
            assert docs.columns == columns and all(r.n_chars == len(r.text) for r in rows)
        else:
            holds(rows, {i: r.text for i, r in before.items()})
    assert seen[-1] > 0


def test_near_copies_with_null_and_shared_ids(spark, tmp_path):
    """One row of each group of texts, whatever its id."""
    one, two, three, four = ("".join(f" {w}{k}" for k in range(60)) for w in ("alpha", "beta", "gamma", "delta"))
    texts = [
        (None, one), (None, one), (None, two), (5, two), (5, two), (5, two),  # null ids alone; after the others
        (7, three), (9, three), (7, four), (None, None), (None, ""),  # a copy whose id also labels a unique text
    ]
    rows = [(i, t, "en", "s", None) for i, t in texts] + [(5, two, None, "en", None), (5, two, "en", None, None)]
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    docs = spark.createDataFrame(rows, schema).selectExpr("*", "1 as tie", "2 as id", "3 as fp", "4 as `a.b`").repartition(3)
    docs.write.parquet(str(tmp_path / "d"))
    for df in (docs, spark.read.parquet(str(tmp_path / "d"))):
        out = corpus_pipeline.drop_near_copies(spark, df, "")
        assert out.columns == docs.columns
        got = sorted((r.doc_id or 0, r.text or "") for r in out.collect())
        assert got == [(0, ""), (0, one), (5, two), (7, four), (7, three)]
    assert corpus_pipeline.drop_near_copies(spark, docs.where("false"), "").collect() == []


def test_odd_tables(spark, tmp_path):
    texts = [None, "", "x", "a " * 3000, "a " * 3000, "mail a@b.co"]
    rows = [(i, t, "en", None, None) for i, t in enumerate(texts)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").selectExpr("*", "1 as ranges", "'k' as fp", "2 as component_id").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(0, None, None)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    out = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert {r.doc_id for r in out} == {0, 2, 3, 5}
    spark.read.parquet(str(tmp_path / "documents.parquet")).where("false").write.parquet(str(tmp_path / "e/documents.parquet"))
    spark.read.parquet(str(tmp_path / "labels.parquet")).where("false").write.parquet(str(tmp_path / "e/labels.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path / "e")).collect() == []
