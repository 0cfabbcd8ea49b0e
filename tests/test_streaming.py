from pyspark.sql import functions as F

from sievewright.streaming import sync


def test_sync_matches_a_batch(spark, tmp_path):
    schema = "doc_id string, rev string, version long"
    batches = [[("a", "1", 1), ("b", "1", 1), ("b", "2", 2)], [("b", "2", 3), ("c", "1", 1)]]
    for k, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(tmp_path / f"in/{k}"))
        stream = spark.readStream.schema(schema).parquet(str(tmp_path / "in/*"))
        sync.sync(stream, str(tmp_path / "state"), str(tmp_path / "changes"), str(tmp_path / "ck")).awaitTermination(60)
    found = lambda n: {tuple(r) for r in sync.current(spark, str(tmp_path / "state"), "doc_id string, rev string", n).collect()}
    assert found(0) == {("a", "1"), ("b", "2")} and found(1) == {("a", "1"), ("b", "2"), ("c", "1")}
    changed = spark.read.parquet(str(tmp_path / "changes"))
    assert {(r.batch, r.doc_id, r.outcome) for r in changed.collect()} == {(0, "a", "added"), (0, "b", "added"), (1, "c", "added")}


def test_sync_rewrites_only_what_a_batch_touches(spark, tmp_path):
    """Each start goes on where the last one ended; parts that no pointer needs any more are deleted."""
    schema = "doc_id string, rev string, version long"
    state = tmp_path / "state"
    for k in range(4):
        rows = [(f"k{i}", "0", 0) for i in range(200)] if k == 0 else [("k7", str(k), k), (f"new{k}", "x", k)]
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(tmp_path / f"in/{k}"))
        stream = spark.readStream.schema(schema).parquet(str(tmp_path / "in/*"))
        sync.sync(stream, str(state), str(tmp_path / "changes"), str(tmp_path / "ck"), parts=8).awaitTermination(60)
    rows = {tuple(r) for r in sync.current(spark, str(state), "doc_id string, rev string", 3).collect()}
    assert len(rows) == 203 and ("k7", "3") in rows and ("new2", "x") in rows and ("k8", "0") in rows
    kept = lambda n: len(list((state / f"data/batch={n}").glob("part=*")))
    assert kept(3) <= 2 and kept(0) < 8


def test_running_totals_of_keys(spark, tmp_path):
    for k, rows in enumerate([[("a", 1.0), ("a", 2.0), ("b", 5.0)], [("a", 4.0)]]):
        spark.createDataFrame(rows, "u string, v double").coalesce(1).write.parquet(str(tmp_path / f"in/{k}"))
        stream = spark.readStream.schema("u string, v double").parquet(str(tmp_path / "in/*"))
        seen = []
        sync.running(stream, "u", "v").writeStream.foreachBatch(lambda df, n, seen=seen: seen.extend(map(tuple, df.collect()))).option("checkpointLocation", str(tmp_path / "ck")).outputMode("update").trigger(availableNow=True).start().awaitTermination(60)
        assert sorted(seen) == ([("a", 2, 3.0), ("b", 1, 5.0)] if k == 0 else [("a", 3, 7.0)])


def test_windows(spark, tmp_path):
    rows = spark.read.parquet("/root/testdata/sf0.001/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    rows.coalesce(1).write.parquet(str(tmp_path / "in"))
    for f, name in ((sync.tumbling, "tumbles"), (sync.sessions, "sessions")):
        q = f(sync.events(spark, str(tmp_path / "in"))).writeStream.format("memory").queryName(name).outputMode("complete" if f is sync.tumbling else "append").trigger(availableNow=True).start()
        q.awaitTermination(60)
    assert spark.table("tumbles").agg(F.sum("n")).first()[0] == rows.count()
    assert spark.table("sessions").count() > 0


def test_deletions_and_net_changes(spark, tmp_path):
    """A streamed run of snapshots, with tombstones, comes to what the batch difference of the snapshots says."""
    from sievewright.operators import ingest

    schema = "doc_id string, rev string"
    snapshots = [
        [("a", "1"), ("b", "1"), ("c", "1"), ("d", "1")],
        [("a", "2"), ("c", "1"), ("d", "1"), ("e", "1")],  # b goes, e comes
        [("a", "1"), ("c", "1"), ("b", "9"), ("f", "1")],  # a as it was, b anew, d and e go
    ]
    frames = [spark.createDataFrame(rows, schema) for rows in snapshots]
    before = spark.createDataFrame([], schema)
    for k, now in enumerate(frames):
        sync.as_versions(now, before, k).coalesce(1).write.parquet(str(tmp_path / f"in/{k}"))
        before = now
        stream = spark.readStream.schema(f"{schema}, version long").parquet(str(tmp_path / "in/*"))
        sync.sync(stream, str(tmp_path / "state"), str(tmp_path / "changes"), str(tmp_path / "ck"), parts=4).awaitTermination(60)
        assert {tuple(r) for r in sync.current(spark, str(tmp_path / "state"), schema, k).collect()} == set(snapshots[k])
    feed = spark.read.parquet(str(tmp_path / "changes"))
    for lo in range(3):
        for hi in range(lo + 1, 3):
            want = {tuple(r) for r in ingest.diff(frames[hi], frames[lo], "doc_id", "rev").collect()}
            assert {tuple(r) for r in sync.net_changes(feed, after=lo, until=hi).collect()} == want
    assert {tuple(r) for r in sync.net_changes(feed).collect()} == {(k, "added") for k, _ in snapshots[2]}


def test_tombstones_of_unknown_keys_and_repeats(spark, tmp_path):
    schema = "doc_id string, rev string, version long"
    for k, rows in enumerate([[("a", "1", 1), ("a", None, 2), ("x", None, 1), ("b", "1", 1)], [("b", None, 2), ("b", "2", 3), ("a", "5", 4)]]):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(tmp_path / f"in/{k}"))
        sync.sync(spark.readStream.schema(schema).parquet(str(tmp_path / "in/*")), str(tmp_path / "state"), str(tmp_path / "changes"), str(tmp_path / "ck")).awaitTermination(60)
    assert {tuple(r) for r in sync.current(spark, str(tmp_path / "state"), "doc_id string, rev string", 1).collect()} == {("a", "5"), ("b", "2")}
    feed = {(r.batch, r.doc_id, r.outcome, r.before, r.after) for r in spark.read.parquet(str(tmp_path / "changes")).collect()}
    assert feed == {(0, "b", "added", None, "1"), (1, "b", "updated", "1", "2"), (1, "a", "added", None, "5")}


def test_judging_goes_on_where_it_was_stopped(spark, tmp_path):
    """Attempts are appended once, scores never change, and a run in two parts gives the table of a run in one."""
    from sievewright.streaming import judging

    def scorer(rows):
        if (rows.id == 13).any():
            raise TimeoutError
        return [None if i % 5 == 0 and n == 0 else 2.0 if i % 7 == 0 else (i % 10) / 10 + n / 100 for i, n in zip(rows.id, rows.number, strict=True)]

    batches = [[(i, "faithfulness") for i in range(1, 12)], [(i, "faithfulness") for i in range(1, 6)] + [(5, "correctness")] * 2, [(13, "faithfulness")], [(5, "faithfulness"), (7, "faithfulness")], [(7, "faithfulness")]]
    for run, parts in (("whole", [5]), ("parted", [2, 3])):
        done = 0
        for n in parts:
            for k in range(done, done + n):
                spark.createDataFrame(batches[k], "id long, metric string").coalesce(1).write.parquet(str(tmp_path / run / f"in/{k}"))
            done += n
            stream = spark.readStream.schema("id long, metric string").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / run / "in/*"))
            judging.judge(stream, str(tmp_path / run), str(tmp_path / run / "ck"), scorer).awaitTermination(120)
    one, two = (judging.attempts(spark, str(tmp_path / run)) for run in ("whole", "parted"))
    rows = lambda df: sorted(map(str, df.collect()))
    assert rows(one) == rows(two)
    got = {(r.id, r.metric): r.value for r in judging.scores(two).collect()}
    assert got[(3, "faithfulness")] == 0.3 and got[(5, "faithfulness")] == 0.51 and (7, "faithfulness") not in got and (13, "faithfulness") not in got
    seen = {(r.id, r.metric): (r.n_attempts, r.n_values, r.last_code) for r in judging.audit(two).collect()}
    assert seen[(3, "faithfulness")] == (1, 1, None) and seen[(5, "faithfulness")] == (2, 1, None) and seen[(7, "faithfulness")] == (3, 0, "out_of_range") and seen[(13, "faithfulness")] == (1, 0, "TimeoutError")
    assert seen[(5, "correctness")] == (1, 0, "no_value")
    # a batch that is run again leaves one copy of its attempts
    before = rows(two)
    stream = spark.readStream.schema("id long, metric string").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "parted/in/*"))
    last = max((tmp_path / "parted/ck/commits").glob("[0-9]*"), key=lambda p: int(p.name))
    last.unlink()
    (last.parent / f".{last.name}.crc").unlink(missing_ok=True)
    judging.judge(stream, str(tmp_path / "parted"), str(tmp_path / "parted/ck"), scorer).awaitTermination(120)
    assert rows(judging.attempts(spark, str(tmp_path / "parted"))) == before
