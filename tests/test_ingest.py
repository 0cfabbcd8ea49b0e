import subprocess

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from sievewright.operators import ingest
from sievewright.sources import catalog, code, files, git, html


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="ab \n", max_size=300), st.integers(4, 40), st.integers(0, 3))
def test_spans_cover_the_text(text, size, overlap):
    found = ingest.spans(text, size, overlap)
    assert found[0][0] == 0 and found[-1][1] == len(text)
    for (a, b), (c, d) in zip(found, found[1:], strict=False):
        assert a < c <= b <= d and b - a <= size


def test_diff_and_upsert(spark):
    old = spark.createDataFrame([("a", "1"), ("b", "1"), ("c", "1")], "k string, rev string")
    new = spark.createDataFrame([("a", "1"), ("b", "2"), ("d", "1")], "k string, rev string")
    assert {(r.k, r.change) for r in ingest.diff(new, old, "k", "rev").collect()} == {("b", "modified"), ("c", "deleted"), ("d", "added")}
    assert ingest.diff(old, old, "k", "rev").count() == 0
    assert {(r.k, r.rev, r.outcome) for r in ingest.upsert(old, new, "k", "rev").collect()} == {("a", "1", "skipped"), ("b", "2", "updated"), ("c", "1", "kept"), ("d", "1", "added")}


def test_partitions(spark):
    rows = [("official_web", None, None, "x.py", None), ("directory", None, None, "src/a.py", None), ("directory", None, None, "tests/a.py", None), ("git", None, None, "x.md", "git_commit"), ("git", None, "Design", "a.py", None), ("git", "shop", None, "readme", None), ("git", None, None, "x#symbol:Y", None)]
    df = spark.createDataFrame(rows, "t string, c string, a string, p string, r string")
    got = [tuple(r) for r in df.select(*ingest.partition(*map(F.col, "tcapr"))).collect()]
    assert got == [("official", "official"), ("internal", "code"), ("internal", "test"), ("internal", "history"), ("internal", "design"), ("shop", "design"), ("internal", "code")]


def test_directory_csv_and_symbols(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    (tmp_path / "a.py").write_text("@d\nclass A:\n    'doc'\n    async def f(self): pass\n\ndef g(): pass\n")
    (tmp_path / "sub/t.csv").write_text('name,value\n"x\ny",1\nz\n')
    (tmp_path / ".env").write_text("SECRET=1")
    (tmp_path / "b.bin").write_bytes(b"\0\1")
    (tmp_path / "c.txt").write_bytes("é汉".encode("gb18030"))
    (tmp_path / "big.txt").write_text("x" * 5000)
    rows = files.directory(spark, str(tmp_path), max_bytes=4000)
    got = {r.relative_path: r for r in rows.collect()}
    assert set(got) == {"a.py", "sub/t.csv", "b.bin", "c.txt", "big.txt"}
    assert got["b.bin"].skipped == "binary" and got["big.txt"].skipped == "large" and got["c.txt"].content == "é汉"
    table = files.csv_documents(rows).first()
    assert table.content.splitlines() == ["| name | value |", "| --- | --- |", "| x<br>y | 1 |", "| z |  |"] and table.row_count == 3
    symbols = code.symbols(rows)
    assert {(r.symbol, r.kind, r.line_start, r.line_end) for r in symbols.collect()} == {("A", "class", 1, 4), ("A.f", "async_function", 4, 4), ("g", "function", 6, 6)}
    terms = spark.createDataFrame([("f",), ("A.f",), ("A",)], "term string")
    assert sorted((r.symbol, r.term) for r in code.lookup(symbols, terms).collect()) == [("A", "A"), ("A.f", "A.f"), ("A.f", "f")]
    kept = files.directory(spark, str(tmp_path), include=["*.py", "*.csv"], exclude=["sub/*"])
    assert [r.relative_path for r in kept.collect()] == ["a.py"]


def test_git_sources(spark, tmp_path):
    run = lambda *a: subprocess.run(["git", "-C", str(tmp_path), "-c", "user.name=x", "-c", "user.email=x@y.z", *a], check=True, capture_output=True)
    run("init")
    (tmp_path / "a.txt").write_text("one")
    run("add", ".")
    run("commit", "-m", "first\n\nbody")
    (tmp_path / "b.txt").write_text("two")
    git.register(spark)
    log = spark.read.format("git_log").load(str(tmp_path)).collect()
    assert [(r.subject, r.body, r.paths) for r in log] == [("first", "body", ["a.txt"])]
    assert {(r.relative_path, bytes(r.content)) for r in spark.read.format("git_files").load(str(tmp_path)).collect()} == {("a.txt", b"one"), ("b.txt", b"two")}
    assert git.sanitised_uri("https://u:p@h.org/r.git?x=1") == "https://h.org/r.git" and git.sanitised_uri("/home/x") == "local-repository"


def test_catalog_and_publish(spark, tmp_path):
    (tmp_path / "c.json").write_text('{"sources": [{"id": "a", "type": "local", "path": "docs"}, {"id": "b", "type": "git", "path": "/r"}]}')
    assert [(s["type"], s["path"]) for s in catalog.load(str(tmp_path / "c.json"))] == [("directory", str(tmp_path / "docs")), ("git", "/r")]
    for n in (1, 2):
        catalog.publish({"t": spark.range(n)}, str(tmp_path / "index"), f"build_{n}")
    assert catalog.current(spark, str(tmp_path / "index"))["t"].count() == 2


def test_html():
    page = "<html><head><title>T &amp; t</title></head><body><nav>no</nav><main><h2>Head</h2><p>a <b>b</b></p><ul><li>x</li><li>y</li></ul><main>inner</main></main>out</body></html>"
    title, content = html.clean(page)
    assert title == "T & t" and content.startswith("# T & t\n\n## Head") and "- x\n- y" in content and "inner" in content and "out" not in content and "no" not in content.split()
    assert html.clean(None) == ("", "")
