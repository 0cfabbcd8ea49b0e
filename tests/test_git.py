"""Git as a source: batch, stream, filters, documents of commits."""

import subprocess

import pytest

from sievewright.sources import git


@pytest.fixture
def repo(tmp_path):
    path = tmp_path / "repo"
    path.mkdir()

    def run(*args):
        subprocess.run(["git", "-C", str(path), "-c", "user.name=n", "-c", "user.email=e@x", *args], check=True, capture_output=True)

    def commit(message, **contents):
        for name, text in contents.items():
            file = path / name.replace("__", "/").replace("_dot_", ".")
            file.parent.mkdir(parents=True, exist_ok=True)
            file.write_text(text)
        run("add", "-A")
        run("commit", "-q", "-m", message)

    run("init", "-q", "-b", "main")
    commit("first\n\nwith token = abc123secret", a_dot_py="x = 1", docs__d_dot_md="doc")
    commit("second: a change", a_dot_py="x = 2")
    return path, run, commit


def rows(df):
    return sorted((r.subject, tuple(r.paths)) for r in df.collect())


def test_batch_filters_and_history(spark, repo):
    path, run, commit = repo
    git.register(spark)
    commit("third", secrets__id_dot_pem="k", b_dot_py="y")
    run("checkout", "-q", "-b", "side", "HEAD~1")
    commit("on the side", s_dot_py="s")
    run("checkout", "-q", "main")
    run("merge", "-q", "--no-ff", "-m", "merged", "side")
    log = spark.read.format("git_log").option("path", str(path)).load()
    assert rows(log) == [("first", ("a.py", "docs/d.md")), ("merged", ()), ("on the side", ("s.py",)), ("second: a change", ("a.py",)), ("third", ("b.py", "secrets/id.pem"))]
    only = spark.read.format("git_log").option("path", str(path)).option("include", "*.py").option("exclude", "b.py\ns.py").load()
    assert rows(only) == [("first", ("a.py",)), ("second: a change", ("a.py",))]
    docs = {r.content.split("\n")[0]: r for r in git.history(log).collect()}
    assert "abc123secret" not in docs["# first"].content and "[redacted]" in docs["# first"].content and "- docs/d.md" in docs["# first"].content
    assert docs["# third"].n_paths == 1 and "id.pem" not in docs["# third"].content and "Changed paths" not in docs["# merged"].content
    found = {r.relative_path: bytes(r.content) for r in spark.read.format("git_files").option("path", str(path)).option("exclude", "secrets/*").load().collect()}
    assert found == {"a.py": b"x = 2", "b.py": b"y", "docs/d.md": b"doc", "s.py": b"s"}


def test_stream_has_each_commit_once(spark, repo, tmp_path):
    path, _, commit = repo
    git.register(spark)

    def run():
        stream = spark.readStream.format("git_log").option("path", str(path)).load()
        stream.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start().awaitTermination(120)
        return [r.subject for r in spark.read.parquet(str(tmp_path / "out")).orderBy("author_date", "subject").collect()]

    assert sorted(run()) == ["first", "second: a change"]
    assert sorted(run()) == ["first", "second: a change"]  # nothing new
    commit("third", c_dot_py="z")
    commit("fourth", c_dot_py="zz")
    assert sorted(run()) == ["first", "fourth", "second: a change", "third"]


def test_a_file_that_changes_is_read_again(tmp_path, monkeypatch):
    file = tmp_path / "f"
    file.write_bytes(b"one")
    assert git.stable(str(file)) == b"one"
    import os

    real, calls = os.stat, []

    def stat(p, *a, **k):
        calls.append(p)
        if len(calls) == 2:
            file.write_bytes(b"longer")
        return real(p, *a, **k)

    monkeypatch.setattr(os, "stat", stat)
    assert git.stable(str(file)) == b"longer"
