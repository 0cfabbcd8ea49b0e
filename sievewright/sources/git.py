"""Git repositories as data sources: ``git_log`` (batch and stream) and ``git_files``.

A partition is a group of commits or files, read by one git process or none. Paths are taken by the
options ``include`` and ``exclude``, globs with a line each. ``history`` makes documents of commits,
without secrets and unsafe paths.
"""

from __future__ import annotations

import re
import subprocess
from collections.abc import Iterator
from fnmatch import fnmatchcase
from pathlib import PurePosixPath

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

from ..functions.text import redacted
from . import files

MAX_COMMITS, MAX_BYTES, GROUP = 500, 2 << 20, 200
LOG_SCHEMA = "commit_sha string, author_date string, subject string, body string, paths array<string>"
FILE_SCHEMA = "relative_path string, size long, content binary, skipped string"


#: Marks the start of a commit in what git prints.
_MARK = "\x1e\x1f"


def _git(repo: str, *args: str, given: str = "") -> bytes:
    return subprocess.run(["git", "-C", repo, *args], check=True, capture_output=True, timeout=120, input=given.encode()).stdout


def wanted(path: str, include: list[str], exclude: list[str]) -> bool:
    """Whether a path matches one of the included globs, or there is none, and none of the excluded."""
    hit = lambda globs: any(fnmatchcase(path, g) or PurePosixPath(path).match(g) for g in globs)
    return (not include or hit(include)) and not hit(exclude)


def commits(repo: str, shas: list[str], include: list[str], exclude: list[str]) -> Iterator[tuple]:
    """Rows of LOG_SCHEMA of commits in their order, by one git process; with globs, only commits that touch a wanted path, and those paths."""
    if not shas:
        return
    form = f"--format={_MARK}%H%x00%aI%x00%s%x00%b%x00".replace(_MARK, "%x1e%x1f")
    out = _git(repo, "log", "--stdin", "--no-walk=unsorted", "--cc", "--name-only", "-z", form, given="\n".join(shas) + "\n").decode("utf-8", "replace")
    for record in out.split(_MARK)[1:]:
        sha, date, subject, body, *names = record.split("\0")
        paths = sorted({n.strip() for n in names if n.strip()})
        if include or exclude:
            paths = [p for p in paths if wanted(p, include, exclude)]
            if not paths:
                continue
        yield sha, date, subject, body.strip(), paths


def sanitised_uri(uri: str) -> str:
    """A remote without user, password, query and fragment; a local path is only said to be one."""
    if m := re.match(r"^(?:[^@/]+@)?([^:/]+):(?!//)(.+)$", uri):
        return f"{m[1]}:{m[2]}"
    if m := re.match(r"^(https?|ssh|git)://(?:[^@/]*@)?([^?#]*)", uri):
        return f"{m[1]}://{m[2]}"
    return "local-repository"


def _globs(options, name: str) -> list[str]:
    return [g.strip() for g in (options.get(name) or "").split("\n") if g.strip()]


class _Reader(DataSourceReader):
    def __init__(self, options):
        self.repo, self.include, self.exclude = options["path"], _globs(options, "include"), _globs(options, "exclude")

    def chunks(self) -> list[list[str]]:
        raise NotImplementedError

    def partitions(self):
        return [InputPartition(c) for c in self.chunks()] or [InputPartition([])]


class _LogReader(_Reader):
    def __init__(self, options):
        super().__init__(options)
        self.limit = min(MAX_COMMITS, int(options.get("limit", MAX_COMMITS)))

    def chunks(self):
        shas = _git(self.repo, "log", f"-n{self.limit}", "--format=%H").decode().split()
        return [shas[k : k + GROUP] for k in range(0, len(shas), GROUP)]

    def read(self, partition):
        yield from commits(self.repo, partition.value, self.include, self.exclude)


class _LogStream(DataSourceStreamReader):
    """New commits of HEAD, in their order; an offset is the last commit of a batch, so each commit is in one batch."""

    def __init__(self, options):
        self.repo, self.include, self.exclude = options["path"], _globs(options, "include"), _globs(options, "exclude")

    def initialOffset(self):
        return {"commit": ""}

    def latestOffset(self):
        head = subprocess.run(["git", "-C", self.repo, "rev-parse", "--verify", "-q", "HEAD"], check=False, capture_output=True, timeout=120).stdout
        return {"commit": head.decode().strip()}  # empty before the first commit

    def partitions(self, start, end):
        first, last = (o["commit"] for o in (start, end))
        shas = _git(self.repo, "rev-list", "--reverse", last, *([f"^{first}"] if first else [])).decode().split() if last and last != first else []
        return [InputPartition(shas[k : k + GROUP]) for k in range(0, len(shas), GROUP)] or [InputPartition([])]

    def read(self, partition):
        yield from commits(self.repo, partition.value, self.include, self.exclude)

    def commit(self, end):
        """Nothing is held for a batch."""


def stable(path: str, tries: int = 3) -> bytes:
    """The bytes of a file that nobody changed while it was read; an error if that never was so."""
    import os

    for _ in range(tries):
        before = os.stat(path)
        with open(path, "rb") as f:
            content = f.read()
        after = os.stat(path)
        if (before.st_size, before.st_mtime_ns) == (after.st_size, after.st_mtime_ns) and len(content) == after.st_size:
            return content
    raise RuntimeError(f"{os.path.basename(path)} changes while it is read")


class _FileReader(_Reader):
    def partitions(self):
        """Groups of files, each with the commit that was checked out when they were listed."""
        head = subprocess.run(["git", "-C", self.repo, "rev-parse", "-q", "--verify", "HEAD"], check=False, capture_output=True, timeout=120).stdout
        return [InputPartition((head, c)) for c in self.chunks()] or [InputPartition((head, []))]

    def chunks(self):
        names = sorted({n for n in _git(self.repo, "ls-files", "-z", "--cached", "--others", "--exclude-standard").decode("utf-8", "replace").split("\0") if n and wanted(n, self.include, self.exclude)})
        return [names[k : k + GROUP] for k in range(0, len(names), GROUP)]

    def read(self, partition):
        import os

        root = os.path.realpath(self.repo)
        head, names = partition.value
        for name in names:
            path = os.path.join(root, name)
            if os.path.islink(path) or not os.path.isfile(path) or not os.path.realpath(path).startswith(root + os.sep):
                yield name, None, None, "link or outside"
                continue
            size = os.path.getsize(path)
            if size > MAX_BYTES:
                yield name, size, None, "large"
                continue
            yield name, size, stable(path), None
        if head and _git(self.repo, "rev-parse", "HEAD") != head:
            raise RuntimeError("the repository was changed while it was read")


class GitLog(DataSource):
    @classmethod
    def name(cls):
        return "git_log"

    def schema(self):
        return LOG_SCHEMA

    def reader(self, schema):
        return _LogReader(self.options)

    def streamReader(self, schema):
        return _LogStream(self.options)


class GitFiles(DataSource):
    @classmethod
    def name(cls):
        return "git_files"

    def schema(self):
        return FILE_SCHEMA

    def reader(self, schema):
        return _FileReader(self.options)


def history(log: DataFrame) -> DataFrame:
    """(commit_sha, relative_path, content, n_paths) of commits: a Markdown document each, its secrets redacted and unsafe paths left out."""
    paths = F.filter("paths", files.safe_path)
    head = F.concat(F.lit("# "), redacted(F.col("subject"), None), F.lit("\n\nCommit: "), "commit_sha", F.lit("\nDate: "), "author_date", F.lit("\n"))
    body = F.when(F.col("body") != "", F.concat(F.lit("\n"), redacted(F.col("body"), None), F.lit("\n"))).otherwise("")
    listed = F.when(F.size(paths) > 0, F.concat(F.lit("\nChanged paths:\n"), F.array_join(F.transform(paths, lambda p: F.concat(F.lit("- "), p)), "\n"), F.lit("\n"))).otherwise("")
    return log.select("commit_sha", F.concat(F.lit("history/"), "commit_sha", F.lit(".md")).alias("relative_path"), F.concat(head, body, listed).alias("content"), F.size(paths).alias("n_paths"))


def register(spark) -> None:
    for source in (GitLog, GitFiles):
        spark.dataSource.register(source)
