"""Search for many fixed strings at once in the lines of files."""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator
from heapq import heappush, heapreplace

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import BROADCAST_ROWS, bounded_batches, few, small, top
from .workspace import new_path, written

#: Hits of one term, characters of a file that is searched, and characters of a term, at most.
MAX_HITS, MAX_FILE, MAX_TERM = 100, 1_000_000, 512
#: Characters of the runs by which texts are looked up.
GRAM = 3
#: Hits that a task holds before it sends them on.
HELD_HITS = 20_000


class _Last:
    """A path in a heap whose top is the last one."""

    __slots__ = ("path",)

    def __init__(self, path: str):
        self.path = path

    def __lt__(self, other: _Last) -> bool:
        return other.path < self.path


def usable(terms: DataFrame) -> DataFrame:
    """Terms (qid, term, ..) that can be searched for: trimmed, not empty, not too long, without line ends and NUL."""
    rows = terms.withColumn("term", F.trim("term"))
    return rows.where((F.col("term") != "") & (F.length("term") <= MAX_TERM) & ~F.col("term").rlike("[\\x00\\r\\n]"))


def _hits(frames: Iterator[pd.DataFrame], automaton, limit: int) -> Iterator[pd.DataFrame]:
    """(term, path, line_no, column, line) of a task's files (path, text), HELD_HITS at once."""
    columns = ["term", "path", "line_no", "column", "line"]
    rows: list[tuple] = []
    seen: dict[str, list[_Last]] = {}  # of each term the first ``limit`` paths, one a hit, as a heap whose top is the last
    for frame in frames:
        for path, text in zip(frame.path, frame.text, strict=True):
            starts: list[int] | None = None
            last: dict[str, int] = {}
            count: dict[str, int] = {}
            for end, word in automaton.iter(text):
                if count.get(word, 0) >= limit:
                    continue
                before = seen.get(word)
                if before is not None and len(before) >= limit and before[0].path < (path or ""):
                    continue
                if starts is None:
                    starts = [0, *(i + 1 for i, c in enumerate(text) if c == "\n")]
                begin = end - len(word) + 1
                n = bisect_right(starts, begin)
                if last.get(word) == n:
                    continue
                last[word], count[word] = n, count.get(word, 0) + 1
                stop = starts[n] - 1 if n < len(starts) else len(text)
                rows.append((word, path, n, begin - starts[n - 1] + 1, text[starts[n - 1] : stop]))
                if before is None:
                    before = seen[word] = []
                if len(before) < limit:
                    heappush(before, _Last(path or ""))
                else:
                    heapreplace(before, _Last(path or ""))
                if len(rows) >= HELD_HITS:
                    yield pd.DataFrame(rows, columns=columns)
                    rows = []
    yield pd.DataFrame(rows, columns=columns)


def term_hits(files: DataFrame, terms: DataFrame, limit: int = MAX_HITS, allowed: str | None = None, passes: int | None = None) -> DataFrame:
    """(term, path, line_no, column, line): the first ``limit`` lines, by path and number, that hold each different term.

    files: (path, text); terms: (term, ..). Line and column count from 1; a line is one hit of a term, at its first
    place. allowed: a regular expression of paths that may be searched. Files of more than MAX_FILE characters or with
    a NUL near their start are not searched, nor is a null text. All terms are found in one pass over each text by an
    automaton that is sent to the tasks; more terms than BROADCAST_ROWS take several passes over the files, each
    written before the next. A task sends on HELD_HITS hits at once, and none of a file that comes after those of
    ``limit`` hits of the term that it has seen; the ranking is limited before its shuffle.
    """
    spark = files.sparkSession
    bounded_batches(spark)
    some = F.col("text").isNotNull() & (F.length("text") <= MAX_FILE) & ~F.contains(F.substring("text", 1, 4096), F.lit("\0"))
    searched = files.where(some if allowed is None else some & F.col("path").rlike(allowed)).select("path", "text")
    wanted = usable(terms).select("term").distinct()
    schema = "term string, path string, line_no int, column int, line string"

    def found(words: list[str]) -> DataFrame:
        def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            import ahocorasick

            automaton = ahocorasick.Automaton()
            for word in words:
                automaton.add_word(word, word)
            automaton.make_automaton()
            yield from _hits(frames, automaton, limit)

        return searched.mapInPandas(run, schema)

    rows = wanted.limit(BROADCAST_ROWS + 1).collect() if passes is None else []
    if passes is None and len(rows) <= BROADCAST_ROWS:
        hits = found(sorted(r.term for r in rows)) if rows else spark.createDataFrame([], schema)
    else:
        passes = passes or -(-wanted.count() * 2 // BROADCAST_ROWS)
        path = new_path(spark, "hits")
        for n in range(passes):
            words = sorted(r.term for r in wanted.where(F.pmod(F.xxhash64("term"), F.lit(passes)) == n).collect())  # about half of BROADCAST_ROWS
            if words:
                found(words).write.mode("append").parquet(path)
        hits = spark.read.schema(schema).parquet(path)
    return top(hits, ["term"], [F.asc("path"), F.asc("line_no")], limit, "_n").drop("_n")


def _grams(text: Column, sizes: list[int]) -> Column:
    """The different runs of so many characters."""
    of = lambda n: F.when(F.length(text) >= n, F.transform(F.sequence(F.lit(1), F.length(text) - n + 1), lambda i: F.substring(text, i, F.lit(n)))).otherwise(F.array().cast("array<string>"))
    return F.array_distinct(F.flatten(F.array(*map(of, sizes))))


def holding(rows: DataFrame, item: str, text: str, queries: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """(qid, item) of every text that holds a query's text (qid, query), whatever the case; empty and null ones hold and are held by none.

    With ``keep``, (qid, item, keep) of every row that does, equal rows each. Each query is looked up by the run of
    GRAM characters (or of all its characters, if it has fewer) that the fewest texts have, by an equi-join; what
    meets there is compared. Runs of texts that no query has are left out first. The queries with their runs are
    sent to the texts if they are few, so texts and matches are not shuffled; more are joined by a shuffle.
    """
    low = rows.select(F.col(item).alias("_item"), *keep, F.lower(text).alias("_text"))
    asked = queries.select("qid", F.lower("query").alias("q")).where(F.length("q") > 0)
    sizes = sorted(r.n for r in asked.select(F.least(F.length("q"), F.lit(GRAM)).alias("n")).distinct().collect())  # GRAM numbers at most
    if not sizes:
        return asked.select("qid", F.lit(None).cast(dict(rows.dtypes)[item]).alias(item), *(F.lit(None).cast(dict(rows.dtypes)[c]).alias(c) for c in keep)).where("false")
    own = F.coalesce(*(F.when(F.least(F.length("q"), F.lit(GRAM)) == n, _grams(F.col("q"), [n])) for n in sizes))
    grams = asked.select("qid", "q", F.explode(own).alias("gram"))
    runs = F.explode(_grams(F.col("_text"), sizes)).alias("gram")
    posted = low.select("_item", runs).join(small(grams.select("gram").distinct()), "gram", "left_semi")
    counts = posted.groupBy("gram").agg(F.count(F.lit(1)).alias("n"))
    rarest = grams.join(small(counts), "gram").groupBy("qid", "q").agg(F.count(F.lit(1)).alias("found"), F.min(F.struct("n", "gram")).alias("least"))
    # a query one of whose runs no text has is held by none
    whole = grams.groupBy("qid", "q").agg(F.count(F.lit(1)).alias("runs"))
    first = written(rarest.join(whole, ["qid", "q"]).where("found = runs").select("qid", "q", F.col("least.gram").alias("gram")), "rarest-runs")
    if few(first):  # a query has one run here, and a text each run once, so a pair meets once
        met = low.select("_item", *keep, "_text", runs).join(F.broadcast(first), "gram")
    else:
        met = posted.join(first, "gram").select("qid", "q", "_item").distinct().join(low.where("_text is not null"), "_item")
    held = met.where(F.contains("_text", "q")).select("qid", F.col("_item").alias(item), *keep)
    return held if keep else held.distinct()


def query_hits(files: DataFrame, terms: DataFrame, k: int, allowed: str | None = None) -> DataFrame:
    """(qid, term, path, line_no, column, line, rank) of the terms (qid, place, term) of queries, k lines a query.

    The terms of a query are searched for in order of ``place``, each for k lines at most; a line that an
    earlier term found is not taken again.
    """
    hits = term_hits(files, terms, k, allowed)
    met = usable(terms).join(hits, "term")
    first = top(met, ["qid", "path", "line_no"], [F.asc("place")], 1, "_f").drop("_f")
    return top(first, ["qid"], [F.asc("place"), F.asc("path"), F.asc("line_no")], k).drop("place")
