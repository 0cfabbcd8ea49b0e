"""Substring deduplication: windows of words counted through super-k-mer partitions.

A window is K consecutive words. Its minimiser is the least hash among its runs
of M words. Consecutive windows of a text that share a minimiser travel as one
packed string (a super-k-mer) to the bucket of that minimiser, so equal windows
always meet there, and overlapping words are sent once for a run, not for each
window. In a bucket, the windows of packed strings are sorted by a 128-bit digest
and equal digests are compared as bytes, so windows are matched exactly.

A first pass counts every minimiser over all texts (8 bytes a super-k-mer are
shuffled). A super-k-mer whose minimiser occurs nowhere else has no equal, so only
those of shared minimisers are packed and sent, and only texts that have one are read
again. A minimiser of more than HOT super-k-mers is hot: its windows are dealt one by
one, by their own digest, and equal ones, sorted by doc_id, are read as a stream. The
counts reach the texts by a join; minimisers with over 1 / TARGET of all super-k-mers,
at most TARGET at any input size, are left out of that join and known by a list. In
each task, of equal packed strings only the one with the least doc_id travels; the
others are known to be covered at once.

A word is removed if a window that covers it also starts in a text with a smaller
doc_id. Null and empty texts have no words; a text with a null doc_id neither covers
nor is covered; of rows with the same doc_id neither covers the other (a smaller doc_id
is asked for); an empty table gives no rows. Repeated doc_ids are told apart nowhere:
their rows get the union of the ranges found, cut at their length. A very long text is
one row like any other; a super-k-mer holds the windows of one place of its minimiser at
most, so one that a text repeats is cut, and what a task holds is sent on in parts, in the
midst of a text too. Extra columns are not read (``replaced`` carries them along, whatever their names).
"""

from __future__ import annotations

import hashlib
from array import array
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import id_and_text, prepare, written

WINDOW = 50
#: Words whose hash is compared to choose minimisers.
MMER = 5
#: Super-k-mers of one minimiser that a bucket holds at most; those of a larger one are dealt window by window.
HOT = 2000
#: At most so many minimisers are listed on the driver: those with over 1 / TARGET of all super-k-mers.
TARGET = 20_000
#: Bytes that a task gathers before it sends them on.
FLUSH_BYTES = 48 << 20
_SENT = "key long, hot boolean, tie long, doc long, starts binary, packed binary"


def _sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    """Minimum of each ``width`` consecutive values, by doubling."""
    have, low = 1, x
    while 2 * have <= width:
        low, have = np.minimum(low[:-have], low[have:]), 2 * have
    return low if have == width else np.minimum(low[: len(x) - width + 1], low[width - have :][: len(x) - width + 1])


def runs(words: list[bytes], window: int, mmer: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(minimiser, first window, windows) of each super-k-mer of a text."""
    import xxhash

    hashes = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
    n = len(words) - mmer + 1
    mixed = np.zeros(n, np.uint64)
    with np.errstate(over="ignore"):
        for i in range(mmer):
            mixed = mixed * np.uint64(0x9E3779B97F4A7C15) + hashes[i : i + n]
            mixed ^= mixed >> np.uint64(29)
        mixed *= np.uint64(0xBF58476D1CE4E5B9)
        mixed ^= mixed >> np.uint64(32)
    most = window - mmer + 1  # one place of a minimiser is in so many windows; where it recurs, a run is cut there
    least = _sliding_min(mixed, most)
    first = np.concatenate([[0], np.flatnonzero(least[1:] != least[:-1]) + 1])
    sizes = np.diff(np.append(first, len(least)))
    pieces = -(-sizes // most)
    nth = np.arange(pieces.sum()) - np.repeat(np.cumsum(pieces) - pieces, pieces)
    first, sizes = np.repeat(first, pieces) + nth * most, np.minimum(most, np.repeat(sizes, pieces) - nth * most)
    return least[first], first, sizes


def spans(starts: np.ndarray, size: int) -> list[tuple[int, int]]:
    """Sorted, disjoint ranges that stretches of ``size`` words from ``starts`` cover."""
    at = np.unique(starts)
    if not len(at):
        return []
    gap = np.flatnonzero(np.diff(at) > size)
    return list(zip(at[np.append(0, gap + 1)].tolist(), (at[np.append(gap, len(at) - 1)] + size).tolist(), strict=True))


def cover(ranges: list[tuple[int, int]], lo: int, hi: int) -> None:
    """Add a range to a list; one that goes on from the last makes that longer."""
    if ranges and ranges[-1][0] <= lo <= ranges[-1][1]:
        ranges[-1] = (ranges[-1][0], max(hi, ranges[-1][1]))
    else:
        ranges.append((lo, hi))


def merged(ranges: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Sorted, disjoint half-open ranges."""
    out: list[tuple[int, int]] = []
    for lo, hi in sorted(ranges):
        if out and lo <= out[-1][1]:
            out[-1] = (out[-1][0], max(hi, out[-1][1]))
        else:
            out.append((lo, hi))
    return out


def _found(window: int, mmer: int):
    """Rows (doc_id, keys): the minimisers of a text's super-k-mers, repeats included."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            docs, keys = [], []
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                words = (text or b"").split()
                if doc is not None and len(words) >= window:
                    docs.append(doc)
                    keys.append(runs(words, window, mmer)[0].view(np.int64))
            yield pa.RecordBatch.from_arrays([pa.array(docs, pa.int64()), pa.array(keys, pa.list_(pa.int64()))], ["doc_id", "keys"])

    return run


def shared_minimisers(texts: DataFrame, window: int, mmer: int, hot: int = HOT, target: int = TARGET) -> tuple[DataFrame, list[int]]:
    """((doc_id, cold, hot): the minimisers of a text that others share, as arrays; minimisers listed as hot for all texts)."""
    keys = written(texts.mapInArrow(_found(window, mmer), "doc_id long, keys array<long>"), "minimisers")
    each = keys.select(F.explode("keys").alias("key"))
    counts = written(each.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1"), "shared-minimisers")
    total = keys.agg(F.sum(F.size("keys").cast("long"))).first()[0] or 0
    listed = sorted(r.key for r in counts.where(F.col("n") > max(total // target, hot)).select("key").collect())  # at most ``target``
    owned = keys.select("doc_id", F.explode(F.array_distinct("keys")).alias("key"))
    if listed:
        few = F.broadcast(texts.sparkSession.createDataFrame([(k,) for k in listed], "key long"))
        common = owned.join(few, "key", "left_semi").select("doc_id", F.lit(None).cast("long").alias("key"), F.lit(True).alias("hot"))
        owned = owned.join(few, "key", "left_anti")
    met = owned.join(counts, "key").select("doc_id", "key", (F.col("n") > hot).alias("hot"))
    if listed:
        met = met.unionByName(common.distinct())
    take = lambda flag: F.collect_set(F.when(F.col("hot") == flag, F.col("key")))  # noqa: E731  nulls are left out
    return met.groupBy("doc_id").agg(take(False).alias("cold"), take(True).alias("hot")), listed


def _send(window: int, mmer: int, listed: list[int]):
    """Rows of _SENT from (doc_id, text, cold, hot): super-k-mers, windows of hot ones, and, with a null key, ranges known in the task."""
    everywhere = frozenset(listed)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        held: dict[bytes, list] = {}  # digest: the least doc_id, its first windows, key, tie, packed words
        covered: dict[int, list[tuple[int, int]]] = {}
        size = 0

        def flush() -> pa.RecordBatch:
            nonlocal held, covered, size
            rows = [(key, tie is not None, tie or 0, doc, at.tobytes(), packed) for doc, at, key, tie, packed in held.values()]
            rows += [(None, False, 0, doc, np.array(merged(ranges), np.int64).tobytes(), None) for doc, ranges in covered.items()]
            held, covered, size = {}, {}, 0
            kinds = (pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.binary(), pa.binary())
            return pa.RecordBatch.from_arrays([pa.array(column, kind) for column, kind in zip(zip(*rows, strict=True), kinds, strict=True)], ["key", "hot", "tie", "doc", "starts", "packed"])

        def offer(doc: int, start: int, n: int, key: int, tie: int | None, packed: bytes, digest: bytes) -> None:
            nonlocal size
            was = held.get(digest)
            if was is None:
                held[digest] = [doc, array("q", [start]), key, tie, packed]
                size += len(packed) + 400
                return
            size += 20
            if was[0] < doc:
                cover(covered.setdefault(doc, []), start, start + n + window - 1)
            elif was[0] > doc:
                covered.setdefault(was[0], []).extend(spans(np.array(was[1]), n + window - 1))
                was[0], was[1] = doc, array("q", [start])
            else:  # the same text repeats itself
                was[1].append(start)

        for batch in batches:
            for doc, text, cold, hot in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                words = (text or b"").split()
                if len(words) < window:
                    continue
                cold, hot = set(cold), everywhere.union(hot)
                keys, first, count = runs(words, window, mmer)
                for key, start, n in zip(keys.view(np.int64).tolist(), first.tolist(), count.tolist(), strict=True):
                    if key in cold:
                        packed = b" ".join(words[start : start + n + window - 1])
                        offer(doc, start, n, key, None, packed, xxhash.xxh3_128_digest(packed))
                    elif key in hot:
                        for at in range(start, start + n):
                            packed = b" ".join(words[at : at + window])
                            digest = xxhash.xxh3_128_digest(packed)
                            offer(doc, at, 1, int.from_bytes(digest[:8], "little", signed=True), int.from_bytes(digest[8:], "little", signed=True), packed, digest)
                    if size >= FLUSH_BYTES:
                        yield flush()
        if held or covered:
            yield flush()

    return run


def match(keys: np.ndarray, docs: np.ndarray, starts: np.ndarray, texts: list[bytes], window: int) -> list[tuple[int, int, int]]:
    """(doc, first word, end) covered by windows that a smaller doc has, for super-k-mers of one bucket."""
    import xxhash

    order = np.argsort(keys, kind="stable")
    same = np.flatnonzero(keys[order][1:] == keys[order][:-1])
    # only minimisers that two or more super-k-mers share can have equal windows
    shared = np.unique(np.concatenate([order[same], order[same + 1]])) if len(same) else np.zeros(0, int)
    digests, owner, offset, slices = [], [], [], []
    for i in shared.tolist():
        packed = texts[i]
        ends = [*[k for k, x in enumerate(packed) if x == 32], len(packed)] if len(packed) < 64 else np.append(np.flatnonzero(np.frombuffer(packed, np.uint8) == 32), len(packed)).tolist()
        begins = [0, *(e + 1 for e in ends[:-1])]
        for at in range(len(ends) - window + 1):
            lo, hi = begins[at], ends[at + window - 1]
            digests.append(xxhash.xxh3_128_digest(packed[lo:hi]))
            owner.append(i)
            offset.append(at)
            slices.append((lo, hi))
    if not digests:
        return []
    both = np.frombuffer(b"".join(digests), np.uint64).reshape(-1, 2)
    who, where = np.array(owner), np.array(offset)
    by = np.lexsort((docs[who], both[:, 1], both[:, 0]))
    sorted_digests = both[by]
    new = np.concatenate([[True], (sorted_digests[1:] != sorted_digests[:-1]).any(axis=1)])
    head = by[np.maximum.accumulate(np.where(new, np.arange(len(by)), 0))]
    found: list[tuple[int, int, int]] = []
    for at, first in zip(by.tolist(), head.tolist(), strict=True):
        i, j = owner[at], owner[first]
        if docs[i] > docs[j] and texts[i][slice(*slices[at])] == texts[j][slice(*slices[first])]:
            found.append((int(docs[i]), int(starts[i]) + offset[at], int(starts[i]) + offset[at] + window))
    return found


def _meet(window: int):
    """Rows of _SENT of a partition, sorted by key, hot, tie and doc, to (doc_id, ranges)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[int, list[tuple[int, int]]] = {}
        known: list[tuple[int, bytes]] = []
        n_found = 0

        def out() -> pa.RecordBatch:
            nonlocal found, known, n_found
            rows = [(doc, np.array(merged(x), np.int64).tobytes()) for doc, x in found.items()] + known
            found, known, n_found = {}, [], 0
            return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.binary())], ["doc_id", "ranges"])

        def bucket(rows: list[tuple[int, int, bytes]], key: int) -> int:
            if len(rows) > 1:
                hits = match(np.full(len(rows), key), np.array([r[0] for r in rows], np.int64), np.array([r[1] for r in rows], np.int64), [r[2] for r in rows], window)
                for doc, lo, hi in hits:
                    cover(found.setdefault(doc, []), lo, hi)
                return len(hits)
            return 0

        last: tuple = ()
        held: list[tuple[int, int, bytes]] = []  # super-k-mers of one minimiser, at most HOT
        firsts: list[tuple[bytes, int]] = []  # of windows with one digest: the words and the least doc of each
        for batch in batches:
            for key, hot, tie, doc, starts, packed in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if key is None:
                    known.append((doc, starts))
                    n_found += 1
                    continue
                at = np.frombuffer(starts, np.int64)
                if (key, hot, tie) != last:
                    n_found += bucket(held, last[0]) if held else 0
                    held, firsts, last = [], [], (key, hot, tie)
                if not hot:
                    held += [(doc, x, packed) for x in at.tolist()]
                    continue
                least = next((d for words, d in firsts if words == packed), None)
                if least is None:  # two texts with one 128-bit digest would only make this list longer
                    firsts.append((packed, doc))
                elif least < doc:
                    more = spans(at, window)
                    found.setdefault(doc, []).extend(more)
                    n_found += len(more)
            if n_found > 500_000:
                yield out()
        if held:
            bucket(held, last[0])
        yield out()

    return run


def repeated_ranges(docs: DataFrame, window: int = WINDOW, mmer: int = MMER, hot: int = HOT, target: int = TARGET) -> DataFrame:
    """(doc_id, ranges): word ranges to remove, as pairs of longs (first, end) in a binary; only texts that have any."""
    spark = docs.sparkSession
    prepare(spark)
    texts = id_and_text(docs)
    shared, listed = shared_minimisers(texts, window, mmer, hot, target)
    asked = texts.join(shared, "doc_id").select("doc_id", "text", "cold", "hot")
    sent = asked.mapInArrow(_send(window, mmer, listed), _SENT)
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = F.when(F.col("key").isNull(), F.xxhash64("doc")).otherwise(F.xxhash64("key", "tie"))  # ranges need no meeting
    met = sent.repartition(parts, dealt).sortWithinPartitions("key", "hot", "tie", "doc").mapInArrow(_meet(window), "doc_id long, ranges binary")
    return written(met.groupBy("doc_id").agg(F.array_join(F.array_sort(F.collect_list(F.hex("ranges"))), "").alias("hex")).select("doc_id", F.unhex("hex").alias("ranges")), "ranges")


def deduplicated(docs: DataFrame, window: int = WINDOW, mmer: int = MMER, keep_text: bool = False) -> DataFrame:
    """(doc_id, n_words, n_removed, kept_sha256[, text]): the kept words, joined by one space; unchanged texts stay as they are in ``text``."""
    ranges = repeated_ranges(docs, window, mmer)
    joined = id_and_text(docs).join(ranges, "doc_id", "left").select("doc_id", "text", "ranges")
    schema = "doc_id long, n_words long, n_removed long, kept_sha256 string" + ", text string" * keep_text

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, gone, shas, kept = [], [], [], []
            for text, cuts in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                words = (text or b"").split()
                left, at, removed = [], 0, 0
                for lo, hi in merged(np.frombuffer(cuts or b"", np.int64).reshape(-1, 2).tolist()):
                    hi = min(hi, len(words))
                    left += words[at:lo]
                    removed += max(0, hi - lo)
                    at = max(at, hi)
                left += words[at:]
                joined_words = b" ".join(left)
                n.append(len(words))
                gone.append(removed)
                shas.append(hashlib.sha256(joined_words).hexdigest())
                if keep_text:
                    kept.append((joined_words if removed else text).decode("utf-8", "replace") if text is not None else None)
            out = [batch.column(0), pa.array(n, pa.int64()), pa.array(gone, pa.int64()), pa.array(shas, pa.string())] + [pa.array(kept, pa.string())] * keep_text
            yield pa.RecordBatch.from_arrays(out, ["doc_id", "n_words", "n_removed", "kept_sha256"] + ["text"] * keep_text)

    return joined.mapInArrow(run, schema)


def replaced(docs: DataFrame, window: int = WINDOW, mmer: int = MMER) -> DataFrame:
    """``docs`` with repeated windows cut out of ``text``, and ``n_chars`` to match; the other columns stay.

    The text is shuffled once, to meet its ranges. A text that is repeated as a whole becomes empty.
    """
    ranges = repeated_ranges(docs, window, mmer)
    names = docs.columns
    joined = docs.withColumn("text", F.col("text").cast("binary")).withColumnRenamed("ranges", "ranges ").join(ranges, "doc_id", "left")

    @F.pandas_udf("string")
    def cut(text: pd.Series, cuts: pd.Series) -> pd.Series:
        def one(t, c):
            if t is None or c is None:
                return None if t is None else t.decode("utf-8", "replace")
            words = t.split()
            left, at = [], 0
            for lo, hi in merged(np.frombuffer(c, np.int64).reshape(-1, 2).tolist()):
                left += words[at:lo]
                at = max(at, hi)
            return b" ".join(left + words[at:]).decode("utf-8", "replace")

        return pd.Series([one(t, c) for t, c in zip(text, cuts, strict=True)], dtype=object)

    out = joined.withColumn("text", cut("text", "ranges"))
    out = out.drop("ranges").withColumnRenamed("ranges ", "ranges")
    if "n_chars" in names:
        out = out.withColumn("n_chars", F.length("text").cast("long"))
    return out.select(names)


def op10_substring(docs: DataFrame) -> DataFrame:
    return deduplicated(docs)
