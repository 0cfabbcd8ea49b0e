"""Packing token sequences into as few bins as possible, by bin completion.

Texts are encoded and cut into pieces; only the counts of each piece length (at most
``capacity`` numbers at any input size) reach the driver. There the bins are planned:
around the largest length that is left, undominated fillings are enumerated, branches
whose waste exceeds what the best known solution allows are pruned, and best fit
decreasing is the first incumbent. A pattern is used for many bins at once, so the plan
is small. Lists of up to EXACT pieces are solved exactly; longer ones are searched within
NODES nodes of BRANCHES fillings each, and come out at ``least_bins`` or near it. Each piece then
gets a rank among those of its length (in salted groups, so that a length that very
many pieces have is not ranked in one task), and the rank is its place in the plan.

Null and empty texts are one piece, the end token. Repeated rows, and rows with a null
doc_id, are pieces of their own; ties of a rank go by doc_id, piece and checksum. A very
long text is many pieces of a whole sequence and a rest. An empty table gives no rows.
Only doc_id and text are read, so other columns may have any name.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import tokens
from .common import id_and_text, prepare, written

CAPACITY = 1024
END_ID = 2
#: Pieces of a list whose search is exact: every undominated filling is enumerated (they have fewer than STEPS).
EXACT = 14
STEPS, SMALL_NODES = 1 << 14, 1 << 20
#: Beyond that: branch-and-bound nodes before the incumbent is taken, fillings tried at a node, and partial ones looked at.
NODES = 2000
BRANCHES = 6
FEW_STEPS = 200
#: Rows that share a rank counter, and counters that are summed in one task.
GROUP_ROWS = 50_000
BLOCK = 1000

PIECE = "doc_id long, piece int, start long, length long, ids_crc32 long"


def pieces(docs: DataFrame, capacity: int = CAPACITY, end_id: int = END_ID, vocabulary: str | None = None, cache_rows: int = tokens.CACHE_ROWS) -> DataFrame:
    """One row for each piece. A text of more than ``capacity`` ids is cut; its first piece is the shorter one."""
    prepare(docs.sparkSession)
    path = vocabulary or tokens.vocabulary("byte_bpe_50k.json")
    end = np.array([end_id], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = tokens.load(path, rows=cache_rows)
        for batch in batches:
            rows: tuple[list, ...] = ([], [], [], [], [])
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                ids = coder.encode((text or b"").decode("utf-8", "replace")) + end
                n = len(ids) // 4
                cuts = [0, *range(n % capacity or capacity, n + 1, capacity)] if n > capacity else [0, n]
                for k, (lo, hi) in enumerate(zip(cuts, cuts[1:], strict=False)):
                    for column, value in zip(rows, (doc, k, lo, hi - lo, zlib.crc32(ids[4 * lo : 4 * hi])), strict=True):
                        column.append(value)
            names = ("doc_id", "piece", "start", "length", "ids_crc32")
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(column, kind) for column, kind in zip(rows, kinds, strict=True)], names)

    return id_and_text(docs).mapInArrow(run, PIECE)


def least_bins(counts: dict[int, int], capacity: int) -> int:
    """A lower bound: bins for the large lengths, plus what the small ones need beyond the room left beside them."""
    many = np.zeros(capacity + 1, np.int64)
    for length, n in counts.items():
        many[length] = n
    size = many * np.arange(capacity + 1)
    n_to, s_to = np.cumsum(many), np.cumsum(size)
    best = -(-int(s_to[-1]) // capacity)
    half = capacity // 2
    for k in range(half + 1):  # lengths over capacity - k stand alone; those under k are left out
        alone = int(n_to[capacity] - n_to[capacity - k])
        big = int(n_to[capacity - k] - n_to[half]) if capacity - k > half else 0
        room = big * capacity - int(s_to[capacity - k] - s_to[half]) if capacity - k > half else 0
        small = int(s_to[half] - (s_to[k - 1] if k else 0))
        best = max(best, alone + big + max(0, -(-(small - room) // capacity)))
    return best


def best_fit(counts: dict[int, int], capacity: int) -> list[tuple[tuple[int, ...], int]]:
    """Best fit decreasing over counts: bins with the same content are handled as one, whatever their number."""
    open_: dict[int, dict[tuple[int, ...], int]] = {}  # room left: content: bins
    for length in sorted(counts, reverse=True):
        n = counts[length]
        while n:
            room = min((r for r in open_ if r >= length), default=None)
            if room is None:
                each = capacity // length
                for content, bins in (((length,) * each, n // each), ((length,) * (n % each), 1 if n % each else 0)):
                    if bins:
                        there = open_.setdefault(capacity - sum(content), {})
                        there[content] = there.get(content, 0) + bins
                break
            content, bins = open_[room].popitem()
            if not open_[room]:
                del open_[room]
            each = min(room // length, n)
            times = min(bins, n // each)
            there = open_.setdefault(room - each * length, {})
            there[content + (length,) * each] = there.get(content + (length,) * each, 0) + times
            n -= times * each
            if bins > times:
                open_.setdefault(room, {})[content] = bins - times
    return [(content, bins) for there in open_.values() for content, bins in there.items()]


def dominated(used: tuple[int, ...], waste: int, others: list[int]) -> bool:
    """Whether a length that is left out could stand for lengths that are in, at no more than the filling's waste.

    Putting it in for them fills the room at least as well and leaves smaller lengths, which fit wherever it would.
    """
    if any(x <= waste for x in others):  # for none of them: there is room for it
        return True
    one, more = set(), set()  # sums of one length, and of several
    for x in used[:12]:  # of very many lengths in one bin only so many are put together
        more |= {t + x for t in one | more}
        one.add(x)
    return any(t < x <= t + waste for x in others for t in one) or any(t <= x <= t + waste for x in others for t in more)


def fillings(lengths: list[int], counts: dict[int, int], room: int, most: int = 0, steps: int = STEPS, even: bool = False) -> list[tuple[int, ...]]:
    """Undominated fillings of ``room``, least waste first: of equal waste, those of fewer and larger lengths first.

    lengths: descending. most: that many fillings at most (0: all). steps: partial fillings that are looked at.
    even: of pairs that fill the room, those of like lengths come first, which keeps the small ones.
    """
    if counts.get(room):
        return [(room,)]  # one length that fills the room dominates all else
    usable = [x for x in lengths if x <= room and counts[x]]
    if not usable:
        return [()]
    pairs: list[tuple[int, ...]] = []
    if most:  # pairs that fill it are found at once, however many lengths there are
        for a in usable:
            b = room - a
            if b > a:
                break
            if counts.get(b, 0) > (a == b):
                pairs.append((a, b))
        pairs = (pairs[::-1] if even else pairs)[:most]
    found: list[tuple[int, tuple[int, ...]]] = []
    budget, least = steps, usable[-1]

    def grow(at: int, left: int, used: tuple[int, ...]) -> None:
        """Take each next length as often as it fits, then less often; a filling that takes more is not yet one."""
        nonlocal budget
        budget -= 1
        if left < least:
            found.append((left, used))
            return
        fitted = False
        for k in range(at, len(usable)):
            x = usable[k]
            for times in range(min(counts[x], left // x), 0, -1):
                fitted = True
                grow(k + 1, left - times * x, (*used, *[x] * times))
                if budget <= 0 and found:
                    return
        if not fitted:
            found.append((left, used))

    grow(0, room, ())
    best = sorted(set(found), key=lambda x: (x[0], len(x[1]), [-y for y in x[1]]))
    out, seen = list(pairs), set(pairs)
    for waste, used in best:
        if most and len(out) >= most:
            break
        others = [x for x in usable if counts[x] > used.count(x)]
        if used not in seen and not dominated(used, waste, others):
            out.append(used)
    return out or [best[0][1]]


def plan(counts: dict[int, int], capacity: int = CAPACITY, nodes: int = NODES) -> list[tuple[tuple[int, ...], int]]:
    """[(lengths of a bin, number of such bins)], covering ``counts`` exactly."""
    counts = {k: n for k, n in counts.items() if n}
    goal = least_bins(counts, capacity)
    best = best_fit(counts, capacity)
    if sum(counts.values()) <= EXACT:
        return complete(counts, capacity, goal, best, SMALL_NODES, 0, False)
    for even in (False, True):
        best = complete(counts, capacity, goal, best, nodes, BRANCHES, even)
    return best


def complete(counts: dict[int, int], capacity: int, goal: int, best: list[tuple[tuple[int, ...], int]], nodes: int, most: int, even: bool) -> list[tuple[tuple[int, ...], int]]:
    """The best of ``best`` and what the search finds within its nodes; it ends at ``goal`` bins.

    A node fills the bin of the largest length left. A filling is used for as many bins as the counts
    allow, for half as many, and so on to one, so a plan may mix fillings around the same length.
    """
    total = sum(k * n for k, n in counts.items())
    best_bins, left_nodes = sum(n for _, n in best), nodes
    seen: dict[frozenset, int] = {}
    # each entry: counts left, patterns so far, bins so far, waste so far
    stack = [(counts, None, 0, 0)]
    while stack and best_bins > goal and left_nodes > 0:
        have, chain, bins, waste = stack.pop()
        left_nodes -= 1
        if waste > (best_bins - 1) * capacity - total:
            continue  # with so much waste it takes as many bins as the incumbent
        if not have:
            best_bins, best = bins, []
            while chain:
                best.append(chain[:2])
                chain = chain[2]
            continue
        if not most:  # a small list: the same rest is not searched twice, and a bound of its own prunes it
            state = frozenset(have.items())
            if seen.get(state, best_bins) <= bins or bins + least_bins(have, capacity) >= best_bins:
                continue
            seen[state] = bins
        lengths = sorted(have, reverse=True)
        top = lengths[0]
        have[top] -= 1
        options = fillings(lengths, have, capacity - top, most, FEW_STEPS if most else STEPS, even)
        have[top] += 1
        for filling in reversed(options):
            pattern = (top, *filling)
            need: dict[int, int] = {}
            for x in pattern:
                need[x] = need.get(x, 0) + 1
            times, uses = min(have[x] // k for x, k in need.items()), []
            while times:
                uses.append(times)
                times = times - 1 if not most else times // 2
            for times in reversed(uses if len(options) > 1 else uses[:1]):
                after = dict(have)
                for x, k in need.items():
                    after[x] -= k * times
                    if not after[x]:
                        del after[x]
                stack.append((after, (pattern, times, chain), bins + times, waste + times * (capacity - sum(pattern))))
    return best


def places(patterns: list[tuple[tuple[int, ...], int]]) -> list[tuple[int, int, int, int, int, int]]:
    """(length, first rank, end rank, first sequence, in a bin, offset) for each length of each pattern."""
    taken: dict[int, int] = {}
    rows, sequence = [], 0
    for pattern, times in patterns:
        at = 0
        for length in sorted(set(pattern), reverse=True):
            k = pattern.count(length)
            lo = taken.get(length, 0)
            rows.append((length, lo, lo + k * times, sequence, k, at))
            taken[length] = lo + k * times
            at += k * length
        sequence += times
    return rows


def packed(docs: DataFrame, capacity: int = CAPACITY, end_id: int = END_ID, vocabulary: str | None = None, cache_rows: int = tokens.CACHE_ROWS) -> DataFrame:
    """The pieces with sequence_id and offset: each sequence is gapless from 0 and holds at most ``capacity`` ids.

    cache_rows: words whose ids a worker keeps, which is memory against time; the ids are the same.
    """
    spark = docs.sparkSession
    cut = written(pieces(docs, capacity, end_id, vocabulary, cache_rows), "pieces")
    counts = {r.length: r["n"] for r in cut.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}  # at most ``capacity`` rows
    plan_rows = places(plan(counts, capacity))
    salts = max(32, sum(counts.values()) // GROUP_ROWS)
    salted = cut.withColumn("salt", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(salts)).cast("int"))
    groups = salted.groupBy("length", "salt").agg(F.count(F.lit(1)).alias("n")).withColumn("block", F.floor(F.col("salt") / BLOCK))
    # groups are summed in blocks, and the blocks of a length: neither sum meets more than a bounded share of its length's groups
    earlier = lambda w: F.coalesce(F.sum("n").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    blocks = groups.groupBy("length", "block").agg(F.sum("n").alias("n")).select("length", "block", earlier(Window.partitionBy("length").orderBy("block")).alias("base"))
    offsets = groups.withColumn("own", earlier(Window.partitionBy("length", "block").orderBy("salt"))).join(blocks, ["length", "block"])
    offsets = offsets.select("length", "salt", (F.col("base") + F.col("own")).alias("before"))
    own = Window.partitionBy("length", "salt").orderBy("doc_id", "piece", "ids_crc32")
    ranked = salted.withColumn("own", F.row_number().over(own) - 1).join(offsets, ["length", "salt"]).withColumn("rank", F.col("before") + F.col("own"))
    # the plan has a bounded number of rows: at most a pattern for each count that runs out
    table = spark.createDataFrame(plan_rows, "l long, lo long, hi long, first long, k long, at long")
    found = ranked.join(F.broadcast(table), (F.col("length") == F.col("l")) & (F.col("rank") >= F.col("lo")) & (F.col("rank") < F.col("hi")))
    index = F.col("rank") - F.col("lo")
    return found.select(
        "doc_id", "piece", "start", "length", "ids_crc32",
        (F.col("first") + F.floor(index / F.col("k"))).cast("long").alias("sequence_id"),
        (F.col("at") + F.col("length") * (index % F.col("k"))).alias("offset"),
    )


def op5_packing(docs: DataFrame) -> DataFrame:
    return packed(docs)
