"""SimHash near-duplicate groups: tiled exact comparison of 64-bit fingerprints.

Every text gets a fingerprint of its word shingles; fingerprints at ``radius``
or fewer differing bits are linked, and linked ones form a component.

Candidates: the 64 bits are cut into radius + 2 blocks. Two fingerprints within
the radius agree on two blocks at least, so each distinct fingerprint goes to one
bucket for each pair of blocks, and no link can be missed. In a bucket, tiles of
fingerprints ordered by their population count are compared with exclusive-or and
bit counts; pairs of tiles whose counts differ by more than the radius are skipped.
Buckets of more than TILE fingerprints are dealt out as pairs of tiles to many
tasks. A task sends on a spanning forest of the links it finds, never all pairs.

``representatives`` keeps one row of each group of texts whose word shingles (five words)
have a Jaccard similarity of 0.8 or more. Such texts differ by more bits than whole blocks
can cover, so their fingerprints, here of the set of their shingles, meet in the buckets of
band keys (least hashes of their shingles) and are compared there by the same tiles with
population-count skips (``near``); what is found is held against the shingles themselves. First each text is compared with leaders only, which
links most of a large group; then all pairs of a bucket that are not in one group yet are
compared, so a large group of copies costs little. What two passes leave to chance, pairs that share no band key or
whose fingerprints are further apart, a third finds without any (``remaining_links``). See there.

Null, empty and blank texts have fingerprint 0 and are linked like any other;
repeated rows share a component; an empty table gives no rows. A null doc_id is no
smallest one unless its component has no other. A fingerprint bit that half the
shingles have is 0. A very long text is one row, fingerprinted in parts. Only doc_id
and text are read, so other columns may have any name.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import combinations, repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import HOT_KEYS, HOT_ROWS, dealt_join, id_and_text, prepare, written
from .graph import components

SEED = 42
SHINGLE = 4
RADIUS = 4
#: Fingerprints compared as one block; larger buckets are dealt out in pairs of tiles.
TILE = 2048
#: Of similar texts: words of a shingle, and the least Jaccard similarity.
SIMILAR_SHINGLE, SIMILARITY = 5, 0.8
#: Bits by which texts differ at most to be held against one another: a bit of the fingerprints of two sets at 0.8
#: differs with a probability of 0.19 at most, so more than 32 bits do with one of about 1e-8; and to follow a leader.
SIMILAR_RADIUS, LEAD_RADIUS = 32, 20
#: Band keys of a text and the least hashes that make one: a pair at 0.8 shares none with a probability of 3e-5.
BANDS, ROWS = 20, 4
#: Classes of a part of a large bucket in the first pass, and of a tile in the second, with columns of a product there.
PART_ROWS, SET_TILE, COLUMNS = 100_000, 512, 4096
#: Bits of the parities of a class's shingles; shingles counted at once, and how often and how many of them are put last.
PARITIES, COUNTED, COMMON, COMMON_KEYS = 512, 1 << 20, 50, 100_000
_TIE, _NTH = "simhash: tie", "simhash: nth"


def fingerprint(text: bytes | None, shingle: int = SHINGLE) -> int:
    """The fingerprint of one text, unsigned."""
    import xxhash

    words = (text or b"").lower().split()
    if not words:
        return 0
    if len(words) < shingle:
        grams, n = [b" ".join(words)], 1
    else:
        grams, n = map(b" ".join, zip(*(words[i:] for i in range(shingle)), strict=False)), len(words) - shingle + 1
    hashes = np.fromiter(map(xxhash.xxh64_intdigest, grams, repeat(SEED)), np.uint64, n)
    ones = np.zeros(64, np.int64)
    for at in range(0, n, 65536):
        part = hashes[at : at + 65536]
        ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits((2 * ones > n).astype(np.uint8), bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """(doc_id, fp): fp is the fingerprint as a signed long."""
    prepare(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = np.fromiter((fingerprint(x, shingle) for x in batch.column(1).to_pylist()), np.uint64, batch.num_rows)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out.view(np.int64))], ["doc_id", "fp"])

    return id_and_text(docs).mapInArrow(run, "doc_id long, fp long")


def block_keys(radius: int = RADIUS) -> list[tuple[int, int, int]]:
    """(number, mask, shift-free) masks of each pair of blocks as signed 64-bit numbers."""
    edges = np.linspace(0, 64, radius + 3).astype(int)
    blocks = [sum(1 << b for b in range(lo, hi)) for lo, hi in zip(edges, edges[1:], strict=False)]
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    return [(i, signed(p | q), 0) for i, (p, q) in enumerate(combinations(blocks, 2))]


def near(left: np.ndarray, right: np.ndarray, radius: int, step: int = 256) -> np.ndarray:
    """Which of the left are within the radius of which of the right, both in the order of their population counts.

    Exclusive-or and bit counts, a tile of both at a time; tiles whose population counts are further apart than the
    radius are skipped, as no pair of them can be within it.
    """
    out = np.zeros((len(left), len(right)), bool)
    count_l, count_r = np.bitwise_count(left).astype(np.int16), np.bitwise_count(right).astype(np.int16)
    for i in range(0, len(left), step):
        for j in range(0, len(right), step):
            l, r = count_l[i : i + step], count_r[j : j + step]
            if l.min() - r.max() > radius or r.min() - l.max() > radius:
                continue
            out[i : i + step, j : j + step] = np.bitwise_count(left[i : i + step, None] ^ right[None, j : j + step]) <= radius
    return out


def forest(left: np.ndarray, right: np.ndarray | None, radius: int, checked: Callable[[np.ndarray], np.ndarray] | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Spanning forest of the links within ``left``, or between left and right: places (node, root) in left followed by right.

    Prints are in the order of their population counts. checked: an exact check that follows; it takes which pairs
    are within the radius, and returns which of them are links.
    """
    cut = len(left)
    linked = near(left, left if right is None else right, radius)
    if checked is not None:
        linked = checked(linked)
    if right is not None:
        both = np.zeros((cut + len(right),) * 2, bool)
        both[:cut, cut:], both[cut:, :cut] = linked, linked.T
        linked = both
    free, nodes_out, roots_out = np.ones(len(linked), bool), [], []
    for start in range(len(linked)):
        if not free[start]:
            continue
        free[start] = False
        front = np.array([start])
        while len(front):
            reached = linked[front].any(axis=0) & free
            front = np.flatnonzero(reached)
            free[front] = False
            nodes_out.append(front)
            roots_out.append(np.full(len(front), start))
    return (np.concatenate(nodes_out), np.concatenate(roots_out)) if nodes_out else (np.zeros(0, int), np.zeros(0, int))


def small_groups(fps: np.ndarray, group: np.ndarray, size: int, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Links within groups of at most ``size`` neighbours in an array: one exclusive-or for each distance."""
    a, b = [], []
    for d in range(1, size):
        if d >= len(fps):
            break
        hit = np.flatnonzero((group[d:] == group[:-d]) & (np.bitwise_count(fps[d:] ^ fps[:-d]) <= radius))
        a.append(fps[hit])
        b.append(fps[hit + d])
    return (np.concatenate(a), np.concatenate(b)) if a else (fps[:0], fps[:0])


def _compare(radius: int):
    """A function for mapInArrow over rows (key, i, j, side, fp) sorted by key, i, j, side, fp."""
    SMALL = 32

    def links(key: np.ndarray, side: np.ndarray, fps: np.ndarray, starts: np.ndarray):
        ends = np.append(starts[1:], len(fps))
        sizes = ends - starts
        whole = np.repeat(sizes, sizes)
        calm = whole <= SMALL
        out = []
        mixed = np.repeat(np.logical_or.reduceat(side > 0, starts), sizes) if len(starts) else side > 0
        calm &= ~mixed
        if calm.any():
            out.append(small_groups(fps[calm], np.repeat(starts, sizes)[calm], int(whole[calm].max()), radius))
        for lo, hi in zip(starts, ends, strict=True):
            if calm[lo] or hi - lo < 2:
                continue
            part, where = fps[lo:hi], side[lo:hi]
            left, right = part[where == 0], part[where == 1]
            if mixed[lo] and len(left) and len(right):
                node, root = forest(left, right, radius)
            elif not mixed[lo]:
                node, root = forest(left, None, radius)
            else:
                continue
            both = np.concatenate([left, right])
            out.append((both[node], both[root]))
        a = np.concatenate([x for x, _ in out]) if out else fps[:0]
        b = np.concatenate([x for _, x in out]) if out else fps[:0]
        keep = a != b
        return pa.RecordBatch.from_arrays([pa.array(a[keep].view(np.int64)), pa.array(b[keep].view(np.int64))], ["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest = None
        for batch in batches:
            cols = [np.asarray(batch.column(k)) for k in range(5)]
            if rest is not None:
                cols = [np.concatenate([x, y]) for x, y in zip(rest, cols, strict=True)]
            key, i, j, side, fps = cols
            new = np.flatnonzero((key[1:] != key[:-1]) | (i[1:] != i[:-1]) | (j[1:] != j[:-1])) + 1
            if not len(new):
                rest = cols
                continue
            last = new[-1]
            starts = np.concatenate([[0], new[:-1]])
            yield links(key[:last], side[:last], fps[:last].view(np.uint64), starts)
            rest = [x[last:] for x in cols]
        if rest is not None and len(rest[0]):
            yield links(rest[0], rest[3], rest[4].view(np.uint64), np.array([0]))

    return run


def links(distinct: DataFrame, radius: int = RADIUS, tile: int = TILE) -> DataFrame:
    """(a, b): links between distinct fingerprints (fp), whose components are those of all links."""
    number = len(block_keys(radius))
    keyed = distinct.select("fp", F.posexplode(F.array(*[F.col("fp").bitwiseAND(F.lit(mask)) for _, mask, _ in block_keys(radius)])).alias("k", "v"))
    keyed = keyed.select("fp", F.xxhash64("k", "v").alias("key"), F.bit_count("fp").alias("p"))
    sizes = keyed.groupBy("key", "p").agg(F.count(F.lit(1)).alias("n"))
    hot = written(
        sizes.groupBy("key").agg(F.sum("n").alias("n"), F.map_from_entries(F.collect_list(F.struct("p", F.ceil(F.col("n") / tile).cast("int").alias("t")))).alias("tiles")).where(F.col("n") > tile).select("key", "tiles"),
        "hot-buckets",
    )
    calm = keyed.join(hot.select("key"), "key", "left_anti").select("key", F.lit(0).alias("i"), F.lit(0).alias("j"), F.lit(0).alias("side"), "fp")
    # tiles of a hot bucket are (population count, number); a row goes to each pair of tiles that may hold a link of it
    tile_no = lambda p, s: p * F.lit(1 << 20) + s
    mine = keyed.join(hot, "key").withColumn("own", tile_no(F.col("p"), F.pmod(F.xxhash64("fp", F.lit(number)), F.col("tiles")[F.col("p")]).cast("int")))
    others = F.flatten(F.transform(F.filter(F.map_keys("tiles"), lambda q: F.abs(q - F.col("p")) <= radius), lambda q: F.transform(F.sequence(F.lit(0), F.col("tiles")[q] - 1), lambda s: tile_no(q, s))))
    dealt = mine.select("key", "fp", "own", F.explode(others).alias("other")).select(
        "key", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), F.when(F.col("own") <= F.col("other"), 0).otherwise(1).alias("side"), "fp"
    )
    rows = calm.unionByName(dealt)
    parts = int(distinct.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = rows.repartition(parts, "key", "i", "j").sortWithinPartitions("key", "i", "j", F.bit_count("fp"), "fp")
    return rows.mapInArrow(_compare(radius), "a long, b long").distinct()


def near_duplicates(docs: DataFrame, shingle: int = SHINGLE, radius: int = RADIUS, tile: int = TILE) -> DataFrame:
    """(doc_id, fp, component_id): component_id is the smallest doc_id reachable over links."""
    prints = written(fingerprints(docs, shingle), "fingerprints")
    distinct = written(prints.groupBy("fp").agg(F.min("doc_id").alias("least")), "distinct-fingerprints")
    roots = components(links(distinct, radius, tile))
    grouped = written(distinct.join(roots, distinct.fp == roots.node, "left").select("fp", "least", F.coalesce("root", "fp").alias("root")), "grouped")
    best = grouped.groupBy("root").agg(F.min("least").alias("component_id"))
    classes = written(dealt_join(grouped, best, "root").select("fp", "component_id"), "classes")
    return dealt_join(prints, classes, "fp").select("doc_id", "fp", "component_id")


def shingle_hashes(text: bytes | None, shingle: int = SIMILAR_SHINGLE) -> np.ndarray:
    """Hashes of a text's word shingles, repeats included; fewer words are one shingle, none are none."""
    import xxhash

    words = (text or b"").lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    if len(words) < shingle:
        return np.array([xxhash.xxh64_intdigest(b" ".join(words), SEED)], np.uint64)
    grams = map(b" ".join, zip(*(words[i:] for i in range(shingle)), strict=False))
    return np.fromiter(map(xxhash.xxh64_intdigest, grams, repeat(SEED)), np.uint64, len(words) - shingle + 1)


def band_keys(hashes: np.ndarray) -> np.ndarray:
    """BANDS keys, each of the least values that ROWS random functions take on the hashes."""
    factors = np.random.default_rng(SEED).integers(1, 1 << 63, BANDS * ROWS, np.uint64) * np.uint64(2) + np.uint64(1)
    least = np.full(BANDS * ROWS, np.uint64(2**64 - 1))
    for at in range(0, len(hashes), 2048):
        with np.errstate(over="ignore"):
            mixed = hashes[at : at + 2048, None] * factors[None, :]
        np.minimum(least, mixed.min(axis=0), out=least)
    keys = np.zeros(BANDS, np.uint64)
    with np.errstate(over="ignore"):
        for k, column in enumerate(least.reshape(BANDS, ROWS).T):
            keys = (keys ^ (column + np.arange(BANDS, dtype=np.uint64) + np.uint64(k))) * np.uint64(0x9E3779B97F4A7C15)
            keys ^= keys >> np.uint64(31)
    return keys


def class_of(distinct: np.ndarray) -> int:
    """The name of a set of shingles, sorted; 0 for none."""
    import xxhash

    return int(np.uint64(xxhash.xxh64_intdigest(distinct.tobytes(), SEED)).view(np.int64)) if len(distinct) else 0


def parities(distinct: np.ndarray) -> bytes:
    """Which of PARITIES parts of the hashes hold an odd number: two sets differ in as many elements as their parities do, at least."""
    return np.packbits((np.bincount((distinct % np.uint64(PARITIES)).astype(np.int64), minlength=PARITIES) & 1).astype(np.uint8)).tobytes()


def _signed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (doc_id, tie, cls, fp, n, keys, odd) from (doc_id, text, tie): cls names the set of a text's shingles, fp is its fingerprint, n their number, keys are its bands, odd their parities."""
    for batch in batches:
        classes, prints, sizes, keys, odd = [], [], [], [], []
        for text in batch.column(1).to_pylist():
            distinct = np.unique(shingle_hashes(text))
            ones = np.zeros(64, np.int64)
            for at in range(0, len(distinct), 65536):
                ones += np.unpackbits(distinct[at : at + 65536].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
            prints.append(np.packbits((2 * ones > len(distinct)).astype(np.uint8), bitorder="little").view(np.int64)[0])
            classes.append(class_of(distinct))
            odd.append(parities(distinct))
            sizes.append(len(distinct))
            keys.append(band_keys(distinct).view(np.int64) if len(distinct) else np.zeros(0, np.int64))
        columns = [batch.column(0), batch.column(2), pa.array(classes, pa.int64()), pa.array(prints, pa.int64()), pa.array(sizes, pa.int64()), pa.array(keys, pa.list_(pa.int64())), pa.array(odd, pa.binary())]
        yield pa.RecordBatch.from_arrays(columns, ["doc_id", "tie", "cls", "fp", "n", "keys", "odd"])


def stars(cls: np.ndarray, fps: np.ndarray, leaders: np.ndarray, prints: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(leader, follower, leaders, prints) of classes: each follows the first leader within the radius, or leads those behind it.

    Both sides are compared in tiles in the order of their population counts.
    """
    head, own = (np.argsort(np.bitwise_count(x), kind="stable") for x in (prints, fps))
    ahead = near(fps[own], prints[head], radius)
    led = np.empty(len(cls), bool)
    led[own] = ahead.any(axis=1)
    first = np.empty(len(cls), np.int64)
    first[own] = leaders[head[ahead.argmax(axis=1)]]
    free = np.flatnonzero(~led)
    new = []
    if len(free):
        place = np.argsort(np.bitwise_count(fps[free]), kind="stable")
        among = near(fps[free[place]], fps[free[place]], radius)
        at = np.empty(len(free), np.int64)
        at[place] = np.arange(len(free))
        open_ = np.ones(len(free), bool)  # by population count, as the rows of among
        for k, row in zip(free.tolist(), at.tolist(), strict=True):
            if open_[row]:
                own_ = place[np.flatnonzero(among[row] & open_)]
                open_ &= ~among[row]
                first[free[own_]] = cls[k]
                new.append(k)
    keep = first != cls
    return first[keep], cls[keep], np.concatenate([leaders, cls[new]]), np.concatenate([prints, fps[new]])


def _followers(radius: int):
    """Pairs (a, b) of a class and its leader, from rows (key, part, place, cls, fp, first_cls, first_fp) sorted by key, part and place.

    A bucket's first class leads; another that is further from all leaders than the radius becomes one.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, leaders, prints = None, np.zeros(0, np.int64), np.zeros(0, np.uint64)
        for batch in batches:
            key, part, _, cls, fp, first_cls, first_fp = (np.asarray(c) for c in batch.columns)
            fp, first_fp = fp.view(np.uint64), first_fp.view(np.uint64)
            out = []
            edges = np.flatnonzero((key[1:] != key[:-1]) | (part[1:] != part[:-1])) + 1
            for lo, hi in zip([0, *edges.tolist()], [*edges.tolist(), len(key)], strict=True):
                if last != (bucket := (int(key[lo]), int(part[lo]))):
                    last, leaders, prints = bucket, first_cls[lo : lo + 1], first_fp[lo : lo + 1]  # the same leader in every part of the bucket
                for at in range(lo, hi, SET_TILE):
                    end = min(hi, at + SET_TILE)
                    a, b, leaders, prints = stars(cls[at:end], fp[at:end], leaders, prints, radius)
                    out.append(np.sort(np.column_stack([a, b]), axis=1))
            rows = np.unique(np.concatenate([np.zeros((0, 2), np.int64), *out]), axis=0)
            yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(rows[:, k])) for k in (1, 0)], ["a", "b"])

    return run


def shared_counts(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """How many values each set of the left shares with each of the right, sets being sorted arrays without repeats.

    Values that one side lacks count nowhere, so they are left out; the others are columns of two 0/1 matrices, whose
    product is taken a block of columns at a time.
    """
    flat = [np.concatenate(x) if x else np.zeros(0, np.uint64) for x in (left, right)]
    both = np.intersect1d(*flat)
    out = np.zeros((len(left), len(right)), np.float32)
    rows = [np.repeat(np.arange(len(x)), [len(v) for v in x]) for x in (left, right)]
    at = [np.searchsorted(both, v) for v in flat]
    known = [(i < len(both)) & (both[np.minimum(i, max(len(both) - 1, 0))] == v) if len(both) else np.zeros(len(v), bool) for i, v in zip(at, flat, strict=True)]
    for lo in range(0, len(both), COLUMNS):
        parts = []
        for side, n in ((0, len(left)), (1, len(right))):
            own = known[side] & (at[side] >= lo) & (at[side] < lo + COLUMNS)
            block = np.zeros((n, min(COLUMNS, len(both) - lo)), np.float32)
            block[rows[side][own], at[side][own] - lo] = 1
            parts.append(block)
        out += parts[0] @ parts[1].T
    return out


def _apart(radius: int, similarity: float):
    """Links (a, b) between groups, from rows (key, i, j, side, root, fp, hashes) sorted by key, i, j; hashes are a class's shingles.

    Classes of different groups whose fingerprints are within the radius, and whose numbers of shingles allow the
    similarity, are compared exactly; of the links a spanning forest (``forest``) is sent on.
    """

    def found(side, root, fps, hashes) -> np.ndarray:
        order = np.argsort(np.bitwise_count(fps), kind="stable")
        side, root, fps = side[order], root[order], fps[order]
        sets = [np.frombuffer(hashes[k], np.uint64) for k in order.tolist()]
        n = np.array([len(x) for x in sets])
        left, right = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
        other = right if len(right) else left

        def similar(hit: np.ndarray) -> np.ndarray:
            """Of the pairs within the radius, those of different groups that share enough shingles."""
            for at in range(0, len(left), SET_TILE):
                rows = left[at : at + SET_TILE]
                for step in range(0, len(other), SET_TILE):
                    some, part = other[step : step + SET_TILE], hit[at : at + SET_TILE, step : step + SET_TILE]
                    small, large = np.minimum(n[rows, None], n[some]), np.maximum(n[rows, None], n[some])
                    part &= (root[rows, None] != root[some]) & (small >= similarity * large - 1e-9)
                    r, c = np.flatnonzero(part.any(axis=1)), np.flatnonzero(part.any(axis=0))
                    if len(r):
                        both = shared_counts([sets[k] for k in rows[r]], [sets[k] for k in some[c]])
                        part[np.ix_(r, c)] &= both >= similarity * (n[rows[r], None] + n[some[c]] - both) - 1e-6
            return hit

        node, top = forest(fps[left], fps[right] if len(right) else None, radius, similar)
        both = np.concatenate([left, right])
        rows = np.sort(np.column_stack([root[both[node]], root[both[top]]]), axis=1)
        return np.unique(rows[rows[:, 0] != rows[:, 1]], axis=0)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, held = None, []

        def links() -> pa.RecordBatch:
            side, root, fps = (np.array([r[k] for r in held], np.int64) for k in range(3))
            rows = found(side, root, fps.view(np.uint64), [r[3] for r in held])
            return pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(rows[:, k])) for k in (1, 0)], ["a", "b"])

        for batch in batches:
            for key, i, j, *row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if last != (key, i, j):
                    if len(held) > 1:
                        yield links()
                    last, held = (key, i, j), []
                held.append(row)
        if len(held) > 1:
            yield links()

    return run


def _overlapping(similarity: float):
    """Pairs (a, b) whose shingle sets are similar enough, from (a, b, left, right) with sorted hashes as binaries."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for left, right in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
                x, y = np.frombuffer(left, np.uint64), np.frombuffer(right, np.uint64)
                both = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(both >= similarity * (len(x) + len(y) - both) - 1e-9)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], ["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return run


def _shingle_sets(asked: DataFrame, texts: DataFrame) -> DataFrame:
    """(cls, hashes): the shingles of the asked (cls), sorted, as binaries; a written table."""

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([np.unique(shingle_hashes(t)).tobytes() for t in batch.column(1).to_pylist()], pa.binary())], ["cls", "hashes"])

    return written(texts.join(asked, "cls", "left_semi").select("cls", "text").mapInArrow(sets, "cls long, hashes binary"), "shingle-sets")


def _verified(pairs: DataFrame, texts: DataFrame, similarity: float) -> DataFrame:
    """The pairs (a, b) of classes whose shingles are similar enough; pairs is a written table, texts are (cls, text)."""
    hashed = _shingle_sets(pairs.select(F.col("a").alias("cls")).unionByName(pairs.select(F.col("b").alias("cls"))).distinct(), texts)
    side = lambda name, out: hashed.select(F.col("cls").alias(name), F.col("hashes").alias(out))
    left = dealt_join(pairs, side("a", "left"), "a")
    # the second join deals its hot keys by the counts of the pairs, not of the joined rows
    hot = pairs.groupBy("b").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > max(pairs.count() // HOT_KEYS, HOT_ROWS)).select("b")
    few = F.broadcast(written(hot, "hot-keys"))  # at most HOT_KEYS rows
    right = side("b", "right")
    both = left.join(few, "b", "left_semi").join(F.broadcast(right.join(few, "b", "left_semi")), "b").unionByName(left.join(few, "b", "left_anti").join(right, "b"))
    return both.select("a", "b", "left", "right").mapInArrow(_overlapping(similarity), "a long, b long")


def similar_links(distinct: DataFrame, texts: DataFrame, similarity: float = SIMILARITY, tile: int = SET_TILE) -> DataFrame:
    """(a, b): links of classes whose texts have a similarity of ``similarity`` or more, enough to connect all that are so linked.

    distinct: (cls, fp, n, keys). texts: (cls, text) of each class. A first pass compares each class of a bucket with
    its nearest leader; a bucket's leaders differ from band to band, and very large buckets are dealt out in parts
    that share the first leader. What is similar joins groups. A second pass compares all pairs of a bucket that are
    in different groups by then, in pairs of tiles where the bucket is large; a bucket of one group is done. The
    shingles of the classes of such buckets travel to them, and only links of groups, a forest for each bucket and
    pair of tiles, come out, so no pairs are shuffled.
    """
    spark = distinct.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    each = written(distinct.select(F.explode("keys").alias("key"), "cls", "fp", "n"), "bands")
    place = F.xxhash64("key", "cls")
    counts = each.groupBy("key").agg(F.count(F.lit(1)).alias("size"), F.min(F.struct(place.alias("place"), "cls", "fp")).alias("first")).where("size > 1")
    shared = written(dealt_join(each, written(counts, "shared-bands"), "key").select("key", "cls", "fp", "n", "size", "first"), "shared")
    part = F.pmod(F.xxhash64("cls"), F.ceil(F.col("size") / PART_ROWS)).cast("int")
    rows = shared.select("key", part.alias("part"), place.alias("place"), "cls", "fp", F.col("first.cls").alias("first_cls"), F.col("first.fp").alias("first_fp"))
    near = rows.repartition(parts, "key", "part").sortWithinPartitions("key", "part", "place").mapInArrow(_followers(LEAD_RADIUS), "a long, b long")
    first = written(_verified(written(near.distinct(), "led-pairs"), texts, similarity), "first-links")

    groups = written(components(first), "first-groups")
    named = written(dealt_join(shared.drop("first"), groups.withColumnRenamed("node", "cls"), "cls", "left").withColumn("root", F.coalesce("root", "cls")), "named")
    open_ = named.groupBy("key").agg(F.min("root").alias("low"), F.max("root").alias("high")).where("low <> high").select("key")
    left = written(dealt_join(named, written(open_.withColumn("open", F.lit(True)), "open-bands"), "key").drop("open"), "open-rows")
    tiles = F.ceil(F.col("size") / tile).cast("int")
    own = left.withColumn("tiles", tiles).withColumn("own", F.pmod(F.xxhash64("cls", F.lit(3)), F.col("tiles")).cast("int"))
    own = own.join(_shingle_sets(left.select("cls").distinct(), texts), "cls")  # a class has BANDS rows at most
    dealt = own.select("key", "root", "fp", "hashes", "own", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)).alias("other"))
    tiled = dealt.select("key", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), F.when(F.col("own") <= F.col("other"), 0).otherwise(1).alias("side"), "root", "fp", "hashes")
    apart = tiled.repartition(parts, "key", "i", "j").sortWithinPartitions("key", "i", "j").mapInArrow(_apart(SIMILAR_RADIUS, similarity), "a long, b long")
    return first.unionByName(apart)


def prefix(distinct: np.ndarray, common: np.ndarray, counts: np.ndarray, similarity: float) -> np.ndarray:
    """The first shingles of a set, sorted, in one order of all shingles, of which each pair of similar sets shares one.

    Similar sets share ``similarity`` of either at least, so the first that they share is among the first
    n - ceil(similarity n) + 1 of both, whatever the order is. Here those not in ``common`` (sorted, with counts) come
    first, by value, then the others, the rarest first. Sets of less than four have none: no other set is similar.
    """
    n = len(distinct)
    if n - 1 < similarity * n - 1e-6 and n < similarity * (n + 1) - 1e-6:
        return distinct[:0]
    most = n - int(np.ceil(similarity * n - 1e-6)) + 1
    if not len(common):
        return distinct[:most]
    at = np.minimum(np.searchsorted(common, distinct), len(common) - 1)
    known = common[at] == distinct
    first = distinct[~known][:most]
    last = distinct[known]
    return np.concatenate([first, last[np.argsort(counts[at[known]], kind="stable")][: most - len(first)]])


def _possible(similarity: float):
    """Pairs (a, b) of classes of different groups that may be similar, from rows (key, i, j, side, root, cls, size, place, odd) sorted by key, i, j.

    Both bounds are exact: a pair shares no more than one shingle and those behind it where it shares its first, and
    differs in no fewer than the parities do. No fingerprint decides.
    """
    share, differ = similarity / (1 + similarity), (1 - similarity) / (1 + similarity)

    def found(held: list) -> Iterator[pa.RecordBatch]:
        side, root, cls, n, place = (np.array([r[k] for r in held], np.int64) for k in range(5))
        odd = np.frombuffer(b"".join(r[5] for r in held), np.uint64).reshape(len(held), -1)
        left, right = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
        other = right if len(right) else left
        for at in range(0, len(left), SET_TILE):
            rows, out = left[at : at + SET_TILE], []
            for step in range(0, len(other), SET_TILE):
                some = other[step : step + SET_TILE]
                both = n[rows, None] + n[some]
                hit = (root[rows, None] != root[some]) & (np.minimum(n[rows, None], n[some]) >= similarity * np.maximum(n[rows, None], n[some]) - 1e-6)
                hit &= 1 + np.minimum((n - place)[rows, None], (n - place)[some]) >= share * both - 1e-6
                r, c = np.nonzero(hit)
                kept = np.bitwise_count(odd[rows[r]] ^ odd[some[c]]).sum(axis=1) <= differ * both[r, c] + 1e-6
                out.append(np.sort(np.column_stack([cls[rows[r[kept]]], cls[some[c[kept]]]]), axis=1))
            pairs = np.unique(np.concatenate(out), axis=0) if out else np.zeros((0, 2), np.int64)
            if len(pairs):
                yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(pairs[:, k])) for k in (1, 0)], ["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, held = None, []
        for batch in batches:
            for key, i, j, *row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if last != (key, i, j):
                    if len(held) > 1:
                        yield from found(held)
                    last, held = (key, i, j), []
                held.append(row)
        if len(held) > 1:
            yield from found(held)

    return run


def remaining_links(links: DataFrame, odd: DataFrame, rows: DataFrame, texts: DataFrame, similarity: float = SIMILARITY, tile: int = TILE) -> DataFrame:
    """(a, b): all links at ``similarity`` between classes that ``links``, a written table, leaves in different groups.

    odd: (cls, odd) of each class, a written table; rows: (text) of all texts; texts: (cls, text) of each class. Classes
    meet at the shingles of their prefixes (see there), so no pair is left to chance. Shingles that many texts have
    come last in the order, which is all that counting them decides; buckets of one group are done.
    """
    spark = links.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def repeated() -> pa.RecordBatch:
            value, n = np.unique(np.concatenate(held), return_counts=True)
            return pa.RecordBatch.from_arrays([pa.array(value[n > 1].view(np.int64)), pa.array(n[n > 1].astype(np.int64))], ["key", "n"])

        for batch in batches:
            for text in batch.column(0).to_pylist():
                held.append(np.unique(shingle_hashes(text)))
                size += len(held[-1])
                if size >= COUNTED:
                    yield repeated()
                    held, size = [], 0
        if held:
            yield repeated()

    seen = rows.mapInArrow(counted, "key long, n long").groupBy("key").agg(F.sum("n").alias("n")).where(F.col("n") >= COMMON)
    known = sorted((r.key % (1 << 64), r.n) for r in seen.orderBy(F.desc("n"), "key").limit(COMMON_KEYS).collect())
    shared = spark.sparkContext.broadcast((np.array([k for k, _ in known], np.uint64), np.array([n for _, n in known], np.int64)))

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        common, counts = shared.value
        for batch in batches:
            keys, owners, sizes, met = [], [], [], set()
            for text in batch.column(0).to_pylist():
                distinct = np.unique(shingle_hashes(text))
                if (cls := class_of(distinct)) not in met:
                    met.add(cls)
                    keys.append(prefix(distinct, common, counts, similarity))
                    owners.append(cls)
                    sizes.append(len(distinct))
            lengths = [len(k) for k in keys]
            place = np.concatenate([np.arange(1, m + 1) for m in lengths] or [np.zeros(0, np.int64)])
            at = (np.repeat(np.array(sizes, np.int64), lengths) << 32) | place
            key = np.concatenate(keys or [np.zeros(0, np.uint64)]).view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(np.repeat(np.array(owners, np.int64), lengths)), pa.array(at)], ["key", "cls", "at"])

    by = Window.partitionBy("key")
    each = rows.mapInArrow(first, "key long, cls long, at long")
    met = each.select("key", "cls", "at", F.min("cls").over(by).alias("low"), F.max("cls").over(by).alias("high")).where("low <> high").select("key", "cls", "at")
    met = written(met, "met").distinct()
    groups = written(components(links), "band-groups")
    named = written(dealt_join(written(met, "met-once"), groups.withColumnRenamed("node", "cls"), "cls", "left").withColumn("root", F.coalesce("root", "cls")), "met-groups")
    sizes = named.groupBy("key").agg(F.min("root").alias("low"), F.max("root").alias("high"), F.count(F.lit(1)).alias("size")).where("low <> high").select("key", F.ceil(F.col("size") / tile).cast("int").alias("tiles"))
    left = written(dealt_join(named, written(sizes, "open-shingles"), "key"), "open-met")
    own = dealt_join(left, odd, "cls").withColumn("own", F.pmod(F.xxhash64("cls", F.lit(3)), F.col("tiles")).cast("int"))
    dealt = own.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)))
    side = F.when(F.col("own") <= F.col("other"), 0).otherwise(1).alias("side")
    tiled = dealt.select("key", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), side, "root", "cls", F.shiftright("at", 32).alias("size"), F.col("at").bitwiseAND(F.lit((1 << 32) - 1)).alias("place"), "odd")
    pairs = tiled.repartition(parts, "key", "i", "j").sortWithinPartitions("key", "i", "j").mapInArrow(_possible(similarity), "a long, b long").distinct()
    return written(_verified(written(pairs, "possible-pairs"), texts, similarity), "remaining-links")


def representatives(docs: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """One row of each group of similar texts, whole: that with the smallest doc_id, null ids last, and of those with one id that with the least hash of its columns.

    Texts of the same shingles are one class, whatever their number; blank ones are a class of their own. Classes
    are linked at a Jaccard similarity of ``similarity``, and linked ones are a group. Repeated rows leave one; a
    row with a null doc_id stays if its group has no other; an empty table gives no rows; the columns, of any
    name, stay as they are.
    """
    prepare(docs.sparkSession)
    names = docs.columns
    # the hash leaves nulls out, so it is told where they stand
    tie = F.xxhash64(*(F.col(f"`{c}`") for c in names), *(F.col(f"`{c}`").isNull() for c in names))
    text = F.col("text").cast("string").cast("binary")
    tied = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"), tie.alias("tie"))
    prints = written(tied.mapInArrow(_signed, "doc_id long, tie long, cls long, fp long, n long, keys array<long>, odd binary"), "signed")
    order = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "tie")
    distinct = written(prints.groupBy("cls").agg(F.min(order).alias("least"), F.any_value("fp").alias("fp"), F.any_value("n").alias("n"), F.any_value("keys").alias("keys"), F.any_value("odd").alias("odd")), "classes")
    least = distinct.select("cls", F.col("least.doc_id").alias("id"), F.col("least.tie").alias("tie"))
    texts = tied.select("text", F.col("doc_id").alias("_id"), F.col("tie").alias("_tie")).join(least, (F.col("tie") == F.col("_tie")) & F.col("id").eqNullSafe(F.col("_id"))).select("cls", "text")
    banded = written(similar_links(distinct.where(F.size("keys") > 0), texts, similarity), "band-links")
    roots = components(banded.unionByName(remaining_links(banded, distinct.select("cls", "odd"), tied.select("text"), texts, similarity)))
    grouped = distinct.join(roots, distinct.cls == roots.node, "left").select(F.coalesce("root", "cls").alias("root"), "least")
    best = grouped.groupBy("root").agg(F.min("least").alias("best")).select(F.col("best.doc_id").alias("id"), F.col("best.tie").alias("tie"))
    equal = prints.groupBy(F.col("doc_id").alias("id"), "tie").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    b, e = best.alias("b"), equal.alias("e")
    kept = written(b.join(e, (F.col("b.tie") == F.col("e.tie")) & F.col("b.id").eqNullSafe(F.col("e.id")), "left").select("b.id", "b.tie", F.col("n").isNotNull().alias("repeated")), "representatives")
    rows = docs.select(*(F.col(f"`{c}`") for c in names), tie.alias(_TIE))
    found = lambda few: rows.join(few, (F.col(_TIE) == few.tie) & F.col("doc_id").cast("long").eqNullSafe(few.id), "left_semi")
    out = found(kept.where("not repeated"))
    repeated = kept.where("repeated")
    if not repeated.isEmpty():  # rows that are equal in every column: the first of them, which each task limits before the shuffle
        by = Window.partitionBy("doc_id", _TIE).orderBy(_TIE)
        out = out.unionByName(found(repeated).withColumn(_NTH, F.row_number().over(by)).where(F.col(_NTH) == 1).drop(_NTH))
    return out.drop(_TIE)


def op2_simhash(docs: DataFrame) -> DataFrame:
    found = near_duplicates(docs)
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
