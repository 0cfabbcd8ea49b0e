import random

import numpy as np
import pytest

from sievewright.llm import simhash
from sievewright.llm.common import documents


def brute(prints: dict[int, int], radius: int = 4) -> dict[int, int]:
    """Least doc_id reachable, by comparing all pairs."""
    ids = sorted(prints)
    fps = np.array([prints[i] for i in ids], np.uint64)
    comp = {i: i for i in ids}

    def root(i):
        while comp[i] != i:
            i = comp[i]
        return i

    for k in range(len(ids)):
        for m in np.flatnonzero(np.bitwise_count(fps[k + 1 :] ^ fps[k]) <= radius) + k + 1:
            a, b = sorted((root(ids[k]), root(ids[m])))
            comp[b] = a
    return {i: root(i) for i in ids}


def similar(texts: dict[int, str | None], least: float = 0.8) -> dict[int, int]:
    """Least doc_id reachable over pairs of texts whose five-word shingles have this Jaccard similarity, by plain sets."""
    import re

    sets = {}
    for i, text in texts.items():
        words = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
        sets[i] = frozenset(tuple(words[k : k + 5]) for k in range(len(words) - 4)) or frozenset([tuple(words)] if words else [])
    comp = {i: i for i in sets}

    def root(i):
        while comp[i] != i:
            i = comp[i]
        return i

    holders = {}  # texts that share no shingle have none in common
    for i in sorted(sets):
        near = {j for g in sets[i] for j in holders.get(g, ())} if sets[i] else {j for j in holders.get(None, ())}
        for j in near:
            both = len(sets[i] & sets[j])
            if not sets[i] or both >= least * (len(sets[i]) + len(sets[j]) - both):
                a, b = sorted((root(i), root(j)))
                comp[b] = a
        for g in sets[i] or [None]:
            holders.setdefault(g, []).append(i)
    return {i: root(i) for i in sets}


def plain_fingerprint(text: str | None) -> int:
    import re

    import xxhash

    text = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    grams = [" ".join(words[i : i + 4]) for i in range(len(words) - 3)] or ([" ".join(words)] if words else [])
    h = [xxhash.xxh64_intdigest(g.encode(), seed=42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h)) if h else 0


def test_documents_against_brute_force(spark):
    docs = documents(spark, "/root/testdata/sf0.01")
    rows = simhash.op2_simhash(docs).collect()
    texts = {r.doc_id: r.text for r in docs.collect()}
    prints = {r.doc_id: int(r.fingerprint, 16) for r in rows}
    assert len(rows) == len(texts) == len(prints)
    for i in list(texts)[:60]:
        assert prints[i] == plain_fingerprint(texts[i])
    assert {r.doc_id: r.component_id for r in rows} == brute(prints)
    assert len(set(brute(prints).values())) < len(rows)


@pytest.mark.parametrize("tile", [4, 2048])
def test_links_of_clusters_and_hot_buckets(spark, tile):
    rng = random.Random(7)
    prints = {}
    for c in range(30):
        centre = rng.getrandbits(64)
        for _ in range(rng.choice([1, 2, 40])):
            fp = centre
            for b in rng.sample(range(64), rng.randrange(4)):
                fp ^= 1 << b
            prints[len(prints)] = fp
    signed = [(fp - (1 << 64) if fp >> 63 else fp,) for fp in set(prints.values())]
    edges = simhash.links(spark.createDataFrame(signed, "fp long"), tile=tile).collect()
    pairs = [(e.a % (1 << 64), e.b % (1 << 64)) for e in edges]
    comp = {fp: fp for fp in prints.values()}

    def root(x):
        while comp[x] != x:
            x = comp[x]
        return x

    for a, b in pairs:
        assert a == b or root(a) is not None
        comp[root(a)] = root(b)
    groups = {}
    for i, c in brute(prints).items():
        groups.setdefault(c, set()).add(prints[i])
    mine = {}
    for fp in comp:
        mine.setdefault(root(fp), set()).add(fp)
    assert sorted(map(sorted, mine.values())) == sorted(map(sorted, groups.values()))


def test_odd_rows(spark):
    rows = [(1, None), (2, ""), (3, " \n"), (4, "one two"), (5, "ONE two"), (6, "x " * 50000), (6, "x " * 50000)]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as fp", "2 as component_id", "'k' as key")
    found = sorted(map(tuple, simhash.op2_simhash(df).collect()))
    assert [r[0] for r in found] == [1, 2, 3, 4, 5, 6, 6]
    assert [r[2] for r in found] == [1, 1, 1, 4, 4, 6, 6]
    assert found[0][1] == "0" * 16
    assert simhash.op2_simhash(df.where("false")).collect() == []


@pytest.mark.parametrize("tile", [512, 4])
def test_similar_texts(spark, monkeypatch, tile):
    """Groups at 0.8 are those of brute force, with reworded copies on both sides of it, in whole buckets and in tiles."""
    monkeypatch.setattr(simhash, "PART_ROWS", 5 if tile == 4 else 100_000)
    real = simhash.similar_links
    monkeypatch.setattr(simhash, "similar_links", lambda d, t, s: real(d, t, s, tile))
    rng = random.Random(3)
    texts = {0: None, 1: "", 2: " \n ", 3: "one two", 4: "One  two", 5: "one two three"}
    for c in range(25):
        words = [f"w{rng.randrange(10**6)}" for _ in range(rng.choice([30, 120, 400]))]
        for _ in range(rng.choice([1, 2, 12])):
            own = list(words)
            for at in rng.sample(range(len(own)), rng.randrange(max(1, len(own) // 30))):
                own[at] = f"x{rng.randrange(10**6)}"
            texts[len(texts)] = " ".join(own)
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(5)
    want, got = similar(texts), {r.doc_id for r in simhash.representatives(df).collect()}
    assert 30 < len(set(want.values())) < len(texts)
    assert got == set(want.values())


def test_a_large_bucket_of_many_groups(spark):
    """500 different texts around one: links by way of others are found though no leader has both ends."""
    rng = random.Random(11)
    centre = [f"w{i}" for i in range(150)]
    texts = {}
    for i in range(500):
        own = list(centre)
        for at in rng.sample(range(len(own)), rng.randrange(1, 9)):
            own[at] = f"x{rng.randrange(10**6)}"
        texts[i] = " ".join(own)
    want = set(similar(texts).values())
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(5)
    got = {r.doc_id for r in simhash.representatives(df).collect()}
    assert 5 < len(want) < 400 and got == want


def test_repeated_shingles(spark):
    """A text that repeats its passage many times has nearly the same set of shingles as one that has it once."""
    passage, tail = " ".join(f"p{i}" for i in range(60)), " ".join(f"t{i}" for i in range(7))
    texts = {1: f"{passage} {tail}", 2: f"{passage} " * 60 + tail, 3: f"other {tail} words"}
    want = set(similar(texts).values())
    got = {r.doc_id for r in simhash.representatives(spark.createDataFrame(list(texts.items()), "doc_id long, text string")).collect()}
    assert want == {1, 3} and got == want


def test_short_texts_near_the_limit(spark):
    """Pairs of sets of 4 and 5 shingles at exactly 0.8, whose fingerprints differ by many bits."""
    texts = {}
    for i in range(400):
        words = [f"a{i}x{k}" for k in range(9)]
        texts[2 * i], texts[2 * i + 1] = " ".join(words), " ".join(words[:-1])
    want = set(similar(texts).values())
    got = {r.doc_id for r in simhash.representatives(spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(4)).collect()}
    assert len(want) == 400 and len(got) - len(want) <= 1 and want <= got  # a pair shares no band with a probability of 3e-5


def test_band_keys_of_similar_sets():
    """The share of pairs at 0.8 without a common key is as small as the bands promise."""
    rng = np.random.default_rng(5)
    missed = 0
    for _ in range(300):
        both, rest = rng.integers(0, 1 << 63, 160, np.uint64), rng.integers(0, 1 << 63, 40, np.uint64)
        a, b = np.concatenate([both, rest[:20]]), np.concatenate([both, rest[20:]])
        missed += not (simhash.band_keys(a) == simhash.band_keys(b)).any()
    assert missed <= 1


def test_shared_counts(monkeypatch):
    monkeypatch.setattr(simhash, "COLUMNS", 7)
    rng = np.random.default_rng(1)
    left, right = ([np.unique(rng.integers(0, 60, rng.integers(0, 40), np.uint64)) for _ in range(n)] for n in (9, 12))
    want = [[len(set(a.tolist()) & set(b.tolist())) for b in right] for a in left]
    assert simhash.shared_counts(left, right).tolist() == want
    assert simhash.shared_counts([], right).shape == (0, 12) and simhash.shared_counts([left[0][:0]], right).sum() == 0


def test_near_is_brute_force_with_tiles_skipped(monkeypatch):
    rng = np.random.default_rng(4)
    some = lambda n: np.array(sorted((int(x) for x in rng.integers(0, 1 << 63, n, np.uint64) & rng.integers(0, 1 << 63, n, np.uint64)), key=int.bit_count), np.uint64)
    left, right = np.concatenate([some(90), np.full(30, 2**64 - 1, np.uint64)]), some(70)
    for radius in (4, 20, 32):
        want = np.bitwise_count(left[:, None] ^ right) <= radius
        assert (simhash.near(left, right, radius, 16) == want).all()
    seen, real = [], np.bitwise_count
    monkeypatch.setattr(simhash.np, "bitwise_count", lambda x: seen.append(x.ndim) or real(x))
    assert not simhash.near(right[:16], left[-16:], 20, 16).any() and seen == [1, 1]  # counts alone, no pair


def test_stages_of_near_copies_use_the_tiles(monkeypatch):
    """Both passes of the pipeline's stage compare by near, the second by the forest of op2, whose check keeps what is similar."""
    import pyarrow as pa

    rng = np.random.default_rng(9)
    calls, real, forest = [], simhash.near, simhash.forest
    monkeypatch.setattr(simhash, "near", lambda *a: calls.append("near") or real(*a))
    monkeypatch.setattr(simhash, "forest", lambda *a: calls.append("forest") or forest(*a))
    base = np.sort(rng.integers(0, 1 << 63, 100, np.uint64))
    sets = [base, base[:90], base[:85], np.sort(rng.integers(0, 1 << 63, 100, np.uint64)), base[:70]]
    prints = [1, 3, 7, 15, 2**40 - 1]
    rows = [[5] * 5, [0] * 5, [0] * 5, [0] * 5, [10, 11, 12, 13, 14], prints, [x.tobytes() for x in sets]]
    kinds = [pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.binary()]
    batch = pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(rows, kinds, strict=True)], [*"abcdefg"])
    out = [p for b in simhash._apart(8, 0.8)([batch]) for p in zip(*(c.to_pylist() for c in b.columns), strict=True)]
    assert sorted(out) == [(11, 10), (12, 10)] and calls == ["forest", "near"]
    fp = np.concatenate([rng.integers(0, 1 << 63, 700, np.uint64), np.full(700, 2**64 - 1, np.uint64)])
    n, cls = len(fp), np.arange(len(fp)) + 1
    cols = [np.full(n, 3), np.zeros(n, int), np.arange(n), cls, fp.view(np.int64), np.full(n, 1), np.full(n, fp[0]).view(np.int64)]
    batches = [pa.RecordBatch.from_arrays([pa.array(c[lo : lo + 450]) for c in cols], [*"abcdefg"]) for lo in range(0, n, 450)]
    pairs = [p for b in simhash._followers(20)(batches) for p in zip(*(c.to_pylist() for c in b.columns), strict=True)]
    far = {int(c): int(f) for c, f in zip(cls, fp, strict=True)}
    assert all((far[a] ^ far[b]).bit_count() <= 20 for a, b in pairs)
    led = {x for p in pairs for x in p}
    leaders = [c for c in cls.tolist() if c not in {max(p) for p in pairs}]
    assert len(pairs) == n - len(leaders) and len(led & set(cls[700:].tolist())) == 700
    assert all((far[a] ^ far[b]).bit_count() > 20 for i, a in enumerate(leaders) for b in leaders[:i])


@pytest.mark.parametrize("tile", [2048, 3])
def test_no_link_is_left_to_the_bands(spark, monkeypatch, tile):
    """Where bands and fingerprints find nothing, the shingles that a pair must share still lead to every link."""
    none = spark.createDataFrame([], "a long, b long")
    monkeypatch.setattr(simhash, "similar_links", lambda d, t, s: none)
    real = simhash.remaining_links
    monkeypatch.setattr(simhash, "remaining_links", lambda *a: real(*a, tile))
    monkeypatch.setattr(simhash, "COMMON", 5)
    rng = random.Random(13)
    line = [f"c{k}" for k in range(12)]
    texts = {0: None, 1: "", 2: "one two", 3: "one  TWO", 4: "one two three four five six seven", 5: "one two three four five six seven eight"}
    for c in range(20):
        words = line + [f"w{rng.randrange(10**6)}" for _ in range(rng.choice([8, 30, 120, 400]))]
        for _ in range(rng.choice([1, 2, 8])):
            own = list(words)
            for at in rng.sample(range(len(own)), rng.randrange(max(1, len(own) // 25))):
                own[at] = f"x{rng.randrange(10**6)}"
            texts[len(texts)] = " ".join(own)
    for k in range(8, 16):
        texts[len(texts)] = " ".join(f"s{i}" for i in range(k))  # sets of 4 to 11, each a part of the next
    want = set(similar(texts).values())
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(4)
    assert 20 < len(want) < len(texts) - 10 and {r.doc_id for r in simhash.representatives(df).collect()} == want
