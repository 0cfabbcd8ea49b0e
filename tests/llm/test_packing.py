import random
import zlib

import numpy as np

from sievewright.llm import packing, tokens
from sievewright.llm.common import documents


def library():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(tokens.vocabulary("byte_bpe_50k.json"))
    return t


def holds(rows, texts, capacity=1024):
    """All that the contract asks of the rows, save that the sequences are few."""
    coder = library()
    by_doc, by_seq = {}, {}
    for r in rows:
        by_doc.setdefault(r.doc_id, []).append(r)
        by_seq.setdefault(r.sequence_id, []).append((r.offset, r.length))
    assert set(by_doc) == set(texts)
    for i, own in by_doc.items():
        ids = np.array([*coder.encode(texts[i] or "", add_special_tokens=False).ids, 2], "<u4")
        own.sort(key=lambda r: r.piece)
        at = 0
        for k, r in enumerate(own):
            assert (r.piece, r.start) == (k, at)
            assert r.ids_crc32 == zlib.crc32(ids[at : at + r.length].tobytes())
            assert r.length == capacity or k == 0
            at += r.length
        assert at == len(ids)
    for spans in by_seq.values():
        at = 0
        for offset, length in sorted(spans):
            assert offset == at
            at += length
        assert at <= capacity
    return len(by_seq)


def test_documents(spark):
    docs = documents(spark, "/root/testdata/sf0.01")
    texts = {r.doc_id: r.text for r in docs.collect()}
    rows = packing.op5_packing(docs).collect()
    bins = holds(rows, texts)
    counts = {}
    for r in rows:
        counts[r.length] = counts.get(r.length, 0) + 1
    assert bins <= packing.least_bins(counts, 1024) + 2


def fewest(items, capacity):
    """The fewest bins, by trying all assignments of sorted items."""
    best = len(items)

    def put(k, rooms):
        nonlocal best
        if len(rooms) >= best:
            return
        if k == len(items):
            best = len(rooms)
            return
        for j in {r: j for j, r in enumerate(rooms)}.values():
            if rooms[j] >= items[k]:
                put(k + 1, [*rooms[:j], rooms[j] - items[k], *rooms[j + 1 :]])
        put(k + 1, [*rooms, capacity - items[k]])

    put(0, [])
    return best


def test_plan_is_optimal_on_small_cases():
    rng = random.Random(3)
    for _ in range(150):
        capacity = rng.choice([10, 20, 50])
        items = sorted((rng.randrange(1, capacity + 1) for _ in range(rng.randrange(0, 10))), reverse=True)
        counts = {x: items.count(x) for x in items}
        plan = packing.plan(counts, capacity)
        assert all(sum(p) <= capacity for p, _ in plan)
        back = {}
        for p, n in plan:
            for x in p:
                back[x] = back.get(x, 0) + n
        assert back == counts
        assert sum(n for _, n in plan) == fewest(items, capacity)
        assert packing.least_bins(counts, capacity) <= fewest(items, capacity)


def test_plan_of_extreme_counts():
    for counts in ({1: 10**7, 1023: 5}, {600: 10**6, 500: 10**6}, {x: 1000 for x in range(1, 1025)}, {2: 3}, {}, {341: 9, 342: 9}):
        plan = packing.plan(counts)
        assert len(packing.places(plan)) < 20_000
        back = {}
        for p, n in plan:
            for x in set(p):
                back[x] = back.get(x, 0) + n * p.count(x)
        assert back == counts
        assert sum(n for _, n in plan) <= packing.least_bins(counts, 1024) * 1.01 + 1


def test_odd_rows(spark):
    rows = [(1, None), (2, ""), (3, "a " * 5000), (4, "same"), (5, "same"), (6, "x" * 30000), (7, " \n \n  q")]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as length", "2 as salt", "3 as l")
    assert holds(packing.op5_packing(df).collect(), dict(rows)) >= 5
    assert packing.op5_packing(df.where("false")).collect() == []


def optimum(items, capacity):
    """The fewest bins, over all subsets: the least (bins, content of the last one) for each."""
    best = [(1, 0)] + [(99, 0)] * ((1 << len(items)) - 1)
    for m in range(len(best)):
        bins, content = best[m]
        for k, x in enumerate(items):
            if not m >> k & 1:
                got = (bins, content + x) if content + x <= capacity else (bins + 1, x)
                best[m | 1 << k] = min(best[m | 1 << k], got)
    return best[-1][0]


def test_lists_of_up_to_fourteen_are_solved_exactly():
    rng = random.Random(11)
    lists = [(60, [32, 27, 26, 26, 24, 21, 20, 17, 17, 14, 11])]
    for size, number in ((8, 300), (10, 80), (12, 12), (14, 2)):
        for _ in range(number):
            capacity = rng.choice([12, 60, 100, 1024])
            lists.append((capacity, [rng.randint(max(1, capacity // 12), capacity * 3 // 5) for _ in range(size)]))
    for capacity, items in lists:
        counts = {x: items.count(x) for x in items}
        patterns = packing.plan(counts, capacity)
        assert all(sum(p) <= capacity for p, _ in patterns)
        assert {x: sum(p.count(x) * n for p, n in patterns) for x in counts} == counts
        assert sum(n for _, n in patterns) == optimum(items, capacity), (capacity, items)


def test_fillings_are_all_undominated_ones():
    counts = {9: 1, 6: 2, 5: 1, 4: 1, 3: 2, 2: 1}
    got = packing.fillings(sorted(counts, reverse=True), counts, 12)
    assert got == [(9, 3), (6, 6)]  # 9 stands for 5 and 4, 6 for 4 and 2 or 3 and 3, 3 for 2
    assert packing.fillings([5, 4, 3], {5: 1, 4: 1, 3: 2}, 8) == [(5, 3)]
    assert packing.fillings([7, 5, 4], {7: 1, 5: 1, 4: 1}, 8) == [(7,)]
    assert packing.fillings([6, 5, 3], {6: 1, 5: 1, 3: 1}, 9) == [(6, 3)] and packing.fillings([5, 4, 2], {5: 1, 4: 1, 2: 3}, 6) == [(4, 2), (5,)]
    assert packing.fillings([7, 5], {7: 1, 5: 1}, 3) == [()]


def test_special_strings_nulls_and_repeated_rows(spark):
    """As the plain library has it: the string of an added token is that token."""
    rows = [(1, "a<|endoftext|> b\n <|endoftext|>"), (1, "a"), (1, "a"), (None, "a"), (None, None), (2, "x  y   z\x00 w")]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as length", "2 as salt", "3 as `rank`")
    got = packing.op5_packing(df).collect()
    coder = library()
    want = []
    for i, text in rows:
        ids = np.array([*coder.encode(text or "", add_special_tokens=False).ids, 2], "<u4")
        want.append((i, len(ids), zlib.crc32(ids.tobytes())))
    assert sorted(((r.doc_id, r.length, r.ids_crc32) for r in got), key=str) == sorted(want, key=str)
    assert len({(r.sequence_id, r.offset) for r in got}) == len(rows)
    plain = tokens.ByteBpe(tokens.vocabulary("byte_bpe_50k.json"), plain=True)
    assert len(plain.encode("<|endoftext|>")) == 4 * 7 and len(tokens.load(tokens.vocabulary("byte_bpe_50k.json")).encode("<|endoftext|>")) == 4


def test_an_empty_table(spark):
    assert packing.op5_packing(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_pipeline_keeps_few_words(spark, monkeypatch):
    import corpus_pipeline

    asked = []
    packed = packing.packed
    monkeypatch.setattr(packing, "packed", lambda docs, **more: asked.append(more) or packed(docs, **more))
    docs = documents(spark, "/root/testdata/sf0.001")
    rows = corpus_pipeline.pack(spark, docs, "/root/testdata/sf0.001")
    holds(rows.collect(), {r.doc_id: r.text for r in docs.collect()})
    assert asked == [{"cache_rows": tokens.SMALL_CACHE_ROWS}]


def test_small_cache():
    """However many words there are, no more are kept than asked for, and the ids are those of the library."""
    coder, whole = tokens.load(tokens.vocabulary("byte_bpe_50k.json"), rows=400), library()
    rng = random.Random(2)
    for _ in range(40):
        text = " ".join(f"{rng.randrange(10**6)}-x {''.join(rng.choices('abcdefg', k=6))}" for _ in range(200))
        assert coder.encode(text) == np.array(whole.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
        assert len(coder.words) <= 200 and len(coder.parts) <= 25
    assert coder is not tokens.load(tokens.vocabulary("byte_bpe_50k.json"))
