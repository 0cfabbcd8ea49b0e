import hashlib
import itertools
import zlib

from pyspark.sql import functions as F

from sievewright.llm import common, media
from sievewright.llm.common import documents


def feature(payload):
    """The feature by plain counting."""
    tally = [0] * 16
    for x in payload:
        tally[x // 16] += 1
    steps = sum(x != y for x, y in itertools.pairwise(payload))
    return f"w64 h{len(payload) // 64} sum{sum(payload)} max{max(payload)} steps{steps} h16:" + ",".join(map(str, tally))


def test_documents_round_trip(spark):
    docs = documents(spark, "/root/testdata/sf0.001")
    rows = [(r.doc_id, r.text) for r in docs.collect()] + [(-1, None), (-2, ""), (-3, "x" * 64), (-4, "é" * 100_000), (-5, "x" * 64), (-6, "a\x00"), (-7, "a"), (-8, "a <b> &amp;\n\nnext\n\nlast"), (-9, "\n\nlate")]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as digest", "2 as id", "3 as caption")
    got = {r.doc_id: r for r in media.op8_media(df).collect()}
    assert len(got) == len(rows)
    for i, text in rows:
        raw = (text or "").encode()
        payload = raw + bytes(-len(raw) % 64 or (64 if not raw else 0))
        r = got[i]
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]))
        assert r.media_bytes > r.payload_bytes and r.media_sha256 == hashlib.sha256(media.greymap(raw)).hexdigest()
        assert r.feature == feature(payload)
        texts = [x for x in (text or "").split("\n\n") if x.strip()]
        first = bool((text or "").split("\n\n")[0].strip())
        assert (r.position, r.n_items, r.n_texts) == (int(first), len(texts) + 1, len(texts))
        assert r.caption == " ".join(" ".join((text or "")[:400].split())[:80].split())
    assert got[-8].caption == "a <b> &amp; next last" and got[-8].n_items == 4
    assert got[-3].feature == got[-5].feature and got[-6].media_sha256 != got[-7].media_sha256
    assert media.op8_media(df.where("false")).collect() == []
    again = spark.createDataFrame([(1, "q"), (1, "q"), (None, "q"), (None, None)], "doc_id long, text string")
    assert sorted((r.doc_id or 0, r.n_bytes) for r in media.op8_media(again).collect()) == [(0, 0), (0, 1), (1, 1), (1, 1)]


def test_payloads_of_a_page_with_several_media(spark, monkeypatch):
    """Text and media in order, each reference with the bytes of its digest, a shared one by the broadcast path."""
    monkeypatch.setattr(common, "HOT_ROWS", 5)
    monkeypatch.setattr(common, "HOT_KEYS", 3)
    raws = [b"first", b"second", "third é".encode()]
    tags = [f"<img src='sha256:{media.digest_of(x)}' alt='c{k}'>" for k, x in enumerate(raws)]
    html = f"<p>a</p>{tags[0]}<p>b</p>{tags[1]}{tags[2]}<p>c</p>{tags[0]}"
    pages = spark.createDataFrame([(k, html if k == 0 else tags[0]) for k in range(20)], "k long, h string")
    items = media.sequences(pages, "k", "h").select("id", F.explode("items").alias("i")).select("id", "i.*")
    whole = items.where("id = 0").orderBy("position").collect()
    assert [(r.kind, r.text if r.kind == "text" else r.caption) for r in whole] == [("text", "a"), ("media", "c0"), ("text", "b"), ("media", "c1"), ("media", "c2"), ("text", "c"), ("media", "c0")]
    refs = common.written(items.where("kind = 'media'").select("id", "position", "digest", "caption"), "refs")
    table = media.store(spark.createDataFrame([(k, x) for k, x in enumerate(raws)], "doc_id long, text binary"))
    got = media.payloads(refs, table).where("id = 0").orderBy("position").collect()
    assert [(r.position, r.caption, media.samples(bytes(r.stored))[1][: media.samples(bytes(r.stored))[0]]) for r in got] == [(1, "c0", raws[0]), (3, "c1", raws[1]), (4, "c2", raws[2]), (6, "c0", raws[0])]
    assert media.payloads(refs, table).where("stored is null").count() == 0 and media.payloads(refs, table).count() == 23


def test_sequences_keep_order_and_captions(spark):
    html = "<main><p>one <b>two</b></p><figure><img src='sha256:ab' alt='alt'><figcaption>cap &amp; <i>more</i></figcaption></figure>three<script>no</script><img src=u alt=other></main>"
    items = media.sequences(spark.createDataFrame([(1, html), (2, None)], "k long, h string"), "k", "h").orderBy("id").collect()
    assert [tuple(x) for x in items[0]["items"]] == [
        (0, "text", "one two", None, None), (1, "media", "sha256:ab", "ab", "cap & more"), (2, "text", "three", None, None), (3, "media", "u", None, "other"),
    ]
    assert items[1]["items"] == []
    pages = spark.read.parquet("/root/testdata/sf0.001/pages.parquet")
    assert media.sequences(pages, "page_id", "html").where("size(items) > 0").count() > 0


def test_unresolved_reference_stays(spark):
    refs = spark.createDataFrame([(1, 0, "zz", None)], "id long, position int, digest string, caption string")
    table = media.described(media.store(spark.createDataFrame([(1, b"q")], "doc_id long, text binary")))
    assert media.resolved(refs, table).first().n_bytes is None and media.payloads(refs, table.withColumn("stored", F.lit(b""))).first().stored is None
