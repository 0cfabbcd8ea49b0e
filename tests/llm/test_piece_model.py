import struct
import zlib

import numpy as np
import sentencepiece

from sievewright.llm import piece_model
from sievewright.llm.common import documents
from sievewright.llm.tokens import vocabulary

ODD = ["", " ", "  ", "   x", "a  b   c ", "\n", " \n x", "▁", "a▁ b", "<s> </s> <unk>", "日本\x00\U0001f600", "x" * 5000, "Hello World", "\t\ta", "é", "naïve"]


def test_documents_and_odd_texts(spark):
    docs = documents(spark, "/root/testdata/sf0.01")
    peer = sentencepiece.SentencePieceProcessor(model_file=vocabulary("piece_bpe_32k.model"))
    rows = [(r.doc_id, r.text) for r in docs.collect()] + [(10**6 + k, t) for k, t in enumerate(ODD)] + [(-1, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as ids")
    got = {r.doc_id: r for r in piece_model.op1_sentencepiece(df).collect()}
    for i, text in rows:
        ids = np.array(peer.encode(text or ""), "<u4").tobytes()
        assert (got[i].n_tokens, got[i].ids_crc32) == (len(ids) // 4, zlib.crc32(ids)), repr(text)[:80]
        assert got[i].round_trip and got[i].parity
    back = {r.doc_id: r.text for r in piece_model.decoded(piece_model.encoded(df.limit(50))).collect()}
    assert back == {i: t for i, t in rows if i in back}


def test_the_rebuilt_tokenizer_agrees_by_itself():
    codec = piece_model.Codec(vocabulary("piece_bpe_32k.model"))
    import pyarrow.parquet as pq

    texts = pq.read_table("/root/testdata/sf0.001/documents.parquet").column("text").to_pylist() + ODD
    mine = [e.ids for e in codec.library.encode_batch(texts, add_special_tokens=False)]
    assert mine == codec.peer.encode(texts)
    codec.encode(texts)
    assert codec.differing == 0
    assert [codec.library.decode(x) for x in mine[:100]] == texts[:100]
    assert codec.decode([x for x, _, _ in codec.encode(texts)]) == [t.replace("▁", " ") for t in texts]


def test_ids_are_the_rebuilt_tokenizers():
    """sentencepiece decides nothing: ids of a stub are only reported."""

    class Stub:
        def encode(self, texts, num_threads=1):
            return [[7] for _ in texts]

    codec = piece_model.Codec(vocabulary("piece_bpe_32k.model"))
    right = codec.encode(["Hello World", "a"])
    assert all(same and back for _, same, back in right)
    codec = piece_model.Codec(vocabulary("piece_bpe_32k.model"))
    codec.peer = Stub()
    found = codec.encode(["Hello World", "a", ""])
    assert [x for x, _, _ in found] == [right[0][0], right[1][0], b""] and [same for _, same, _ in found] == [False, False, True]
    assert codec.differing == 3


def test_odd_tables(spark):
    rows = [(1, "a b"), (1, "a b"), (None, "a b"), (2, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as ids", "2 as parity", "3 as n_tokens")
    got = [(r.doc_id, r.n_tokens, r.round_trip, r.parity) for r in piece_model.op1_sentencepiece(df).collect()]
    n = got[0][1]
    assert sorted(got, key=str) == sorted([(1, n, True, True), (1, n, True, True), (None, n, True, True), (2, 0, True, True)], key=str)
    assert piece_model.op1_sentencepiece(df.where("false")).collect() == []


def proto(pieces, kind):
    def field(number, value):
        if isinstance(value, int):
            out, v = bytearray(), value
            tag = number << 3
            for x in (tag, v):
                while x > 127:
                    out.append(x & 127 | 128)
                    x >>= 7
                out.append(x)
            return bytes(out)
        if isinstance(value, float):
            return bytes([number << 3 | 5]) + struct.pack("<f", value)
        tag, n = number << 3 | 2, len(value)
        out = bytearray()
        for x in (tag, n):
            while x > 127:
                out.append(x & 127 | 128)
                x >>= 7
            out.append(x)
        return bytes(out) + value

    body = b"".join(field(1, field(1, p.encode()) + field(2, float(s)) + field(3, t)) for p, s, t in pieces)
    trainer = field(3, kind) + field(35, 1)
    normalizer = field(1, b"identity") + field(3, 1) + field(4, 0) + field(5, 1)
    return body + field(2, trainer) + field(3, normalizer)


def test_unigram_model():
    pieces = [("<unk>", 0, 2), ("<s>", 0, 3), ("</s>", 0, 3)] + [(f"<0x{b:02X}>", -20, 6) for b in range(256)]
    pieces += [(p, -2 - 0.37 * k, 1) for k, p in enumerate(["▁", "a", "b", "c", "ab", "bc", "abc", "▁a", "▁ab", "▁▁", "ca"])]
    raw = proto(pieces, 1)
    peer = sentencepiece.SentencePieceProcessor(model_proto=raw)
    tokenizer = piece_model.Model(raw).tokenizer()
    for text in ["abcab cab", "a  bca", "aab日c", "", "cabcab", "zz a"]:
        assert tokenizer.encode(text, add_special_tokens=False).ids == peer.encode(text), text
