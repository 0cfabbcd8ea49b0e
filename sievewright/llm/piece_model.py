"""SentencePiece models on the tokenizers library.

The model file is a protocol buffer; its pieces, scores and settings are read from the
wire format here, and an equal tokenizer is built: the normaliser, the marker for
spaces, unigram scores or BPE merges (by the pieces' scores), and byte fallback. A
piece never joins the end of a word to the marker of the next (this is checked on the
pieces), so texts are cut into marker runs with their word, the new ones of a batch are
strung together and encoded in one call by the library's threads, and their ids kept: a
piece that opens with the marker tells where a run begins. All ids are those of the
rebuilt tokenizer, and its decoder gives the text of each new run back. To verify the
parity, each new run is also encoded by the sentencepiece library; its ids decide
nothing, but a text with a run that differs is reported (``parity`` false).

Null and empty texts have no ids and parity; a literal marker is a space, as it is to
the model; a very long text is one row, and of a very long run (no space for more than
KEPT_CHARS) nothing is kept. Repeated rows are encoded each, an empty table gives no
rows, and only doc_id and text are read, so other columns may have any name.
"""

from __future__ import annotations

import re
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import id_and_text, prepare
from .tokens import vocabulary as path_of

MARK = "▁"
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
UNIGRAM, BPE = 1, 2
#: Runs whose ids a worker keeps (in two halves, the older one is dropped), and the longest one kept.
CACHE_ROWS = 800_000
KEPT_CHARS = 64
#: Characters of runs that are strung together.
STRUNG_CHARS = 1 << 14


def fields(raw: bytes) -> Iterator[tuple[int, int | bytes]]:
    """(field number, value) of a protocol buffer message."""
    at = 0

    def varint() -> int:
        nonlocal at
        value = shift = 0
        while True:
            byte = raw[at]
            at += 1
            value |= (byte & 127) << shift
            shift += 7
            if byte < 128:
                return value

    while at < len(raw):
        tag = varint()
        kind = tag & 7
        if kind == 0:
            yield tag >> 3, varint()
            continue
        n = {1: 8, 5: 4}.get(kind) or varint()
        yield tag >> 3, raw[at : at + n]
        at += n


class Model:
    """What a model file says."""

    def __init__(self, raw: bytes):
        self.pieces: list[tuple[str, float, int]] = []
        self.kind, self.unk_id, self.byte_fallback = UNIGRAM, 0, False
        self.charsmap, self.dummy_prefix, self.trim, self.escape = b"", True, True, True
        for number, value in fields(raw):
            if number == 1:
                own = dict(fields(value))
                self.pieces.append((own.get(1, b"").decode(), struct.unpack("<f", own.get(2, bytes(4)))[0], own.get(3, NORMAL)))
            elif number == 2:
                own = dict(fields(value))
                self.kind, self.unk_id, self.byte_fallback = own.get(3, UNIGRAM), own.get(40, 0), bool(own.get(35, 0))
            elif number == 3:
                own = dict(fields(value))
                self.charsmap, self.dummy_prefix, self.trim, self.escape = own.get(2, b""), bool(own.get(3, 1)), bool(own.get(4, 1)), bool(own.get(5, 1))

    def tokenizer(self):
        """The same model for the tokenizers library."""
        from tokenizers import Regex, Tokenizer, decoders, models, normalizers, pre_tokenizers

        ids = {p: k for k, (p, _, _) in enumerate(self.pieces)}
        unk = self.pieces[self.unk_id][0]
        if self.kind == UNIGRAM:
            model = models.Unigram([(p, s if kind != CONTROL else -1e9) for p, s, kind in self.pieces], unk_id=self.unk_id, byte_fallback=self.byte_fallback)
        elif self.kind == BPE:
            plain = {p for p, _, kind in self.pieces if kind in (NORMAL, USER)}
            merges = []
            for p in plain:
                rank = -self.pieces[ids[p]][1]
                merges += [(rank, ids[p[:k]], ids[p[k:]], p[:k], p[k:]) for k in range(1, len(p)) if p[:k] in plain and p[k:] in plain]
            merges.sort()
            model = models.BPE(vocab=ids, merges=[m[3:] for m in merges], unk_token=unk, fuse_unk=True, byte_fallback=self.byte_fallback)
        else:
            raise ValueError("only unigram and BPE models can be rebuilt")
        out = Tokenizer(model)
        steps = [normalizers.Precompiled(self.charsmap)] if self.charsmap else []
        if self.trim:
            steps += [normalizers.Replace(Regex(" {2,}"), " "), normalizers.Replace(Regex("^ | $"), "")]
        if self.dummy_prefix:
            steps.append(normalizers.Prepend(MARK))
        if self.escape:
            steps.append(normalizers.Replace(" ", MARK))
        out.normalizer = normalizers.Sequence(steps)
        out.pre_tokenizer = pre_tokenizers.Split(Regex(f"{MARK}*[^{MARK}]+|{MARK}+"), "isolated") if self.parted() else None
        out.decoder = decoders.Sequence([decoders.Replace(MARK, " "), decoders.ByteFallback(), decoders.Fuse(), *[decoders.Strip(" ", 1, 0)] * self.dummy_prefix])
        return out

    def parted(self) -> bool:
        """No piece has a marker after another character, so marker runs can be encoded apart."""
        return not any(MARK in p.lstrip(MARK) for p, _, kind in self.pieces if kind in (NORMAL, USER))


class Codec:
    """Encodes batches of texts to little-endian unsigned 32-bit ids, and decodes them."""

    _runs = re.compile(" +[^ ]*|[^ ]+")

    def __init__(self, path: str):
        import sentencepiece

        with open(path, "rb") as f:
            raw = f.read()
        self.model = Model(raw)
        self.library = self.model.tokenizer()
        self.peer = sentencepiece.SentencePieceProcessor(model_proto=raw)
        self.simple = self.model.parted() and self.model.escape and self.model.dummy_prefix and not self.model.trim and not self.model.charsmap
        pieces = self.model.pieces
        self.opens = np.array([p.startswith(MARK) and kind not in (CONTROL, UNKNOWN) for p, _, kind in pieces])
        self.silent = np.array([kind in (CONTROL, UNKNOWN) for _, _, kind in pieces])
        self.kept: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}
        self.spelt: dict[bytes, str] = {}
        self.odd: set[str] = set()  # runs whose ids sentencepiece has otherwise
        self.lost: set[str] = set()  # runs that the decoder does not give back
        self.differing = 0

    def _each(self, runs: list[str]) -> dict[str, bytes]:
        """Ids of runs, each encoded, decoded and compared on its own; the prefix stands for a run's own first space."""
        found = self._new([r[1:] for r in runs])
        out = dict(zip(runs, [ids for ids, _ in found], strict=True))
        if " " in out:  # it has no rest to encode
            out[" "] = np.array([self.library.token_to_id(MARK)], "<u4").tobytes()
        self.odd.update(r for r, (_, same) in zip(runs, found, strict=True) if not same)
        self.lost.update(r for r, text in zip(runs, self.decode(list(out.values())), strict=True) if text != r[1:])
        return out

    def _learn(self, runs: list[str]) -> dict[str, bytes]:
        """Ids of new runs: those of one space and a word strung together, others each on its own."""
        strung: list[list[str]] = [[]]
        alone, size = [], 0
        for r in runs:
            if len(r) < 2 or r[0] != " " or " " in r[1:]:
                alone.append(r)
                continue
            strung[-1].append(r)
            size += len(r)
            if size >= STRUNG_CHARS:
                strung.append([])
                size = 0
        texts = ["".join(group)[1:] for group in strung if group]
        ids = [e.ids for e in self.library.encode_batch_fast(texts, add_special_tokens=False)] if texts else []
        same = list(map(list.__eq__, ids, self.peer.encode(texts, num_threads=1))) if texts else []
        back = list(map(str.__eq__, texts, self.library.decode_batch(ids, skip_special_tokens=False)))
        out = {}
        for group, own, one, two in zip(filter(None, strung), ids, same, back, strict=True):
            own = np.array(own, "<u4")
            begins = np.flatnonzero(self.opens[own])
            if not (one and two and len(begins) == len(group) and not begins[0]):
                alone += group
                continue
            raw, at = own.tobytes(), [*(4 * begins).tolist(), 4 * len(own)]
            out.update(zip(group, [raw[lo:hi] for lo, hi in zip(at, at[1:], strict=False)], strict=True))
        return out | (self._each(alone) if alone else {})

    def _new(self, texts: list[str]) -> list[tuple[bytes, bool]]:
        """Ids by the rebuilt tokenizer and its threads, and whether sentencepiece has the same."""
        mine = [e.ids for e in self.library.encode_batch_fast(texts, add_special_tokens=False)]
        same = list(map(list.__eq__, mine, self.peer.encode(texts, num_threads=1)))
        self.differing += len(same) - sum(same)
        return [(np.array(a, "<u4").tobytes(), ok) for a, ok in zip(mine, same, strict=True)]

    def _runs_of(self, text: str) -> list[str]:
        """A text's runs of spaces, each with its word; the dummy prefix is a space of its own."""
        if not text:
            return []
        text = " " + text.replace(MARK, " ")
        if "  " in text or "\x00" in text:
            return self._runs.findall(text)
        return text.replace(" ", "\x00 ").split("\x00")[1:]

    def encode(self, texts: list[str]) -> list[tuple[bytes, bool, bool]]:
        """(ids, parity, round trip) of each text."""
        if not self.simple:
            found = self._new(texts)
            return [(ids, same, back == t.replace(MARK, " ")) for (ids, same), back, t in zip(found, self.decode([ids for ids, _ in found]), texts, strict=True)]
        runs = list(map(self._runs_of, texts))
        if len(self.kept) >= CACHE_ROWS // 2:
            self.old, self.kept = self.kept, {}
        kept, old = self.kept, self.old
        new = []
        for run in set().union(*runs).difference(kept):
            if run in old:
                kept[run] = old[run]
            else:
                new.append(run)
        kept.update(self._learn(new))
        good = lambda bad, own: not bad or bad.isdisjoint(own)
        out = [(b"".join(map(kept.__getitem__, own)), good(self.odd, own), good(self.lost, own)) for own in runs]
        for run in new:
            if len(run) > KEPT_CHARS:
                del kept[run]
        return out

    def decode(self, texts: list[bytes]) -> list[str]:
        """Texts of ids by the tokenizer's decoder. Ids are cut where a piece begins with the marker, and each part's text is kept."""
        arrays = [np.frombuffer(x, "<u4") for x in texts]
        arrays = [a[~self.silent[a]] if self.silent[a].any() else a for a in arrays]  # control ids have no text
        if not self.simple:
            return self.library.decode_batch([a.tolist() for a in arrays], skip_special_tokens=False)
        parts = []
        for a in arrays:
            raw, cuts = a.tobytes(), (4 * np.flatnonzero(self.opens[a])).tolist()
            edges = [*([0] if not cuts or cuts[0] else []), *cuts, len(raw)]
            parts.append([raw[lo:hi] for lo, hi in zip(edges, edges[1:], strict=False) if hi > lo])
        if len(self.spelt) > CACHE_ROWS:
            self.spelt.clear()
        new = list(set().union(*parts).difference(self.spelt))
        fresh = self.library.decode_batch([np.frombuffer(x, "<u4").tolist() for x in new], skip_special_tokens=False)
        for raw, text in zip(new, fresh, strict=True):  # the decoder drops the first space of what it decodes
            self.spelt[raw] = " " + text if self.opens[int.from_bytes(raw[:4], "little")] else text
        whole = ["".join(map(self.spelt.__getitem__, own)) for own in parts]
        for raw in new:
            if len(raw) > 4 * KEPT_CHARS:
                del self.spelt[raw]
        return [x[1:] if x.startswith(" ") else x for x in whole]


_loaded: dict[str, Codec] = {}


def load(path: str) -> Codec:
    if path not in _loaded:
        _loaded[path] = Codec(path)
    return _loaded[path]


def _mapped(docs: DataFrame, vocabulary: str | None, schema: str, columns) -> DataFrame:
    """(doc_id, what ``columns`` makes of a codec and the texts' (ids, parity, round trip))."""
    prepare(docs.sparkSession)
    path = vocabulary or path_of("piece_bpe_32k.model")
    names = [x.split()[0] for x in schema.split(", ")]
    kinds = [{"binary": pa.binary(), "long": pa.int64(), "boolean": pa.bool_()}[x.split()[1]] for x in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = load(path)
        for batch in batches:
            texts = [(t or b"").decode("utf-8", "replace") for t in batch.column(1).to_pylist()]
            made = columns(codec, codec.encode(texts))
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(x, kind) for x, kind in zip(made, kinds, strict=True))], ["doc_id", *names])

    return id_and_text(docs).mapInArrow(run, f"doc_id long, {schema}")


def encoded(docs: DataFrame, vocabulary: str | None = None) -> DataFrame:
    """(doc_id, ids, parity, round_trip): ids as little-endian unsigned 32-bit numbers."""
    return _mapped(docs, vocabulary, "ids binary, parity boolean, round_trip boolean", lambda codec, found: zip(*found, strict=True) if found else ([], [], []))


def decoded(encoded_rows: DataFrame, vocabulary: str | None = None) -> DataFrame:
    """(doc_id, text) of (doc_id, ids)."""
    path = vocabulary or path_of("piece_bpe_32k.model")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = load(path)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(codec.decode([x or b"" for x in batch.column(1).to_pylist()]), pa.string())], ["doc_id", "text"])

    return encoded_rows.select("doc_id", "ids").mapInArrow(run, "doc_id long, text string")


def op1_sentencepiece(docs: DataFrame) -> DataFrame:
    """doc_id, n_tokens, ids_crc32, round_trip: whether decoding gives the text back (literal markers as spaces), parity: whether sentencepiece has the same ids."""

    def columns(codec: Codec, found: list[tuple[bytes, bool, bool]]):
        return [len(ids) // 4 for ids, _, _ in found], [zlib.crc32(ids) for ids, _, _ in found], [back for _, _, back in found], [same for _, same, _ in found]

    return _mapped(docs, None, "n_tokens long, ids_crc32 long, round_trip boolean, parity boolean", columns)
