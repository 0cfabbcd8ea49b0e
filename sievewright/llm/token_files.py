"""Token files: independent zstandard frames with a trailing seek table.

A file holds the ids of consecutive documents (little-endian, unsigned):

* zstandard frames, each of whole documents, compressed on their own; ids are of 16
  bits in a file whose ids all are below 65,536, else of 32;
* a skippable frame (0x184D2A50) with the directory: shard, bytes of an id, number of
  documents, how many of them have no doc_id (they are the last), doc_ids of the others
  (int64), ids of each document (uint64), frame of each (uint32);
* the seek table of the public seekable format: a skippable frame (0x184D2A5E) with
  the compressed and raw size and the checksum (low 32 bits of XXH64) of each frame,
  and a footer of the number of frames, a flag byte and the magic 0x8F92EAB1.

A reader takes the footer, then the directory, and decompresses the frames of the
documents it wants. Files are written by Spark's own text writer, one row to a file,
so they go to any file system and only whole files of successful tasks appear; its
line end is set to 0x8F, the last byte of the footer, which the row leaves out.

Null and empty texts are the end id alone; an empty table gives no files and no rows;
repeated rows are stored each. Documents with a null doc_id follow all others, by the
hash of their text, and are read back with a null doc_id. A very long text is one
document in a frame of its own. Only doc_id and text are read, so other columns may have
any name.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import tokens
from .common import id_and_text, new_path, prepare, written

END_ID = 0
FRAME_BYTES = 256 << 10
#: Raw bytes of a file; a partition with more makes several.
FILE_BYTES = 64 << 20
DIRECTORY_MAGIC, TABLE_MAGIC, FOOTER_MAGIC = 0x184D2A50, 0x184D2A5E, 0x8F92EAB1


def encode_file(shard: tuple[int, int], docs: list[tuple[int | None, bytes]]) -> bytes:
    """The file of (doc_id, raw ids) pairs; those with a null doc_id come last."""
    import xxhash
    import zstandard

    squeeze = zstandard.ZstdCompressor(level=1)
    arrays = [np.frombuffer(raw, "<u4") for _, raw in docs]
    width = 2 if all(int(a.max(initial=0)) < 1 << 16 for a in arrays) else 4
    frames, table, frame_of, held, size = [], [], [], [], 0

    def close() -> None:
        nonlocal held, size
        if held:
            raw = b"".join(held)
            frames.append(squeeze.compress(raw))
            table.append((len(frames[-1]), len(raw), xxhash.xxh64_intdigest(raw) & 0xFFFFFFFF))
        held, size = [], 0

    for a in arrays:
        raw = a.astype(f"<u{width}").tobytes()
        if held and size + len(raw) > FRAME_BYTES:
            close()
        frame_of.append(len(frames))
        held.append(raw)
        size += len(raw)
    close()
    named = [d for d, _ in docs if d is not None]
    directory = struct.pack("<IIQQQ", *shard, width, len(docs), len(docs) - len(named)) + np.array(named, "<i8").tobytes() + np.array([len(a) for a in arrays], "<u8").tobytes() + np.array(frame_of, "<u4").tobytes()
    frames.append(struct.pack("<II", DIRECTORY_MAGIC, len(directory)) + directory)
    table.append((len(frames[-1]), 0, 0))
    entries = b"".join(struct.pack("<III", *x) for x in table)
    return b"".join(frames) + struct.pack("<II", TABLE_MAGIC, len(entries) + 9) + entries + struct.pack("<IBI", len(table), 0x80, FOOTER_MAGIC)


class TokenFile:
    """Random access to one file, given a function (offset, length) -> bytes and the file's size."""

    def __init__(self, read, size: int):
        n, flags, magic = struct.unpack("<IBI", read(size - 9, 9))
        if magic != FOOTER_MAGIC or not flags & 0x80:
            raise ValueError("not a token file")
        table = np.frombuffer(read(size - 9 - 12 * n, 12 * n), "<u4").reshape(n, 3)
        self.read, self.table = read, table
        self.offsets = np.concatenate([[0], np.cumsum(table[:, 0].astype(np.int64))])
        raw = read(int(self.offsets[n - 1]) + 8, int(table[n - 1, 0]) - 8)
        part, seq, self.width, docs, nameless = struct.unpack("<IIQQQ", raw[:32])
        self.shard = (part, seq)
        named = docs - nameless
        self.doc_ids = np.frombuffer(raw, "<i8", named, 32)
        self.counts = np.frombuffer(raw, "<u8", docs, 32 + 8 * named).astype(np.int64)
        self.frame_of = np.frombuffer(raw, "<u4", docs, 32 + 8 * named + 8 * docs)
        starts = np.cumsum(self.counts) - self.counts
        first = np.searchsorted(self.frame_of, self.frame_of, side="left")
        self.within = starts - starts[first] if docs else starts
        self._frame: tuple[int, bytes] = (-1, b"")

    def frame(self, k: int) -> bytes:
        import xxhash
        import zstandard

        if self._frame[0] != k:
            raw = zstandard.ZstdDecompressor().decompress(self.read(int(self.offsets[k]), int(self.table[k, 0])))
            if xxhash.xxh64_intdigest(raw) & 0xFFFFFFFF != int(self.table[k, 2]) or len(raw) != int(self.table[k, 1]):
                raise ValueError(f"frame {k} is damaged")
            self._frame = (k, raw)
        return self._frame[1]

    def document(self, row: int) -> np.ndarray:
        """The ids of the row-th document; only its frame is decompressed."""
        raw = self.frame(int(self.frame_of[row]))
        return np.frombuffer(raw, f"<u{self.width}", int(self.counts[row]), self.width * int(self.within[row])).astype("<u4")

    def find(self, doc_id: int | None) -> list[np.ndarray]:
        """The ids of the documents with this doc_id, or without any if it is None."""
        if doc_id is None:
            return [self.document(k) for k in range(len(self.doc_ids), len(self.counts))]
        lo, hi = np.searchsorted(self.doc_ids, [doc_id, doc_id + 1])
        return [self.document(k) for k in range(int(lo), int(hi))]


def opened(content: bytes) -> TokenFile:
    return TokenFile(lambda at, n: content[at : at + n], len(content))


def write(docs: DataFrame, path: str, end_id: int = END_ID, vocabulary: str | None = None, partitions: int | None = None) -> None:
    """Encode ``docs`` and write token files in ascending doc_id order, null ids last."""
    from pyspark import TaskContext

    prepare(docs.sparkSession)
    vocabulary = vocabulary or tokens.vocabulary("byte_bpe_50k.json")
    end = np.array([end_id], "<u4").tobytes()
    parts = partitions or int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder, part, seq, held, size = tokens.load(vocabulary), TaskContext.get().partitionId(), 0, [], 0

        def shard() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([encode_file((part, seq), held)[:-1]], pa.binary())], ["file"])

        for batch in batches:
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                raw = coder.encode((text or b"").decode("utf-8", "replace")) + end
                if held and size + len(raw) > FILE_BYTES:
                    yield shard()
                    seq, held, size = seq + 1, [], 0
                held.append((doc, raw))
                size += len(raw)
        if held:
            yield shard()

    # the hash only parts rows that have the same doc_id
    texts = id_and_text(docs).withColumn("tie", F.xxhash64("text"))
    order = (F.asc_nulls_last("doc_id"), F.asc("tie"))
    ordered = texts.repartitionByRange(parts, *order).sortWithinPartitions(*order).select("doc_id", "text")
    files = ordered.mapInArrow(run, "file binary").select(F.col("file").cast("string").alias("value"))
    files.write.option("maxRecordsPerFile", 1).option("encoding", "ISO-8859-1").option("lineSep", "\x8f").option("compression", "none").text(path)


def read(spark: SparkSession, path: str) -> DataFrame:
    """(part, seq, doc_id, within, n_tokens, ids_crc32) of every document; ``within`` counts ids before it in its file."""
    prepare(spark)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column(0).to_pylist():
                f = opened(content)
                n = len(f.counts)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([f.shard[0]] * n, pa.int32()), pa.array([f.shard[1]] * n, pa.int32()), pa.array([*f.doc_ids.tolist(), *[None] * (n - len(f.doc_ids))], pa.int64()), pa.array(np.cumsum(f.counts) - f.counts), pa.array(f.counts),
                        pa.array([zlib.crc32(f.document(k)) for k in range(n)], pa.int64()),
                    ],
                    ["part", "seq", "doc_id", "within", "n_tokens", "ids_crc32"],
                )

    files = spark.read.format("binaryFile").load(path).select("content")
    return files.mapInArrow(run, "part int, seq int, doc_id long, within long, n_tokens long, ids_crc32 long")


def op6_token_files(docs: DataFrame) -> DataFrame:
    spark = docs.sparkSession
    path = new_path(spark, "tokens")
    write(docs, path)
    rows = written(read(spark, path), "token-rows")
    # one row for each file: the sums before a file are taken over files, not documents
    files = rows.groupBy("part", "seq").agg(F.sum("n_tokens").alias("n"))
    earlier = lambda w: F.coalesce(F.sum("n").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    # the files of a partition are summed in its own task; only a row for each partition, a set number, meets in one
    parts = files.groupBy("part").agg(F.sum("n").alias("n")).select("part", earlier(Window.orderBy("part")).alias("base"))
    firsts = files.select("part", "seq", earlier(Window.partitionBy("part").orderBy("seq")).alias("own")).join(parts, "part").select("part", "seq", (F.col("base") + F.col("own")).alias("first"))
    return rows.join(firsts, ["part", "seq"]).select("doc_id", (F.col("first") + F.col("within")).alias("start"), "n_tokens", "ids_crc32")
