"""Operator 2: token ids in fixed-width bit-packed blobs with block offsets.

A blob holds the ids of consecutive documents, each id in the fewest bits that the vocabulary needs,
the most significant bit first. Blocks of BLOCK ids begin at byte boundaries, so a block is unpacked on
its own with numpy, and any range of ids touches only its blocks. Layout, little-endian:

    magic 4s "CGTB" | version u16 | bits u16 | block u32 | documents u32 | ids u64
    first id of each document, and the end: u64 * (documents + 1)
    byte at which each block begins, and the end: u64 * (blocks + 1)
    packed blocks

Blobs are rows of a Parquet folder (shard, part, blob, n_ids), written by Spark: any store that Spark
writes to will do, and a task that is run again leaves no second copy.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cuegrain.llm.common import scratch_path
from cuegrain.llm.tokens import END_ID, encoder, tokenizer_path

MAGIC, VERSION = b"CGTB", 1
HEAD = struct.Struct("<4sHHIIQ")
BLOCK = 4096
#: Ids after which a blob is closed; bounds a blob's size and a task's memory, whatever the partition holds.
BLOB_IDS = 2_000_000
#: Texts encoded at a time.
TEXTS = 500


def id_bits(vocabulary: int) -> int:
    """The fewest bits that hold every id below `vocabulary`."""
    return max(1, (vocabulary - 1).bit_length())


def pack(ids: np.ndarray, bits: int) -> bytes:
    shifts = np.arange(bits - 1, -1, -1, dtype=np.uint32)
    return np.packbits((ids.astype(np.uint32)[:, None] >> shifts) & np.uint32(1)).tobytes()


def unpack(data: bytes | memoryview, n: int, bits: int) -> np.ndarray:
    if bits == 16:
        return np.frombuffer(data, ">u2", n).astype(np.uint32)
    rows = np.unpackbits(np.frombuffer(data, np.uint8), count=n * bits).reshape(n, bits)
    return rows.astype(np.uint32) @ (np.uint32(1) << np.arange(bits - 1, -1, -1, dtype=np.uint32))


def write_blob(documents: list[bytes], bits: int, block: int = BLOCK) -> bytes:
    """documents: ids of each, as little-endian unsigned 32-bit integers."""
    ids = np.frombuffer(b"".join(documents), "<u4")
    firsts = np.cumsum([0, *(len(d) // 4 for d in documents)], dtype="<u8")
    if bits == 16:  # a block of 16-bit ids is the ids themselves
        blocks = [ids[i : i + block].astype(">u2").tobytes() for i in range(0, len(ids), block)]
    else:
        blocks = [pack(ids[i : i + block], bits) for i in range(0, len(ids), block)]
    at = np.cumsum([0, *map(len, blocks)], dtype="<u8")
    return HEAD.pack(MAGIC, VERSION, bits, block, len(documents), len(ids)) + firsts.tobytes() + at.tobytes() + b"".join(blocks)


class Blob:
    """Random access to the ids of a blob."""

    def __init__(self, data: bytes):
        magic, version, self.bits, self.block, self.documents, self.ids = HEAD.unpack_from(data)
        if magic != MAGIC or version != VERSION:
            raise ValueError("not a token blob of a known version")
        blocks = -(-self.ids // self.block)
        self.firsts = np.frombuffer(data, "<u8", self.documents + 1, HEAD.size).astype(np.int64)
        self.at = np.frombuffer(data, "<u8", blocks + 1, HEAD.size + self.firsts.nbytes).astype(np.int64)
        self.body = memoryview(data)[HEAD.size + self.firsts.nbytes + self.at.nbytes :]

    def range(self, lo: int, hi: int) -> np.ndarray:
        """Ids lo to hi (not hi itself); only the blocks that hold them are unpacked."""
        if lo >= hi:
            return np.empty(0, np.uint32)
        first, last = lo // self.block, (hi - 1) // self.block
        got = [unpack(self.body[self.at[b] : self.at[b + 1]], min(self.block, self.ids - b * self.block), self.bits) for b in range(first, last + 1)]
        return np.concatenate(got)[lo - first * self.block : hi - first * self.block]

    def document(self, k: int) -> np.ndarray:
        return self.range(int(self.firsts[k]), int(self.firsts[k + 1]))


def write_tokens(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", tokenizer: str | None = None, end_id: int = END_ID, partitions: int | None = None, blob_ids: int = BLOB_IDS) -> None:
    """Encode every whole text, null as empty, and write the ids in ascending id order (null ids first, rows of one id by their texts).

    A text of any length is one document of one blob; a blob ends with the document that fills it.
    """
    tokenizer = tokenizer or tokenizer_path()
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        encode = encoder(tokenizer, end_id)
        bits = id_bits(max(encode.tokenizer.get_vocab_size(), end_id + 1))
        shard, part, held, names, total = TaskContext.get().partitionId(), 0, [], [], 0

        def close() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([shard], pa.int32()), pa.array([part], pa.int32()), pa.array([total], pa.int64()), pa.array([names], pa.list_(id_type)), pa.array([write_blob(held, bits)], pa.binary())], names=["shard", "part", "n_ids", "ids", "blob"])

        id_type = None
        for batch in batches:
            id_type = batch.column(0).type
            for at in range(0, batch.num_rows, TEXTS):
                piece = batch.slice(at, TEXTS)
                for name, ids in zip(piece.column(0).to_pylist(), encode.encode(piece.column(1).to_pylist()), strict=True):
                    held.append(ids), names.append(name)
                    total += len(ids) // 4
                    if total >= blob_ids:
                        yield close()
                        part, held, names, total = part + 1, [], [], 0
        if held:
            yield close()

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    n = partitions or int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = rows.repartitionByRange(n, "id").sortWithinPartitions("id", "text")
    dealt.mapInArrow(run, f"shard int, part int, n_ids long, ids array<{kind}>, blob binary").write.parquet(path)


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """(id, start, n_tokens, ids_crc32) per document, unpacked from the written blobs.

    start counts the ids of all documents before it; running totals are over a shard's blobs, then over
    the shards, a row each.
    """
    blobs = spark.read.parquet(path)
    kind = blobs.schema["ids"].dataType.elementType.simpleString()
    inside = F.sum("n_ids").over(Window.partitionBy("shard").orderBy("part")) - F.col("n_ids")
    shards = blobs.groupBy("shard").agg(F.sum("n_ids").alias("all"))
    shards = shards.select("shard", (F.sum("all").over(Window.orderBy("shard")) - F.col("all")).alias("earlier"))
    offsets = blobs.select("shard", "part", inside.alias("inside")).join(shards, "shard").select("shard", "part", (F.col("inside") + F.col("earlier")).alias("before"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                blob = Blob(batch.column(3)[i].as_py())
                ids = blob.range(0, blob.ids).astype("<u4").tobytes()
                firsts = blob.firsts
                n = blob.documents
                crc = [zlib.crc32(ids[4 * a : 4 * b]) for a, b in zip(firsts.tolist(), firsts[1:].tolist(), strict=False)]
                names = batch.column(2).slice(i, 1).flatten()
                cols = [pa.array([batch.column(0)[i].as_py()] * n, pa.int32()), pa.array([batch.column(1)[i].as_py()] * n, pa.int32()), names, pa.array(firsts[:-1]), pa.array(np.diff(firsts)), pa.array(crc, pa.int64())]
                yield pa.RecordBatch.from_arrays(cols, names=["shard", "part", "id", "local", "n_tokens", "ids_crc32"])

    got = blobs.select("shard", "part", "ids", "blob").mapInArrow(run, f"shard int, part int, id {kind}, local long, n_tokens long, ids_crc32 long")
    return got.join(offsets, ["shard", "part"]).select("id", (F.col("before") + F.col("local")).alias("start"), "n_tokens", "ids_crc32")


def token_files(docs: DataFrame, path: str | None = None, id_col: str = "doc_id", text_col: str = "text", tokenizer: str | None = None, **options) -> DataFrame:
    """Write the ids of docs to path (scratch space if none) and read them back.

    Every row counts, repeated ones too; null ids come first, and rows with one id stand in the order of
    their texts. Very long texts are encoded whole. Columns other than the two are not read. An empty
    table writes an empty folder and gives no rows.
    """
    path = path or scratch_path(docs.sparkSession, "tokens")
    write_tokens(docs, path, id_col, text_col, tokenizer, **options)
    return read_tokens(docs.sparkSession, path)
