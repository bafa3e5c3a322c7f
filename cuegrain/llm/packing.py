"""Operator 10: best-fit decreasing packing of token pieces into sequences of bounded length."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructType

from cuegrain.llm.common import cut, give_back
from cuegrain.llm.tokens import END_ID, Encoder, encoder, tokenizer_path

ROOM = 1024
#: Pieces of a group, about; each group is packed on its own and wastes at most about one sequence more.
GROUP_PIECES = 50_000
TEXTS = 500


def pieces(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", tokenizer: str | None = None, room: int = ROOM, end_id: int = END_ID, keep_ids: bool = False, known_words: int | None = None) -> DataFrame:
    """(id, piece, start, length, ids_crc32[, ids]) of every document; the first piece may be shorter.

    A document of at most `room` ids is one piece. Of a longer one the first piece takes what is left
    over and all others are full. A null text is an empty one, which has its end id only.
    A worker remembers the ids of words from one task to the next; with known_words, it remembers that
    many and only within a task, which takes less memory and more time.
    """
    tokenizer = tokenizer or tokenizer_path()
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(tokenizer, end_id) if known_words is None else Encoder(tokenizer, end_id, known_words)
        for batch in batches:
            for at in range(0, batch.num_rows, TEXTS):
                part = batch.slice(at, TEXTS)
                row, number, start, length, crc, held = [], [], [], [], [], []
                for k, ids in enumerate(encode.encode(part.column(1).to_pylist())):
                    n = len(ids) // 4
                    cuts = [0, *range(n % room or room, n + 1, room)]
                    for i, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False)):
                        row.append(k), number.append(i), start.append(a), length.append(b - a)
                        crc.append(zlib.crc32(ids[4 * a : 4 * b]))
                        if keep_ids:
                            held.append(ids[4 * a : 4 * b])
                cols = [part.column(0).take(pa.array(row, pa.int64())), pa.array(number, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64())]
                names = ["id", "piece", "start", "length", "ids_crc32"]
                if keep_ids:
                    cols.append(pa.array(held, pa.binary()))
                    names.append("ids")
                yield pa.RecordBatch.from_arrays(cols, names=names)
        del encode
        give_back()

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, f"id {kind}, piece int, start long, length long, ids_crc32 long" + ", ids binary" * keep_ids)


def best_fit(lengths: np.ndarray, room: int) -> tuple[np.ndarray, np.ndarray]:
    """Bin and offset of each piece by best-fit decreasing.

    A segment tree over remaining capacities counts the open bins of each; a descent finds the least
    capacity that fits, in logarithmic time for each piece. Among equal bins the one opened last is taken.
    """
    size = 1 << room.bit_length()
    tree = [0] * (2 * size)
    bins: list[list[int]] = [[] for _ in range(size)]
    where, offset, opened = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64), 0

    def count(capacity: int, by: int) -> None:
        node = capacity + size
        while node:
            tree[node] += by
            node >>= 1

    def tightest(need: int) -> int:
        """The least capacity of an open bin that is at least `need`, or -1."""
        node = need + size
        if tree[node]:
            return need
        while node > 1:  # up to the first right sibling that holds a bin, then down to its least
            if not node & 1 and tree[node + 1]:
                node += 1
                while node < size:
                    node = 2 * node if tree[2 * node] else 2 * node + 1
                return node - size
            node >>= 1
        return -1

    for i in np.argsort(-lengths, kind="stable").tolist():
        need = int(lengths[i])
        left = tightest(need)
        if left < 0:
            left, b, opened = room, opened, opened + 1
        else:
            b = bins[left].pop()
            count(left, -1)
        where[i], offset[i] = b, room - left
        if left > need:
            bins[left - need].append(b)
            count(left - need, 1)
    return where, offset


def pack_pieces(found: DataFrame, room: int = ROOM, group_pieces: int = GROUP_PIECES) -> DataFrame:
    """found (id, piece, start, length, ids_crc32, ...) with sequence_id and offset.

    Pieces are dealt by hash to groups of about group_pieces, alike in their lengths, and each group is
    packed by a task of its own: no group grows with the corpus. The group's number is in the upper
    bits of sequence_id.
    """
    found = cut(found.withColumn("row", F.monotonically_increasing_id()), "pieces")
    groups = max(1, -(-found.count() // group_pieces))

    def run(key: tuple[pa.Scalar, ...], rows: pa.Table) -> pa.Table:
        rows = rows.sort_by([("length", "descending"), ("row", "ascending")])
        where, offset = best_fit(rows["length"].to_numpy(), room)
        kept = rows.select([f.name for f in placed.fields][:-2])
        return kept.append_column("sequence_id", pa.array((np.int64(key[0].as_py()) << np.int64(32)) + where)).append_column("offset", pa.array(offset))

    placed = StructType([*(f for f in found.schema.fields if f.name != "row")]).add("sequence_id", LongType()).add("offset", LongType())
    dealt = found.withColumn("packing_group", F.pmod(F.xxhash64("row"), F.lit(groups)))
    return dealt.groupBy("packing_group").applyInArrow(run, placed)


def best_fit_packing(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", tokenizer: str | None = None, room: int = ROOM, group_pieces: int = GROUP_PIECES, known_words: int | None = None) -> DataFrame:
    """(id, piece, start, length, ids_crc32, sequence_id, offset) per piece of every document.

    A null or empty text is one piece, its end id; null ids are kept; a very long text is cut into full
    pieces. Ties in length keep the order of rows. Repeated rows are packed each. Columns other than the
    two are not read. An empty table gives none.
    """
    return pack_pieces(pieces(docs, id_col, text_col, tokenizer, room, known_words=known_words), room, group_pieces)
