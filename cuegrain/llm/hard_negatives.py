"""Operator 13: hard-negative mining by angular triangle filtering.

Each row's angles to a few reference directions are computed once and stored. For an anchor and a row the
angle between them lies, for every reference, between |p - q| and min(p + q, 2 pi - p - q) of their angles p and q
to it. The cosines of the tightest such limits, times both norms, bound the score, widened by
more than rounding can take away. Only rows whose bounds overlap what an anchor still seeks get the integer score.

Anchors and rows meet in blocks: a task holds one block of anchors and streams one lane of rows past it,
keeping the best few of each anchor, so its memory does not grow with the lane, and what an anchor has found
already narrows what it seeks. The best of all lanes are ranked by an ordinary window with a limit, which Spark applies before its shuffle.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, FloatType, StructType

from cuegrain.llm.common import cut

#: Reference directions, and the rows, lowest by hash, that they are fitted on: bounds of the sample. References change speed only.
REFERENCES, SAMPLE_ROWS = 16, 1_024
#: Anchors a block, rows a lane, and lanes at most (beyond it, lanes grow; they are streamed).
ANCHOR_ROWS, LANE_ROWS, MOST_LANES = 4_096, 4_096, 512
#: Rows and anchors of one matrix.
ROW_TILE, ANCHOR_TILE = 4_096, 64
#: Stored angles are 32-bit floats: no angle is off by more than this.
ANGLE_SLACK = 1e-6
#: Sums of products below this are exact in doubles.
EXACT = float(1 << 53)
LONG_MIN, LONG_MAX = -(1 << 63), (1 << 63) - 1


def reference_directions(sample: np.ndarray, count: int = REFERENCES, rounds: int = 8) -> np.ndarray:
    """Unit vectors (count x dim) by k-means on the sphere, from farthest-first starts; rows of norm 0 are not used."""
    norms = np.linalg.norm(sample, axis=1) if sample.size else np.zeros(0)
    unit = sample[norms > 0] / norms[norms > 0][:, None]
    if not len(unit):
        return np.zeros((0, sample.shape[1] if sample.ndim == 2 else 0))
    chosen = [0]
    near = unit @ unit[0]
    while len(chosen) < min(count, len(unit)):
        chosen.append(int(near.argmin()))
        near = np.maximum(near, unit @ unit[chosen[-1]])
    centres = unit[chosen]
    for _ in range(rounds):
        nearest = (unit @ centres.T).argmax(axis=1)
        sums = np.zeros_like(centres)
        np.add.at(sums, nearest, unit)
        length = np.linalg.norm(sums, axis=1)
        centres = np.where(length[:, None] > 1e-9, sums / np.maximum(length, 1e-9)[:, None], centres)
    return centres


def matrix(lists: pa.Array) -> np.ndarray:
    """A list column as a matrix of doubles; shorter lists end in zeros, which adds nothing to a product."""
    flat = lists.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    sizes = np.diff(lists.offsets.to_numpy())
    width = int(sizes.max(initial=0))
    if (sizes == width).all():
        return flat.reshape(len(sizes), width)
    out = np.zeros((len(sizes), width))
    out[np.arange(width) < sizes[:, None]] = flat
    return out


def _to_width(a: np.ndarray, width: int) -> np.ndarray:
    return a[:, :width] if a.shape[1] >= width else np.pad(a, ((0, 0), (0, width - a.shape[1])))


def angles_to(vectors: np.ndarray, references: np.ndarray) -> np.ndarray:
    """Angles (rows x references) as 32-bit floats; of a zero vector, right angles, which no bound depends on as its norm is 0."""
    width = max(vectors.shape[1], references.shape[1])
    norms = np.linalg.norm(vectors, axis=1)
    cosine = _to_width(vectors, width) @ _to_width(references, width).T / np.maximum(norms, 1e-300)[:, None]
    return np.arccos(np.clip(cosine, -1, 1)).astype(np.float32)


def score_bounds(anchor_angles: np.ndarray, anchor_norms: np.ndarray, row_angles: np.ndarray, row_norms: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Least and greatest score (anchors x rows) that the stored angles allow."""
    shape = (len(anchor_norms), len(row_norms))
    low, high = np.zeros(shape, np.float32), np.full(shape, np.pi, np.float32)
    for k in range(anchor_angles.shape[1]):
        p, q = anchor_angles[:, k, None], row_angles[None, :, k]
        np.maximum(low, np.abs(p - q), out=low)
        both = p + q
        np.minimum(high, np.minimum(both, np.float32(2 * np.pi) - both), out=high)
    size = anchor_norms[:, None] * row_norms[None, :]
    room = size * 1e-6 + 1  # of the cosines in 32 bits and of the product
    greatest = size * np.cos(np.maximum(low - ANGLE_SLACK, 0)) + room
    least = size * np.cos(np.minimum(high + ANGLE_SLACK, np.float32(np.pi))) - room
    return least, greatest


def integer_scores(anchors: np.ndarray, rows: np.ndarray, most: float) -> np.ndarray:
    """Inner products of whole numbers held as doubles, as 64-bit integers; most: a bound of their size. Beyond 64 bits they stop at its limits."""
    width = max(anchors.shape[1], rows.shape[1])
    a, r = _to_width(anchors, width), _to_width(rows, width)
    if most < EXACT:
        return (a @ r.T).astype(np.int64)
    whole = [[int(x) for x in row] for row in r.tolist()]
    exact = [[min(max(sum(x * y for x, y in zip(map(int, one), row, strict=True)), LONG_MIN), LONG_MAX) for row in whole] for one in a.tolist()]
    return np.array(exact, np.int64).reshape(len(a), len(r))


class Best:
    """The best rows of each of several searches: highest score, then smallest id (null last), then row number."""

    def __init__(self, searches: int, keep: int):
        self.keep = keep
        self.found: list[list[tuple]] = [[] for _ in range(searches)]
        #: The last of a full list; scores below it cannot enter.
        self.bar = np.full(searches, LONG_MIN, np.int64)

    def add(self, search: int, scores: np.ndarray, ids: np.ndarray, void: np.ndarray, rows: np.ndarray) -> None:
        first = np.lexsort((rows, ids, void, ~scores))[: self.keep]  # ~s = -1 - s turns the order round without overflow
        new = zip(scores[first].tolist(), void[first].tolist(), ids[first].tolist(), rows[first].tolist(), strict=True)
        best = sorted([*self.found[search], *new], key=lambda x: (-x[0], *x[1:]))[: self.keep]
        self.found[search] = best
        if len(best) == self.keep:
            self.bar[search] = best[-1][0]


class Block:
    """A block of anchors that rows stream past. keep: rows to find a search; windows: of each anchor, lists of (lowest, highest) scores sought among rows of other labels; None: highest scores of the same label."""

    def __init__(self, keep: int, windows: bool):
        self.keep, self.windows = keep, windows
        self.parts: list[dict] = []
        self.ready = False

    def anchors(self, part: dict) -> None:
        self.parts.append(part)

    def _start(self) -> None:
        width = max(p["vector"].shape[1] for p in self.parts)
        joined = {k: [_to_width(p[k], width) if k == "vector" else p[k] for p in self.parts] for k in self.parts[0] if k not in ("lowest", "highest")}
        self.a = {k: np.concatenate(v) for k, v in joined.items()}
        n = len(self.a["row"])
        if self.windows:
            limits = [list(zip(lo, hi, strict=True)) for p in self.parts for lo, hi in zip(p["lowest"], p["highest"], strict=True)]
            self.slots = max(map(len, limits), default=0)
            self.lowest, self.highest = np.full((n, self.slots), LONG_MAX, np.int64), np.full((n, self.slots), LONG_MIN, np.int64)
            for i, own in enumerate(limits):
                for j, (lo, hi) in enumerate(own):
                    self.lowest[i, j], self.highest[i, j] = lo, hi
        else:
            self.slots = 1
        self.best = Best(n * self.slots, self.keep)
        self.ready = True

    def rows(self, part: dict) -> None:
        if not self.ready:
            self._start()
        if not self.windows:  # only rows of an anchor's label are its partners
            for label in np.intersect1d(self.a["label"], part["label"]):
                mine, theirs = np.flatnonzero(self.a["label"] == label), np.flatnonzero(part["label"] == label)
                for i in range(0, len(mine), ANCHOR_TILE):
                    self._meet(mine[i : i + ANCHOR_TILE], {k: v[theirs] for k, v in part.items()})
        else:
            for i in range(0, len(self.a["row"]), ANCHOR_TILE):
                self._meet(np.arange(i, min(i + ANCHOR_TILE, len(self.a["row"]))), part)

    def _meet(self, at: np.ndarray, part: dict) -> None:
        a = self.a
        least, greatest = score_bounds(a["angles"][at], a["norm"][at], part["angles"], part["norm"])
        partner = a["row"][at][:, None] != part["row"][None, :]
        if self.windows:
            partner &= a["label"][at][:, None] != part["label"][None, :]
            bars = self.best.bar.reshape(-1, self.slots)[at]
            open_ = self.lowest[at] <= self.highest[at]
            low = np.where(open_, np.maximum(self.lowest[at], bars), LONG_MAX).min(axis=1, initial=LONG_MAX)
            high = np.where(open_, self.highest[at], LONG_MIN).max(axis=1, initial=LONG_MIN)
            overlap = partner & (greatest >= low[:, None]) & (least <= high[:, None])
        else:
            low = self.best.bar[at].astype(np.float64)
            if partner.shape[1] > self.keep:  # as many rows of this tile are known to score so much
                certain = np.partition(np.where(partner, least, -np.inf), -self.keep, axis=1)[:, -self.keep]
                low = np.maximum(low, certain)
            overlap = partner & (greatest >= low[:, None])
        seen = np.flatnonzero(overlap.any(axis=0))
        if not len(seen):
            return
        overlap = overlap[:, seen]
        most = float(a["norm"][at].max() * part["norm"][seen].max())
        scores = integer_scores(a["vector"][at], part["vector"][seen], most)
        ids, void, rows = part["id"][seen], part["void"][seen], part["row"][seen]
        for j in range(self.slots):
            search = at * self.slots + j
            ok = overlap & (scores >= self.best.bar[search][:, None])
            if self.windows:
                ok &= (scores >= self.lowest[at, j][:, None]) & (scores <= self.highest[at, j][:, None])
            for i in np.flatnonzero(ok.any(axis=1)):
                own = np.flatnonzero(ok[i])
                self.best.add(int(search[i]), scores[i, own], ids[own], void[own], rows[own])

    def results(self) -> Iterator[tuple[int, int, int, int | None, int]]:
        """(anchor's row, search, row, id, score)."""
        if self.ready:
            for s, found in enumerate(self.best.found):
                for score, void, key, row in found:
                    yield int(self.a["row"][s // self.slots]), s % self.slots, row, None if void else key, score


OUT = "anchor_row long, search int, row long, id long, score long"


def _streamed(keep: int, windows: bool) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Batches of rows sorted by (block, lane, kind): anchors of a block and lane first, then its rows."""

    def part_of(batch: pa.RecordBatch) -> dict:
        ids = batch.column("id")
        got = {"row": batch.column("row").to_numpy(), "void": ids.is_null().to_numpy(zero_copy_only=False), "id": ids.fill_null(0).to_numpy(), "label": batch.column("label").to_numpy(), "norm": batch.column("norm").to_numpy()}
        got |= {"vector": np.floor(256 * matrix(batch.column("vector"))), "angles": matrix(batch.column("angles")).astype(np.float32)}
        return got

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, at = None, None

        def ended() -> pa.RecordBatch:
            rows = list(zip(*block.results(), strict=True)) or [[]] * 5
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
            return pa.RecordBatch.from_arrays([pa.array(list(x), k) for x, k in zip(rows, kinds, strict=True)], names=["anchor_row", "search", "row", "id", "score"])

        for batch in batches:
            keys = np.stack([batch.column(k).to_numpy() for k in ("block", "lane", "kind")])
            edges = np.flatnonzero((keys[:, 1:] != keys[:, :-1]).any(axis=0)) + 1
            for lo, hi in zip([0, *edges.tolist()], [*edges.tolist(), batch.num_rows], strict=True):
                if hi == lo:
                    continue
                key = tuple(keys[:2, lo])
                if key != at:
                    if block is not None:
                        yield ended()
                    block, at = Block(keep, windows), key
                if keys[2, lo] == 0:
                    own = batch.slice(lo, hi - lo)
                    more = {"lowest": own.column("lowest").to_pylist(), "highest": own.column("highest").to_pylist()} if windows else {}
                    block.anchors(part_of(own) | more)
                elif block.parts:
                    for k in range(lo, hi, ROW_TILE):
                        block.rows(part_of(batch.slice(k, min(ROW_TILE, hi - k))))
        if block is not None:
            yield ended()

    return run


def _meet(anchors: DataFrame, rows: DataFrame, blocks: int, lanes: int, keep: int, windows: bool) -> DataFrame:
    """Best rows of each anchor and search in each lane. Every block of anchors meets every lane of rows."""
    own = [*rows.columns, *(["lowest", "highest"] if windows else [])]
    left = anchors.select(*own, F.pmod(F.xxhash64("row"), F.lit(blocks)).cast("int").alias("block"), F.explode(F.sequence(F.lit(0), F.lit(lanes - 1))).alias("lane"), F.lit(0).alias("kind"))
    right = rows.select("*", *[F.lit(None).cast("array<long>").alias(x) for x in own[len(rows.columns) :]], F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"), F.pmod(F.xxhash64("row"), F.lit(lanes)).cast("int").alias("lane"), F.lit(1).alias("kind"))
    met = left.unionByName(right).repartition(min(blocks * lanes, 20_000), "block", "lane").sortWithinPartitions("block", "lane", "kind")
    return met.mapInArrow(_streamed(keep, windows), OUT)


def _ranked(found: DataFrame, keep: int) -> DataFrame:
    order = Window.partitionBy("anchor_row", "search").orderBy(F.col("score").desc(), F.col("id").isNull(), "id", "row")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= keep)


def prepared_vectors(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """(row, id, label, vector, norm, angles): rows that take part, with what is stored of them, as a written table."""
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("long").alias("label"), F.col(vector_col).alias("vector")).where(F.col("label").isNotNull() & F.col("vector").isNotNull())
    # beyond 7e305, 256 * x is infinite
    rows = rows.where(~F.exists("vector", lambda v: v.isNull() | F.isnan(v.cast("double")) | (F.abs(v.cast("double")) >= 7e305)))
    sample = [r.vector for r in rows.select("vector", F.xxhash64("vector").alias("h")).orderBy("h").limit(SAMPLE_ROWS).collect()]
    references = reference_directions(np.floor(256 * matrix(pa.array(sample, pa.list_(pa.float64())))))
    shared = vectors.sparkSession.sparkContext.broadcast(references)
    schema = StructType(list(rows.schema.fields)).add("norm", "double").add("angles", ArrayType(FloatType()))

    def store(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, batch.num_rows, ROW_TILE):
                part = batch.slice(k, ROW_TILE)
                whole = np.floor(256 * matrix(part.column("vector")))
                angles = angles_to(whole, shared.value)
                lists = pa.ListArray.from_arrays(np.arange(len(angles) + 1, dtype=np.int32) * angles.shape[1], pa.array(angles.ravel(), pa.float32()))
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(np.linalg.norm(whole, axis=1)), lists], names=schema.names)

    return cut(rows.mapInArrow(store, schema).withColumn("row", F.monotonically_increasing_id()), "vectors")


def hard_negatives(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", anchors: Column | None = None, positives: int = 5, negatives: int = 5, least_percent: int = 80) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score).

    Components become floor(256 * x), and scores are their integer inner products. anchors: a condition on id
    (by default, divisible by 100). An anchor's positives are the first rows of its label by score, itself left out;
    the negatives of a positive are the first rows of other labels that score from least_percent to 100 per cent of it.
    Rows with a null label or vector, or a null or non-finite component, take no part. A row with a null
    id is no anchor and comes last among ties. Rows are rows: repeated ones are each found, and repeated anchors each search. Vectors
    of different lengths are compared on what both have; empty and zero vectors score 0. Positives with a negative score have no negatives.
    Other columns are not read. An empty table, or one without anchors, gives an empty result. All rows are scored or bounded, whatever
    the label's size: rows are dealt to lanes by a hash of their place and not by label or value.
    """
    rows = prepared_vectors(vectors, id_col, vector_col, label_col)
    chosen = (F.col("id") % 100 == 0) if anchors is None else anchors
    n = rows.agg(F.count("*").alias("rows"), F.count_if(chosen).alias("anchors")).first()
    blocks, lanes = max(1, -(-n.anchors // ANCHOR_ROWS)), min(MOST_LANES, max(1, -(-n.rows // LANE_ROWS)))
    starts = rows.where(chosen)
    first = _ranked(_meet(starts, rows, blocks, lanes, positives, False), positives)
    first = first.groupBy("anchor_row").agg(F.sort_array(F.collect_list(F.struct("rank", "id", "score"))).alias("found"))  # at most `positives` each
    # ceil(least_percent * score / 100), without leaving 64 bits
    lowest = F.expr(f"transform(found, p -> p.score div 100 * {least_percent} + ceil(p.score % 100 * {least_percent} / 100.0D))")
    limits = starts.join(first, starts.row == first.anchor_row).drop("anchor_row")
    limits = cut(limits.withColumns({"lowest": lowest, "highest": F.col("found.score")}), "anchors")
    second = _ranked(_meet(limits, rows, blocks, lanes, negatives, True), negatives)
    known = limits.select(F.col("row").alias("anchor_row"), F.col("id").alias("anchor_id"), F.posexplode("found").alias("search", "positive"))
    return second.join(known, ["anchor_row", "search"]).select("anchor_id", F.col("positive.id").alias("positive_id"), "rank", F.col("id").alias("negative_id"), F.col("positive.score").alias("positive_score"), F.col("score").alias("negative_score"))
