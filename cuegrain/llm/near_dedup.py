"""Operator 5: near-duplicates by banded MinHash, sequential Bayesian verification and an exact check.

A document is its set of distinct five-word shingles. Signatures propose pairs band by band; a pair's
signatures are then compared batch by batch, and the pair is dropped as soon as the posterior
probability that its similarity reaches the threshold falls below a chosen miss probability; what
survives is decided on the full shingle sets.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import blake2b
from math import comb

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cuegrain.llm.common import broadcast_below, cut, give_back, meet_totals, slices_of, smallest_first
from cuegrain.llm.components import components

WIDTH = 5
#: Links need 100 * intersection >= PERCENT * union.
PERCENT = 75
#: A pair at the threshold shares none of the bands with probability (1 - 0.75**5)**52 < 1e-6.
BANDS, ROWS = 52, 5
#: Signature values compared in verification, 16 bits of each, BATCH at a time.
VERIFY, BATCH = 128, 16
#: Probability that a pair at or above the threshold is dropped at one batch.
MISS = 1e-7
#: Buckets with more rows than this after the round with one of them are compared in blocks, not in pairs.
DENSE = 32
#: Rows, and shingles, of a block at most (on average: rows are dealt to blocks by hash).
BLOCK_ROWS, BLOCK_ITEMS = 512, 1_000_000
#: Rows of shingles hashed at a time, so that very long texts need bounded memory.
CHUNK = 2048

_random = np.random.default_rng(5)
_XOR = _random.integers(0, 1 << 32, BANDS * ROWS, dtype=np.uint64).astype(np.uint32)
_MUL = _random.integers(0, 1 << 32, BANDS * ROWS, dtype=np.uint64).astype(np.uint32) | np.uint32(1)
_BAND = _random.integers(0, 1 << 63, (BANDS, ROWS), dtype=np.uint64) | np.uint64(1)
_STEP = np.uint64(0x9E3779B97F4A7C15)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingles(text: str | None, width: int = WIDTH) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the word shingles; A-Z are lower-cased, words split at ASCII space.

    A text of fewer words is one shingle; one without words has none.
    """
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
    k = min(width, len(h))
    acc = np.full(len(h) - k + 1, k, np.uint64)
    for i in range(k):
        acc = _mix(acc * _STEP + h[i : len(h) - k + 1 + i])
    return np.unique(acc)


def signature(items: np.ndarray) -> np.ndarray:
    x = (items >> np.uint64(32)).astype(np.uint32)
    out = np.full(BANDS * ROWS, 0xFFFFFFFF, np.uint32)
    for i in range(0, len(x), CHUNK):
        np.minimum(out, ((x[i : i + CHUNK, None] ^ _XOR) * _MUL).min(axis=0), out=out)
    return out


def band_keys(sig: np.ndarray) -> np.ndarray:
    """A 64-bit key per band; equal in two documents if the band's values are (and the band is the same)."""
    return _mix((sig.reshape(BANDS, ROWS).astype(np.uint64) * _BAND).sum(axis=1, dtype=np.uint64) + _STEP * np.arange(1, BANDS + 1, dtype=np.uint64)).view(np.int64)


def least_matches(threshold: float, miss: float = MISS) -> dict[int, int]:
    """For each number of values compared so far, the fewest matches with which a pair is kept.

    With a uniform prior, the similarity after m matches in n values follows Beta(m + 1, n - m + 1),
    and the chance that it reaches the threshold is P(Binomial(n + 1, threshold) <= m).
    """
    out = {}
    for n in range(BATCH, VERIFY + 1, BATCH):
        below, m = 0.0, -1
        while below < miss:
            m += 1
            below += comb(n + 1, m) * threshold**m * (1 - threshold) ** (n + 1 - m)
        out[n] = m
    return out


def sketch(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH, row_col: str | None = None) -> DataFrame:
    """(row, id, n, digest, bands, sig) per document; digest tells equal shingle sets."""
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                part = batch.slice(at, 1000)
                n, digest, bands, sigs = [], [], [], []
                for text in part.column(2).to_pylist():
                    items = shingles(text, width)
                    n.append(len(items))
                    if len(items):
                        s = signature(items)
                        digest.append(blake2b(items.tobytes(), digest_size=16).digest())
                        bands.append(band_keys(s))
                        sigs.append(s[:VERIFY].astype("<u2").tobytes())
                    else:
                        digest.append(None), bands.append(None), sigs.append(None)
                cols = [part.column(0), part.column(1), pa.array(n, pa.int64()), pa.array(digest, pa.binary()), pa.array(bands, pa.list_(pa.int64())), pa.array(sigs, pa.binary())]
                yield pa.RecordBatch.from_arrays(cols, names=["row", "id", "n", "digest", "bands", "sig"])

    number = F.col(row_col) if row_col else F.monotonically_increasing_id()
    rows = docs.select(number.alias("row"), F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return cut(rows.mapInArrow(run, f"row long, id {kind}, n long, digest binary, bands array<long>, sig binary"), "sketch")


def _prune(threshold: float):
    kept = least_matches(threshold)

    @F.arrow_udf("boolean")
    def survives(a: pa.Array, b: pa.Array) -> pa.Array:
        x = np.frombuffer(b"".join(a.to_pylist()), "<u2").reshape(-1, VERIFY)
        y = np.frombuffer(b"".join(b.to_pylist()), "<u2").reshape(-1, VERIFY)
        alive, matches = np.arange(len(x)), np.zeros(len(x), np.int64)
        for n, least in kept.items():  # only pairs still alive are compared further
            matches[alive] += (x[alive, n - BATCH : n] == y[alive, n - BATCH : n]).sum(axis=1)
            alive = alive[matches[alive] >= least]
        out = np.zeros(len(x), bool)
        out[alive] = True
        return pa.array(out)

    return survives


class _Verifier:
    """Decides pairs (low, high) of rows: Bayesian pruning on signatures, then the full sets."""

    def __init__(self, docs: DataFrame, sketches: DataFrame, reps: DataFrame, id_col: str, text_col: str, width: int, percent: int):
        self.docs, self.sketches, self.reps, self.width, self.percent = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")), sketches, reps, width, percent

    def links(self, pairs: DataFrame) -> DataFrame:
        a = self.reps.select(F.col("row").alias("low"), F.col("n").alias("na"), F.col("sig").alias("sa"))
        b = self.reps.select(F.col("row").alias("high"), F.col("n").alias("nb"), F.col("sig").alias("sb"))
        near = pairs.join(a, "low").join(b, "high").where(f"100 * least(na, nb) >= {self.percent} * greatest(na, nb)")
        near = cut(near.where(_prune(self.percent / 100)("sa", "sb")).select("low", "high"), "survivors")
        sets = self.sets(near.select(F.col("low").alias("row")).union(near.select("high")).distinct(), "array<long>")
        p = sets.select(F.col("row").alias("low"), F.col("items").alias("pa"))
        q = sets.select(F.col("row").alias("high"), F.col("items").alias("pb"))
        common = F.size(F.array_intersect("pa", "pb"))
        both = near.join(p, "low").join(q, "high")
        return both.where(100 * common >= self.percent * (F.size("pa") + F.size("pb") - common)).select("low", "high")

    def sets(self, rows: DataFrame, form: str) -> DataFrame:
        """(row, items) of some rows, made again from their texts; form is array<long>, or binary for numpy."""
        width = self.width
        wanted = cut(self.reps.join(rows, "row", "left_semi").select("row", "id", "digest"), "wanted")
        ids = broadcast_below(cut(wanted.select(F.col("id").alias("wanted_id")).distinct(), "wanted-ids"))
        kind = self.docs.schema["id"].dataType.simpleString()

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for at in range(0, batch.num_rows, 500):
                    part = batch.slice(at, 500)
                    items = [shingles(t, width) for t in part.column(1).to_pylist()]
                    digests = pa.array([blake2b(x.tobytes(), digest_size=16).digest() for x in items], pa.binary())
                    held = pa.array([x.tobytes() for x in items], pa.binary()) if form == "binary" else pa.array([x.view(np.int64) for x in items], pa.list_(pa.int64()))
                    yield pa.RecordBatch.from_arrays([part.column(0), digests, held], names=["id", "digest", "items"])

        chosen = self.docs.join(ids, F.col("id").eqNullSafe(F.col("wanted_id")), "left_semi")
        made = chosen.mapInArrow(run, f"id {kind}, digest binary, items {form}").alias("m")
        w = broadcast_below(wanted).alias("w")
        same = F.col("m.id").eqNullSafe(F.col("w.id")) & (F.col("m.digest") == F.col("w.digest"))
        # rows repeated with one id and text give one set, chosen as any of them
        return cut(made.join(w, same).select("w.row", "m.items").dropDuplicates(["row"]), "sets")


def _counts(a: list[np.ndarray], b: list[np.ndarray], columns: int = 8192) -> np.ndarray:
    """Sizes of the intersections of each set of a with each of b: products of 0/1 matrices, some columns at a time."""
    known, at = np.unique(np.concatenate(a + b), return_inverse=True)
    which = np.repeat(np.arange(len(a) + len(b)), [len(x) for x in a + b])
    order = np.argsort(at, kind="stable")
    at, which = at[order], which[order]
    out = np.zeros((len(a), len(b)), np.float64)
    for start in range(0, len(known), columns):
        lo, hi = np.searchsorted(at, [start, start + columns])
        m = np.zeros((len(a) + len(b), min(columns, len(known) - start)), np.float32)
        m[which[lo:hi], at[lo:hi] - start] = 1
        out += m[: len(a)] @ m[len(a) :].T
    return out.astype(np.int64)


def _compare_blocks(percent: int):
    """Links between the rows of two blocks that are in different components: Bayesian pruning, then the full sets."""
    kept = least_matches(percent / 100)

    def run(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        _, first, second = (k.as_py() for k in key)
        block, row, component = (table.column(c).to_numpy() for c in ("block", "row", "component"))
        sig = np.frombuffer(b"".join(table.column("sig").to_pylist()), "<u2").reshape(-1, VERIFY)
        sides = [np.flatnonzero(block == z) for z in (first, second)]
        i, j = (side[z] for side, z in zip(sides, np.nonzero(component[sides[0]][:, None] != component[sides[1]][None, :]), strict=True))
        if first == second:
            i, j = i[row[i] < row[j]], j[row[i] < row[j]]
        matches = np.zeros(len(i), np.int64)
        for n, least in kept.items():
            matches += (sig[i, n - BATCH : n] == sig[j, n - BATCH : n]).sum(axis=1)
            i, j, matches = (v[matches >= least] for v in (i, j, matches))
        if len(i):
            items = table.column("items")
            ua, ub = np.unique(i), np.unique(j)
            sa, sb = ([np.frombuffer(items[int(k)].as_py(), np.uint64) for k in u] for u in (ua, ub))
            at, to = np.searchsorted(ua, i), np.searchsorted(ub, j)
            common = _counts(sa, sb)[at, to]
            total = np.array([len(v) for v in sa])[at] + np.array([len(v) for v in sb])[to] - common
            ok = 100 * common >= percent * total
            i, j = i[ok], j[ok]
            # one link for each two components is enough
            _, one = np.unique(np.stack([component[i], component[j]]), axis=1, return_index=True)
            i, j = i[one], j[one]
        return pa.table({"low": pa.array(np.minimum(row[i], row[j]), pa.int64()), "high": pa.array(np.maximum(row[i], row[j]), pa.int64())})

    return run


def _links_in_dense(verifier: _Verifier, dense: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Links between rows that dense buckets join, and (node, cluster).

    dense: (key, node, component). Rows joined by dense buckets form a cluster; a cluster's rows are
    dealt to blocks by hash. Each row goes once to every pair of blocks that its own is in, and these
    pairs are the keys by which the rows are shuffled, so a hot cluster is many keys of at most two
    blocks each. Only links leave a task.
    """
    hubs = dense.groupBy("key").agg(F.min("node").alias("low"), slices_of("node").alias("slices"))
    clusters = components(meet_totals(dense, hubs, "key", "node").where("low < node").select("low", F.col("node").alias("high")))
    clusters = cut(clusters.withColumnRenamed("component", "cluster"), "clusters")
    sets = verifier.sets(clusters.select(F.col("node").alias("row")), "binary")
    known = dense.select("node", "component").distinct()
    rows = clusters.join(known, "node").withColumnRenamed("node", "row").join(sets, "row").join(verifier.reps.select("row", "n", "sig"), "row")
    rows = cut(rows, "dense-rows")
    fill = F.greatest(F.count("*") / BLOCK_ROWS, F.sum("n") / BLOCK_ITEMS)
    # a cluster that is one component has nothing to link
    sizes = rows.groupBy("cluster").agg(F.ceil(fill).alias("blocks"), slices_of("row").alias("slices"), F.min("component").alias("a"), F.max("component").alias("b"))
    dealt = meet_totals(rows, sizes.where("a <> b").drop("a", "b"), "cluster", "row").withColumn("block", F.pmod(F.xxhash64("row"), "blocks"))
    pairs = dealt.withColumn("other", F.explode(F.expr("sequence(0L, blocks - 1)")))
    pairs = pairs.select("cluster", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "block", "row", "component", "sig", "items")
    return pairs.groupBy("cluster", "i", "j").applyInArrow(_compare_blocks(verifier.percent), "low long, high long"), clusters


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH, percent: int = PERCENT, row_col: str | None = None) -> DataFrame:
    """One row per input row: row, id, n_shingles, component_id, kept.

    Rows whose shingle sets share `percent` of their union are linked; component_id is the smallest
    id reachable over links, and the row that has it is kept (null ids last; of repeated rows one).
    A null, empty or blank text has no shingles, is linked with nothing and stays. Other columns are
    not read. row_col numbers the rows if the caller needs to find them again. An empty table gives an
    empty result.
    """
    sketches = sketch(docs, id_col, text_col, width, row_col)
    # equal sets are one node: the smallest row of each
    nodes = sketches.where("n > 0").groupBy("digest").agg(F.min("row").alias("node"), slices_of("row").alias("slices"))
    nodes = cut(nodes, "nodes")
    reps = cut(sketches.join(nodes.select(F.col("node").alias("row")), "row", "left_semi"), "representatives")
    verifier = _Verifier(docs, sketches, reps, id_col, text_col, width, percent)

    # each bucket's members meet the smallest of them
    keyed = reps.select(F.col("row").alias("node"), F.explode("bands").alias("key"))
    hubs = keyed.groupBy("key").agg(F.count("*").alias("n"), F.min("node").alias("hub"), slices_of("node").alias("slices")).where("n > 1").drop("n")
    met = cut(meet_totals(keyed, hubs, "key", "node").where("node <> hub"), "buckets")
    links = cut(verifier.links(met.select(F.col("hub").alias("low"), F.col("node").alias("high")).distinct()), "links")
    found = cut(components(links), "components")
    # a bucket stays open while its members, the hub aside, are in several components
    rest = met.select("key", "node").join(found, "node", "left").withColumn("component", F.coalesce("component", "node"))
    split = rest.groupBy("key").agg(F.min("component").alias("a"), F.max("component").alias("b"), F.count("*").alias("members"), slices_of("node").alias("slices"))
    open_rows = cut(meet_totals(rest, split.where("a <> b").drop("a", "b"), "key", "node"), "buckets")
    if not open_rows.isEmpty():
        in_blocks, clusters = _links_in_dense(verifier, open_rows.where(f"members > {DENSE}"))
        sparse = open_rows.where(f"members <= {DENSE}").join(clusters, "node", "left")
        other = sparse.select("key", F.col("node").alias("other"), F.col("component").alias("its"), F.col("cluster").alias("there"))
        pairs = sparse.join(other, "key").where("node < other AND component <> its AND NOT coalesce(cluster = there, false)")
        new = cut(verifier.links(pairs.select(F.col("node").alias("low"), F.col("other").alias("high")).distinct()), "links")
        found = components(links.union(new).union(cut(in_blocks, "links")))

    labelled = nodes.join(found, "node", "left").select("digest", F.coalesce("component", "node").alias("component"), "slices")
    rows = meet_totals(sketches.select("row", "id", "n", "digest"), labelled, "digest", "row", "left").withColumn("component", F.coalesce("component", "row"))
    rows = cut(rows.select("row", "id", "n", "component"), "labelled")
    first = rows.groupBy("component").agg(F.min(smallest_first("id", "row")).alias("first"), slices_of("row").alias("slices"))
    rows = meet_totals(rows, first, "component", "row")
    return rows.select("row", "id", F.col("n").alias("n_shingles"), F.col("first.id").alias("component_id"), (F.col("row") == F.col("first.row")).alias("kept"))


def drop_near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs that stay, one of each group of near-duplicates, with their columns."""
    numbered = cut(docs.withColumn("__cg_row", F.monotonically_increasing_id()), "numbered")  # written, so that both reads number alike
    gone = near_duplicates(numbered, id_col, text_col, row_col="__cg_row").where("NOT kept").select(F.col("row").alias("__cg_row"))
    gone = broadcast_below(cut(gone, "gone"))
    return numbered.join(gone, "__cg_row", "left_anti").select(*docs.columns)
