"""Operator 7: toxicity by subword-bag embeddings averaged into a linear softmax, trained jointly in numpy.

Each distinct word, in <>, gives its character n-grams; each n-gram, hashed to a bucket, has a vector;
a document is the mean of all its n-grams' vectors, and a linear softmax reads it. Misspelt and inflected
words share n-grams with the words seen in training.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from cuegrain.llm.common import cut, give_back, text_or_empty

SIZES = (3, 4, 5, 6)
BUCKETS = 1 << 18
DIM = 8
EPOCHS = 12
RATE = 0.5
MOMENTUM = 0.9
DECAY = 1e-4
BATCH = 64
#: Buckets in fewer training texts than this keep a zero vector.
LEAST_TEXTS = 3
#: N-grams without a vector that every mean includes, so that a few words decide little.
PADDING = 300
#: Log odds of a text without evidence: fixed, so that a text is toxic for what it says and not for what it lacks.
NO_EVIDENCE = -2.0
#: What means are multiplied by, so that a few words among hundreds count.
SCALE = 200.0
#: Training rows of each class at most, after ids and texts met, in the order of a hash of their id: the bound of the sample.
ROWS_PER_CLASS = 1500
#: Characters of the training texts of each class at most, in the same order; a text beyond the bound is not trained on.
CHARS_PER_CLASS = 12_000_000
#: Words whose sums a worker keeps at most; later ones are summed each time.
KNOWN_WORDS = 150_000
TEXTS = 500
_MUL = np.uint64(0x9E3779B97F4A7C15)


def ngram_buckets(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of all n-grams of all words, word by word, and where each word's begin (one more for the end)."""
    text = "".join([f"<{w}>" for w in words])
    code = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64)
    length = np.fromiter(map(len, words), np.int64, len(words)) + 2
    word = np.repeat(np.arange(len(words)), length)
    end = np.repeat(np.cumsum(length), length)
    place, bucket = [], []
    rolling = np.zeros(len(code), np.uint64)
    at = np.arange(len(code))
    for k in range(max(SIZES)):
        step = np.zeros(len(code), np.uint64)
        step[: len(code) - k] = code[k:]
        rolling = (rolling ^ step) * _MUL
        rolling ^= rolling >> np.uint64(29)
        if k + 1 in SIZES:
            ok = at + k < end
            place.append(word[ok])
            bucket.append((rolling[ok] >> np.uint64(20)) % np.uint64(BUCKETS))
    place, bucket = np.concatenate(place), np.concatenate(bucket).astype(np.int32)
    order = np.argsort(place, kind="stable")
    return bucket[order], np.searchsorted(place[order], np.arange(len(words) + 1))


@dataclass
class Model:
    """Vectors of the buckets (BUCKETS x DIM) and the softmax over the two labels (DIM x 2, and 2 biases)."""

    vectors: np.ndarray
    weights: np.ndarray
    bias: np.ndarray

    def margins(self) -> np.ndarray:
        """What an n-gram adds to logit 1 less logit 0, before the mean: the mean is linear."""
        return (self.vectors @ (self.weights[:, 1] - self.weights[:, 0])).astype(np.float32)


def train(bags: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, seed: int = 7) -> Model:
    """Vectors and softmax together, by stochastic gradient descent with momentum. bags: distinct buckets and their shares of a document.

    Bags are read where they lie, a batch at a time, so training adds little to the memory of the sample.
    """
    rng = np.random.default_rng(seed)
    texts = np.zeros(BUCKETS, np.int32)
    for buckets, _ in bags:
        texts[buckets] += 1
    used = np.flatnonzero(texts >= LEAST_TEXTS)
    place = np.full(BUCKETS, -1, np.int32)
    place[used] = np.arange(len(used), dtype=np.int32)
    n = len(bags)
    vectors = rng.normal(0, 0.01, (len(used), DIM)).astype(np.float32)
    weights, bias = rng.normal(0, DIM**-0.5, (DIM, 2)).astype(np.float32), np.array([0, NO_EVIDENCE if n else 0], np.float32)
    move_v, move_w = np.zeros_like(vectors), np.zeros_like(weights)
    one_hot = np.eye(2, dtype=np.float32)[labels]
    for epoch in range(EPOCHS if n else 0):
        rate = RATE * (1 - epoch / EPOCHS)
        for chosen in np.array_split(rng.permutation(n), max(1, n // BATCH)):
            idx = place[np.concatenate([bags[i][0] for i in chosen])]
            known = idx >= 0
            row = np.repeat(np.arange(len(chosen)), [len(bags[i][0]) for i in chosen])[known]
            idx, share = idx[known], np.concatenate([bags[i][1] for i in chosen])[known] * np.float32(SCALE)
            sizes = np.bincount(row, minlength=len(chosen))
            mean = np.zeros((len(chosen), DIM), np.float32)
            if len(idx):
                mean[sizes > 0] = np.add.reduceat(vectors[idx] * share[:, None], (np.cumsum(sizes) - sizes)[sizes > 0])
            logits = mean @ weights + bias
            p = np.exp(logits - logits.max(axis=1, keepdims=True))
            error = (p / p.sum(axis=1, keepdims=True) - one_hot[chosen]) / len(chosen)
            back = (error @ weights.T)[row] * share[:, None]
            move_v *= MOMENTUM
            for k in range(DIM):
                move_v[:, k] += np.bincount(idx, back[:, k], len(used)).astype(np.float32)
            move_v += DECAY * vectors
            move_w = MOMENTUM * move_w + mean.T @ error + DECAY * weights
            vectors -= rate * move_v
            weights -= 0.1 * rate * move_w
    full = np.zeros((BUCKETS, DIM), np.float32)
    full[used] = vectors
    return Model(full, weights * np.float32(SCALE), bias)


def _words(text: str | None) -> set[str]:
    return set((text or "").lower().split())


def bag(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct buckets of a text's distinct words and the share of the n-grams that each has."""
    buckets, _ = ngram_buckets(sorted(_words(text)))
    known, count = np.unique(buckets, return_counts=True)
    return known, (count / (len(buckets) + PADDING)).astype(np.float32)


def training_rows(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", label_col: str = "toxic", text_col: str = "text", per_class: int = ROWS_PER_CLASS, chars_per_class: int = CHARS_PER_CLASS) -> DataFrame:
    """(id, text, label): distinct labelled texts of ids outside the held-out fold, the first per_class of each label by a hash of the id.

    Copies of a row count once, and texts of one id a row each, so no id takes more than the sample. Held out are ids with crc32(id as text) mod 5 = 0. Null ids, and labels other than 0 and 1, are not used.
    Of those rows, the ones stay whose texts together have at most chars_per_class characters, counted in that order and past texts that alone are longer.
    """
    chosen = labels.select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("label")).where("label IN (0, 1) AND pmod(crc32(cast(id AS string)), 5) <> 0").distinct()
    texts = docs.select(F.col(id_col).alias("id"), text_or_empty(text_col).alias("text")).withColumn("hash", F.xxhash64("text"))
    keys = texts.select("id", "hash", F.length("text").alias("chars")).where(F.col("chars") <= chars_per_class).distinct().join(chosen, "id")
    keys = _first_hashes(cut(keys, "labelled"), per_class)
    order = Window.partitionBy("label").orderBy(F.xxhash64("id"), "id", "hash")
    ranked = keys.withColumn("n", F.row_number().over(order)).where(F.col("n") <= per_class)  # at most 2 * per_class rows
    few = ranked.withColumn("total", F.sum("chars").over(order.rowsBetween(Window.unboundedPreceding, 0))).where(F.col("total") <= chars_per_class).select("id", "hash", "label")
    return texts.join(F.broadcast(few), ["id", "hash"]).dropDuplicates(["id", "hash", "label"]).select("id", "text", "label")


def _first_hashes(keys: DataFrame, per_class: int) -> DataFrame:
    """Rows of keys (id, label) whose id's hash is among the lowest, some times per_class for each label: no task then orders a whole class.

    A share of the range of hashes is taken by the number of rows. Should it hold too few of a label, all rows are left in.
    """
    hashed = F.xxhash64("id")
    found = {r.label: r.n for r in keys.groupBy("label").agg(F.count("*").alias("n")).collect()}
    limits = {y: -(1 << 63) + (1 << 64) * 4 * per_class // n for y, n in found.items() if n > 8 * per_class}
    low = keys
    for y, limit in limits.items():
        low = low.where((F.col("label") != y) | (hashed < limit))
    held = {r.label: r.n for r in low.groupBy("label").agg(F.count("*").alias("n")).collect()} if limits else found
    return low if all(held.get(y, 0) >= min(n, 2 * per_class) for y, n in found.items()) else keys


def fit(docs: DataFrame, labels: DataFrame, **columns: str) -> Model:
    """Fit on the bounded sample, in one task: its texts meet there, in a fixed order, and bags are made there.

    The driver sees the model only: of each bucket that has a vector its number and DIM floats, 9 MB at most.
    """

    def learn(sample: pa.Table) -> pa.Table:
        rows = sorted((str(i), zlib.crc32(t.encode("utf-8", "surrogatepass")), y, t) for i, t, y in zip(*(sample[x].to_pylist() for x in ("id", "text", "label")), strict=True))
        model = train([bag(r[3]) for r in rows], np.array([r[2] for r in rows], np.int64))
        give_back()
        used = np.flatnonzero(model.vectors.any(axis=1)).astype(np.int32)
        parts = [used, model.vectors[used], model.weights.astype(np.float32), model.bias]
        return pa.Table.from_arrays([pa.array([x.tobytes()], pa.binary()) for x in parts], names=["used", "vectors", "weights", "bias"])

    sample = training_rows(docs, labels, **columns).withColumn("one", F.lit(0))
    found = sample.groupBy("one").applyInArrow(learn, "used binary, vectors binary, weights binary, bias binary").first()
    if found is None:  # no usable label
        return train([], np.zeros(0, np.int64))
    used = np.frombuffer(found.used, np.int32)
    vectors = np.zeros((BUCKETS, DIM), np.float32)
    vectors[used] = np.frombuffer(found.vectors, np.float32).reshape(-1, DIM)
    return Model(vectors, np.frombuffer(found.weights, np.float32).reshape(DIM, 2), np.frombuffer(found.bias, np.float32))


class Scorer:
    """Scores of texts; what a word adds is summed once and remembered."""

    def __init__(self, margins: np.ndarray, bias: float):
        self.margins, self.bias = margins, bias
        self.place: dict[str, int] = {}
        self.sums, self.counts = np.zeros(0, np.float64), np.zeros(0, np.int64)

    def scores(self, texts: list[str | None]) -> list[float]:
        split = [_words(t) for t in texts]
        new = list(set().union(*split).difference(self.place))
        kept = len(self.place)
        if new:
            new.sort()
            buckets, starts = ngram_buckets(new)
            # each word's own sum (every word has an n-gram), the same whatever words stand beside it
            self.place.update(zip(new, range(kept, kept + len(new)), strict=True))
            self.sums = np.concatenate([self.sums[:kept], np.add.reduceat(self.margins[buckets].astype(np.float64), starts[:-1])])
            self.counts = np.concatenate([self.counts[:kept], np.diff(starts)])
        get, out = self.place.__getitem__, []
        for words in split:
            at = np.fromiter(map(get, words), np.int64, len(words))
            # sorted, so that the score does not depend on the order of a set
            logit = float(self.bias + np.sort(self.sums[at]).sum() / (self.counts[at].sum() + PADDING))
            out.append(float(1 / (1 + np.exp(-min(max(logit, -500.0), 500.0)))))
        if len(self.place) > KNOWN_WORDS:
            for w in new:
                del self.place[w]
        return out


def _scored(docs: DataFrame, model: Model, text_col: str, take: Callable[[pa.RecordBatch, pa.Array], pa.RecordBatch], schema: StructType | str) -> DataFrame:
    """What `take` makes of each batch of docs and its scores; every whole text is scored, null as empty. Tasks get the model's BUCKETS sums."""
    shared = docs.sparkSession.sparkContext.broadcast((model.margins(), float(model.bias[1] - model.bias[0])))
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(*shared.value)
        for batch in batches:
            for i in range(0, batch.num_rows, TEXTS):
                part = batch.slice(i, TEXTS)
                yield take(part, pa.array(scorer.scores(part.column(at).to_pylist()), pa.float64()))
        del scorer
        give_back()

    return docs.mapInArrow(run, schema)


def toxicity(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, held_out, score, predicted) per row of docs.

    A null or empty text has no evidence and a score below 0.5. A null id is not held out. Without usable
    labels every score is 0.5. Repeated rows score alike; other columns are not read. A very long text is
    scored whole, by its distinct words. Ties of the sample's order fall to the id and the text's hash.
    An empty table gives an empty result.
    """
    model = fit(docs, labels, id_col=id_col, text_col=text_col)
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    schema = StructType([rows.schema["id"]]).add("score", "double")
    scored = _scored(rows, model, "text", lambda part, scores: pa.RecordBatch.from_arrays([part.column(0), scores], names=["id", "score"]), schema)
    held = F.coalesce(F.pmod(F.crc32(F.col("id").cast("string")), F.lit(5)) == 0, F.lit(False))
    scored = scored.select("id", held.alias("held_out"), "score")
    return scored.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def drop_toxic(docs: DataFrame, labels: DataFrame, known: DataFrame | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs whose score is below 0.5, with their columns; `known` has the texts of labelled rows if docs hasn't."""
    model = fit(known if known is not None else docs, labels, id_col=id_col, text_col=text_col)
    return _scored(docs, model, text_col, lambda part, scores: part.filter(pc.less(scores, 0.5)), docs.schema)
