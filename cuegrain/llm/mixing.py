"""Operator 1: mixing sources to target weights by blocks of words.

Each source's documents, one after another, are cut into blocks of `block` words. The mix is a row of
slots in shards of fixed size; each shard draws how many of its slots each source gets from a
multinomial over the targets. A source's slots, counted over the shards, run through its blocks by
one pseudorandom permutation of the block numbers for each pass, and slots and blocks meet by number.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cuegrain.llm.common import WORD, broadcast_below, cut, text_or_empty

BLOCK_WORDS = 128
SHARD_SLOTS = 4096
#: A source is taken at most so many times.
PASSES = 3
#: Weights of the sources by code point of their names, repeating.
WEIGHTS = (1, 2, 3)
#: Rows of a lane, about: a source's documents are laid end to end in lanes, so that no task orders a whole source.
LANE_ROWS = 2_000
#: Groups of sources that a shard draws for at first; with more sources, each group then draws for its own.
GROUPS = 4096
#: Neighbours in an order whose running sums are made together, so that no task orders all of a hot source.
STRETCH = 1024


def word_count(text: Column) -> Column:
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(WORD)).cast("long")


def _ranked(table: DataFrame, by: str) -> DataFrame:
    """table with s, the place of each row in the order of `by`, null last; rows are sorted in ranges, not in one task."""
    ordered = cut(table.orderBy(F.col(by).asc_nulls_last()).withColumn("__cg_at", F.monotonically_increasing_id()), "ranked")
    place = F.col("__cg_at").bitwiseAND((1 << 33) - 1)
    ranges = ordered.groupBy(F.shiftright("__cg_at", 33).alias("__cg_range")).agg(F.count("*").alias("n"))  # a row a task
    ranges = ranges.select("__cg_range", (F.sum("n").over(Window.orderBy("__cg_range")) - F.col("n")).alias("__cg_before"))
    return ordered.withColumn("__cg_range", F.shiftright("__cg_at", 33)).join(F.broadcast(ranges), "__cg_range").withColumn("s", place + F.col("__cg_before")).drop("__cg_at", "__cg_range", "__cg_before")


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, passes: int = PASSES) -> DataFrame:
    """sizes (source, source_size, ...) with s and target for each row.

    Sources in order of code points, null last, are numbered s and weigh `weights`, repeating, and share
    the sum of all sizes. A source's target stops at passes * source_size; the excess is shared by weight
    among the others until none is above. Each round is one aggregation over the table of sources.
    """
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), (F.col("s") % len(weights) + 1).cast("int"))
    plan = cut(_ranked(sizes, "source").withColumn("weight", w).withColumn("cap", passes * F.col("source_size").cast("double")), "sources")
    over, left, free = F.lit(False), 0.0, 1.0
    total, known = plan.agg(F.sum("source_size")).first()[0] or 0, -1
    while True:
        found = plan.agg(F.count_if(over).alias("n"), F.coalesce(F.sum(F.when(over, F.col("cap"))), F.lit(0.0)).alias("held"), F.coalesce(F.sum(F.when(~over, F.col("weight"))), F.lit(0.0)).alias("free")).first()
        if found.n == known or not found.free:
            break
        known, left, free = found.n, float(total - found.held), found.free
        over = F.lit(left) * F.col("weight") / F.lit(free) > F.col("cap")
    return plan.withColumn("target", F.when(over, F.col("cap")).otherwise(F.lit(left) * F.col("weight") / F.lit(free))).drop("weight", "cap")


def _start(table: DataFrame, by: str, order: str, value: str) -> DataFrame:
    """table with start: the sum of value over the rows of the same `by` whose order (from 0, each once) is smaller.

    Sums are made in stretches of STRETCH neighbours, then over the stretches, so a hot key is many tasks' work.
    """
    table = table.withColumn("__cg_stretch", F.floor(F.col(order) / STRETCH))
    stretches = table.groupBy(by, "__cg_stretch").agg(F.sum(value).alias("__cg_sum"))
    stretches = stretches.select(by, "__cg_stretch", (F.sum("__cg_sum").over(Window.partitionBy(by).orderBy("__cg_stretch")) - F.col("__cg_sum")).alias("__cg_before"))
    within = F.sum(value).over(Window.partitionBy(by, "__cg_stretch").orderBy(order)) - F.col(value)
    return table.withColumn("__cg_within", within).join(stretches, [by, "__cg_stretch"]).withColumn("start", F.col("__cg_within") + F.col("__cg_before")).drop("__cg_stretch", "__cg_within", "__cg_before")


def permuted(index: np.ndarray, n: np.ndarray, key: np.ndarray) -> np.ndarray:
    """Image of index under a pseudorandom permutation of 0 to n - 1: a keyed Feistel network on the next
    power of four, walked until it lands below n. All arrays are of one length."""
    half = np.maximum(1, np.array([(int(x - 1).bit_length() + 1) // 2 for x in np.unique(n)]))[np.searchsorted(np.unique(n), n)].astype(np.uint64)
    mask = (np.uint64(1) << half) - np.uint64(1)
    out = index.astype(np.uint64)
    todo = np.arange(len(out))
    while len(todo):
        h, m, k = half[todo], mask[todo], key[todo].astype(np.uint64)
        left, right = out[todo] >> h, out[todo] & m
        for turn in range(4):
            x = (right + k + np.uint64(turn * 0x632BE5AB)) * np.uint64(0x9E3779B97F4A7C15)
            x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
            left, right = right, left ^ ((x ^ (x >> np.uint64(32))) & m)
        out[todo] = (left << h) | right
        todo = todo[out[todo] >= n[todo].astype(np.uint64)]
    return out.astype(np.int64)


def _draws(recipe: DataFrame, sources: int, shards: int, shard_slots: int, total: int, seed: int) -> DataFrame:
    """(shard, s, drawn): how many slots of each shard each source draws, of a multinomial over all quotas; none are left out.

    A shard draws for GROUPS groups of sources (with fewer sources, for each), and a group that is drawn draws for its sources.
    """
    groups = min(sources, GROUPS)
    quotas = recipe.groupBy((F.col("s") % max(1, groups)).alias("g")).agg(F.sum("quota").alias("quota")).orderBy("g").collect()  # at most GROUPS rows
    share = np.array([r.quota for r in quotas], np.float64) / max(1, total)

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for shard in batch.column(0).to_pylist():
                n = np.random.default_rng([seed, shard]).multinomial(min(shard_slots, total - shard * shard_slots), share)
                g = np.flatnonzero(n)
                yield _batch(shard=np.full(len(g), shard), g=g, drawn=n[g])

    drawn = recipe.sparkSession.range(shards).toDF("shard").mapInArrow(first, "shard long, g long, drawn long")
    if sources <= GROUPS:
        return drawn.withColumnRenamed("g", "s")
    members = cut(recipe.groupBy((F.col("s") % groups).alias("g")).agg(F.array_sort(F.collect_list(F.struct("s", "quota"))).alias("members")), "members")

    def second(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                s, quota = (np.array([m[k] for m in row["members"]]) for k in ("s", "quota"))
                n = np.random.default_rng([seed, row["shard"], row["g"]]).multinomial(row["drawn"], quota / quota.sum())
                yield _batch(shard=np.full((n > 0).sum(), row["shard"]), s=s[n > 0], drawn=n[n > 0])

    return drawn.join(members, "g").mapInArrow(second, "shard long, s long, drawn long")


def _slots(plan: DataFrame, shard_slots: int, block: int, seed: int) -> DataFrame:
    """(shard, slot, s, pass, block): which block of which source fills each slot of each shard. plan: s, source_size, target."""
    size = F.col("source_size")
    blocks = F.ceil(size / block)
    whole = F.when(size > 0, F.floor(F.col("target") / size)).otherwise(0)
    # slots of each source: whole passes, and as many blocks more as come nearest to the target
    quota = F.col("whole") * F.col("blocks") + F.least(F.rint((F.col("target") - F.col("whole") * size) / block).cast("long"), "blocks")
    recipe = plan.withColumns({"blocks": blocks, "whole": whole}).select("s", "blocks", F.least(quota, PASSES * F.col("blocks")).alias("quota"))
    recipe = cut(recipe, "recipe")
    sources, total = recipe.agg(F.count("*"), F.coalesce(F.sum("quota"), F.lit(0))).first()
    shards = -(-total // shard_slots)
    drawn = _start(cut(_draws(recipe, sources, shards, shard_slots, total, seed), "draws"), "s", "shard", "drawn")
    drawn = cut(drawn.join(broadcast_below(recipe), "s").withColumn("end", F.col("start") + F.col("drawn")), "drawn")
    # draws beyond a source's slots are void, and last shards settle what the draws left
    inside = drawn.select("shard", "s", "blocks", "start", F.least("end", "quota").alias("end")).where("start < end")
    reached = drawn.groupBy("s").agg(F.max("end").alias("reached"))
    left = recipe.join(reached, "s", "left").withColumn("reached", F.coalesce("reached", F.lit(0))).where("reached < quota")
    left = left.withColumn("start", F.explode(F.sequence(F.col("reached"), F.col("quota") - 1, F.lit(shard_slots).cast("long"))))
    extra = F.lit(shards) + F.floor((F.col("start") - F.col("reached")) / shard_slots)
    settle = left.select(extra.alias("shard"), "s", "blocks", "start", F.least(F.col("start") + shard_slots, F.col("quota")).alias("end"))
    runs = inside.unionByName(settle)

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, 64):
                shard, s, blocks, start, end = (c.to_numpy() for c in batch.slice(i, 64).columns)
                n = end - start
                row = np.repeat(np.arange(len(n)), n)
                j = start[row] + np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
                turn = j // blocks[row]
                key = (np.uint64(seed) * np.uint64(1_000_003) + s[row].astype(np.uint64)) * np.uint64(PASSES + 1) + turn.astype(np.uint64)
                yield _batch(shard=shard[row], slot=j, s=s[row], **{"pass": turn}, block=permuted(j % blocks[row], blocks[row], key))

    return runs.select("shard", "s", "blocks", "start", "end").mapInArrow(number, "shard long, slot long, s long, pass long, block long")


def _batch(**columns: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c.astype(np.int64)) for c in columns.values()], names=list(columns))


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", block: int = BLOCK_WORDS, shard_slots: int = SHARD_SLOTS, seed: int = 1, weights: tuple[int, ...] = WEIGHTS, row_col: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(rows, taken): the documents, and which words of them fill which slot.

    rows: row, id, size, source_size, target. taken: shard, slot, pass, row, first, words (word
    positions from 0). A null text has no words; documents without words fill no slot. Null is a
    source of its own, last in order. Repeated rows are documents each; null ids come first in a lane.
    A very long text spans many blocks. The same documents and seed give the same mix: within a source
    they are laid out by a hash of id and text. row_col numbers the rows if the caller needs to find
    them again. Other columns are not read. An empty table gives empty ones. The number of sources has
    no bound: their table is planned, and drawn for, by Spark.
    """
    number = F.col(row_col) if row_col else F.monotonically_increasing_id()
    rows = docs.select(number.alias("row"), F.col(id_col).alias("id"), F.col(source_col).cast("string").alias("source"), word_count(F.col(text_col)).alias("size"), F.xxhash64(text_or_empty(text_col)).alias("mark"))
    rows = cut(rows, "sizes")
    counts = rows.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n"))
    plan = cut(source_targets(counts, weights).withColumn("lanes", F.ceil(F.col("n") / LANE_ROWS)), "plan")
    known = broadcast_below(plan.select(F.col("source").alias("name"), "s", "source_size", "target", "lanes"))
    rows = rows.join(known, F.col("source").eqNullSafe(F.col("name"))).drop("name", "source")
    rows = rows.withColumn("lane", F.pmod(F.xxhash64("id", "mark"), "lanes"))

    # where each document begins in its source: lanes end to end, and in order within each lane
    lanes = _start(rows.groupBy("s", "lane").agg(F.sum("size").alias("words")), "s", "lane", "words").select("s", "lane", F.col("start").alias("before"))
    within = F.sum("size").over(Window.partitionBy("s", "lane").orderBy("id", "mark", "row").rowsBetween(Window.unboundedPreceding, 0)) - F.col("size")
    placed = rows.where("size > 0").withColumn("begin", within).join(lanes, ["s", "lane"]).select("s", "row", "size", (F.col("begin") + F.col("before")).alias("begin"))
    b = F.lit(block).cast("long")
    spread = placed.select("s", "row", "size", "begin", F.explode(F.sequence(F.floor(F.col("begin") / b), F.floor((F.col("begin") + F.col("size") - 1) / b))).alias("block"))
    first = F.greatest(F.lit(0), F.col("block") * b - F.col("begin"))
    last = F.least("size", (F.col("block") + 1) * b - F.col("begin"))
    spans = spread.select("s", "block", "row", first.alias("first"), (last - first).alias("words"))
    slots = _slots(plan, shard_slots, block, seed)
    # Spark takes slots for as small as the runs that they are numbered from, and would broadcast them
    taken = slots.join(spans.hint("merge"), ["s", "block"]).select("shard", "slot", "pass", "row", "first", "words")
    return rows.select("row", "id", "size", "source_size", "target"), taken


def mixed_sizes(docs: DataFrame, **options) -> DataFrame:
    """(id, size, source_size, target, taken) per row: how many words of it the mix takes, repeats counted."""
    rows, taken = mix(docs, **options)
    words = taken.groupBy("row").agg(F.sum("words").alias("taken"))
    return rows.join(words, "row", "left").select("id", "size", "source_size", "target", F.coalesce("taken", F.lit(0).cast("long")).alias("taken"))


def mixed_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", **options) -> DataFrame:
    """The mix as rows of docs: for each pass that takes words of a document, a row with those words.

    A document that a pass takes whole keeps its text as it is; else its text holds the taken words,
    each stretch as it stood, stretches joined by a space. An n_chars column follows the text.
    Documents without words hold none of the mix and go.
    """
    keyed = cut(docs.withColumn("__cg_row", F.monotonically_increasing_id()), "numbered")  # written, so that both reads number alike
    _, taken = mix(keyed, id_col, text_col, source_col, row_col="__cg_row", **options)
    parts = taken.groupBy("row", "pass").agg(F.array_sort(F.collect_list(F.struct("first", "words"))).alias("__cg_spans"))
    both = keyed.join(parts, F.col("__cg_row") == F.col("row")).withColumn("__cg_size", word_count(F.col(text_col)))

    @F.arrow_udf("string")
    def cut_text(texts: pa.Array, spans: pa.Array, sizes: pa.Array) -> pa.Array:
        import re

        word = re.compile(r"[^\x20\x09-\x0D]+")
        out = []
        for text, its, size in zip(texts, spans, sizes, strict=True):
            text, its = text.as_py(), sorted((x["first"], x["words"]) for x in its.as_py())
            if sum(n for _, n in its) == size.as_py():
                out.append(text)
                continue
            at = [m.span() for m in word.finditer(text)]
            joined: list[list[int]] = []
            for first, n in its:
                if joined and joined[-1][1] == first:
                    joined[-1][1] = first + n
                else:
                    joined.append([first, first + n])
            out.append(" ".join(text[at[a][0] : at[b - 1][1]] for a, b in joined))
        return pa.array(out, pa.string())

    mixed = both.withColumn("__cg_text", cut_text(text_col, "__cg_spans", "__cg_size"))
    new = {text_col: F.col("__cg_text")}
    if "n_chars" in docs.columns and docs.schema["n_chars"].dataType.typeName() in ("long", "integer"):
        new["n_chars"] = F.length("__cg_text").cast(docs.schema["n_chars"].dataType)
    return mixed.select(*[new[c].alias(c) if c in new else F.col(c) for c in docs.columns])
