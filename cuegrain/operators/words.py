"""Tokens to words, words to absolute time, chunk planning and stitching. Every table is keyed by recording_id."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cuegrain.functions.intervals import covered_points

TOKEN_SECONDS, LAST_LEAST, LAST_MOST = 0.20, 0.08, 0.6
LAG_SECONDS = 0.146
CHUNK_SECONDS, OVERLAP_SECONDS = 20.0, 2.0
#: A repeat may begin so much after the end of the word it repeats.
REPEAT_SLACK = 1e-6


def token_ends(tokens: DataFrame) -> DataFrame:
    """tokens (recording_id, chunk_id, duration, idx, text, start, logprob) with end and confidence.

    A token ends where the next begins, after TOKEN_SECONDS at the latest; the last one at the chunk's
    end, within bounds after its start.
    """
    order = Window.partitionBy("recording_id", "chunk_id").orderBy("idx")
    following = F.lead("start").over(order)
    last = F.least(F.greatest("duration", F.col("start") + LAST_LEAST), F.col("start") + LAST_MOST)
    end = F.when(following.isNotNull(), F.least(following, F.col("start") + TOKEN_SECONDS)).otherwise(last)
    return tokens.withColumns({"end": end, "confidence": F.exp("logprob")})


def token_word_ids(tokens: DataFrame) -> DataFrame:
    """tokens with piece (text without its marker) and word_id, the running count of markers.

    A marker is one leading U+2581, or any leading white space. A marker alone ends the word before it.
    """
    bar = F.col("text").startswith("▁")
    space = F.col("text").rlike("(?U)^\\s")
    piece = F.when(bar, F.expr("substring(text, 2)")).otherwise(F.regexp_replace("text", "(?U)^\\s+", ""))
    order = Window.partitionBy("recording_id", "chunk_id").orderBy("idx")
    return tokens.withColumns({"piece": piece, "word_id": F.sum((bar | space).cast("long")).over(order)})


def tokens_to_words(tokens: DataFrame) -> DataFrame:
    """(recording_id, chunk_id, idx, text, start, end, confidence): chunk-relative words from tokens with ends.

    confidence is the mean of those that are known. Empty pieces give nothing.
    """
    kept = token_word_ids(tokens).where("piece <> ''")
    pieces = F.array_sort(F.collect_list(F.struct("idx", "piece")))
    words = kept.groupBy("recording_id", "chunk_id", "word_id").agg(
        F.array_join(F.transform(pieces, lambda p: p.piece), "").alias("text"),
        F.min_by("start", "idx").alias("start"),
        F.max_by("end", "idx").alias("end"),
        F.avg("confidence").alias("confidence"),
    )
    order = Window.partitionBy("recording_id", "chunk_id").orderBy("word_id")
    return words.select("recording_id", "chunk_id", (F.row_number().over(order) - 1).cast("long").alias("idx"), "text", "start", "end", "confidence")


def full_text(words: DataFrame, *keys: str) -> DataFrame:
    """(keys, full_text): words in order, joined by single spaces."""
    ordered = F.array_sort(F.collect_list(F.struct("idx", "text")))
    return words.groupBy(*keys).agg(F.array_join(F.transform(ordered, lambda w: w.text), " ").alias("full_text"))


def offset_words(words: DataFrame, chunks: DataFrame) -> DataFrame:
    """Chunk-relative words on the recording's time: the chunk's start is added."""
    begins = chunks.select("recording_id", "chunk_id", F.col("start").alias("chunk_start"))
    moved = words.join(begins, ["recording_id", "chunk_id"])
    return moved.withColumns({"start": F.col("start") + F.col("chunk_start"), "end": F.col("end") + F.col("chunk_start")}).drop("chunk_start")


def unlag_words(words: DataFrame, lag: float = LAG_SECONDS) -> DataFrame:
    """Times moved earlier by the recogniser's emission lag, never below zero; a lag of zero or less changes nothing."""
    if lag <= 0:
        return words
    start = F.greatest(F.lit(0.0), F.col("start") - lag)
    return words.withColumns({"start": start, "end": F.greatest(start, F.col("end") - lag)})


def order_words(words: DataFrame, *ties: str) -> DataFrame:
    """words with a new idx by (start, end); ties names the columns that keep equal times in order."""
    order = Window.partitionBy("recording_id").orderBy("start", "end", *ties)
    return words.withColumn("idx", (F.row_number().over(order) - 1).cast("long"))


def plan_chunks(spans: DataFrame, longest: float = CHUNK_SECONDS, overlap: float = OVERLAP_SECONDS) -> DataFrame:
    """(recording_id, span_id, part, start, end): spans of at most `longest` as they are, longer ones in overlapping windows."""
    if not 0 <= overlap < longest:
        raise ValueError("the overlap must be at least zero and shorter than a chunk")
    step = longest - overlap
    count = F.greatest(F.lit(0), F.ceil((F.col("end") - F.col("start") - longest) / step)).cast("long")
    parts = spans.where("end > start").select("recording_id", "span_id", "start", "end", F.explode(F.sequence(F.lit(0).cast("long"), count)).alias("part"))
    start = F.col("start") + F.col("part") * step
    end = F.when(F.col("end") - F.col("start") <= longest, F.col("end")).otherwise(F.least(start + longest, F.col("end")))
    return parts.select("recording_id", "span_id", "part", start.alias("start"), end.alias("end")).where("end > start")


def chunk_bounds(chunks: DataFrame) -> DataFrame:
    """chunks (recording_id, chunk_id, start, end) with lower and upper: where a chunk's words count.

    Between overlapping neighbours the boundary is the middle of the overlap; else there is none
    (minus and plus infinity).
    """
    order = Window.partitionBy("recording_id").orderBy("start", "chunk_id")
    before, after = F.lag("end").over(order), F.lead("start").over(order)
    lower = F.when(before > F.col("start"), (F.col("start") + before) / 2).otherwise(F.lit(float("-inf")))
    upper = F.when(after < F.col("end"), (after + F.col("end")) / 2).otherwise(F.lit(float("inf")))
    return chunks.withColumns({"lower": lower, "upper": upper, "previous_end": before, "next_start": after})


def stitch_chunks(words: DataFrame, chunks: DataFrame) -> DataFrame:
    """Absolute words of all chunks, each kept in the chunk that owns its start, in order of time.

    lower <= start < upper. Ties of (start, end) stay in order of chunk and place.
    """
    bounds = chunk_bounds(chunks).select("recording_id", "chunk_id", "lower", "upper")
    kept = words.join(bounds, ["recording_id", "chunk_id"]).where("start >= lower AND start < upper")
    return order_words(kept.drop("lower", "upper"), "chunk_id", "idx")


def overlap_windows(chunks: DataFrame) -> DataFrame:
    """(recording_id, overlap_start, overlap_end): the stretches that two neighbouring chunks share."""
    bounds = chunk_bounds(chunks).where("previous_end > start")
    return bounds.select("recording_id", F.col("start").alias("overlap_start"), F.least("previous_end", "end").alias("overlap_end"))


def words_in_overlaps(words: DataFrame, overlaps: DataFrame) -> DataFrame:
    """words that start inside an overlap, both ends included (a semi-join on recording and range)."""
    return covered_points(words, overlaps, "recording_id", "start", "overlap_start", "overlap_end", True, 60.0)


def drop_boundary_repeats(words: DataFrame, overlaps: DataFrame) -> DataFrame:
    """words without those that repeat the word kept before them inside an overlap; the longer one stays, the earlier if equal.

    A word repeats if its text is the same, case and outer space aside, and it begins no later than the
    kept word's end. Candidates form short runs, and each run is folded: what counts is the word kept
    last, which a comparison with the row before would miss.
    """
    inside = words_in_overlaps(words.select("recording_id", "idx", "start"), overlaps).select("recording_id", "idx", F.lit(True).alias("inside"))
    marked = words.join(inside, ["recording_id", "idx"], "left").withColumn("plain", F.lower(F.trim("text")))
    order = Window.partitionBy("recording_id").orderBy("idx")
    goes_on = F.coalesce(F.col("inside"), F.lit(False)) & (F.col("plain") == F.lag("plain").over(order))
    runs = marked.withColumn("run", F.sum(F.when(F.coalesce(goes_on, F.lit(False)), 0).otherwise(1)).over(order))
    rows = runs.groupBy("recording_id", "run").agg(F.array_sort(F.collect_list(F.struct("idx", "text", "start", "end"))).alias("ws"))
    fold = f"""aggregate(slice(ws, 2, greatest(size(ws) - 1, 0)), slice(ws, 1, 1), (kept, w) ->
        CASE WHEN w.start <= element_at(kept, -1).end + {REPEAT_SLACK}D
             THEN CASE WHEN w.end - w.start > element_at(kept, -1).end - element_at(kept, -1).start
                       THEN concat(slice(kept, 1, size(kept) - 1), array(w)) ELSE kept END
             ELSE concat(kept, array(w)) END)"""
    return rows.select("recording_id", F.explode(F.expr(fold)).alias("w")).select("recording_id", "w.*")
