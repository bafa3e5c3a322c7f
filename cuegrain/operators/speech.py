"""Levels, energy frames, speech and silence. Samples are cast to double before they are squared."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cuegrain.functions.intervals import covered_points
from cuegrain.functions.percentiles import exact_percentiles

FRAME_SECONDS = 0.03
PAD, MERGE_BELOW, LEAST_SPAN = 0.15, 0.30, 0.20
LEAST_RETAINED = 0.90
RATES = (8000, 11025, 16000, 22050, 24000, 32000, 44100, 48000)
RESAMPLE_LIMIT = 57_600_000
SILENCE_SECONDS, SEPARATION_DB = 0.12, 12.0


def rate_check(recordings: DataFrame) -> DataFrame:
    """recordings (rate, samples) with needs_resample and refused."""
    odd = ~F.col("rate").isin(*RATES)
    return recordings.withColumns({"needs_resample": odd, "refused": odd & (F.col("samples") > RESAMPLE_LIMIT)})


def level_profile(blocks: DataFrame) -> DataFrame:
    """(recording_id, peak, rms): over all samples; zeros for a recording without any. Blocks are reduced before they are shuffled."""
    x = F.transform("samples", lambda v: v.cast("double"))
    each = blocks.select(
        "recording_id",
        F.aggregate(x, F.lit(0.0), lambda a, v: F.greatest(a, F.abs(v))).alias("peak"),
        F.aggregate(x, F.lit(0.0), lambda a, v: a + v * v).alias("energy"),
        F.size("samples").alias("n"),
    )
    total = each.groupBy("recording_id").agg(F.max("peak").alias("peak"), F.sum("energy").alias("energy"), F.sum("n").alias("n"))
    return total.select("recording_id", "peak", F.when(F.col("n") > 0, F.sqrt(F.col("energy") / F.col("n"))).otherwise(F.lit(0.0)).alias("rms"))


def frame_rms(blocks: DataFrame, frame_length: int) -> DataFrame:
    """(recording_id, frame_idx, rms) per frame of frame_length samples; a partial last frame is dropped.

    Blocks are laid end to end by block_no; the running count is over blocks, not samples.
    """
    order = Window.partitionBy("recording_id").orderBy("block_no")
    begin = F.sum(F.size("samples")).over(order) - F.size("samples")
    placed = blocks.where(F.size("samples") > 0).select("recording_id", "samples", begin.cast("long").alias("begin"))
    # each block is reduced to a row per frame that it touches; only frames cut by the end of a block meet another's part
    first, last = F.col("begin"), F.col("begin") + F.size("samples") - 1

    def part(frame: Column) -> Column:
        lo = F.greatest(frame * frame_length, first)
        n = F.least((frame + 1) * frame_length - 1, last) - lo + 1
        inside = F.slice("samples", (lo - first + 1).cast("int"), n.cast("int"))
        energy = F.aggregate(inside, F.lit(0.0), lambda total, v: total + v.cast("double") * v.cast("double"))
        return F.struct(frame.alias("frame_idx"), energy.alias("energy"), n.alias("n"))

    touched = F.sequence(F.floor(first / frame_length).cast("long"), F.floor(last / frame_length).cast("long"))
    parts = placed.select("recording_id", F.inline(F.transform(touched, part)))
    sums = parts.groupBy("recording_id", "frame_idx").agg(F.sum("energy").alias("energy"), F.sum("n").alias("n"))
    return sums.where(F.col("n") == frame_length).select("recording_id", "frame_idx", F.sqrt(F.col("energy") / frame_length).alias("rms"))


def vad_thresholds(frames: DataFrame) -> DataFrame:
    """(recording_id, floor, speech, threshold, flat): exact percentiles; flat recordings have no speech to tell apart."""
    p = exact_percentiles(frames, "recording_id", "rms", {"floor": 0.2, "speech": 0.9})
    flat = (F.col("most") <= 0) | (F.col("speech") <= 2 * F.col("floor"))
    return p.select("recording_id", "floor", "speech", (F.col("floor") + 0.2 * (F.col("speech") - F.col("floor"))).alias("threshold"), flat.alias("flat"))


def silence_thresholds(frames: DataFrame) -> DataFrame:
    """(recording_id, level): the level below which a frame is silent, null if loud and quiet are too close or frames too few."""
    p = exact_percentiles(frames, "recording_id", "rms", {"low": 0.01, "high": 0.99})  # percentiles of levels, then decibels
    p = p.withColumns({x: 20 * F.log10(F.col(x) + 1e-9) for x in ("low", "high")})
    level = F.pow(F.lit(10.0), F.greatest(F.col("low") + 3, F.col("high") - 20) / 20)
    usable = (F.col("n") >= 4) & (F.col("most") > 0) & (F.col("high") - F.col("low") >= SEPARATION_DB)
    return p.select("recording_id", F.when(usable, level).alias("level"))


def silent_runs(frames: DataFrame, frame_seconds: float = FRAME_SECONDS, least: float = SILENCE_SECONDS) -> DataFrame:
    """(recording_id, start, end): runs of frames at or below the recording's silence level, `least` seconds or longer."""
    quiet = frames.join(silence_thresholds(frames), "recording_id").where("rms <= level")
    order = Window.partitionBy("recording_id").orderBy("frame_idx")
    runs = quiet.withColumn("run", F.col("frame_idx") - F.row_number().over(order)).groupBy("recording_id", "run").agg(F.min("frame_idx").alias("a"), F.max("frame_idx").alias("b"))
    length = (F.col("b") - F.col("a") + 1) * frame_seconds
    return runs.where(length >= least).select("recording_id", (F.col("a") * frame_seconds).alias("start"), ((F.col("b") + 1) * frame_seconds).alias("end"))


def _recordings(frames: DataFrame, frame_seconds: float) -> DataFrame:
    return frames.groupBy("recording_id").agg(((F.max("frame_idx") + 1) * frame_seconds).alias("duration"))


def detected_spans(frames: DataFrame, frame_seconds: float = FRAME_SECONDS) -> DataFrame:
    """(recording_id, start, end): runs of loud frames, padded, merged where close, short ones dropped."""
    loud = frames.join(vad_thresholds(frames).where("NOT flat"), "recording_id").where("rms > threshold")
    order = Window.partitionBy("recording_id").orderBy("frame_idx")
    runs = loud.withColumn("run", F.col("frame_idx") - F.row_number().over(order)).groupBy("recording_id", "run").agg(F.min("frame_idx").alias("a"), F.max("frame_idx").alias("b"))
    whole = _recordings(frames, frame_seconds)
    padded = runs.join(whole, "recording_id").select(
        "recording_id",
        F.greatest(F.lit(0.0), F.col("a") * frame_seconds - PAD).alias("start"),
        F.least("duration", (F.col("b") + 1) * frame_seconds + PAD).alias("end"),
    )
    by = Window.partitionBy("recording_id").orderBy("start", "end")
    apart = F.col("start") - F.lag("end").over(by) >= MERGE_BELOW
    islands = padded.withColumn("island", F.sum(F.when(F.coalesce(apart, F.lit(True)), 1).otherwise(0)).over(by))
    spans = islands.groupBy("recording_id", "island").agg(F.min("start").alias("start"), F.max("end").alias("end"))
    return spans.where(F.col("end") - F.col("start") >= LEAST_SPAN).select("recording_id", "start", "end")


def covered_frames(frames: DataFrame, spans: DataFrame, frame_seconds: float = FRAME_SECONDS) -> DataFrame:
    """frames that some span covers: from the frame of its start to the one that holds its end."""
    s = spans.select("recording_id", F.floor(F.col("start") / frame_seconds).alias("first"), F.ceil(F.col("end") / frame_seconds).alias("stop"))
    return covered_points(frames, s, "recording_id", "frame_idx", "first", "stop", False, 4096)


def energy_retained(frames: DataFrame, spans: DataFrame, frame_seconds: float = FRAME_SECONDS) -> DataFrame:
    """(recording_id, retained): the share of all energy that lies in covered frames."""
    energy = F.sum(F.col("rms") * F.col("rms"))
    total = frames.groupBy("recording_id").agg(energy.alias("total"))
    inside = covered_frames(frames, spans, frame_seconds).groupBy("recording_id").agg(energy.alias("inside"))
    return total.join(inside, "recording_id", "left").select("recording_id", F.when(F.col("total") > 0, F.coalesce("inside", F.lit(0.0)) / F.col("total")).otherwise(F.lit(1.0)).alias("retained"))


def speech_spans(frames: DataFrame, frame_seconds: float = FRAME_SECONDS) -> DataFrame:
    """(recording_id, span_id, start, end): detected spans, or the whole recording where detection found nothing or lost energy."""
    spans = detected_spans(frames, frame_seconds)
    good = energy_retained(frames, spans, frame_seconds).where(F.col("retained") >= LEAST_RETAINED).select("recording_id")
    kept = spans.join(good, "recording_id", "left_semi")
    whole = _recordings(frames, frame_seconds).join(kept.select("recording_id").distinct(), "recording_id", "left_anti")
    every = kept.unionByName(whole.select("recording_id", F.lit(0.0).alias("start"), F.col("duration").alias("end"))).where("end > 0")
    by = Window.partitionBy("recording_id").orderBy("start")
    return every.select("recording_id", (F.row_number().over(by) - 1).cast("long").alias("span_id"), "start", "end")


def diagnostics(levels: DataFrame, spans: DataFrame, chunks: DataFrame, recordings: DataFrame) -> DataFrame:
    """One row per recording: its level, format text, and how many spans and chunks it has.

    recordings: recording_id, duration, rate, channels, bits, container.
    """
    s = spans.groupBy("recording_id").agg(F.count("*").alias("speech_spans"))
    c = chunks.groupBy("recording_id").agg(F.count("*").alias("chunks"))
    text = F.format_string("%s %d Hz %d-bit %d ch", "container", "rate", "bits", "channels")
    out = recordings.join(levels, "recording_id", "left").join(s, "recording_id", "left").join(c, "recording_id", "left")
    zero = F.lit(0).cast("long")
    return out.select("recording_id", "duration", "rate", F.coalesce("peak", F.lit(0.0)).alias("peak"), F.coalesce("rms", F.lit(0.0)).alias("rms"), F.coalesce("speech_spans", zero).alias("speech_spans"), F.coalesce("chunks", zero).alias("chunks"), text.alias("source_format"))


def duration_drift(pairs: DataFrame) -> DataFrame:
    """pairs (decoded, rendered) with drifted: off by 0.25 s or 2 %, whichever is more, where rendered is known."""
    off = F.abs(F.col("decoded") - F.col("rendered")) >= F.greatest(F.lit(0.25), 0.02 * F.col("rendered"))
    return pairs.withColumn("drifted", (F.col("rendered") > 0) & off)


def header_only(files: DataFrame) -> DataFrame:
    """files (length) with empty_render: more than nothing, but no more than a header; -1 is unknown and passes."""
    return files.withColumn("empty_render", (F.col("length") > 0) & (F.col("length") <= 128))


def empty_transcript_reasons(diagnosed: DataFrame, words: DataFrame) -> DataFrame:
    """(recording_id, reason) of recordings without words. diagnosed: recording_id, peak (null if not diagnosed)."""
    without = diagnosed.join(words.select("recording_id").distinct(), "recording_id", "left_anti")
    reason = F.when(F.col("peak").isNull(), "no diagnostics").when(F.col("peak") < 0.01, "very quiet").otherwise("not recognised")
    return without.select("recording_id", reason.alias("reason"))
