"""Live captions: a stream of timed words to captions at pauses, with a watermark for late words."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def caption_sessions(words: DataFrame, pause: str = "1 second", late: str = "10 seconds") -> DataFrame:
    """(recording_id, start, end, text, n_words): words (recording_id, at, text) that follow within a pause are a caption.

    Works on a stream, in append mode, and on a table. Words of one time are in order of their texts; words
    later than the watermark are not waited for.
    """
    timed = words.withWatermark("at", late)
    grouped = timed.groupBy("recording_id", F.session_window("at", pause).alias("w"))
    ordered = F.array_sort(F.collect_list(F.struct("at", "text")))
    return grouped.agg(F.array_join(F.transform(ordered, lambda x: x.text), " ").alias("text"), F.count("*").alias("n_words"), F.min("at").alias("start"), F.max("at").alias("end")).select("recording_id", "start", "end", "text", "n_words")


def speech_activity(frames: DataFrame, level: float, window: str = "10 seconds", late: str = "30 seconds") -> DataFrame:
    """(recording_id, start, frames, loud): how many frames of each window are above a level. frames: recording_id, at, rms."""
    timed = frames.withWatermark("at", late)
    return timed.groupBy("recording_id", F.window("at", window).alias("w")).agg(F.count("*").alias("frames"), F.count_if(F.col("rms") > level).alias("loud")).select("recording_id", F.col("w.start").alias("start"), "frames", "loud")
