"""Recogniser results, parallel arrays, to token rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A result with text must come with tokens and times.
TEXT_WITHOUT_TOKENS = "text without tokens or timestamps"


def result_tokens(results: DataFrame) -> DataFrame:
    """(recording_id, chunk_id, duration, idx, text, start, logprob): arrays paired up to the shorter of tokens and timestamps."""
    n = F.least(F.coalesce(F.size("tokens"), F.lit(0)), F.coalesce(F.size("timestamps"), F.lit(0)))
    pairs = F.arrays_zip(F.slice("tokens", 1, n).alias("text"), F.slice("timestamps", 1, n).alias("start"))
    rows = results.where(n > 0).select("recording_id", "chunk_id", "duration", "logprobs", F.posexplode(pairs).alias("idx", "pair"))
    logprob = F.get("logprobs", F.col("idx"))
    return rows.select("recording_id", "chunk_id", "duration", F.col("idx").cast("long").alias("idx"), "pair.text", "pair.start", logprob.alias("logprob"))


def result_errors(results: DataFrame) -> DataFrame:
    """(recording_id, chunk_id, error): results that hold text but nothing to time it with; truly empty ones are no error."""
    bare = (F.coalesce(F.size("tokens"), F.lit(0)) < 1) | (F.coalesce(F.size("timestamps"), F.lit(0)) < 1)
    has_text = F.trim(F.coalesce("text", F.lit(""))) != ""
    return results.where(bare & has_text).select("recording_id", "chunk_id", F.lit(TEXT_WITHOUT_TOKENS).alias("error"))
