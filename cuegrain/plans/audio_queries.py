"""Registered queries on alignment, audio decoding, the recogniser hook and live captions."""

from __future__ import annotations

import struct

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cuegrain.operators import align, recognise
from cuegrain.operators import words as W
from cuegrain.plans import derived as d
from cuegrain.sources import pcm
from cuegrain.streaming import live

QUERIES, SQL = {}, {}


def query(name: str, sql: str | None = None):
    def add(run):
        QUERIES[name] = run
        if sql:
            SQL[name] = sql
        return run

    return add


def r6(*names: str) -> list:
    return [F.round(n, 6).alias(n) for n in names]


def energy(spark, sf, tasks: int) -> DataFrame:
    """Frames of 10 ms for the derived words, dealt to so many tasks by recording: loud inside a word, quiet between words."""
    by = Window.partitionBy("recording_id").orderBy("idx")
    first = F.floor(F.col("start_ms") / 10)
    w = d.timed_words(spark, sf, tasks).select("recording_id", "idx", first.alias("a"), F.floor(F.col("end_ms") / 10).alias("b"))
    w = w.withColumns({"from_": F.when(F.lag("a").over(by).isNull(), 0).otherwise(F.col("a")), "to_": F.coalesce(F.lead("a").over(by) - 1, "b")})
    loud = F.col("frame_idx").between(F.col("a") + 2, F.greatest(F.col("a") + 2, F.col("b") - 6))
    return w.where("to_ >= from_").select("*", F.explode(F.sequence("from_", "to_")).alias("frame_idx")).select("recording_id", "frame_idx", F.when(loud, 0.2).otherwise(0.0005).alias("rms"))


@query("align_to_audio")
def _(spark, sf):
    tasks = d.word_tasks(spark, sf)
    # a word is some 28 frames
    return align.align_to_audio(d.words(spark, sf, tasks), energy(spark, sf, 8 * tasks)).select("recording_id", "idx", "text", *r6("start", "end"))


#: Block numbers that one WAV file covers, so that files and rows stay small however long a recording is.
BLOCKS_PER_FILE = 4096


def _wav_files(spark, sf, blocks: int = BLOCKS_PER_FILE) -> DataFrame:
    """16-bit WAVs of each recording's sample blocks, recording/part; recording 3's are cut to the header and 7's are none."""

    def build(batches):
        for batch in batches:
            rows = []
            for label, part, found in zip(batch["recording_id"], batch["part"], batch["blocks"], strict=True):
                x = (np.clip(np.concatenate([np.asarray(b["samples"], np.float64) for b in found]), -0.999, 0.999) * 32768).astype("<i2").tobytes()
                head = b"RIFF" + struct.pack("<I", 36 + len(x)) + b"WAVEfmt " + struct.pack("<IHHIIHH", 16, 1, 1, 16000, 32000, 2, 16)
                data = head + b"data" + struct.pack("<I", len(x)) + x
                rows.append((f"{label}/{part}", data[:30] if label == 3 else b"OggS" + data if label == 7 else data))
            yield pd.DataFrame(rows, columns=["path", "content"])

    part = F.floor(F.col("block_no") / blocks).alias("part")
    grouped = d.pcm_blocks(spark, sf).groupBy("recording_id", part).agg(F.array_sort(F.collect_list(F.struct("block_no", "samples"))).alias("blocks"))
    return grouped.mapInPandas(build, "path string, content binary")


def _decoded(spark, sf, blocks: int = BLOCKS_PER_FILE) -> DataFrame:
    """The decoded files under the names of their recordings."""
    return pcm.decode_audio(_wav_files(spark, sf, blocks), 1000).withColumn("recording", F.substring_index("recording", "/", 1))


@query("ingest_pcm", f"""WITH {d.PCM} SELECT CAST(recording_id AS VARCHAR) AS recording, 'WAV' AS container, 16000 AS rate, 1 AS channels, 16 AS bits, CAST(sum(len(samples)) AS BIGINT) AS samples, round(sum(len(samples)) / 16000.0::DOUBLE, 6) AS duration FROM pcm_blocks WHERE recording_id NOT IN (3, 7) GROUP BY 1""")
def _(spark, sf):
    return pcm.recordings(_decoded(spark, sf)).select("recording", "container", "rate", "channels", "bits", "samples", *r6("duration"))


@query("ingest_errors", "SELECT CAST(label AS VARCHAR) AS recording, CASE WHEN label = 3 THEN 'no format or no samples' ELSE 'neither WAV nor AIFF' END AS error FROM embeddings WHERE label IN (3, 7) GROUP BY label")
def _(spark, sf):
    return _decoded(spark, sf).where("error IS NOT NULL").select("recording", "error").distinct()


@query("recogniser_hook", f"""WITH {d.TURN_SPANS}, parts AS (SELECT recording_id, span_id, start, "end", unnest(range(0, CAST(greatest(0, ceil(("end" - start - 20.0::DOUBLE) / 18.0::DOUBLE)) AS BIGINT) + 1)) AS part FROM turn_spans WHERE "end" > start),
 ch AS (SELECT recording_id, span_id * 1000 + part AS chunk_id, start + part * 18.0::DOUBLE AS start, CASE WHEN "end" - start <= 20.0::DOUBLE THEN "end" ELSE least(start + part * 18.0::DOUBLE + 20.0::DOUBLE, "end") END AS "end" FROM parts)
 SELECT recording_id, chunk_id, k AS idx, 'word' || k AS text, round(start + k, 6) AS start FROM ch, unnest(range(0, CAST(floor("end" - start) AS BIGINT))) AS u(k) WHERE "end" > start""")
def _(spark, sf):
    planned = W.plan_chunks(d.turn_spans(spark, sf))
    chunks = planned.select("recording_id", (F.col("span_id") * 1000 + F.col("part")).alias("chunk_id"), "start", "end")
    words = W.tokens_to_words(recognise.recognise(chunks, recognise.one_word_a_second))
    return W.offset_words(words, chunks).select("recording_id", "chunk_id", "idx", "text", *r6("start"))


@query("live_captions", f"""WITH {d.TIMED_WORDS}, br AS (SELECT *, CASE WHEN start_ms - lag(start_ms) OVER (PARTITION BY recording_id ORDER BY start_ms) < 1000 THEN 0 ELSE 1 END AS b FROM timed_words),
 ss AS (SELECT *, sum(b) OVER (PARTITION BY recording_id ORDER BY start_ms) AS s FROM br)
 SELECT recording_id, string_agg(text, ' ' ORDER BY start_ms) AS text, count(*) AS n_words FROM ss GROUP BY recording_id, s""")
def _(spark, sf):
    words = d.timed_words(spark, sf).select("recording_id", F.timestamp_millis("start_ms").alias("at"), "text")
    return live.caption_sessions(words).select("recording_id", "text", "n_words")
