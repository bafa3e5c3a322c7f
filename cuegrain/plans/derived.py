"""Inputs that the registered queries derive from the driver's tables, for Spark and as SQL for the oracle.

Times are whole milliseconds until the last step, so that both engines hold the same doubles.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _turn_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    split = F.filter(F.split("text", "[ \t\r\n]+"), lambda x: x != "")
    return table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("recording_id"), "turn", split.alias("ws"))


#: Bytes of spoken text for one task. It bounds what a task holds; tasks, not their size, grow with the tables.
TASK_BYTES = 1_000_000


def word_tasks(spark: SparkSession, sf_dir: str) -> int:
    """Tasks that the recordings of the words are dealt to."""
    spoken = table(spark, sf_dir, "conversations").agg(F.sum(F.octet_length("text"))).first()[0] or 0
    return max(spark.sparkContext.defaultParallelism, math.ceil(spoken / TASK_BYTES))


def timed_words(spark: SparkSession, sf_dir: str, tasks: int | None = None) -> DataFrame:
    """words with the turn they are from: recording_id, turn, idx, text, start_ms, end_ms; in so many tasks, else in word_tasks, by recording."""
    turns = _turn_words(spark, sf_dir).repartition(tasks or word_tasks(spark, sf_dir), "recording_id")
    w = turns.select("recording_id", "turn", F.size("ws").alias("n"), F.posexplode("ws").alias("pos", "text"))
    last = F.col("pos") == F.col("n") - 1
    gap = F.when(last, 1500).when(F.col("text").rlike("[.!?]\\z"), 650).when(F.col("text").rlike("[,;:]\\z"), 280).when(F.length("text") % 7 == 0, 400).otherwise(40)
    w = w.withColumns({"dur": (80 + 25 * F.length("text")).cast("long"), "gap": gap.cast("long")})
    by = Window.partitionBy("recording_id").orderBy("turn", "pos")
    end = F.sum(F.col("dur") + F.col("gap")).over(by) - F.col("gap")
    w = w.withColumns({"end_ms": end, "idx": (F.row_number().over(by) - 1).cast("long")})
    return w.select("recording_id", "turn", "idx", "text", (F.col("end_ms") - F.col("dur")).alias("start_ms"), "end_ms")


TIMED_WORDS = """
tw_pieces AS (SELECT conv_id AS recording_id, turn, list_filter(string_split_regex(text, '[ \\t\\r\\n]+'), lambda x: x <> '') AS ws FROM conversations),
tw_each AS (SELECT recording_id, turn, i AS pos, ws[i] AS text, i = len(ws) AS last FROM tw_pieces, unnest(range(1, len(ws) + 1)) AS u(i)),
tw_gaps AS (SELECT *, 80 + 25 * length(text) AS dur,
    CASE WHEN last THEN 1500 WHEN regexp_matches(text, '[.!?]$') THEN 650 WHEN regexp_matches(text, '[,;:]$') THEN 280
         WHEN length(text) % 7 = 0 THEN 400 ELSE 40 END AS gap FROM tw_each),
timed_words AS (SELECT recording_id, turn, CAST(row_number() OVER p - 1 AS BIGINT) AS idx, text,
    CAST((sum(dur + gap) OVER p) - gap - dur AS BIGINT) AS start_ms, CAST((sum(dur + gap) OVER p) - gap AS BIGINT) AS end_ms
    FROM tw_gaps WINDOW p AS (PARTITION BY recording_id ORDER BY turn, pos))
"""


def words(spark: SparkSession, sf_dir: str, tasks: int | None = None) -> DataFrame:
    """recording_id, idx, text, start, end (seconds)."""
    return timed_words(spark, sf_dir, tasks).select("recording_id", "idx", "text", (F.col("start_ms") / 1000.0).alias("start"), (F.col("end_ms") / 1000.0).alias("end"))


WORDS = TIMED_WORDS + """,
words AS (SELECT recording_id, idx, text, start_ms::DOUBLE / 1000.0::DOUBLE AS start, end_ms::DOUBLE / 1000.0::DOUBLE AS "end" FROM timed_words)
"""


def asr_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One recogniser result per turn: recording_id, chunk_id, duration, text, tokens, timestamps, logprobs.

    Words are cut into pieces of four letters, the first marked; each third turn lacks its last
    timestamp, each fourth its logprobs, each eleventh its tokens.
    """
    piece = "flatten(transform(ws, w -> transform(sequence(0, CAST(ceil(length(w) / 4.0) AS INT) - 1), k -> concat(CASE WHEN k = 0 THEN '▁' ELSE '' END, substring(w, 4 * k + 1, 4)))))"
    t = _turn_words(spark, sf_dir).selectExpr("recording_id", "turn AS chunk_id", "ws", f"{piece} AS tokens")
    return t.selectExpr(
        "recording_id",
        "chunk_id",
        "size(tokens) * 0.09 + 0.3 AS duration",
        "array_join(ws, ' ') AS text",
        "CASE WHEN (recording_id + chunk_id) % 11 = 10 THEN CAST(array() AS array<string>) ELSE tokens END AS tokens",
        "transform(sequence(1, size(tokens) - CASE WHEN chunk_id % 3 = 2 THEN 1 ELSE 0 END), i -> CAST(i * 90 + i % 4 * 40 AS DOUBLE) / 1000.0D) AS timestamps",
        "CASE WHEN chunk_id % 4 = 3 THEN NULL ELSE transform(tokens, t -> CAST(length(t) AS DOUBLE) / -8.0D) END AS logprobs",
    )


ASR_RESULTS = """
ar_pieces AS (SELECT conv_id AS recording_id, turn AS chunk_id, list_filter(string_split_regex(text, '[ \\t\\r\\n]+'), lambda x: x <> '') AS ws FROM conversations),
ar_tokens AS (SELECT *, flatten(list_transform(ws, lambda w: list_transform(range(0, CAST(ceil(length(w) / 4.0) AS BIGINT)), lambda k: (CASE WHEN k = 0 THEN '▁' ELSE '' END) || substring(w, 4 * k + 1, 4)))) AS toks FROM ar_pieces),
asr_results AS (SELECT recording_id, chunk_id, CAST(len(toks) * 0.09 + 0.3 AS DOUBLE) AS duration, array_to_string(ws, ' ') AS text,
    CASE WHEN (recording_id + chunk_id) % 11 = 10 THEN [] ELSE toks END AS tokens,
    list_transform(range(1, len(toks) - (CASE WHEN chunk_id % 3 = 2 THEN 1 ELSE 0 END) + 1), lambda i: CAST(i * 90 + i % 4 * 40 AS DOUBLE) / 1000.0::DOUBLE) AS timestamps,
    CASE WHEN chunk_id % 4 = 3 THEN NULL ELSE list_transform(toks, lambda t: CAST(length(t) AS DOUBLE) / -8.0::DOUBLE) END AS logprobs FROM ar_tokens)
"""


def turn_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """recording_id, span_id (turn), start, end: where each turn is spoken."""
    return timed_words(spark, sf_dir).groupBy("recording_id", F.col("turn").alias("span_id")).agg((F.min("start_ms") / 1000.0).alias("start"), (F.max("end_ms") / 1000.0).alias("end"))


TURN_SPANS = TIMED_WORDS + """,
turn_spans AS (SELECT recording_id, turn AS span_id, min(start_ms)::DOUBLE / 1000.0::DOUBLE AS start, max(end_ms)::DOUBLE / 1000.0::DOUBLE AS "end" FROM timed_words GROUP BY ALL)
"""


def pcm_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """recording_id, block_no, sample_rate, samples."""
    return table(spark, sf_dir, "embeddings").select(F.col("label").cast("long").alias("recording_id"), F.col("vec_id").alias("block_no"), F.lit(16000).alias("sample_rate"), F.col("embedding").alias("samples"))


PCM = """
pcm_blocks AS (SELECT label::BIGINT AS recording_id, vec_id AS block_no, 16000 AS sample_rate, embedding AS samples FROM embeddings)
"""


def frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """recording_id, frame_idx, rms: frames of 0.03 s."""
    by = Window.partitionBy("user_id").orderBy("ts", "event_id")
    return table(spark, sf_dir, "events").select(F.col("user_id").alias("recording_id"), (F.row_number().over(by) - 1).cast("long").alias("frame_idx"), (F.abs("value") / 1000.0).alias("rms"))


FRAMES = """
frames AS (SELECT user_id AS recording_id, CAST(row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS BIGINT) AS frame_idx, abs(value) / 1000.0::DOUBLE AS rms FROM events)
"""


def timelines(spark: SparkSession, sf_dir: str, of: str = "customer") -> DataFrame:
    """comp_id, width, height, frame_rate, frame_duration, duration, work_start, work_duration: a timeline for each customer, or each nation."""
    key = KEYS[of]
    return table(spark, sf_dir, of).selectExpr(
        f"CAST({key} AS BIGINT) AS comp_id",
        f"element_at(array(1920, 1080, 1080, 0), CAST({key} % 4 AS INT) + 1) AS width",
        f"element_at(array(1080, 1920, 1080, 0), CAST({key} % 4 AS INT) + 1) AS height",
        f"element_at(array(30.0D, 25.0D, 24.0D, 30.0D), CAST({key} % 4 AS INT) + 1) AS frame_rate",
        "60.0D AS duration",
        f"CAST({key} % 25 AS DOUBLE) AS work_start",
        f"CASE WHEN {key} % 5 = 0 THEN 0.0D ELSE 20.0D END AS work_duration",
    ).withColumn("frame_duration", F.expr("1.0D / frame_rate"))


KEYS = {"customer": "c_custkey", "nation": "n_nationkey"}


def timelines_sql(of: str) -> str:
    key = KEYS[of]
    return f"""
timelines AS (SELECT CAST({key} AS BIGINT) AS comp_id, ([1920, 1080, 1080, 0])[{key} % 4 + 1] AS width, ([1080, 1920, 1080, 0])[{key} % 4 + 1] AS height,
    CAST(([30.0, 25.0, 24.0, 30.0])[{key} % 4 + 1] AS DOUBLE) AS frame_rate, 60.0::DOUBLE AS duration, CAST({key} % 25 AS DOUBLE) AS work_start,
    CASE WHEN {key} % 5 = 0 THEN 0.0::DOUBLE ELSE 20.0::DOUBLE END AS work_duration, 1.0::DOUBLE / CAST(([30.0, 25.0, 24.0, 30.0])[{key} % 4 + 1] AS DOUBLE) AS frame_duration FROM {of})
"""


TIMELINES, NATION_TIMELINES = timelines_sql("customer"), timelines_sql("nation")


def layers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """comp_id, layer_id, name, tag, has_audio, enabled, solo, selected, start, end, source_comp_id, start_time, text."""
    o = table(spark, sf_dir, "orders")
    return o.selectExpr(
        "CAST(o_custkey AS BIGINT) AS comp_id",
        "CAST(o_orderkey AS BIGINT) AS layer_id",
        "concat('layer ', o_orderkey) AS name",
        "CASE WHEN o_orderkey % 3 = 0 THEN 'caption' END AS tag",
        "o_orderkey % 4 = 0 AS has_audio",
        "o_orderkey % 5 <> 0 AS enabled",
        "o_orderkey % 97 = 0 AS solo",
        "o_orderkey % 31 = 0 AS selected",
        "CAST((o_orderkey * 37) % 60000 AS DOUBLE) / 1000.0D AS start",
        "CAST((o_orderkey * 37) % 60000 + 200 + o_orderkey % 3000 AS DOUBLE) / 1000.0D AS end",
        "CASE WHEN o_orderkey % 50 = 0 AND o_custkey % 25 < 24 THEN CAST(o_custkey + 1 AS BIGINT) END AS source_comp_id",
        "CAST(o_orderkey % 700 AS DOUBLE) / 100.0D AS start_time",
        "CASE WHEN o_orderkey % 17 = 0 THEN '  ' ELSE concat('caption ', o_orderpriority, chr(10), ' of ', o_orderkey) END AS text",
    )


LAYERS = """
layers AS (SELECT CAST(o_custkey AS BIGINT) AS comp_id, CAST(o_orderkey AS BIGINT) AS layer_id, 'layer ' || o_orderkey AS name,
    CASE WHEN o_orderkey % 3 = 0 THEN 'caption' END AS tag, o_orderkey % 4 = 0 AS has_audio, o_orderkey % 5 <> 0 AS enabled,
    o_orderkey % 97 = 0 AS solo, o_orderkey % 31 = 0 AS selected, CAST((o_orderkey * 37) % 60000 AS DOUBLE) / 1000.0::DOUBLE AS start,
    CAST((o_orderkey * 37) % 60000 + 200 + o_orderkey % 3000 AS DOUBLE) / 1000.0::DOUBLE AS "end",
    CASE WHEN o_orderkey % 50 = 0 AND o_custkey % 25 < 24 THEN CAST(o_custkey + 1 AS BIGINT) END AS source_comp_id,
    CAST(o_orderkey % 700 AS DOUBLE) / 100.0::DOUBLE AS start_time,
    CASE WHEN o_orderkey % 17 = 0 THEN '  ' ELSE 'caption ' || o_orderpriority || chr(10) || ' of ' || o_orderkey END AS text FROM orders)
"""
