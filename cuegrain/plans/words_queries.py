"""Registered queries on tokens, words, chunks, levels and speech, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cuegrain.functions import scalars as S
from cuegrain.operators import speech, words
from cuegrain.plans import derived as d
from cuegrain.sources import asr

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


TOKENS = f"""WITH {d.ASR_RESULTS},
tok AS (SELECT recording_id, chunk_id, duration, i - 1 AS idx, tokens[i] AS text, timestamps[i] AS start, logprobs[i] AS logprob
    FROM asr_results, unnest(range(1, least(len(tokens), len(timestamps)) + 1)) AS u(i)),
ends AS (SELECT *, CASE WHEN lead(start) OVER p IS NOT NULL THEN least(lead(start) OVER p, start + 0.2::DOUBLE)
    ELSE least(greatest(duration, start + 0.08::DOUBLE), start + 0.6::DOUBLE) END AS "end", exp(logprob) AS confidence
    FROM tok WINDOW p AS (PARTITION BY recording_id, chunk_id ORDER BY idx)),
ids AS (SELECT *, CASE WHEN starts_with(text, '▁') THEN substring(text, 2) ELSE ltrim(text) END AS piece,
    CAST(sum(CASE WHEN starts_with(text, '▁') OR text <> ltrim(text) THEN 1 ELSE 0 END) OVER (PARTITION BY recording_id, chunk_id ORDER BY idx) AS BIGINT) AS word_id FROM ends),
grouped AS (SELECT recording_id, chunk_id, word_id, string_agg(piece, '' ORDER BY idx) AS text, min_by(start, idx) AS start, max_by("end", idx) AS "end", avg(confidence) AS confidence
    FROM ids WHERE piece <> '' GROUP BY ALL),
chunk_words AS (SELECT recording_id, chunk_id, row_number() OVER (PARTITION BY recording_id, chunk_id ORDER BY word_id) - 1 AS idx, text, start, "end", confidence FROM grouped)
"""


def _tokens(spark, sf) -> DataFrame:
    return words.token_ends(asr.result_tokens(d.asr_results(spark, sf)))


@query("asr_result_scan", TOKENS + "SELECT recording_id, chunk_id, idx, text, round(start, 6) AS start, round(logprob, 6) AS logprob FROM tok")
def _(spark, sf):
    return asr.result_tokens(d.asr_results(spark, sf)).select("recording_id", "chunk_id", "idx", "text", *r6("start", "logprob"))


@query("asr_result_errors", f"WITH {d.ASR_RESULTS} SELECT recording_id, chunk_id, '{asr.TEXT_WITHOUT_TOKENS}' AS error FROM asr_results WHERE (len(tokens) = 0 OR len(timestamps) = 0) AND trim(text) <> ''")
def _(spark, sf):
    return asr.result_errors(d.asr_results(spark, sf))


@query("token_end", TOKENS + 'SELECT recording_id, chunk_id, idx, round("end", 6) AS "end", round(confidence, 6) AS confidence FROM ends')
def _(spark, sf):
    return _tokens(spark, sf).select("recording_id", "chunk_id", "idx", *r6("end", "confidence"))


@query("token_word_id", TOKENS + "SELECT recording_id, chunk_id, idx, piece, word_id FROM ids")
def _(spark, sf):
    return words.token_word_ids(_tokens(spark, sf)).select("recording_id", "chunk_id", "idx", "piece", "word_id")


@query("tokens_to_words", TOKENS + 'SELECT recording_id, chunk_id, idx, text, round(start, 6) AS start, round("end", 6) AS "end", round(confidence, 6) AS confidence FROM chunk_words')
def _(spark, sf):
    return words.tokens_to_words(_tokens(spark, sf)).select("recording_id", "chunk_id", "idx", "text", *r6("start", "end", "confidence"))


@query("full_text", TOKENS + "SELECT recording_id, chunk_id, string_agg(text, ' ' ORDER BY idx) AS full_text FROM chunk_words GROUP BY ALL")
def _(spark, sf):
    return words.full_text(words.tokens_to_words(_tokens(spark, sf)), "recording_id", "chunk_id")


SPANS = f"WITH {d.TURN_SPANS}"
CHUNKED = SPANS + """,
parts AS (SELECT recording_id, span_id, start, "end", unnest(range(0, CAST(greatest(0, ceil(("end" - start - 20.0::DOUBLE) / 18.0::DOUBLE)) AS BIGINT) + 1)) AS part FROM turn_spans WHERE "end" > start),
planned AS (SELECT recording_id, span_id, part, start + part * 18.0::DOUBLE AS start, CASE WHEN "end" - start <= 20.0::DOUBLE THEN "end" ELSE least(start + part * 18.0::DOUBLE + 20.0::DOUBLE, "end") END AS "end" FROM parts),
chunks AS (SELECT recording_id, span_id * 1000 + part AS chunk_id, start, "end" FROM planned WHERE "end" > start),
neighbours AS (SELECT *, lag("end") OVER p AS previous_end, lead(start) OVER p AS next_start FROM chunks WINDOW p AS (PARTITION BY recording_id ORDER BY start, chunk_id)),
bounds AS (SELECT *, CASE WHEN previous_end > start THEN (start + previous_end) / 2 ELSE '-infinity'::DOUBLE END AS lower,
    CASE WHEN next_start < "end" THEN (next_start + "end") / 2 ELSE 'infinity'::DOUBLE END AS upper FROM neighbours),
shared_parts AS (SELECT recording_id, start AS overlap_start, least(previous_end, "end") AS overlap_end FROM bounds WHERE previous_end > start),
words AS (SELECT recording_id, idx, text, start_ms::DOUBLE / 1000.0::DOUBLE AS start, end_ms::DOUBLE / 1000.0::DOUBLE AS "end" FROM timed_words),
heard AS (SELECT c.recording_id, c.chunk_id, w.idx, w.text, w.start + (CASE WHEN c.chunk_id % 1000 % 2 = 1 THEN 0.01::DOUBLE ELSE 0.0::DOUBLE END) AS start,
    w."end" + (CASE WHEN c.chunk_id % 1000 % 2 = 1 THEN 0.03::DOUBLE ELSE 0.0::DOUBLE END) AS "end" FROM chunks c JOIN words w ON c.recording_id = w.recording_id AND w.start >= c.start AND w.start < c."end"),
stitched AS (SELECT h.recording_id, h.chunk_id, row_number() OVER (PARTITION BY h.recording_id ORDER BY h.start, h."end", h.chunk_id, h.idx) - 1 AS idx, h.text, h.start, h."end"
    FROM heard h JOIN bounds b ON h.recording_id = b.recording_id AND h.chunk_id = b.chunk_id WHERE h.start >= b.lower AND h.start < b.upper)
"""


def _chunks(spark, sf) -> DataFrame:
    planned = words.plan_chunks(d.turn_spans(spark, sf))
    return planned.select("recording_id", (F.col("span_id") * 1000 + F.col("part")).alias("chunk_id"), "start", "end")


def _heard(spark, sf) -> DataFrame:
    """Words as each chunk's recogniser would hear them; odd chunks hear them a little late."""
    c = _chunks(spark, sf).withColumnsRenamed({"start": "c_start", "end": "c_end"})
    late = F.col("chunk_id") % 1000 % 2 == 1
    both = d.words(spark, sf).join(c, "recording_id").where("start >= c_start AND start < c_end")
    return both.select("recording_id", "chunk_id", "idx", "text", (F.col("start") + F.when(late, 0.01).otherwise(0.0)).alias("start"), (F.col("end") + F.when(late, 0.03).otherwise(0.0)).alias("end"))


@query("plan_chunks", CHUNKED + 'SELECT recording_id, chunk_id, round(start, 6) AS start, round("end", 6) AS "end" FROM chunks')
def _(spark, sf):
    return _chunks(spark, sf).select("recording_id", "chunk_id", *r6("start", "end"))


@query("chunk_midpoints", CHUNKED + "SELECT recording_id, chunk_id, round(lower, 6) AS lower, round(upper, 6) AS upper FROM bounds")
def _(spark, sf):
    return words.chunk_bounds(_chunks(spark, sf)).select("recording_id", "chunk_id", *r6("lower", "upper"))


@query("chunk_word_join", CHUNKED + 'SELECT recording_id, idx, text, round(start, 6) AS start, round("end", 6) AS "end" FROM stitched')
def _(spark, sf):
    return words.stitch_chunks(_heard(spark, sf), _chunks(spark, sf)).select("recording_id", "idx", "text", *r6("start", "end"))


@query("inside_overlap", CHUNKED + "SELECT recording_id, idx, text FROM words w WHERE EXISTS (SELECT 1 FROM shared_parts o WHERE o.recording_id = w.recording_id AND w.start BETWEEN o.overlap_start AND o.overlap_end)")
def _(spark, sf):
    return words.words_in_overlaps(d.words(spark, sf), words.overlap_windows(_chunks(spark, sf))).select("recording_id", "idx", "text")


REPEATS = CHUNKED.replace("WITH ", "WITH RECURSIVE ", 1) + """,
hw AS (SELECT recording_id, row_number() OVER (PARTITION BY recording_id ORDER BY start, "end", chunk_id, idx) - 1 AS idx, text, start, "end" FROM heard),
hm AS (SELECT *, lower(trim(text)) AS plain, EXISTS (SELECT 1 FROM shared_parts o WHERE o.recording_id = hw.recording_id AND hw.start BETWEEN o.overlap_start AND o.overlap_end) AS inside FROM hw),
ho AS (SELECT *, inside AND coalesce(plain = lag(plain) OVER (PARTITION BY recording_id ORDER BY idx), false) AS goes_on FROM hm),
fold AS (SELECT recording_id, idx, [idx] AS kept, start AS ks, "end" AS ke FROM ho WHERE idx = 0
 UNION ALL SELECT h.recording_id, h.idx,
    CASE WHEN NOT goes_on OR h.start > ke + 1e-6 THEN list_append(kept, h.idx) WHEN h."end" - h.start > ke - ks THEN list_append(kept[:-2], h.idx) ELSE kept END,
    CASE WHEN NOT goes_on OR h.start > ke + 1e-6 OR h."end" - h.start > ke - ks THEN h.start ELSE ks END,
    CASE WHEN NOT goes_on OR h.start > ke + 1e-6 OR h."end" - h.start > ke - ks THEN h."end" ELSE ke END
    FROM fold f JOIN ho h ON h.recording_id = f.recording_id AND h.idx = f.idx + 1),
stay AS (SELECT recording_id, unnest(arg_max(kept, idx)) AS idx FROM fold GROUP BY 1)
"""


@query("boundary_repeats", REPEATS + 'SELECT recording_id, idx, text, round(start, 6) AS start, round("end", 6) AS "end" FROM ho JOIN stay USING (recording_id, idx)')
def _(spark, sf):
    heard = words.order_words(_heard(spark, sf), "chunk_id", "idx").drop("chunk_id")
    return words.drop_boundary_repeats(heard, words.overlap_windows(_chunks(spark, sf))).select("recording_id", "idx", "text", *r6("start", "end"))


@query("offset_words", TOKENS + ', begins AS (SELECT recording_id, chunk_id, chunk_id * 12.5::DOUBLE AS begin FROM asr_results) SELECT recording_id, chunk_id, idx, text, round(start + begin, 6) AS start, round("end" + begin, 6) AS "end" FROM chunk_words JOIN begins USING (recording_id, chunk_id)')
def _(spark, sf):
    begins = d.asr_results(spark, sf).select("recording_id", "chunk_id", (F.col("chunk_id") * 12.5).alias("start"))
    return words.offset_words(words.tokens_to_words(_tokens(spark, sf)), begins).select("recording_id", "chunk_id", "idx", "text", *r6("start", "end"))


WORDS = f"WITH {d.WORDS}"


@query("unlag_words", WORDS + 'SELECT recording_id, idx, round(greatest(0.0::DOUBLE, start - 0.146::DOUBLE), 6) AS start, round(greatest(greatest(0.0::DOUBLE, start - 0.146::DOUBLE), "end" - 0.146::DOUBLE), 6) AS "end" FROM words')
def _(spark, sf):
    return words.unlag_words(d.words(spark, sf)).select("recording_id", "idx", *r6("start", "end"))


@query("order_words", CHUNKED + 'SELECT recording_id, chunk_id, row_number() OVER (PARTITION BY recording_id ORDER BY start, "end", chunk_id, idx) - 1 AS idx, text FROM heard')
def _(spark, sf):
    return words.order_words(_heard(spark, sf), "chunk_id", F.col("idx")).select("recording_id", "chunk_id", "idx", "text")


FRAMES = f"""WITH {d.FRAMES},
th AS (SELECT *, floor + 0.2::DOUBLE * (speech - floor) AS threshold, most <= 0 OR speech <= 2 * floor AS flat FROM
    (SELECT recording_id, quantile_cont(rms, 0.2) AS floor, quantile_cont(rms, 0.9) AS speech, max(rms) AS most FROM frames GROUP BY 1)),
whole AS (SELECT recording_id, (max(frame_idx) + 1) * 0.03::DOUBLE AS duration FROM frames GROUP BY 1),
loud AS (SELECT f.recording_id, frame_idx, frame_idx - row_number() OVER (PARTITION BY f.recording_id ORDER BY frame_idx) AS run FROM frames f JOIN th USING (recording_id) WHERE NOT flat AND rms > threshold),
runs AS (SELECT recording_id, run, min(frame_idx) AS a, max(frame_idx) AS b FROM loud GROUP BY 1, 2),
padded AS (SELECT recording_id, greatest(0.0::DOUBLE, a * 0.03::DOUBLE - 0.15::DOUBLE) AS start, least(duration, (b + 1) * 0.03::DOUBLE + 0.15::DOUBLE) AS "end" FROM runs JOIN whole USING (recording_id)),
flagged AS (SELECT *, CASE WHEN coalesce(start - lag("end") OVER (PARTITION BY recording_id ORDER BY start, "end") >= 0.3::DOUBLE, true) THEN 1 ELSE 0 END AS apart FROM padded),
islands AS (SELECT *, sum(apart) OVER (PARTITION BY recording_id ORDER BY start, "end") AS island FROM flagged),
detected AS (SELECT recording_id, min(start) AS start, max("end") AS "end" FROM islands GROUP BY recording_id, island HAVING max("end") - min(start) >= 0.2::DOUBLE),
covered AS (SELECT * FROM frames f WHERE EXISTS (SELECT 1 FROM detected s WHERE s.recording_id = f.recording_id AND frame_idx >= floor(s.start / 0.03::DOUBLE) AND frame_idx < ceil(s."end" / 0.03::DOUBLE))),
retained AS (SELECT t.recording_id, CASE WHEN total > 0 THEN coalesce(inside, 0.0::DOUBLE) / total ELSE 1.0::DOUBLE END AS retained FROM
    (SELECT recording_id, sum(rms * rms) AS total FROM frames GROUP BY 1) t LEFT JOIN (SELECT recording_id, sum(rms * rms) AS inside FROM covered GROUP BY 1) i USING (recording_id)),
kept AS (SELECT * FROM detected WHERE recording_id IN (SELECT recording_id FROM retained WHERE retained >= 0.9::DOUBLE)),
every AS (SELECT * FROM kept UNION ALL SELECT recording_id, 0.0::DOUBLE, duration FROM whole WHERE recording_id NOT IN (SELECT recording_id FROM kept)),
spans AS (SELECT recording_id, row_number() OVER (PARTITION BY recording_id ORDER BY start) - 1 AS span_id, start, "end" FROM every WHERE "end" > 0),
sil AS (SELECT recording_id, CASE WHEN n >= 4 AND most > 0 AND hi - lo >= 12 THEN pow(10.0::DOUBLE, greatest(lo + 3, hi - 20) / 20) END AS level FROM
    (SELECT recording_id, 20 * log10(quantile_cont(rms, 0.01) + 1e-9) AS lo, 20 * log10(quantile_cont(rms, 0.99) + 1e-9) AS hi, count(*) AS n, max(rms) AS most FROM frames GROUP BY 1)),
quiet AS (SELECT f.recording_id, frame_idx, frame_idx - row_number() OVER (PARTITION BY f.recording_id ORDER BY frame_idx) AS run FROM frames f JOIN sil USING (recording_id) WHERE rms <= level),
silent AS (SELECT recording_id, min(frame_idx) * 0.03::DOUBLE AS start, (max(frame_idx) + 1) * 0.03::DOUBLE AS "end" FROM quiet GROUP BY recording_id, run HAVING (max(frame_idx) - min(frame_idx) + 1) * 0.03::DOUBLE >= 0.12::DOUBLE)
"""


@query("vad_threshold", FRAMES + "SELECT recording_id, round(floor, 6) AS floor, round(speech, 6) AS speech, round(threshold, 6) AS threshold, flat FROM th")
def _(spark, sf):
    return speech.vad_thresholds(d.frames(spark, sf)).select("recording_id", *r6("floor", "speech", "threshold"), "flat")


@query("vad_spans", FRAMES + 'SELECT recording_id, span_id, round(start, 6) AS start, round("end", 6) AS "end" FROM spans')
def _(spark, sf):
    return speech.speech_spans(d.frames(spark, sf)).select("recording_id", "span_id", *r6("start", "end"))


@query("speech_frame_cover", FRAMES + "SELECT recording_id, frame_idx FROM covered")
def _(spark, sf):
    f = d.frames(spark, sf)
    return speech.covered_frames(f, speech.detected_spans(f)).select("recording_id", "frame_idx")


@query("energy_retained", FRAMES + "SELECT recording_id, round(retained, 6) AS retained FROM retained")
def _(spark, sf):
    f = d.frames(spark, sf)
    return speech.energy_retained(f, speech.detected_spans(f)).select("recording_id", *r6("retained"))


@query("silence_threshold", FRAMES + "SELECT recording_id, round(level, 6) AS level FROM sil")
def _(spark, sf):
    return speech.silence_thresholds(d.frames(spark, sf)).select("recording_id", *r6("level"))


@query("silent_runs", FRAMES + 'SELECT recording_id, round(start, 6) AS start, round("end", 6) AS "end" FROM silent')
def _(spark, sf):
    return speech.silent_runs(d.frames(spark, sf)).select("recording_id", *r6("start", "end"))


LEVELS = f"""WITH {d.PCM}, x AS (SELECT recording_id, block_no, unnest(samples)::DOUBLE AS x, generate_subscripts(samples, 1) AS i FROM pcm_blocks),
lev AS (SELECT recording_id, max(abs(x)) AS peak, sqrt(sum(x * x) / count(*)) AS rms, count(*) AS n FROM x GROUP BY 1)
"""


@query("level_profile", LEVELS + "SELECT recording_id, round(peak, 6) AS peak, round(rms, 6) AS rms FROM lev")
def _(spark, sf):
    return speech.level_profile(d.pcm_blocks(spark, sf)).select("recording_id", *r6("peak", "rms"))


@query("frame_rms", LEVELS + ", o AS (SELECT recording_id, x, (row_number() OVER (PARTITION BY recording_id ORDER BY block_no, i) - 1) // 160 AS frame_idx FROM x) SELECT recording_id, CAST(frame_idx AS BIGINT) AS frame_idx, round(sqrt(sum(x * x) / 160), 6) AS rms FROM o GROUP BY 1, 2 HAVING count(*) = 160")
def _(spark, sf):
    return speech.frame_rms(d.pcm_blocks(spark, sf), 160).select("recording_id", "frame_idx", *r6("rms"))


@query("silence_gate", LEVELS + "SELECT recording_id, CASE WHEN peak / 2000 < 1e-5 THEN 'silent' WHEN peak / 2000 < 1e-3 THEN 'quiet' WHEN peak / 2000 < 0.01 THEN 'very quiet' ELSE 'ok' END AS level_class FROM (SELECT recording_id, peak * (recording_id % 40) AS peak FROM lev)")
def _(spark, sf):
    peak = F.col("peak") * (F.col("recording_id") % 40) / 2000
    return speech.level_profile(d.pcm_blocks(spark, sf)).select("recording_id", S.level_class(peak).alias("level_class"))


@query("dbfs_label", LEVELS + "SELECT recording_id, CASE WHEN recording_id % 3 = 0 THEN 'digital silence' ELSE format('{:.1f} dBFS peak', 20 * log10(peak)) END AS label FROM lev")
def _(spark, sf):
    peak = F.when(F.col("recording_id") % 3 == 0, 0.0).otherwise(F.col("peak"))
    return speech.level_profile(d.pcm_blocks(spark, sf)).select("recording_id", S.dbfs_label(peak).alias("label"))


@query("rate_whitelist", "SELECT o_orderkey, rate, samples, rate NOT IN (8000, 11025, 16000, 22050, 24000, 32000, 44100, 48000) AS needs_resample, rate NOT IN (8000, 11025, 16000, 22050, 24000, 32000, 44100, 48000) AND samples > 57600000 AS refused FROM (SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN 16000 WHEN 1 THEN 44100 WHEN 2 THEN 96000 ELSE 12000 END AS rate, o_orderkey * 977 AS samples FROM orders)")
def _(spark, sf):
    files = d.table(spark, sf, "orders").selectExpr("o_orderkey", "CASE o_orderkey % 4 WHEN 0 THEN 16000 WHEN 1 THEN 44100 WHEN 2 THEN 96000 ELSE 12000 END AS rate", "o_orderkey * 977 AS samples")
    return speech.rate_check(files)


@query("duration_drift", "SELECT o_orderkey, rendered > 0 AND abs(decoded - rendered) >= greatest(0.25::DOUBLE, 0.02::DOUBLE * rendered) AS drifted FROM (SELECT o_orderkey, CAST(o_orderkey % 400 AS DOUBLE) / 10 AS rendered, CAST(o_orderkey % 400 + o_orderkey % 7 AS DOUBLE) / 10 AS decoded FROM orders)")
def _(spark, sf):
    pairs = d.table(spark, sf, "orders").selectExpr("o_orderkey", "CAST(o_orderkey % 400 AS DOUBLE) / 10 AS rendered", "CAST(o_orderkey % 400 + o_orderkey % 7 AS DOUBLE) / 10 AS decoded")
    return speech.duration_drift(pairs).select("o_orderkey", "drifted")


@query("header_only_render", "SELECT o_orderkey, (o_orderkey * 7) % 300 - 1 > 0 AND (o_orderkey * 7) % 300 - 1 <= 128 AS empty_render FROM orders")
def _(spark, sf):
    return speech.header_only(d.table(spark, sf, "orders").selectExpr("o_orderkey", "(o_orderkey * 7) % 300 - 1 AS length")).select("o_orderkey", "empty_render")


@query("empty_transcript_reason", "SELECT c_custkey AS recording_id, CASE WHEN c_custkey % 3 = 0 THEN 'no diagnostics' WHEN (c_custkey % 50) / 1000.0::DOUBLE < 0.01 THEN 'very quiet' ELSE 'not recognised' END AS reason FROM customer WHERE c_custkey NOT IN (SELECT conv_id FROM conversations WHERE trim(text) <> '')")
def _(spark, sf):
    diagnosed = d.table(spark, sf, "customer").select(F.col("c_custkey").alias("recording_id"), F.when(F.col("c_custkey") % 3 != 0, (F.col("c_custkey") % 50) / 1000.0).alias("peak"))
    return speech.empty_transcript_reasons(diagnosed, d.words(spark, sf))


@query("diagnostics", FRAMES + f""", {d.PCM}, x AS (SELECT recording_id, unnest(samples)::DOUBLE AS x FROM pcm_blocks), lev AS (SELECT recording_id, max(abs(x)) AS peak, sqrt(sum(x * x) / count(*)) AS rms FROM x GROUP BY 1),
    n_spans AS (SELECT recording_id, count(*) AS speech_spans, sum(CAST(greatest(0, ceil(("end" - start - 20.0::DOUBLE) / 18.0::DOUBLE)) AS BIGINT) + 1) AS chunks FROM spans WHERE "end" > start GROUP BY 1)
    SELECT w.recording_id, round(duration, 6) AS duration, 16000 AS rate, round(coalesce(peak, 0), 6) AS peak, round(coalesce(rms, 0), 6) AS rms, coalesce(speech_spans, 0) AS speech_spans, CAST(coalesce(chunks, 0) AS BIGINT) AS chunks, 'WAV 16000 Hz 16-bit 1 ch' AS source_format
    FROM whole w LEFT JOIN lev USING (recording_id) LEFT JOIN n_spans USING (recording_id)""")
def _(spark, sf):
    f = d.frames(spark, sf)
    spans = speech.speech_spans(f)
    recordings = f.groupBy("recording_id").agg(((F.max("frame_idx") + 1) * 0.03).alias("duration")).select("*", F.lit(16000).alias("rate"), F.lit(1).alias("channels"), F.lit(16).alias("bits"), F.lit("WAV").alias("container"))
    out = speech.diagnostics(speech.level_profile(d.pcm_blocks(spark, sf)), spans, words.plan_chunks(spans), recordings)
    return out.select("recording_id", *r6("duration"), "rate", *r6("peak", "rms"), "speech_spans", "chunks", "source_format")


@query("slice_bounds", WORDS + 'SELECT recording_id, idx, CAST(least(greatest(round_even(start * 16000, 0), 0), 400000) AS BIGINT) AS first, CAST(least(greatest(round_even("end" * 16000, 0), least(greatest(round_even(start * 16000, 0), 0), 400000)), 400000) AS BIGINT) AS last FROM words')
def _(spark, sf):
    b = S.slice_bounds(F.col("start"), F.col("end"), F.lit(16000), F.lit(400000).cast("long"))
    return d.words(spark, sf).select("recording_id", "idx", b.alias("b")).select("recording_id", "idx", "b.first", "b.last")
