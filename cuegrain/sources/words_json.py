"""Finished transcriptions as JSON: words to payloads, and payloads to words."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

WORDS = "struct<result:struct<duration:double,full_text:string,words:array<struct<text:string,start:double,end:double,confidence:double>>,diagnostics:struct<peak:double,rms:double,speech_spans:bigint,chunks:bigint>>>"


def words_payloads(words: DataFrame, diagnostics: DataFrame | None = None) -> DataFrame:
    """(recording_id, payload): one JSON per recording; nulls are written, diagnostics also where there are no words."""
    ordered = F.array_sort(F.collect_list(F.struct("idx", "text", "start", "end", "confidence")))
    rows = words.groupBy("recording_id").agg(F.transform(ordered, lambda w: F.struct(w.text.alias("text"), w.start.alias("start"), w.end.alias("end"), w.confidence.alias("confidence"))).alias("words"))
    empty = "array<struct<text:string,start:double,end:double,confidence:double>>"
    kind = "struct<peak:double,rms:double,speech_spans:bigint,chunks:bigint>"
    if diagnostics is not None:
        d = diagnostics.select("recording_id", F.col("duration").alias("d_duration"), F.struct("peak", "rms", "speech_spans", "chunks").cast(kind).alias("diagnostics"))
        rows = rows.join(d, "recording_id", "full")
    else:
        rows = rows.withColumns({"d_duration": F.lit(None).cast("double"), "diagnostics": F.lit(None).cast(kind)})
    ws = F.coalesce("words", F.array().cast(empty))
    last = F.try_element_at(ws, F.lit(-1))["end"]
    result = F.struct(F.coalesce("d_duration", last).alias("duration"), F.array_join(F.transform(ws, lambda w: w.text), " ").alias("full_text"), ws.alias("words"), F.col("diagnostics").alias("diagnostics"))
    return rows.select("recording_id", F.to_json(F.struct(result.alias("result")), {"ignoreNullFields": "false"}).alias("payload"))


def payload_words(payloads: DataFrame, *keys: str) -> DataFrame:
    """(keys, idx, text, start, end, confidence) of JSON payloads; malformed ones give no rows."""
    parsed = payloads.select(*keys, F.from_json("payload", WORDS).alias("p"))
    return parsed.select(*keys, F.posexplode("p.result.words").alias("idx", "w")).select(*keys, F.col("idx").cast("long").alias("idx"), "w.*")


def write_payloads(payloads: DataFrame, path: str) -> None:
    payloads.select(F.col("payload").alias("value")).write.text(path)
