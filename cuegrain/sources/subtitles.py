"""Subtitle texts (SRT and WebVTT) to captions and back."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cuegrain.functions.scalars import cue_seconds, srt_timecode, trimmed

CUE = "(?:(\\d+):)?(\\d{1,2}):(\\d{1,2})[,.](\\d{1,3})\\s*-->\\s*(?:(\\d+):)?(\\d{1,2}):(\\d{1,2})[,.](\\d{1,3})"


def read_files(spark, path: str) -> DataFrame:
    """(file, content) of whole text files."""
    return spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("file"), F.col("value").alias("content"))


def subtitle_blocks(files: DataFrame) -> DataFrame:
    """(file, block_no, lines, at): blocks of lines numbered from 1, empty ones counted; at is the line of the time, from 1, 0 if none."""
    text = F.regexp_replace(F.regexp_replace("content", "^\\x{FEFF}", ""), "\r\n?", "\n")
    text = F.regexp_replace(text, "^WEBVTT[^\n]*\n?", "")
    blocks = files.select("file", F.posexplode(F.split(text, "\n{2,}")).alias("b", "block")).where(trimmed(F.col("block")) != "")
    lines = F.split("block", "\n")
    first = F.filter(F.sequence(F.lit(1), F.size(lines)), lambda i: F.element_at(lines, i).rlike(CUE))
    return blocks.select("file", (F.col("b") + 1).cast("long").alias("block_no"), lines.alias("lines"), F.coalesce(F.get(first, 0), F.lit(0)).alias("at"))


def _cues(files: DataFrame) -> DataFrame:
    b = subtitle_blocks(files)
    time = F.when(F.col("at") > 0, F.element_at("lines", F.when(F.col("at") > 0, F.col("at")).otherwise(1)))
    part = [F.regexp_extract(time, CUE, i) for i in range(1, 9)]
    body = F.expr("slice(lines, at + 1, size(lines))")
    plain = F.filter(F.transform(body, lambda x: trimmed(F.regexp_replace(x, "<[^>]*>", ""))), lambda x: x != "")
    c = b.withColumns({"body": F.when(F.col("at") > 0, plain)})
    start, end = (F.when(F.col("at") > 0, cue_seconds(h, m, s, f)) for h, m, s, f in (part[:4], part[4:]))
    c = c.withColumns({"start": start, "end": end})
    error = F.when(F.col("at") == 0, "no timecode").when(F.col("end") <= F.col("start"), "ends before it starts").when(F.size("body") == 0, "no text")
    return c.withColumn("error", error)


def subtitle_captions(files: DataFrame) -> DataFrame:
    """(file, caption_no, text, start, end): usable cues by start; lines are joined by spaces, tags dropped."""
    good = _cues(files).where("error IS NULL")
    by = Window.partitionBy("file").orderBy("start", "block_no")
    return good.select("file", (F.row_number().over(by) - 1).cast("long").alias("caption_no"), F.array_join("body", " ").alias("text"), "start", "end")


def subtitle_errors(files: DataFrame) -> DataFrame:
    """(file, block_no, error)."""
    return _cues(files).where("error IS NOT NULL").select("file", "block_no", "error")


def subtitle_texts(captions: DataFrame, key: str, *ties: str) -> DataFrame:
    """(key, content): an SRT text for each key; captions hold text, start, end and may hold lines.

    Cues are numbered from 1 by (start, end); empty ones are left out before numbering; starts are not
    below zero, and an end that is not after its start is put a millisecond behind it.
    """
    body = F.array_join("lines", "\n") if "lines" in captions.columns else F.col("text")
    kept = captions.withColumn("cue_body", trimmed(F.coalesce(body, F.lit("")))).where("cue_body <> ''")
    n = F.row_number().over(Window.partitionBy(key).orderBy("start", "end", *ties))
    start = F.greatest(F.lit(0.0), F.col("start"))
    end = F.when(F.col("end") <= start, start + 0.001).otherwise(F.col("end"))
    cue = F.concat(F.col("n").cast("string"), F.lit("\r\n"), srt_timecode(start), F.lit(" --> "), srt_timecode(end), F.lit("\r\n"), F.regexp_replace("cue_body", "\r?\n", "\r\n"), F.lit("\r\n"))
    rows = kept.withColumn("n", n).withColumn("cue", cue)
    return rows.groupBy(key).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n", "cue"))), lambda x: x.cue), "\r\n").alias("content"))


def write_subtitles(texts: DataFrame, key: str, path: str) -> None:
    """One folder of text files, partitioned by key; a line end follows each text."""
    texts.select(key, F.col("content").alias("value")).write.partitionBy(key).text(path)
