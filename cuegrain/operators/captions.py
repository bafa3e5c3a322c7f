"""Captions on a timeline: holding, checks, edits, splits and merges."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructField, StructType

from cuegrain.functions.groups import connected_groups
from cuegrain.functions.scalars import body_text, clean_text, occurrences, query_pattern, round_half_up, snap, units16, word_count
from cuegrain.functions.scratch import cut

HOLD_SECONDS = 1.2
SHORT_SECONDS, FAST_CHARS = 0.2, 20.0


def hold(captions: DataFrame, key: str, *order: str) -> DataFrame:
    """Ends moved on by HOLD_SECONDS, but never past the next caption's start, to which they may be pulled back."""
    following = F.lead("start").over(Window.partitionBy(key).orderBy(*order))
    return captions.withColumn("end", F.least(F.col("end") + HOLD_SECONDS, F.coalesce(following, F.lit(float("inf")))))


def order_captions(captions: DataFrame, key: str, *ties: str) -> DataFrame:
    """captions with n from 1 by (start, end)."""
    return captions.withColumn("n", F.row_number().over(Window.partitionBy(key).orderBy("start", "end", *ties)).cast("long"))


def caption_issues(captions: DataFrame, key: str, tie: str) -> DataFrame:
    """(key, tie, kind, gap_frames): overlap or flicker with the next caption, short, fast, in this order.

    captions: key, tie (an order among equal times), text, start, end, frame_duration.
    """
    by = Window.partitionBy(key).orderBy("start", "end", tie)
    gap = round_half_up((F.lead("start").over(by) - F.col("end")) / F.col("frame_duration")).cast("long")
    c = captions.withColumns({"gap_frames": gap, "seconds": F.col("end") - F.col("start")})
    flat = F.translate("text", "\n", " ")
    fast = (word_count(F.col("text")) > 1) & (F.col("seconds") > 0) & (units16(flat) / F.when(F.col("seconds") > 0, F.col("seconds")) > FAST_CHARS)
    kinds = F.array(
        F.when(F.col("gap_frames") < 0, "overlap").when(F.col("gap_frames").between(1, 2), "flicker"),
        F.when(F.col("seconds") < SHORT_SECONDS - F.col("frame_duration") / 2, "short"),
        F.when(fast, "fast"),
    )
    return c.select(key, tie, "gap_frames", F.explode(F.filter(kinds, lambda k: k.isNotNull())).alias("kind"))


def fix_overlaps(captions: DataFrame, key: str, tie: str) -> DataFrame:
    """(key, tie, new_end, unfixed) of captions that overlap or flicker: the end goes to the next start, on a frame,
    unless less than half a frame would be left."""
    by = Window.partitionBy(key).orderBy("start", "end", tie)
    following = F.lead("start").over(by)
    gap = round_half_up((following - F.col("end")) / F.col("frame_duration"))
    c = captions.withColumns({"gap_frames": gap, "new_end": snap(following, F.col("frame_duration"))}).where("gap_frames < 0 OR gap_frames BETWEEN 1 AND 2")
    left = F.col("new_end") - F.col("start") < F.col("frame_duration") / 2
    return c.select(key, tie, F.when(~left, F.col("new_end")).alias("new_end"), left.alias("unfixed"))


def shift_captions(captions: DataFrame, key: str, tie: str, first: int, frames: int) -> DataFrame:
    """(key, tie, start, end, error): captions from number `first` on moved by whole frames.

    A list is refused whole if nothing would move or one caption would begin before zero. A list that ends
    before `first` has one row, with the error and no caption.
    """
    by = Window.partitionBy(key).orderBy("start", "end", tie)
    move = F.col("frame_duration") * frames
    listed = Window.partitionBy(key)
    c = captions.withColumns({"n": F.row_number().over(by), "size": F.count("*").over(listed)})
    c = c.where((F.col("n") >= first) | ((F.col("size") < first) & (F.col("n") == 1))).withColumn("short", F.col("size") < first)
    earliest = F.min(F.col("start") + move).over(listed)
    error = F.when(F.lit(frames == 0), "nothing to move").when(F.col("short"), "no captions to shift").when(earliest < -1e-6, "before the start")
    c = c.withColumn("error", error)
    by_move = F.when(F.col("error").isNull(), move).otherwise(F.lit(0.0))
    there = lambda x: F.when(~F.col("short"), x)
    return c.select(key, there(F.col(tie)).alias(tie), there(F.col("start") + by_move).alias("start"), there(F.col("end") + by_move).alias("end"), "error")


def retext_edits(captions: DataFrame, new_text: str) -> DataFrame:
    """captions with edit_text and error: null if the cleaned texts are equal, an error if nothing is left."""
    cleaned = clean_text(F.col(new_text))
    error = F.when(cleaned == "", "empty text")
    same = cleaned == clean_text(F.col("text"))
    return captions.withColumns({"edit_text": F.when(error.isNull() & ~same, cleaned), "error": error})


def retime_edits(captions: DataFrame, start: str, end: str) -> DataFrame:
    """captions with edit_start, edit_end and error: each edge typed by itself, put on a frame, null if that moves it by less than half a frame.

    An edge that moves is an error if the caption, its other edge as it is, would begin before zero or keep less than half a frame.
    """
    fd = F.col("frame_duration")
    edges = {}
    for name, typed in (("start", start), ("end", end)):
        to = snap(F.col(typed), fd)
        begins, ends = (to, F.col("end")) if name == "start" else (F.col("start"), to)
        moved = F.abs(to - F.col(name)) >= fd / 2
        error = F.when(moved & (begins < -1e-6), "before the start").when(moved & (ends - begins < fd / 2), "too short")
        edges[f"edit_{name}"], edges[f"{name}_error"] = F.when(moved & error.isNull(), to), error
    return captions.withColumns(edges | {"error": F.coalesce(edges["start_error"], edges["end_error"])}).drop("start_error", "end_error")


def find_text(captions: DataFrame, query: str, match_case: bool = False) -> DataFrame:
    """captions that hold the query, with matches."""
    return captions.withColumn("matches", occurrences(F.col("text"), F.lit(query), match_case)).where("matches > 0")


def replace_all(captions: DataFrame, key: str, query: str, by: str, match_case: bool = False) -> DataFrame:
    """(captions that hold the query) with new_text, matches and refused: a list is refused whole if one caption becomes empty.

    Only what matches is replaced, in the text as it is, so line breaks elsewhere stay; then the text is cleaned and runs of spaces become one.
    """
    found = find_text(captions, query, match_case)
    made = F.regexp_replace(F.col("text"), query_pattern(F.lit(query), match_case), F.lit(by.replace("\\", "\\\\").replace("$", "\\$")))
    out = found.withColumn("new_text", F.regexp_replace(clean_text(made), " {2,}", " "))
    empty = F.max(F.when(F.col("new_text") == "", 1).otherwise(0)).over(Window.partitionBy(key)) == 1
    return out.withColumn("refused", empty)


def edit_counts(replaced: DataFrame, key: str) -> DataFrame:
    """(key, replaced, changed): occurrences, and captions whose text a replacement of a list changes."""
    done = ~F.col("refused")
    changed = done & (F.col("text") != F.col("new_text"))
    return replaced.groupBy(key).agg(F.sum(F.when(done, F.col("matches")).otherwise(0)).alias("replaced"), F.count_if(changed).alias("changed"))


def split_captions(captions: DataFrame, offset: str) -> DataFrame:
    """Two rows, part 0 and 1, for each caption that can be split at the character offset; others as they are, part null.

    Time is shared by the lengths of the cleaned halves, on a frame; where that leaves one of them less than a frame, at the frame nearest to one frame.
    """
    first, second = clean_text(F.col("text").substr(F.lit(1), F.col(offset))), clean_text(F.col("text").substr(F.col(offset) + 1, F.length("text")))
    c = captions.withColumns({"a": first, "b": second})
    fd, seconds = F.col("frame_duration"), F.col("end") - F.col("start")
    possible = (F.col("a") != "") & (F.col("b") != "") & (seconds >= 1.5 * fd)
    share = units16(F.col("a")) / (units16(F.col("a")) + units16(F.col("b")))
    shared = snap(F.col("start") + seconds * share, fd)
    after = F.when(shared < F.col("start") + fd, snap(F.col("start") + fd, fd)).otherwise(shared)
    middle = F.when(after > F.col("end") - fd, snap(F.col("end") - fd, fd)).otherwise(after)
    c = c.withColumns({"possible": possible, "middle": F.when(possible, middle)})
    halves = F.array(
        F.struct(F.lit(0).alias("part"), F.col("a").alias("text"), F.col("start").alias("start"), F.col("middle").alias("end")),
        F.struct(F.lit(1).alias("part"), F.col("b").alias("text"), F.col("middle").alias("start"), F.col("end").alias("end")),
    )
    whole = F.array(F.struct(F.lit(None).cast("int").alias("part"), F.col("text").alias("text"), F.col("start").alias("start"), F.col("end").alias("end")))
    other = [x for x in captions.columns if x not in ("text", "start", "end")]
    return c.select(*other, F.explode(F.when(F.col("possible"), halves).otherwise(whole)).alias("h")).select(*other, "h.*")


def merge_captions(captions: DataFrame, key: str, tie: str, chosen: str) -> DataFrame:
    """captions where each chosen one takes in the next of its list, which goes; the first one's other columns stay.

    A caption taken in cannot take in another: the earlier choice wins.
    """
    by = Window.partitionBy(key).orderBy("start", "end", tie)
    c = captions.withColumns({"n_text": F.lead("text").over(by), "n_start": F.lead("start").over(by), "n_end": F.lead("end").over(by), "taken": F.coalesce(F.lag(chosen).over(by), F.lit(False)), "pos": F.row_number().over(by)})
    # in a run of chosen captions every second one is taken in
    run = F.col("pos") - F.sum(F.col(chosen).cast("int")).over(by)
    c = c.withColumn("run", run)
    place = F.row_number().over(Window.partitionBy(key, "run", chosen).orderBy("pos"))
    c = c.withColumn("merges", F.col(chosen) & (place % 2 == 1) & F.col("n_text").isNotNull())
    c = c.withColumn("goes", F.coalesce(F.lag("merges").over(by), F.lit(False)))
    merged = F.col("merges")
    joined = clean_text(F.concat_ws(" ", clean_text(F.col("text")), clean_text(F.col("n_text"))))
    out = c.where("NOT goes").withColumns({"text": F.when(merged, joined).otherwise(F.col("text")), "end": F.when(merged, F.greatest("end", "n_end")).otherwise(F.col("end")), "start": F.when(merged, F.least("start", "n_start")).otherwise(F.col("start"))})
    return out.select(*captions.columns)


#: What an edit may hold besides its batch: how its caption is found, what is expected of it and what changes.
_EXPECTED = ("expect_text", "expect_start", "expect_end")


def _resolved(captions: DataFrame, edits: DataFrame, offsets: DataFrame | None) -> DataFrame:
    """edits with their caption's present state (c_*, null if there is none) and changes put on frames of its own timeline."""
    known = captions.select("comp_id", "layer_id", F.col("text").alias("c_text"), F.col("start").alias("c_start"), F.col("end").alias("c_end"), "frame_duration", "keyframed", F.lit(True).alias("found"))
    e = edits
    if "layer_index" in edits.columns and "layer_index" in captions.columns:
        places = captions.select("comp_id", "layer_index", F.col("layer_id").alias("at_index"))
        e = e.join(places, ["comp_id", "layer_index"], "left").withColumn("layer_id", F.coalesce("layer_id", "at_index")).drop("at_index")
    e = e.join(known, ["comp_id", "layer_id"], "left")
    e = e.withColumn("offset", F.lit(0.0)) if offsets is None else e.join(offsets.select("comp_id", "offset"), "comp_id", "left")
    fd = F.col("frame_duration")
    shift = F.when(F.col("shift_by") != 0, snap(F.col("shift_by"), fd)).otherwise(F.lit(0.0))
    twice = F.count("found").over(Window.partitionBy("batch_id", "comp_id", "layer_id")) > 1
    return e.select(
        "batch_id", "comp_id", "layer_id", F.coalesce("found", F.lit(False)).alias("found"), "offset", *_EXPECTED, twice.alias("twice"), F.coalesce("keyframed", F.lit(False)).alias("keyframed"), (fd / 2).alias("half"), body_text(F.col("c_text")).alias("c_text"), "c_start", "c_end",
        body_text(F.col("text")).alias("new_text"), F.coalesce(shift, F.lit(0.0)).alias("shift"), snap(F.col("start") - F.col("offset"), fd).alias("new_start"), snap(F.col("end") - F.col("offset"), fd).alias("new_end"), F.col("start").isNotNull().alias("sets_start"), F.col("end").isNotNull().alias("sets_end"),
    )


def _fault(x: dict, text: str, start: float, end: float) -> str | None:
    """Why an edit cannot be made to a caption that now is (text, start, end)."""
    if not x["found"]:
        return "missing"
    expected = [x[k] for k in _EXPECTED]
    if x["offset"] is None or any(v is None for v in expected) or expected[0] != text or abs(start + x["offset"] - expected[1]) > x["half"] or abs(end + x["offset"] - expected[2]) > x["half"]:
        return "stale"
    if x["twice"]:
        return "edited twice"
    if x["new_text"] == "":
        return "empty text"
    if x["new_text"] is not None and x["keyframed"]:
        return "keyframed text"
    to_start = x["new_start"] if x["sets_start"] else start + x["shift"]
    to_end = x["new_end"] if x["sets_end"] else end + x["shift"]
    if math.isnan(to_start) or math.isnan(to_end):
        return "not a number"
    if to_end - to_start < x["half"]:
        return "too short"
    return "before the start" if to_start + x["offset"] < -x["half"] else None


def _made(x: dict, text: str, start: float, end: float) -> tuple[str, float, float]:
    """A caption after an edit: a shift moves it whole, and only without one are its edges set."""
    text = text if x["new_text"] is None else x["new_text"]
    if x["shift"]:
        return text, start + x["shift"], end + x["shift"]
    return text, x["new_start"] if x["sets_start"] else start, x["new_end"] if x["sets_end"] else end


def _in_turn(schema: pa.Schema) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Edits sorted by (series, batch_id): each batch is judged by what earlier ones of its series left, and leaves nothing if it is refused.

    A series is streamed; what is kept of it are the captions that it has changed.
    """

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state: dict[tuple, tuple[str, float, float]] = {}
        series, batch = None, []

        def judged() -> list[dict]:
            now = [state.get((x["comp_id"], x["layer_id"]), (x["c_text"], x["c_start"], x["c_end"])) for x in batch]
            reasons = [_fault(x, *s) for x, s in zip(batch, now, strict=True)]
            refused = any(reasons)
            out = []
            for x, s, reason in zip(batch, now, reasons, strict=True):
                text, start, end = s if refused else _made(x, *s)
                if not refused:
                    state[x["comp_id"], x["layer_id"]] = text, start, end
                out.append({"batch_id": x["batch_id"], "comp_id": x["comp_id"], "layer_id": x["layer_id"], "reason": reason, "refused": refused, "text": text, "start": start, "end": end, "retexted": x["new_text"] is not None})
            return out

        for part in parts:
            out: list[dict] = []
            for x in part.to_pylist():
                if batch and (x["series"], x["batch_id"]) != (series, batch[0]["batch_id"]):
                    out += judged()
                    batch = []
                if x["series"] != series:
                    series, state = x["series"], {}
                batch.append(x)
            if out:
                yield pa.RecordBatch.from_pylist(out, schema)
        if batch:
            yield pa.RecordBatch.from_pylist(judged(), schema)

    return run


def apply_edits(captions: DataFrame, edits: DataFrame, offsets: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(captions, rejects): batches of edits applied in the order of batch_id, each whole or not at all.

    captions: comp_id, layer_id, text, start, end, frame_duration, keyframed, and layer_index (places in the timeline) if edits use it.
    edits: batch_id, comp_id, layer_id (or, where that is null, layer_index), expect_text, expect_start, expect_end, and text, start, end,
    shift_by (null: unchanged). offsets: comp_id, offset of timelines inside the outer one, whose time edits are in;
    none: all captions are on the outer one. Times go to frames; a shift moves a caption whole, and edges are set only without one.

    A batch sees what earlier accepted batches left. It is refused if a caption is missing, is not as expected
    (times within half a frame; a null expectation or a timeline without an offset is never as expected), is edited twice, would be empty, has keyframed text
    that would change, or would be too short or before zero. rejects: batch_id, comp_id, layer_id, reason of each edit at fault.

    Batches that share a caption, directly or through others, form a series, which is settled in order and so is one task's
    work, streamed; other batches are a series each. Every caption comes back once.
    """
    e = cut(_resolved(captions, edits, offsets), "edits")
    touched = e.where("found").select("comp_id", "layer_id", "batch_id").distinct()
    first = touched.groupBy("comp_id", "layer_id").agg(F.min("batch_id").alias("first"), F.count("*").alias("n")).where("n > 1")
    links = touched.join(first, ["comp_id", "layer_id"]).where("batch_id <> first").select(F.col("batch_id").alias("a"), F.col("first").alias("b"))
    shared = connected_groups(links).select(F.col("node").alias("batch_id"), F.col("group").alias("series"))
    queued = e.join(shared, "batch_id", "left").withColumn("series", F.coalesce("series", "batch_id"))
    kinds = {f.name: f.dataType for f in queued.schema.fields}
    schema = StructType([StructField(x, kinds[x]) for x in ("batch_id", "comp_id", "layer_id")])
    schema = StructType([*schema.fields, *StructType.fromDDL("reason string, refused boolean, text string, start double, `end` double, retexted boolean").fields])
    turns = queued.repartition("series").sortWithinPartitions("series", "batch_id", "comp_id", "layer_id")
    judged = cut(turns.mapInArrow(_in_turn(to_arrow_schema(schema)), schema), "judged")
    good = judged.where("NOT refused").groupBy("comp_id", "layer_id").agg(F.max_by(F.struct("start", "end"), "batch_id").alias("times"), F.max_by("text", F.when(F.col("retexted"), F.col("batch_id"))).alias("typed"), F.max("retexted").alias("retexted"))
    out = captions.join(good, ["comp_id", "layer_id"], "left").withColumn("edited", F.col("times").isNotNull())
    out = out.withColumns({"text": F.when(F.col("retexted"), F.col("typed")).otherwise(F.col("text")), "start": F.coalesce("times.start", "start"), "end": F.coalesce("times.end", "end")})
    return out.select(*captions.columns, "edited"), judged.where("reason IS NOT NULL").select("batch_id", "comp_id", "layer_id", "reason")
