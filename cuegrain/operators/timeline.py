"""Layers, nested timelines, rebuilding ranges of captions and style sync."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cuegrain.functions.intervals import apart_from
from cuegrain.functions.scalars import clean_text, round_half_up
from cuegrain.functions.scratch import cut, scratch_path

CAPTION_TAG, LEGACY_PREFIX, CONTROLLER_TAG = "caption", "caption:", "controller"
#: Nested timelines are followed so deep when a caption is located.
DEEPEST = 8


def audible_layers(layers: DataFrame) -> DataFrame:
    """Layers that are heard: with audio, enabled or soloed, and soloed themselves if any layer of the timeline is."""
    any_solo = F.max(F.col("solo")).over(Window.partitionBy("comp_id"))
    heard = layers.withColumn("any_solo", any_solo)
    return heard.where("has_audio AND (enabled OR solo) AND (NOT any_solo OR solo)").drop("any_solo")


def render_layers(layers: DataFrame) -> DataFrame:
    """Audible layers when selected layers with audio, if there are any, are the only ones soloed."""
    chosen = F.max(F.col("selected") & F.col("has_audio")).over(Window.partitionBy("comp_id"))
    solo = F.when(chosen, F.col("selected") & F.col("has_audio")).otherwise(F.col("solo"))
    return audible_layers(layers.withColumn("solo", solo))


def render_source(layers: DataFrame, timelines: DataFrame, scope: str = "all") -> DataFrame:
    """(comp_id, start, duration, audible, error) per timeline: what a render of its sound covers."""
    heard = render_layers(layers).groupBy("comp_id").agg(F.count("*").alias("audible"))
    start, duration = ("work_start", "work_duration") if scope == "inout" else (F.lit(0.0), "duration")
    out = timelines.join(heard, "comp_id", "left").withColumn("audible", F.coalesce("audible", F.lit(0).cast("long")))
    range_start = F.col(start) if isinstance(start, str) else start
    return out.select("comp_id", range_start.alias("start"), F.col(duration).alias("duration"), "audible", F.when(F.col("audible") == 0, "no audible layer").alias("error"))


def is_caption_layer(tag: Column, name: Column) -> Column:
    return F.coalesce(tag == CAPTION_TAG, F.lit(False)) | F.coalesce(name.startswith(LEGACY_PREFIX), F.lit(False))


def caption_layers(layers: DataFrame) -> DataFrame:
    """Caption layers that hold text; the controller is none."""
    return layers.where(is_caption_layer(F.col("tag"), F.col("name")) & (clean_text(F.coalesce("text", F.lit(""))) != ""))


def clear_captions(layers: DataFrame, controller: bool = False) -> DataFrame:
    """Layers that stay when the captions are cleared, and the controller too if asked."""
    gone = is_caption_layer(F.col("tag"), F.col("name"))
    if controller:
        gone = gone | F.coalesce(F.col("tag") == CONTROLLER_TAG, F.lit(False))
    return layers.where(~gone)


def layer_times(layers: DataFrame, selected_only: bool = False) -> DataFrame:
    """(comp_id, layer_id, name, duration) of caption layers."""
    found = layers.where(is_caption_layer(F.col("tag"), F.col("name")))
    found = found.where("selected") if selected_only else found
    return found.select("comp_id", "layer_id", "name", (F.col("end") - F.col("start")).alias("duration"))


def usable_range(start: Column, duration: Column) -> Column:
    """A range is usable if it is there, is a number, begins at zero or later and lasts."""
    good = start.isNotNull() & duration.isNotNull() & ~F.isnan(start) & ~F.isnan(duration) & (start >= 0) & (duration > 0)
    return F.coalesce(good, F.lit(False))


def place_captions(captions: DataFrame, offset: Column, range_end: Column) -> DataFrame:
    """captions on frames: moved by the offset, snapped, ended by the range's last frame, one frame long at least; blank ones go."""
    fd = F.col("frame_duration")

    def on_frame(x: Column) -> Column:
        return round_half_up(x / fd) * fd

    start = on_frame(F.col("start") + offset)
    end = F.least(on_frame(F.col("end") + offset), on_frame(range_end))
    kept = captions.where(clean_text(F.coalesce("text", F.lit(""))) != "")
    return kept.withColumns({"p_start": start, "p_end": F.when(end <= start, start + fd).otherwise(end)}).drop("start", "end").withColumnsRenamed({"p_start": "start", "p_end": "end"})


def caption_position(captions: DataFrame, timelines: DataFrame, default_y: float = 0.85) -> DataFrame:
    """captions (comp_id, position_y) with x and y: half the width, and position_y (or default_y) of the height."""
    t = timelines.select("comp_id", "width", "height")
    return captions.join(t, "comp_id").withColumns({"x": F.col("width") * 0.5, "y": F.col("height") * F.coalesce("position_y", F.lit(default_y))}).drop("width", "height")


def outside_ranges(captions: DataFrame, ranges: DataFrame) -> DataFrame:
    """captions that overlap no half-open range of their timeline (an interval anti-join). ranges: comp_id, range_start, range_end."""
    return apart_from(captions, ranges, "comp_id", "start", "end", "range_start", "range_end")


def rebuild_captions(new: DataFrame, existing: DataFrame, ranges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(captions, report): new captions and the existing ones outside the range rebuilt.

    ranges: comp_id, scoped, range_start, range_duration. An unscoped rebuild replaces all of its
    timeline; a scoped one with an unusable range, and one without new captions, is refused and changes
    nothing. new and existing: comp_id, layer_id, text, start, end, and source_comp_id of existing layers that hold a nested timeline.
    report: comp_id, added, replaced, error, cuts_nested (a layer that goes holds a timeline and reaches beyond the range, so captions outside it go, too)
    and nested_lost (captions of the timelines that go with their layers).
    """
    counts = new.groupBy("comp_id").agg(F.count("*").alias("n_new"))
    r = ranges.join(counts, "comp_id", "left")
    error = F.when(F.col("scoped") & ~usable_range(F.col("range_start"), F.col("range_duration")), "unusable range").when(F.coalesce("n_new", F.lit(0)) == 0, "no captions")
    r = r.withColumn("error", error)
    good = r.where("error IS NULL")
    spans = good.select("comp_id", F.when(F.col("scoped"), F.col("range_start")).otherwise(F.lit(float("-inf"))).alias("range_start"), F.when(F.col("scoped"), F.col("range_start") + F.col("range_duration")).otherwise(F.lit(float("inf"))).alias("range_end"))
    kept = outside_ranges(existing, spans)
    added = new.join(good.select("comp_id"), "comp_id", "left_semi")
    names = ["comp_id", "layer_id", "text", "start", "end"]
    out = added.select(*names, F.lit(True).alias("is_new")).unionByName(kept.select(*names, F.lit(False).alias("is_new")))
    before = existing.groupBy("comp_id").agg(F.count("*").alias("n_before"))
    after = kept.groupBy("comp_id").agg(F.count("*").alias("n_kept"))
    zero = F.lit(0).cast("long")
    held = existing if "source_comp_id" in existing.columns else existing.withColumn("source_comp_id", F.lit(None).cast("long"))
    gone = held.where("source_comp_id IS NOT NULL").join(spans, "comp_id").where("start < range_end AND end > range_start")
    cuts = gone.groupBy("comp_id").agg(F.max((F.col("start") < F.col("range_start")) | (F.col("end") > F.col("range_end"))).alias("cuts"))
    inside = held.where("source_comp_id IS NULL").groupBy(F.col("comp_id").alias("source_comp_id")).agg(F.count("*").alias("n_inside"))
    lost = gone.select("comp_id", "source_comp_id").distinct().join(inside, "source_comp_id").groupBy("comp_id").agg(F.sum("n_inside").alias("n_lost"))
    report = r
    for own in (before, after, cuts, lost):
        report = report.join(own, "comp_id", "left")
    return out, report.select("comp_id", F.when(F.col("error").isNull(), F.coalesce("n_new", zero)).otherwise(zero).alias("added"), (F.coalesce("n_before", zero) - F.coalesce("n_kept", zero)).alias("replaced"), "error", F.coalesce("cuts", F.lit(False)).alias("cuts_nested"), F.coalesce("n_lost", zero).alias("nested_lost"))


def _extended(path: Column) -> tuple[Column, Column]:
    """Whether a path repeats no timeline before its last step, and whether that step leads back into it."""
    body = F.slice(path, F.lit(1), F.size(path) - 1)
    return F.size(F.array_distinct(body)) == F.size(body), F.array_contains(body, F.element_at(path, -1))


def nested_offsets(layers: DataFrame, deepest: int | None = None, roots: DataFrame | None = None) -> DataFrame:
    """(root_id, comp_id, depth, offset, error): every timeline under every other, through caption-tagged holder layers.

    Ways are doubled: with all ways of exactly n steps and all from the roots of fewer than n, one join gives those from the roots of fewer than
    2n, and another all ways of exactly 2n. So the rounds, each written, grow with the logarithm of the depth; to locate a timeline,
    deepest is DEEPEST. A timeline met again inside itself is a row with an error and is not followed.
    roots: root_id, all timelines if not given.
    """
    spark, kind = layers.sparkSession, layers.schema["comp_id"].dataType
    to = F.col("source_comp_id").cast(kind)
    holders = layers.where(is_caption_layer(F.col("tag"), F.col("name")) & F.col("source_comp_id").isNotNull())
    ways = cut(holders.select(F.col("comp_id").alias("from_id"), to.alias("to_id"), F.col("start_time").alias("way"), F.array(to).alias("steps"), (to == F.col("comp_id")).alias("again")), "ways")
    start = layers.select(F.col("comp_id").alias("root_id"), "comp_id").distinct()
    start = start if roots is None else start.join(roots.select("root_id"), "root_id", "left_semi")
    found = start.select("root_id", "comp_id", F.lit(0).alias("depth"), F.lit(0.0).alias("offset"), F.array("comp_id").alias("path"), F.lit(None).cast("string").alias("error"))
    folder, schema, n = scratch_path(spark, "nested"), found.schema, 1
    found.write.parquet(f"{folder}/part=0")
    while deepest is None or n <= deepest:
        known = spark.read.schema(schema).parquet(folder)
        path = F.concat("path", "steps")
        fresh, again = _extended(path)
        longer = known.where("error IS NULL").join(ways, F.col("comp_id") == F.col("from_id")).where(fresh)
        longer = longer.select("root_id", F.col("to_id").alias("comp_id"), (F.col("depth") + n).cast("int").alias("depth"), (F.col("offset") + F.col("way")).alias("offset"), path.alias("path"), F.when(again, "timeline inside itself").alias("error"))
        longer = longer if deepest is None else longer.where(F.col("depth") <= deepest)
        longer.write.parquet(f"{folder}/part={n}")
        if spark.read.schema(schema).parquet(f"{folder}/part={n}").isEmpty():
            break
        second = ways.select(*[F.col(x).alias(f"s_{x}") for x in ways.columns])
        steps = F.concat("steps", "s_steps")
        fresh, again = _extended(F.concat(F.array("from_id"), steps))
        twice = ways.where("NOT again").join(second, F.col("to_id") == F.col("s_from_id")).where(fresh)
        ways = cut(twice.select("from_id", F.col("s_to_id").alias("to_id"), (F.col("way") + F.col("s_way")).alias("way"), steps.alias("steps"), again.alias("again")), "ways")
        n *= 2
    return spark.read.schema(schema).parquet(folder).select("root_id", "comp_id", "depth", "offset", "error")


def flatten_captions(layers: DataFrame, roots: DataFrame, deepest: int | None = None) -> tuple[DataFrame, DataFrame]:
    """(captions, errors): captions of nested timelines, of any depth, on the outer timeline's time. roots: root_id.

    captions: root_id, depth, layer_id, text, start, end. errors: root_id, comp_id, depth, error, a row where
    a timeline holds itself; its captions are there once for each way that leads to it without a repeat.
    """
    under = nested_offsets(layers, deepest, roots)
    captions = caption_layers(layers).where("source_comp_id IS NULL").select("comp_id", "layer_id", "text", "start", "end")
    both = under.where("error IS NULL").join(captions, "comp_id")
    errors = under.where("error IS NOT NULL").select("root_id", "comp_id", "depth", "error")
    return both.select("root_id", "depth", "layer_id", "text", (F.col("start") + F.col("offset")).alias("start"), (F.col("end") + F.col("offset")).alias("end")), errors


#: Style fields that an empty or zero value leaves as they are, and those that any value sets.
STYLE_IF_FILLED = ("font", "size", "fill", "stroke", "scale")
STYLE_IF_GIVEN = ("tracking", "leading", "justification", "apply_fill", "apply_stroke", "stroke_width", "stroke_over_fill")


def sync_style(captions: DataFrame, style: dict, timelines: DataFrame) -> DataFrame:
    """captions with one style applied to all: absent values keep the old, of some fields empty and zero ones too.

    captions: comp_id, layer_id and any of the style's fields, position_x and position_y among them. style
    holds values of the same names, and the source_width and source_height of the timeline that they were
    taken from. The position scales with the timeline; it moves only if both its parts and both sizes are known.
    """
    both = captions.join(timelines.select("comp_id", "width", "height"), "comp_id")
    kinds = dict(captions.dtypes)
    new = {}
    for name in (*STYLE_IF_FILLED, *STYLE_IF_GIVEN):
        value = style.get(name)
        if name in kinds and value is not None and (name in STYLE_IF_GIVEN or value not in ("", 0)):
            new[name] = (F.array(*map(F.lit, value)) if isinstance(value, (list, tuple)) else F.lit(value)).cast(kinds[name])
    x, y, width, height = (style.get(k) for k in ("position_x", "position_y", "source_width", "source_height"))
    if x is not None and y is not None and width and height:
        new["position_x"] = F.col("width") * F.lit(x / width)
        new["position_y"] = F.col("height") * F.lit(y / height)
    return both.withColumns({k: v for k, v in new.items() if k in kinds}).select(*captions.columns)


def sync_report(synced: DataFrame) -> DataFrame:
    """(updated, comps, error) of one sync."""
    return synced.agg(F.count("*").alias("updated"), F.countDistinct("comp_id").alias("comps")).withColumn("error", F.when(F.col("updated") == 0, "no captions"))
