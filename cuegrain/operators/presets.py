"""Presets and animation timings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cuegrain.functions.scalars import trimmed

PRESET = "struct<id:string,name:string,basedOn:string,`in`:string,`out`:string>"


def _kind(value: Column) -> Column:
    """OBJECT, ARRAY, VOID for a null, or a scalar's type; null where there is nothing."""
    return F.regexp_extract(F.schema_of_variant(value), "^[A-Z]+", 0)


def scan_presets(files: DataFrame) -> DataFrame:
    """(file, pos, id, name, based_on, in_phase, out_phase, custom, entry) of preset files (file, content).

    A malformed file gives no rows. Entries stay that have an id and a name, and whose phases, where they
    are there and not null, are objects or lists whose properties, where they are there, are a list; the first of an id stays.
    entry is the whole entry as JSON, with every field that it came with. Values are judged as VARIANT, so by their types and not by how they are written.
    """
    files = files.repartition("file")  # parsing is the work, and where files are read there may be one task
    read = files.where(F.try_parse_json("content").isNotNull()).select("file", F.from_json("content", "struct<version:int,presets:array<string>>").alias("p"))
    rows = read.select("file", F.posexplode("p.presets").alias("pos", "entry")).select("file", "pos", F.trim("entry").alias("entry"))
    rows = rows.withColumns({"v": F.try_parse_json("entry"), "e": F.from_json("entry", PRESET)})

    def usable(phase: str) -> Column:
        kind = _kind(F.try_variant_get("v", f"$.{phase}", "variant"))
        properties = F.coalesce(_kind(F.try_variant_get("v", f"$.{phase}.properties", "variant")), F.lit("ARRAY"))
        return F.coalesce(kind, F.lit("VOID")).isin("VOID", "ARRAY") | ((kind == "OBJECT") & (properties == "ARRAY"))

    good = rows.where(_kind(F.col("v")) == "OBJECT").where("trim(e.id) <> '' AND trim(e.name) <> ''").where(usable("in") & usable("out"))
    first = F.row_number().over(Window.partitionBy("file", "e.id").orderBy("pos"))
    return good.withColumn("n", first).where("n = 1").select("file", "pos", "e.id", "e.name", F.col("e.basedOn").alias("based_on"), F.col("e.in").alias("in_phase"), F.col("e.out").alias("out_phase"), F.lit(True).alias("custom"), "entry")


def _custom(entry: Column) -> Column:
    """A JSON object with custom true: set where it has that field, added at its end where it hasn't."""
    value = "to_json(element_at(fields, k))"
    own = f"transform(json_object_keys(entry), k -> concat('\"', replace(replace(k, '\\\\', '\\\\\\\\'), '\"', '\\\\\"'), '\":', CASE WHEN k = 'custom' THEN 'true' ELSE {value} END))"
    kept = F.concat(F.lit("{"), F.array_join(F.expr(own), ","), F.lit("}"))
    added = F.concat(F.regexp_replace(entry, "\\s*\\}\\s*\\z", ""), F.when(F.size(F.json_object_keys(entry)) > 0, ",").otherwise(""), F.lit('"custom":true}'))
    return F.when(F.array_contains(F.json_object_keys(entry), "custom"), kept).otherwise(added)


def write_presets(presets: DataFrame, key: str) -> DataFrame:
    """(key, content): one JSON of version 1 for each key. presets: key, pos, id, name, and entry, if there, which is written whole. All are marked as custom, whatever they say."""
    plain = F.to_json(F.struct("id", "name"))
    rows = presets.select(key, "pos", (F.coalesce("entry", plain) if "entry" in presets.columns else plain).alias("entry"))
    rows = rows.withColumn("fields", F.try_variant_get(F.try_parse_json("entry"), "$", "map<string,variant>"))
    ordered = F.array_sort(F.collect_list(F.struct("pos", _custom(F.col("entry")).alias("entry"))))
    content = F.concat(F.lit('{"version":1,"presets":['), F.array_join(F.transform(ordered, lambda x: x.entry), ","), F.lit("]}"))
    return rows.groupBy(key).agg(content.alias("content"))


def preset_library(built_in: DataFrame, user: DataFrame) -> DataFrame:
    """Built-in presets whose id no user preset has, then the user's, with their order: part 0 and 1, and pos."""
    kept = built_in.join(user.select("id"), "id", "left_anti")
    return kept.withColumn("part", F.lit(0)).unionByName(user.withColumn("part", F.lit(1)))


def upsert_presets(presets: DataFrame, new: DataFrame) -> DataFrame:
    """presets (owner, pos, id, name, body) with one new preset (owner, id, name, body) per owner.

    The first that has its id, or its name but for case and outer space, is replaced in its place, and
    others stay; without one it is appended.
    """
    n = new.select("owner", F.col("id").alias("n_id"), F.col("name").alias("n_name"), F.col("body").alias("n_body"))
    fold = lambda c: F.lower(trimmed(c))
    both = presets.join(n, "owner", "left")
    match = F.coalesce((F.col("id") == F.col("n_id")) | (fold(F.col("name")) == fold(F.col("n_name"))), F.lit(False))
    seen = F.sum(F.col("match").cast("int")).over(Window.partitionBy("owner").orderBy("pos"))
    marked = both.withColumn("match", match).withColumn("seen", seen).withColumn("hit", F.col("match") & (F.col("seen") == 1))
    replaced = marked.select("owner", "pos", *[F.when(F.col("hit"), F.col(f"n_{c}")).otherwise(F.col(c)).alias(c) for c in ("id", "name", "body")])
    last = presets.groupBy("owner").agg((F.max("pos") + 1).alias("pos"))
    missing = new.join(marked.where("hit").select("owner").distinct(), "owner", "left_anti").join(last, "owner", "left")
    return replaced.unionByName(missing.select("owner", F.coalesce("pos", F.lit(0)).cast(presets.schema["pos"].dataType).alias("pos"), "id", "name", "body"))


def remove_presets(presets: DataFrame, gone: DataFrame) -> DataFrame:
    """presets without the (owner, id) in gone."""
    return presets.join(gone, ["owner", "id"], "left_anti")


def phase_timings(duration: Column, in_seconds: Column, out_seconds: Column, has_out: Column) -> Column:
    """struct(in_s, out_s): lengths of the phases of a caption: their own, or a share of the caption within
    bounds; half and two fifths of it at most, and nine tenths together."""
    good = F.coalesce((duration > 0) & ~F.isnan(duration), F.lit(False))
    d = F.when(good, duration).otherwise(F.lit(0.0))

    def within(x: Column, lo: float, hi: float) -> Column:
        return F.least(F.greatest(x, F.lit(lo)), F.lit(hi))

    first = F.least(F.coalesce(in_seconds, within(0.25 * d, 0.1, 0.45)), 0.5 * d)
    last = F.when(has_out, F.least(F.coalesce(out_seconds, within(0.2 * d, 0.08, 0.35)), 0.4 * d)).otherwise(F.lit(0.0))
    total = first + last
    scale = F.when(total > 0.9 * d, 0.9 * d / F.when(total > 0, total)).otherwise(F.lit(1.0))
    return F.struct((first * scale).alias("in_s"), (last * scale).alias("out_s"))


def animate_captions(captions: DataFrame, animations: DataFrame) -> DataFrame:
    """captions (animation_id, start, end) with in_s and out_s. animations: animation_id, in_seconds, out_seconds, has_out."""
    both = captions.join(animations, "animation_id")
    return both.withColumn("t", phase_timings(F.col("end") - F.col("start"), F.col("in_seconds"), F.col("out_seconds"), F.col("has_out"))).select(*captions.columns, "t.in_s", "t.out_s")


SPRING_FROM, SPRING_SHARE, DECAY, MOST_KEYS = 0.65, 0.35, 0.5, 4


def spring_keys(travels: DataFrame, *keys: str) -> DataFrame:
    """(keys, i, at, value): the keys that swing about the end of a travel, each a share of the overshoot, sides alternating.

    travels: keys, from_value, to_value, overshoot, keys_wanted, decay (null: DECAY). An overshoot of 1 or less has none.
    """
    n = F.least(F.greatest("keys_wanted", F.lit(0)), F.lit(MOST_KEYS))
    rows = travels.where("overshoot > 1").withColumn("n", n).where("n > 0").select("*", F.posexplode(F.sequence(F.lit(1), F.col("n"))).alias("p", "i"))
    size = (F.col("overshoot") - 1) * F.pow(F.coalesce("decay", F.lit(DECAY)), F.col("i") - 1)
    side = F.when(F.col("i") % 2 == 1, 1.0).otherwise(-1.0)
    value = F.col("to_value") + (F.col("to_value") - F.col("from_value")) * size * side
    at = SPRING_FROM + SPRING_SHARE * F.col("i") / (F.col("n") + 1)
    return rows.select(*keys, "i", at.alias("at"), value.alias("value"))
