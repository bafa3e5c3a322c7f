"""Registered queries on layers, timelines, presets, timecodes and names, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cuegrain.functions import scalars as S
from cuegrain.operators import presets as P
from cuegrain.operators import timeline as L
from cuegrain.plans import derived as d

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


LAY = f"WITH {d.LAYERS}, {d.TIMELINES}"
SOLO = "max(CASE WHEN solo THEN 1 ELSE 0 END) OVER (PARTITION BY comp_id) = 1"


@query("audible_layers", LAY + f"SELECT comp_id, layer_id FROM (SELECT *, {SOLO} AS any_solo FROM layers) WHERE has_audio AND (enabled OR solo) AND (NOT any_solo OR solo)")
def _(spark, sf):
    return L.audible_layers(d.layers(spark, sf)).select("comp_id", "layer_id")


RENDER = LAY + f""", ch AS (SELECT * REPLACE (CASE WHEN chosen THEN selected AND has_audio ELSE solo END AS solo) FROM (SELECT *, max(CASE WHEN selected AND has_audio THEN 1 ELSE 0 END) OVER (PARTITION BY comp_id) = 1 AS chosen FROM layers)),
 heard AS (SELECT * FROM (SELECT *, {SOLO} AS any_solo FROM ch) WHERE has_audio AND (enabled OR solo) AND (NOT any_solo OR solo))
"""


@query("render_source", RENDER + "SELECT t.comp_id, work_start AS start, work_duration AS duration, count(h.layer_id) AS audible, CASE WHEN count(h.layer_id) = 0 THEN 'no audible layer' END AS error FROM timelines t LEFT JOIN heard h USING (comp_id) GROUP BY 1, 2, 3")
def _(spark, sf):
    return L.render_source(d.layers(spark, sf), d.timelines(spark, sf), "inout")


IS_CAP = "coalesce(tag = 'caption', false)"


@query("caption_layers", LAY + f"SELECT comp_id, layer_id FROM layers WHERE {IS_CAP} AND trim(text) <> ''")
def _(spark, sf):
    return L.caption_layers(d.layers(spark, sf)).select("comp_id", "layer_id")


@query("clear_captions", LAY + f"SELECT comp_id, count(*) AS kept FROM layers WHERE NOT {IS_CAP} GROUP BY 1")
def _(spark, sf):
    return L.clear_captions(d.layers(spark, sf)).groupBy("comp_id").agg(F.count("*").alias("kept"))


@query("layer_times", LAY + f'SELECT comp_id, layer_id, name, round("end" - start, 6) AS duration FROM layers WHERE {IS_CAP} AND selected')
def _(spark, sf):
    return L.layer_times(d.layers(spark, sf), True).select("comp_id", "layer_id", "name", *r6("duration"))


@query("usable_range", "SELECT o_orderkey, o_orderkey % 11 - 3 >= 0 AND o_custkey % 4 > 0 AS usable FROM orders")
def _(spark, sf):
    return d.table(spark, sf, "orders").select("o_orderkey", L.usable_range(F.col("o_orderkey") % 11 - 3, F.col("o_custkey") % 4).alias("usable"))


ON_FRAME = "floor(({0}) / frame_duration + 0.5) * frame_duration"
PLACED = LAY + f""", pl AS (SELECT l.comp_id, layer_id, {ON_FRAME.format('start + start_time')} AS s, least({ON_FRAME.format('l."end" + start_time')}, {ON_FRAME.format('45.0')}) AS e, frame_duration FROM layers l JOIN timelines USING (comp_id) WHERE trim(text) <> '')
"""


@query("snap_and_widen", PLACED + 'SELECT comp_id, layer_id, round(s, 6) AS start, round(CASE WHEN e <= s THEN s + frame_duration ELSE e END, 6) AS "end" FROM pl')
def _(spark, sf):
    t = d.timelines(spark, sf).select("comp_id", "frame_duration")
    return L.place_captions(d.layers(spark, sf).join(t, "comp_id"), F.col("start_time"), F.lit(45.0)).select("comp_id", "layer_id", *r6("start", "end"))


@query("caption_position", LAY + "SELECT comp_id, layer_id, width * 0.5 AS x, round(height * (CASE WHEN layer_id % 2 = 0 THEN 0.85::DOUBLE ELSE CAST(layer_id % 10 AS DOUBLE) / 10 END), 6) AS y FROM layers JOIN timelines USING (comp_id)")
def _(spark, sf):
    y = F.when(F.col("layer_id") % 2 == 1, (F.col("layer_id") % 10) / 10.0)
    captions = d.layers(spark, sf).select("comp_id", "layer_id", y.alias("position_y"))
    return L.caption_position(captions, d.timelines(spark, sf)).select("comp_id", "layer_id", "x", *r6("y"))


RANGES = ", rg AS (SELECT comp_id, comp_id % 4 <> 3 AS scoped, work_start, work_duration FROM timelines)"


@query("replace_range", LAY + f"SELECT comp_id, layer_id FROM layers l WHERE {IS_CAP} AND NOT EXISTS (SELECT 1 FROM timelines t WHERE t.comp_id = l.comp_id AND l.start < work_start + work_duration AND l.\"end\" > work_start)")
def _(spark, sf):
    ranges = d.timelines(spark, sf).select("comp_id", F.col("work_start").alias("range_start"), (F.col("work_start") + F.col("work_duration")).alias("range_end"))
    existing = d.layers(spark, sf).where("tag = 'caption'")
    return L.outside_ranges(existing, ranges).select("comp_id", "layer_id")


REBUILD = LAY + RANGES + f""", ex AS (SELECT * FROM layers WHERE {IS_CAP}), nw AS (SELECT * FROM layers WHERE NOT {IS_CAP} AND has_audio AND comp_id % 25 <> 7), cn AS (SELECT comp_id, count(*) AS n_new FROM nw GROUP BY 1),
 rr AS (SELECT r.*, n_new, CASE WHEN scoped AND NOT (work_start >= 0 AND work_duration > 0) THEN 'unusable range' WHEN coalesce(n_new, 0) = 0 THEN 'no captions' END AS error FROM rg r LEFT JOIN cn USING (comp_id)),
 kp AS (SELECT * FROM ex e WHERE NOT EXISTS (SELECT 1 FROM rr WHERE rr.comp_id = e.comp_id AND error IS NULL AND (NOT scoped OR (e.start < work_start + work_duration AND e."end" > work_start))))
"""


def _rebuild(spark, sf):
    layers = d.layers(spark, sf)
    ranges = d.timelines(spark, sf).select("comp_id", (F.col("comp_id") % 4 != 3).alias("scoped"), F.col("work_start").alias("range_start"), F.col("work_duration").alias("range_duration"))
    return L.rebuild_captions(layers.where("tag IS NULL AND has_audio AND comp_id % 25 <> 7"), layers.where("tag = 'caption'"), ranges)


@query("rebuild_captions", REBUILD + "SELECT comp_id, layer_id, true AS is_new FROM nw WHERE comp_id IN (SELECT comp_id FROM rr WHERE error IS NULL) UNION ALL SELECT comp_id, layer_id, false FROM kp")
def _(spark, sf):
    return _rebuild(spark, sf)[0].select("comp_id", "layer_id", "is_new")


@query("rebuild_report", REBUILD + """, hs AS (SELECT e.comp_id, e.source_comp_id, scoped AND (e.start < work_start OR e."end" > work_start + work_duration) AS cuts FROM ex e JOIN rr ON rr.comp_id = e.comp_id AND error IS NULL AND (NOT scoped OR (e.start < work_start + work_duration AND e."end" > work_start)) WHERE e.source_comp_id IS NOT NULL)
 SELECT comp_id, CASE WHEN error IS NULL THEN coalesce(n_new, 0) ELSE 0 END AS added, (SELECT count(*) FROM ex WHERE ex.comp_id = rr.comp_id) - (SELECT count(*) FROM kp WHERE kp.comp_id = rr.comp_id) AS replaced, error,
 coalesce((SELECT bool_or(cuts) FROM hs WHERE hs.comp_id = rr.comp_id), false) AS cuts_nested, (SELECT count(*) FROM ex WHERE source_comp_id IS NULL AND ex.comp_id IN (SELECT source_comp_id FROM hs WHERE hs.comp_id = rr.comp_id)) AS nested_lost FROM rr""")
def _(spark, sf):
    return _rebuild(spark, sf)[1]


#: A timeline for each customer, a layer for each order; a customer's first order holds the next customer's timeline.
#: A chain ends at every 25th customer, so results grow with the orders; no level is cut.
NESTED = """WITH RECURSIVE cl AS (SELECT o_custkey AS comp_id, o_orderkey AS layer_id, 'order ' || o_orderkey AS text, CAST(o_orderkey % 9000 AS DOUBLE) / 1000.0::DOUBLE AS start, CAST(o_orderkey % 9000 + 400 AS DOUBLE) / 1000.0::DOUBLE AS "end",
    CAST(o_custkey % 50 AS DOUBLE) / 4.0::DOUBLE AS start_time, CASE WHEN o_custkey % 25 <> 0 AND o_orderkey = min(o_orderkey) OVER (PARTITION BY o_custkey) THEN o_custkey + 1 END AS source_comp_id FROM orders),
 hd AS (SELECT comp_id AS from_id, source_comp_id, start_time FROM cl WHERE source_comp_id IS NOT NULL),
 tree AS (SELECT DISTINCT comp_id AS root_id, comp_id, 0 AS depth, 0.0::DOUBLE AS "offset" FROM cl UNION ALL SELECT root_id, source_comp_id, depth + 1, "offset" + start_time FROM tree JOIN hd ON from_id = comp_id)
"""


def _nested(spark, sf, chain: int = 25) -> DataFrame:
    first = F.col("o_orderkey") == F.min("o_orderkey").over(Window.partitionBy("o_custkey"))
    o = d.table(spark, sf, "orders").withColumn("first", first)
    return o.selectExpr("o_custkey AS comp_id", "o_orderkey AS layer_id", "concat('layer ', o_orderkey) AS name", "'caption' AS tag", "concat('order ', o_orderkey) AS text", "CAST(o_orderkey % 9000 AS DOUBLE) / 1000.0D AS start", "CAST(o_orderkey % 9000 + 400 AS DOUBLE) / 1000.0D AS end", "CAST(o_custkey % 50 AS DOUBLE) / 4.0D AS start_time", f"CASE WHEN first AND o_custkey % {chain} <> 0 THEN o_custkey + 1 END AS source_comp_id")


@query("flatten_hierarchy", NESTED + 'SELECT root_id, depth, layer_id, text, round(l.start + "offset", 6) AS start, round(l."end" + "offset", 6) AS "end" FROM tree JOIN cl l ON l.comp_id = tree.comp_id WHERE source_comp_id IS NULL')
def _(spark, sf):
    layers = _nested(spark, sf)
    roots = layers.select(F.col("comp_id").alias("root_id")).distinct()
    return L.flatten_captions(layers, roots)[0].select("root_id", "depth", "layer_id", "text", *r6("start", "end"))


#: The same with chains of 20 customers.
WHOLE_NESTED = """WITH RECURSIVE cl AS (SELECT o_custkey AS comp_id, o_orderkey AS layer_id, 'order ' || o_orderkey AS text, CAST(o_orderkey % 9000 AS DOUBLE) / 1000.0::DOUBLE AS start, CAST(o_orderkey % 9000 + 400 AS DOUBLE) / 1000.0::DOUBLE AS "end",
    CAST(o_custkey % 50 AS DOUBLE) / 4.0::DOUBLE AS start_time, CASE WHEN o_custkey % 20 <> 0 AND o_orderkey = min(o_orderkey) OVER (PARTITION BY o_custkey) THEN o_custkey + 1 END AS source_comp_id FROM orders),
 hd AS (SELECT comp_id AS from_id, source_comp_id, start_time FROM cl WHERE source_comp_id IS NOT NULL),
 tree AS (SELECT DISTINCT comp_id AS root_id, comp_id, 0 AS depth, 0.0::DOUBLE AS "offset" FROM cl UNION ALL SELECT root_id, source_comp_id, depth + 1, "offset" + start_time FROM tree JOIN hd ON from_id = comp_id)
"""


@query("flatten_whole_hierarchy", WHOLE_NESTED + 'SELECT root_id, depth, layer_id, text, round(l.start + "offset", 6) AS start, round(l."end" + "offset", 6) AS "end" FROM tree JOIN cl l ON l.comp_id = tree.comp_id WHERE source_comp_id IS NULL')
def _(spark, sf):
    layers = _nested(spark, sf, 20)
    roots = layers.select(F.col("comp_id").alias("root_id")).distinct()
    return L.flatten_captions(layers, roots)[0].select("root_id", "depth", "layer_id", "text", *r6("start", "end"))


STYLED = LAY + """, st AS (SELECT comp_id, layer_id, 'font' || layer_id % 3 AS font, CASE WHEN layer_id % 2 = 0 THEN [1.0::DOUBLE, 0.0::DOUBLE] END AS fill, CAST(layer_id % 5 AS DOUBLE) AS "leading" FROM layers WHERE tag = 'caption')"""


def _styled(spark, sf) -> DataFrame:
    captions = d.layers(spark, sf).where("tag = 'caption'").selectExpr("comp_id", "layer_id", "concat('font', layer_id % 3) AS font", "CAST(layer_id % 40 AS DOUBLE) AS size", "CASE WHEN layer_id % 2 = 0 THEN array(1.0D, 0.0D) END AS fill", "10.0D AS position_x", "CAST(layer_id % 100 AS DOUBLE) AS position_y")
    captions = captions.selectExpr("*", "layer_id % 7 AS tracking", "CAST(layer_id % 5 AS DOUBLE) AS leading", "'left' AS justification", "layer_id % 2 = 0 AS apply_fill", "true AS apply_stroke", "array(0.0D, 0.0D) AS stroke", "2.0D AS stroke_width", "true AS stroke_over_fill", "array(100.0D, 100.0D) AS scale")
    style = {"font": "", "size": 48.0, "position_x": 960.0, "position_y": 810.0, "source_width": 1920, "source_height": 1080}
    style |= {"tracking": 0, "leading": None, "justification": "center", "apply_fill": False, "apply_stroke": False, "stroke": [1.0, 0.5], "stroke_width": 0.0, "stroke_over_fill": False, "scale": [80.0, 90.0]}
    return L.sync_style(captions, style, d.timelines(spark, sf))


_joined = lambda c: F.array_join(F.transform(c, lambda x: x.cast("string")), ",")


@query("style_sync", STYLED + """ SELECT comp_id, layer_id, font, 48.0::DOUBLE AS size, array_to_string(fill, ',') AS fill, round(960.0 * (width / 1920), 6) AS position_x, round(810.0 * (height / 1080), 6) AS position_y,
    0::BIGINT AS tracking, "leading", 'center' AS justification, false AS apply_fill, false AS apply_stroke, '1.0,0.5' AS stroke, 0.0::DOUBLE AS stroke_width, false AS stroke_over_fill, '80.0,90.0' AS scale FROM st JOIN timelines USING (comp_id)""")
def _(spark, sf):
    plain = ("tracking", "leading", "justification", "apply_fill", "apply_stroke", "stroke_width", "stroke_over_fill")
    return _styled(spark, sf).select("comp_id", "layer_id", "font", "size", *[_joined(c).alias(c) for c in ("fill", "stroke", "scale")], *r6("position_x", "position_y"), *plain)


@query("style_report", STYLED + " SELECT count(*) AS updated, count(DISTINCT comp_id) AS comps, CASE WHEN count(*) = 0 THEN 'no captions' END AS error FROM st JOIN timelines USING (comp_id)")
def _(spark, sf):
    return L.sync_report(_styled(spark, sf))


# --- presets -------------------------------------------------------------------------------------


def _preset_files(spark, sf) -> DataFrame:
    """A file of four presets per customer: some lack names or a phase, repeat ids, say that they are not custom, have odd phases or are cut short."""
    c = d.table(spark, sf, "customer")
    kinds = [',"in":{"seconds":0.%}', ',"description":"plain"', ',"in":{"properties":[1]},"out":null', ',"out":{"properties":{}}', ',"in":"{x"', ',"custom":false,"in":{"a":{"properties":null},"properties":[]}', ',"in":{"a":{"properties":null},"properties":{}}', ',"out":{"properties":null}']
    body = lambda i: f"CASE (c_custkey + {i}) % {len(kinds)} " + " ".join(f"WHEN {k} THEN '{x.replace('%', str(i + 1))}'" for k, x in enumerate(kinds)) + " END"
    one = lambda i: f"concat('{{\"id\":\"p', (c_custkey + {i}) % 3, '\",\"name\":', CASE WHEN (c_custkey + {i}) % 7 = 0 THEN 'null' ELSE concat('\"Preset ', c_custkey % 5, ' {i}\"') END, {body(i)}, '}}')"
    text = f"concat('{{\"version\":1,\"presets\":[', {one(0)}, ',', {one(1)}, ',', {one(2)}, ',', {one(3)}, CASE WHEN c_custkey % 11 = 0 THEN '' ELSE ']}}' END)"
    return c.selectExpr("c_custkey AS file", f"{text} AS content")


PRESETS = """WITH pf AS (SELECT c_custkey AS file, i AS pos, 'p' || (c_custkey + i) % 3 AS id, CASE WHEN (c_custkey + i) % 7 = 0 THEN NULL ELSE 'Preset ' || c_custkey % 5 || ' ' || i END AS name,
    CASE (c_custkey + i) % 8 WHEN 0 THEN ',"in":{"seconds":0.' || (i + 1) || '},"custom":true' WHEN 1 THEN ',"description":"plain","custom":true' WHEN 2 THEN ',"in":{"properties":[1]},"out":null,"custom":true'
        WHEN 5 THEN ',"custom":true,"in":{"a":{"properties":null},"properties":[]}' END AS rest FROM customer, unnest(range(0, 4)) AS u(i) WHERE c_custkey % 11 <> 0),
ps AS (SELECT file, CAST(pos AS INT) AS pos, id, name, rest FROM pf WHERE name IS NOT NULL AND rest IS NOT NULL QUALIFY row_number() OVER (PARTITION BY file, id ORDER BY pos) = 1)
"""


@query("preset_scan", PRESETS + "SELECT file, pos, id, name, true AS custom FROM ps")
def _(spark, sf):
    return P.scan_presets(_preset_files(spark, sf)).select("file", "pos", "id", "name", "custom")


@query("preset_write", PRESETS + """SELECT file, '{"version":1,"presets":[' || string_agg('{"id":"' || id || '","name":"' || name || '"' || rest || '}', ',' ORDER BY pos) || ']}' AS content FROM ps GROUP BY 1""")
def _(spark, sf):
    return P.write_presets(P.scan_presets(_preset_files(spark, sf)), "file")


@query("preset_override", "SELECT 'p' || p_partkey AS id, p_name AS name, 0 AS part FROM part WHERE 'p' || p_partkey NOT IN (SELECT 'p' || c_custkey // 2 FROM customer) UNION ALL SELECT 'p' || c_custkey // 2, c_name, 1 FROM customer")
def _(spark, sf):
    built_in = d.table(spark, sf, "part").selectExpr("concat('p', p_partkey) AS id", "p_name AS name")
    user = d.table(spark, sf, "customer").selectExpr("concat('p', c_custkey div 2) AS id", "c_name AS name")
    return P.preset_library(built_in, user)


UPSERT = PRESETS + """, old AS (SELECT file AS owner, pos, id, name, 'old' AS body FROM ps), nw AS (SELECT c_custkey AS owner, 'p' || c_custkey % 6 AS id, ' PRESET ' || c_custkey % 5 || ' ' || c_custkey % 9 || ' ' AS name, 'new' AS body FROM customer WHERE c_custkey % 2 = 0),
 mk AS (SELECT o.*, n.id AS n_id, n.name AS n_name, n.body AS n_body, coalesce(o.id = n.id OR lower(trim(o.name)) = lower(trim(n.name)), false) AS mt FROM old o LEFT JOIN nw n USING (owner)),
 hits AS (SELECT *, mt AND sum(CASE WHEN mt THEN 1 ELSE 0 END) OVER (PARTITION BY owner ORDER BY pos) = 1 AS hit FROM mk)
"""


@query("preset_upsert", UPSERT + "SELECT owner, pos, CASE WHEN hit THEN n_id ELSE id END AS id, CASE WHEN hit THEN n_name ELSE name END AS name, CASE WHEN hit THEN n_body ELSE body END AS body FROM hits UNION ALL SELECT owner, coalesce((SELECT max(pos) + 1 FROM old WHERE old.owner = nw.owner), 0), id, name, body FROM nw WHERE owner NOT IN (SELECT owner FROM hits WHERE hit)")
def _(spark, sf):
    old = P.scan_presets(_preset_files(spark, sf)).select(F.col("file").alias("owner"), "pos", "id", "name", F.lit("old").alias("body"))
    new = d.table(spark, sf, "customer").where("c_custkey % 2 = 0").selectExpr("c_custkey AS owner", "concat('p', c_custkey % 6) AS id", "concat(' PRESET ', c_custkey % 5, ' ', c_custkey % 9, ' ') AS name", "'new' AS body")
    return P.upsert_presets(old, new)


@query("preset_remove", PRESETS + "SELECT file AS owner, pos, id FROM ps WHERE NOT (id = 'p' || file % 2)")
def _(spark, sf):
    old = P.scan_presets(_preset_files(spark, sf)).select(F.col("file").alias("owner"), "pos", "id")
    gone = d.table(spark, sf, "customer").selectExpr("c_custkey AS owner", "concat('p', c_custkey % 2) AS id")
    return P.remove_presets(old, gone).select("owner", "pos", "id")


TIMED = LAY + """, an AS (SELECT CAST(r_regionkey AS BIGINT) AS animation_id, CASE WHEN r_regionkey % 2 = 0 THEN r_regionkey / 4.0::DOUBLE END AS in_seconds, CASE WHEN r_regionkey % 3 = 0 THEN r_regionkey / 8.0::DOUBLE END AS out_seconds, r_regionkey <> 4 AS has_out FROM region),
 du AS (SELECT comp_id, layer_id, (CASE WHEN layer_id % 19 = 0 THEN 0.0::DOUBLE ELSE "end" - start END) AS dur, a.* FROM layers JOIN an a ON a.animation_id = layer_id % 5),
 fl AS (SELECT *, least(coalesce(in_seconds, least(greatest(0.25::DOUBLE * dur, 0.1), 0.45)), 0.5::DOUBLE * dur) AS i, CASE WHEN has_out THEN least(coalesce(out_seconds, least(greatest(0.2::DOUBLE * dur, 0.08), 0.35)), 0.4::DOUBLE * dur) ELSE 0 END AS o FROM du)
"""


@query("animation_join", TIMED + "SELECT comp_id, layer_id, round(i * (CASE WHEN i + o > 0.9::DOUBLE * dur THEN 0.9::DOUBLE * dur / nullif(i + o, 0) ELSE 1 END), 6) AS in_s, round(o * (CASE WHEN i + o > 0.9::DOUBLE * dur THEN 0.9::DOUBLE * dur / nullif(i + o, 0) ELSE 1 END), 6) AS out_s FROM fl")
def _(spark, sf):
    end = F.when(F.col("layer_id") % 19 == 0, F.col("start")).otherwise(F.col("end"))
    captions = d.layers(spark, sf).select("comp_id", "layer_id", (F.col("layer_id") % 5).alias("animation_id"), "start", end.alias("end"))
    animations = d.table(spark, sf, "region").selectExpr("CAST(r_regionkey AS BIGINT) AS animation_id", "CASE WHEN r_regionkey % 2 = 0 THEN r_regionkey / 4.0D END AS in_seconds", "CASE WHEN r_regionkey % 3 = 0 THEN r_regionkey / 8.0D END AS out_seconds", "r_regionkey <> 4 AS has_out")
    return P.animate_captions(captions, animations).select("comp_id", "layer_id", *r6("in_s", "out_s"))


@query("spring_keys", "SELECT p_partkey, CAST(i AS INT) AS i, round(0.65::DOUBLE + 0.35::DOUBLE * i / (n + 1), 6) AS at, round(100.0::DOUBLE + 80.0::DOUBLE * (ov - 1) * pow(0.5::DOUBLE, i - 1) * (CASE WHEN i % 2 = 1 THEN 1 ELSE -1 END), 6) AS value FROM (SELECT p_partkey, 1.0::DOUBLE + CAST(p_size % 5 AS DOUBLE) / 10 AS ov, least(p_partkey % 6, 4) AS n FROM part), unnest(range(1, 5)) AS u(i) WHERE ov > 1 AND i <= n")
def _(spark, sf):
    travels = d.table(spark, sf, "part").selectExpr("p_partkey", "20.0D AS from_value", "100.0D AS to_value", "1.0D + CAST(p_size % 5 AS DOUBLE) / 10 AS overshoot", "CAST(p_partkey % 6 AS INT) AS keys_wanted", "CAST(NULL AS DOUBLE) AS decay")
    return P.spring_keys(travels, "p_partkey").select("p_partkey", "i", *r6("at", "value"))


# --- scalars -------------------------------------------------------------------------------------

#: One time per order, at each timeline's rate; every second one is flagged drop-frame at 29.97 or 59.94.
TIMES = """WITH tm AS (SELECT o_orderkey, CAST((o_orderkey * 7919) % 4000000 AS DOUBLE) / 1000.0::DOUBLE AS t, CASE o_orderkey % 5 WHEN 0 THEN 24.0::DOUBLE WHEN 1 THEN 25.0::DOUBLE WHEN 2 THEN 29.97::DOUBLE WHEN 3 THEN 59.94::DOUBLE ELSE 30.0::DOUBLE END AS rate, o_orderkey % 2 = 0 AS flagged FROM orders),
fd AS (SELECT *, 1.0::DOUBLE / rate AS frame_duration, CAST(floor(rate + 0.5) AS BIGINT) AS base, flagged AND floor(rate + 0.5) IN (30, 60) AND abs(rate - floor(rate + 0.5)) > 0.001 AS dropped FROM tm)
"""


def _times(spark, sf) -> DataFrame:
    rate = "CASE o_orderkey % 5 WHEN 0 THEN 24.0D WHEN 1 THEN 25.0D WHEN 2 THEN 29.97D WHEN 3 THEN 59.94D ELSE 30.0D END"
    t = d.table(spark, sf, "orders").selectExpr("o_orderkey", "CAST((o_orderkey * 7919) % 4000000 AS DOUBLE) / 1000.0D AS t", f"{rate} AS rate", "o_orderkey % 2 = 0 AS flagged")
    return t.withColumn("frame_duration", F.expr("1.0D / rate"))


@query("snap", TIMES + "SELECT o_orderkey, round(floor(t / frame_duration + 0.5) * frame_duration, 6) AS snapped FROM fd")
def _(spark, sf):
    return _times(spark, sf).select("o_orderkey", F.round(S.snap(F.col("t"), F.col("frame_duration")), 6).alias("snapped"))


@query("timebase", TIMES + "SELECT o_orderkey, base, dropped FROM fd")
def _(spark, sf):
    return _times(spark, sf).select("o_orderkey", S.frame_base(F.col("rate")).alias("base"), S.drops_frames(F.col("rate"), F.col("flagged")).alias("dropped"))


CODES = TIMES + """, fr AS (SELECT *, CAST(floor((t + 3600) / frame_duration + 0.5) AS BIGINT) AS f, CASE WHEN base = 60 THEN 4 ELSE 2 END AS lost FROM fd),
 nn AS (SELECT *, CASE WHEN dropped THEN f + lost * 9 * (f // (base * 600 - lost * 9)) + (CASE WHEN f % (base * 600 - lost * 9) > lost THEN lost * ((f % (base * 600 - lost * 9) - lost) // (base * 60 - lost)) ELSE 0 END) ELSE f END AS n FROM fr),
 codes AS (SELECT *, lpad(CAST(n // (base * 3600) AS VARCHAR), 2, '0') || ':' || lpad(CAST(n // (base * 60) % 60 AS VARCHAR), 2, '0') || ':' || lpad(CAST(n // base % 60 AS VARCHAR), 2, '0') || (CASE WHEN dropped THEN ';' ELSE ':' END) || lpad(CAST(n % base AS VARCHAR), 2, '0') AS code FROM nn)
"""


@query("format_timecode", CODES + "SELECT o_orderkey, code FROM codes")
def _(spark, sf):
    return _times(spark, sf).select("o_orderkey", S.format_timecode(F.col("t"), F.col("rate"), F.col("frame_duration"), F.col("flagged"), F.lit(3600.0)).alias("code"))


@query("parse_timecode", CODES + "SELECT o_orderkey, round(floor((t + 3600) / frame_duration + 0.5) * frame_duration - 3600, 5) AS seconds, CAST(NULL AS VARCHAR) AS error FROM codes")
def _(spark, sf):
    rate, fd, flagged = F.col("rate"), F.col("frame_duration"), F.col("flagged")
    coded = _times(spark, sf).withColumn("code", S.format_timecode(F.col("t"), rate, fd, flagged, F.lit(3600.0)))
    parsed = S.parse_timecode(F.col("code"), F.lit(0.0), rate, fd, flagged, F.lit(3600.0))
    return coded.select("o_orderkey", parsed.alias("p")).select("o_orderkey", F.round("p.seconds", 5).alias("seconds"), "p.error")


TYPED = TIMES + """, ty AS (SELECT o_orderkey, frame_duration AS f, base, dropped, o_orderkey % 10 AS kind, o_orderkey % 90 AS n FROM fd),
 rd AS (SELECT *, CASE kind WHEN 0 THEN 10.0 + n * f WHEN 1 THEN n + 0.5 - 3.0 WHEN 2 THEN 0.5 - 3.0 WHEN 3 THEN n * f - 3.0
    WHEN 4 THEN ((1 * 60 + 12) * 60 + 75) * base * f - (CASE WHEN dropped THEN (CASE WHEN base = 60 THEN 4 ELSE 2 END) * (72 - 7) ELSE 0 END) * f - 3.0
    WHEN 5 THEN (n * base + 3) * f - 3.0 END AS raw FROM ty),
 sn AS (SELECT *, CASE WHEN kind IN (0, 1, 2) THEN floor(raw / f + 0.5) * f ELSE raw END AS sec FROM rd)
"""


@query("typed_timecode", TYPED + """SELECT o_orderkey, CASE WHEN sec >= -1e-6 THEN round(greatest(sec, 0), 4) END AS seconds,
    CASE kind WHEN 6 THEN 'nothing to nudge from' WHEN 7 THEN 'too many digits' WHEN 8 THEN 'not a time' WHEN 9 THEN 'empty' ELSE CASE WHEN sec < -1e-6 THEN 'before the start' END END AS error FROM sn""")
def _(spark, sf):
    n, kind = F.col("o_orderkey") % 90, F.col("o_orderkey") % 10
    forms = [F.concat(F.lit("+ "), n), F.concat(n, F.lit(".5 S")), F.lit(".5s"), F.concat(n), F.lit("1:12;75.0"), F.concat(n, F.lit(":3")), F.lit("-4"), F.lit("123456789"), F.lit("1:2:3:4:5"), F.lit("  ")]
    typed = F.get(F.array(*[f.cast("string") for f in forms]), kind.cast("int"))
    parsed = S.parse_timecode(typed, F.when(kind != 6, F.lit(10.0)), F.col("rate"), F.col("frame_duration"), F.col("flagged"), F.lit(3.0))
    return _times(spark, sf).select("o_orderkey", parsed.alias("p")).select("o_orderkey", F.round("p.seconds", 4).alias("seconds"), "p.error")


@query("format_duration", TIMES + "SELECT o_orderkey, CAST(round(CAST(CASE WHEN o_orderkey % 9 = 0 THEN 0.0 ELSE t END AS DECIMAL(18, 6)), 2) AS DECIMAL(18, 2)) || 's' AS label FROM fd")
def _(spark, sf):
    return _times(spark, sf).select("o_orderkey", S.format_duration(F.when(F.col("o_orderkey") % 9 == 0, -F.col("t")).otherwise(F.col("t"))).alias("label"))


@query("word_count", "SELECT conv_id, turn, CAST(len(list_filter(string_split_regex(text, '\\s+'), lambda x: x <> '')) AS INT) AS words FROM conversations")
def _(spark, sf):
    return d.table(spark, sf, "conversations").select("conv_id", "turn", S.word_count(F.col("text")).alias("words"))


@query("occurrences", "SELECT conv_id, turn, CAST((length(text) - length(replace(text, 'en', ''))) / 2 AS BIGINT) AS n FROM conversations")
def _(spark, sf):
    return d.table(spark, sf, "conversations").select("conv_id", "turn", S.occurrences(F.col("text"), F.lit("en"), True).alias("n"))


@query("occurrence_positions", "SELECT conv_id, turn, array_to_string(list_transform(range(1, len(p)), lambda i: length(array_to_string(p[1:i], 'en'))), ',') AS places FROM (SELECT conv_id, turn, string_split(text, 'en') AS p FROM conversations)")
def _(spark, sf):
    places = S.occurrence_positions(F.col("text"), F.lit("en"), True)
    return d.table(spark, sf, "conversations").select("conv_id", "turn", F.array_join(F.transform(places, lambda x: x.cast("string")), ",").alias("places"))


@query("safe_file_name", "SELECT page_id, CASE WHEN s = '' THEN 'captions' ELSE s END AS name FROM (SELECT page_id, regexp_replace(trim(regexp_replace(url || (CASE WHEN page_id % 3 = 0 THEN ' .. ' ELSE '' END), '[\\\\/:*?\"<>|\\r\\n]+', '-', 'g')), '[. ]+$', '') AS s FROM pages)")
def _(spark, sf):
    url = F.concat("url", F.when(F.col("page_id") % 3 == 0, " .. ").otherwise(""))
    return d.table(spark, sf, "pages").select("page_id", S.safe_file_name(url).alias("name"))


@query("layer_name", LAY + "SELECT comp_id, layer_id, coalesce(nullif(trim(regexp_replace(text, '[\\r\\n]+', ' ', 'g')), ''), name) AS shown FROM layers")
def _(spark, sf):
    return d.layers(spark, sf).select("comp_id", "layer_id", S.layer_name(F.col("text"), F.col("name")).alias("shown"))


@query("frames_to_seconds", "SELECT o_orderkey, round(CASE WHEN o_orderkey % 50 - 3 > 0 THEN (o_orderkey % 50 - 3) / (CASE WHEN o_orderkey % 4 = 0 THEN 30.0::DOUBLE ELSE o_orderkey % 4 * 12.0::DOUBLE END) ELSE 0 END, 6) AS seconds FROM orders")
def _(spark, sf):
    k = F.col("o_orderkey")
    return d.table(spark, sf, "orders").select("o_orderkey", F.round(S.frames_to_seconds((k % 50 - 3).cast("double"), (k % 4 * 12).cast("double")), 6).alias("seconds"))


@query("preset_slug", "SELECT p_partkey, substring(regexp_replace(regexp_replace(lower(substring(trim(p_name), 1, 60)), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g'), 1, 32) AS slug FROM part")
def _(spark, sf):
    return d.table(spark, sf, "part").select("p_partkey", S.preset_slug(F.col("p_name")).alias("slug"))


@query("preset_id", "SELECT p_partkey, substring(regexp_replace(regexp_replace(lower(substring(trim(p_name), 1, 60)), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g'), 1, 32) || '-' || lower(to_base(p_partkey * 1000003, 36)) AS id FROM part")
def _(spark, sf):
    return d.table(spark, sf, "part").select("p_partkey", S.preset_id(F.col("p_name"), F.col("p_partkey") * 1000003).alias("id"))


@query("version_compare", "SELECT o_orderkey, 0 + o_orderkey % 4 AS major, (CASE WHEN o_orderkey % 5 = 4 THEN 0 ELSE o_orderkey % 5 END) AS minor, CASE WHEN o_orderkey % 3 = 0 THEN 0 ELSE 1 END AS release FROM orders")
def _(spark, sf):
    text = "concat(CASE WHEN o_orderkey % 2 = 0 THEN 'v' ELSE '' END, o_orderkey % 4, '.', CASE WHEN o_orderkey % 5 = 4 THEN 'x' ELSE CAST(o_orderkey % 5 AS STRING) END, CASE WHEN o_orderkey % 3 = 0 THEN '-beta.2' ELSE '' END)"
    key = S.version_key(F.expr(text))
    return d.table(spark, sf, "orders").select("o_orderkey", key.alias("k")).select("o_orderkey", *[F.coalesce(F.get("k.numbers", F.lit(i))["text"].try_cast("int"), F.lit(0)).alias(n) for i, n in enumerate(("major", "minor"))], "k.release")


VERSIONS = """WITH v AS (SELECT o_orderkey, o_orderkey % 3 AS a1, o_orderkey % 2 AS a4, CASE o_orderkey % 4 WHEN 0 THEN 'alpha' WHEN 1 THEN 'beta.2' ELSE '' END AS ap,
    o_custkey % 3 AS b1, o_custkey % 2 AS b4, CASE o_custkey % 4 WHEN 0 THEN 'alpha' WHEN 1 THEN 'beta.2' ELSE '' END AS bp FROM orders)
"""


@query("version_order", VERSIONS + """SELECT o_orderkey, CAST(CASE WHEN (a1, a4) < (b1, b4) THEN -1 WHEN (a1, a4) > (b1, b4) THEN 1 WHEN ap = bp THEN 0 WHEN ap = '' THEN 1 WHEN bp = '' THEN -1 WHEN ap < bp THEN -1 ELSE 1 END AS INT) AS sign FROM v""")
def _(spark, sf):
    text = "concat('v', {0} % 3, '.0.x', CASE WHEN {0} % 2 = 1 THEN '.1' ELSE '.0.0' END, CASE {0} % 4 WHEN 0 THEN '-alpha' WHEN 1 THEN '-beta.2' ELSE '' END)"
    a, b = F.expr(text.format("o_orderkey")), F.expr(text.format("o_custkey"))
    return d.table(spark, sf, "orders").select("o_orderkey", S.compare_versions(a, b).alias("sign"))


@query("stable_bare_word", f"WITH {d.WORDS} SELECT recording_id, idx, regexp_replace(lower(text), '[^a-z'']', '', 'g') AS bare FROM words")
def _(spark, sf):
    return d.words(spark, sf).select("recording_id", "idx", S.bare_word(F.col("text")).alias("bare"))
