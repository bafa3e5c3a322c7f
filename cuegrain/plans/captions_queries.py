"""Registered queries on captions, edits, segmentation and subtitle texts, with their SQL."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cuegrain.functions import scalars as S
from cuegrain.functions.scratch import cut, scratch_path
from cuegrain.operators import captions as C
from cuegrain.operators import segment as G
from cuegrain.plans import derived as d
from cuegrain.sources import subtitles as T
from cuegrain.streaming import segments as L

#: Files that a stream of words arrives in, and the micro-batches that read them.
STREAM_FILES, STREAM_BATCHES = 24, 3
#: When the recordings of the stream began, in milliseconds.
RECORDED = 1_700_000_000_000

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


def counted(n: int) -> str:
    return f"""WITH {d.WORDS},
grp AS (SELECT recording_id, idx // {n} AS caption_no, string_agg(text, ' ' ORDER BY idx) AS text, min_by(start, idx) AS start, max_by("end", idx) AS "end", count(*) AS n_words FROM words GROUP BY 1, 2),
cap AS (SELECT recording_id, CAST(caption_no AS BIGINT) AS caption_no, text, start, least("end" + 1.2::DOUBLE, coalesce(lead(start) OVER (PARTITION BY recording_id ORDER BY caption_no), 'infinity'::DOUBLE)) AS "end", n_words FROM grp)
"""


ROUGH = counted(2) + f""", {d.NATION_TIMELINES},
rough AS (SELECT recording_id AS comp_id, caption_no, CASE WHEN caption_no % 6 = 0 THEN text || chr(10) || ' ' ELSE text END AS text, start,
    CASE WHEN caption_no % 13 = 4 THEN start + 0.1::DOUBLE ELSE "end" + ((caption_no * 7) % 11 - 5) * 0.02::DOUBLE END AS "end", frame_duration, frame_rate, caption_no % 9 = 3 AS keyframed
    FROM cap JOIN timelines t ON t.comp_id = recording_id % 25)
"""


def rough_captions(spark, sf) -> DataFrame:
    """Two-word captions with overlaps, flickers and short ones among them; comp_id is the recording."""
    cap = G.segment_counts(d.words(spark, sf), 2)
    t = d.timelines(spark, sf, "nation").select(F.col("comp_id").alias("t_id"), "frame_duration", "frame_rate")
    both = cap.join(F.broadcast(t), F.col("recording_id") % 25 == F.col("t_id"))  # a row per nation
    end = F.when(F.col("caption_no") % 13 == 4, F.col("start") + 0.1).otherwise(F.col("end") + ((F.col("caption_no") * 7) % 11 - 5) * 0.02)
    text = F.when(F.col("caption_no") % 6 == 0, F.concat("text", F.lit("\n "))).otherwise(F.col("text"))
    return both.select(F.col("recording_id").alias("comp_id"), "caption_no", text.alias("text"), "start", end.alias("end"), "frame_duration", "frame_rate", (F.col("caption_no") % 9 == 3).alias("keyframed"))


def entry_query(spark, sf) -> DataFrame:
    found = C.caption_issues(rough_captions(spark, sf), "comp_id", "caption_no")
    return found.groupBy("comp_id", "kind").agg(F.count("*").alias("n"))


ISSUES = ROUGH + """,
gaps AS (SELECT *, CAST(floor((lead(start) OVER (PARTITION BY comp_id ORDER BY start, "end", caption_no) - "end") / frame_duration + 0.5) AS BIGINT) AS gap_frames, "end" - start AS seconds FROM rough),
issues AS (SELECT comp_id, caption_no, gap_frames, CASE WHEN gap_frames < 0 THEN 'overlap' ELSE 'flicker' END AS kind FROM gaps WHERE gap_frames < 0 OR gap_frames BETWEEN 1 AND 2
    UNION ALL SELECT comp_id, caption_no, gap_frames, 'short' FROM gaps WHERE seconds < 0.2::DOUBLE - frame_duration / 2
    UNION ALL SELECT comp_id, caption_no, gap_frames, 'fast' FROM gaps WHERE len(list_filter(string_split_regex(text, '\\s+'), lambda x: x <> '')) > 1 AND seconds > 0 AND length(text) / seconds > 20)
"""

QUERIES["issue_counts"] = entry_query
SQL["issue_counts"] = ISSUES + "SELECT comp_id, kind, count(*) AS n FROM issues GROUP BY 1, 2"


@query("caption_issues", ISSUES + "SELECT * FROM issues")
def _(spark, sf):
    return C.caption_issues(rough_captions(spark, sf), "comp_id", "caption_no")


for _n, _mode in ((1, "word"), (2, "two"), (3, "three")):

    @query(f"count_captions_{_mode}", counted(_n) + 'SELECT recording_id, caption_no, text, round(start, 6) AS start, round("end", 6) AS "end", n_words FROM cap')
    def _(spark, sf, mode=_mode):
        return G.segment(d.words(spark, sf), mode).select("recording_id", "caption_no", "text", *r6("start", "end"), "n_words")


@query("hold", counted(5) + 'SELECT recording_id, caption_no, round("end", 6) AS "end" FROM cap')
def _(spark, sf):
    return G.segment_counts(d.words(spark, sf), 5).select("recording_id", "caption_no", *r6("end"))


GAPS = f"""WITH {d.WORDS},
sp AS (SELECT *, lead(start) OVER (PARTITION BY recording_id ORDER BY idx) AS nxt, regexp_replace(lower(text), '[^a-z'']', '', 'g') AS bare FROM words),
nm AS (SELECT *, nxt - start AS span, min(CASE WHEN bare <> '' THEN nxt - start END) OVER (PARTITION BY recording_id, bare) AS normal FROM sp)
"""


@query("word_gaps", GAPS + "SELECT recording_id, idx, CASE WHEN nxt IS NOT NULL THEN round(greatest(0.0::DOUBLE, nxt - \"end\"), 6) END AS gap, round(CASE WHEN span IS NOT NULL AND NOT ends_with(text, '-') AND bare <> '' AND normal > 0 THEN span / normal ELSE 0 END, 6) AS held FROM nm")
def _(spark, sf):
    return G.word_gaps(d.words(spark, sf)).select("recording_id", "idx", F.round("gap", 6).alias("gap"), F.round("held", 6).alias("held"))


@query("word_baseline", GAPS + "SELECT DISTINCT recording_id, bare, round(normal, 6) AS normal FROM nm WHERE bare <> '' AND normal IS NOT NULL")
def _(spark, sf):
    spans = G.word_gaps(d.words(spark, sf)).withColumn("bare", S.bare_word(F.col("text")))
    by = spans.where("gap IS NOT NULL AND bare <> ''").select("recording_id", "bare", (F.col("end") + F.col("gap") - F.col("start")).alias("span"))
    return by.groupBy("recording_id", "bare").agg(F.round(F.min("span"), 6).alias("normal"))


@query("median_gap", GAPS + "SELECT recording_id, round(median(greatest(0.0::DOUBLE, nxt - \"end\")), 6) AS median_gap FROM nm WHERE nxt IS NOT NULL GROUP BY 1")
def _(spark, sf):
    gaps = G.word_gaps(d.words(spark, sf)).where("gap IS NOT NULL")
    return gaps.groupBy("recording_id").agg(F.round(F.median("gap"), 6).alias("median_gap"))


def segmented(o: G.Budget) -> str:
    """Segmentation as three recursions over lists of a recording's words: captions one after another, each looking ahead as far
    as its budgets let it; then words borrowed by short captions, in order; then lines of each caption."""
    floor = max(1, o.min_words)
    joined = "ahead[{1} + 1] - ahead[{0} + 1] - 1"
    ends = f"mark[b] = 2 OR b = n OR (raw[b] > {o.max_gap} AND (b - a >= {o.min_words} OR raw[b] > {o.hard_gap}))"
    full = f"{joined.format('a', '(b + 1)')} > {o.chars * o.lines} OR b - a >= {o.max_words} OR en[b + 1] - st[a + 1] > {o.max_seconds}"
    usual = "(CASE WHEN {1} - {0} > 1 THEN list_aggregate(gap[{0} + 1:{1} - 1], 'median') ELSE 0 END)"
    last_of = "list_sort(list_transform(list_filter(range(first, b + 1), lambda p: {0}[p] >= {1}), lambda p: {{'v': {0}[p], 'p': p}}), 'DESC')[1].p"
    stands_out = f"(raw[b] >= {G.GAP_LEAST}::DOUBLE AND raw[b] >= {G.GAP_TIMES}::DOUBLE * {usual.format('lo', 'b')})"
    fits = f"stop - b + 1 <= {o.max_words} AND {joined.format('(b - 1)', 'stop')} <= {o.chars * o.lines} AND en[stop] - st[b] <= {o.max_seconds}"
    wraps = f"len(done) <> {o.lines - 1 if o.lines > 1 else -1} AND line <> '' AND length(line || ' ' || ws[i + 1]) > {o.chars}"
    return GAPS.replace("WITH ", "WITH RECURSIVE ", 1) + f""",
 wd AS (SELECT recording_id, idx, text, start, "end", coalesce(greatest(0.0::DOUBLE, nxt - "end"), 0) AS gap, CASE WHEN span IS NOT NULL AND NOT ends_with(text, '-') AND bare <> '' AND normal > 0 THEN span / normal ELSE 0 END AS held,
    nxt - "end" AS raw, CASE WHEN regexp_matches(text, '[.!?]["'')\\]]?$') THEN 2 WHEN regexp_matches(text, '[,;:]["'')\\]]?$') THEN 1 ELSE 0 END AS mark, sum(length(text) + 1) OVER (PARTITION BY recording_id ORDER BY idx) AS upto FROM nm),
 ar AS MATERIALIZED (SELECT recording_id, count(*) AS n, list(idx ORDER BY idx) AS ids, list(text ORDER BY idx) AS tx, list(start ORDER BY idx) AS st, list("end" ORDER BY idx) AS en, list(gap ORDER BY idx) AS gap, list(held ORDER BY idx) AS held, list(raw ORDER BY idx) AS raw,
    list(mark ORDER BY idx) AS mark, list_prepend(0, list(upto ORDER BY idx)) AS ahead FROM wd GROUP BY 1),
 cp AS (SELECT recording_id, 0::BIGINT AS a, []::BIGINT[] AS ends FROM ar
    UNION ALL SELECT recording_id, coalesce(to_, b), list_append(ends, coalesce(to_, b)) FROM (
      SELECT *, CASE WHEN ({ends}) OR first > b THEN b ELSE coalesce(list_filter(range(first, b + 1), lambda p: mark[p] = 1)[-1], {last_of.format('gap', f'greatest({G.GAP_LEAST}::DOUBLE, {G.GAP_TIMES}::DOUBLE * usual)')}, {last_of.format('held', f'{G.HELD_TIMES}::DOUBLE')}, b) END AS to_ FROM (
      SELECT *, greatest(a + {floor}, a + CAST(ceil((b - a) / 2.0) AS BIGINT)) AS first, {usual.format('a', 'b')} AS usual FROM (
      SELECT cp.a, cp.ends, ar.*, list_filter(range(a + 1, least(n, a + {o.max_words}) + 1), lambda b: {ends} OR {full})[1] AS b FROM cp JOIN ar USING (recording_id) WHERE a < n)))),
 cut AS (SELECT recording_id, arg_max(ends, a) AS ends FROM cp GROUP BY 1),
 rb AS (SELECT recording_id, 1::BIGINT AS i, ends FROM cut
    UNION ALL SELECT recording_id, i + 1, CASE WHEN stop - b < {floor} AND b - lo > {floor} AND {fits} AND NOT (raw[b] > {o.max_gap} OR {stands_out} OR mark[b] = 2) THEN ends[:i - 1] || [b - 1] || ends[i + 1:] ELSE ends END FROM (
      SELECT rb.i, rb.ends, ar.*, CASE WHEN i > 1 THEN ends[i - 1] ELSE 0 END AS lo, ends[i] AS b, ends[i + 1] AS stop FROM rb JOIN ar USING (recording_id) WHERE i < len(ends))),
 gr AS (SELECT recording_id, arg_max(ends, i) AS ends FROM rb GROUP BY 1),
 ea AS (SELECT recording_id, unnest(range(1, len(ends) + 1)) AS c, ends FROM gr),
 cps AS (SELECT recording_id, c - 1 AS caption_no, CASE WHEN c > 1 THEN ends[c - 1] ELSE 0 END AS a, ends[c] AS b FROM ea),
 tc AS (SELECT recording_id, caption_no, array_to_string(tx[a + 1:b], ' ') AS text, st[a + 1] AS start, en[b] AS e0, ids[a + 1] AS first_idx, b - a AS n_words, tx[a + 1:b] AS ws FROM cps JOIN ar USING (recording_id)),
 wr AS (SELECT recording_id, caption_no, ws, 0 AS i, '' AS line, CAST([] AS VARCHAR[]) AS done FROM tc
    UNION ALL SELECT recording_id, caption_no, ws, i + 1, CASE WHEN ({wraps}) OR line = '' THEN ws[i + 1] ELSE line || ' ' || ws[i + 1] END, CASE WHEN {wraps} THEN list_append(done, line) ELSE done END FROM wr WHERE i < len(ws)),
 seg AS (SELECT tc.*, round(least(e0 + {C.HOLD_SECONDS}::DOUBLE, coalesce(lead(start) OVER (PARTITION BY tc.recording_id ORDER BY tc.caption_no), 'infinity'::DOUBLE)), 6) AS "end", array_to_string(list_append(done, line), '|') AS lines FROM tc JOIN wr ON wr.recording_id = tc.recording_id AND wr.caption_no = tc.caption_no AND i = len(wr.ws))
"""


_SEGMENT_BUDGETS = {"phrase": G.PHRASE, "sentence": G.sentence_budget("horizontal"), "smart": replace(G.PHRASE, min_words=2), "parts": G.PARTS}

for _mode in _SEGMENT_BUDGETS:

    @query(f"segment_{_mode}", segmented(_SEGMENT_BUDGETS[_mode]) + 'SELECT recording_id, caption_no, text, round(start, 6) AS start, "end", first_idx, n_words, lines FROM seg')
    def _(spark, sf, mode=_mode):
        tasks = d.word_tasks(spark, sf)
        got = G.segment(d.words(spark, sf, tasks), mode, tasks=tasks)
        return got.select("recording_id", "caption_no", "text", *r6("start", "end"), "first_idx", "n_words", F.array_join("lines", "|").alias("lines"))


@query("segment_vertical", segmented(replace(G.LAYOUTS["vertical"], min_words=2)) + 'SELECT recording_id, caption_no, text, round(start, 6) AS start, "end", lines FROM seg')
def _(spark, sf):
    tasks = d.word_tasks(spark, sf)
    got = G.segment(d.words(spark, sf, tasks), "smart", "vertical", tasks)
    return got.select("recording_id", "caption_no", "text", *r6("start", "end"), F.array_join("lines", "|").alias("lines"))


@query("live_segments", segmented(G.PHRASE) + 'SELECT recording_id, caption_no, text, round(start, 6) AS start, "end", first_idx, n_words, lines FROM seg')
def _(spark, sf):
    """The words as files in no order of their recordings, read as a stream some files at a time; captions go to a table."""
    words = cut(d.words(spark, sf), "words")
    spans = G.word_gaps(words).where("gap IS NOT NULL").select("recording_id", S.bare_word(F.col("text")).alias("bare"), (F.col("end") + F.col("gap") - F.col("start")).alias("span"))
    usual = spans.where("bare <> ''").groupBy("recording_id", "bare").agg(F.min("span").alias("normal"))
    ends = words.groupBy("recording_id").agg(F.max("idx").alias("last_idx"))
    sent = L.usual_lengths(words.join(ends, "recording_id"), usual).select("recording_id", "idx", "text", "start", "end", "usual", F.timestamp_millis(F.lit(RECORDED) + (F.col("start") * 1000).cast("long")).alias("at"), (F.col("idx") == F.col("last_idx")).alias("last"))
    arrived, shown = scratch_path(spark, "arrived"), scratch_path(spark, "shown")
    sent.repartition(STREAM_FILES, F.xxhash64("recording_id", "idx")).write.parquet(arrived)
    stream = spark.readStream.schema(sent.schema).option("maxFilesPerTrigger", STREAM_FILES // STREAM_BATCHES).parquet(arrived)
    captions = L.live_segments(stream, late="1000 days")  # the files are in no order, so no word is late
    captions.writeStream.format("parquet").option("checkpointLocation", f"{shown}-state").trigger(availableNow=True).start(shown).awaitTermination()
    got = spark.read.schema(captions.schema).parquet(shown)
    return got.select("recording_id", "caption_no", "text", *r6("start", "end"), "first_idx", "n_words", F.array_join("lines", "|").alias("lines"))


WRAP = """WITH RECURSIVE t AS (SELECT conv_id, turn, list_filter(string_split_regex(text, '\\s+'), lambda x: x <> '') AS ws FROM conversations),
 wr AS (SELECT conv_id, turn, ws, 0 AS i, '' AS line, CAST([] AS VARCHAR[]) AS done FROM t
 UNION ALL SELECT conv_id, turn, ws, i + 1,
    CASE WHEN len(done) < 2 AND line <> '' AND length(line || ' ' || ws[i + 1]) > 42 THEN ws[i + 1] WHEN line = '' THEN ws[i + 1] ELSE line || ' ' || ws[i + 1] END,
    CASE WHEN len(done) < 2 AND line <> '' AND length(line || ' ' || ws[i + 1]) > 42 THEN list_append(done, line) ELSE done END
    FROM wr WHERE i < len(ws))
"""


@query("wrap_lines", WRAP + "SELECT conv_id, turn, array_to_string(list_append(done, line), '|') AS lines FROM wr WHERE i = len(ws)")
def _(spark, sf):
    turns = d.table(spark, sf, "conversations")
    return turns.select("conv_id", "turn", F.array_join(G.wrap_lines(F.col("text"), 42, 3), "|").alias("lines"))


@query("choose_layout", """WITH t AS (SELECT o_orderkey, o_orderkey % 1999 AS width, o_custkey % 1499 AS height FROM orders)
 SELECT o_orderkey, CASE WHEN width <= 0 OR height <= 0 THEN 'unknown' WHEN width / height < 0.9 THEN 'vertical' WHEN width / height <= 1.2 THEN 'square' ELSE 'horizontal' END AS orientation FROM t""")
def _(spark, sf):
    return d.table(spark, sf, "orders").select("o_orderkey", G.orientation(F.col("o_orderkey") % 1999, F.col("o_custkey") % 1499).alias("orientation"))


@query("reading_speed", ROUGH + "SELECT comp_id, caption_no, CASE WHEN caption_no % 10 = 0 THEN 'infinity'::DOUBLE ELSE round(length(text) / (\"end\" - start), 6) END AS speed FROM rough")
def _(spark, sf):
    seconds = F.when(F.col("caption_no") % 10 == 0, 0.0).otherwise(F.col("end") - F.col("start"))
    return rough_captions(spark, sf).select("comp_id", "caption_no", F.round(S.reading_speed(F.length("text"), seconds), 6).alias("speed"))  # code points, as its SQL counts


@query("order_captions", ROUGH + 'SELECT comp_id, caption_no, row_number() OVER (PARTITION BY comp_id ORDER BY start, "end", caption_no) AS n FROM rough')
def _(spark, sf):
    return C.order_captions(rough_captions(spark, sf), "comp_id", "caption_no").select("comp_id", "caption_no", "n")


SNAP = "floor({0} / frame_duration + 0.5) * frame_duration"


@query("fix_overlaps", ROUGH + f""", g AS (SELECT *, lead(start) OVER p AS nxt, floor((lead(start) OVER p - "end") / frame_duration + 0.5) AS gf FROM rough WINDOW p AS (PARTITION BY comp_id ORDER BY start, "end", caption_no)),
 f AS (SELECT *, {SNAP.format('nxt')} AS ne FROM g WHERE gf < 0 OR gf BETWEEN 1 AND 2)
 SELECT comp_id, caption_no, CASE WHEN ne - start >= frame_duration / 2 THEN round(ne, 6) END AS new_end, ne - start < frame_duration / 2 AS unfixed FROM f""")
def _(spark, sf):
    return C.fix_overlaps(rough_captions(spark, sf), "comp_id", "caption_no").select("comp_id", "caption_no", *r6("new_end"), "unfixed")


@query("shift_captions", ROUGH + """, n AS (SELECT *, row_number() OVER (PARTITION BY comp_id ORDER BY start, "end", caption_no) AS n, count(*) OVER (PARTITION BY comp_id) AS size FROM rough),
 s AS (SELECT *, min(start - 30 * frame_duration) OVER (PARTITION BY comp_id) < -1e-6 AS bad FROM n WHERE n >= 30)
 SELECT comp_id, caption_no, round(CASE WHEN bad THEN start ELSE start - 30 * frame_duration END, 6) AS start, round(CASE WHEN bad THEN "end" ELSE "end" - 30 * frame_duration END, 6) AS "end", CASE WHEN bad THEN 'before the start' END AS error FROM s
 UNION ALL SELECT DISTINCT comp_id, NULL, NULL, NULL, 'no captions to shift' FROM n WHERE size < 30""")
def _(spark, sf):
    return C.shift_captions(rough_captions(spark, sf), "comp_id", "caption_no", 30, -30).select("comp_id", "caption_no", *r6("start", "end"), "error")


CLEAN = "trim(regexp_replace(regexp_replace(regexp_replace({0}, '\\r\\n?', chr(10), 'g'), '[ \\t]+\\n', chr(10), 'g'), '\\n[ \\t]+', chr(10), 'g'), ' ' || chr(10) || chr(9))"


@query("clean_text", ROUGH + f"SELECT comp_id, caption_no, {CLEAN.format('text')} AS clean FROM rough")
def _(spark, sf):
    return rough_captions(spark, sf).select("comp_id", "caption_no", S.clean_text(F.col("text")).alias("clean"))


@query("retext_edits", ROUGH + f", n AS (SELECT *, CASE WHEN caption_no % 5 = 0 THEN '  ' WHEN caption_no % 5 = 1 THEN text ELSE 'x' || text || ' ' END AS typed FROM rough) SELECT comp_id, caption_no, CASE WHEN {CLEAN.format('typed')} <> '' AND {CLEAN.format('typed')} <> {CLEAN.format('text')} THEN {CLEAN.format('typed')} END AS edit_text, CASE WHEN {CLEAN.format('typed')} = '' THEN 'empty text' END AS error FROM n")
def _(spark, sf):
    n = F.col("caption_no") % 5
    typed = rough_captions(spark, sf).withColumn("typed", F.when(n == 0, "  ").when(n == 1, F.col("text")).otherwise(F.concat(F.lit("x"), "text", F.lit(" "))))
    return C.retext_edits(typed, "typed").select("comp_id", "caption_no", "edit_text", "error")


@query("retime_edits", ROUGH + f""", n AS (SELECT *, {SNAP.format("(start - (caption_no % 4) * 0.013::DOUBLE)")} AS s2, {SNAP.format('("end" - (caption_no % 7) * 0.2::DOUBLE)')} AS e2 FROM rough),
 e AS (SELECT *, abs(s2 - start) >= frame_duration / 2 AS ms, abs(e2 - "end") >= frame_duration / 2 AS me FROM n),
 j AS (SELECT *, CASE WHEN ms AND s2 < -1e-6 THEN 'before the start' WHEN ms AND "end" - s2 < frame_duration / 2 THEN 'too short' END AS x1, CASE WHEN me AND start < -1e-6 THEN 'before the start' WHEN me AND e2 - start < frame_duration / 2 THEN 'too short' END AS x2 FROM e)
 SELECT comp_id, caption_no, round(CASE WHEN ms AND x1 IS NULL THEN s2 END, 6) AS edit_start, round(CASE WHEN me AND x2 IS NULL THEN e2 END, 6) AS edit_end, coalesce(x1, x2) AS error FROM j""")
def _(spark, sf):
    typed = rough_captions(spark, sf).withColumns({"s2": F.col("start") - (F.col("caption_no") % 4) * 0.013, "e2": F.col("end") - (F.col("caption_no") % 7) * 0.2})
    return C.retime_edits(typed, "s2", "e2").select("comp_id", "caption_no", *r6("edit_start", "edit_end"), "error")


#: Captions with line breaks between words, and characters of two UTF-16 units.
BROKEN = ROUGH + ", broken AS (SELECT * REPLACE (CASE WHEN caption_no % 4 = 0 THEN replace(text, ' ', chr(10)) WHEN caption_no % 7 = 0 THEN '😀' || text ELSE text END AS text) FROM rough)"


def broken_captions(spark, sf) -> DataFrame:
    n = F.col("caption_no")
    text = F.when(n % 4 == 0, F.translate("text", " ", "\n")).when(n % 7 == 0, F.concat(F.lit("😀"), "text")).otherwise(F.col("text"))
    return rough_captions(spark, sf).withColumn("text", text)


FOUND = BROKEN + ", found AS (SELECT *, CAST((length(text) - length(regexp_replace(text, '{0}', '', 'gi'))) / {1} AS BIGINT) AS matches FROM broken)"


@query("find_text", FOUND.format("th", 2) + "SELECT comp_id, caption_no, matches FROM found WHERE matches > 0")
def _(spark, sf):
    return C.find_text(broken_captions(spark, sf), "TH").select("comp_id", "caption_no", "matches")


def replaced(pattern: str, size: int, by: str) -> str:
    made = CLEAN.format(f"regexp_replace(text, '{pattern}', '{by}', 'gi')")
    return FOUND.format(pattern, size) + f", made AS (SELECT *, regexp_replace({made}, ' {{2,}}', ' ', 'g') AS new_text FROM found WHERE matches > 0), ref AS (SELECT *, max(CASE WHEN new_text = '' THEN 1 ELSE 0 END) OVER (PARTITION BY comp_id) = 1 AS refused FROM made)"


@query("replace_all", replaced("th", 2, "$z") + "SELECT comp_id, caption_no, new_text, refused FROM ref")
def _(spark, sf):
    return C.replace_all(broken_captions(spark, sf), "comp_id", "th", "$z").select("comp_id", "caption_no", "new_text", "refused")


@query("edit_counts", replaced("e[ \\n]t", 3, "e t") + "SELECT comp_id, CAST(sum(CASE WHEN refused THEN 0 ELSE matches END) AS BIGINT) AS replaced, count(*) FILTER (WHERE NOT refused AND text <> new_text) AS changed FROM ref GROUP BY 1")
def _(spark, sf):
    return C.edit_counts(C.replace_all(broken_captions(spark, sf), "comp_id", "e t", "e t"), "comp_id")


@query("split_caption", ROUGH + f""", o AS (SELECT *, CAST(caption_no % 9 AS INT) AS cutat FROM rough),
 h AS (SELECT *, {CLEAN.format('substring(text, 1, cutat)')} AS a, {CLEAN.format('substring(text, cutat + 1)')} AS b FROM o),
 p AS (SELECT *, a <> '' AND b <> '' AND "end" - start >= 1.5::DOUBLE * frame_duration AS ok FROM h),
 m0 AS (SELECT *, {SNAP.format('''(start + ("end" - start) * (CAST(length(a) AS DOUBLE) / (length(a) + length(b))))''')} AS m0 FROM p),
 m1 AS (SELECT *, CASE WHEN m0 < start + frame_duration THEN {SNAP.format("(start + frame_duration)")} ELSE m0 END AS m1 FROM m0),
 m AS (SELECT *, CASE WHEN m1 > "end" - frame_duration THEN {SNAP.format('("end" - frame_duration)')} ELSE m1 END AS mid FROM m1)
 SELECT comp_id, caption_no, 0 AS part, a AS text, round(start, 6) AS start, round(mid, 6) AS "end" FROM m WHERE ok UNION ALL SELECT comp_id, caption_no, 1, b, round(mid, 6), round("end", 6) FROM m WHERE ok
 UNION ALL SELECT comp_id, caption_no, NULL, text, round(start, 6), round("end", 6) FROM m WHERE NOT ok""")
def _(spark, sf):
    at = rough_captions(spark, sf).withColumn("at", (F.col("caption_no") % 9).cast("int"))
    return C.split_captions(at, "at").select("comp_id", "caption_no", "part", "text", *r6("start", "end"))


@query("merge_caption", ROUGH + f""", l AS (SELECT *, lead(text) OVER p AS nt, lead(start) OVER p AS ns, lead("end") OVER p AS ne, row_number() OVER p AS pos FROM rough WINDOW p AS (PARTITION BY comp_id ORDER BY start, "end", caption_no)),
 c AS (SELECT *, pos % 4 = 1 AND nt IS NOT NULL AS merges, pos % 4 = 2 AS goes FROM l)
 SELECT comp_id, caption_no, CASE WHEN merges THEN {CLEAN.format(CLEAN.format("text") + " || ' ' || " + CLEAN.format("nt"))} ELSE text END AS text, round(CASE WHEN merges THEN least(start, ns) ELSE start END, 6) AS start, round(CASE WHEN merges THEN greatest("end", ne) ELSE "end" END, 6) AS "end" FROM c WHERE NOT goes""")
def _(spark, sf):
    n = C.order_captions(rough_captions(spark, sf), "comp_id", "caption_no").withColumn("chosen", F.col("n") % 4 == 1)
    return C.merge_captions(n, "comp_id", "caption_no", "chosen").select("comp_id", "caption_no", "text", *r6("start", "end"))


BODY = "trim(regexp_replace({0}, '\\r\\n?', chr(10), 'g'), ' ' || chr(10) || chr(9))"
_SNAPPED = "floor({0} / fd + 0.5) * fd"
#: What captions will look like if the first wave of edits, and then the second, is applied to them: expressions of either engine.
_GUESSES = {
    "m": "n + 3 * comp_id",
    "off": "CAST(CASE WHEN comp_id % 5 = 2 THEN 10 WHEN comp_id % 47 = 13 THEN NULL ELSE 0 END AS DOUBLE)",
    "t1": "CASE WHEN n % 9 = 0 THEN 'x' || t0 ELSE t0 END",
    "t2": "CASE WHEN n % 24 = 0 THEN 'y' || (CASE WHEN n % 9 = 0 THEN 'x' || t0 ELSE t0 END) WHEN n % 9 = 0 THEN 'x' || t0 ELSE t0 END",
    "e1": f"CASE WHEN n % 27 = 0 AND n % 6 <> 3 THEN {_SNAPPED.format('(e0 + CAST(0.313 AS DOUBLE))')} ELSE e0 END",
    "sh": _SNAPPED.format("CAST(0.3 AS DOUBLE)"),
}
_WAVE1 = {
    "layer_id": "CASE WHEN m % 600 = 0 THEN n + 100000 WHEN n % 15 = 6 THEN NULL ELSE n END", "layer_index": "n + 1",
    "expect_text": "CASE WHEN m % 603 = 0 THEN t0 || '!' WHEN m % 606 = 0 THEN NULL ELSE t0 END", "expect_start": "s0 + off + n % 5 * CAST(0.001 AS DOUBLE)", "expect_end": "e0 + off",
    "text": "CASE WHEN m % 609 = 0 THEN ' ' WHEN n % 9 = 3 AND m % 618 < 30 THEN 'k' || t0 WHEN n % 9 = 0 THEN 'x' || t0 || ' ' END", "start": "CASE WHEN m % 612 = 0 THEN e0 + off END",
    "end": "CASE WHEN n % 27 = 0 THEN e0 + off + CAST(0.313 AS DOUBLE) END", "shift_by": "CAST(CASE WHEN m % 615 = 0 THEN -1000 WHEN n % 6 = 3 THEN 0.25 END AS DOUBLE)",
}
_WAVE2 = _WAVE1 | {
    "layer_id": "n", "expect_text": "CASE WHEN m % 15 <> 0 THEN t1 ELSE t0 END", "expect_start": "s0 + off", "expect_end": "(CASE WHEN m % 15 <> 0 THEN e1 ELSE e0 END) + off",
    "text": "CASE WHEN n % 24 = 0 THEN 'y' || t1 END", "start": "CASE WHEN n % 36 = 12 THEN s0 + off - CAST(0.013 AS DOUBLE) END", "end": "CAST(NULL AS DOUBLE)", "shift_by": "CAST(CASE WHEN n % 48 = 0 THEN 0.3 END AS DOUBLE)",
}
_WAVE3 = _WAVE2 | {
    "expect_text": "CASE WHEN m % 21 <> 0 THEN t2 ELSE t0 END", "expect_start": "s0 + (CASE WHEN n % 48 = 0 THEN sh ELSE 0 END) + off", "expect_end": "e1 + (CASE WHEN n % 48 = 0 THEN sh ELSE 0 END) + off",
    "text": "'z' || t2", "start": "CAST(NULL AS DOUBLE)", "shift_by": "CAST(NULL AS DOUBLE)",
}
#: Edits in batches, in three waves that touch the same captions; among them stale, empty, doubled, too short, missing and keyframed ones.
_WAVES = [(wave, where, edit | {"batch_id": f"comp_id * 10000 + {k * 1000} + CAST(floor(n / {60.0 * (k + 1)}) AS BIGINT)"}) for k, wave, where, edit in ((0, "first", "n % 3 = 0", _WAVE1), (0, "again", "m % 621 = 0", _WAVE1), (1, "second", "n % 12 = 0", _WAVE2), (2, "third", "n % 36 = 0", _WAVE3))]


def _fault_sql(x: str, c: str) -> str:
    to_start, to_end = f"coalesce({x}.s, {c}.s + {x}.sh)", f"coalesce({x}.e, {c}.e + {x}.sh)"
    stale = f"{x}.off IS NULL OR {x}.et IS NULL OR {x}.es IS NULL OR {x}.ee IS NULL OR {x}.et <> {c}.t OR abs({c}.s + {x}.off - {x}.es) > {x}.half OR abs({c}.e + {x}.off - {x}.ee) > {x}.half"
    return f"""(CASE WHEN {c} IS NULL THEN 'missing' WHEN {stale} THEN 'stale' WHEN {x}.twice THEN 'edited twice' WHEN {x}.t = '' THEN 'empty text' WHEN {x}.t IS NOT NULL AND {x}.kf THEN 'keyframed text'
        WHEN {to_end} - {to_start} < {x}.half THEN 'too short' WHEN {to_start} + {x}.off < -{x}.half THEN 'before the start' END)"""


#: The batches of a timeline applied one after another to the list of its captions.
EDITS = ROUGH.replace("WITH ", "WITH RECURSIVE ", 1) + f""", g0 AS (SELECT comp_id, caption_no AS n, {BODY.format('text')} AS t0, text AS raw, start AS s0, "end" AS e0, frame_duration AS fd, keyframed FROM rough),
 g AS (SELECT *, {", ".join(f"{v} AS {k}" for k, v in _GUESSES.items() if k not in ("t2",))}, {_GUESSES["t2"]} AS t2 FROM g0),
 ed AS ({" UNION ALL ".join(f'SELECT comp_id, {", ".join(f"{v} AS {chr(34)}{k}{chr(34)}" for k, v in edit.items())} FROM g WHERE {where}' for _, where, edit in _WAVES)}),
 rs AS (SELECT comp_id, batch_id, {{'id': coalesce(layer_id, layer_index - 1), 'et': expect_text, 'es': expect_start, 'ee': expect_end, 't': {BODY.format('e.text')}, 's': {_SNAPPED.format('(e.start - off)')}, 'e': {_SNAPPED.format('(e."end" - off)')},
    'sh': coalesce({_SNAPPED.format('shift_by')}, 0), 'twice': count(*) OVER (PARTITION BY batch_id, comp_id, coalesce(layer_id, layer_index - 1)) > 1, 'half': fd / 2, 'off': off, 'kf': keyframed}} AS x FROM ed e LEFT JOIN g USING (comp_id) WHERE g.n = coalesce(layer_id, layer_index - 1) OR (layer_id >= 100000 AND g.n = 0)),
 bl AS (SELECT comp_id, batch_id, row_number() OVER (PARTITION BY comp_id ORDER BY batch_id) AS k, list(x) AS eds FROM rs GROUP BY 1, 2),
 st AS (SELECT comp_id, 0::BIGINT AS k, list({{'id': n, 't': t0, 's': s0, 'e': e0, 'r': false, 'd': false}} ORDER BY n) AS caps FROM g GROUP BY 1
   UNION ALL SELECT st.comp_id, st.k + 1, CASE WHEN len(list_filter(eds, lambda x: {_fault_sql('x', 'caps[x.id + 1]')} IS NOT NULL)) > 0 THEN caps
     ELSE list_transform(caps, lambda c: coalesce(list_transform(list_filter(eds, lambda x: x.id = c.id), lambda x: {{'id': c.id, 't': coalesce(x.t, c.t), 's': CASE WHEN x.sh <> 0 THEN c.s + x.sh ELSE coalesce(x.s, c.s) END,
       'e': CASE WHEN x.sh <> 0 THEN c.e + x.sh ELSE coalesce(x.e, c.e) END, 'r': c.r OR x.t IS NOT NULL, 'd': true}})[1], c)) END FROM st JOIN bl ON bl.comp_id = st.comp_id AND bl.k = st.k + 1)
"""


def _edits(spark, sf):
    rough = rough_captions(spark, sf).withColumnRenamed("caption_no", "n")
    rough = cut(rough, "captions")  # read for each wave and for the edits' captions
    g = rough.select("comp_id", "n", S.body_text(F.col("text")).alias("t0"), F.col("start").alias("s0"), F.col("end").alias("e0"), F.col("frame_duration").alias("fd"))
    g = g.selectExpr("*", *[f"{v} AS {k}" for k, v in _GUESSES.items()])
    edits = None
    for _, where, edit in _WAVES:
        own = g.where(where).selectExpr("comp_id", *[f"{v} AS `{k}`" for k, v in edit.items()])
        edits = own if edits is None else edits.unionByName(own)
    captions = rough.withColumn("layer_index", F.col("n") + 1).withColumnRenamed("n", "layer_id")
    return C.apply_edits(captions, edits, g.select("comp_id", F.col("off").alias("offset")).distinct())


@query("apply_edits", EDITS + ', z AS (SELECT comp_id, unnest(arg_max(caps, k)) AS c FROM st GROUP BY 1) SELECT z.comp_id, c.id AS layer_id, CASE WHEN c.r THEN c.t ELSE raw END AS text, round(c.s, 6) AS start, round(c.e, 6) AS "end", c.d AS edited FROM z JOIN g ON g.comp_id = z.comp_id AND g.n = c.id')
def _(spark, sf):
    return _edits(spark, sf)[0].select("comp_id", "layer_id", "text", *r6("start", "end"), "edited")


@query("edit_rejects", EDITS + f", z AS (SELECT batch_id, st.comp_id, caps, unnest(eds) AS x FROM st JOIN bl ON bl.comp_id = st.comp_id AND bl.k = st.k + 1) SELECT batch_id, comp_id, x.id AS layer_id, {_fault_sql('x', 'caps[x.id + 1]')} AS reason FROM z WHERE {_fault_sql('x', 'caps[x.id + 1]')} IS NOT NULL")
def _(spark, sf):
    return _edits(spark, sf)[1]


TC = "(CASE WHEN {0} >= 360000000 THEN CAST({0} // 3600000 AS VARCHAR) ELSE lpad(CAST({0} // 3600000 AS VARCHAR), 2, '0') END || ':' || lpad(CAST({0} // 60000 % 60 AS VARCHAR), 2, '0') || ':' || lpad(CAST({0} // 1000 % 60 AS VARCHAR), 2, '0') || ',' || lpad(CAST({0} % 1000 AS VARCHAR), 3, '0'))"
MS = "CAST(floor({0} * 1000 + 0.5) AS BIGINT)"


def tc(x: str) -> str:
    return TC.format(MS.format(x))


@query("srt_timecode", counted(3) + f'SELECT recording_id, caption_no, {tc("start")} AS code FROM cap')
def _(spark, sf):
    return G.segment_counts(d.words(spark, sf), 3).select("recording_id", "caption_no", S.srt_timecode(F.col("start")).alias("code"))


SRT = counted(4) + f""", kept AS (SELECT *, row_number() OVER (PARTITION BY recording_id ORDER BY start, "end", caption_no) AS n, CASE WHEN "end" <= start THEN start + 0.001::DOUBLE ELSE "end" END AS e2 FROM cap),
 srt AS (SELECT recording_id, string_agg(n || E'\\r\\n' || {tc('start')} || ' --> ' || {tc('e2')} || E'\\r\\n' || text || E'\\r\\n', E'\\r\\n' ORDER BY n) AS content FROM kept GROUP BY 1)
"""


def _srt(spark, sf) -> DataFrame:
    return T.subtitle_texts(G.segment_counts(d.words(spark, sf), 4).drop("lines"), "recording_id", "caption_no")


@query("subtitle_write", SRT + "SELECT recording_id, content FROM srt")
def _(spark, sf):
    return _srt(spark, sf)


def _files(spark, sf) -> DataFrame:
    """The written texts, with a block without a time and one that ends before it starts in some."""
    bad = F.when(F.col("recording_id") % 3 == 0, F.lit("\r\n\r\nnobody\r\nknows when\r\n\r\n00:00:09,5 --> 00:00:08,50\r\nback\r\n")).otherwise(F.lit(""))
    head = F.when(F.col("recording_id") % 2 == 0, F.lit("WEBVTT\n\n")).otherwise(F.lit(""))
    return _srt(spark, sf).select(F.col("recording_id").alias("file"), F.concat(head, "content", bad).alias("content"))


@query("subtitle_scan", counted(4) + f"SELECT recording_id AS file, caption_no, text, {MS.format('start')} / 1000.0::DOUBLE AS start, {MS.format(chr(34) + 'end' + chr(34))} / 1000.0::DOUBLE AS \"end\" FROM cap")
def _(spark, sf):
    return T.subtitle_captions(_files(spark, sf)).select("file", "caption_no", "text", *r6("start", "end"))


@query("subtitle_errors", counted(4) + """, n AS (SELECT recording_id AS file, count(*) AS blocks FROM cap WHERE recording_id % 3 = 0 GROUP BY 1)
 SELECT file, CAST(blocks + 1 AS BIGINT) AS block_no, 'no timecode' AS error FROM n UNION ALL SELECT file, CAST(blocks + 2 AS BIGINT), 'ends before it starts' FROM n""")
def _(spark, sf):
    return T.subtitle_errors(_files(spark, sf))


@query("cue_seconds", "SELECT o_orderkey, CAST(o_orderkey % 3 AS DOUBLE) * 3600 + o_orderkey % 60 * 60 + o_orderkey % 59 + CAST(o_orderkey % 97 AS DOUBLE) / pow(10, length(CAST(o_orderkey % 97 AS VARCHAR))) AS seconds FROM orders")
def _(spark, sf):
    text = lambda n: (F.col("o_orderkey") % n).cast("string")
    hours = F.when(F.col("o_orderkey") % 3 == 0, "").otherwise(text(3))
    return d.table(spark, sf, "orders").select("o_orderkey", S.cue_seconds(hours, text(60), text(59), text(97)).alias("seconds"))


@query("words_json", counted(1) + "SELECT recording_id, count(*) AS n_words, string_agg(text, ' ' ORDER BY caption_no) AS full_text, round(sum(start), 3) AS total FROM cap GROUP BY 1")
def _(spark, sf):
    from cuegrain.sources import words_json as J

    payloads = J.words_payloads(d.words(spark, sf).withColumn("confidence", F.lit(None).cast("double")))
    return J.payload_words(payloads, "recording_id").groupBy("recording_id").agg(F.count("*").alias("n_words"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("idx", "text"))), lambda x: x.text), " ").alias("full_text"), F.round(F.sum("start"), 3).alias("total"))
