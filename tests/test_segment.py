import random

import pytest
from pyspark.sql import functions as F

from cuegrain.operators import segment as G
from cuegrain.operators.captions import HOLD_SECONDS

SCHEMA = "recording_id long, idx long, text string, start double, end double"


def rows(texts, gap=0.05, length=0.3, recording=1, at=0.0):
    out = []
    for i, text in enumerate(texts):
        out.append((recording, i, text, at, at + length))
        at += length + (gap[i] if isinstance(gap, list) else gap)
    return out


def random_words(seed, n):
    rng = random.Random(seed)
    out, at = [], 0.0
    for i in range(n):
        text = rng.choice(["a", "the", "holding", "extraordinarily", "we're", "cut-", "you"]) + rng.choice([""] * 8 + [",", ".", '?"', ";"])
        length = rng.choice([0.08, 0.2, 0.3, 0.9])
        out.append((seed, i, text, at, at + length))
        at += length + rng.choice([0.0, 0.0, 0.05, 0.28, 0.4, 0.47, 0.6, 0.95, 1.5])
    return out


@pytest.fixture(scope="module")
def mixed(spark):
    return spark.createDataFrame([r for s in range(6) for r in random_words(s, 160)], SCHEMA).cache()


BUDGETS = {"phrase": G.PHRASE, "sentence": G.SENTENCE, "parts": G.PARTS, "smart": G.replace(G.PHRASE, min_words=2), "vertical": G.replace(G.LAYOUTS["vertical"], min_words=2)}


@pytest.mark.parametrize("name", BUDGETS)
def test_islands_give_what_whole_recordings_give(mixed, name):
    got = G.segment_phrases(mixed, BUDGETS[name])
    whole = G.segment_phrases(mixed, BUDGETS[name], islands=False)
    key = ["recording_id", "caption_no"]
    assert got.orderBy(key).collect() == whole.orderBy(key).collect()


@pytest.mark.parametrize("name", BUDGETS)
def test_no_word_is_lost_and_budgets_hold(mixed, name):
    b = BUDGETS[name]
    texts = {r.recording_id: r.t for r in mixed.groupBy("recording_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("idx", "text"))), lambda x: x.text), " ").alias("t")).collect()}
    by = {}
    for c in G.segment_phrases(mixed, b).orderBy("recording_id", "caption_no").collect():
        by.setdefault(c.recording_id, []).append(c)
        assert c.n_words <= b.max_words
        assert len(c.text) <= b.chars * b.lines or c.n_words == 1
        assert " ".join(c.lines) == c.text
    for recording, captions in by.items():
        assert " ".join(c.text for c in captions) == texts[recording]
        for one, two in zip(captions, captions[1:], strict=False):
            assert one.end <= two.start and one.start <= two.start


def captions(spark, words, **budget):
    return [c.text for c in G.segment_phrases(spark.createDataFrame(words, SCHEMA), G.replace(G.PHRASE, **budget)).orderBy("caption_no").collect()]


def test_clause_end_before_gap_before_held(spark):
    words = rows("one two three, four five six".split(), [0.05, 0.05, 0.05, 0.3, 0.05, 0.05])
    assert captions(spark, words, max_words=5)[0] == "one two three,"
    words = rows("one two three four five six".split(), [0.05, 0.05, 0.05, 0.3, 0.05, 0.05])
    assert captions(spark, words, max_words=5)[0] == "one two three four"


def test_stranded_word_is_filled_up_but_not_across_a_sentence(spark):
    assert captions(spark, rows("we do like making this".split(), 0.0), max_words=4, min_words=2) == ["we do like", "making this"]
    assert captions(spark, rows("we do like this. Right".split(), 0.0), min_words=2) == ["we do like this.", "Right"]


def test_hold_is_bounded(spark):
    got = G.segment_counts(spark.createDataFrame(rows(["a", "b", "c"], [0.4, 5.0, 0]), SCHEMA), 1).orderBy("caption_no").collect()
    assert got[0].end == got[1].start and got[1].end == pytest.approx(1.0 + HOLD_SECONDS)


def test_wrap(spark):
    df = spark.createDataFrame([("aa bb cc dd ee",), ("abcdefghij kl",), ("",)], "t string")
    lines = lambda chars, n: [list(r[0]) for r in df.select(G.wrap_lines(F.col("t"), chars, n)).collect()]
    assert lines(5, 2) == [["aa bb", "cc dd ee"], ["abcdefghij", "kl"], [""]]
    assert lines(5, 1) == [["aa bb", "cc dd", "ee"], ["abcdefghij", "kl"], [""]]


def test_modes(spark):
    df = spark.createDataFrame(rows("a b c d e".split()), SCHEMA)
    assert G.segment(df, "three").count() == 2 and G.segment(df, "unheard of").count() == 1
    assert G.segment(df.where("false"), "smart").count() == 0


# --- a stream of words ----------------------------------------------------------------------------


@pytest.mark.parametrize("name", ["phrase", "smart"])
def test_a_shuffled_stream_with_repeats_gives_the_captions_of_the_table(spark, tmp_path, name):
    from cuegrain.functions.scalars import bare_word
    from cuegrain.streaming import segments as L

    words = spark.createDataFrame([r for s in range(4) for r in random_words(50 + s, 90)], SCHEMA)
    spans = G.word_gaps(words).where("gap IS NOT NULL").withColumn("bare", bare_word(F.col("text")))
    usual = spans.where("bare <> ''").groupBy("recording_id", "bare").agg(F.min(F.col("end") + F.col("gap") - F.col("start")).alias("normal"))
    sent = L.usual_lengths(words, usual).withColumns({"at": F.timestamp_millis(F.lit(1_700_000_000_000) + (F.col("start") * 1000).cast("long")), "last": F.col("idx") == 89})
    rows_sent = sent.collect()
    assert len(rows_sent) == 360
    random.Random(3).shuffle(rows_sent)
    rows_sent += random.Random(4).sample(rows_sent, 100)  # sent again, most in a later batch
    void = (None, 3, "lost", 0.0, 0.1, None, None, None)
    for n in range(4):
        part = spark.createDataFrame([tuple(r) for r in rows_sent[n::4]] + [void], sent.schema)
        part.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(sent.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    query = L.live_segments(stream, BUDGETS[name], late="1 day").writeStream.format("memory").queryName(f"cut_{name}").trigger(availableNow=True).start()
    query.awaitTermination()
    columns = ["recording_id", "caption_no", "text", "start", "end", "lines", "first_idx", "n_words"]
    assert sorted(map(tuple, spark.table(f"cut_{name}").select(columns).collect())) == sorted(map(tuple, G.segment_phrases(words, BUDGETS[name]).select(columns).collect()))


class Kept:
    """State of one recording, outside a stream."""

    exists, hasTimedOut, get, due = False, False, None, None

    def update(self, values):
        self.exists, self.get = True, values

    def remove(self):
        self.exists = False

    def setTimeoutTimestamp(self, at):
        self.due = at

    def getCurrentWatermarkMs(self):
        return 0


def test_a_recording_that_falls_silent_ends_without_its_missing_words():
    import pandas as pd

    from cuegrain.streaming.segments import _fold

    fold, state = _fold(G.PHRASE, 5_000), Kept()

    def send(*words):
        return pd.DataFrame([{"idx": i, "text": t, "chars": len(t), "start": s, "end": s + 0.2, "usual": 0.0, "mark": m, "last": last, "ms": int(s * 1000)} for i, t, s, m, last in words])

    def step(*words):
        return [(r.caption_no, r.text, r.start, round(r.end, 6), r.first_idx, r.n_words) for x in fold((7,), iter([send(*words)] if words else []), state) for r in x.itertuples()]

    assert step((1, "b.", 0.3, 2, False), (0, "a", 0.0, 0, False)) == []  # closed, but the next start may pull its end back
    assert step((4, "e", 1.4, 0, False), (0, "again", 0.0, 0, False)) == []
    assert step((2, "c", 0.6, 0, False)) == [(0, "a b.", 0.0, 0.6, 0, 2)]
    assert state.due == 1_400 + 5_000
    state.hasTimedOut = True  # word 3 never comes
    assert step() == [(1, "c", 0.6, 1.4, 2, 1), (2, "e", 1.4, 2.8, 4, 1)]
    state.hasTimedOut = False
    assert step((3, "d", 1.0, 0, False), (5, "f", 9.0, 0, True)) == [(3, "f", 9.0, 10.4, 5, 1)]
    assert state.exists
    state.hasTimedOut = True
    assert step() == [] and not state.exists
