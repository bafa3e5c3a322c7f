"""Words with odd characters, and what grows with the tables: tasks, shuffles and bundles."""

import shutil
from pathlib import Path
from types import SimpleNamespace

import duckdb
import pandas as pd
import pytest

from cuegrain.operators import align
from cuegrain.operators.segment import PHRASE
from cuegrain.plans import audio_queries, captions_queries, derived, timeline_queries
from cuegrain.streaming import segments

DATA = Path("/root/testdata/sf0.001")


@pytest.fixture
def tables(spark, tmp_path):
    """A folder of the smallest tables whose conversations are the given (conv_id, turn, text)."""

    def make(turns):
        for path in DATA.glob("*.parquet"):
            if path.stem != "conversations":
                shutil.copy(path, tmp_path)
        rows = [(i, t, "user", x) for i, t, x in turns]
        spark.createDataFrame(rows, "conv_id long, turn int, role string, text string").write.parquet(str(tmp_path / "conversations.parquet"))
        return str(tmp_path)

    return make


def oracle(folder, name):
    con = duckdb.connect()
    for path in Path(folder).glob("*.parquet"):
        con.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM '{path}{'/*.parquet' if path.is_dir() else ''}'")
    found = con.execute(captions_queries.SQL[name])
    return [x[0] for x in found.description], sorted(found.fetchall())


def test_reading_speed_counts_code_points_as_its_sql(spark, tables):
    folder = tables([(1, 0, "all's well \U0001f600\U0001f600 said \U0001d53e\U0001d53e they, and went."), (2, 0, "plain words")])
    names, theirs = oracle(folder, "reading_speed")
    assert sorted(map(tuple, captions_queries.QUERIES["reading_speed"](spark, folder).select(*names).collect())) == theirs


def test_tasks_grow_with_the_words(spark, monkeypatch):
    """The session has four partitions whatever comes; the words, and captions made of them, are dealt to more."""
    monkeypatch.setattr(derived, "TASK_BYTES", 2_000)
    n = derived.word_tasks(spark, str(DATA))
    assert 18 < n < 25
    assert derived.words(spark, str(DATA)).rdd.getNumPartitions() == n
    for name in ("word_gaps", "count_captions_word", "segment_parts", "segment_vertical", "live_captions", "merge_caption"):
        run = (captions_queries.QUERIES | audio_queries.QUERIES)[name]
        assert run(spark, str(DATA)).rdd.getNumPartitions() == n, name


def test_captions_leave_their_island_once(spark):
    """Turns are shuffled, and captions; grouping the words of captions anew was a third shuffle, of all words."""
    for name in ("segment_phrase", "segment_sentence", "segment_smart"):
        plan = captions_queries.QUERIES[name](spark, str(DATA))._jdf.queryExecution().executedPlan().toString()
        assert plan.count("Exchange hashpartitioning(recording_id") == 2, name


def test_frames_of_audio_are_not_shuffled(spark, monkeypatch):
    """Frames, some 28 for a word, go into cells where they are made, and the bundles are dealt to as many tasks as the words need."""
    frames = audio_queries.energy(spark, str(DATA), 6)
    plan = align.frame_cells(frames)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1
    monkeypatch.setattr(align, "TASK_WORDS", 500)
    rows = derived.words(spark, str(DATA)).count()
    dealt = []
    settled = align._settled
    monkeypatch.setattr(align, "_settled", lambda *args: dealt.append(args[-1]) or settled(*args))
    assert audio_queries.QUERIES["align_to_audio"](spark, str(DATA)).count() == rows
    assert dealt[0] >= rows / 500


def test_the_stream_folds_a_recording_without_sorting_in_pandas(monkeypatch):
    """A batch holds some hundred words of one recording, for which pandas' sort took most of the time; of one idx the earliest word counts."""

    def refused(*_, **__):
        raise AssertionError("sorted in pandas")

    monkeypatch.setattr(pd.DataFrame, "sort_values", refused)
    words = [(2, "end.", 4, 1.0, 1.2, 0.2, 2, True, 1000), (0, "late", 4, 0.3, 0.4, 0.2, 0, False, 300), (1, "b", 1, 0.5, 0.7, 0.2, 0, False, 500), (0, "a", 1, 0.0, 0.2, 0.2, 0, False, 0)]
    state = SimpleNamespace(exists=False, hasTimedOut=False, update=lambda _: None, setTimeoutTimestamp=lambda _: None, getCurrentWatermarkMs=lambda: 0)
    (out,) = segments._fold(PHRASE, 60_000)((7,), iter([pd.DataFrame(words, columns=[*segments.FIELDS, "last", "ms"])]), state)
    assert out[["text", "first_idx", "n_words"]].values.tolist() == [["a b end.", 0, 3]]


def test_preset_files_are_dealt_before_they_are_parsed(spark):
    """Customers are read in one task; their files are dealt to many, and the first of an id is found where they are."""
    plan = timeline_queries.QUERIES["preset_write"](spark, str(DATA))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning(file") == 1 and plan.count("Exchange") == 1
