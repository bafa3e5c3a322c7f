"""Segmentation of words as they arrive: each recording's open island is state, and its captions leave when it closes.

An island closes when the first word of the next one is known, or the recording ends. Its captions
are then those of the whole table, as nothing behind an island changes them.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from cuegrain.functions.scalars import bare_word, units16
from cuegrain.operators.captions import HOLD_SECONDS
from cuegrain.operators.segment import CLAUSE_END, PHRASE, SENTENCE_END, Budget, _Island, wrap_lines

FIELDS = ["idx", "text", "chars", "start", "end", "usual", "mark"]
STATE = "idx array<long>, text array<string>, chars array<int>, start array<double>, end array<double>, usual array<double>, mark array<int>, next_idx long, next_no long, last_idx long, latest long"
CAPTION = "caption_no long, text string, start double, end double, first_idx long, n_words long"


def usual_lengths(words: DataFrame, spans: DataFrame) -> DataFrame:
    """words with `usual`: the shortest length of the word in its recording, from (recording_id, bare, normal) of an earlier pass."""
    known = spans.select("recording_id", F.col("bare").alias("its_bare"), F.col("normal").alias("usual"))
    named = words.withColumn("bare", bare_word(F.col("text")))
    return named.join(known.withColumnRenamed("recording_id", "its"), (F.col("recording_id") == F.col("its")) & (F.col("bare") == F.col("its_bare")), "left").drop("bare", "its", "its_bare")


def _captions(run: list[tuple], budget: Budget, closed: int, number: int) -> Iterator[tuple]:
    """Captions of the first `closed` words of a run, which end an island; the word behind them is only looked at."""
    _, text, chars, start, end, usual, mark = zip(*run, strict=True)
    following = [*start[1:], None]
    gap = np.array([np.nan if n is None else max(0.0, n - e) for n, e in zip(following, end, strict=True)])
    held = [0.0 if n is None or not u > 0 or t.endswith("-") else (n - s) / u for n, s, u, t in zip(following, start, usual, text, strict=True)]
    heads = [i for i in range(closed) if _opens(run, i, budget)]
    for a, b in zip(heads, [*heads[1:], closed], strict=True):
        done = a
        for stop in _Island(chars[a:b], start[a:b], end[a:b], gap[a:b], held[a:b], mark[a:b], budget).groups():
            first, done = done, a + stop
            shown = end[done - 1] + HOLD_SECONDS
            following_start = start[done] if done < len(run) else shown
            yield number, " ".join(text[first:done]), start[first], min(shown, following_start), run[first][0], done - first
            number += 1


def _opens(run: list[tuple], i: int, budget: Budget) -> bool:
    """Whether word i of a run begins an island."""
    least = budget.max_gap if budget.min_words <= 1 else max(budget.max_gap, budget.hard_gap)
    return i == 0 or run[i - 1][6] == 2 or run[i][3] - run[i - 1][4] > least


def _fold(budget: Budget, patience: int) -> Callable:
    def fold(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        *columns, next_idx, next_no, last_idx, latest = state.get if state.exists else (*[[]] * len(FIELDS), 0, 0, -1, 0)
        waiting = {w[0]: w for w in zip(*columns, strict=True)}
        for batch in batches:
            # lists and no pandas: a batch is one recording's, and a call of pandas costs more than its words
            came = list(zip(*(batch[f].tolist() for f in FIELDS), strict=True))
            for word in sorted((w for w in came if w[0] >= next_idx), key=lambda w: (w[0], w[3] != w[3], w[3], w[4] != w[4], w[4], w[1])):
                waiting.setdefault(word[0], word)
            latest = max([latest, *batch["ms"].tolist()])
            last_idx = max(last_idx, max((w[0] for w, last in zip(came, batch["last"].tolist(), strict=True) if last), default=-1))
        order = sorted(waiting)
        # a word that is still missing keeps back all behind it, until patience is over
        known = len(order) if state.hasTimedOut else next((n for n, i in enumerate(order) if i != next_idx + n), len(order))
        run = [waiting[i] for i in order[:known]]
        over = state.hasTimedOut or bool(run) and run[-1][0] == last_idx
        closed = len(run) if over else next((i for i in range(len(run) - 1, 0, -1) if _opens(run, i, budget)), 0)
        out = list(_captions(run, budget, closed, next_no)) if closed else []
        if closed:
            next_idx, next_no = run[closed - 1][0] + 1, next_no + len(out)
        left = [waiting[i] for i in order if i >= next_idx]
        if state.hasTimedOut and not run:
            state.remove()
        else:  # the numbers stay for a while, so that words that are sent again are known
            state.update((*([w[i] for w in left] for i in range(len(FIELDS))), next_idx, next_no, last_idx, latest))
            state.setTimeoutTimestamp(max(latest, state.getCurrentWatermarkMs()) + patience)
        if out:
            numbers, texts, starts, ends, firsts, sizes = zip(*out, strict=True)
            yield pd.DataFrame({"recording_id": key[0], "caption_no": numbers, "text": texts, "start": starts, "end": ends, "first_idx": firsts, "n_words": sizes})

    return fold


def live_segments(words: DataFrame, budget: Budget = PHRASE, late: str = "10 seconds", patience: float = 60.0) -> DataFrame:
    """(recording_id, caption_no, text, start, end, lines, first_idx, n_words): captions of a stream of words, in append mode.

    words: recording_id, idx (from 0 without holes), text, start, end (seconds), at (when the word was said, for the
    watermark), last (whether the recording ends with it), and usual (its usual length, null if unknown; see
    usual_lengths). Words may come in any order and more than once: of words with one idx the first to come counts, then
    the earliest. With all words in time, the captions are those of segment_phrases on the table. A recording of which
    nothing was heard for `patience` seconds behind its latest word is ended as it is, and words missing in it are left
    out; what comes later is a word of the next caption. Rows without a recording, idx, text or time are left out.
    State holds the words of the open island of each recording and those behind a missing one.
    """
    mark = F.when(F.col("text").rlike(SENTENCE_END), 2).when(F.col("text").rlike(CLAUSE_END), 1).otherwise(0)
    whole = words.where("recording_id IS NOT NULL AND idx IS NOT NULL AND text IS NOT NULL AND start IS NOT NULL AND `end` IS NOT NULL AND at IS NOT NULL")
    made = whole.withWatermark("at", late).select(
        "recording_id", F.col("idx").cast("long").alias("idx"), "text", units16(F.col("text")).cast("int").alias("chars"), F.col("start").cast("double").alias("start"), F.col("end").cast("double").alias("end"),
        F.coalesce(F.col("usual").cast("double"), F.lit(0.0)).alias("usual"), mark.alias("mark"), F.coalesce("last", F.lit(False)).alias("last"), F.unix_millis("at").alias("ms"), "at",
    )
    kind = words.schema["recording_id"].dataType.simpleString()
    fold = _fold(budget, int(patience * 1000))
    captions = made.groupBy("recording_id").applyInPandasWithState(fold, f"recording_id {kind}, {CAPTION}", STATE, "append", GroupStateTimeout.EventTimeTimeout)
    return captions.withColumn("lines", wrap_lines(F.col("text"), budget.chars, budget.lines)).select("recording_id", "caption_no", "text", "start", "end", "lines", "first_idx", "n_words")
