"""Words to captions under line, word, time and pause budgets.

No caption spans a hard boundary: the end of a sentence, or a pause past every pause budget. Words
between two hard boundaries are an island, which is segmented on its own; what an island needs from
the rest of the recording, the gaps and how long a word is held against its usual length, are window
columns. So one Arrow UDF cuts thousands of islands a batch, and a long recording is many of them.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cuegrain.functions.scalars import bare_word, units16
from cuegrain.operators.captions import hold

SENTENCE_END = "[.!?][\"')\\]]?\\z"
CLAUSE_END = "[,;:][\"')\\]]?\\z"
#: A gap that stands out: so long, and so many times the run's usual gap.
GAP_LEAST, GAP_TIMES = 0.25, 2.5
#: A word that is held: so many times its shortest length.
HELD_TIMES = 1.4


@dataclass(frozen=True)
class Budget:
    """Characters a line, lines, words at most and at least, pauses in seconds (ordinary and hard), seconds at most."""

    chars: int = 42
    lines: int = 2
    max_words: int = 14
    min_words: int = 1
    max_gap: float = 0.5
    hard_gap: float = 1.2
    max_seconds: float = 6.0


# The budgets of each layout and mode.
PHRASE = Budget()
LAYOUTS = {
    "horizontal": PHRASE,
    "vertical": Budget(20, 2, 4, 1, 0.45, 0.9, 2.5),
    "square": Budget(28, 2, 7, 1, 0.5, 1.0, 3.5),
    "unknown": PHRASE,
}
SENTENCE = Budget(42, 3, 40, 2, 99.0, 99.0, 8.0)
PARTS = Budget(24, 2, 5, 2, 0.35, 0.7, 2.5)
COUNTS = {"word": 1, "one": 1, "two": 2, "three": 3}


def orientation(width: Column, height: Column) -> Column:
    aspect = width / F.when(height > 0, height)
    return F.when((width <= 0) | (height <= 0) | aspect.isNull(), "unknown").when(aspect < 0.9, "vertical").when(aspect <= 1.2, "square").otherwise("horizontal")


def sentence_budget(layout: str) -> Budget:
    """One caption a sentence, in as many lines of the layout as hold what three broadcast lines do."""
    chars = LAYOUTS[layout].chars
    return replace(SENTENCE, chars=chars, lines=max(2, -(-SENTENCE.chars * SENTENCE.lines // chars)))


def word_gaps(words: DataFrame) -> DataFrame:
    """words with gap (to the next word, not below zero; null for the last) and held: how many times its
    shortest length in the recording the word lasts; 0 where that says nothing."""
    order = Window.partitionBy("recording_id").orderBy("idx")
    following = F.lead("start").over(order)
    spanned = words.withColumns({"next_start": following, "span": following - F.col("start"), "bare": bare_word(F.col("text"))})
    normal = F.min(F.when(F.col("bare") != "", F.col("span"))).over(Window.partitionBy("recording_id", "bare"))
    sized = spanned.withColumn("normal", normal)
    known = F.col("span").isNotNull() & ~F.col("text").endswith("-") & (F.col("bare") != "") & (F.col("normal") > 0)
    held = F.when(known, F.col("span") / F.when(F.col("normal") > 0, F.col("normal"))).otherwise(F.lit(0.0))
    return sized.withColumns({"gap": F.when(F.col("next_start").isNotNull(), F.greatest(F.lit(0.0), F.col("next_start") - F.col("end"))), "held": held}).drop("next_start", "span", "bare", "normal")


def wrap_lines(text: Column, chars: int, lines: int) -> Column:
    """Array of lines, filled greedily; what is left when lines - 1 are closed goes on the last one.

    A word longer than a line stays whole; an empty text is one empty line. With one line asked for, text
    wraps into as many as it takes.
    """
    words = F.filter(F.split(text, "(?U)\\s+"), lambda w: w != "")
    start = F.struct(F.array().cast("array<string>").alias("done"), F.lit("").alias("line"))

    def add(acc: Column, w: Column) -> Column:
        full = F.lit(False) if lines == 1 else F.size(acc["done"]) == lines - 1
        joined = F.when(acc["line"] == "", w).otherwise(F.concat(acc["line"], F.lit(" "), w))
        breaks = ~full & (acc["line"] != "") & (units16(joined) > chars)
        return F.struct(F.when(breaks, F.concat(acc["done"], F.array(acc["line"]))).otherwise(acc["done"]).alias("done"), F.when(breaks, w).otherwise(joined).alias("line"))

    return F.aggregate(words, start, add, lambda acc: F.when((acc["line"] == "") & (F.size(acc["done"]) > 0), acc["done"]).otherwise(F.concat(acc["done"], F.array(acc["line"]))))


class _Island:
    """One run of words as arrays; positions are within it."""

    def __init__(self, chars, start, end, gap, held, mark, o: Budget):
        self.chars, self.start, self.end, self.held, self.mark, self.o = chars, start, end, held, mark, o
        self.gap = np.nan_to_num(np.asarray(gap, np.float64))  # the recording's last word has no gap
        self.raw = np.asarray(start[1:]) - np.asarray(end[:-1])
        self.ahead = np.concatenate([[0], np.cumsum(np.asarray(chars) + 1)])

    def joined(self, a: int, b: int) -> int:
        return int(self.ahead[b] - self.ahead[a]) - 1

    def stop(self, a: int) -> tuple[int, bool]:
        """Where the caption from a must end, and whether a budget, not the speaker, ends it."""
        o = self.o
        for b in range(a + 1, len(self.chars) + 1):
            if self.mark[b - 1] == 2 or b == len(self.chars):
                return b, False
            pause = self.raw[b - 1]
            if pause > o.max_gap and (b - a >= o.min_words or pause > o.hard_gap):
                return b, False
            if self.joined(a, b + 1) > o.chars * o.lines or b - a >= o.max_words or self.end[b] - self.start[a] > o.max_seconds:
                return b, True
        return len(self.chars), False

    def usual_gap(self, a: int, b: int) -> float:
        return float(np.median(self.gap[a : b - 1])) if b - a > 1 else 0.0

    def cut(self, a: int, b: int) -> int:
        """The best place to end a caption that a budget ends at b: in its later half, at the last clause end,
        else the widest gap that stands out, else the word held longest, else b."""
        first = max(a + max(1, self.o.min_words), a + -(-(b - a) // 2))
        places = range(first, b + 1)
        clauses = [p for p in places if self.mark[p - 1] == 1]
        if clauses:
            return clauses[-1]
        usual = self.usual_gap(a, b)
        for value, least in ((self.gap, max(GAP_LEAST, GAP_TIMES * usual)), (self.held, HELD_TIMES)):
            good = [p for p in places if value[p - 1] >= least]
            if good:
                return max(good, key=lambda p: (value[p - 1], p))
        return b

    def groups(self) -> list[int]:
        """The end of each caption, short ones filled from the one before where no break of the speaker's is undone."""
        ends, a = [], 0
        while a < len(self.chars):
            b, budget = self.stop(a)
            a = self.cut(a, b) if budget else b
            ends.append(a)
        o, floor = self.o, max(1, self.o.min_words)
        for i in range(1, len(ends)):
            lo, b, end = (ends[i - 2] if i > 1 else 0), ends[i - 1], ends[i]
            pause = self.raw[b - 1]
            stands_out = pause >= GAP_LEAST and pause >= GAP_TIMES * self.usual_gap(lo, b)
            if pause > o.max_gap or stands_out or self.mark[b - 1] == 2:
                continue
            while end - b < floor and b - lo > floor:
                fits = end - b + 1 <= o.max_words and self.joined(b - 1, end) <= o.chars * o.lines and self.end[end - 1] - self.start[b - 1] <= o.max_seconds
                if not fits:
                    break
                b -= 1
            ends[i - 1] = b
        return ends


def _cutter(o: Budget):
    @F.pandas_udf("array<int>")
    def cut(chars: pd.Series, start: pd.Series, end: pd.Series, gap: pd.Series, held: pd.Series, mark: pd.Series) -> pd.Series:
        return pd.Series([np.array(_Island(*columns, o).groups(), np.int32) for columns in zip(chars, start, end, gap, held, mark, strict=True)], dtype=object)

    return cut


def segment_phrases(words: DataFrame, budget: Budget = PHRASE, islands: bool = True, tasks: int | None = None) -> DataFrame:
    """(recording_id, caption_no, text, start, end, lines, first_idx, n_words): captions in order, held on screen.

    islands=False segments each recording whole, to the same result; tests compare the two. tasks: to how many the
    captions are dealt by recording, so that what one holds is bounded on large inputs; without it, as the session deals them.
    """
    order = Window.partitionBy("recording_id").orderBy("idx")
    mark = F.when(F.col("text").rlike(SENTENCE_END), 2).when(F.col("text").rlike(CLAUSE_END), 1).otherwise(0)
    w = word_gaps(words).withColumns({"mark": mark, "chars": units16(F.col("text"))})
    least = budget.max_gap if budget.min_words <= 1 else max(budget.max_gap, budget.hard_gap)
    pause = F.col("start") - F.lag("end").over(order)
    hard = F.coalesce((F.lag("mark").over(order) == 2) | (pause > least), F.lit(True)) if islands else F.lit(False)
    w = w.withColumn("hard", hard.cast("int")).withColumn("island", F.sum("hard").over(order))
    fields = ["idx", "text", "chars", "start", "end", "gap", "held", "mark"]
    rows = w.groupBy("recording_id", "island").agg(F.array_sort(F.collect_list(F.struct(*fields))).alias("ws"))
    ends = _cutter(budget)(*[F.col(f"ws.{f}") for f in ("chars", "start", "end", "gap", "held", "mark")])
    spans = F.transform("ends", lambda b, i: F.struct(F.coalesce(F.get("ends", i - 1), F.lit(0)).alias("a"), b.alias("b")))
    # captions are sliced out of their island where it is, as grouping words anew would shuffle all of them again
    each = rows.withColumn("ends", ends).select("recording_id", "ws", F.explode(spans).alias("x"))
    each = each.select("recording_id", F.slice("ws", F.col("x.a") + 1, F.col("x.b") - F.col("x.a")).alias("ws"))
    grouped = each.select(
        "recording_id",
        F.array_join("ws.text", " ").alias("text"),
        F.element_at("ws", 1)["start"].alias("start"),
        F.element_at("ws", -1)["end"].alias("end"),
        F.element_at("ws", 1)["idx"].alias("first_idx"),
        F.size("ws").cast("long").alias("n_words"),
    )
    return _finish(grouped.repartition(tasks, "recording_id") if tasks else grouped, budget)


def segment_counts(words: DataFrame, size: int, budget: Budget = PHRASE) -> DataFrame:
    """Captions of exactly `size` words; the last of a recording has what is left."""
    order = Window.partitionBy("recording_id").orderBy("idx")
    numbered = words.withColumn("group", F.floor((F.row_number().over(order) - 1) / max(1, size)))
    grouped = numbered.groupBy("recording_id", "group").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("idx", "text"))), lambda t: t.text), " ").alias("text"),
        F.min_by("start", "idx").alias("start"),
        F.max_by("end", "idx").alias("end"),
        F.min("idx").alias("first_idx"),
        F.count("*").alias("n_words"),
    )
    return _finish(grouped, budget)


def _finish(grouped: DataFrame, budget: Budget) -> DataFrame:
    by = Window.partitionBy("recording_id").orderBy("first_idx")
    numbered = grouped.withColumns({"caption_no": (F.row_number().over(by) - 1).cast("long"), "lines": wrap_lines(F.col("text"), budget.chars, budget.lines)})
    return hold(numbered, "recording_id", "caption_no").select("recording_id", "caption_no", "text", "start", "end", "lines", "first_idx", "n_words")


def segment(words: DataFrame, mode: str = "phrase", layout: str = "horizontal", tasks: int | None = None, **overrides) -> DataFrame:
    """Captions of a mode: word, one, two, three, parts, sentence, smart, or phrase for any other name.

    overrides are fields of Budget and win over the mode's own. tasks: see segment_phrases.
    """
    if mode in COUNTS:
        return segment_counts(words, COUNTS[mode], replace(PHRASE, **overrides))
    budget = {"parts": PARTS, "sentence": sentence_budget(layout), "smart": replace(LAYOUTS[layout], min_words=2)}.get(mode, PHRASE)
    return segment_phrases(words, replace(budget, **overrides), tasks=tasks)
