import json
import math
import random
import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from cuegrain.functions import groups, intervals, percentiles
from cuegrain.functions import scalars as S
from cuegrain.operators import align, captions, presets, recognise, speech, timeline, words
from cuegrain.sources import asr, pcm, subtitles, words_json


def one(spark, column, **values):
    return spark.range(1).select(*[F.lit(v).alias(k) for k, v in values.items()] or ["id"]).select(column).first()[0]


@pytest.mark.parametrize("seconds,code", [(0.0, "00:00:00,000"), (3661.0015, "01:01:01,002"), (360000.0, "100:00:00,000"), (-4.0, "00:00:00,000")])
def test_srt_timecode(spark, seconds, code):
    assert one(spark, S.srt_timecode(F.lit(seconds))) == code


@pytest.mark.parametrize("typed,rate,flagged,seconds", [("01:00:00:12", 24.0, False, 3600.5), ("12:10", 25.0, False, 12.4), ("110", 30.0, False, 1 + 10 / 30), ("+5", 25.0, False, 10.2), ("-5", 25.0, False, 9.8), ("4.5s", 24.0, False, 4.5), ("4.5 S", 25.0, False, 4.52), (".5s", 24.0, False, 0.5), ("00:01:75;00", 29.97, True, (135 * 30 - 2) / 29.97), ("00:01:00;02", 29.97, True, 1800 / 29.97), ("00:10:00;00", 29.97, True, 17982 / 29.97)])
def test_parse_timecode(spark, typed, rate, flagged, seconds):
    got = one(spark, S.parse_timecode(F.lit(typed), F.lit(10.0), F.lit(rate), F.lit(1 / rate), F.lit(flagged), F.lit(0.0)))
    assert got.error is None and got.seconds == pytest.approx(seconds)


@pytest.mark.parametrize("typed,error", [("", "empty"), ("soon", "not a time"), ("-400", "before the start"), ("123456789", "too many digits"), ("1:2:3:4:5", "not a time")])
def test_parse_timecode_errors(spark, typed, error):
    got = one(spark, S.parse_timecode(F.lit(typed), F.lit(1.0), F.lit(25.0), F.lit(0.04), F.lit(False), F.lit(0.0)))
    assert got.error == error and got.seconds is None


def test_scalars(spark):
    assert one(spark, S.round_half_up(F.lit(-2.5))) == -2
    assert one(spark, S.units16(F.lit("a😀"))) == 3
    assert one(spark, S.clean_text(F.lit("  a \r\n\t b\r c \n"))) == "a\nb\nc"
    assert one(spark, S.safe_file_name(F.lit('a/b: "c" .. '))) == "a-b- -c-"
    assert one(spark, S.safe_file_name(F.lit(" . "))) == "captions"
    assert one(spark, S.dbfs_label(F.lit(0.5))) == "-6.0 dBFS peak" and one(spark, S.dbfs_label(F.lit(0.0))) == "digital silence"
    assert one(spark, S.reading_speed(F.lit(10), F.lit(0.0))) == math.inf
    keys = [one(spark, S.version_key(F.lit(v))) for v in ("1.2", "v1.10.0-beta", "1.10", "junk")]
    assert keys[3] < keys[0] < keys[1] < keys[2]
    signs = [one(spark, S.compare_versions(F.lit(a), F.lit(b))) for a, b in (("1.2.3.4", "1.2.3.5"), ("1.0-alpha", "1.0-beta"), ("1.0.0.0", "v1"), ("1.0-", "1.0"), ("2", "1.9.9.9.9"))]
    assert signs == [-1, -1, 0, 0, 1]
    assert one(spark, S.occurrence_positions(F.lit("Aa\naA aaa"), F.lit("aa"))) == [0, 3, 6]
    nudged = S.parse_timecode(F.lit("+1"), F.lit(None).cast("double"), F.lit(25.0), F.lit(0.04), F.lit(False), F.lit(0.0))
    assert one(spark, nudged).error == "nothing to nudge from"
    assert one(spark, S.occurrences(F.lit("Aa\naA"), F.lit("a a"))) == 1


def test_asr_results_and_tokens(spark):
    df = spark.createDataFrame(
        [(1, 0, 2.0, "hi there", [" hi", " the", "re", "", " "], [0.0, 0.5, 0.6, 1.0], None), (1, 1, 1.0, "lost", None, None, None), (1, 2, 1.0, "", [], [], [])],
        "recording_id long, chunk_id long, duration double, text string, tokens array<string>, timestamps array<double>, logprobs array<double>",
    )
    got = words.tokens_to_words(words.token_ends(asr.result_tokens(df))).orderBy("idx").collect()
    assert [(w.text, w.start, w.end, w.confidence) for w in got] == [("hi", 0.0, 0.2, None), ("there", 0.5, 0.8, None)]
    assert [r.chunk_id for r in asr.result_errors(df).collect()] == [1]


def test_boundary_repeats_fold_against_the_kept_word(spark):
    w = spark.createDataFrame([(1, 0, "Go", 9.0, 9.2), (1, 1, "go", 9.2, 9.6), (1, 2, "go", 9.5, 9.6), (1, 3, "go", 12.0, 12.1), (1, 4, "go", 12.1, 12.5)], "recording_id long, idx long, text string, start double, end double")
    o = spark.createDataFrame([(1, 8.0, 10.0)], "recording_id long, overlap_start double, overlap_end double")
    assert [r.idx for r in words.drop_boundary_repeats(w, o).orderBy("idx").collect()] == [1, 3, 4]


def test_plan_chunks_covers_spans(spark):
    df = spark.createDataFrame([(1, 0, 0.0, 20.0), (1, 1, 0.0, 50.0), (1, 2, 5.0, 5.0), (1, 3, 5.0, 4.0)], "recording_id long, span_id long, start double, end double")
    got = [(r.span_id, r.start, r.end) for r in words.plan_chunks(df).orderBy("span_id", "part").collect()]
    assert got == [(0, 0.0, 20.0), (1, 0.0, 20.0), (1, 18.0, 38.0), (1, 36.0, 50.0)]
    with pytest.raises(ValueError):
        words.plan_chunks(df, 2.0, 2.0)


def test_speech_falls_back_to_the_whole(spark):
    f = spark.createDataFrame([(1, i, 0.1) for i in range(100)] + [(2, i, 0.2 if 30 <= i < 60 else 0.001) for i in range(100)], "recording_id long, frame_idx long, rms double")
    got = {r.recording_id: (round(r.start, 2), round(r.end, 2)) for r in speech.speech_spans(f).collect()}
    assert got[1] == (0.0, 3.0)
    assert got[2] == (0.75, 1.95)
    assert speech.speech_spans(f.where("false")).count() == 0


def plain_silences(rms, lo, hi, frame=0.01):
    a, b = max(0, int(lo / frame)), min(len(rms), int(np.ceil(hi / frame)))
    part = rms[a:b]
    if len(part) < 4 or not (part > 0).any():
        return []
    low, high = 20 * np.log10(np.percentile(part, [1, 99]) + 1e-9)
    if high - low < 12:
        return []
    level, out, k = 10 ** (max(low + 3, high - 20) / 20), [], a
    while k < b:
        j = k
        while j < b and rms[j] <= level:
            j += 1
        if (j - k) * frame >= 0.12 - 1e-9:
            out.append((k * frame, j * frame))
        k = max(j, k + 1)
    return out


def plain_alignment(starts, ends, rms):
    """The chain of a whole recording, pair after pair."""
    s, e = list(starts), list(ends)
    if not len(rms):
        return s, e
    for a, b in [r for r in plain_silences(rms, 0, min(e[0], s[0] + 1)) if r[0] <= s[0] <= r[1]][:1]:
        s[0] = max(s[0], min(e[0] - 0.05, b))
    for i in range(len(s) - 1):
        near = [(max(a, s[i]), min(b, e[i + 1])) for a, b in plain_silences(rms, max(s[i], e[i] - 1), min(e[i + 1], s[i + 1] + 1))]
        near = [r for r in near if r[1] > r[0]]
        if near:
            a, b = max(near, key=lambda r: r[1] - r[0])
            e[i] = max(s[i] + 0.05, min(e[i], a))
            s[i + 1] = min(e[i + 1] - 0.05, max(s[i + 1], b))
    for a, _ in [r for r in plain_silences(rms, max(s[-1], e[-1] - 1), len(rms) * 0.01) if r[0] <= e[-1] <= r[1]][:1]:
        e[-1] = min(e[-1], max(s[-1] + 0.05, a))
    return s, e


def random_recording(rng, kind):
    """Words and frames: kinds have pauses, no quiet at all, too little separation, or hardly any gaps."""
    n, at, starts, ends = int(rng.integers(1, 90)), float(rng.uniform(0, 1)), [], []
    for _ in range(n):
        length = float(rng.choice([0.1, 0.3, 0.6, 1.5]))
        starts.append(at)
        ends.append(at + length)
        at += length + float(rng.choice([0, 0.02] if kind == 3 else [0, 0, 0.05, 0.2, 0.5, 3.0]))
    rms = np.abs(rng.normal(0.2, 0.03, int(at * 100) + int(rng.integers(0, 200))))
    at = 0
    while kind != 1 and at < len(rms):
        at += int(rng.integers(20, 300))
        length = int(rng.choice([5, 11, 12, 13, 20, 40, 150]))
        part = rms[at : at + length]
        part[:] = np.abs(rng.normal(0.002, 0.001, len(part))) if kind != 2 else 0.05 + 0.01 * rng.random(len(part))
        at += length
    return starts, ends, rms


@pytest.mark.parametrize("early", [0, 1, 12])
def test_alignment_in_bundles_is_that_of_whole_recordings(spark, monkeypatch, early):
    monkeypatch.setattr(align, "BUNDLE_WORDS", 15)
    monkeypatch.setattr(align, "EARLY_WORDS", early)
    monkeypatch.setattr(align, "CELL_FRAMES", 70)
    rng = np.random.default_rng(9)
    w, f, want = [], [], {}
    for recording in range(200 if early else 80):
        starts, ends, rms = random_recording(rng, recording % 4)
        rms = rms[:0] if recording == 150 else rms * (recording != 151)
        w += [(recording, 2 * i, "w", a, b) for i, (a, b) in enumerate(zip(starts, ends, strict=True))]
        f += [(recording, i, float(x)) for i, x in enumerate(rms)]
        want |= {(recording, 2 * i): x for i, x in enumerate(zip(*plain_alignment(starts, ends, rms), strict=True))}
    words_df = spark.createDataFrame(w, "recording_id long, idx long, text string, start double, end double")
    frames_df = spark.createDataFrame(f, "recording_id long, frame_idx long, rms double").repartition(4)
    got = {(r.recording_id, r.idx): (r.start, r.end) for r in align.align_to_audio(words_df, frames_df).collect()}
    assert got == want
    assert sum(want[r, i] != (a, b) for r, i, _, a, b in w) > 300
    assert all(want[r, i][0] >= a and want[r, i][1] <= b for r, i, _, a, b in w)  # no word grows
    assert align.align_to_audio(words_df.limit(0), frames_df).collect() == []


def test_alignment_moves_boundaries(spark):
    rms = np.full(300, 0.3)
    rms[100:150] = 1e-5
    frames = lambda x: spark.createDataFrame([(1, i, float(v)) for i, v in enumerate(x)], "recording_id long, frame_idx long, rms double")
    w = spark.createDataFrame([(1, 0, "a", 0.2, 1.2), (1, 1, "b", 1.2, 2.5)], "recording_id long, idx long, text string, start double, end double")
    times = lambda x: [v for r in align.align_to_audio(w, frames(x)).orderBy("idx").collect() for v in (r.start, r.end)]
    assert times(rms) == pytest.approx([0.2, 1.0, 1.5, 2.5])
    assert times(np.full(300, 0.3)) == [0.2, 1.2, 1.2, 2.5]


def test_percentiles_of_large_and_small_groups(spark):
    rng = np.random.default_rng(6)
    groups_ = {1: np.round(rng.normal(0, 1, 20_000), 4), 2: np.full(5000, 0.25), 3: np.array([1.0]), 4: np.array([3.0, 1.0]), 5: rng.random(37)}
    rows = [(k, float(x)) for k, v in groups_.items() for x in v] + [(1, None), (9, None)]
    df = spark.createDataFrame(rows, "k int, x double").repartition(7)
    got = {r.k: r for r in percentiles.exact_percentiles(df, "k", "x", {"a": 0.01, "b": 0.2, "c": 0.5, "d": 0.99, "e": 1.0}).collect()}
    assert set(got) == set(groups_)
    for k, v in groups_.items():
        r = got[k]
        assert (r.n, r.least, r.most) == (len(v), v.min(), v.max())
        assert [r.a, r.b, r.c, r.d, r.e] == pytest.approx(np.percentile(v, [1, 20, 50, 99, 100]).tolist(), abs=1e-12)


def test_presets_are_judged_by_type(spark):
    entries = ['{"id":"a","name":"x","in":{"x":{"properties":null},"properties":{}}}', '{"id":"b","name":"x","in":"{x"}', '{"id":"c","name":"x","in":{"x":{"properties":null},"properties":[]},"custom":false,"q\\"":"z\\"y","n":1.50}', '{"id":"d","name":"x","in":[],"out":null}', '{"id":"e","name":"x","out":{"properties":null}}', '{"id":7,"name":"x"}', '"text"', "[1]", "null", '{"id":"a","name":"later","in":{}}', '{"id":" ","name":"x"}']
    df = spark.createDataFrame([(1, '{"version":1,"presets":[' + ",".join(entries) + "]}"), (2, '{"version":1,"presets":[{"id":"a","name":"x"}'), (3, "[]"), (4, '{"presets":{"a":1}}'), (5, None)], "file int, content string")
    found = presets.scan_presets(df)
    assert [(r.file, r.id) for r in found.orderBy("file", "pos").collect()] == [(1, "c"), (1, "d"), (1, "7"), (1, "a")]
    written = json.loads(presets.write_presets(found, "file").first().content)
    assert [x["custom"] for x in written["presets"]] == [True] * 4 and written["version"] == 1
    assert written["presets"][0] == json.loads(entries[2]) | {"custom": True}


def test_rebuild_reports_nested_timelines(spark):
    layers = [(1, 1, "a", 0.0, 1.0, None), (1, 2, "", 4.0, 12.0, 5), (1, 3, "", 6.0, 9.0, 6), (1, 4, "", 20.0, 30.0, 7), (5, 5, "in", 0.0, 1.0, None), (5, 6, "in", 1.0, 2.0, None), (6, 7, "in", 0.0, 1.0, None), (7, 8, "in", 0.0, 1.0, None), (2, 9, "", 4.0, 12.0, 7), (3, 10, "", 5.5, 6.0, 6)]
    existing = spark.createDataFrame(layers, "comp_id long, layer_id long, text string, start double, end double, source_comp_id long")
    new = spark.createDataFrame([(k, 90 + k, "n", 5.0, 6.0) for k in (1, 2, 3)], "comp_id long, layer_id long, text string, start double, end double")
    ranges = spark.createDataFrame([(1, True, 5.0, 5.0), (2, False, 0.0, 0.0), (3, True, 5.0, 5.0)], "comp_id long, scoped boolean, range_start double, range_duration double")
    report = {r.comp_id: (r.replaced, r.cuts_nested, r.nested_lost) for r in timeline.rebuild_captions(new, existing, ranges)[1].collect()}
    assert report == {1: (2, True, 3), 2: (1, False, 1), 3: (1, False, 1)}


def test_versions_of_any_length(spark):
    compared = lambda a, b: one(spark, S.compare_versions(F.lit(a), F.lit(b)))
    assert compared("1.1234567890123456789", "1.1234567890123456788") == 1 and compared("1.0009", "1.10") == -1
    assert compared("1.0.0", "v1") == 0 and compared("2.x", "2.0") == 0 and compared("1.0-b", "1") == -1


def test_intervals_against_every_pair(spark):
    rng = random.Random(3)
    points = [(rng.randrange(3), i, float(rng.randrange(0, 400))) for i in range(400)] + [(1, 999, None), (None, 998, 5.0)]
    spans = [(rng.randrange(3), a := float(rng.randrange(0, 400)), a + rng.randrange(-3, 90)) for _ in range(25)] + [(1, None, 5.0), (2, 5.0, None), (None, 0.0, 9.0)]
    p, s = spark.createDataFrame(points, "k int, i int, at double"), spark.createDataFrame(spans, "k int, a double, b double")
    for closed in (False, True):
        inside = lambda v, a, b, c=closed: a <= v < b or (c and a <= v == b)
        want = {i for k, i, v in points if v is not None and any(k == q and a is not None and b is not None and inside(v, a, b) for q, a, b in spans)} - {998}
        got = [r.i for r in intervals.covered_points(p, s, "k", "at", "a", "b", closed, 32).where("k IS NOT NULL").collect()]
        assert sorted(got) == sorted(want)
    rows = [(rng.randrange(4), i, a := float(rng.randrange(0, 400)), a + rng.randrange(0, 40)) for i in range(300)]
    spans = [(0, 10.0, 60.0), (0, 40.0, 45.0), (0, 300.0, float("inf")), (1, float("-inf"), float("inf")), (2, 100.0, 100.0), (2, 50.0, 20.0)]
    want = [i for k, i, a, b in rows if not any(k == q and a < d and b > c for q, c, d in spans)]
    df = spark.createDataFrame(rows, "k int, i int, start double, end double")
    got = intervals.apart_from(df, spark.createDataFrame(spans, "k int, a double, b double"), "k", "start", "end", "a", "b")
    assert sorted(r.i for r in got.collect()) == want and got.columns == df.columns


def wav(bits, channels, data):
    return b"RIFF" + struct.pack("<I", 36 + len(data)) + b"WAVEfmt " + struct.pack("<IHHIIHH", 16, 1, channels, 8000, 0, 0, bits) + b"data" + struct.pack("<I", len(data)) + data


def aiff(bits, data, codec=None, rate=b"\x40\x0e\xbb\x7f\xff\xff\xff\xff\xff\xff"):
    comm = struct.pack(">hIh", 1, len(data) * 8 // bits, bits) + rate + (codec + b"\0\0" if codec else b"")
    body = b"COMM" + struct.pack(">I", len(comm)) + comm + b"SSND" + struct.pack(">I", len(data) + 8) + bytes(8) + data
    return b"FORM" + struct.pack(">I", 4 + len(body)) + (b"AIFC" if codec else b"AIFF") + body


@pytest.mark.parametrize("data,expected", [(wav(8, 1, bytes([128, 192, 0])), [0, 0.5, -1]), (wav(16, 2, struct.pack("<4h", 16384, 0, -32768, -32768)), [0.25, -1]), (wav(24, 1, b"\0\0\x40\0\0\x80"), [0.5, -1]), (wav(32, 1, struct.pack("<i", 1 << 30)), [0.5]), (aiff(16, struct.pack(">2h", 16384, -32768)), [0.5, -1]), (aiff(16, struct.pack("<h", 16384), b"sowt"), [0.5]), (aiff(24, b"\x40\0\0", b"NONE"), [0.5])])
def test_audio_formats(data, expected):
    assert pcm.read_audio(data)[4].tolist() == pytest.approx(expected)


def test_audio_rates_and_rejects(spark):
    assert pcm.read_audio(aiff(16, b"\0\0"))[1] == 48000  # 47999.9999 Hz is rounded
    files = spark.createDataFrame([("a.aiff", wav(8, 1, b"\x80")), ("b.wav", aiff(16, b"\0\0", b"ima4")), ("c", b""), ("d", b"RIFF....WAVE")], "path string, content binary")
    got = {r.recording: (r.container, r.error) for r in pcm.decode_audio(files).collect()}
    assert got["a.aiff"] == ("WAV", None) and all(got[k][1] for k in ("b.wav", "c", "d"))


def test_subtitles(spark, tmp_path):
    text = "﻿WEBVTT\r\n\r\n2\r\n00:00:05,5 --> 0:00:06.50\r\n<i>later</i>\r\n two\r\n\r\n00:01.250 --> 00:02.000\nfirst\n\n\nno time\n\n00:00:03,000 --> 00:00:02,000\nback\n\n00:00:07,000 --> 00:00:08,000\n<b></b>\n"
    files = spark.createDataFrame([("f", text)], "file string, content string")
    got = [(r.text, r.start, r.end) for r in subtitles.subtitle_captions(files).orderBy("caption_no").collect()]
    assert got == [("first", 1.25, 2.0), ("later two", 5.5, 6.5)]
    assert sorted(r.error for r in subtitles.subtitle_errors(files).collect()) == ["ends before it starts", "no text", "no timecode"]
    cap = spark.createDataFrame([("r", "b\nc", 2.0, 2.0), ("r", " ", 0.0, 1.0), ("r", "a", -1.0, 0.5)], "k string, text string, start double, end double")
    texts = subtitles.subtitle_texts(cap, "k")
    assert texts.first().content == "1\r\n00:00:00,000 --> 00:00:00,500\r\na\r\n\r\n2\r\n00:00:02,000 --> 00:00:02,001\r\nb\r\nc\r\n"
    subtitles.write_subtitles(texts, "k", str(tmp_path / "out"))
    back = subtitles.subtitle_captions(subtitles.read_files(spark, str(tmp_path / "out" / "*")))
    assert [r.text for r in back.orderBy("caption_no").collect()] == ["a", "b c"]


def test_words_json_round_trip(spark):
    w = spark.createDataFrame([(1, 0, 'say "hi"', 0.0, 0.5, None), (1, 1, "x", 0.5, 1.0, 0.25)], "recording_id long, idx long, text string, start double, end double, confidence double")
    payloads = words_json.words_payloads(w)
    assert '"confidence":null' in payloads.first().payload
    assert words_json.payload_words(payloads, "recording_id").select(*w.columns).orderBy("idx").collect() == w.collect()
    assert words_json.payload_words(spark.createDataFrame([(1, "{oops")], "recording_id long, payload string"), "recording_id").count() == 0


class PlainTimeline:
    """Batches applied one after another to a dictionary of captions."""

    def __init__(self, rows, offsets):
        self.now = {(c, i): [t, a, b] for c, i, _, t, a, b, _, _ in rows}
        self.rest = {(c, i): (fd, kf) for c, i, _, _, _, _, fd, kf in rows}
        self.places = {(c, n): i for c, i, n, *_ in rows}
        self.offsets, self.rejects = offsets, []

    def fault(self, keys, key, e):
        _, _, _, _, et, es, ee, text, start, end, shift = e
        if key not in self.now:
            return "missing", None
        (t, a, b), (fd, kf), off = self.now[key], self.rest[key], self.offsets.get(key[0])
        if off is None or None in (et, es, ee) or et != t.strip() or abs(a + off - es) > fd / 2 or abs(b + off - ee) > fd / 2:
            return "stale", None
        if keys.count(key) > 1:
            return "edited twice", None
        if text is not None and not text.strip():
            return "empty text", None
        if text is not None and kf:
            return "keyframed text", None
        snap = lambda x: math.floor(x / fd + 0.5) * fd
        by = snap(shift) if shift else 0.0
        to = [a + by if start is None else snap(start - off), b + by if end is None else snap(end - off)]
        if to[1] - to[0] < fd / 2:
            return "too short", None
        if to[0] + off < -fd / 2:
            return "before the start", None
        return None, [t if text is None else text.strip(), *((a + by, b + by) if by else to)]

    def apply(self, batch):
        keys = [(e[1], e[2] if e[2] is not None else self.places.get((e[1], e[3]))) for e in batch]
        judged = [self.fault(keys, k, e) for k, e in zip(keys, batch, strict=True)]
        self.rejects += [(e[0], k[0], k[1], why) for (why, _), k, e in zip(judged, keys, batch, strict=True) if why]
        if not any(why for why, _ in judged):
            self.now.update({k: new for (_, new), k in zip(judged, keys, strict=True)})


@pytest.mark.parametrize("seed", range(3))
def test_batches_of_edits_in_turn(spark, seed):
    """Random batches that share captions, against a dictionary; expectations are those of some earlier state."""
    rng = random.Random(seed)
    offsets = {1: 0.0, 2: 12.5, 3: None}
    rows = [(c, 10 * n, n, f"c{c} {n}" + rng.choice(["", "\n", " "]), n * 1.0, n + rng.choice([0.04, 0.5, 0.8]), 0.04, n % 7 == 3) for c in (1, 2, 3) for n in range(1, 9)]
    plain, edits, states = PlainTimeline(rows, offsets), [], []
    for batch in range(70):
        states.append({k: list(v) for k, v in plain.now.items()})
        own = []
        for _ in range(rng.choice([1, 1, 2, 3])):
            c, n = rng.choice([1, 1, 2, 2, 2, 3] if batch % 9 == 0 else [1, 2]), rng.randrange(1, 9)
            t, a, b = states[-rng.choice([1, 1, 1, 1, 2, 5]) if len(states) > 5 else -1][c, 10 * n]
            off = offsets[c] or 0.0
            odd = rng.random()
            expect = (None, a + off, b + off) if odd < 0.02 else (t.strip(), a + off + rng.choice([0, 0.01]), b + off)
            change = rng.choice([(f"new {batch}", None, None, None), (None, a + off - 0.013 * rng.randrange(5), None, None), (None, None, b + off + 0.1, None), (None, None, None, 0.25), ("both ", 0.0, b, -0.31), (" ", None, None, None) if odd > 0.4 else (None, b + off, b + off + 1, None), (None, None, None, -999.0) if odd > 0.9 else (None, None, None, 0.0)])
            own.append((batch, c, None if odd > 0.5 else 10 * n + (5 if odd < 0.03 else 0), n, *expect, *change))
        edits += own
        plain.apply(own)
    c = spark.createDataFrame(rows, "comp_id int, layer_id int, layer_index int, text string, start double, end double, frame_duration double, keyframed boolean")
    e = spark.createDataFrame(edits, "batch_id int, comp_id int, layer_id int, layer_index int, expect_text string, expect_start double, expect_end double, text string, start double, end double, shift_by double")
    applied, rejects = captions.apply_edits(c, e.repartition(5), spark.createDataFrame(list(offsets.items()), "comp_id int, offset double"))
    got = applied.collect()
    assert len(got) == len(rows)  # no caption is doubled
    assert {(r.comp_id, r.layer_id): [r.text, r.start, r.end] for r in got} == plain.now
    assert sorted(map(tuple, rejects.collect()), key=str) == sorted(plain.rejects, key=str)
    assert {"stale", "missing", "edited twice", "empty text"} <= {x[3] for x in plain.rejects} or seed


def test_two_batches_that_edit_one_caption(spark):
    c = spark.createDataFrame([(1, 1, "a", 0.0, 1.0, 0.04, False)], "comp_id int, layer_id int, text string, start double, end double, frame_duration double, keyframed boolean")
    e = spark.createDataFrame([(1, 1, 1, "a", 0.0, 1.0, "b", None, 1.013, None), (2, 1, 1, "a", 0.0, 1.0, "c", None, None, None), (3, 1, 1, "b", 0.0, 1.0, None, None, None, 0.5)], "batch_id int, comp_id int, layer_id int, expect_text string, expect_start double, expect_end double, text string, start double, end double, shift_by double")
    applied, rejects = captions.apply_edits(c, e)
    assert [(r.text, round(r.start, 6), round(r.end, 6), r.edited) for r in applied.collect()] == [("b", 0.52, 1.52, True)]
    assert [tuple(r) for r in rejects.collect()] == [(2, 1, 1, "stale")]


def test_connected_groups(spark):
    links = [(i, i + 1) for i in range(100, 163)] + [(7, 3), (3, 9), (9, 7), (50, 51), (4, 4)]
    got = {r.node: r.group for r in groups.connected_groups(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {i: 100 for i in range(100, 164)} | {3: 3, 7: 3, 9: 3, 50: 50, 51: 50}


def test_replacing_keeps_line_breaks(spark):
    rows = [(1, "one fox\ntwo cat", 0), (1, "red\nfox", 1), (1, "FOX \n x", 2), (2, "fox", 3), (2, "a fox", 4)]
    df = spark.createDataFrame(rows, "k int, text string, n int")
    new = lambda q, by, case=False: {r.n: (r.new_text, r.matches, r.refused) for r in captions.replace_all(df, "k", q, by, case).collect()}
    assert new("fox", "dog")[0] == ("one dog\ntwo cat", 1, False)
    assert new("red fox", "x")[1] == ("x", 1, False)
    assert new("fox", "fox", True)[1] == ("red\nfox", 1, False)
    assert new("fox", "")[4] == ("a", 1, True) and new("x \n x", "y") == {}
    counts = {r.k: (r.replaced, r.changed) for r in captions.edit_counts(captions.replace_all(df, "k", "fox", "fox"), "k").collect()}
    assert counts == {1: (3, 1), 2: (2, 0)}


def test_places_are_utf16_units(spark):
    assert one(spark, S.occurrence_positions(F.lit("😀en😀\nEN"), F.lit("en"))) == [2, 7]
    assert one(spark, S.occurrence_positions(F.lit("a.b.c"), F.lit("."))) == [1, 3]


def test_retiming_edges(spark):
    rows = [(1.0, 1.01, 1.013, 1.01), (0.0, 1.0, -0.5, 1.0), (0.0, 1.0, 0.9, 0.3), (0.0, 1.0, 1.2, 1.0)]
    df = spark.createDataFrame(rows, "start double, end double, s double, e double").withColumn("frame_duration", F.lit(0.04))
    got = [(r.edit_start, r.edit_end, r.error) for r in captions.retime_edits(df, "s", "e").collect()]
    assert got[0] == (None, None, None)  # too short as it is, but untouched
    assert got[1] == (None, None, "before the start")
    assert got[2] == (pytest.approx(0.92), pytest.approx(0.32), None) and got[3] == (None, None, "too short")


def test_edits_are_all_or_nothing(spark):
    c = spark.createDataFrame([(1, k, f"t{k}", float(k), k + 0.9, 0.04, k == 3) for k in range(6)], "comp_id long, layer_id long, text string, start double, end double, frame_duration double, keyframed boolean")
    rows = [(10, 1, 0, "t0", 0.0, 0.9, "new", None, None, None), (10, 1, 1, "t1", 1.0, 1.9, None, None, None, 0.5), (11, 1, 2, "t2", 2.0, 2.9, "ok", None, None, None), (11, 1, 3, "t3", 3.0, 3.9, "key", None, None, None), (12, 1, 9, "?", 0.0, 1.0, None, None, None, 1.0), (13, 1, 4, "t4", 4.0, 4.9, " ", None, None, None)]
    e = spark.createDataFrame(rows, "batch_id long, comp_id long, layer_id long, expect_text string, expect_start double, expect_end double, text string, start double, end double, shift_by double")
    applied, rejects = captions.apply_edits(c, e)
    got = {r.layer_id: (r.text, r.start, r.edited) for r in applied.collect()}
    assert got[0] == ("new", 0.0, True) and got[1] == ("t1", pytest.approx(1.52), True) and got[2] == ("t2", 2.0, False)
    assert {(r.batch_id, r.reason) for r in rejects.collect()} == {(11, "keyframed text"), (12, "missing"), (13, "empty text")}


def test_rebuild_refuses_unusable_ranges(spark):
    kind = "comp_id long, layer_id long, text string, start double, end double"
    old = spark.createDataFrame([(1, 1, "a", 0.0, 2.0), (1, 2, "b", 2.0, 3.0), (2, 3, "c", 0.0, 1.0)], kind)
    new = spark.createDataFrame([(1, 8, "n", 0.5, 1.0), (2, 9, "n", 0.0, 1.0)], kind)
    ranges = spark.createDataFrame([(1, True, 0.0, 2.0), (2, True, 0.0, 0.0)], "comp_id long, scoped boolean, range_start double, range_duration double")
    out, report = timeline.rebuild_captions(new, old, ranges)
    assert {r.layer_id for r in out.collect()} == {2, 3, 8}
    assert {(r.comp_id, r.added, r.replaced, r.error) for r in report.collect()} == {(1, 1, 1, None), (2, 0, 0, "unusable range")}


def test_long_recordings_are_files_of_bounded_size(spark):
    from cuegrain.plans import audio_queries as A

    sf = "/root/testdata/sf0.001"
    blocks = spark.read.parquet(f"{sf}/embeddings.parquet").agg(F.countDistinct("label", F.floor(F.col("vec_id") / 16)), F.max(F.size("embedding"))).first()
    sizes = [r[0] for r in A._wav_files(spark, sf, 16).select(F.length("content")).collect()]
    assert len(sizes) == blocks[0] > 10 and max(sizes) <= 48 + 16 * 2 * blocks[1]
    few, one = (pcm.recordings(A._decoded(spark, sf, n)) for n in (16, 1 << 40))
    assert sorted(map(tuple, few.collect())) == sorted(map(tuple, one.collect()))


def nest(spark, edges):
    """A caption in each timeline, and a holder a second in for each edge."""
    comps = sorted({x for e in edges for x in e})
    rows = [(c, c, "caption", f"t{c}", 0.0, 1.0, 0.0, None) for c in comps] + [(a, 1000 + i, "caption", None, 0.0, 9.0, 1.0, b) for i, (a, b) in enumerate(edges)]
    layers = spark.createDataFrame(rows, "comp_id long, layer_id long, tag string, text string, start double, end double, start_time double, source_comp_id long").withColumn("name", F.lit("x"))
    return layers, spark.createDataFrame([(comps[0],)], "root_id long")


def test_captions_of_any_depth_are_flattened(spark):
    captions, errors = timeline.flatten_captions(*nest(spark, [(i, i + 1) for i in range(1, 13)]))
    assert sorted((r.depth, r.text, r.start) for r in captions.collect()) == [(i, f"t{i + 1}", float(i)) for i in range(13)]
    assert errors.count() == 0


def test_timelines_inside_themselves_are_errors(spark):
    captions, errors = timeline.flatten_captions(*nest(spark, [(1, 2), (1, 3), (2, 4), (3, 4), (4, 5), (5, 3), (4, 4)]))
    # ways without a repeat: 1, 12, 13, 124, 134, 1245, 1345, 12453
    assert sorted(r.text for r in captions.collect()) == ["t1", "t2", "t3", "t3", "t4", "t4", "t5", "t5"]
    assert sorted((r.root_id, r.comp_id, r.depth) for r in errors.collect()) == [(1, 3, 4), (1, 4, 3), (1, 4, 3), (1, 4, 5)]


def test_locating_stops_at_its_depth(spark):
    layers, roots = nest(spark, [(i, i + 1) for i in range(1, 13)])
    assert timeline.nested_offsets(layers, timeline.DEEPEST, roots).agg(F.max("depth")).first()[0] == timeline.DEEPEST == 8


def test_settings():
    assert recognise.Settings.from_text({"align": " Off ", "lag_seconds": "0.2"}) == recognise.Settings(lag_seconds=0.2, align=False)


def test_live_captions_on_a_stream(spark, tmp_path):
    from cuegrain.streaming.live import caption_sessions

    rows = [(1, f"2024-01-01 00:00:{s:02d}", t) for s, t in ((0, "a"), (1, "b"), (9, "c"), (40, "d"))]
    spark.createDataFrame(rows, "recording_id long, at string, text string").selectExpr("recording_id", "CAST(at AS timestamp) AS at", "text").coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("recording_id long, at timestamp, text string").parquet(str(tmp_path / "in"))
    query = caption_sessions(stream, "2 seconds", "5 seconds").writeStream.format("memory").queryName("live").outputMode("append").start()
    query.processAllAvailable()
    query.stop()
    assert {r.text for r in spark.table("live").collect()} == {"a b", "c"}
