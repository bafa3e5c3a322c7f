"""Column functions on times, texts and names. Times are seconds as doubles.

round_half_up is floor(x + 0.5), which differs from Spark's round at halves and for negatives.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

EDGE = "(?U)^\\s+|\\s+\\z"


def round_half_up(x: Column) -> Column:
    return F.floor(x + F.lit(0.5))


def units16(text: Column) -> Column:
    """Length in UTF-16 units, in which caption budgets count."""
    return (F.octet_length(F.encode(text, "UTF-16BE")) / 2).cast("int")


def trimmed(text: Column) -> Column:
    """Without white space of any kind at either end."""
    return F.regexp_replace(text, EDGE, "")


def srt_timecode(seconds: Column) -> Column:
    """HH:MM:SS,mmm; negative times are zero, and hours may take more than two digits."""
    ms = round_half_up(F.greatest(seconds, F.lit(0.0)) * 1000).cast("long")
    return F.format_string("%02d:%02d:%02d,%03d", F.floor(ms / 3600000), F.floor(ms / 60000) % 60, F.floor(ms / 1000) % 60, ms % 1000)


def cue_seconds(hours: Column, minutes: Column, seconds: Column, fraction: Column) -> Column:
    """Seconds of a cue time's parts, given as text; the fraction counts by its digits, absent hours are 0."""
    h = F.when(F.coalesce(hours, F.lit("")) == "", F.lit(0.0)).otherwise(hours.cast("double"))
    return h * 3600 + minutes.cast("double") * 60 + seconds.cast("double") + fraction.cast("double") / F.pow(F.lit(10.0), F.length(fraction))


def snap(seconds: Column, frame_duration: Column) -> Column:
    """The nearest frame's time."""
    return round_half_up(seconds / frame_duration) * frame_duration


def frame_base(rate: Column) -> Column:
    return round_half_up(rate).cast("long")


def drops_frames(rate: Column, flagged: Column) -> Column:
    """Drop-frame counting applies to flagged rates just off 30 and 60."""
    base = frame_base(rate)
    return flagged & base.isin(30, 60) & (F.abs(rate - base) > 0.001)


def format_timecode(seconds: Column, rate: Column, frame_duration: Column, flagged: Column, display_start: Column) -> Column:
    """HH:MM:SS:FF, or HH:MM:SS;FF where frames are dropped: 2 labels (4 at 60) a minute but each tenth."""
    base, drop = frame_base(rate), drops_frames(rate, flagged)
    frames = F.greatest(round_half_up((seconds + display_start) / frame_duration).cast("long"), F.lit(0))
    lost = F.when(base == 60, 4).otherwise(2)
    ten = base * 600 - lost * 9
    minute = base * 60 - lost
    tens, rest = F.floor(frames / ten), frames % ten
    skipped = lost * 9 * tens + F.when(rest > lost, lost * F.floor((rest - lost) / minute)).otherwise(0)
    n = F.when(drop, frames + skipped).otherwise(frames)
    return F.concat(
        F.format_string("%02d:%02d:%02d", F.floor(n / (base * 3600)), F.floor(n / (base * 60)) % 60, F.floor(n / base) % 60),
        F.when(drop, ";").otherwise(":"),
        F.format_string("%02d", n % base),
    )


def parse_timecode(text: Column, current: Column, rate: Column, frame_duration: Column, flagged: Column, display_start: Column) -> Column:
    """struct(seconds, error) of what a user typed, on a frame: a full, partial or digits-only timecode, +n/-n
    frames from the current time, or seconds of the display like 4.5s, .5s or 4.5S."""
    t = trimmed(F.coalesce(text, F.lit("")))
    base, drop = frame_base(rate), drops_frames(rate, flagged)
    is_nudge, is_seconds = t.rlike("^[+-]\\s*\\d+\\z"), t.rlike("^(\\d+(\\.\\d+)?|\\.\\d+)\\s*[sS]\\z")
    is_digits, is_code = t.rlike("^\\d+\\z"), t.rlike("^\\d+([:;.]\\d+){1,3}\\z")
    nudge = snap(current + F.regexp_replace(t, "\\s", "").try_cast("long") * frame_duration, frame_duration)
    plain = snap(F.regexp_extract(t, "^([0-9.]+)", 1).try_cast("double") - display_start, frame_duration)
    padded = F.lpad(t, 8, "0")
    parts = F.when(is_digits, F.array(*[F.substring(padded, i, 2) for i in (1, 3, 5, 7)])).otherwise(F.split(t, "[:;.]"))
    number = F.transform(F.concat(F.array_repeat(F.lit("0"), F.greatest(F.lit(0), F.lit(4) - F.size(parts))), parts), lambda x: x.try_cast("long"))
    h, m, s, f = (F.get(number, F.lit(i)) for i in range(4))
    label = ((h * 60 + m) * 60 + s) * base + f
    minutes = h * 60 + m  # labels are skipped by the minutes as written, whatever the seconds add up to
    lost = F.when(base == 60, 4).otherwise(2)
    coded = F.when(drop, label - lost * (minutes - F.floor(minutes / 10))).otherwise(label) * frame_duration - display_start
    seconds = F.when(is_nudge, nudge).when(is_seconds, plain).when(is_digits | is_code, coded)
    error = (
        F.when(t == "", "empty")
        .when(is_nudge & current.isNull(), "nothing to nudge from")
        .when(is_digits & (F.length(t) > 8), "too many digits")
        .when(seconds.isNull(), "not a time")
        .when(seconds < -1e-6, "before the start")
    )
    return F.struct(F.when(error.isNull(), F.greatest(seconds, F.lit(0.0))).alias("seconds"), error.alias("error"))


def format_duration(seconds: Column) -> Column:
    return F.format_string("%.2fs", F.greatest(seconds, F.lit(0.0)) + 0.0)  # not -0.00


def clean_text(text: Column) -> Column:
    """Line ends as newlines, no blanks around them, no white space at the ends."""
    unix = F.regexp_replace(text, "\r\n?", "\n")
    return trimmed(F.regexp_replace(F.regexp_replace(unix, "[ \t]+\n", "\n"), "\n[ \t]+", "\n"))


def body_text(text: Column) -> Column:
    """A caption's text as it is compared and written: line ends as newlines, no white space at the ends."""
    return trimmed(F.regexp_replace(text, "\r\n?", "\n"))


def word_count(text: Column) -> Column:
    return F.size(F.filter(F.split(text, "(?U)\\s+"), lambda x: x != ""))


def dbfs_label(peak: Column) -> Column:
    return F.when(peak <= 0, "digital silence").otherwise(F.format_string("%.1f dBFS peak", F.log10(F.when(peak > 0, peak)) * 20))


def slice_bounds(start: Column, end: Column, rate: Column, length: Column) -> Column:
    """struct(first, last): sample indices of a span, half-even rounded and held inside the signal."""
    first = F.least(F.greatest(F.rint(start * rate).cast("long"), F.lit(0)), length)
    last = F.least(F.greatest(F.rint(end * rate).cast("long"), first), length)
    return F.struct(first.alias("first"), last.alias("last"))


def safe_file_name(name: Column, default: str = "captions") -> Column:
    dashed = F.regexp_replace(F.coalesce(name, F.lit("")), "[\\\\/:*?\"<>|\r\n]+", "-")
    bare = F.regexp_replace(trimmed(dashed), "[. ]+\\z", "")
    return F.when(bare == "", default).otherwise(bare)


def layer_name(text: Column, fallback: Column) -> Column:
    flat = trimmed(F.regexp_replace(text, "[\r\n]+", " "))
    return F.coalesce(F.when(flat != "", flat), fallback)


def frames_to_seconds(frames: Column, rate: Column) -> Column:
    good = F.when((rate > 0) & ~F.isnan(rate), rate).otherwise(F.lit(30.0))
    return F.when((frames > 0) & ~F.isnan(frames), frames / good).otherwise(F.lit(0.0))


def preset_slug(name: Column) -> Column:
    dashed = F.regexp_replace(F.lower(F.substring(trimmed(name), 1, 60)), "[^a-z0-9]+", "-")
    return F.substring(F.regexp_replace(dashed, "^-+|-+\\z", ""), 1, 32)


def preset_id(name: Column, millis: Column) -> Column:
    """Slug and time in base 36."""
    return F.concat_ws("-", preset_slug(name), F.lower(F.conv(millis.cast("string"), 10, 36)))


def version_key(version: Column) -> Column:
    """Sortable struct(numbers, release, pre): all numbers of the dotted part (junk is 0, zeros at the end don't count), 0 for a
    pre-release and 1 for a release, and the pre-release's text, which is what follows the first dash.

    A number of any length is (digits, text) without zeros in front, which sorts as its value.
    """
    bare = F.regexp_replace(trimmed(F.coalesce(version, F.lit(""))), "^[vV]", "")
    digits = F.transform(F.split(F.substring_index(bare, "-", 1), "\\."), lambda n: F.regexp_replace(F.regexp_extract(n, "^\\s*(\\d+)", 1), "^0+", ""))
    last = F.array_max(F.transform(digits, lambda n, i: F.when(n != "", i + 1).otherwise(0)))
    numbers = F.transform(F.slice(digits, F.lit(1), last), lambda n: F.struct(F.length(n).alias("digits"), n.alias("text")))
    pre = F.when(bare.contains("-"), F.regexp_replace(bare, "(?s)^[^-]*-", "")).otherwise("")
    return F.struct(numbers.alias("numbers"), F.when(pre != "", 0).otherwise(1).alias("release"), pre.alias("pre"))


def compare_versions(a: Column, b: Column) -> Column:
    """-1, 0 or 1: whether version a is older than, equal to or newer than b."""
    x, y = version_key(a), version_key(b)
    return F.when(x < y, -1).when(x > y, 1).otherwise(0)


def bare_word(text: Column) -> Column:
    """Lower-cased, only a-z and apostrophes kept."""
    return F.regexp_replace(F.lower(text), "[^a-z']", "")


def reading_speed(chars: Column, duration: Column) -> Column:
    return F.when(duration <= 0, F.lit(float("inf"))).otherwise(chars / F.when(duration > 0, duration))


def level_class(peak: Column) -> Column:
    """What a peak level says about a recording."""
    return F.when(peak < 1e-5, "silent").when(peak < 1e-3, "quiet").when(peak < 0.01, "very quiet").otherwise("ok")


def query_pattern(query: Column, match_case: bool = False) -> Column:
    """A pattern for the query as plain text; its spaces also match line breaks, and a line break in it matches nothing."""
    quoted = F.replace(F.replace(query, F.lit("\\E"), F.lit("\\E\\\\E\\Q")), F.lit(" "), F.lit("\\E[ \n]\\Q"))
    return F.when(query.contains("\n"), "(?!)").otherwise(F.concat(F.lit("\\Q" if match_case else "(?iu)\\Q"), quoted, F.lit("\\E")))


def occurrences(text: Column, query: Column, match_case: bool = False) -> Column:
    """Number of matches of query in text that don't overlap; a line break counts as a space."""
    pieces = F.split(text, query_pattern(query, match_case), F.lit(-1))
    return F.when(F.length(query) > 0, (F.size(pieces) - 1).cast("long")).otherwise(F.lit(0).cast("long"))


def occurrence_positions(text: Column, query: Column, match_case: bool = False) -> Column:
    """array of places, from 0 and in UTF-16 units, of the matches of query in text, from the left and without overlaps; a line break counts as a space."""
    pattern = query_pattern(query, match_case)
    pieces, matches = F.split(text, pattern, F.lit(-1)), F.regexp_extract_all(text, pattern, F.lit(0))
    # what stands before a match: all pieces up to it, and the matches between them
    ends = F.aggregate(
        F.arrays_zip(F.slice(pieces, F.lit(1), F.size(matches)).alias("piece"), matches.alias("match")),
        F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("found")),
        lambda acc, x: F.struct((acc.at + units16(x.piece) + units16(x.match)).alias("at"), F.concat(acc.found, F.array(acc.at + units16(x.piece))).alias("found")),
        lambda acc: acc.found,
    )
    return F.when(F.length(query) > 0, ends).otherwise(F.array().cast("array<int>"))
