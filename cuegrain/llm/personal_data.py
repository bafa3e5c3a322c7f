"""Operator 11: personal data by base patterns and a character-level bidirectional LSTM with CRF transitions.

Base patterns find e-mail and network addresses, card and phone numbers in their usual forms. The model, trained in
numpy on labelled spans, tags characters and adds what the patterns miss: `anna (at) example [dot] org`, `192[.]0[.]2[.]7`,
`(030) 555 0100`, `4111.1111.1111.1111`. Texts are cut into overlapping windows; each is decoded by Viterbi, and what all
windows of a text propose is reconciled over the whole text: valid proposals are weighted by the windows that
agree on them, and the set of disjoint spans with the greatest weight is added to the base ones.

A proposal is valid only if it holds a digit, an @, a bracketed `at` or the word `dot`, and windows are decoded apart. So a
window without any of these cannot add a span and is not decoded: results are the same, and tests hold them against decoding every window.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import lru_cache
from random import Random

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StructType

from cuegrain.llm.common import give_back

KINDS = ("email", "ip", "card", "phone")
TAGS = 1 + len(KINDS)

# ---------------------------------------------------------------- base patterns

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")

Span = tuple[int, int, int]


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = int(c) * (1 + k % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def _digits(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def base_spans(text: str) -> list[Span]:
    """(kind, start, end) by kind and start, in time linear in the text: no pattern rescans a run of characters that it has left.

    An e-mail's local part is the run of its characters that ends at an @, after the last address; where its domain does not
    match, no other start could. A run of digits that begins no address holds the start of none either.
    """
    found: list[Span] = []
    last, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > last and text[start - 1] in _LOCAL:
            start -= 1
        domain = _DOMAIN.match(text, at + 1) if start < at else None
        if domain:
            found.append((0, start, domain.end()))
            last = domain.end()
        at = text.find("@", max(at + 1, last))
    found += [(1, *m.span()) for m in _IP.finditer(text) if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split("."))]
    found += [(2, *m.span()) for m in _CARD.finditer(text) if 13 <= len(d := _digits(m[0])) <= 19 and luhn(d)]
    found += [(3, *m.span()) for m in _PHONE.finditer(text) if 9 <= len(_digits(m[0])) <= 15]
    return found


# ---------------------------------------------------------------- valid proposals

_NAME, _LABEL = r"[a-z0-9._%+-]{1,64}", r"[a-z0-9-]{1,63}"
_AT, _DOT = r" ?(?:@|[(\[{<] ?at ?[)\]}>]) ?", r"(?:\.| ?[(\[{<] ?(?:dot|\.) ?[)\]}>] ?| dot )"
_VALID_EMAIL = re.compile(rf"{_NAME}{_AT}{_LABEL}(?:{_DOT}{_LABEL})+|{_NAME} at {_LABEL}(?: dot {_LABEL})+", re.IGNORECASE)
_VALID_IP = re.compile(rf"(\d{{1,3}}){_DOT}(\d{{1,3}}){_DOT}(\d{{1,3}}){_DOT}(\d{{1,3}})", re.IGNORECASE | re.ASCII)
_VALID_CARD = re.compile(r"\d(?:[ \u00a0\u202f./_\u2010-\u2015-]?\d)+", re.ASCII)
_VALID_PHONE = re.compile(r"(?:\+|\()?\d(?:[ \u00a0\u202f()./\u2010-\u2015-]{0,2}\d)+", re.ASCII)
#: What every valid proposal holds; the first for Arrow, which decides if a text is looked at, the second within texts.
TRIGGER = r"[0-9@]|(?i:[(\[{<] ?at ?[)\]}>]| dot )"
_SPELT = re.compile(r"[(\[{<] ?at ?[)\]}>]| dot ", re.IGNORECASE)


def valid(kind: int, piece: str) -> bool:
    if kind == 0:
        return bool(_VALID_EMAIL.fullmatch(piece))
    if kind == 1:
        m = _VALID_IP.fullmatch(piece)
        return bool(m) and all(int(p) <= 255 for p in m.groups())
    digits = _digits(piece)
    if kind == 2:
        return 13 <= len(digits) <= 19 and bool(_VALID_CARD.fullmatch(piece)) and luhn(digits)
    most = 15 if piece.startswith(("+", "00")) else 12
    return 9 <= len(digits) <= most and piece != digits and piece.count("(") == piece.count(")") and bool(_VALID_PHONE.fullmatch(piece))


# ---------------------------------------------------------------- the model

#: Characters of a window and from one window to the next. A span shorter than the step lies inside a window, off its edges.
WINDOW, STEP = 128, 64
HIDDEN = 12
#: Windows decoded at a time.
LANES = 1_024
_SPACES, _DASHES = (0xA0, 0x2007, 0x202F, 0x3000), (*range(0x2010, 0x2016), 0x2212)


def _classes() -> np.ndarray:
    """The class of each code point: nothing 0, letters without case, one digit, printable ASCII each by itself, line ends, other characters."""
    known = np.full(0x3001, 1, np.uint8)
    known[:32] = 2
    n = 3
    for code in range(32, 127):
        c = chr(code)
        if c.isupper():
            continue
        known[code] = n
        if c.isalpha():
            known[ord(c.upper())] = n
        if c != "0" and c.isdigit():
            known[code] = known[ord("0")]
        else:
            n += 1
    known[list(_SPACES)], known[list(_DASHES)] = known[32], known[ord("-")]
    return known


CLASS_OF = _classes()
CLASSES = int(CLASS_OF.max()) + 1
_DIGIT, _AT_SIGN = CLASS_OF[ord("0")], CLASS_OF[ord("@")]


def classes_of(text: str) -> np.ndarray:
    code = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")
    return CLASS_OF[np.minimum(code, len(CLASS_OF) - 1)] if len(code) else np.zeros(0, np.uint8)


@dataclass
class Tagger:
    """Input tables (2 x 4H x CLASSES), recurrent weights (2 x 4H x H), output (TAGS x 2H and TAGS), transitions (TAGS x TAGS, from row to column)."""

    table: np.ndarray
    recurrent: np.ndarray
    output: np.ndarray
    bias: np.ndarray
    moves: np.ndarray

    def parts(self) -> list[np.ndarray]:
        return [self.table, self.recurrent, self.output, self.bias, self.moves]


def _recur(model: Tagger, x: np.ndarray, keep: bool) -> tuple[np.ndarray, list]:
    """States (steps x 2H x lanes) of both directions over x (steps x lanes), by place in x; what the way back needs, if kept."""
    (steps, lanes), size = x.shape, model.recurrent.shape[2]
    h, c = np.zeros((2, size, lanes), np.float32), np.zeros((2, size, lanes), np.float32)
    out, kept = np.empty((steps, 2 * size, lanes), np.float32), []
    for t in range(steps):
        z = np.matmul(model.recurrent, h)
        z[0] += np.take(model.table[0], x[t], axis=1)
        z[1] += np.take(model.table[1], x[steps - 1 - t], axis=1)
        gates = z[:, : 3 * size]
        gates *= 0.5
        np.tanh(z, out=z)
        gates += 1
        gates *= 0.5
        i, f, o, g = (z[:, k * size : (k + 1) * size] for k in range(4))
        before = c
        c = f * c
        c += i * g
        squashed = np.tanh(c)
        h = o * squashed
        out[t, :size], out[steps - 1 - t, size:] = h[0], h[1]
        if keep:
            kept.append((z, before, squashed, h))
    return out, kept


def emissions(model: Tagger, x: np.ndarray) -> np.ndarray:
    """Scores (steps x TAGS x lanes) of the tags of x (steps x lanes of classes)."""
    states, _ = _recur(model, x, False)
    return np.matmul(model.output, states) + model.bias[:, None]


def decode(model: Tagger, x: np.ndarray) -> np.ndarray:
    """The best tags (steps x lanes) by Viterbi; ties fall to the smaller tag."""
    scores = emissions(model, x)
    best, came = scores[0], np.empty(scores.shape, np.uint8)
    for t in range(1, len(scores)):
        through = best[:, None, :] + model.moves[:, :, None]
        came[t] = through.argmax(axis=0)
        best = through.max(axis=0) + scores[t]
    tags = np.empty(x.shape, np.uint8)
    tags[-1] = best.argmax(axis=0)
    lane = np.arange(x.shape[1])
    for t in range(len(scores) - 1, 0, -1):
        tags[t - 1] = came[t, tags[t], lane]
    return tags


def _log_sum(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis=axis, keepdims=True)
    return np.log(np.exp(x - top).sum(axis=axis)) + top.squeeze(axis)


def gradients(model: Tagger, x: np.ndarray, tags: np.ndarray) -> tuple[float, list[np.ndarray]]:
    """Mean negative log likelihood of the tags (steps x lanes) and its gradients, in the order of parts()."""
    (steps, lanes), size = x.shape, HIDDEN
    states, kept = _recur(model, x, True)
    score = np.matmul(model.output, states) + model.bias[:, None]
    moves = model.moves[:, :, None]
    alpha, beta = np.empty_like(score), np.zeros_like(score)
    alpha[0] = score[0]
    for t in range(1, steps):
        alpha[t] = _log_sum(alpha[t - 1][:, None] + moves, 0) + score[t]
    for t in range(steps - 2, -1, -1):
        beta[t] = _log_sum(moves + (score[t + 1] + beta[t + 1])[None], 1)
    total = _log_sum(alpha[-1], 0)
    back = np.exp(alpha + beta - total)  # the marginals
    lane, step = np.arange(lanes)[None, :], np.arange(steps)[:, None]
    gold = score[step, tags, lane].sum() + model.moves[tags[:-1], tags[1:]].sum()
    d_moves = np.exp(alpha[:-1][:, :, None] + moves[None] + (score[1:] + beta[1:])[:, None] - total).sum(axis=(0, 3))
    np.add.at(d_moves, (tags[:-1].ravel(), tags[1:].ravel()), -1)
    back[step, tags, lane] -= 1
    back /= lanes
    d_output, d_bias = np.tensordot(back, states, ([0, 2], [0, 2])), back.sum(axis=(0, 2))
    d_states = np.matmul(model.output.T, back)
    d_recurrent = np.zeros_like(model.recurrent)
    dh, dc = np.zeros((2, size, lanes), np.float32), np.zeros((2, size, lanes), np.float32)
    dz_all = np.empty((2, 4 * size, steps, lanes), np.float32)
    turned = model.recurrent.transpose(0, 2, 1)
    for t in range(steps - 1, -1, -1):
        z, before, squashed, _ = kept[t]
        i, f, o, g = (z[:, k * size : (k + 1) * size] for k in range(4))
        dh[0] += d_states[t, :size]
        dh[1] += d_states[steps - 1 - t, size:]
        dc += dh * o * (1 - squashed * squashed)
        dz = np.concatenate([dc * g * i * (1 - i), dc * before * f * (1 - f), dh * squashed * o * (1 - o), dc * i * (1 - g * g)], axis=1)
        dz_all[:, :, t] = dz
        dc *= f
        dh = np.matmul(turned, dz)
        if t:
            d_recurrent += np.matmul(dz, kept[t - 1][3].transpose(0, 2, 1))
    hot = np.zeros((steps, lanes, CLASSES), np.float32)
    hot[step, lane, x] = 1
    d_table = np.stack([dz_all[0].reshape(4 * size, -1) @ hot.reshape(-1, CLASSES), dz_all[1].reshape(4 * size, -1) @ hot[::-1].reshape(-1, CLASSES)])
    return float((total.sum() - gold) / lanes), [d_table, d_recurrent, d_output, d_bias, d_moves / lanes]


TRAIN_WINDOW, TRAIN_LANES, EPOCHS, RATE = 64, 96, 13, 0.03


def train(labelled: list[tuple[str, list[Span]]], seed: int = 11, epochs: int = EPOCHS) -> Tagger:
    """Trained by Adam on windows of the labelled texts (text, spans of kind, start, end)."""
    xs, ys = [], []
    for text, spans in labelled:
        x, y = classes_of(text), np.zeros(len(text), np.uint8)
        for kind, start, end in spans:
            y[start:end] = kind + 1
        for k in range(0, max(1, len(x)), TRAIN_WINDOW):
            fill = (0, TRAIN_WINDOW - len(x[k : k + TRAIN_WINDOW]))
            xs.append(np.pad(x[k : k + TRAIN_WINDOW], fill))
            ys.append(np.pad(y[k : k + TRAIN_WINDOW], fill))
    x, y = np.array(xs).reshape(-1, TRAIN_WINDOW).T, np.array(ys).reshape(-1, TRAIN_WINDOW).T
    rng = np.random.default_rng(seed)
    normal = lambda *shape: rng.normal(0, 0.3, shape).astype(np.float32)
    model = Tagger(normal(2, 4 * HIDDEN, CLASSES), normal(2, 4 * HIDDEN, HIDDEN), normal(TAGS, 2 * HIDDEN), np.zeros(TAGS, np.float32), np.zeros((TAGS, TAGS), np.float32))
    model.table[:, HIDDEN : 2 * HIDDEN] += 1  # to remember, at first
    first, second = [np.zeros_like(p) for p in model.parts()], [np.zeros_like(p) for p in model.parts()]
    total, n = epochs * max(1, x.shape[1] // TRAIN_LANES), 0
    for _ in range(epochs if x.shape[1] else 0):
        for own in np.array_split(rng.permutation(x.shape[1]), max(1, x.shape[1] // TRAIN_LANES)):
            _, slopes = gradients(model, x[:, own], y[:, own])
            n += 1
            length = np.sqrt(sum(float((s * s).sum()) for s in slopes))
            rate = RATE * (1 - (n - 1) / total) * np.sqrt(1 - 0.999**n) / (1 - 0.9**n)
            for p, s, m, v in zip(model.parts(), slopes, first, second, strict=True):
                s = s * np.float32(min(1.0, 5 / max(length, 1e-9)))
                m += 0.1 * (s - m)
                v += 0.001 * (s * s - v)
                p -= (rate * m / (np.sqrt(v) + 1e-8)).astype(np.float32)
    return model


# ---------------------------------------------------------------- labelled spans made by a rule

_SYLLABLES = "an ber co del en fi go her in jo ka lor me ni ou pre qui ra st tion um ver wa xi yo zen är ção ñe öst ßen éme ll rr th sch".split()


def labelled_texts(count: int = 900, seed: int = 5) -> list[tuple[str, list[Span]]]:
    """Texts of invented words with personal data in many forms, labelled, and with numbers that are none: dates, prices, versions, keys, web addresses."""
    rng = Random(seed)
    pick = lambda *xs: rng.choice(xs)
    number = lambda n: f"{rng.randrange(10**n):0{n}}"
    below = lambda n: str(rng.randrange(n))

    def word(least: int = 1) -> str:
        return "".join(pick(*_SYLLABLES) for _ in range(rng.randrange(least, 4)))

    def ascii_word() -> str:
        return word(1).encode("ascii", "ignore").decode() or "ka"

    def email() -> str:
        name = pick(ascii_word(), f"{ascii_word()}.{ascii_word()}", f"{ascii_word()}{below(100)}", f"{ascii_word()}_{ascii_word()}", f"{ascii_word()}.{below(100)}")
        host, top = pick(ascii_word(), f"mail{below(10)}", f"{ascii_word()}-{ascii_word()}"), pick("com", "org", "net", "de", "example", "info")
        middle = [ascii_word()] if rng.random() < 0.4 else []
        at, dot = pick(("@", "."), ("@", "."), (" (at) ", "."), (" [at] ", " [dot] "), ("(at)", "(dot)"), (" at ", " dot "), (" @ ", "."), ("[at]", "."), (" {at} ", " dot "))
        return name + at + dot.join([host, *middle, top])

    def ip() -> str:
        return pick(".", ".", "[.]", " dot ", "(.)", " [.] ", "[dot]").join(below(256) for _ in range(4))

    def card() -> str:
        gap = pick("", " ", "-", ".", " ", " ", "/", "–")
        return gap.join(pick([number(4)] * 4, [number(4), number(6), number(5)], [number(4)] * 3 + [number(1)], [number(16)]))

    def phone() -> str:
        a, b, c = number(3), number(3), number(4)
        return pick(f"+{pick('1', '44', '49', '33')} ({a}) {b}-{c}", f"({a}) {b}-{c}", f"{a}-{b}-{c}", f"{a}.{b}.{c}", f"0049 {a} {b}{c}", f"(0{number(2)}) {b} {c}", f"+{below(90)} {number(2)} {b} {c}", f"00{below(90)}-{a}-{b}-{c}", f"0{number(3)}/{b}{c}", f"+{below(90)}{a}{b}{c}")

    def other() -> str:
        year = f"{pick(19, 20)}{number(2)}"
        return pick(
            f"{year}-{number(2)}-{number(2)}", f"{number(2)}.{number(2)}.{year}", f"{number(2)}:{number(2)}:{number(2)}", f"{year}-{number(2)}-{number(2)} {number(2)}:{number(2)}", f"{below(1000)}.{number(2)}", f"v{below(9)}.{below(20)}.{below(9)}",
            f"#{number(6)}", f'token = "{"".join(pick(*"0123456789abcdef") for _ in range(40))}"', f"{below(100)}%", year, f"{below(100)}-{below(200)}", f"{below(100)},{number(3)},{number(3)}", f"{below(90)}.{number(4)}, {below(90)}.{number(4)}",
            f"http://{ascii_word()}.example.net/{ascii_word()}/{number(3)}.html", f"{ascii_word()}_{year}.pdf", f"@{ascii_word()}", f"at {ascii_word()}.com", f"the dot {ascii_word()}", f"978-{below(9)}-{number(2)}-{number(6)}-{below(9)}", number(5), number(9), f"{number(3)}-{number(4)}", f"{ascii_word()}{number(2)}", f"chapter {below(9)}.{below(9)}.{below(9)}", f"{number(8)}-{number(4)}-{number(4)}",
        )

    texts = []
    for _ in range(count):
        out, at, spans = [], 0, []
        for _ in range(rng.randrange(8, 30)):
            draw = rng.random()
            kind = rng.randrange(len(KINDS)) if draw < 0.16 else None
            piece = (email, ip, card, phone)[kind]() if kind is not None else other() if draw < 0.3 else pick(word(), word(), word().capitalize(), word().upper())
            if kind is not None:
                spans.append((kind, at, at + len(piece)))
            piece += pick(" ", " ", " ", " ", ", ", ". ", "\n", ": ", " | ", "; ", ") ", " (", '" ')
            out.append(piece)
            at += len(piece)
        texts.append(("".join(out), spans))
    return texts


@lru_cache(maxsize=1)
def default_model() -> Tagger:
    return train(labelled_texts())


# ---------------------------------------------------------------- windows and their reconciliation

def window_starts(text: str, classes: np.ndarray, every: bool) -> np.ndarray:
    """Starts of the windows to decode: all, or those that touch what a valid proposal must hold."""
    last = max(0, -(-(len(classes) - WINDOW) // STEP))
    if every:
        return np.arange(last + 1) * STEP
    held = np.flatnonzero((classes == _DIGIT) | (classes == _AT_SIGN)).tolist()
    held += [p for m in _SPELT.finditer(text) for p in (m.start(), m.end() - 1)]
    at = np.array(held, np.int64) // STEP
    return np.unique(np.clip(np.concatenate([at, at - 1]), 0, last)) * STEP


def proposals(tags: np.ndarray, start: int, text: str) -> Iterator[Span]:
    """Valid spans of one window's tags, in places of the text. One at an inner edge may be cut off; the next window has it whole."""
    edges = np.flatnonzero(np.diff(tags, prepend=0, append=0))
    for a, b in zip(edges.tolist(), [*edges[1:].tolist(), len(tags)], strict=True):
        kind = int(tags[a]) - 1 if a < len(tags) else -1
        if kind < 0 or (a == 0 and start) or (b == WINDOW and start + b < len(text)):
            continue
        a, b = start + a, min(start + b, len(text))
        while a < b and (text[a].isspace() or text[a] in ",;:"):
            a += 1
        while b > a and (text[b - 1].isspace() or text[b - 1] in ".,;:"):
            b -= 1
        joined = (a > 0 and text[a - 1].isalnum()) or (b < len(text) and text[b].isalnum())
        if a < b and not joined and valid(kind, text[a:b]):
            yield kind, a, b


def reconciled(offered: dict[Span, int], base: list[Span]) -> list[Span]:
    """The disjoint proposals of greatest weight in all, none of which meets a base span; of equal sums, the one with the later end left out."""
    taken = sorted((s, e) for _, s, e in base)
    starts, reach = [s for s, _ in taken], np.maximum.accumulate([e for _, e in taken] or [0]).tolist()

    def free(s: int, e: int) -> bool:
        k = bisect_right(starts, e - 1)
        return not (k and reach[k - 1] > s)

    own = sorted(((x, w) for x, w in offered.items() if free(x[1], x[2])), key=lambda p: (p[0][2], p[0][1], p[0][0]))
    ends = [x[2] for x, _ in own]
    total, before = [0], []
    for k, ((_, s, _), w) in enumerate(own):
        before.append(bisect_right(ends, s, 0, k))
        total.append(max(total[k], total[before[k]] + w))
    out, k = [], len(own)
    while k:
        if total[k] == total[k - 1]:
            k -= 1
        else:
            out.append(own[k - 1][0])
            k = before[k - 1]
    return sorted(out)


def added_spans(model: Tagger, texts: list[str], base: list[list[Span]], every: bool = False) -> list[list[Span]]:
    """What the model adds to the base spans of each text. every: decode all windows, which gives the same."""
    offered: list[dict[Span, int]] = [{} for _ in texts]
    waiting: list[tuple[int, int, np.ndarray]] = []

    def flush() -> None:
        x = np.zeros((WINDOW, len(waiting)), np.uint8)
        for lane, (_, _, own) in enumerate(waiting):
            x[: len(own), lane] = own
        tags = decode(model, x)
        for lane in np.flatnonzero(tags.any(axis=0)).tolist():
            at, start, own = waiting[lane]
            for span in proposals(tags[: len(own), lane], start, texts[at]):
                offered[at][span] = offered[at].get(span, 0) + span[2] - span[1]
        waiting.clear()

    for at, text in enumerate(texts):
        classes = classes_of(text)
        for start in window_starts(text, classes, every).tolist():
            waiting.append((at, start, classes[start : start + WINDOW]))
            if len(waiting) == LANES:
                flush()
    if waiting:
        flush()
    return [reconciled(o, b) for o, b in zip(offered, base, strict=True)]


# ---------------------------------------------------------------- the operator

_SPAN = StructType().add("kind", "string").add("start", "long").add("end", "long")
#: Texts that a task looks at together.
TEXTS = 500


def personal_data(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", model: Callable[[], Tagger] = default_model) -> DataFrame:
    """(id, base, spans) per row of docs: arrays of (kind, start, end) by kind and start; places are code points, ends exclusive.

    spans holds all base spans and those that the model adds, which overlap no other span of the model and none of base. Null texts
    are empty and have none. Each whole text is searched; very long ones are decoded some windows at a time. Of
    equal proposals' weights the earlier end wins. Repeated rows get the same result each; other columns are not read. Rows are worked on by themselves,
    without a shuffle, and an empty table gives an empty result. model: trains or loads the tagger, on the driver.
    """
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    shared = docs.sparkSession.sparkContext.broadcast(model())
    schema = StructType([rows.schema["id"]]).add("base", ArrayType(_SPAN)).add("spans", ArrayType(_SPAN))
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, batch.num_rows, TEXTS):
                part = batch.slice(k, TEXTS)
                seen = np.flatnonzero(pc.match_substring_regex(part.column(1), TRIGGER).to_numpy(zero_copy_only=False))
                texts = part.column(1).take(pa.array(seen)).to_pylist()
                base = [base_spans(t) for t in texts]
                every = [sorted(b + a) for b, a in zip(base, added_spans(shared.value, texts, base), strict=True)]
                columns = []
                for found in (base, every):
                    out: list[list[dict]] = [[] for _ in range(part.num_rows)]
                    for at, spans in zip(seen.tolist(), found, strict=True):
                        out[at] = [{"kind": KINDS[x], "start": s, "end": e} for x, s, e in spans]
                    columns.append(pa.array(out, kind))
                yield pa.RecordBatch.from_arrays([part.column(0), *columns], names=["id", "base", "spans"])
        give_back()

    return rows.mapInArrow(run, schema)


def spans_text(spans: Column) -> Column:
    """kind:start:end of each span, joined by commas."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def span_digests(found: DataFrame) -> DataFrame:
    """(id, n_<kind> of the base spans, base_sha256, spans as text, n_added)."""
    counts = [F.expr(f"size(filter(base, s -> s.kind = '{k}'))").cast("long").alias(f"n_{k}") for k in KINDS]
    more = (F.size("spans") - F.size("base")).cast("long").alias("n_added")
    return found.select("id", *counts, F.sha2(spans_text(F.col("base")), 256).alias("base_sha256"), spans_text(F.col("spans")).alias("spans"), more)
