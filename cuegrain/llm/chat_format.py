"""Operator 8: chat formatting with typed content parts, escaped texts and a loss mask.

A turn is a role and a list of parts. A visitor flattens the parts, in order, into text and
placeholders, and records for each attachment where it stands, what it refers to and how many tokens
its placeholder expands to. Control strings that occur in texts are escaped so that the formatted
conversation can be read back to exactly what went in.
"""

from __future__ import annotations

import hashlib
import json
import re
from dataclasses import dataclass, field
from itertools import groupby
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

START, END = "<|im_start|>", "<|im_end|>"
#: Tokens that an attachment expands to, unless its part says so: by kind, from its own measures.
IMAGE_TILE, IMAGE_TILE_TOKENS, AUDIO_TOKENS_A_SECOND, DOCUMENT_TOKENS_A_PAGE = 512, 170, 25, 600
#: Roles whose text is trained on.
LOSS_ROLES = ("assistant",)


def escape(text: str) -> str:
    """Puts a backslash between < and |, after any backslashes there; no control string is left."""
    return re.sub(r"<(\\*)\|", r"<\1\\|", text)


def unescape(text: str) -> str:
    return re.sub(r"<(\\*)\\\|", r"<\1|", text)


def escape_role(role: str) -> str:
    return escape(role.replace("\\", "\\\\").replace("\n", "\\n"))


def unescape_role(role: str) -> str:
    return re.sub(r"\\(n|\\)", lambda m: "\n" if m[1] == "n" else "\\", unescape(role))


#: Kinds of parts and their measures.
MEASURES = {"text": (), "image": ("width", "height", "tokens"), "audio": ("seconds", "tokens"), "document": ("pages", "tokens")}
MOST = 1e9


def _fault(part: Any) -> str | None:
    """Why something is no part that can be formatted."""
    if not isinstance(part, dict):
        return "not an object"
    kind = part.get("type") or "text"
    if not isinstance(kind, str) or kind not in MEASURES:
        return "unknown kind"
    for name in ("text", "ref"):
        value = part.get(name)
        if value is not None and not isinstance(value, str):
            return f"{name} is no text"
        try:
            (value or "").encode()
        except UnicodeEncodeError:
            return f"{name} is no valid Unicode"
    for name in MEASURES[kind]:
        value = part.get(name)
        if value is not None and (isinstance(value, bool) or not isinstance(value, (int, float)) or not 0 <= value <= MOST):
            return f"{name} is no measure"
    return None


def part_list(text: str) -> tuple[list[dict[str, Any]] | None, str | None]:
    """The parts that a JSON text lists, or why it lists none that can be formatted."""
    try:
        parts = json.loads(text)
    except (ValueError, RecursionError):
        return None, "parts are no JSON"
    if not isinstance(parts, list):
        return None, "parts are no list"
    return next(((None, f"part {k}: {fault}") for k, p in enumerate(parts) if (fault := _fault(p))), (parts, None))


@dataclass
class PartVisitor:
    """Flattens one turn's parts; attachments are numbered through the conversation."""

    attachments: list[dict[str, Any]] = field(default_factory=list)

    def flatten(self, parts: list[dict[str, Any]]) -> str:
        """All parts in order. Neighbouring texts are escaped as one, so no control string is made where they meet."""
        out = []
        for is_text, its in groupby(parts, lambda p: (p.get("type") or "text") == "text"):
            out += [escape("".join(p.get("text") or "" for p in its))] if is_text else [self.visit(p) for p in its]
        return "".join(out)

    def visit(self, part: dict[str, Any]) -> str:
        handler = getattr(self, f"visit_{part['type']}", None)
        if handler is None:
            raise ValueError(f"unknown kind of part: {part['type']}")
        return handler(part)

    def visit_image(self, part: dict[str, Any]) -> str:
        tiles = -(-int(part.get("width") or IMAGE_TILE) // IMAGE_TILE) * -(-int(part.get("height") or IMAGE_TILE) // IMAGE_TILE)
        return self.attach("image", part, tiles * IMAGE_TILE_TOKENS)

    def visit_audio(self, part: dict[str, Any]) -> str:
        return self.attach("audio", part, max(1, round(float(part.get("seconds") or 0) * AUDIO_TOKENS_A_SECOND)))

    def visit_document(self, part: dict[str, Any]) -> str:
        return self.attach("document", part, max(1, int(part.get("pages") or 1)) * DOCUMENT_TOKENS_A_PAGE)

    def attach(self, kind: str, part: dict[str, Any], tokens: int) -> str:
        n = len(self.attachments)
        self.attachments.append({"index": n, "kind": kind, "ref": part.get("ref") or "", "tokens": int(part.get("tokens") or tokens)})
        return f"<|{kind}:{n}|>"


@dataclass
class Formatted:
    text: str
    loss: list[tuple[int, int]]  # start and length of each stretch under the mask, in code points
    attachments: list[dict[str, Any]]


def format_conversation(turns: list[tuple[str, list[dict[str, Any]]]]) -> Formatted:
    visitor, out, at, loss = PartVisitor(), [], 0, []
    for role, parts in turns:
        head = f"{START}{escape_role(role)}\n"
        body = visitor.flatten(parts)
        if role in LOSS_ROLES:
            loss.append((at + len(head), len(body)))
        out += [head, body, END, "\n"]
        at += len(head) + len(body) + len(END) + 1
    return Formatted("".join(out), loss, visitor.attachments)


def read_conversation(formatted: str) -> list[tuple[str, str]]:
    """Role and text of each turn, read back; placeholders stay as they stand."""
    turns, at = [], 0
    while at < len(formatted):
        if not formatted.startswith(START, at):
            raise ValueError(f"no turn begins at {at}")
        line = formatted.index("\n", at)
        end = formatted.index(END, line)
        turns.append((unescape_role(formatted[at + len(START) : line]), unescape(formatted[line + 1 : end])))
        at = end + len(END) + 1
    return turns


def read_parts(formatted: str) -> list[tuple[str, list[str | int]]]:
    """Role and parts of each turn, read back: a text as it went in, an attachment as its number."""
    turns, at = [], 0
    while at < len(formatted):
        line = formatted.index("\n", at)
        end = formatted.index(END, line)
        split = _PLACEHOLDER.split(formatted[line + 1 : end])  # texts hold no control string, so these are attachments
        parts: list[str | int] = [int(x) if i % 2 else unescape(x) for i, x in enumerate(split) if i % 2 or x]
        turns.append((unescape_role(formatted[at + len(START) : line]), parts))
        at = end + len(END) + 1
    return turns


_PLACEHOLDER = re.compile(r"<\|(?:image|audio|document):(\d+)\|>")

FORMATTED = "conv_id {kind}, n_turns long, formatted string, loss_start array<long>, loss_length array<long>, attachments array<struct<index int, kind string, ref string, tokens long>>, errors array<string>"


def format_conversations(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", parts_col: str | None = None) -> DataFrame:
    """One row per conversation: conv_id, n_turns, formatted, loss_start, loss_length, attachments, errors.

    Turns are ordered by turn (null first), then role and text, so repeated rows are turns each and
    reruns agree. A null role or text is empty. A row without a conversation id belongs to no other row
    and is a conversation of its own, so such rows meet nowhere. parts_col, if given, holds a JSON list
    of parts (type, text, ref and measures) that stands for the text. A list that cannot be formatted (no JSON, no list,
    an unknown kind, a text or measure of another type, or out of range) is refused whole: its turn stands with its text, and errors says why. Very long texts are formatted
    whole. Other columns are not read. An empty table gives an empty result.
    A conversation is one string and so one task's work; conversations are spread by their ids.
    """
    kind = turns.schema[conv_col].dataType.simpleString()
    parts = F.col(parts_col) if parts_col else F.lit(None).cast("string")
    row = F.struct(F.col(turn_col).alias("turn"), F.coalesce(role_col, F.lit("")).alias("role"), F.coalesce(text_col, F.lit("")).alias("text"), parts.cast("string").alias("parts"))
    lone = F.when(F.col(conv_col).isNull(), F.monotonically_increasing_id())
    grouped = turns.select(F.col(conv_col).alias("conv_id"), lone.alias("lone"), row.alias("row")).groupBy("conv_id", "lone").agg(F.array_sort(F.collect_list("row")).alias("rows")).drop("lone")

    def run(batches):
        for batch in batches:
            out = []
            for conv, rows in zip(batch["conv_id"], batch["rows"], strict=True):
                turns, errors = [], []
                for n, r in enumerate(rows):
                    parts, error = part_list(r["parts"]) if r["parts"] is not None else (None, None)
                    if error:
                        errors.append(f"turn {n}: {error}")
                    turns.append((r["role"], [{"type": "text", "text": r["text"]}] if parts is None else parts))
                made = format_conversation(turns)
                out.append((conv, len(rows), made.text, [a for a, _ in made.loss], [n for _, n in made.loss], made.attachments, errors))
            frame = pd.DataFrame(out, columns=["conv_id", "n_turns", "formatted", "loss_start", "loss_length", "attachments", "errors"])
            yield frame.assign(conv_id=pd.Series([c for c, *_ in out], dtype=batch["conv_id"].dtype))

    return grouped.mapInPandas(run, FORMATTED.format(kind=kind))


def conversation_digests(formatted: DataFrame) -> DataFrame:
    """What each formatted conversation holds, read back from its string and mask."""

    @F.pandas_udf("n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")
    def digest(text: pd.Series, start: pd.Series, length: pd.Series) -> pd.DataFrame:
        out = []
        for x, starts, lengths in zip(text, start, length, strict=True):
            turns = read_conversation(x)
            whole = "".join(f"{role}\n{body}\n" for role, body in turns).encode("utf-8", "surrogatepass")
            masked = "".join(unescape(x[a : a + n]) for a, n in zip(starts, lengths, strict=True))
            out.append((len(turns), hashlib.sha256(whole).hexdigest(), len(masked), hashlib.sha256(masked.encode("utf-8", "surrogatepass")).hexdigest(), len(x)))
        return pd.DataFrame(out, columns=["n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"])

    return formatted.select("conv_id", digest("formatted", "loss_start", "loss_length").alias("d")).select("conv_id", "d.*")


def part_counts(formatted: DataFrame) -> DataFrame:
    """(conv_id, images, audio, documents, attachment_tokens, text_chars) of each formatted conversation, its parts read back."""

    @F.pandas_udf("images long, audio long, documents long, attachment_tokens long, text_chars long")
    def count(text: pd.Series, attachments: pd.Series) -> pd.DataFrame:
        out = []
        for x, its in zip(text, attachments, strict=True):
            found = [p for _, parts in read_parts(x) for p in parts]
            used = [its[p] for p in found if isinstance(p, int)]
            out.append((*(sum(a["kind"] == k for a in used) for k in ("image", "audio", "document")), sum(a["tokens"] for a in used), sum(len(p) for p in found if isinstance(p, str))))
        return pd.DataFrame(out, columns=["images", "audio", "documents", "attachment_tokens", "text_chars"])

    return formatted.select("conv_id", count("formatted", "attachments").alias("d")).select("conv_id", "d.*")
