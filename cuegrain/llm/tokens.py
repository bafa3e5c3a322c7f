"""Token ids of whole texts by a public tokenizer file, with a bounded memory of words seen before."""

from __future__ import annotations

import os
import re
from functools import cache
from itertools import filterfalse

#: Id appended to every document.
END_ID = 2
#: Words whose ids a worker keeps at most; later ones are encoded each time.
KNOWN_WORDS = 800_000
#: Characters encoded together, about.
CHARS = 4_000_000
#: A lone space between two visible characters always begins a token in the tokenizer's pattern.
_CUT = re.compile(r"(?<=\S) (?=\S)")
_SPACES = [chr(c) for c in range(0x3001) if chr(c).isspace() and c != 0x20]


def tokenizer_path(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class Encoder:
    """Encodes batches of whole texts to little-endian unsigned 32-bit ids, the end id last.

    The byte-level pattern never carries a token across a lone space, so a text is cut there, each
    part is encoded once with the tokenizers library and remembered, and a text's ids are its parts'
    ids one after another: the same ids as from the whole text, in a fraction of the time.
    """

    def __init__(self, path: str, end_id: int = END_ID, known_words: int | None = None):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.end = end_id.to_bytes(4, "little")
        self.most = KNOWN_WORDS if known_words is None else known_words
        self.heads: dict[str, bytes] = {}  # the first part of a text, without a space before it
        self.known: dict[str, bytes] = {}  # any other part, as if after a space

    def uneven(self, text: str) -> bool:
        """Whether some space in text is not between two visible characters."""
        return "  " in text or text[:1] == " " or text[-1:] == " " or any(x + " " in text or " " + x in text for x in _SPACES if x in text)

    def alone(self, texts: list[str]) -> list[bytes]:
        import numpy as np

        return [np.array(x.ids, "<u4").tobytes() for x in self.tokenizer.encode_batch(texts, add_special_tokens=False)]

    def learn(self, words: list[str]) -> dict[str, bytes]:
        """Ids of parts after a space, encoded in runs: a run of parts is a text whose cuts are known."""
        import numpy as np

        ends = [x for x in words if x[-1].isspace()]  # only the end of a text ends in white space
        out = dict(zip(ends, self.alone([f" {x}" for x in ends]), strict=True))
        words = [x for x in words if x not in out] if ends else words
        runs = [words[i : i + 512] for i in range(0, len(words), 512)]
        for run, got in zip(runs, self.tokenizer.encode_batch([" " + " ".join(r) for r in runs], add_special_tokens=False), strict=True):
            starts = np.array([s for s, _ in got.offsets])
            at = (4 * np.searchsorted(starts, np.cumsum([0, *(len(x) + 1 for x in run)]))).tolist()
            ids = np.array(got.ids, "<u4").tobytes()
            out.update(zip(run, map(ids.__getitem__, map(slice, at, at[1:])), strict=True))
        return out

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """Ids of whole texts; about CHARS characters are encoded together."""
        out: list[bytes] = []
        held: list[str] = []
        size = 0
        for text in texts:
            held.append(text or "")
            size += len(held[-1])
            if size >= CHARS:
                out += self._together(held)
                held, size = [], 0
        return out + self._together(held) if held else out

    def _together(self, texts: list[str]) -> list[bytes]:
        import numpy as np
        import pyarrow as pa
        import pyarrow.compute as pc

        odd = [i for i, t in enumerate(texts) if self.uneven(t)]
        split = pc.split_pattern(pa.array(texts, pa.large_string()), " ")
        if odd:  # their parts are put in the place of the plain ones
            split = split.to_pylist()
            for i in odd:
                split[i] = _CUT.split(texts[i])
            split = pa.array(split, pa.large_list(pa.large_string()))
        ends = split.offsets.to_numpy()
        coded = split.flatten().dictionary_encode()
        at, distinct = coded.indices.to_numpy().astype(np.int64), coded.dictionary.to_pylist()
        first = ends[:-1]
        heads = [distinct[k] for k in at[first]]
        new = list(set(filterfalse(self.heads.__contains__, heads)))
        self.heads |= dict(zip(new, self.alone(new), strict=True))
        rest = np.ones(len(at), bool)
        rest[first] = False
        used = np.zeros(len(distinct), bool)
        used[at[rest]] = True
        known = list(map(self.known.get, distinct))
        new = [x for x, k, u in zip(distinct, known, used.tolist(), strict=True) if k is None and u]
        ids = self.learn(new) if new else {}
        table = [k if k is not None else ids.get(x, b"") for x, k in zip(distinct, known, strict=True)] if new else [k or b"" for k in known]
        if len(self.known) < self.most:
            self.known |= ids
        # one table of ids for parts, first parts and the end; each text is a row of its places
        table += [self.heads[h] for h in heads]
        table.append(self.end)
        at[first] = len(distinct) + np.arange(len(texts))
        row = np.insert(at, ends[1:], len(table) - 1)
        length = np.fromiter(map(len, table), np.int64, len(table)) // 4
        flat = np.frombuffer(b"".join(table), "<u4")
        begin = (np.cumsum(length) - length)[row]
        n = length[row]
        stop = np.cumsum(n)
        got = flat[np.repeat(begin - (stop - n), n) + np.arange(stop[-1])].tobytes()
        cuts = (4 * stop[ends[1:] + np.arange(len(texts))]).tolist()
        if len(self.heads) > self.most // 10:
            self.heads.clear()
        return [got[a:b] for a, b in zip([0, *cuts], cuts, strict=False)]


@cache
def encoder(path: str, end_id: int = END_ID) -> Encoder:
    """The worker process's encoder, which keeps the words it knows from one task to the next."""
    return Encoder(path, end_id)
