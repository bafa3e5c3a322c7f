"""The recogniser hook: a batch function of the caller's, loaded once per task, and the job's parameters."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame

FALSY = {"0", "false", "no", "off", ""}
TOKENS = "recording_id long, chunk_id long, duration double, idx long, text string, start double, end double, confidence double"


@dataclass(frozen=True)
class Settings:
    """Longest chunk and overlap in seconds, emission lag in seconds, and whether words are aligned to the audio."""

    chunk_seconds: float = 20.0
    overlap_seconds: float = 2.0
    lag_seconds: float = 0.146
    align: bool = True

    @classmethod
    def from_text(cls, values: dict[str, str]) -> Settings:
        """From strings, such as a job's arguments; absent ones keep their defaults."""
        out = {k: float(values[k]) for k in ("chunk_seconds", "overlap_seconds", "lag_seconds") if values.get(k)}
        if "align" in values:
            out["align"] = values["align"].strip().lower() not in FALSY
        return cls(**out)


def recognise(chunks: DataFrame, load: Callable[[], Callable[[pd.DataFrame], pd.DataFrame]]) -> DataFrame:
    """Tokens of chunks: load() gives a function from a batch of chunks to token rows (chunk-relative times)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        transcribe = load()
        for batch in batches:
            yield transcribe(batch)

    return chunks.mapInPandas(run, TOKENS)


def one_word_a_second() -> Callable[[pd.DataFrame], pd.DataFrame]:
    """A stand-in recogniser: a word for each whole second of a chunk."""

    def transcribe(batch: pd.DataFrame) -> pd.DataFrame:
        rows = [(r.recording_id, r.chunk_id, r.end - r.start, k, f"▁word{k}", float(k), k + 0.5, 1.0) for r in batch.itertuples() for k in range(int(r.end - r.start))]
        return pd.DataFrame(rows, columns=[x.split()[0] for x in TOKENS.split(", ")])

    return transcribe
