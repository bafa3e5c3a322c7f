"""What the text operators share: texts, row numbers and bounded broadcasts; scratch files are for all operators."""

from __future__ import annotations

import ctypes

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cuegrain.functions.scratch import cut, scratch_path, shared_folder  # noqa: F401

#: White space as the contracts define it: space and U+0009 to U+000D.
SPACE_RUN = "[\\x20\\x09-\\x0D]+"
WORD = "[^\\x20\\x09-\\x0D]+"
MASK64 = (1 << 64) - 1


def text_or_empty(name: str = "text") -> Column:
    return F.coalesce(F.col(name), F.lit(""))


def smallest_first(id_col: str, row_col: str) -> Column:
    """Orders the rows of a group: smallest id first, null ids last, then the row number."""
    return F.struct(F.col(id_col).isNull().alias("void"), F.col(id_col).alias("id"), F.col(row_col).alias("row"))


#: Rows, and characters and bytes in their columns, of what is broadcast at most.
BROADCAST_ROWS, BROADCAST_BYTES = 1_000_000, 64_000_000


def broadcast_below(df: DataFrame, rows: int = BROADCAST_ROWS, size: int = BROADCAST_BYTES) -> DataFrame:
    """df with a broadcast hint if it has at most `rows` rows and their strings and bytes at most `size`; else as it is, for a shuffled join.

    df should be cheap to read twice, such as a written table.
    """
    long = [F.coalesce(F.octet_length(f.name), F.lit(0)) for f in df.schema.fields if f.dataType.typeName() in ("string", "binary")]
    total = sum(long, F.lit(0)).cast("long")
    found = df.agg(F.count("*").alias("n"), F.coalesce(F.sum(total), F.lit(0)).alias("size")).first()
    return F.broadcast(df) if found.n <= rows and found.size <= size else df


def give_back() -> None:
    """Returns memory that Python has freed to the system; workers live on from task to task. Without glibc, only Arrow's."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


#: Parts at most into which the rows of a group are dealt when they meet the group's totals.
SLICES = 64


def slice_of(member: str) -> Column:
    return F.pmod(F.xxhash64(member), F.lit(SLICES)).cast("int")


def slices_of(member: str) -> Column:
    """An aggregate: the slices that a group's members fall in, as bits."""
    return F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), slice_of(member)))


def meet_totals(rows: DataFrame, totals: DataFrame, key: str, member: str, how: str = "inner") -> DataFrame:
    """rows with the columns of their group's row in totals, which has `slices`, made by slices_of(member).

    The join is by key and slice, so the rows of a hot key are up to SLICES tasks' work, and a group
    of a few rows makes no more rows than it has itself. `how` is inner or left.
    """
    each = F.explode(F.expr(f"filter(sequence(0, {SLICES - 1}), s -> getbit(slices, s) = 1)"))
    spread = totals.withColumn("__slice", each).drop("slices")
    return rows.withColumn("__slice", slice_of(member)).join(spread, [key, "__slice"], how).drop("__slice")
