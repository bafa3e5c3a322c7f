"""Operator 12: fill-in-middle transformation by one counted, possessive match a row.

A text is a sequence of units: runs of A-Z and a-z, and any other character by itself. regexp_count gives their
number n; two hashes of the row's id place the cuts a <= b among them. A pattern made for the row,
(unit{a})(unit{b-a})(rest), then captures prefix, middle and suffix in one match, and its groups are put in
the order of the row's form. Counted groups are possessive, so the matcher loops over units and
neither backtracks nor recurses, however long the text is.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cuegrain.llm.common import text_or_empty

UNIT = "[A-Za-z]++|[^A-Za-z]"
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
MARKER = "<[PSM]>"
#: Of 100 rows, those that are transformed, and of 100 transformed ones those with the suffix first.
TRANSFORMED, SUFFIX_FIRST = 90, 20


def row_hashes(id_col: Column, seed: int) -> list[Column]:
    """Four numbers below 2^32 from the hex sha256 of seed:id; a null id is hashed as an empty one."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(id_col.cast("string"), F.lit(""))), 256)
    return [F.conv(F.substring(digest, 1 + 8 * k, 8), 16, 10).cast("long") for k in range(4)]


def restore_text(output: Column, form: Column) -> Column:
    """The exact text of an output. Transformed texts hold no marker of their own and none can arise where pieces meet, so markers split the output."""
    part = F.split(output, MARKER, -1)
    return F.when(form == "plain", output).when(form == "psm", F.concat(part[1], part[3], part[2])).otherwise(F.concat(part[2], part[3], part[1]))


def fill_in_middle(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", seed: int = 1) -> DataFrame:
    """(id, n, form, prefix_chars, middle_chars, output) per row of docs; form is plain, psm or spm.

    Null texts are empty, and empty texts plain, as are texts that hold a marker. Prefix, middle or suffix may be
    empty. Rows of one id are cut by the same hashes, repeated rows alike; other columns are not read, so their names may clash.
    A row is worked on by itself: no shuffle, and an empty table gives an empty result. Very long texts are
    matched whole, in time and memory linear in their length.
    """
    rows = docs.select(F.col(id_col).alias("id"), text_or_empty(text_col).alias("text"))
    rows = rows.withColumn("n", F.regexp_count("text", F.lit(UNIT)).cast("long"))
    h1, h2, h3, h4 = row_hashes(F.col("id"), seed)
    cut1, cut2 = F.pmod(h1, F.col("n") + 1), F.pmod(h2, F.col("n") + 1)
    plain = (F.col("text") == "") | F.col("text").rlike(MARKER) | (h3 % 100 >= TRANSFORMED)
    rows = rows.select("id", "text", "n", F.least(cut1, cut2).alias("a"), F.greatest(cut1, cut2).alias("b"), F.when(plain, "plain").when(h4 % 100 < SUFFIX_FIRST, "spm").otherwise("psm").alias("form"))

    def units(count: Column) -> list[Column]:
        return [F.lit(f"((?:{UNIT}){{"), count.cast("string"), F.lit("}+)")]

    pattern = F.concat(F.lit("(?s)\\A"), *units(F.col("a")), *units(F.col("b") - F.col("a")), F.lit("(.*)\\z"))
    order = F.when(F.col("form") == "psm", f"{PREFIX}$1{SUFFIX}$3{MIDDLE}$2").otherwise(f"{SUFFIX}$3{PREFIX}$1{MIDDLE}$2")
    output = F.when(F.col("form") == "plain", F.col("text")).otherwise(F.regexp_replace(F.col("text"), pattern, order))
    rows = rows.select("id", "n", "form", output.alias("output"))
    part = F.split("output", MARKER, -1)
    prefix = F.when(F.col("form") == "psm", F.length(part[1])).when(F.col("form") == "spm", F.length(part[2]))
    middle = F.when(F.col("form") != "plain", F.length(part[3]))
    return rows.select("id", "n", "form", prefix.cast("long").alias("prefix_chars"), middle.cast("long").alias("middle_chars"), "output")


def fill_digests(filled: DataFrame) -> DataFrame:
    """filled with the digests of outputs and of the texts rebuilt from them, in the place of the outputs."""
    return filled.withColumns({"output_sha256": F.sha2("output", 256), "restored_sha256": F.sha2(restore_text(F.col("output"), F.col("form")), 256)}).drop("output")
