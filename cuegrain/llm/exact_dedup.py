"""Operator 6: exact deduplication with a heavy-hitter split. DataFrame operations only."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cuegrain.llm.common import SPACE_RUN, broadcast_below, cut, text_or_empty

#: A digest with more than 1/HEAVY_SHARE of all rows counts as heavy; so there are fewer than HEAVY_SHARE of them.
HEAVY_SHARE = 512
#: Counters of a Misra-Gries summary; far more than HEAVY_SHARE, so that none of those is missed.
COUNTERS = 4096
#: Summaries are merged in two levels, by this many tasks first.
MERGERS = 64


def text_digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", row_col: str | None = None, mark: Column | None = None) -> DataFrame:
    """(id, mark, row, digest): the SHA-256 of each text after turning white-space runs into one space."""
    plain = F.regexp_replace(text_or_empty(text_col), SPACE_RUN, " ")
    number = F.col(row_col) if row_col else F.monotonically_increasing_id()
    mark = F.lit(0).cast("long") if mark is None else mark
    return docs.select(F.col(id_col).alias("id"), mark.alias("mark"), number.alias("row"), F.sha2(plain, 256).alias("digest"))


def frequent_digests(digests: DataFrame) -> DataFrame:
    """(digest): candidates for the heavy digests, from mergeable Misra-Gries summaries, at most HEAVY_SHARE rows.

    approx_top_k keeps the Misra-Gries counters (a frequent-items sketch). Each input task fills one
    summary, MERGERS tasks merge those, one merges the rest; no digest is shuffled.
    """
    merged = (
        digests.groupBy(F.pmod(F.spark_partition_id(), F.lit(MERGERS)).alias("merger"))
        .agg(F.expr(f"approx_top_k_accumulate(digest, {COUNTERS})").alias("summary"), F.count("*").alias("n"))
        .groupBy(F.lit(0).alias("one"))  # a key, so that an empty table has no summary
        .agg(F.expr(f"approx_top_k_combine(summary, {COUNTERS})").alias("summary"), F.sum("n").alias("n"))
    )
    tops = merged.select("n", F.explode(F.expr(f"approx_top_k_estimate(summary, {HEAVY_SHARE})")).alias("top"))
    return tops.where(f"top.count > 1 AND top.count * {HEAVY_SHARE} > n").select(F.col("top.item").alias("digest"))


def duplicate_groups(digests: DataFrame) -> DataFrame:
    """digests (id, mark, row, digest) with keep (struct void, id, mark, row of the row that stays) and group_size.

    Heavy digests: the candidates are counted exactly, and these winners, at most HEAVY_SHARE rows,
    are broadcast to the rows, which then need no shuffle. All others meet in an ordinary shuffle by
    digest, in groups of at most about 1/HEAVY_SHARE of the rows.
    """
    ordered = digests.withColumn("order", F.struct(F.col("id").isNull().alias("void"), "id", "mark", "row"))
    candidates = F.broadcast(frequent_digests(digests))
    winners = ordered.join(candidates, "digest").groupBy("digest").agg(F.min("order").alias("keep"), F.count("*").alias("group_size"))
    winners = cut(winners.coalesce(1), "heavy-digests")
    heavy = ordered.join(F.broadcast(winners), "digest")
    rest = ordered.join(F.broadcast(winners.select("digest")), "digest", "left_anti")
    same = Window.partitionBy("digest")
    rest = rest.withColumns({"keep": F.min("order").over(same), "group_size": F.count("*").over(same)})
    return heavy.select("id", "row", "digest", "keep", "group_size").unionByName(rest.select("id", "row", "digest", "keep", "group_size"))


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", row_col: str | None = None, mark: Column | None = None) -> DataFrame:
    """One row per input row: id, row, keep_id, group_size, kept, text_sha256.

    A null text is an empty one, and all empty texts form a group. The smallest id stays; a null id
    stays only if the group has no other; of repeated rows with that id one stays, with the smallest
    mark, if given, then the smallest row number. row_col numbers the rows if the caller needs to find
    them again. Very long texts are digested whole. Other columns are not read, whatever their names.
    An empty table gives an empty result.
    """
    digests = cut(text_digests(docs, id_col, text_col, row_col, mark), "digests")
    groups = duplicate_groups(digests)
    return groups.select("id", "row", F.col("keep.id").alias("keep_id"), "group_size", (F.col("row") == F.col("keep.row")).alias("kept"), F.col("digest").alias("text_sha256"))


def drop_exact_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs that stay, with their columns.

    Each text is digested once, and the keys of the rows that go are broadcast, or meet the rows in a
    shuffle if they are many. A row's key is its file and place, if docs is a table of files as it is
    read; else docs is written once with row numbers, so that both reads number alike. Of repeated rows
    with one id and text but other columns, the one with the smallest hash of its columns (but maps)
    stays, so that reruns agree.
    """
    plain = [f.name for f in docs.schema.fields if "map<" not in f.dataType.simpleString()]
    keyed = _with_file_keys(docs) or cut(docs.withColumn("__cg_row", F.monotonically_increasing_id()), "numbered")
    found = exact_dedup(keyed, id_col, text_col, row_col="__cg_row", mark=F.xxhash64(*plain))
    gone = cut(found.where("NOT kept").select(F.col("row").alias("__cg_row")), "gone")
    return keyed.join(broadcast_below(gone), "__cg_row", "left_anti").select(*docs.columns)


def _with_file_keys(docs: DataFrame) -> DataFrame | None:
    """docs with __cg_row: a hash of the file that holds the row, and its place there; None if docs is not files as they are read."""
    key = F.struct(F.xxhash64("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("at"))
    try:
        return docs.withColumn("__cg_row", key)
    except AnalysisException:
        return None
