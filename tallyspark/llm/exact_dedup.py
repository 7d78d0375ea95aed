"""Exact deduplication by distributed MSD radix partitioning.

Documents are split by successive bytes: a round groups the documents of each open group by their
next bytes, drops groups of one (nothing equals them) and closes groups whose texts have ended (they
are equal, compared byte by byte).  The other groups go on with the rest of their texts.  The digit
grows eightfold from round to round up to a fixed width, so a text of n bytes takes few rounds, and
each round reads only what is still open.  No digest decides equality.

A group with a third of all rows is counted by partial aggregation.  The groups of two and more are
written as a table, so that both sides of the join back are plain shuffles and a hot group's rows are
split over tasks at run time (skew join); where the table is small enough Spark broadcasts it.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import stage_table

FIRST_DIGIT, GROWTH, WIDEST_DIGIT = 128, 8, 1 << 19


def _rows(docs: DataFrame, text: str, doc_id: str) -> DataFrame:
    """Row numbers are those of the scan: ``docs`` must give the same rows in the same order again,
    as a stored table does."""
    return docs.select(F.col(f"`{doc_id}`").alias("doc_id"), F.monotonically_increasing_id().alias("row_id"),
                       F.coalesce(F.col(f"`{text}`").cast("string"), F.lit("")).alias("rest"))


def copies(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", first_digit: int = FIRST_DIGIT,
           growth: int = GROWTH, widest: int = WIDEST_DIGIT) -> DataFrame:
    """``row_id, keep_id, keep_row, group_size`` of the rows whose text occurs more than once.

    Of equal texts the row with the largest doc_id stays (a null id is smallest, and of rows with
    the same id the one with the largest ``row_id`` stays).  Null text is an empty text.  Repeated
    rows count as members.  An empty table gives an empty result."""
    open_rows = _rows(docs, text, doc_id).withColumn("rest", F.encode("rest", "UTF-8")).withColumn("grp", F.lit(0).cast("long"))
    closed, width = [], first_digit
    while True:
        parts = open_rows.withColumn("digit", F.substring("rest", 1, width)).withColumn("ended", F.length("rest") <= width)
        groups = parts.groupBy("grp", "digit", "ended").agg(F.count(F.lit(1)).alias("group_size"),
                                                            F.max(F.struct("doc_id", "row_id")).alias("top"))
        groups = stage_table(groups.where("group_size > 1"), "radix-groups")
        # The next name of a group is the number of the row that would stay.
        found = parts.join(groups, ["grp", "digit", "ended"]).select(
            "doc_id", "row_id", "ended", F.when(~F.col("ended"), F.expr(f"substring(rest, {width + 1})")).alias("rest"),
            F.col("top.row_id").alias("grp"), F.col("top.doc_id").alias("keep_id"), "group_size")
        found = stage_table(found, "radix-rows")
        closed.append(found.where("ended").select("row_id", "keep_id", F.col("grp").alias("keep_row"), "group_size"))
        open_rows = found.where("NOT ended").select("doc_id", "row_id", "rest", "grp")
        if open_rows.isEmpty():
            return reduce(DataFrame.unionByName, closed)
        width = min(widest, width * growth)


def dedup_report(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", **options) -> DataFrame:
    """``doc_id, keep_id, group_size, kept, text_sha256`` of every row; see :func:`copies`.  The digest
    is for the reader only."""
    rows = _rows(docs, text, doc_id).withColumn("text_sha256", F.sha2("rest", 256)).drop("rest")
    found = copies(docs, text, doc_id, **options).withColumnRenamed("row_id", "copy_row")
    copied = F.col("copy_row").isNotNull()
    return rows.join(found, F.col("row_id") == F.col("copy_row"), "left").select(
        "doc_id", F.when(copied, F.col("keep_id")).otherwise(F.col("doc_id")).alias("keep_id"),
        F.coalesce("group_size", F.lit(1).cast("long")).alias("group_size"),
        F.when(copied, F.col("row_id") == F.col("keep_row")).otherwise(True).alias("kept"), "text_sha256")


def drop_copies(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", **options) -> DataFrame:
    """``docs`` with one row of each text (see :func:`copies`); all columns stay."""
    dropped = copies(docs, text, doc_id, **options).where("row_id <> keep_row").select(F.col("row_id").alias("__dropped"))
    rows = docs.withColumn("__row", F.monotonically_increasing_id())
    return rows.join(dropped, F.col("__row") == F.col("__dropped"), "left_anti").drop("__row")
