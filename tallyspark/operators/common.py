"""Join/window helpers shared by operators: skew-safe patterns.

* Blank keys are the classic hot key in exports: they never match anything, so
  they are split off *before* a shuffle join instead of landing in one task.
* Counts per key come from ``groupBy`` (partial aggregation on the map side),
  never from a window that would hold a whole hot group in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import constants as K
from ..functions.exprs import strip


def key_present(cols: list[str]) -> Column:
    """Whether no key is blank: never null, so that the optimizer sees that rows with and without keys exclude each other."""
    cond = F.lit(True)
    for c in cols:
        cond = cond & F.coalesce(~F.lower(strip(F.col(c).cast("string"))).isin(*K.NULL_TOKENS), F.lit(False))
    return cond


def left_join_keyed(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """Left join on ``keys`` where rows of ``left`` with a blank key skip the shuffle
    (they cannot match) and come back with NULL right-hand columns."""
    right_cols = [c for c in right.columns if c not in keys]
    has = key_present(keys)
    matched = left.where(has).join(right.where(key_present(keys)), keys, "left")
    unmatched = left.where(~has)
    for c in right_cols:
        unmatched = unmatched.withColumn(c, F.lit(None).cast(right.schema[c].dataType))
    return matched.unionByName(unmatched)


def counts_per_key(df: DataFrame, keys: list[str], name: str = "_n") -> DataFrame:
    """``count(*)`` per non-blank key via partial aggregation (skew-proof)."""
    return df.where(key_present(keys)).groupBy(*keys).agg(F.count(F.lit(1)).alias(name))


def first_per_key(df: DataFrame, keys: list[str], order: list[Column | str]) -> DataFrame:
    """First row per key by ``order``.  ``row_number() = 1`` gets a partial
    ``WindowGroupLimit`` below the shuffle, so a hot key ships one row per map task."""
    from pyspark.sql import Window as W
    w = W.partitionBy(*keys).orderBy(*order)
    return df.withColumn("__rn", F.row_number().over(w)).where(F.col("__rn") == 1).drop("__rn")


def running_total(df: DataFrame, group: str, order: str, value: str, name: str = "running") -> DataFrame:
    """Exact running sum of ``value`` per ``group`` in ``order`` without putting a whole
    group into one task: range-partition on (group, order), sum inside each range
    partition, then add the totals of the earlier partitions of the same group (a small
    table: at most one row per partition and group).  The range split is written as a
    staged table so that both branches see the same partition ids even after a retry."""
    from pyspark.sql import Window as W
    from ..session import stage_table
    n = max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), 1)
    s = stage_table(df.repartitionByRange(n, group, order).withColumn("_pid", F.spark_partition_id()), "ranges")
    w_local = W.partitionBy("_pid", group).orderBy(order).rowsBetween(W.unboundedPreceding, 0)
    local = s.withColumn("_local", F.sum(value).over(w_local))
    tot = s.groupBy(group, "_pid").agg(F.sum(value).alias("_t"))
    w_off = W.partitionBy(group).orderBy("_pid").rowsBetween(W.unboundedPreceding, -1)
    off = tot.withColumn("_off", F.coalesce(F.sum("_t").over(w_off), F.lit(0))).drop("_t")
    # off has a row per group and range partition; a NULL group is a group like any other
    off = off.select(F.col(group).alias("_g"), F.col("_pid").alias("_p"), "_off")
    return (local.join(off, local[group].eqNullSafe(off["_g"]) & (local["_pid"] == off["_p"]))
            .withColumn(name, F.col("_local") + F.col("_off")).drop("_local", "_off", "_pid", "_g", "_p"))


def top_k_per_group(df: DataFrame, group: str, order: list[Column | str], k: Column | int) -> DataFrame:
    """First ``k`` rows per group.  ``row_number() <= k`` with a literal ``k`` gets a partial
    ``WindowGroupLimit`` below the shuffle (each map task ships <= k rows per group)."""
    from pyspark.sql import Window as W
    w = W.partitionBy(group).orderBy(*order)
    kk = F.lit(k) if isinstance(k, int) else k
    return df.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= kk)


def ordered_distinct(df: DataFrame, value: str, pos: str) -> DataFrame:
    """Distinct values in order of first occurrence: ``min(pos)`` per value (partial
    aggregation), ordered by that position."""
    return df.where(F.col(value).isNotNull()).groupBy(value).agg(F.min(pos).alias("first_pos")).orderBy("first_pos")


def common_columns(a: DataFrame, b: DataFrame) -> list[str]:
    """Column names present on both sides, in the order of ``a`` (schema only)."""
    other = set(b.columns)
    return [c for c in a.columns if c in other]
