"""Change tracking.

Plans are shaped for skew: the first row per key is taken with
``row_number() = 1`` (Spark adds a partial ``WindowGroupLimit`` before the
shuffle, so a hot key ships one row per map task) or with partial aggregates, and
blank keys never enter a shuffle.  The snapshot diff, which reports every row of a key,
deals each row once by a key that tells rows apart.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DateType, IntegralType, NumericType, TimestampNTZType, TimestampType

from ..functions import constants as K
from ..functions import exprs as X
from .common import first_per_key, key_present
from .normalize import col, q


AMOUNT_NAME = re.compile(r"amount|amt|total|value|price|tax$|^[cis]gst|^vat", re.IGNORECASE)


def canonical(df: DataFrame, c: str, amounts: list[str] | None = None) -> Column:
    """Canonical comparison text: NULL -> '', trimmed; dates ISO; typed numbers, and text in amount
    columns (named ones, else by header), in one decimal form, so ``10000`` equals ``10000.0`` (T12).
    Other text is compared as it is: ``007`` and ``7`` are two codes."""
    t = df.schema[c].dataType
    txt = X.strip(col(c).cast("string"))
    if isinstance(t, (DateType, TimestampType, TimestampNTZType)):
        return F.coalesce(txt, F.lit(""))
    if isinstance(t, NumericType) or (c in amounts if amounts is not None else AMOUNT_NAME.search(c)):
        # 38 digits: at most 18 places; what does not fit is compared as text rather than rounded
        number = F.when(txt.rlike(X.NUM_RE), txt.try_cast("decimal(38,18)"))
        exact = F.when(F.length(F.regexp_extract(txt, r"\.(\d*)", 1)) <= 18, number.cast("string"))
        return F.coalesce(exact, txt, F.lit(""))
    return F.coalesce(txt, F.lit(""))


def snapshot_diff(current: DataFrame, previous: DataFrame, key: str | None = None, order: str | None = None,
                  compare: list[str] | None = None, amounts: list[str] | None = None) -> DataFrame:
    """One row per reported input row: ``change_type`` in added / modified / unchanged /
    deleted / unkeyed, and ``changed_columns`` for modified keys.

    Without ``key`` the first fitting candidate is taken (:func:`choose_key`).  The first row per key on
    each side (by ``order``, ties by content) is compared over the common columns; every current row of a
    modified key is reported (deleted: every previous row).  Both sides are dealt by key once, each row with its
    compared content as one text; a key's rows are then judged where they are (a window, which spills)."""
    from pyspark.sql import Window as W
    key = key or choose_key(current, previous)
    if key is None:
        raise ValueError("no column can serve as key")
    order = order or key
    common = [c for c in current.columns if c in set(previous.columns) and c != key]
    compare = [c for c in (compare or common) if c in common]
    cur_k = key_present([key])
    cur, prev = current.where(cur_k), previous.where(cur_k)

    # whole numbers on both sides are equal, and in the same order, as plain text: no decimal form is made of them
    whole = {c for c in compare if all(isinstance(df.schema[c].dataType, IntegralType) for df in (current, previous))}
    names = [key, *(c for c in current.columns if c != key)]
    late = [c for c in previous.columns if c not in set(names)]

    def content(df: DataFrame) -> Column:
        text = [F.coalesce(col(c).cast("string"), F.lit("")) if c in whole else canonical(df, c, amounts) for c in compare]
        # rows of one key have the same order when that is the key
        return F.struct(*([] if order == key else [col(order).alias("_o")]), packed(text).alias("_v"))

    def side(df: DataFrame, mine: str, other: str) -> DataFrame:
        c = content(df)
        return df.select("*", c.alias(mine), F.lit(None).cast(df.select(c).schema[0].dataType).alias(other))

    both = side(cur, "_c", "_p").unionByName(side(prev, "_p", "_c"), allowMissingColumns=True)
    of_key = W.partitionBy(q(key))
    j = both.select("*", F.min("_c").over(of_key)["_v"].alias("_now"), F.min("_p").over(of_key)["_v"].alias("_was"))
    differs = F.col("_now") != F.col("_was")
    found = (F.when(F.col("_was").isNull(), F.lit("added")).when(F.col("_now").isNull(), F.lit("deleted"))
              .when(differs, F.lit("modified")).otherwise(F.lit("unchanged")))
    parts = F.arrays_zip(unpacked(F.col("_now")).alias("a"), unpacked(F.col("_was")).alias("b"), F.array(*map(F.lit, compare)).alias("name"))
    changed = F.transform(F.filter(parts, lambda p: p["a"] != p["b"]), lambda p: p["name"]) if compare else F.array().cast("array<string>")
    judged = (j.where(F.col("_c").isNotNull() | F.col("_now").isNull())
              .select(*map(col, names), found.alias("change_type"), F.when(differs, F.concat_ws(", ", changed)).otherwise(F.lit("")).alias("changed_columns"), *map(col, late)))
    unkeyed = (current.where(~cur_k).withColumn("change_type", F.lit("unkeyed"))
               .withColumn("changed_columns", F.lit("")))
    return judged.unionByName(unkeyed, allowMissingColumns=True)


def packed(texts: list[Column]) -> Column:
    """Texts as one, equal and in the same order as the list of them: each ends with a zero, and what is below 2 in a
    text is written as two characters."""
    plain = [F.replace(F.replace(t, F.lit("\1"), F.lit("\1\2")), F.lit("\0"), F.lit("\1\1")) for t in texts]
    return F.concat(F.lit(""), *[x for t in plain for x in (t, F.lit("\0"))])


def unpacked(text: Column) -> Column:
    """The (escaped) texts of :func:`packed`, and an empty one."""
    return F.split(text, "\0")


def change_stats(diff: DataFrame) -> DataFrame:
    return diff.groupBy("change_type").agg(F.count(F.lit(1)).alias("rows"))


def top_new_vendors(diff: DataFrame, vendor: str, k: int = 3) -> DataFrame:
    """Top ``k`` vendors among added rows (ties by vendor name)."""
    return (diff.where(F.col("change_type") == "added").groupBy(vendor).agg(F.count(F.lit(1)).alias("added_rows"))
            .orderBy(F.desc("added_rows"), F.asc(vendor)).limit(k))


def key_sets(current: DataFrame, previous: DataFrame, key: str, kind: str) -> DataFrame:
    """Distinct non-blank keys only on the current side (added), only on the previous
    side (deleted), or on both (common)."""
    c = current.where(key_present([key])).select(key).distinct()
    p = previous.where(key_present([key])).select(key).distinct()
    if kind == "added":
        return c.join(p, key, "left_anti")
    if kind == "deleted":
        return p.join(c, key, "left_anti")
    return c.join(p, key, "left_semi")


def delta_with_reason(current: DataFrame, previous: DataFrame, keys: list[str] = K.DELTA_KEYS,
                      compare: list[str] = K.DELTA_COMPARE, order: str | None = None) -> DataFrame:
    """Composite-key delta: ``New Upload`` / ``Modified`` (reason lists the changed
    columns) / ``Deleted``; unchanged keys dropped.  Values compared as text, NULL as ''.
    A repeated composite key keeps its first row by ``order``, ties by content (T10); ``dup_rows``
    reports how many.  Both sides meet in one aggregate."""
    cols = keys + compare

    def side(df: DataFrame, tag: str) -> DataFrame:
        text = {c: F.coalesce(col(c).cast("string"), F.lit("")) for c in cols}
        return df.select(*[text[c].alias(c) for c in keys], F.lit(tag).alias("_side"),
                         F.struct((col(order) if order else F.lit(0)).alias("_o"), F.struct(*[text[c].alias(c) for c in compare]).alias("_v")).alias("_r"))

    is_c, is_p = F.col("_side") == "c", F.col("_side") == "p"
    both = side(current, "c").unionByName(side(previous, "p"))
    j = both.groupBy(*keys).agg(F.min(F.when(is_c, F.col("_r")))["_v"].alias("_c"), F.count_if(is_c).alias("_n_c"),
                                F.min(F.when(is_p, F.col("_r")))["_v"].alias("_p"), F.count_if(is_p).alias("_n_p"))
    diffs = F.array_compact(F.array(*[
        F.when(F.col(f"_c.`{c}`") != F.col(f"_p.`{c}`"), F.lit(f"{c} changed")) for c in compare]))
    out = j.select(
        *keys,
        *[F.coalesce(F.col(f"_c.`{c}`"), F.col(f"_p.`{c}`")).alias(c) for c in compare],
        F.when(F.col("_p").isNull(), F.lit("New Upload")).when(F.col("_c").isNull(), F.lit("Deleted"))
         .when(F.size(diffs) > 0, F.lit("Modified")).alias("Status"),
        F.when(F.col("_p").isNull(), F.lit("Not found in previous file"))
         .when(F.col("_c").isNull(), F.lit("Missing in current file"))
         .otherwise(F.concat_ws(", ", diffs)).alias("Reason"),
        F.greatest(F.coalesce(F.col("_n_c"), F.lit(0)), F.coalesce(F.col("_n_p"), F.lit(0))).alias("dup_rows"))
    return out.where(F.col("Status").isNotNull())


def detect_keys(df: DataFrame, candidates: list[str], threshold: float = K.KEY_RATIO,
                approximate: bool = False) -> DataFrame:
    """Per candidate column: distinct / non-null (``choose`` rule) and distinct / rows
    (``list`` rule) ratios, one aggregate; ``approximate`` uses HyperLogLog for wide data."""
    present = [c for c in candidates if c in df.columns]
    cd = (lambda c: F.approx_count_distinct(col(c))) if approximate else (lambda c: F.count_distinct(col(c)))
    aggs = [F.count(F.lit(1)).alias("_rows")]
    for i, c in enumerate(present):
        aggs += [cd(c).alias(f"d{i}"), F.count(col(c)).alias(f"n{i}")]
    wide = df.agg(*aggs)
    rows = []
    for i, c in enumerate(present):
        rows.append(F.struct(F.lit(i).alias("preference"), F.lit(c).alias("column_name"),
                             F.col(f"d{i}").alias("distinct_values"), F.col(f"n{i}").alias("non_null"),
                             F.col("_rows").alias("total_rows")))
    out = wide.select(F.explode(F.array(*rows)).alias("r")).select("r.*")
    return out.select("*",
                      (F.col("distinct_values") > F.col("non_null") * threshold).alias("choose_ok"),
                      (F.col("distinct_values") > F.col("total_rows") * threshold).alias("list_ok"))


def choose_key(df: DataFrame, other: DataFrame, preferred: str | None = None) -> str | None:
    """First candidate (preferred first) present on both sides whose distinct/non-null > 0.8."""
    cands = ([preferred] if preferred else []) + [c for c in K.KEY_CANDIDATES_CHOOSE if c != preferred]
    cands = [c for c in cands if c in df.columns and c in other.columns]
    if not cands:
        return None
    for r in detect_keys(df, cands).orderBy("preference").collect():
        if r["choose_ok"]:
            return r["column_name"]
    return None


def dedupe_keep_first(df: DataFrame, keys: list[str], order: str) -> DataFrame:
    """First row per non-blank key by ``order``; blank-key rows pass through untouched."""
    has = key_present(keys)
    return first_per_key(df.where(has), keys, [col(order)]).unionByName(df.where(~has))


def latest_runs(runs: DataFrame, by: str = "run_date", n: int = 2) -> DataFrame:
    """The ``n`` most recent distinct run dates (top-k is the feature)."""
    return runs.select(by).where(F.col(by).isNotNull()).distinct().orderBy(F.desc(by)).limit(n)


def previous_snapshot(snaps: DataFrame, as_of, by: str = "run_date") -> DataFrame:
    """Rows of the newest snapshot strictly before ``as_of`` (T7 fixed: no future dates)."""
    cutoff = X.as_of_lit(as_of)
    prev = snaps.where(F.col(by) < cutoff).agg(F.max(by).alias("_d"))
    return snaps.where(F.col(by) < cutoff).join(prev, F.col(by) == F.col("_d"), "left_semi")


def latest_partition(snaps: DataFrame, as_of, by: str = "run_date") -> DataFrame:
    """Today's partition if present, else the newest one not after ``as_of``."""
    cutoff = X.as_of_lit(as_of)
    last = snaps.where(F.col(by) <= cutoff).agg(F.max(by).alias("_d"))
    return snaps.where(F.col(by) <= cutoff).join(last, F.col(by) == F.col("_d"), "left_semi")
