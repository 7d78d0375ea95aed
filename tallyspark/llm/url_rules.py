"""URL filter: a range join of urls with host and path rules, by sort and sweep.

A rule ``host/path`` fits its host and all subdomains when the path of the url starts with the
rule's.  A canonical key is the host with its labels reversed, a zero byte, and the path; the keys
that a rule covers for one host are the interval ``[key, key + 0xFF)`` of byte strings (0xFF does
not occur in UTF-8), and such intervals are nested or apart.  Each url is a point once for each
label suffix of its host, no longer than the longest rule host.

The sweep goes over points and interval ends in key order.  Its stack of open rules is kept in the
events themselves: the event at the end of an interval carries the rule around it, found before
from the rule's own prefixes, so that the last event at or before a point names the innermost open
rule.  Sorting and sweeping happen per host and salt.  Urls are counted per host first: a host with more
than a task's share of them has as many salts as shares, each with a copy of that host's events, all
others have one.  DataFrame functions only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import stage_table
from .common import partitions

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def url_host(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z in lower case; else empty."""
    rest = F.substring(url, F.instr(url, "://") + 3, F.length(url))
    host = F.translate(F.regexp_extract(rest, r"^([^/?#]*)", 1), UPPER, LOWER)
    return F.when(F.instr(url, "://") > 0, host).otherwise("")


def url_path(url: Column) -> Column:
    """After the host up to ``?``, ``#`` or the end; empty without ``://``."""
    rest = F.substring(url, F.instr(url, "://") + 3, F.length(url))
    return F.when(F.instr(url, "://") > 0, F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)).otherwise("")


def sweep_key(reversed_host: Column, path: Column) -> Column:
    return F.concat(F.encode(reversed_host, "UTF-8"), F.unhex(F.lit("00")), F.encode(path, "UTF-8"))


def reversed_host(host: Column) -> Column:
    return F.concat_ws(".", F.reverse(F.split(host, r"\.", -1)))


def rule_events(rules: DataFrame) -> DataFrame:
    """Start and end events of the rules' intervals: ``rhost, key, kind, open`` where ``open`` is the
    innermost rule from there on (null fields: none)."""
    r = (rules.select(F.coalesce("host", F.lit("")).alias("host"), F.coalesce("path", F.lit("")).alias("path"), "verdict")
         .groupBy("host", "path").agg(F.max("verdict").alias("verdict"))  # of equal rules, block wins
         .withColumn("rhost", reversed_host(F.col("host"))))
    size = F.length("host") + F.length("path")
    r = r.withColumn("open", F.struct(size.alias("size"), F.length("host").alias("host_size"),
                                      F.concat("host", "path").alias("rule"), "verdict"))
    outer = r.select(F.col("rhost").alias("o_host"), F.col("path").alias("o_path"), F.col("open").alias("around"))
    prefixes = r.withColumn("cut", F.explode(F.sequence(F.lit(0), F.greatest(F.length("path") - 1, F.lit(0)))))
    prefixes = prefixes.where("cut < length(path)").select("rhost", "path", F.expr("left(path, cut)").alias("prefix"))
    inner = prefixes.join(outer, (F.col("rhost") == F.col("o_host")) & (F.col("prefix") == F.col("o_path")))
    around = inner.groupBy(F.col("rhost").alias("a_host"), F.col("path").alias("a_path")).agg(F.max("around").alias("around"))
    r = r.join(around, (F.col("rhost") == F.col("a_host")) & (F.col("path") == F.col("a_path")), "left")
    key = sweep_key(F.col("rhost"), F.col("path"))
    none = F.lit(None)
    nothing = F.struct(none.cast("int").alias("size"), none.cast("int").alias("host_size"),
                       none.cast("string").alias("rule"), none.cast("string").alias("verdict"))
    return r.select("rhost", F.explode(F.array(
        F.struct(key.alias("key"), F.lit(0).alias("kind"), F.col("open")),
        F.struct(F.concat(key, F.unhex(F.lit("FF"))).alias("key"), F.lit(2).alias("kind"),
                 F.coalesce("around", nothing).alias("open")))).alias("e")).select("rhost", "e.*")


def filter_urls(urls: DataFrame, rules: DataFrame, url: str = "url", default: str = "allow",
                salts: int | None = None) -> DataFrame:
    """``urls`` (a stored table: it is counted first) with host, path, rule and verdict of each row (own columns of these
    names are replaced).

    Longest rule wins: most characters of host and path together, then the longer host; of rules
    with the same text the greater verdict (block).  No rule fits: rule null, ``default`` verdict.
    A null url, or one without ``://``, has an empty host and path.  Repeated rows are kept, an
    empty table gives an empty result.  ``salts``: shares of all urls; a host with n of them is spread over n tasks."""
    spark = urls.sparkSession
    salts = salts or partitions(spark)
    labels = rules.agg(F.max(F.size(F.split(F.coalesce("host", F.lit("")), r"\.", -1)))).first()[0] or 1
    own = [c for c in urls.columns if c not in ("host", "path", "rule", "verdict")]
    rows = urls.select(F.struct(*[F.col(f"`{c}`") for c in own]).alias("__row"), url_host(F.col(f"`{url}`")).alias("host"),
                       url_path(F.col(f"`{url}`")).alias("path")).withColumn("__id", F.monotonically_increasing_id())
    parts = F.reverse(F.split("host", r"\.", -1))
    rows = rows.withColumn("__parts", parts)
    points = rows.withColumn("n", F.explode(F.sequence(F.lit(1), F.least(F.lit(labels), F.size("__parts")))))
    points = points.withColumn("rhost", F.concat_ws(".", F.slice("__parts", F.lit(1), F.col("n"))))
    null_open = F.lit(None).cast("struct<size:int,host_size:int,rule:string,verdict:string>")
    # At most ``salts`` hosts for each number of labels hold more than a share, so their table is small at every size.
    share = max(1, -(-urls.count() // salts))
    hot = (points.groupBy("rhost").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > share)
           .select("rhost", F.ceil(F.col("n") / share).alias("__salts")))
    hot = F.broadcast(stage_table(hot, "url-hosts"))
    points = points.join(hot, "rhost", "left")
    points = points.withColumn("__salt", F.pmod(F.xxhash64("__id"), F.coalesce("__salts", F.lit(1).cast("long"))))
    points = points.select("rhost", "__salt", sweep_key(F.col("rhost"), F.col("path")).alias("key"), F.lit(1).alias("kind"),
                           null_open.alias("open"), "__id", F.when(F.col("n") == 1, F.col("__row")).alias("__row"), "host", "path")
    copies = F.sequence(F.lit(0).cast("long"), F.coalesce("__salts", F.lit(1).cast("long")) - 1)
    events = rule_events(rules).join(hot, "rhost", "left").withColumn("__salt", F.explode(copies)).drop("__salts")
    swept = points.unionByName(events, allowMissingColumns=True)
    # One sweep per reversed host and salt: only rules of the very same suffix lie in it.
    w = Window.partitionBy("rhost", "__salt").orderBy("key", "kind").rowsBetween(Window.unboundedPreceding, 0)
    swept = swept.withColumn("found", F.last("open", ignorenulls=True).over(w)).where("kind = 1")
    best = swept.groupBy("__id").agg(
        F.max(F.when(F.col("found.size").isNotNull(), F.col("found"))).alias("found"),
        F.max_by("__row", F.col("__row").isNotNull()).alias("__row"), F.first("host").alias("host"), F.first("path").alias("path"))
    return best.select(*[F.col(f"__row.`{c}`").alias(c) for c in own], "host", "path", F.col("found.rule").alias("rule"),
                       F.coalesce("found.verdict", F.lit(default)).alias("verdict"))
