"""Similarity join of documents on word n-grams: rare-first prefix filtering with verification.

A document's set holds the 64-bit hashes of its distinct shingles.  All sets are sorted by one order
of the shingles, rare ones first; of two sets with Jaccard similarity t or more the prefixes of
``n - ceil(t n) + 1`` shingles meet, so only prefixes are joined.

1. A pass over the texts gives every row the digest of its set, and the shingle counts in a table of
   a fixed number of hashed buckets (summed as a tree; its size does not grow with the data, and any
   order is exact: the counts only make it rare-first).  Rows with equal sets form a class, of which
   one member goes on.
2. A second pass gives the prefixes; of equal sets a task gives one, or one again after many others.
3. Prefix shingles with two classes or more make candidates.  First every class is tried with one hub
   of each of its shingles; pairs that verify are contracted to components.  While some shingles' components leave
   many more pairs than members, further hubs of these are drawn, turn by turn more of them, and contracted: a group of
   near copies comes together in a few turns, each with some pairs per member.  Then the pairs across components that are left
   are tried, from every class outside the shingle's largest component to all others.
   Pairs within a component cannot change the result and are not made.
4. Length and positional filters act in the joins; the suffix filter and the exact overlap act on
   the whole sets, once per pair.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from math import ceil

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import settings, stage_table
from .common import GOLDEN, U64, bounded_batches, mix64, slices, utf8
from .components import components

WORDS, PERCENT = 5, 80
#: Further hubs are drawn while the pairs across components might be so many times their members; so many a shingle, turn by turn.
PAIRS_A_ROW, HUBS = 4, (8, 128)
VERIFY_BYTES = 4 << 20  # of an Arrow batch of pairs of sets
BUCKET_BITS, BLOCK_BITS, FAN = 22, 16, 64
SLICE_BYTES = 512 << 10  # a slice's hashes take some 30 times its bytes
WAITING, MOST_SEEN = 1 << 20, 1 << 16  # of a task: hashes that wait to be counted, sets known to be given
BASE = U64(0x5851F42D4C957F2D)  # an odd multiplier
BASE_INVERSE = U64(pow(int(BASE), -1, 1 << 64))
IS_SPACE = np.zeros(256, bool)
IS_SPACE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 0x20
_powers: dict[str, np.ndarray] = {}


def _power_tables(size: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers.get("up", ())) < size:
        for name, base in (("up", BASE), ("down", BASE_INVERSE)):
            t = np.full(size, base, U64)
            t[0] = 1
            _powers[name] = np.cumprod(t, dtype=U64)
    return _powers["up"], _powers["down"]


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words of a slice (A-Z lowered) and, per row, the number of the first word, with the total last."""
    if not len(data):
        return np.zeros(0, U64), np.zeros(len(starts) + 1, np.int64)
    letters = ~IS_SPACE[data]
    before, after = np.empty_like(letters), np.empty_like(letters)
    before[0], before[1:] = False, letters[:-1]
    after[-1], after[:-1] = False, letters[1:]
    full = starts < ends
    before[starts[full]] = False
    after[ends[full] - 1] = False
    begin, end = np.flatnonzero(letters & ~before), np.flatnonzero(letters & ~after) + 1
    up, down = _power_tables(len(data) + 1)
    sums = np.zeros(len(data) + 1, U64)
    np.cumsum((LOWER[data].astype(U64) + U64(1)) * up[: len(data)], out=sums[1:])
    words = (sums[end] - sums[begin]) * down[begin] + (end - begin).astype(U64) * GOLDEN
    return mix64(words), np.append(np.searchsorted(begin, starts), len(begin))


def shingle_sets(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, width: int = WORDS) -> Iterator[np.ndarray]:
    """Per row the sorted distinct shingle hashes (a shorter text is one shingle, one without words none)."""
    words, first = word_hashes(data, starts, ends)
    odd = mix64(np.arange(1, width + 1, dtype=U64) * GOLDEN) | U64(1)
    grams = np.zeros(max(0, len(words) - width + 1), U64)
    for j in range(width):
        grams += words[j: j + len(grams)] * odd[j]
    grams = mix64(grams)
    for a, b in zip(first[:-1].tolist(), first[1:].tolist()):
        if b - a >= width:
            yield np.unique(grams[a: b - width + 1])
        elif b > a:
            yield mix64((words[a:b] * odd[: b - a]).sum(keepdims=True) + odd[b - a])
        else:
            yield np.zeros(0, U64)


def set_digest(s: np.ndarray) -> int:
    return int((mix64(s ^ BASE).sum(keepdims=True) ^ np.bitwise_xor.reduce(mix64(s * BASE), keepdims=True)).view(np.int64)[0])


def bucket(s: np.ndarray) -> np.ndarray:
    return (s >> U64(64 - BUCKET_BITS)).astype(np.int64)


def _rows(docs: DataFrame, text: str, doc_id: str) -> DataFrame:
    """Row numbers are those of the scan: ``docs`` has to be a stored table."""
    return docs.select(F.monotonically_increasing_id().alias("row"), F.col(f"`{doc_id}`").cast("long").alias("doc_id"),
                       F.col(f"`{text}`").cast("string").alias("text"))


def _pack(counts: np.ndarray) -> bytes:
    return zstandard.ZstdCompressor(level=3).compress(counts.tobytes())


def _unpack(packed: bytes) -> np.ndarray:
    return np.frombuffer(zstandard.ZstdDecompressor().decompress(packed), np.uint32)


class BucketCounts:
    """Hashes per bucket; so many wait to be counted at once that this takes little more than the table."""

    def __init__(self) -> None:
        self.counts = np.zeros(1 << BUCKET_BITS, np.uint32)
        self.waiting, self.held = [], 0

    def add(self, s: np.ndarray) -> None:
        for at in range(0, len(s), WAITING):
            some = bucket(s[at: at + WAITING]).astype(np.uint32)
            self.waiting.append(some)
            self.held += len(some)
            if self.held >= WAITING:
                self.total()

    def total(self) -> np.ndarray:
        if self.waiting:
            at, n = np.unique(np.concatenate(self.waiting), return_counts=True)
            self.counts[at] += n.astype(np.uint32)
            self.waiting, self.held = [], 0
        return self.counts


def digests_and_counts(rows: DataFrame, width: int) -> DataFrame:
    """Rows with ``row, doc_id, digest, n`` and rows with ``block, part, counts`` (the task's bucket counts)."""
    names = ["row", "doc_id", "digest", "n", "block", "part", "counts"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = BucketCounts()
        for batch in slices(batches, "text", SLICE_BYTES):
            digests, sizes = [], []
            for s in shingle_sets(*utf8(batch.column("text")), width):
                digests.append(set_digest(s))
                sizes.append(len(s))
                counts.add(s)
            none = pa.nulls(batch.num_rows, pa.int32())
            yield pa.record_batch([batch.column("row"), batch.column("doc_id"), pa.array(digests, pa.int64()), pa.array(sizes, pa.int32()),
                                   none, none, pa.nulls(batch.num_rows, pa.binary())], names)
        blocks = counts.total().reshape(-1, 1 << BLOCK_BITS)
        some = np.flatnonzero(blocks.any(1))
        part = TaskContext.get().partitionId()
        for b in some.tolist():
            yield pa.record_batch([*(pa.nulls(1, t) for t in (pa.int64(), pa.int64(), pa.int64(), pa.int32())),
                                   pa.array([b], pa.int32()), pa.array([part], pa.int32()), pa.array([_pack(blocks[b])], pa.binary())], names)

    return rows.mapInArrow(run, "row long, doc_id long, digest long, n int, block int, part int, counts binary")


def summed_counts(parts: DataFrame) -> np.ndarray:
    """Bucket counts of all tasks: sums of at most ``FAN`` blocks at a time, so no task holds more."""
    def add(pdf: pd.DataFrame) -> pd.DataFrame:
        total = np.zeros(1 << BLOCK_BITS, np.uint64)
        for c in pdf["counts"]:
            total += _unpack(c)
        return pd.DataFrame({"block": pdf["block"][:1], "part": pdf["part"][:1] // FAN,
                             "counts": [_pack(np.minimum(total, 0xFFFFFFFF).astype(np.uint32))]})

    schema = "block int, part int, counts binary"
    most = parts.agg(F.max("part")).first()[0] or 0
    while True:
        parts = parts.groupBy("block", (F.col("part") / FAN).cast("int").alias("g")).applyInPandas(lambda pdf: add(pdf), schema)
        most //= FAN
        if most == 0:
            break
    out = np.zeros((1 << (BUCKET_BITS - BLOCK_BITS), 1 << BLOCK_BITS), np.uint32)
    for r in parts.toLocalIterator():  # a fixed 2 ** BUCKET_BITS counts in all
        out[r["block"]] = _unpack(r["counts"])
    return out.reshape(-1)


def prefixes(rows: DataFrame, counts: np.ndarray, width: int, percent: int) -> DataFrame:
    """``token, row, n, pos``: the rare-first prefix of each set; of equal sets a task gives the first, and one again after ``MOST_SEEN`` others."""
    shared = rows.sparkSession.sparkContext.broadcast(counts)
    names = ["token", "row", "n", "pos"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weight, seen = shared.value, set()
        for batch in slices(batches, "text", SLICE_BYTES):
            ids = batch.column("row").to_numpy()
            tokens, owner, size, pos = [], [], [], []
            for r, s in zip(ids, shingle_sets(*utf8(batch.column("text")), width)):
                if not len(s) or (key := (set_digest(s), len(s))) in seen:
                    continue
                if len(seen) >= MOST_SEEN:
                    seen.clear()
                seen.add(key)
                p = len(s) - ceil(len(s) * percent / 100) + 1
                order = (np.minimum(weight[bucket(s)], 0xFFFFFF).astype(U64) << U64(40)) | (s >> U64(24))
                tokens.append(s[np.argsort(order, kind="stable")[:p]])
                owner.append(np.full(p, r))
                size.append(np.full(p, len(s), np.int32))
                pos.append(np.arange(p, dtype=np.int32))
            if tokens:
                yield pa.record_batch([pa.array(np.concatenate(x)) for x in ([t.view(np.int64) for t in tokens], owner, size, pos)], names)

    return rows.mapInArrow(run, "token long, row long, n int, pos int")


def whole_sets(rows: DataFrame, width: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", SLICE_BYTES):
            sets = [s.tobytes() for s in shingle_sets(*utf8(batch.column("text")), width)]
            yield pa.record_batch([batch.column("row"), pa.array(sets, pa.binary())], ["row", "grams"])

    return rows.mapInArrow(run, "row long, grams binary")


def suffix_bound(x: np.ndarray, y: np.ndarray, depth: int = 3) -> int:
    """At least so many elements are in only one of two sorted sets: both are split at the middle of y,
    and the parts differ at least by their sizes."""
    if depth == 0 or not len(x) or not len(y):
        return abs(len(x) - len(y))
    w = y[len(y) // 2]
    i, j = int(np.searchsorted(x, w)), len(y) // 2
    return suffix_bound(x[:i], y[:j], depth - 1) + suffix_bound(x[i:], y[j:], depth - 1)


def linked(x: np.ndarray, y: np.ndarray, percent: int) -> bool:
    both = len(x) + len(y)
    # similarity >= t: the sets differ in at most (1 - t) / (1 + t) of their summed sizes
    if suffix_bound(x, y) * (100 + percent) > (100 - percent) * both:
        return False
    common = len(np.intersect1d(x, y, assume_unique=True))
    return 100 * common >= percent * (both - common)


def verify(pairs: DataFrame, rows: DataFrame, width: int, percent: int) -> DataFrame:
    """The pairs ``a, b`` whose whole sets are similar enough; only their documents are read."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = [linked(np.frombuffer(x.as_buffer(), U64), np.frombuffer(y.as_buffer(), U64), percent)
                    for x, y in zip(batch.column("x"), batch.column("y"))]
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    needed = stage_table(pairs.select("a").union(pairs.select("b")).distinct(), "join-needed")
    sets = stage_table(whole_sets(rows.join(needed, F.col("row") == F.col("a"), "left_semi"), width), "join-sets")
    x, y = (sets.select(F.col("row").alias(f"{s}_row"), F.col("grams").alias(s)) for s in "xy")
    both = pairs.join(x, F.col("a") == F.col("x_row")).join(y, F.col("b") == F.col("y_row")).select("a", "b", "x", "y")
    with settings(pairs.sparkSession, {"spark.sql.execution.arrow.maxBytesPerBatch": str(VERIFY_BYTES)}):
        return stage_table(both.mapInArrow(run, "a long, b long"), "join-links")


def _passes(percent: int):
    """Length filter, and positional filter at a shared shingle: what is left of both sets must do."""
    both, rest = F.col("n") + F.col("h_n"), F.least(F.col("n") - F.col("pos"), F.col("h_n") - F.col("h_pos"))
    return (F.least("n", "h_n") * 100 >= F.greatest("n", "h_n") * percent) & (rest * (100 + percent) >= both * percent)


def _open(meeting: DataFrame, labels: DataFrame) -> DataFrame:
    """``token, rep, n, pos, comp, main, size, outside`` of the shingles that more than one component has; main: the largest
    one; size: the shingle's members, and those outside of it."""
    labelled = meeting.select("token", "rep", "n", "pos").join(labels, F.col("rep") == F.col("node"), "left")
    labelled = stage_table(labelled.select("token", "rep", "n", "pos", F.coalesce("label", "rep").alias("comp")), "join-labelled")
    per = labelled.groupBy("token", "comp").agg(F.count(F.lit(1)).alias("members"))
    top = per.groupBy("token").agg(F.max_by("comp", F.struct("members", "comp")).alias("main"), F.count(F.lit(1)).alias("comps"),
                                   F.sum("members").alias("size"), (F.sum("members") - F.max("members")).alias("outside")).where("comps > 1")
    return stage_table(labelled.join(stage_table(top.drop("comps"), "join-top"), "token"), "join-mixed")


def _many(opened: DataFrame) -> DataFrame:
    """The rows of shingles whose pairs across components might be many more than their members."""
    return opened.where(F.col("outside") > PAIRS_A_ROW)


def _pairs_of(opened: DataFrame) -> int:
    """The pairs across components that there might be, for each row one with every member outside."""
    return opened.agg(F.sum("outside")).first()[0] or 0


def _named(members: DataFrame) -> DataFrame:
    return members.select(F.col("token").alias("h_token"), F.col("rep").alias("h_rep"), F.col("n").alias("h_n"), F.col("pos").alias("h_pos"),
                          F.col("comp").alias("h_comp"))


def _pairs(left: DataFrame, right: DataFrame, percent: int, condition) -> DataFrame:
    found = left.join(right, (F.col("token") == F.col("h_token")) & (F.col("comp") != F.col("h_comp")) & _passes(percent) & condition)
    return found.select(F.least("rep", "h_rep").alias("a"), F.greatest("rep", "h_rep").alias("b")).distinct()


def _to_hubs(opened: DataFrame, hubs: int, percent: int) -> DataFrame:
    """The pairs of about ``hubs`` members of each shingle with the members of other components.  Members are drawn by their
    hash, so that the shingles of a group draw the same ones."""
    draw = F.pmod(F.xxhash64("rep", F.lit(hubs)), F.lit(1 << 40)) / float(1 << 40)
    chosen = _named(opened.where(draw * F.col("size") < hubs))
    return _pairs(opened, stage_table(chosen, "join-hubs"), percent, F.lit(True))


def _across(opened: DataFrame, percent: int) -> DataFrame:
    """All pairs across components, but for those of two members of the same component."""
    return _pairs(opened, _named(opened.where("comp <> main")), percent, (F.col("comp") == F.col("main")) | (F.col("rep") < F.col("h_rep")))


def _apart(pairs: DataFrame, labels: DataFrame) -> DataFrame:
    """The pairs whose members no component holds both of."""
    a, b = (labels.select(F.col("node").alias(f"{s}_node"), F.col("label").alias(f"{s}_label")) for s in "ab")
    named = pairs.join(a, F.col("a") == F.col("a_node"), "left").join(b, F.col("b") == F.col("b_node"), "left")
    return named.where(F.coalesce("a_label", "a") != F.coalesce("b_label", "b")).select("a", "b")


def _untried(pairs: DataFrame, tried: DataFrame) -> DataFrame:
    return pairs.join(tried, (F.col("a") == F.col("ta")) & (F.col("b") == F.col("tb")), "left_anti")


def link_components(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", width: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """``row, doc_id, n_shingles, component_id`` per row of ``docs``: the smallest doc_id that links reach.

    Texts are lowered in A-Z and split at ASCII white space.  A null, empty or blank text has an empty
    set and its own id.  Repeated rows and ids are members of their own.  A null id is no smallest
    id: a component of such rows alone has a null one.  An empty table gives an empty result."""
    spark: SparkSession = docs.sparkSession
    bounded_batches(spark)
    rows = _rows(docs, text, doc_id)
    first = stage_table(digests_and_counts(rows, width), "join-digests")
    members = first.where("block IS NULL").select("row", "doc_id", "digest", "n")
    counts = summed_counts(first.where("block IS NOT NULL").select("block", "part", "counts"))
    classes = stage_table(members.where("n > 0").groupBy("digest", "n").agg(F.min("row").alias("rep"), F.min("doc_id").alias("least_id"),
                                                                            F.count(F.lit(1)).alias("size")), "join-classes")
    rep_of = members.join(classes, ["digest", "n"]).select("row", "rep")
    found = prefixes(rows, counts, width, percent)  # cheaper to make twice than to keep
    shared = found.groupBy("token").count().where("count > 1").select("token")
    meeting = found.join(shared, "token").join(rep_of, "row").groupBy("token", "rep").agg(F.max("n").alias("n"), F.max("pos").alias("pos"))
    meeting = stage_table(meeting, "join-meeting")
    # A pair that is similar enough passes at its first shared shingle, so passing at any one of them is asked.
    hubs = meeting.groupBy("token").agg(F.min(F.struct("rep", "n", "pos")).alias("hub"), F.max("rep").alias("hi")).where("hub.rep < hi")
    hubs = hubs.select("token", F.col("hub.rep").alias("h_rep"), F.col("hub.n").alias("h_n"), F.col("hub.pos").alias("h_pos"))
    tried = meeting.join(hubs, "token").where((F.col("rep") != F.col("h_rep")) & _passes(percent))
    tried = stage_table(tried.select(F.col("h_rep").alias("a"), F.col("rep").alias("b")).distinct(), "join-tried")
    links = verify(tried, rows, width, percent)
    labels = components(links.select(F.col("a").alias("u"), F.col("b").alias("v")))

    meeting = meeting.join(hubs.select("token"), "token", "left_semi")
    # Only what is open between components is still of interest; its texts are read from here on.
    opened = _open(meeting, labels)
    texts = stage_table(rows.join(opened.select(F.col("rep").alias("o_rep")).distinct(), F.col("row") == F.col("o_rep"), "left_semi"), "join-open-texts")
    again = tried.select(F.col("a").alias("ta"), F.col("b").alias("tb"))  # a hub is the smaller of its pairs
    enough, left = PAIRS_A_ROW * opened.count(), [opened.where(F.col("outside") <= PAIRS_A_ROW)]
    opened = _many(opened)
    for hubs_now in HUBS:
        if _pairs_of(opened) <= enough:
            break
        # Only these shingles are looked at again: the others' rows are as many as before, their pairs in proportion to them.
        near = stage_table(_untried(_to_hubs(opened, hubs_now, percent), again), "join-near")
        links = verify(near, texts, width, percent)
        again = again.union(near)
        labels = components(labels.select(F.col("node").alias("u"), F.col("label").alias("v"))
                            .union(links.select(F.col("a").alias("u"), F.col("b").alias("v"))))
        opened = _open(opened, labels)
    across = reduce(DataFrame.union, [_across(some, percent) for some in (*left, opened)]).distinct()
    # the shingles of few pairs still have the components from before the turns
    across = stage_table(_untried(_apart(across, labels), again), "join-across")
    more = verify(across, texts, width, percent)
    labels = components(labels.select(F.col("node").alias("u"), F.col("label").alias("v"))
                        .union(more.select(F.col("a").alias("u"), F.col("b").alias("v"))))

    named = classes.join(labels, F.col("rep") == F.col("node"), "left").select("digest", "n", "least_id", F.coalesce("label", "rep").alias("comp"))
    least = named.groupBy(F.col("comp").alias("c")).agg(F.min("least_id").alias("component_id"))
    named = stage_table(named.join(least, F.col("comp") == F.col("c")).select(F.col("digest").alias("d"), F.col("n").alias("m"), "component_id"), "join-named")
    return members.join(named, (F.col("digest") == F.col("d")) & (F.col("n") == F.col("m")), "left").select(
        "row", "doc_id", F.col("n").cast("long").alias("n_shingles"),
        F.when(F.col("n") == 0, F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"))


def drop_linked(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", **options) -> DataFrame:
    """``docs`` with one row of each component: that with the smallest id (of equal ids, the first row).
    Rows with an empty set, and components without any id, all stay; all columns stay."""
    found = link_components(docs, text, doc_id, **options).where("n_shingles > 0 AND component_id IS NOT NULL")
    first = Window.partitionBy("component_id").orderBy("row")
    own = found.where("doc_id = component_id").withColumn("k", F.row_number().over(first))
    dropped = own.where("k > 1").select("row").union(found.where("doc_id IS NULL OR doc_id <> component_id").select("row"))
    rows = docs.withColumn("__row", F.monotonically_increasing_id())
    dropped = dropped.withColumnRenamed("row", "__dropped")
    return rows.join(dropped, F.col("__row") == F.col("__dropped"), "left_anti").drop("__row")
