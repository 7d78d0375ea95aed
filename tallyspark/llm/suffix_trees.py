"""Removal of repeated word sequences by prefix-partitioned suffix trees.

A word goes when a window of ``least`` consecutive words over it starts at another place too, in any
document.  Equal windows lie below one deep node of the suffix tree over all texts.  The tree is never built as a
whole: prefixes of different lengths split its suffixes into groups, each the subtree of one task.

1. A suffix's first prefix runs from its start through the gram of ``gram`` words with the smallest hash in its
   window (the leftmost of equal ones), so equal windows have equal prefixes.  Neighbouring suffixes that
   end their prefix with the same occurrence of a gram travel as one run.  A pass gives a row of numbers per run.
2. A gram met once ends in leaves: its windows are unique.  A gram whose runs are all equal is one path down to
   beyond the window: all its windows are repeated.  Both need counts only.
3. The other grams, the ends of repeated passages, are given their words, one copy of each distinct run.
   Subtrees are built from the suffixes' order and the common prefixes of neighbours; the leaves below a node of
   depth ``least`` or more are repeated.
4. A gram with more than ``group_runs`` distinct runs would outgrow a task.  There the prefixes of its
   suffixes are lengthened to the whole window: each group is then one deep node or one leaf, and is counted.

Words are compared as bytes in step 3 (words over 64 bytes by their SHA-256); steps 2 and 4 compare two 64-bit
hashes.  No group, list or table is held by one task beyond ``group_runs`` runs, and nothing is collected.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import stage_table
from .common import GOLDEN, U64, bounded_batches, mix64, partitions, slices, utf8
from .ngram_join import IS_SPACE, _power_tables

LEAST, GRAM, GROUP_RUNS, HOT_RUNS = 35, 8, 20_000, 1000
SLICE_BYTES, CHUNK_BYTES = 2 << 20, 8 << 20
LONG_WORD = 64


def word_places(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Begin and end of all words of a slice and, per row, the number of its first word, with the total last."""
    letters = ~IS_SPACE[data]
    before, after = np.zeros_like(letters), np.zeros_like(letters)
    before[1:], after[:-1] = letters[:-1], letters[1:]
    full = starts < ends
    before[starts[full]] = False
    after[ends[full] - 1] = False
    begin, end = np.flatnonzero(letters & ~before), np.flatnonzero(letters & ~after) + 1
    return begin, end, np.append(np.searchsorted(begin, starts), len(begin))


def word_names(data: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hashes of words."""
    up, down = _power_tables(len(data) + 1)
    sums = np.zeros(len(data) + 1, U64)
    np.cumsum((data.astype(U64) + U64(1)) * up[: len(data)], out=sums[1:])
    return mix64((sums[end] - sums[begin]) * down[begin] + (end - begin).astype(U64) * GOLDEN)


class Sums:
    """Hashes of any stretches of words, by sums of their names times powers."""

    def __init__(self, names: np.ndarray):
        self.up, self.down = _power_tables(len(names) + 1)
        self.sums = np.zeros(len(names) + 1, U64)
        np.cumsum(names * self.up[: len(names)], out=self.sums[1:])

    def of(self, begin: np.ndarray, end: np.ndarray, salt: np.ndarray | int = 0) -> np.ndarray:
        return mix64((self.sums[end] - self.sums[begin]) * self.down[begin] + np.asarray(salt).astype(U64) * GOLDEN)


def runs_of(names: np.ndarray, first: np.ndarray, least: int, gram: int) -> tuple[np.ndarray, ...]:
    """(row, first window, last window, place of the gram, gram hash, run hash) of a slice, in words of the slice."""
    none = tuple(np.zeros(0, t) for t in (np.int64,) * 4 + (U64, U64))
    n = len(names)
    if n < least:
        return none
    sums = Sums(names)
    grams = sums.of(np.arange(n - gram + 1), np.arange(gram, n + 1))
    bits = U64(n.bit_length())  # hash above, place below: the minimum also tells where it is, the leftmost of equal ones
    low = (grams >> bits << bits) | np.arange(len(grams), dtype=U64)
    width, span = least - gram + 1, 1
    while span * 2 <= width:
        low = np.minimum(low[:-span], low[span:])
        span *= 2
    if span < width:
        low = np.minimum(low[: len(low) - (width - span)], low[width - span:])
    inside = np.zeros(n + 1, np.int32)
    full = np.diff(first) >= least
    np.add.at(inside, first[:-1][full], 1)
    np.add.at(inside, first[1:][full] - least + 1, -1)
    windows = np.flatnonzero(np.cumsum(inside)[: len(low)])
    if not len(windows):
        return none
    place = (low[windows] & ((U64(1) << bits) - U64(1))).astype(np.int64)
    fresh = np.ones(len(windows), bool)
    fresh[1:] = (place[1:] != place[:-1]) | (windows[1:] != windows[:-1] + 1)
    head = np.flatnonzero(fresh)
    begin, last, place = windows[head], windows[np.append(head[1:], len(windows)) - 1], place[head]
    shape = (place - begin) * 64 + (place - last) + 1
    return (np.searchsorted(first, begin, "right") - 1, begin, last, place, grams[place], sums.of(begin, last + least, shape))


def _rows(docs: DataFrame, text: str, doc_id: str) -> DataFrame:
    """Row numbers are those of the scan: ``docs`` has to be a stored table."""
    return docs.select(F.monotonically_increasing_id().alias("row"), F.col(f"`{doc_id}`").cast("long").alias("doc_id"),
                       F.col(f"`{text}`").cast("string").alias("text"))


def runs(rows: DataFrame, least: int, gram: int) -> DataFrame:
    """``gram, run`` (hashes), ``row, start, stop``: first word of the run's first window and end of its last."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", SLICE_BYTES):
            data, starts, ends = utf8(batch.column("text"))
            begin, end, first = word_places(data, starts, ends)
            row, s, last, _, g, whole = runs_of(word_names(data, begin, end), first, least, gram)
            yield pa.record_batch([pa.array(g.view(np.int64)), pa.array(whole.view(np.int64)), pa.array(batch.column("row").to_numpy()[row]),
                                   pa.array((s - first[row]).astype(np.int32)), pa.array((last + least - first[row]).astype(np.int32))],
                                  ["gram", "run", "row", "start", "stop"])

    return rows.select("row", "text").mapInArrow(run, "gram long, run long, row long, start int, stop int")


def run_words(rows: DataFrame, wanted: DataFrame, least: int) -> DataFrame:
    """The words of ``wanted`` runs (``gram, row, start, stop, large``): per run its words between single spaces; of
    runs of a large group a row for each window, with two hashes of it."""
    names = ["gram", "row", "start", "words", "key", "key2"]
    asked = wanted.groupBy(F.col("row").alias("w_row")).agg(F.collect_list(F.struct("gram", "start", "stop", "large")).alias("at"))  # of one text

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", SLICE_BYTES):
            data, starts, ends = utf8(batch.column("text"))
            begin, end, first = word_places(data, starts, ends)
            at = batch.column("at")
            counts = np.diff(at.offsets.to_numpy())
            fields = at.flatten()
            gram, start, stop, large = (fields.field(c).to_numpy(zero_copy_only=False) for c in ("gram", "start", "stop", "large"))
            number = np.repeat(np.arange(batch.num_rows), counts)
            row = batch.column("row").to_numpy()
            words, size, small = [], 0, np.flatnonzero(~large)
            done = 0
            for k, i in enumerate(small.tolist()):
                a, b = first[number[i]] + start[i], first[number[i]] + stop[i]
                words.append(_plain(data, begin[a:b], end[a:b]))
                size += len(words[-1])
                if size > CHUNK_BYTES or k == len(small) - 1:
                    part = small[done: k + 1]
                    none = pa.nulls(len(part), pa.int64())
                    yield pa.record_batch([pa.array(gram[part]), pa.array(row[number[part]]), pa.array(start[part], pa.int32()),
                                           pa.array(words, pa.binary()), none, none], names)
                    words, size, done = [], 0, k + 1
            if large.any():
                i = np.flatnonzero(large)
                many = stop[i] - start[i] - least + 1
                lane = np.repeat(i, many)
                own = start[lane] + np.arange(len(lane)) - np.repeat(np.cumsum(many) - many, many)
                name = word_names(data, begin, end)
                a = first[number[lane]] + own
                key, key2 = Sums(name).of(a, a + least), Sums(mix64(name + GOLDEN)).of(a, a + least)
                yield pa.record_batch([pa.array(gram[lane]), pa.array(row[number[lane]]), pa.array(own.astype(np.int32)),
                                       pa.nulls(len(lane), pa.binary()), pa.array(key.view(np.int64)), pa.array(key2.view(np.int64))], names)

    joined = rows.join(asked, F.col("row") == F.col("w_row")).select("row", "text", "at")
    return joined.mapInArrow(run, "gram long, row long, start int, words binary, key long, key2 long")


def _plain(data: np.ndarray, begin: np.ndarray, end: np.ndarray) -> bytes:
    """Words between single spaces; a long one as a mark and its digest, longer than any plain word."""
    raw = data[begin[0]: end[-1]].tobytes()
    if (end - begin).max() > LONG_WORD:
        base = begin[0]
        parts = [raw[a - base: b - base] for a, b in zip(begin.tolist(), end.tolist())]
        return b" ".join(b"#" + hashlib.sha256(p).hexdigest().encode() if len(p) > LONG_WORD else p for p in parts)
    return b" ".join(raw.split())


class SubTree:
    """Suffix tree over strings of words, as the order of all suffixes and the common prefixes of neighbours in it.

    ``codes``: the strings one after the other, each ended by a code of its own.  Suffixes are ordered, and prefixes
    known, up to ``2 * span`` words, span being the largest power of two below ``depth``."""

    def __init__(self, codes: np.ndarray, depth: int):
        self.depth, self.ranks = depth, {}
        rank, span, n = np.unique(codes, return_inverse=True)[1].astype(np.int64), 1, len(codes)
        while True:
            self.ranks[span] = rank
            later = np.zeros(n, np.int64)
            later[: max(0, n - span)] = rank[span:] + 1
            rank = np.unique(rank * (n + 1) + later, return_inverse=True)[1].astype(np.int64)
            if span * 2 > depth:
                break
            span *= 2
        self.order = np.argsort(rank, kind="stable")
        a, b = self.order[:-1].copy(), self.order[1:].copy()
        self.common = np.zeros(max(0, n - 1), np.int64)
        for span in sorted(self.ranks, reverse=True):
            for _ in range(2 if span == max(self.ranks) else 1):
                same = (a < n) & (b < n)
                same[same] = self.ranks[span][a[same]] == self.ranks[span][b[same]]
                self.common[same] += span
                a[same] += span
                b[same] += span

    def leaves_below_deep_nodes(self) -> np.ndarray:
        """Suffixes (by place) that share ``depth`` words or more with another."""
        deep = self.common >= self.depth
        below = np.zeros(len(self.order), bool)
        below[self.order[:-1][deep]] = True
        below[self.order[1:][deep]] = True
        return below


def grow_subtrees(found: DataFrame, least: int) -> DataFrame:
    """``row, start, stop`` (words) of the windows that runs share with other runs, or have twice.

    found: ``gram, row, start, words``; all runs of a gram in one partition and next to each other."""

    def solve(t: pa.Table) -> Iterator[pa.RecordBatch]:
        data, starts, ends = utf8(t.column("words").combine_chunks())
        begin, end, first = word_places(data, starts, ends)
        # words as a dictionary of their bytes: an exact name for each
        offsets = np.zeros(len(begin) + 1, np.int64)
        np.cumsum(end - begin, out=offsets[1:])
        words = pa.Array.from_buffers(pa.large_binary(), len(begin), [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(data[~IS_SPACE[data]].tobytes())])
        code = words.dictionary_encode().indices.to_numpy().astype(np.int64)
        many = np.diff(first)
        at = np.arange(len(code)) + np.repeat(np.arange(len(many)), many)
        codes = np.empty(len(code) + len(many), np.int64)
        codes[at] = code
        codes[np.cumsum(many) + np.arange(len(many))] = len(code) + np.arange(len(many))
        below = np.flatnonzero(SubTree(codes, least).leaves_below_deep_nodes())
        if not len(below):
            return
        head = np.cumsum(many + 1) - many - 1
        which = np.searchsorted(head, below, "right") - 1
        place = t.column("start").to_numpy()[which] + below - head[which]
        new = np.ones(len(below), bool)  # windows next to each other make a span
        new[1:] = (which[1:] != which[:-1]) | (below[1:] != below[:-1] + 1)
        h = np.flatnonzero(new)
        tail = np.append(h[1:], len(below)) - 1
        yield pa.record_batch([pa.array(t.column("row").to_numpy()[which[h]]), pa.array(place[h].astype(np.int32)),
                               pa.array((place[tail] + least).astype(np.int32))], ["row", "start", "stop"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            for batch in slices(iter([batch]), "words", CHUNK_BYTES):
                held.append(batch)
                size += len(utf8(batch.column("words"))[0])
                if size <= CHUNK_BYTES:
                    continue
                t = pa.Table.from_batches(held).combine_chunks()
                gram = t.column("gram").to_numpy()
                edges = np.flatnonzero(gram[1:] != gram[:-1]) + 1
                if len(edges):  # a gram is never cut
                    yield from solve(t.slice(0, int(edges[-1])))
                    t = t.slice(int(edges[-1]))
                held, size = t.to_batches(), len(utf8(t.column("words").combine_chunks())[0])
        if held:
            yield from solve(pa.Table.from_batches(held).combine_chunks())

    return found.mapInArrow(run, "row long, start int, stop int")


def repeated_spans(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", least: int = LEAST, gram: int = GRAM,
                   group_runs: int = GROUP_RUNS) -> DataFrame:
    """``row, start, stop`` (words) of the stretches of ``docs`` covered by repeated windows; they may overlap."""
    bounded_batches(docs.sparkSession)
    rows = _rows(docs, text, doc_id)
    all_runs = stage_table(runs(rows, least, gram), "tree-runs")
    # Counts are written as tables, so that both sides of the joins are plain shuffles: a hot gram's rows are then split over tasks.
    grams = all_runs.groupBy("gram").agg(F.count(F.lit(1)).alias("n"), (F.min("run") < F.max("run")).alias("several"))
    grams = stage_table(grams.where("n > 1").select("gram", "several"), "tree-grams")
    met = stage_table(all_runs.join(grams, "gram"), "tree-met")
    split = met.where("several")
    distinct = stage_table(split.groupBy("gram", "run").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("row", "start", "stop")).alias("first")),
                           "tree-distinct")
    large = distinct.groupBy("gram").count().where(F.col("count") > group_runs).select("gram", F.lit(True).alias("large"))
    wanted = distinct.join(stage_table(large, "tree-large"), "gram", "left").select("gram", "first.*", F.coalesce("large", F.lit(False)).alias("large"))
    words = stage_table(run_words(rows, wanted, least), "tree-words")
    small = words.where("words IS NOT NULL").select("gram", "row", "start", "words")
    ends = grow_subtrees(small.repartition(partitions(docs.sparkSession), "gram").sortWithinPartitions("gram"), least)
    whole = words.where("words IS NULL").select("key", "key2", "row", "start")
    deep = stage_table(whole.groupBy("key", "key2").count().where("count > 1").select("key", "key2"), "tree-deep")
    # The few runs with a large share of all rows (at most HOT_RUNS of them) are met by broadcast, so that their rows stay where they are.
    key, copied = ["gram", "run"], distinct.where("n > 1")
    often = F.col("n") * HOT_RUNS > split.count()
    hot = F.broadcast(stage_table(copied.where(often).select(key), "tree-hot"))
    cold = split.join(hot, key, "left_anti").join(copied.where(~often).select(key), key)
    return (met.where("NOT several").select("row", "start", "stop")
            .unionByName(split.join(hot, key, "left_semi").select("row", "start", "stop"))
            .unionByName(cold.select("row", "start", "stop"))
            .unionByName(ends)
            .unionByName(whole.join(deep, ["key", "key2"]).select("row", "start", (F.col("start") + least).alias("stop"))))


def remove_repeats(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", least: int = LEAST, gram: int = GRAM,
                   group_runs: int = GROUP_RUNS) -> DataFrame:
    """``doc_id, n_words, n_removed, kept_sha256, kept`` per row of ``docs``; kept words are joined by one space.

    Words are what stands between ASCII white space.  Windows are judged on the input, and may repeat within a
    document.  Repeated rows and ties of ids count as documents.  Null and empty texts have no words; an empty
    table gives an empty result.  Other columns are not read."""
    rows = _rows(docs, text, doc_id)
    spans = repeated_spans(docs, text, doc_id, least, gram, group_runs)
    spans = spans.groupBy(F.col("row").alias("s_row")).agg(F.collect_list(F.struct("start", "stop")).alias("spans"))  # of one text
    names = ["doc_id", "n_words", "n_removed", "kept_sha256", "kept"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", SLICE_BYTES):
            data, starts, ends = utf8(batch.column("text"))
            begin, end, first = word_places(data, starts, ends)
            listed = batch.column("spans").fill_null([])
            number = np.repeat(first[:-1], np.diff(listed.offsets.to_numpy()))
            fields = listed.flatten()
            cover = np.zeros(len(begin) + 1, np.int64)
            np.add.at(cover, number + fields.field("start").to_numpy(), 1)
            np.add.at(cover, number + fields.field("stop").to_numpy(), -1)
            gone = np.cumsum(cover[:-1]) > 0
            # a kept word's bytes and the separator behind it stay
            mark = np.zeros(len(data) + 1, np.int8)
            mark[begin[~gone]] += 1
            row_end = np.repeat(ends, np.diff(first))
            np.subtract.at(mark, np.minimum(end + 1, row_end)[~gone], 1)
            stays = np.cumsum(mark[:-1]) > 0
            plain = np.where(IS_SPACE[data], np.uint8(32), data)
            kept = [plain[a:b][stays[a:b]].tobytes().rstrip(b" ") for a, b in zip(starts.tolist(), ends.tolist())]
            sums = np.append(0, np.cumsum(gone))
            yield pa.record_batch([batch.column("doc_id"), pa.array(np.diff(first)), pa.array(sums[first[1:]] - sums[first[:-1]]),
                                   pa.array([hashlib.sha256(k).hexdigest() for k in kept], pa.string()), pa.array(kept, pa.binary())], names)

    joined = rows.join(spans, F.col("row") == F.col("s_row"), "left").select("doc_id", "text", "spans")
    return joined.mapInArrow(run, "doc_id long, n_words long, n_removed long, kept_sha256 string, kept binary")
