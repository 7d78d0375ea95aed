"""Removal of repeated byte strings by external induced sorting of suffixes.

A byte goes when it lies in a string of ``least`` bytes (a window) that also starts in a document with
a smaller id.  Suffixes need to be ordered only where two documents can share a window, and only as
far as a window reaches.

1. Sample.  The sampled suffix of a window is its minimizer: the leftmost of the grams in it with the
   smallest hash.  Equal windows have it at the same place.  The windows of one sampled place lie next
   to each other and form a context.  Within a slice of texts, equal contexts of larger ids are known
   copies at once; one row of each context goes on, so a passage in a third of all documents gives a
   row per slice.
2. Rows meet by gram, in sorted order, in one pass that holds a row or two: equal contexts of larger
   ids are copies as a whole.  Only grams with different contexts in different documents remain, the
   ends of copied passages.
3. Those contexts are sorted with their suffixes by induction: the order of the suffixes at one byte
   follows from the order at the next byte by a stable distribution into 256 queues, from the last
   byte of the windows back to the first, and the common prefix of neighbours is carried along in the
   tuples (one more than the least one passed since the queue's last tuple).  Queues, orders and
   prefixes lie in memory, or in mapped files of the task's own scratch folder where a shard is larger
   than ``memory_rows``; blocks are read and written in sequence, and the folder goes with the task.
   Neighbours with a common prefix of a whole window or more share that window.

The recursion of induced sorting stays shallow because a gram already names its sample: equal names
share a shard.  Every comparison in step 3 is of bytes; steps 1 and 2 compare 64-bit hashes of the gram and
of the context together.
"""

from __future__ import annotations

import hashlib
import tempfile
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import stage_table
from .common import GOLDEN, U64, bounded_batches, mix64, slices, utf8
from .ngram_join import _power_tables

LEAST, GRAM = 50, 16
SLICE_BYTES, SHAPE_BITS = 2 << 20, 12
NO_ID = (1 << 63) - 1
BLOCK, MEMORY_ROWS = 1 << 18, 1 << 21


def contexts(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, least: int = LEAST, gram: int = GRAM) -> tuple[np.ndarray, ...]:
    """(row, first window, last window, sampled place, gram hash, context hash) of all contexts of a slice."""
    n = len(data)
    if n < least:
        return tuple(np.zeros(0, t) for t in (np.int64,) * 4 + (U64, U64))
    up, down = _power_tables(n + 1)
    sums = np.zeros(n + 1, U64)
    np.cumsum((data.astype(U64) + U64(1)) * up[:n], out=sums[1:])
    names = mix64((sums[gram:] - sums[:-gram]) * down[: n - gram + 1])
    # hash above, place below: the minimum also tells where it is, the leftmost of equal ones
    bits = U64(max(1, n).bit_length())
    low = (names >> bits << bits) | np.arange(len(names), dtype=U64)
    width, span = least - gram + 1, 1
    while span * 2 <= width:
        low = np.minimum(low[:-span], low[span:])
        span *= 2
    if span < width:
        low = np.minimum(low[: len(low) - (width - span)], low[width - span:])
    inside = np.zeros(n + 1, np.int32)
    full = ends - starts >= least
    np.add.at(inside, starts[full], 1)
    np.add.at(inside, ends[full] - least + 1, -1)
    windows = np.flatnonzero(np.cumsum(inside)[: len(low)])
    if not len(windows):
        return tuple(np.zeros(0, t) for t in (np.int64,) * 4 + (U64, U64))
    place = (low[windows] & ((U64(1) << bits) - U64(1))).astype(np.int64)
    fresh = np.ones(len(windows), bool)
    fresh[1:] = (place[1:] != place[:-1]) | (windows[1:] != windows[:-1] + 1)
    head = np.flatnonzero(fresh)
    first, last, place = windows[head], windows[np.append(head[1:], len(windows)) - 1], place[head]
    row = np.searchsorted(starts, first, "right") - 1
    whole = (sums[last + least] - sums[first]) * down[first]
    shape = ((place - first) * 64 + (last - first)).astype(U64) + U64(1)
    return row, first, last, place, names[place], mix64(whole + shape * GOLDEN)


def _first_of(gram: np.ndarray, ctx: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For rows sorted by (gram, ctx, doc): heads of equal (gram, ctx), and whether a row has its head's doc."""
    head = np.ones(len(gram), bool)
    head[1:] = (gram[1:] != gram[:-1]) | (ctx[1:] != ctx[:-1])
    group = np.cumsum(head) - 1
    return head, doc == doc[head][group]


def _rows(docs: DataFrame, text: str, doc_id: str) -> DataFrame:
    """Row numbers are those of the scan: ``docs`` has to be a stored table."""
    return docs.select(F.monotonically_increasing_id().alias("row"), F.col(f"`{doc_id}`").cast("long").alias("doc_id"),
                       F.col(f"`{text}`").cast("string").alias("text"))


def _slice_contexts(batch: pa.RecordBatch, least: int) -> tuple:
    data, starts, ends = utf8(batch.column("text"))
    row, first, last, place, gram, ctx = contexts(data, starts, ends, least)
    doc = batch.column("doc_id").fill_null(NO_ID).to_numpy()[row]
    order = np.lexsort((doc, ctx, gram))
    _, mine = _first_of(gram[order], ctx[order], doc[order])
    own = batch.column("row").to_numpy()[row]
    return own, doc, first - starts[row], last - starts[row], place - starts[row], gram.view(np.int64), ctx.view(np.int64), order, mine


def samples(rows: DataFrame, least: int) -> DataFrame:
    """Contexts of the smallest id of a slice: ``gram, ctx, doc, row, at`` (at: the place, and in its low
    bits the shape, that is how far the first and the last window start before the place)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", SLICE_BYTES):
            own, doc, first, last, place, gram, ctx, order, mine = _slice_contexts(batch, least)
            k = order[mine]
            at = (place << SHAPE_BITS) + (place - first) * 64 + place - last
            yield pa.record_batch([pa.array(x) for x in (gram[k], ctx[k], doc[k], own[k], at[k])], ["gram", "ctx", "doc", "row", "at"])

    return rows.mapInArrow(run, "gram long, ctx long, doc long, row long, at long")


def copies_in_slices(rows: DataFrame, least: int) -> DataFrame:
    """``row, start, end`` of the contexts that a slice has in a document of smaller id, joined where they touch."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", SLICE_BYTES):
            own, _, first, last, _, _, _, order, mine = _slice_contexts(batch, least)
            k = np.sort(order[~mine])  # contexts come by row and place
            if not len(k):
                continue
            r, s, e = own[k], first[k], last[k] + least
            new = np.ones(len(k), bool)
            new[1:] = (r[1:] != r[:-1]) | (s[1:] > e[:-1])
            head = np.flatnonzero(new)
            tail = np.append(head[1:], len(k)) - 1
            yield pa.record_batch([pa.array(r[head]), pa.array(s[head].astype(np.int32)), pa.array(e[tail].astype(np.int32))],
                                  ["row", "start", "end"])

    return rows.mapInArrow(run, "row long, start int, end int")


def meet(sampled: DataFrame, least: int) -> DataFrame:
    """Rows sorted by gram, context and id: whole copies (``start``, ``end`` set) and the contexts of grams that
    different documents have in different contexts (``start`` null)."""
    names = ["gram", "ctx", "doc", "row", "at"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [np.zeros(0, np.int64) for _ in names]
        done = np.zeros(0, bool)
        for batch in batches:
            cols = [np.concatenate([h, c.to_numpy()]) for h, c in zip(held, batch.columns)]
            done = np.concatenate([done, np.zeros(batch.num_rows, bool)])
            gram, ctx, doc, row, both = cols
            place, shape = both >> SHAPE_BITS, both & ((1 << SHAPE_BITS) - 1)
            _, mine = _first_of(gram, ctx, doc)
            edge = np.append(True, gram[1:] != gram[:-1])
            at = np.flatnonzero(edge)
            group = np.cumsum(edge) - 1
            several = np.minimum.reduceat(np.where(mine, doc, NO_ID), at) < np.maximum.reduceat(np.where(mine, doc, -NO_ID), at)
            copy = ~mine & ~done
            left = mine & ~done & several[group]
            if copy.any():
                p, s, n = place[copy], shape[copy], int(copy.sum())  # of a copy, only what it covers is needed later
                yield pa.record_batch([pa.nulls(n, pa.int64()), pa.nulls(n, pa.int64()), pa.array(row[copy]), pa.nulls(n, pa.int32()), pa.nulls(n, pa.int32()),
                                       pa.array((p - s // 64).astype(np.int32)), pa.array((p - s % 64 + least).astype(np.int32))],
                                      ["gram", "doc", "row", "place", "shape", "start", "end"])
            if left.any():
                none = pa.nulls(int(left.sum()), pa.int32())
                yield pa.record_batch([*(pa.array(x[left]) for x in (gram, doc, row)), pa.array(place[left].astype(np.int32)),
                                       pa.array(shape[left].astype(np.int32)), none, none],
                                      ["gram", "doc", "row", "place", "shape", "start", "end"])
            # what the next batch needs of the last gram: its open rows, or two rows of different ids and the last context's first
            tail = np.flatnonzero(mine & (group == group[-1]))
            done = done | left
            if several[-1]:
                other = tail[doc[tail] != doc[tail[0]]]
                last = tail[ctx[tail] == ctx[-1]]
                tail = np.unique(np.concatenate([tail[:1], other[:1], last[:1]]))
                done = np.ones_like(done)
            held, done = [c[tail] for c in cols], done[tail]

    return sampled.mapInArrow(run, "gram long, doc long, row long, place int, shape int, start int, end int")


class InducedOrder:
    """Order and common prefixes of the suffixes of equally long strings, byte by byte from the end.

    ``columns``: an array of one byte per string for each place.  With a folder, arrays are mapped files."""

    def __init__(self, size: int, folder: str | None = None, block: int = BLOCK):
        self.size, self.block, self.folder, self.made = size, block, folder, 0
        self.order, self.prefix = self.array(np.int64), self.array(np.uint8)
        self.spare = self.array(np.int64), self.array(np.uint8)
        self.order[:] = np.arange(size)
        self.prefix[:] = 0

    def array(self, kind) -> np.ndarray:
        if self.folder is None:
            return np.empty(self.size, kind)
        self.made += 1
        return np.memmap(Path(self.folder, f"queue-{self.made}"), kind, "w+", shape=(self.size,))

    def step(self, column: np.ndarray) -> None:
        """Distributes the suffixes in their order to the queues of the byte before them."""
        counts = np.zeros(256, np.int64)
        for a in range(0, self.size, self.block):
            counts += np.bincount(column[a: a + self.block], minlength=256)
        end_of = np.concatenate([[0], np.cumsum(counts)[:-1]])  # next free place of each queue
        passed = np.full(256, 255, np.uint8)  # least prefix passed since the queue's last tuple
        begun = np.zeros(256, bool)
        order, prefix = self.spare
        for a in range(0, self.size, self.block):
            ids, common = np.asarray(self.order[a: a + self.block]), np.asarray(self.prefix[a: a + self.block])
            byte = column[ids]
            by = np.argsort(byte, kind="stable")
            sorted_byte = byte[by]
            head = np.flatnonzero(np.append(True, sorted_byte[1:] != sorted_byte[:-1]))
            present, tail = sorted_byte[head], np.append(head[1:], len(by)) - 1
            least = np.empty(len(by), np.uint8)
            inner = np.ones(len(by), bool)
            inner[head] = False
            least[inner] = _range_least(common, by[:-1][inner[1:]] + 1, by[1:][inner[1:]])
            before = np.minimum.accumulate(common)
            least[head] = np.minimum(passed[present], before[by[head]])
            value = least + 1
            value[head[~begun[present]]] = 0
            place = end_of[sorted_byte] + np.arange(len(by)) - np.repeat(head, tail - head + 1)
            order[place], prefix[place] = ids[by], value
            end_of[present] += tail - head + 1
            passed = np.minimum(passed, before[-1])
            after = np.append(np.minimum.accumulate(common[::-1])[::-1], 255).astype(np.uint8)
            passed[present] = after[by[tail] + 1]
            begun[present] = True
        self.spare = self.order, self.prefix
        self.order, self.prefix = order, prefix


def _range_least(values: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """Least value of each range lo..hi (inclusive, not empty), by a table of powers of two."""
    if not len(lo):
        return np.zeros(0, np.uint8)
    size = hi - lo + 1
    power = np.frexp(size.astype(float))[1] - 1
    out, table = np.empty(len(lo), np.uint8), values
    for p in range(int(power.max()) + 1):
        if p:
            table = np.minimum(table[: -(1 << p - 1)], table[1 << p - 1:])
        k = np.flatnonzero(power == p)
        out[k] = np.minimum(table[lo[k]], table[hi[k] - (1 << p) + 1])
    return out


def shared_windows(columns: list[np.ndarray], reach: int, doc: np.ndarray, far: np.ndarray, near: np.ndarray, least: int,
                   folder: str | None = None) -> np.ndarray:
    """For each context the set of windows (bit o: the one that starts o bytes before the sampled place) that a
    document of smaller id has too.  Column ``reach + j`` holds the byte at place + j; a context's own
    windows start ``far`` to ``near`` bytes before the place."""
    sorter = InducedOrder(len(doc), folder)
    hits = np.zeros(len(doc), U64)
    for j in range(least - 1, -reach - 1, -1):
        sorter.step(columns[reach + j])
        if j > 0:
            continue
        at = 0
        while at < sorter.size:  # blocks end where a run of equal windows ends
            to = min(sorter.size, at + sorter.block)
            while to < sorter.size and sorter.prefix[to] >= least:
                to += 1
            ids, head = np.asarray(sorter.order[at:to]), np.asarray(sorter.prefix[at:to]) < least
            head[0] = True
            at = to
            lone = head & np.append(head[1:], True)
            if lone.all():
                continue
            group = np.cumsum(head) - 1
            own = (far[ids] >= -j) & (near[ids] <= -j)
            first = np.minimum.reduceat(np.where(own, doc[ids], NO_ID), np.flatnonzero(head))
            hits[ids[own & (doc[ids] > first[group])]] |= U64(1) << U64(-j)
    return hits


def sort_shards(found: DataFrame, least: int, gram: int, memory_rows: int) -> DataFrame:
    """``row, start, end`` of the windows that contexts share with documents of smaller ids.

    found: ``gram, doc, row, place, shape, bytes``, all contexts of a gram in one partition and next to each other."""
    reach = least - gram
    width = reach + least

    def solve(parts: list[pa.RecordBatch], folder: str | None) -> Iterator[pa.RecordBatch]:
        t = pa.Table.from_batches(parts).combine_chunks()
        n = t.num_rows
        doc, row, place, shape = (t.column(c).to_numpy() for c in ("doc", "row", "place", "shape"))
        body, _, _ = utf8(t.column("bytes").chunk(0))
        if folder is None:
            columns = list(np.ascontiguousarray(body.reshape(n, width).T))
        else:
            columns = [np.memmap(Path(folder, f"bytes-{i}"), np.uint8, "w+", shape=(n,)) for i in range(width)]
            for i, c in enumerate(columns):
                c[:] = body[i::width]
        hits = shared_windows(columns, reach, doc, shape // 64, shape % 64, least, folder)
        some = np.flatnonzero(hits)
        if not len(some):
            return
        bits = (hits[some, None] >> np.arange(reach + 2, dtype=U64)) & U64(1) > 0
        bits[:, -1] = False
        # along a row from the farthest window to the nearest: where a run of set bits begins and ends
        k, begin = np.nonzero(bits & ~np.pad(bits, ((0, 0), (1, 0)))[:, :-1])
        k2, stop = np.nonzero(bits & ~np.pad(bits, ((0, 0), (0, 1)))[:, 1:])
        p = place[some[k]]
        yield pa.record_batch([pa.array(row[some[k]]), pa.array((p - stop).astype(np.int32)), pa.array((p - begin + least).astype(np.int32))],
                              ["row", "start", "end"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, size = [], 0
        for batch in batches:
            grams = batch.column("gram").to_numpy()
            edges = np.flatnonzero(grams[1:] != grams[:-1]) + 1
            if parts and parts[-1].column("gram")[-1].as_py() != grams[0]:
                edges = np.append(0, edges)
            if size + batch.num_rows > BLOCK and len(edges):  # a gram is never cut
                parts.append(batch.slice(0, int(edges[-1])))
                size += int(edges[-1])
                yield from solved([p for p in parts if p.num_rows])
                parts, size = [], 0
                batch = batch.slice(int(edges[-1]))
            parts.append(batch)
            size += batch.num_rows
        if size:
            yield from solved([p for p in parts if p.num_rows])

    def solved(parts: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if sum(p.num_rows for p in parts) <= memory_rows:
            yield from solve(parts, None)
        else:
            with tempfile.TemporaryDirectory(prefix="queues-") as folder:  # like a sort's own spill: gone with the task
                yield from solve(parts, folder)

    return found.mapInArrow(run, "row long, start int, end int")


def context_bytes(rows: DataFrame, left: DataFrame, least: int, gram: int) -> DataFrame:
    """The bytes around each sampled place, zero outside the text."""
    reach = least - gram
    names = ["gram", "doc", "row", "place", "shape", "bytes"]
    wanted = left.groupBy(F.col("row").alias("l_row")).agg(F.collect_list(F.struct("place", "shape", "gram", "doc")).alias("at"))  # of one text

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            data, starts, ends = utf8(batch.column("text"))
            at = batch.column("at")
            counts = np.diff(at.offsets.to_numpy())
            fields = at.flatten()
            place, shape, name, doc = (fields.field(c).to_numpy() for c in ("place", "shape", "gram", "doc"))
            row = np.repeat(np.arange(batch.num_rows), counts)
            for a in range(0, len(row), 100_000):
                r, p = row[a: a + 100_000], place[a: a + 100_000].astype(np.int64)
                index = (starts[r] + p)[:, None] + np.arange(-reach, least)
                ok = (index >= starts[r][:, None]) & (index < ends[r][:, None])
                around = np.where(ok, data[np.where(ok, index, 0)], 0).astype(np.uint8)
                width = reach + least
                bodies = pa.Array.from_buffers(pa.binary(), len(r), [None, pa.py_buffer((np.arange(len(r) + 1) * width).astype(np.int32)),
                                                                    pa.py_buffer(around.tobytes())])
                yield pa.record_batch([pa.array(name[a: a + 100_000]), pa.array(doc[a: a + 100_000]), pa.array(batch.column("row").to_numpy()[r]),
                                       pa.array(place[a: a + 100_000]), pa.array(shape[a: a + 100_000]), bodies], names)

    joined = rows.join(wanted, F.col("row") == F.col("l_row")).select("row", "text", "at")
    return joined.mapInArrow(run, "gram long, doc long, row long, place int, shape int, bytes binary")


def repeated_spans(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", least: int = LEAST, gram: int = GRAM,
                   memory_rows: int = MEMORY_ROWS) -> DataFrame:
    """``row, start, end`` (bytes) of strings that documents of smaller ids have too; spans may overlap."""
    bounded_batches(docs.sparkSession)
    rows = _rows(docs, text, doc_id)
    met = meet(samples(rows, least).repartition("gram").sortWithinPartitions("gram", "ctx", "doc"), least)
    met = stage_table(met, "suffix-met")
    left = context_bytes(rows, met.where("start IS NULL"), least, gram)
    ends = sort_shards(left.repartition("gram").sortWithinPartitions("gram"), least, gram, memory_rows)
    return (met.where("start IS NOT NULL").select("row", "start", "end")
            .unionByName(copies_in_slices(rows, least)).unionByName(ends))


def remove_repeats(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", least: int = LEAST, gram: int = GRAM,
                   memory_rows: int = MEMORY_ROWS) -> DataFrame:
    """``doc_id, n_bytes, n_removed, n_spans, kept_sha256, kept (binary)`` per row of ``docs``.

    Strings are judged on the input.  Rows with the same id do not remove from each other; a null id is
    larger than all others.  Null and empty texts have no bytes; an empty table gives an empty result."""
    rows = _rows(docs, text, doc_id)
    spans = repeated_spans(docs, text, doc_id, least, gram, memory_rows)
    spans = spans.groupBy(F.col("row").alias("s_row")).agg(F.collect_list(F.struct("start", "end")).alias("spans"))  # of one text
    names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            data, starts, ends = utf8(batch.column("text"))
            removed, runs, kept = [], [], []
            for i, listed in enumerate(batch.column("spans")):
                body = data[starts[i]: ends[i]]
                if not listed.is_valid or not len(listed.values):
                    removed.append(0)
                    runs.append(0)
                    kept.append(body.tobytes())
                    continue
                cover = np.zeros(len(body) + 1, np.int64)
                np.add.at(cover, listed.values.field("start").to_numpy(), 1)
                np.add.at(cover, listed.values.field("end").to_numpy(), -1)
                gone = np.cumsum(cover[:-1]) > 0
                removed.append(int(gone.sum()))
                runs.append(int((gone & ~np.append(False, gone[:-1])).sum()))
                kept.append(body[~gone].tobytes())
            yield pa.record_batch([batch.column("doc_id"), pa.array(ends - starts), pa.array(removed, pa.int64()), pa.array(runs, pa.int64()),
                                   pa.array([hashlib.sha256(k).hexdigest() for k in kept], pa.string()), pa.array(kept, pa.binary())], names)

    joined = rows.join(spans, F.col("row") == F.col("s_row"), "left").select("doc_id", "text", "spans")
    return joined.mapInArrow(run, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary")
