"""Benchmark decontamination: items found in documents within a bounded edit distance.

A CGK walk reads a string with a random bit per step and character that says whether it moves on;
strings at a small edit distance give walks at a small Hamming distance, because two walks fall into
step again soon after an edit.  A repetition draws its bits and a few steps (bit sampling); windows
whose walks show the same characters at those steps share a bucket.

Windows of a document start at every ``stride`` bytes.  Windows of an item start at its first
``stride`` bytes each and at every stride-th place of the rest, so that an item that stands anywhere
in a document has windows in step with the document's, all along its length.  Classes of item sizes
have their own walk lengths and strides.  Repetitions are added until the recall that a class is
expected to reach at ``typical_ratio`` edits, by a model of windows and edits, is ``recall``.

Every pair that shares a bucket is verified by the exact edit distance of the item to the best
passage around (bit-parallel).  Items are taken in blocks of bounded size; each block is sent to all
tasks and meets all documents.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import ceil, log

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import U64, bounded_batches, mix64, slices, utf8

#: (least item bytes, steps of a walk, stride, sampled steps)
CLASSES = ((64, 48, 16, 12), (16, 12, 4, 8), (4, 4, 1, 4), (1, 1, 1, 1))
#: Share of a walk's steps at which bucket mates may differ: chance mates differ in most of them.
MAX_APART = 0.35
GRAM = 4
BLOCK_ITEMS, BLOCK_BYTES = 4096, 4 << 20
#: A-Z lowered and white space as a blank, byte for byte.
FOLD = np.arange(256, dtype=np.uint8)
FOLD[0x41:0x5B] += 0x20
FOLD[0x09:0x0E] = 0x20


def repetitions(size: int, steps: int, stride: int, sampled: int, ratio: float, recall: float, most: int = 16) -> int:
    """Repetitions for an item of ``size`` bytes: a window of ``steps / 2`` bytes has that many times
    ``ratio`` edits, and one edit sets about 3 steps apart."""
    windows = max(1, (size - steps) // stride + 1)
    hit = (1 - min(0.9, 3 / steps)) ** (sampled * ratio * steps / 2)
    missed = (1 - hit) ** windows
    if missed <= 0:
        return 1
    return max(1, min(most, ceil(log(1 - recall) / log(missed)))) if missed < 1 else most


class Walks:
    """The random bits and sampled steps of a class, by repetition."""

    def __init__(self, steps: int, sampled: int, count: int, seed: int):
        rng = np.random.default_rng(seed)
        self.steps = steps
        self.moves = rng.integers(0, 2, (count, steps, 256), dtype=np.uint8).astype(np.intp)
        self.sampled = [set(rng.choice(steps, min(sampled, steps), replace=False).tolist()) for _ in range(count)]

    def keys(self, body: np.ndarray, at: np.ndarray, repetition: int, chunk: int = 8192) -> np.ndarray:
        """Bucket keys of the windows at ``at``; ``body`` has ``steps`` zero bytes after its end."""
        sampled, moves = self.sampled[repetition], self.moves[repetition]
        out = np.full(len(at), repetition + 1, U64)
        for c in range(0, len(at), chunk):  # small enough to stay in the cache
            pos, key = at[c: c + chunk].astype(np.intp), out[c: c + chunk]
            for j in range(max(sampled) + 1):
                char = body.take(pos)
                if j in sampled:
                    key *= U64(0x9E3779B97F4A7C15)
                    key += char
                pos += moves[j].take(char)
        return mix64(out)


    def apart(self, one: np.ndarray, at_one: np.ndarray, other: np.ndarray, at_other: np.ndarray, repetition: int) -> np.ndarray:
        """Hamming distances of the walks from the given places of two bodies."""
        moves, p, q = self.moves[repetition], at_one.astype(np.intp), at_other.astype(np.intp)
        distance = np.zeros(len(p), np.int32)
        for j in range(self.steps):
            a, b = one.take(p), other.take(q)
            distance += a != b
            p += moves[j].take(a)
            q += moves[j].take(b)
        return distance


class Index:
    """Buckets of a block of items, by class and repetition, as sorted keys."""

    def __init__(self, items: list[tuple[int, bytes]], max_ratio: float, typical_ratio: float, recall: float):
        self.items = [(i, FOLD[np.frombuffer(t, np.uint8)].tobytes()) for i, t in items if t]
        self.max_ratio, self.classes = max_ratio, []
        above = None
        for c, (least, steps, stride, sampled) in enumerate(CLASSES):
            own = [(k, t) for k, (_, t) in enumerate(self.items) if len(t) >= least and (above is None or len(t) < above)]
            above = least
            if not own:
                continue
            count = max(repetitions(len(t), steps, stride, sampled, typical_ratio, recall) for _, t in own)
            walks, tables = Walks(steps, sampled, count, 1000 + c), []
            body = np.concatenate([x for _, t in own for x in (np.frombuffer(t, np.uint8), np.zeros(steps, np.uint8))])
            at, owner, offset, base = [], [], [], 0
            for k, t in own:
                o = np.arange(max(1, min(len(t), len(t) - steps // 2 + 1)))
                at.append(base + o)
                owner.append(np.full(len(o), k))
                offset.append(o)
                base += len(t) + steps
            at, owner, offset = (np.concatenate(x) for x in (at, owner, offset))
            for r in range(count):
                keys = walks.keys(body, at, r)
                order = np.argsort(keys, kind="stable")
                tables.append((keys[order], order))
            self.classes.append((steps, stride, walks, tables, body, at, owner, offset))

    def candidates(self, body: np.ndarray, size: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(item, start of the item in the slice) of all bucket mates; ``body`` is a folded slice with zero bytes after it."""
        for steps, stride, walks, tables, items, places, owner, offset in self.classes:
            at = np.arange(0, size, stride)
            for r, (keys, order) in enumerate(tables):
                found = walks.keys(body, at, r)
                lo = np.searchsorted(keys, found)
                hit = np.flatnonzero(keys[np.minimum(lo, len(keys) - 1)] == found)
                if not len(hit):
                    continue
                lo, hi = lo[hit], np.searchsorted(keys, found[hit], "right")
                n = hi - lo
                mates = order[np.repeat(lo - (np.cumsum(n) - n), n) + np.arange(n.sum())]
                windows = np.repeat(at[hit], n)
                near = walks.apart(body, windows, items, places[mates], r) <= steps * MAX_APART
                yield owner[mates[near]], windows[near] - offset[mates[near]]


def _ends(pattern: bytes, text: bytes, most: int) -> tuple[int, int]:
    """(least edits, end in the text) of the pattern against any passage of the text; edits over ``most``: (-1, -1)."""
    m = len(pattern)
    peq: dict[int, int] = {}
    for i, c in enumerate(pattern):
        peq[c] = peq.get(c, 0) | 1 << i
    full, high = (1 << m) - 1, 1 << (m - 1)
    pv, mv, score, best, end = full, 0, m, most + 1, -1
    for j, c in enumerate(text):
        eq = peq.get(c, 0)
        xv = eq | mv
        xh = (((eq & pv) + pv) ^ pv) | eq
        ph, mh = mv | ~(xh | pv) & full, pv & xh
        score += bool(ph & high) - bool(mh & high)
        ph, mh = ph << 1 & full, mh << 1 & full
        pv, mv = mh | ~(xv | ph) & full, ph & xv
        if score < best:
            best, end = score, j + 1
    return (best, end) if end >= 0 else (-1, -1)


def best_passage(item: bytes, text: bytes, start: int, most: int) -> tuple[int, int, int] | None:
    """(edits, start, end) of the passage nearest to the item around ``start``, at most ``most`` edits."""
    lo, hi = max(0, start - 2 * most - 32), start + len(item) + 2 * most + 32
    near = text[lo:hi]
    at = near.find(item)
    if at >= 0:
        return 0, lo + at, lo + at + len(item)
    # an edit changes at most GRAM of the item's grams: the others all stand in the passage
    grams, least = {near[i: i + GRAM] for i in range(len(near) - GRAM + 1)}, len(item) - GRAM + 1 - most * GRAM
    if least > 0 and sum(item[i: i + GRAM] in grams for i in range(len(item) - GRAM + 1)) < least:
        return None
    edits, end = _ends(item, near, most)
    if edits < 0:
        return None
    _, back = _ends(item[::-1], near[:end][::-1], edits)
    return edits, lo + end - back, lo + end


def find_items(index: Index, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> Iterator[tuple[int, int, int, int, int]]:
    """(row, item number, edits, start, end) of the items in a slice of texts, the best passage of each pair."""
    if not len(data) or not index.classes:
        return
    folded = FOLD[data]
    body = np.concatenate([folded, np.zeros(max(c[0] for c in index.classes) + 1, np.uint8)])
    pairs, best = set(), {}
    for item, begin in index.candidates(body, len(data)):
        middle = np.clip(begin + np.array([len(index.items[i][1]) // 2 for i in item]), 0, len(data) - 1)
        row = np.searchsorted(starts, middle, "right") - 1
        pairs.update(zip(row.tolist(), item.tolist(), (begin >> 4).tolist()))
    for row, item, place in sorted(pairs):
        known = best.get((row, item))
        if known and known[0] == 0:
            continue
        number, text = index.items[item][0], index.items[item][1]
        passage = best_passage(text, folded[starts[row]: ends[row]].tobytes(), (place << 4) - int(starts[row]), int(index.max_ratio * len(text)))
        if passage and (known is None or passage < known):
            best[row, item] = passage
    for (row, item), (edits, s, e) in best.items():
        yield row, index.items[item][0], edits, s, e


def blocks(items: DataFrame, text: str, item_id: str) -> Iterator[list[tuple[int, bytes]]]:
    """The stated items in blocks of bounded number and size; null and empty texts are left out."""
    block, size = [], 0
    rows = items.select(F.col(f"`{item_id}`").cast("long").alias("i"), F.encode(F.col(f"`{text}`").cast("string"), "UTF-8").alias("t"))
    for r in rows.where("length(t) > 0").orderBy("i", "t").toLocalIterator():
        block.append((r["i"], bytes(r["t"])))
        size += len(r["t"])
        if len(block) >= BLOCK_ITEMS or size >= BLOCK_BYTES:
            yield block
            block, size = [], 0
    if block:
        yield block


FOUND = "doc_id long, item_id long, edits int, start long, end long"


def find_leaks(docs: DataFrame, items: DataFrame, text: str = "text", doc_id: str = "doc_id", item_text: str = "text",
               item_id: str = "item_id", max_ratio: float = 0.1, typical_ratio: float | None = None, recall: float = 0.98) -> DataFrame:
    """A row per row of ``docs`` and item in it: ``doc_id, item_id, edits, start, end`` of the best passage
    (code points, end exclusive), at most ``max_ratio`` edits per byte of the item, letter case and kind
    of white space aside.  Windows are tried so often that an item with ``typical_ratio`` edits per byte (by default
    ``max_ratio``, the most that are accepted) is met with a chance of ``recall``.

    Null and empty texts and items match nothing; null ids stay null; repeated rows repeat; empty
    tables give an empty result."""
    spark = docs.sparkSession
    bounded_batches(spark)
    rows = docs.select(F.col(f"`{doc_id}`").cast("long").alias("doc_id"), F.col(f"`{text}`").cast("string").alias("text"))
    names = [f.split()[0] for f in FOUND.split(", ")]
    types = [pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64()]
    out = spark.createDataFrame([], FOUND)
    for block in blocks(items, item_text, item_id):
        shared = spark.sparkContext.broadcast(Index(block, max_ratio, max_ratio if typical_ratio is None else typical_ratio, recall))

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            for batch in slices(batches, "text", 4 << 20):
                data, starts, ends = utf8(batch.column("text"))
                ids, found = batch.column("doc_id"), []
                for row, item, edits, s, e in find_items(shared.value, data, starts, ends):
                    points = np.cumsum((data[starts[row]: ends[row]] & 0xC0) != 0x80)
                    found.append((ids[row].as_py(), item, edits, int(points[s]) - 1, int(points[e - 1])))
                if found:
                    yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*found), types)], names)

        out = out.unionByName(rows.mapInArrow(run, FOUND))
    return out


def drop_leaks(docs: DataFrame, items: DataFrame, text: str = "text", item_text: str = "text", item_id: str = "item_id",
               max_ratio: float = 0.1, typical_ratio: float | None = None, recall: float = 0.98) -> DataFrame:
    """``docs`` without the rows in which :func:`find_leaks` finds an item; all columns stay."""
    spark = docs.sparkSession
    bounded_batches(spark)
    for block in blocks(items, item_text, item_id):
        shared = spark.sparkContext.broadcast(Index(block, max_ratio, max_ratio if typical_ratio is None else typical_ratio, recall))

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            for batch in slices(batches, text, 4 << 20):
                keep = np.ones(batch.num_rows, bool)
                keep[[x[0] for x in find_items(shared.value, *utf8(batch.column(text)))]] = False
                yield batch.filter(pa.array(keep))

        docs = docs.mapInArrow(run, docs.schema)
    return docs
