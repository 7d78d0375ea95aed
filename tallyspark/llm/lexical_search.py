"""Ranked lexical search by NRA (no random access) over an impact-sorted index of document shards.

1. A pass over the documents makes shards of about ``SHARD_BYTES`` of text.  A shard is an inverted index: a row per
   term with its documents and counts, and one row with the shard's document ids and lengths.  Lists of
   terms that no query has are dropped by a join with the queries' terms.  Corpus figures are sums over all shards.
2. Queries go in blocks of ``BLOCK_ITEMS``; a task gets one shard and one block, that is, the lists of the block's terms.
   Each list is sorted by impact and read in sequence, some further postings of all lists at a time.  A
   document's score lies between what its lists have shown so far and that plus the next impacts of
   the lists that have not shown it.  Reading stops when every document whose upper bound reaches the k-th
   lower bound (equal scores too) has equal bounds: membership, ties and scores are then exact.
3. The best of the shards are ranked per query; each task sends on ``k`` rows a query at most.

Memory of a task is that of one shard's lists for one block of queries, whatever the number of documents and queries;
postings are copied once per block of queries that has the term, which is the size of the search itself.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import stage_table
from .common import bounded_batches, partitions, slices, utf8
from .ngram_join import LOWER

TOP, SHARD_BYTES, BLOCK_ITEMS, FIRST_DEPTH, DEEPER = 20, 16 << 20, 256, 64, 4
SLICE_BYTES = 2 << 20
IS_TERM = np.zeros(256, bool)
IS_TERM[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True
RESULT = "item_id long, rank int, doc_id long, score long"


def terms_of(column: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Distinct terms of a column of texts; (row, number of the term, count) of all pairs; all terms by row."""
    data, starts, ends = utf8(column)
    inside = IS_TERM[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[starts[starts < ends]] = True
    head, tail = inside.copy(), inside.copy()
    head[1:] &= ~inside[:-1] | edge[1:-1]
    tail[:-1] &= ~inside[1:] | edge[1:-1]
    begin, end = np.flatnonzero(head), np.flatnonzero(tail) + 1
    offsets = np.append(0, np.cumsum(end - begin))
    words = pa.Array.from_buffers(pa.large_binary(), len(begin), [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(LOWER[data[inside]].tobytes())])
    coded = words.dictionary_encode()
    row = np.searchsorted(starts, begin, "right") - 1  # the last of the rows that start here is the one with text
    total = np.bincount(row, minlength=len(starts)).astype(np.int64)
    size = max(1, len(coded.dictionary))
    pair, count = np.unique(row * size + coded.indices.to_numpy().astype(np.int64), return_counts=True)
    return coded.dictionary, pair // size, pair % size, count, total


def _blobs(values: np.ndarray, ends: np.ndarray) -> pa.Array:
    """Slices of an array as a binary column."""
    offsets = np.append(0, ends).astype(np.int64) * values.itemsize
    return pa.Array.from_buffers(pa.large_binary(), len(ends), [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(values.tobytes())]).cast(pa.binary())


def build_index(docs: DataFrame, text: str, doc_id: str, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """``shard, term, n_docs, total, docs, counts``: lists of terms, and of each shard a row without term, whose
    ``docs`` are ids and ``counts`` lengths, ``n_docs`` its documents with a term and ``total`` its terms."""
    names = ["shard", "term", "n_docs", "total", "docs", "counts"]

    def shard(number: int, parts: list[tuple]) -> Iterator[pa.RecordBatch]:
        ids = np.concatenate([p[0] for p in parts])
        total = np.concatenate([p[5] for p in parts])
        coded = pa.chunked_array([p[1] for p in parts]).combine_chunks().dictionary_encode()
        code = coded.indices.to_numpy().astype(np.int64)
        first, shift, doc, term, count = 0, 0, [], [], []
        for p in parts:
            doc.append(p[2] + first)
            term.append(code[p[3] + shift])
            count.append(p[4])
            first += len(p[0])
            shift += len(p[1])
        doc, term, count = map(np.concatenate, (doc, term, count))
        order = np.argsort(term, kind="stable")
        ends = np.cumsum(np.bincount(term, minlength=len(coded.dictionary)))
        key = pa.array([number], pa.int64())
        yield pa.record_batch([key, pa.nulls(1, pa.binary()), pa.array([int((total > 0).sum())], pa.int64()), pa.array([int(total.sum())], pa.int64()),
                               pa.array([ids.tobytes()], pa.binary()), pa.array([total.tobytes()], pa.binary())], names)
        if not len(ends):
            return
        n = len(ends)
        lists = pa.record_batch([pa.array(np.full(n, number)), coded.dictionary.cast(pa.binary()), pa.array(np.diff(ends, prepend=0)), pa.nulls(n, pa.int64()),
                                 _blobs(doc[order].astype(np.int32), ends), _blobs(count[order].astype(np.int32), ends)], names)
        for a in range(0, n, 10_000):
            yield lists.slice(a, 10_000)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, held, number = [], 0, TaskContext.get().partitionId() << 33
        for batch in slices(batches, "text", SLICE_BYTES):
            ids = batch.column("doc_id").fill_null(np.iinfo(np.int64).max).to_numpy()
            parts.append((ids, *terms_of(batch.column("text"))))
            held += len(utf8(batch.column("text"))[0]) + 16 * len(ids)
            if held >= shard_bytes:
                yield from shard(number, parts)
                parts, held, number = [], 0, number + 1
        if parts:
            yield from shard(number, parts)

    return docs.select(F.col(f"`{doc_id}`").cast("long").alias("doc_id"), F.col(f"`{text}`").cast("string").alias("text")).mapInArrow(
        run, "shard long, term binary, n_docs long, total long, docs binary, counts binary")


def query_terms(queries: DataFrame, text: str, item_id: str, block_items: int) -> DataFrame:
    """``block, item, item_id, term, times``: the terms of each row of ``queries``."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", SLICE_BYTES):
            terms, row, term, count, _ = terms_of(batch.column("text"))
            at = pa.array(row)
            yield pa.record_batch([batch.column("item").take(at), batch.column("item_id").take(at), terms.take(pa.array(term)).cast(pa.binary()),
                                   pa.array(count)], ["item", "item_id", "term", "times"])

    rows = queries.select(F.monotonically_increasing_id().alias("item"), F.col(f"`{item_id}`").cast("long").alias("item_id"),
                          F.col(f"`{text}`").cast("string").alias("text"))
    return rows.mapInArrow(run, "item long, item_id long, term binary, times long").withColumn("block", F.expr(f"item div {block_items}"))


def no_random_access(lists: list[tuple[np.ndarray, np.ndarray, int]], ids: np.ndarray, top: int, first_depth: int = FIRST_DEPTH) -> tuple[np.ndarray, np.ndarray]:
    """The ``top`` documents (places in ``ids``) by score, then id, with their scores.

    lists: documents and impacts, highest impacts first, and the factor by which the list counts."""
    lower, depth, read = np.zeros(len(ids), np.int64), first_depth, 0
    while True:
        cover, rest = np.zeros(len(ids), np.int64), 0
        for docs, impact, factor in lists:
            lower[docs[read:depth]] += impact[read:depth] * factor
            if depth < len(docs):
                ahead = int(impact[depth]) * factor  # what a list can still add to those it has not shown
                rest += ahead
                cover[docs[:depth]] += ahead
        upper = lower + (rest - cover)
        bar = max(1, int(np.partition(lower, len(lower) - top)[len(lower) - top]) if len(lower) >= top else 1)
        if not ((upper >= bar) & (upper > lower)).any():
            break
        read, depth = depth, depth * DEEPER
    found = np.flatnonzero(lower >= bar)
    found = found[np.lexsort((ids[found], -lower[found]))][:top]
    return found, lower[found]


def search_shards(rows: DataFrame, n: int, length: int, top: int, first_depth: int) -> DataFrame:
    """``item, item_id, doc_id, score``: the best of each shard.  rows: by shard and block the shard's row (kind 0), the
    block's query terms (1) and lists (2)."""

    def solve(t: pa.Table) -> Iterator[pa.RecordBatch]:
        kind = t.column("kind").to_numpy()
        shard, query, lists = (t.filter(pa.array(kind == k)) for k in range(3))
        ids = np.frombuffer(shard.column("docs")[0].as_py(), np.int64)
        m = 100 - 25 + (25 * np.frombuffer(shard.column("counts")[0].as_py(), np.int64) * n) // length
        postings = {}
        for term, docs, counts in zip(lists.column("term"), lists.column("docs"), lists.column("counts")):
            doc, tf = np.frombuffer(docs.as_py(), np.int32), np.frombuffer(counts.as_py(), np.int32).astype(np.int64)
            impact = (1_000_000_000 * tf) // (1000 * tf + 12 * m[doc])
            order = np.argsort(-impact, kind="stable")
            postings[term.as_py()] = doc[order], impact[order]
        order = np.argsort(query.column("item").to_numpy(), kind="stable")
        items = query.column("item").to_numpy()[order]
        item_ids, terms = query.column("item_id").take(pa.array(order)), query.column("term").take(pa.array(order)).to_pylist()
        factor = (query.column("times").to_numpy() * query.column("weight").to_numpy())[order].tolist()
        edges = np.append(np.flatnonzero(np.append(True, items[1:] != items[:-1])), len(items)).tolist()
        at, doc, score = [], [], []
        for a, b in zip(edges[:-1], edges[1:]):
            mine = [(*postings[terms[i]], factor[i]) for i in range(a, b) if terms[i] in postings and factor[i]]
            if mine:
                found, scores = no_random_access(mine, ids, top, first_depth)
                at.append(np.full(len(found), a))
                doc.append(ids[found])
                score.append(scores)
        if at:
            at, ids_found = np.concatenate(at), np.concatenate(doc)
            yield pa.record_batch([pa.array(items[at]), item_ids.combine_chunks().take(pa.array(at)),
                                   pa.array(ids_found, mask=ids_found == np.iinfo(np.int64).max), pa.array(np.concatenate(score))],
                                  ["item", "item_id", "doc_id", "score"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            shard, block = batch.column("shard").to_numpy(), batch.column("block").to_numpy()
            a = 0
            for b in [*(np.flatnonzero((shard[1:] != shard[:-1]) | (block[1:] != block[:-1])) + 1).tolist(), batch.num_rows]:
                part = batch.slice(a, b - a)
                if held and part.num_rows and any(held[-1].column(c)[-1].as_py() != part.column(c)[0].as_py() for c in ("shard", "block")):
                    yield from solve(pa.Table.from_batches(held).combine_chunks())
                    held = []
                if part.num_rows:
                    held.append(part)
                a = b
        if held:
            yield from solve(pa.Table.from_batches(held).combine_chunks())

    return rows.mapInArrow(run, "item long, item_id long, doc_id long, score long")


def search(docs: DataFrame, queries: DataFrame, text: str = "text", doc_id: str = "doc_id", item_text: str = "text", item_id: str = "item_id",
           top: int = TOP, shard_bytes: int = SHARD_BYTES, block_items: int = BLOCK_ITEMS, first_depth: int = FIRST_DEPTH) -> DataFrame:
    """``item_id, rank, doc_id, score``: per row of ``queries`` its ``top`` documents with a score above 0.

    Terms are runs of letters, digits and characters beyond ASCII, A-Z lowered.  Equal scores rank by doc_id (null last);
    repeated rows are documents of their own, and repeated query rows are ranked each.  Null and empty texts have no terms and
    are not found; a query without terms, or with none that the documents have, gives no row.  An empty table on either
    side gives an empty result.  Other columns are not read."""
    spark = docs.sparkSession
    bounded_batches(spark)
    asked = stage_table(query_terms(queries, item_text, item_id, block_items), "search-queries")
    vocabulary = stage_table(asked.select("term").distinct().withColumn("asked", F.lit(True)), "search-terms")  # a measured size for the join
    index = build_index(docs, text, doc_id, shard_bytes).join(vocabulary, "term", "left").where("asked OR term IS NULL").drop("asked")
    index = stage_table(index, "search-index")
    n, length = index.where("term IS NULL").agg(F.sum("n_docs"), F.sum("total")).first()
    if not length:
        return spark.createDataFrame([], RESULT)
    lists = index.where("term IS NOT NULL")
    rarity = (2 * n + 2) / (2 * F.col("df") + 1).cast("double")
    weights = lists.groupBy("term").agg(F.sum("n_docs").alias("df")).select("term", F.floor(1000 * F.log(rarity)).cast("long").alias("weight"))
    asked = stage_table(asked.join(weights, "term"), "search-weights")
    by_block = lists.join(asked.select("term", "block").distinct(), "term")
    groups = stage_table(by_block.select("shard", "block").distinct(), "search-groups")
    none = {c: F.lit(None).cast(k).alias(c) for c, k in (("term", "binary"), ("docs", "binary"), ("counts", "binary"), ("item", "long"),
                                                         ("item_id", "long"), ("times", "long"), ("weight", "long"))}
    columns = ["shard", "block", "kind", *none]

    def as_kind(rows: DataFrame, kind: int) -> DataFrame:
        return rows.select("shard", "block", F.lit(kind).alias("kind"), *[c if c in rows.columns else none[c] for c in none]).select(columns)

    rows = as_kind(index.where("term IS NULL").join(groups, "shard"), 0).unionByName(as_kind(asked.join(groups, "block"), 1)).unionByName(as_kind(by_block, 2))
    rows = rows.repartition(partitions(spark), "shard", "block").sortWithinPartitions("shard", "block", "kind")
    best = search_shards(rows, n, length, top, first_depth)
    ranked = best.withColumn("rank", F.row_number().over(Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))))
    return ranked.where(F.col("rank") <= top).select("item_id", "rank", "doc_id", "score")
