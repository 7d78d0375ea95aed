"""Merkle dataset manifest: a SHA-256 midstate tree over the documents of every group.

Every document is a leaf; a parent is the SHA-256 of the hexadecimal digests of up to three
consecutive children.  A child fills one 64-byte block of the hash, so the state before a child slot is
the eight words reached after the children to its left.  A parent retains a copy of that state
for each slot.  A replaced leaf is folded by resuming the state of its slot with the
replacement and the siblings to its right; those to its left are never hashed again.

1. Leaves are digested by built-in functions, range partitioned by (group, order) and numbered from
   counts per partition and group, so a group with a third of all rows is spread over tasks.
2. A block of ``3 ** height`` consecutive nodes is raised in one task, many blocks at a time (the
   compression function works on arrays).  Its row keeps the digests and the retained states of all
   its levels.  The tops of the blocks are the nodes of the next tier, until each group has one; the
   groups' tops are the nodes of one more tree of the same make.
3. From the top down, each block is given the steps from its top to the root (slot, run size, state,
   siblings).  Last, each document is folded through its block and these steps.

No block and no step list grows with the data beyond the logarithm of its size.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce
from math import isqrt
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import stage_table
from .common import bounded_batches, partitions, utf8

FAN, HEIGHT = 3, 8
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
#: A step: run size, slot, state before the slot, the run's other digests.
STEP = np.dtype([("size", "u1"), ("slot", "u1"), ("state", "u1", 32), ("others", "u1", (FAN - 1, 32))])
CHUNK_ROWS, LANES = 1 << 15, 1 << 13

_PRIMES = [p for p in range(2, 312) if all(p % q for q in range(2, isqrt(p) + 1))]


def _cube_root(x: int) -> int:
    r = round(x ** (1 / 3))
    while r ** 3 > x:
        r -= 1
    while (r + 1) ** 3 <= x:
        r += 1
    return r


def _root_bits(p: int, cube: bool) -> np.uint32:
    """The first 32 bits of the fraction of a square or cube root."""
    if not cube:
        return np.uint32(isqrt(p << 64) & 0xFFFFFFFF)
    low, high = _cube_root(p) << 32, (_cube_root(p) + 1) << 32
    while high - low > 1:
        mid = (low + high) // 2
        low, high = (mid, high) if mid ** 3 <= p << 96 else (low, mid)
    return np.uint32(low & 0xFFFFFFFF)


START = np.array([_root_bits(p, False) for p in _PRIMES[:8]], np.uint32)
ROUND = [_root_bits(p, True) for p in _PRIMES]
#: The last block of a hash over ``k`` digests.
PADDING = [np.array([0x80000000, *[0] * 14, 512 * k], np.uint32)[:, None] for k in range(FAN + 1)]
HEX = np.frombuffer("".join(f"{b:02x}" for b in range(256)).encode(), np.uint16)


def _turn(x: np.ndarray, *by: int) -> np.ndarray:
    out = None
    for r in by:
        y = (x >> np.uint32(r)) | (x << np.uint32(32 - r))
        out = y if out is None else np.bitwise_xor(out, y, out=out)
    return out


def compress(states: np.ndarray, blocks: np.ndarray) -> np.ndarray:
    """SHA-256's compression function: ``states`` (n, 8) after hashing one block each, (16, n) or (16, 1) words."""
    out = np.empty_like(states)
    for a in range(0, len(states), LANES):
        s = np.ascontiguousarray(states[a: a + LANES].T)
        w = list(blocks[:, a: a + LANES] if blocks.shape[1] > 1 else blocks)
        v = list(s)
        for i in range(64):
            if i > 15:
                x, y = w[i - 15], w[i - 2]
                w.append(w[i - 16] + (_turn(x, 7, 18) ^ (x >> np.uint32(3))) + w[i - 7] + (_turn(y, 17, 19) ^ (y >> np.uint32(10))))
            t = v[7] + _turn(v[4], 6, 11, 25) + (v[6] ^ (v[4] & (v[5] ^ v[6]))) + (w[i] + ROUND[i])
            u = _turn(v[0], 2, 13, 22) + ((v[0] & v[1]) | (v[2] & (v[0] | v[1])))
            v = [t + u, v[0], v[1], v[2], v[3] + t, v[4], v[5], v[6]]
        out[a: a + LANES] = (s + np.stack(v)).T
    return out


def hex_text(digests: np.ndarray) -> np.ndarray:
    """(n, 32) bytes to (n, 64) hexadecimal characters."""
    return HEX[digests].view(np.uint8)


def hex_words(digests: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(hex_text(np.ascontiguousarray(digests)).view(">u4").T.astype(np.uint32))


def as_bytes(states: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(states.astype(">u4")).view(np.uint8).reshape(len(states), 32)


def as_states(raw: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(raw).view(">u4").astype(np.uint32)


def finish(states: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Digests of hashes over ``sizes`` digests each."""
    out = np.empty((len(states), 32), np.uint8)
    for k in range(1, FAN + 1):
        on = sizes == k
        if on.any():
            out[on] = as_bytes(compress(states[on], PADDING[k]))
    return out


def resume(digests: np.ndarray, steps: np.ndarray) -> np.ndarray:
    """The parents' digests when the child at each step's slot is ``digests``: the retained state takes the child
    and the siblings to its right."""
    states = compress(as_states(steps["state"]), hex_words(digests))
    for j in range(FAN - 1):
        on = (steps["slot"] <= j) & (steps["size"] > j + 1)  # the sibling in place j stands right of the slot
        if on.any():
            states[on] = compress(states[on], hex_words(steps["others"][on, j]))
    return finish(states, steps["size"])


class Level(NamedTuple):
    """A level of many blocks: child digests and the parents' retained states (before slots 1 and 2), one
    block after the other; ``first`` and ``count`` of each block's children, ``parent`` its first parent."""
    digests: np.ndarray
    states: np.ndarray
    first: np.ndarray
    count: np.ndarray
    parent: np.ndarray


def _starts(counts: np.ndarray) -> np.ndarray:
    return np.cumsum(counts) - counts


def raise_level(digests: np.ndarray, count: np.ndarray) -> tuple[Level, np.ndarray]:
    """One level over blocks of ``count`` consecutive digests each; the level and the parents' digests."""
    parents = -(-count // FAN)
    first, parent = _starts(count), _starts(parents)
    block = np.repeat(np.arange(len(count)), parents)
    at = (np.arange(len(block)) - parent[block]) * FAN
    size = np.minimum(FAN, count[block] - at)
    at += first[block]
    now = np.broadcast_to(START, (len(at), 8)).copy()
    kept = np.zeros((len(at), FAN - 1, 32), np.uint8)
    for slot in range(FAN):
        on = size > slot
        if slot:
            kept[on, slot - 1] = as_bytes(now[on])
        now[on] = compress(now[on], hex_words(digests[at[on] + slot]))
    return Level(digests, kept, first, count, parent), finish(now, size)


def steps_at(level: Level, block: np.ndarray, child: np.ndarray) -> np.ndarray:
    """The steps from children (number in their block) to their parents."""
    out = np.zeros(len(block), STEP)
    run, slot = np.divmod(child, FAN)
    size = np.minimum(FAN, level.count[block] - run * FAN)
    out["size"], out["slot"] = size, slot
    kept = level.states[level.parent[block] + run]
    out["state"] = as_bytes(START[None])
    for s in range(1, FAN):
        out["state"][slot == s] = kept[slot == s, s - 1]
    base = level.first[block] + run * FAN
    for j in range(FAN - 1):
        on = size > j + 1
        out["others"][on, j] = level.digests[(base + j + (slot <= j))[on]]
    return out


def whole_blocks(batches: Iterator[pa.RecordBatch], starts) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Tables of whole blocks with the rows at which blocks start; ``starts(pos)`` marks them."""
    held, rows = [], 0

    def cut(last: bool):
        nonlocal held, rows
        t = pa.Table.from_batches(held).combine_chunks()
        first = np.flatnonzero(starts(t.column("pos").to_numpy()))
        to = t.num_rows if last else int(first[-1])
        held = t.slice(to).to_batches()
        rows = t.num_rows - to
        return t.slice(0, to), first[first < to]

    for batch in batches:
        if batch.num_rows:
            held.append(batch)
            rows += batch.num_rows
        if rows >= CHUNK_ROWS:
            done = cut(False)
            if done[0].num_rows:
                yield done
    if rows:
        yield cut(True)


def _digests(column: pa.ChunkedArray) -> np.ndarray:
    return utf8(column.combine_chunks())[0].reshape(-1, 32)


def _binary(rows: np.ndarray) -> pa.Array:
    """(n, k) bytes as a binary column."""
    n, k = rows.shape
    return pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer((np.arange(n + 1, dtype=np.int64) * k).astype(np.int32)),
                                                  pa.py_buffer(np.ascontiguousarray(rows).tobytes())])


def raise_blocks(nodes: DataFrame, height: int) -> DataFrame:
    """``g, pos, levels, digest`` nodes to a row per block: ``g, pos`` (the block's number), ``levels`` (those of the
    block's nodes up to their group's top), ``size, tree`` (digests and states by level) and ``top``."""
    wide = FAN ** height
    schema = "g string, pos long, levels int, size int, tree binary, top binary"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t, first in whole_blocks(batches, lambda pos: pos % wide == 0):
            sizes = np.diff(np.append(first, t.num_rows))
            levels = t.column("levels").to_numpy()[first]
            up = np.minimum(levels, height)
            trees: list[list[bytes]] = [[] for _ in first]
            tops = np.zeros((len(first), 32), np.uint8)
            digests, count, blocks = _digests(t.column("digest")), sizes, np.arange(len(first))
            for step in range(height + 1):
                on = up[blocks] > step
                lanes = np.repeat(on, count)
                tops[blocks[~on]] = digests[~lanes]  # a finished block has one node
                digests, count, blocks = digests[lanes], count[on], blocks[on]
                if not len(blocks):
                    break
                level, digests = raise_level(digests, count)
                count = -(-count // FAN)
                for b, a, n, p, m in zip(blocks.tolist(), level.first.tolist(), level.count.tolist(), level.parent.tolist(), count.tolist()):
                    trees[b] += [level.digests[a: a + n].tobytes(), level.states[p: p + m].tobytes()]
            at = pa.array(first)
            yield pa.record_batch([t.column("g").combine_chunks().take(at), pa.array(t.column("pos").to_numpy()[first] // wide),
                                   pa.array(levels, pa.int32()), pa.array(sizes, pa.int32()),
                                   pa.array([b"".join(x) for x in trees], pa.binary()), _binary(tops)],
                                  ["g", "pos", "levels", "size", "tree", "top"])

    spread = nodes.withColumn("block", F.expr(f"pos div {wide}")).repartition(partitions(nodes.sparkSession), "g", "block")
    return spread.sortWithinPartitions("g", "pos").select("g", "pos", "levels", "digest").mapInArrow(run, schema)


def read_levels(sizes: np.ndarray, up: np.ndarray, trees: list[bytes]) -> list[tuple[Level, np.ndarray]]:
    """The levels of blocks as :func:`raise_blocks` wrote them, each with the number of a block in it (-1: none)."""
    out, count, at = [], sizes.astype(np.int64), np.zeros(len(sizes), np.int64)
    for step in range(int(up.max(initial=0))):
        on = np.flatnonzero(up > step)
        n, parents = count[on], -(-count[on] // FAN)
        digests, states = [], []
        for b, a, c, p in zip(on.tolist(), at[on].tolist(), n.tolist(), parents.tolist()):
            digests.append(trees[b][a: a + 32 * c])
            states.append(trees[b][a + 32 * c: a + 32 * c + 64 * p])
        number = np.full(len(sizes), -1)
        number[on] = np.arange(len(on))
        out.append((Level(np.frombuffer(b"".join(digests), np.uint8).reshape(-1, 32),
                          np.frombuffer(b"".join(states), np.uint8).reshape(-1, FAN - 1, 32), _starts(n), n, _starts(parents)), number))
        at[on] += 32 * n + 64 * parents
        count[on] = parents
    return out


def _with_blocks(rows: DataFrame, blocks: DataFrame, height: int) -> DataFrame:
    """Nodes (``g, pos, id, digest``) behind the row of their block (``size, levels, tree, path, subroot, root``; its pos is -1)."""
    wide = FAN ** height
    block_rows = blocks.select("g", F.col("pos").alias("block"), F.lit(-1).cast("long").alias("pos"), F.lit(None).cast("long").alias("id"),
                               F.lit(None).cast("binary").alias("leaf"), F.lit(None).cast("binary").alias("digest"),
                               "size", "levels", "tree", "path", "subroot", "root")
    node_rows = rows.select("g", F.expr(f"pos div {wide}").alias("block"), "pos", "id", "leaf", "digest",
                            *[F.lit(None).cast(block_rows.schema[c].dataType).alias(c) for c in ("size", "levels", "tree", "path", "subroot", "root")])
    both = block_rows.unionByName(node_rows).repartition(partitions(rows.sparkSession), "g", "block")
    return both.sortWithinPartitions("g", "block", "pos")


def _block_parts(t: pa.Table, first: np.ndarray, height: int):
    """Of a table of :func:`_with_blocks`: the node rows, the block of each, their numbers in it, the levels."""
    is_node = np.ones(t.num_rows, bool)
    is_node[first] = False
    heads, nodes = t.take(pa.array(first)), t.filter(pa.array(is_node))
    block = np.repeat(np.arange(len(first)), np.diff(np.append(first, t.num_rows)) - 1)
    child = nodes.column("pos").to_numpy() % FAN ** height
    up = np.minimum(heads.column("levels").to_numpy(), height)
    return heads, nodes, block, child, read_levels(heads.column("size").to_numpy(), up, heads.column("tree").to_pylist())


def _climb(block: np.ndarray, child: np.ndarray, levels) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """By level: the lanes that have it and their steps."""
    for level, number in levels:
        on = np.flatnonzero(number[block] >= 0)
        yield on, steps_at(level, number[block[on]], child[on])
        child = child // FAN


def lower_paths(nodes: DataFrame, blocks: DataFrame, height: int) -> DataFrame:
    """``g, pos, path`` of nodes: the steps in their block, followed by the path of the block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t, first in whole_blocks(batches, lambda pos: pos < 0):
            heads, nodes, block, child, levels = _block_parts(t, first, height)
            parts: list[list[bytes]] = [[] for _ in block]
            for on, steps in _climb(block, child, levels):
                for i, s in zip(on.tolist(), steps):
                    parts[i].append(s.tobytes())
            above = heads.column("path").to_pylist()
            paths = [b"".join(p) + above[b] for p, b in zip(parts, block.tolist())]
            yield pa.record_batch([nodes.column("g").combine_chunks(), nodes.column("pos").combine_chunks(), pa.array(paths, pa.binary())],
                                  ["g", "pos", "path"])

    nodes = nodes.select("g", "pos", F.lit(None).cast("long").alias("id"), F.lit(None).cast("binary").alias("leaf"), "digest")
    return _with_blocks(nodes, blocks, height).mapInArrow(run, "g string, pos long, path binary")


def fold_leaves(leaves: DataFrame, blocks: DataFrame, height: int) -> DataFrame:
    """``id, leaf, subroot, root, proof_sha256, folded_root`` of leaves, whose ``digest`` takes the place of ``leaf``."""
    names = ["id", "leaf", "subroot", "root", "proof_sha256", "folded_root"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t, first in whole_blocks(batches, lambda pos: pos < 0):
            heads, nodes, block, child, levels = _block_parts(t, first, height)
            folded = _digests(nodes.column("digest")).copy()
            paths = [np.frombuffer(p, STEP) for p in heads.column("path").to_pylist()]
            others = np.zeros((len(block), max(1, len(levels)), FAN - 1, 32), np.uint8)
            some = np.zeros(others.shape[:3], bool)
            for k, (on, steps) in enumerate(_climb(block, child, levels)):
                folded[on] = resume(folded[on], steps)
                others[on, k] = steps["others"]
                some[on, k] = steps["size"][:, None] > np.arange(1, FAN)
            longest = max(map(len, paths), default=0)
            length = np.array([len(p) for p in paths])
            for k in range(longest):
                at = np.array([p[min(k, len(p) - 1)] if len(p) else np.zeros((), STEP) for p in paths], STEP)
                on = np.flatnonzero(length[block] > k)
                folded[on] = resume(folded[on], at[block[on]])
            own = hex_text(others[some]).tobytes()
            ends = np.cumsum(some.sum((1, 2))) * 64
            above = [hex_text(p["others"][p["size"][:, None] > np.arange(1, FAN)].reshape(-1, 32)).tobytes() for p in paths]
            proofs, a = [], 0
            for e, b in zip(ends.tolist(), block.tolist()):
                h = hashlib.sha256(own[a:e])
                h.update(above[b])
                proofs.append(h.hexdigest())
                a = e
            by_block = pa.array(block)
            yield pa.record_batch([nodes.column("id").combine_chunks(), nodes.column("leaf").combine_chunks(),
                                   heads.column("subroot").combine_chunks().take(by_block), heads.column("root").combine_chunks().take(by_block),
                                   pa.array(proofs, pa.string()), _binary(folded)], names)

    found = _with_blocks(leaves, blocks, height).mapInArrow(
        run, "id long, leaf binary, subroot binary, root binary, proof_sha256 string, folded_root binary")
    text = [c if c in ("id", "proof_sha256") else F.lower(F.hex(c)).alias(c) for c in names]
    return found.select(*text, (F.col("folded_root") == F.col("root")).alias("verified"))


def _numbered(rows: DataFrame, *order: str) -> DataFrame:
    """``rows`` (a stored table with ``g``) with ``pos``, the place in ``g`` by ``order``, and ``levels`` of a tree over ``g``."""
    n = partitions(rows.sparkSession)
    rows = stage_table(rows.repartitionByRange(n, "g", *order).sortWithinPartitions("g", *order)
                       .withColumn("at", F.monotonically_increasing_id()), "merkle-sorted").withColumn("part", F.expr("shiftright(at, 33)"))
    by_group = Window.partitionBy("g")
    runs = rows.groupBy("g", "part").agg(F.min("at").alias("least"), F.count(F.lit(1)).alias("size"))
    runs = runs.select("g", "part", F.sum("size").over(by_group).alias("n"),
                       (F.sum("size").over(by_group.orderBy("part")) - F.col("size") - F.col("least")).alias("shift"))
    levels = reduce(Column.__add__, [(F.col("n") > FAN ** i).cast("int") for i in range(39)])
    return rows.join(runs, ["g", "part"]).withColumn("pos", F.col("at") + F.col("shift")).withColumn("levels", levels).drop("at", "part", "n", "shift")


def _tiers(nodes: DataFrame, height: int) -> list[DataFrame]:
    """The blocks of all tiers, lowest first, as stored tables."""
    tiers = []
    while True:
        blocks = stage_table(raise_blocks(nodes, height), "merkle-blocks")
        tiers.append(blocks)
        open_blocks = blocks.where(F.col("levels") > height)
        if open_blocks.isEmpty():
            return tiers
        nodes = open_blocks.select("g", "pos", (F.col("levels") - height).alias("levels"), F.col("top").alias("digest"))


def _tops(tiers: list[DataFrame], height: int) -> DataFrame:
    return reduce(DataFrame.unionByName, [t.where(F.col("levels") <= height).select("g", F.col("top").alias("subroot")) for t in tiers])


def _paths(tiers: list[DataFrame], above: DataFrame, height: int) -> DataFrame:
    """The lowest tier's blocks with ``path`` (their tops to the root) and the columns of ``above`` (``g, path, subroot, root``)."""
    groups = above.select("g", "subroot", "root")
    paths = None
    for k in reversed(range(len(tiers))):
        ended = tiers[k].where(F.col("levels") <= height).select("g", "pos").join(above.select("g", "path"), "g")
        given = ended if paths is None else ended.unionByName(paths)
        blocks = tiers[k].join(given, ["g", "pos"]).join(groups, "g")
        if k:
            below = tiers[k - 1].where(F.col("levels") > height).select("g", "pos", F.col("top").alias("digest"))
            paths = stage_table(lower_paths(below, blocks, height), "merkle-paths")
    return blocks


def leaf_digest(columns) -> Column:
    """SHA-256 over the columns as text: ``-`` for null, else byte count, ``:`` and value."""
    parts = [c.cast("string") for c in columns]
    return F.unhex(F.sha2(F.concat(*[F.coalesce(F.concat(F.octet_length(c).cast("string"), F.lit(":"), c), F.lit("-")) for c in parts]), 256))


def audit(docs: DataFrame, tampered: dict[str, Column] | None = None, fields=FIELDS, group: str = "source", order: str = "doc_id",
          height: int = HEIGHT) -> DataFrame:
    """The manifest of ``docs``, and each document folded into it, alone, with its ``tampered`` columns.

    A row per document: ``order``'s value, ``leaf, subroot, root, proof_sha256`` of the untampered table,
    ``folded_root`` (with the replaced leaf; the same leaf where nothing is tampered) and ``verified``.
    Leaves ascend by ``order`` in their group; the groups by name, null first.  A null ``order`` comes
    first; rows with equal values are ordered by leaf, so that equal rows may change places.  Null and
    empty columns are told apart.  An empty table gives an empty result.  Other columns are not read."""
    bounded_batches(docs.sparkSession, 10_000)
    at = {c: F.col(f"`{c}`") for c in fields}
    changed = leaf_digest([(tampered or {}).get(c, at[c]) for c in fields])
    name = F.col(f"`{group}`").cast("string")
    leaves = stage_table(docs.select(
        F.when(name.isNull(), "n").otherwise(F.concat(F.lit("s"), name)).alias("g"), F.col(f"`{order}`").cast("long").alias("id"),
        leaf_digest(at.values()).alias("leaf"), (changed if tampered else leaf_digest(at.values())).alias("digest"),
        F.monotonically_increasing_id().alias("row")), "merkle-leaves")
    leaves = stage_table(_numbered(leaves, "id", "leaf", "row").drop("row"), "merkle-numbered")
    tiers = _tiers(leaves.select("g", "pos", "levels", F.col("leaf").alias("digest")), height)
    subroots = stage_table(_tops(tiers, height).select(F.lit("").alias("g"), F.col("g").alias("name"), F.col("subroot")), "merkle-subroots")
    subroots = stage_table(_numbered(subroots, "name"), "merkle-forest")
    forest = _tiers(subroots.select("g", "pos", "levels", F.col("subroot").alias("digest")), height)
    root = _tops(forest, height).select("g", F.col("subroot").alias("root"))
    top = root.select("g", F.lit(b"").alias("path"), F.col("root").alias("subroot"), "root")
    steps = lower_paths(subroots.select("g", "pos", F.col("subroot").alias("digest")), _paths(forest, top, height), height)
    above = subroots.join(steps, ["g", "pos"]).join(root, "g").select(F.col("name").alias("g"), "path", "subroot", "root")
    above = stage_table(above, "merkle-above")
    return fold_leaves(leaves, _paths(tiers, above, height), height).withColumnRenamed("id", order)
