"""Merkle manifest against a plain recursive construction."""

import hashlib
import random
import zlib

import numpy as np
from pyspark.sql import functions as F

FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def h(parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf_of(row):
    return h("-" if v is None else f"{len(str(v).encode())}:{v}" for v in row)


def climb(nodes, at, value):
    """Top of a tree over ``nodes``, the siblings from ``at`` up, and the top with ``value`` in its place."""
    proof = []
    while len(nodes) > 1:
        run = at // 3 * 3
        mine = nodes[run: run + 3]
        proof += [x for k, x in enumerate(mine) if run + k != at]
        mine[at - run] = value
        nodes, at, value = [h(nodes[i: i + 3]) for i in range(0, len(nodes), 3)], at // 3, h(mine)
    return nodes[0], proof, value


def brute(rows):
    groups = {}
    for r in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, leaf_of(r))):
        groups.setdefault(r[1], []).append(r)
    names = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    tops = [climb([leaf_of(r) for r in groups[s]], 0, "")[0] for s in names]
    out = []
    for k, s in enumerate(names):
        leaves = [leaf_of(r) for r in groups[s]]
        for i, r in enumerate(groups[s]):
            new = r
            if r[0] is not None and zlib.crc32(str(r[0]).encode()) % 2 == 0 and r[4] is not None:
                new = (*r[:4], r[4].replace("\n", ""))
            top, inner, folded = climb(leaves, i, leaf_of(new))
            root, outer, folded = climb(tops, k, folded)
            out.append((r[0], leaves[i], top, root, h(inner + outer), folded, folded == root))
    return out


def found(spark, rows, height):
    from tallyspark.llm.merkle import audit
    from tallyspark.session import stage_table
    docs = spark.createDataFrame([(*r, 1, "x") for r in rows], "doc_id long, source string, lang string, n_chars long, text string, pos int, g string")
    docs = stage_table(docs.repartition(3), "test-merkle")
    cut = F.when(F.crc32(F.col("doc_id").cast("string")) % 2 == 0, F.replace("text", F.lit("\n"), F.lit(""))).otherwise(F.col("text"))
    return [tuple(r) for r in audit(docs, {"text": cut}, height=height).collect()]


def by_key(rows):
    return sorted(rows, key=lambda r: (r[0] is not None, *map(str, r)))


def test_compression_equals_hashlib():
    from tallyspark.llm.merkle import raise_level
    raw = np.frombuffer(random.Random(3).randbytes(32 * 40), np.uint8).reshape(-1, 32)
    texts = [bytes(x).hex() for x in raw]
    _, tops = raise_level(raw, np.array([34, 1, 5]))
    want = [h(texts[i: min(i + 3, b)]) for a, b in ((0, 34), (34, 35), (35, 40)) for i in range(a, b, 3)]
    assert [bytes(x).hex() for x in tops] == want


def test_against_brute_force_on_many_shapes(spark):
    rng = random.Random(7)
    rows = []
    for k, n in enumerate([1, 2, 3, 4, 9, 10, 27, 28, 82, 250]):  # the blocks of height 3 hold 27 nodes
        rows += [(len(rows) + i * 7, f"s{k}", "en", i, "\n".join("ab"[: rng.randint(0, 2)] for _ in range(4))) for i in range(n)]
    rows += [(5000 + i, None, None, None, None) for i in range(5)] + [(6000 + i, "", "", 0, "") for i in range(4)]
    rows += [(6100, "é" * 3, "ü", 4, "line\n" * 20_000)]
    rng.shuffle(rows)
    assert by_key(found(spark, rows, 3)) == by_key(brute(rows))


def test_nulls_ties_and_repeated_rows(spark):
    rows = [(None, "a", "x", 1, "t\n"), (None, "a", "x", 1, "u"), (1, "a", "x", 1, "t\n"), (1, "a", "x", 1, "t\n"), (1, "a", None, 1, "t\n"), (2, None, "x", 1, None)]
    got, want = found(spark, rows, 1), brute(rows)
    assert {(r[0], r[1], r[2], r[3]) for r in got} == {(r[0], r[1], r[2], r[3]) for r in want}
    assert by_key(got) == by_key(want)


def test_one_group_one_row_and_empty_table(spark):
    assert found(spark, [(1, "a", "x", 1, "t\n")], 8) == brute([(1, "a", "x", 1, "t\n")])
    assert found(spark, [], 8) == []
