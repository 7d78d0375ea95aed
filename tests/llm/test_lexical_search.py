"""Ranked search against a plain scoring of all documents."""

import math
import random
import re
from collections import Counter

import numpy as np
import pytest

from .conftest import edge_pairs

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
LOW = {ord(c): c.lower() for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"}


def terms(text):
    return TERM.findall((text or "").translate(LOW))


def brute(pairs, items, top):
    docs = [(i, Counter(terms(t))) for i, t in pairs]
    docs = [(i, c) for i, c in docs if c]
    n, length = len(docs), sum(sum(c.values()) for _, c in docs)
    df = Counter(t for _, c in docs for t in c)
    out = []
    for item_id, text in items:
        scored = []
        for i, c in docs:
            m = 75 + 25 * sum(c.values()) * n // length
            score = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * (10 ** 9 * c[t] // (1000 * c[t] + 12 * m)) for t in terms(text) if c[t])
            if score > 0:
                scored.append((-score, i is None, i or 0))
        out += [(item_id, k + 1, None if none else i, -s) for k, (s, none, i) in enumerate(sorted(scored)[:top])]
    return sorted(out, key=str)


def found(spark, docs, items, **options):
    from tallyspark.llm.lexical_search import search
    from tallyspark.session import stage_table
    queries = stage_table(spark.createDataFrame([(i, t, 1, "x") for i, t in items], "item_id long, text string, term int, shard string"), "test-items")
    return sorted((tuple(r) for r in search(docs, queries, **options).collect()), key=str)


def zipf_pairs(rng, n):
    words = [f"w{i}" for i in range(400)] + ["ÉCOLE", "naïve", "Über"]
    return [(i, " ".join(rng.choice(words[: rng.choice([4, 30, 403])]).title() + rng.choice(["", ",", "."]) for _ in range(rng.randint(0, 60)))) for i in range(n)]


@pytest.mark.parametrize("shard_bytes, block_items, first_depth", [(16 << 20, 256, 64), (4000, 3, 1)])
def test_against_brute_force(spark, docs_of, shard_bytes, block_items, first_depth):
    rng = random.Random(3)
    pairs = zipf_pairs(rng, 600)
    pairs += [(1000 + i, pairs[5][1]) for i in range(40)]  # more copies than places: ties by id
    items = [(i, t) for i, t in zipf_pairs(rng, 8)] + [(20, None), (21, ""), (22, "absent"), (23, pairs[5][1]), (24, "w1 w1 w1 W1 w300"), (24, "w2")]
    got = found(spark, docs_of(pairs), items, shard_bytes=shard_bytes, block_items=block_items, first_depth=first_depth)
    assert got == brute(pairs, items, 20)


def test_edge_cases_and_empty_tables(spark, docs_of):
    items = [(1, "same word3 word4 😀 text"), (None, "here a")]
    assert found(spark, docs_of(edge_pairs()), items) == brute(edge_pairs(), items, 20)
    assert found(spark, docs_of([]), items) == []
    assert found(spark, docs_of(edge_pairs()), []) == []


def test_reading_stops_before_the_lists_end():
    """The bounds alone decide: one document has all terms, the rest of the lists cannot reach it."""
    from tallyspark.llm.lexical_search import no_random_access

    class Watched(np.ndarray):
        furthest = 0

        def __getitem__(self, k):
            if isinstance(k, slice) and k.stop:
                Watched.furthest = max(Watched.furthest, min(k.stop, len(self)))
            return super().__getitem__(k)

    rng = np.random.default_rng(1)
    lists = []
    for _ in range(3):
        docs = np.append(7, np.setdiff1d(rng.permutation(5000), 7)).astype(np.int32)
        impact = np.sort(np.append(900_000, rng.integers(1, 1000, len(docs) - 1)))[::-1].copy()
        lists.append((docs.view(Watched), impact, 3))
    got, score = no_random_access(lists, np.arange(5000), 1)
    assert (got.tolist(), score.tolist()) == ([7], [3 * 3 * 900_000])
    assert Watched.furthest < 5000
