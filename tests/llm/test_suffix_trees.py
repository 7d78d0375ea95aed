"""Repeated word sequences against brute force."""

import hashlib
import random
import re
from collections import Counter

import numpy as np
import pytest

from .conftest import edge_pairs

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(pairs, least):
    texts = [WORD.findall(t or "") for _, t in pairs]
    seen = Counter(tuple(w[i: i + least]) for w in texts for i in range(len(w) - least + 1))
    out = []
    for (doc_id, _), w in zip(pairs, texts):
        gone = set()
        for i in range(len(w) - least + 1):
            if seen[tuple(w[i: i + least])] > 1:
                gone.update(range(i, i + least))
        kept = " ".join(x for i, x in enumerate(w) if i not in gone)
        out.append((doc_id, len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return sorted(out, key=str)


def found(docs, **options):
    from tallyspark.llm.suffix_trees import remove_repeats
    return sorted(((r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in remove_repeats(docs, **options).collect()), key=str)


def passages(rng):
    """Texts of few words with shared passages, each in other surroundings, and repeats within a text."""
    words = [f"w{i}" for i in range(60)] + ["é" * 5, "long" * 40]
    shared = [[rng.choice(words) for _ in range(rng.randint(10, 40))] for _ in range(4)]
    pairs = []
    for i in range(120):
        t = [rng.choice(words) for _ in range(rng.randint(0, 30))]
        for _ in range(rng.randint(0, 3)):
            p = rng.choice(shared)
            a = rng.randint(0, 5)
            t += p[a: len(p) - rng.randint(0, 5)] + [rng.choice(words) for _ in range(rng.randint(0, 8))]
        pairs.append((i, rng.choice([" ", "\n", " \t "]).join(t) + rng.choice(["", " ", "\n"])))
    return pairs + [(500 + i, "a b a b a b a b a b a b a b c") for i in range(2)] + [(600, "x " * 300)] + [(601, "y " * 11)]


@pytest.mark.parametrize("group_runs", [20_000, 3])  # 3: nearly all groups are split by longer prefixes
def test_against_brute_force(docs_of, group_runs):
    pairs = passages(random.Random(4))
    assert found(docs_of(pairs), least=12, gram=4, group_runs=group_runs) == brute(pairs, 12)


def test_edge_cases_and_empty_table(docs_of):
    pairs = edge_pairs()
    assert found(docs_of(pairs)) == brute(pairs, 35)
    assert found(docs_of([])) == []


def test_one_passage_in_all_documents_with_other_surroundings(docs_of):
    rng = random.Random(9)
    passage = " ".join(f"p{i}" for i in range(50))
    pairs = [(i, f"{rng.random()} {rng.random()} " + passage + f" {rng.random()}") for i in range(400)]
    assert found(docs_of(pairs), group_runs=50) == brute(pairs, 35)


def test_subtree_prefixes():
    from tallyspark.llm.suffix_trees import SubTree
    rng = random.Random(2)
    codes = [rng.randint(0, 2) for _ in range(200)] + [90] + [rng.randint(0, 2) for _ in range(50)] + [91]
    tree = SubTree(np.array(codes), 5)
    got = tree.leaves_below_deep_nodes()
    seen = Counter(tuple(codes[i: i + 5]) for i in range(len(codes) - 4))
    assert [bool(x) for x in got] == [i < len(codes) - 4 and seen[tuple(codes[i: i + 5])] > 1 for i in range(len(codes))]
    a, b = tree.order[:-1], tree.order[1:]
    for i, j, c in zip(a.tolist(), b.tolist(), tree.common.tolist()):
        n = next(k for k in range(300) if i + k >= len(codes) or j + k >= len(codes) or codes[i + k] != codes[j + k])
        assert c == n or (n > 8 and c >= 8)
