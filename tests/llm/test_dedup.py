"""Exact dedup, n-gram join and repeated strings against brute force, with edge cases."""

import hashlib
import random
import re

import numpy as np
import pytest

from .conftest import edge_pairs


def copies(rng, words, n):
    base = [" ".join(rng.choice(words) for _ in range(rng.randint(3, 80))) for _ in range(n)]
    out = []
    for t in base:
        out.append(t)
        for _ in range(rng.choice([0, 0, 1, 3])):
            w = t.split(" ")
            for _ in range(rng.randint(0, 4)):
                w[rng.randrange(len(w))] = rng.choice(words)
            out.append(" ".join(w))
    return [(i, t) for i, t in enumerate(out)]


@pytest.fixture(scope="module")
def near_pairs():
    rng = random.Random(5)
    return copies(rng, [f"w{i}" for i in range(300)], 60) + [(1000 + i, "The shared line of all these texts stands here, word for word, at the top.\n"
                                                             + " ".join(rng.choice("abcdefgh") * rng.randint(1, 9) for _ in range(12))) for i in range(40)]


def exact_brute(pairs):
    groups = {}
    for i, t in pairs:
        groups.setdefault(t or "", []).append(i)
    return {t: (max((i for i in g if i is not None), default=None), len(g)) for t, g in groups.items()}


def test_exact_report(docs_of):
    from tallyspark.llm.exact_dedup import dedup_report
    pairs = edge_pairs()
    want = exact_brute(pairs)
    got = dedup_report(docs_of(pairs), first_digit=2, growth=2, widest=4096).collect()
    by_digest = {hashlib.sha256(t.encode()).hexdigest(): v for t, v in want.items()}
    assert len(got) == len(pairs)
    assert all((r.keep_id, r.group_size) == by_digest[r.text_sha256] for r in got)
    assert sum(r.kept for r in got) == len(want)
    assert all(r.doc_id == r.keep_id for r in got if r.kept)


def test_exact_drop_keeps_columns_and_empty_table(docs_of):
    from tallyspark.llm.exact_dedup import dedup_report, drop_copies
    docs = docs_of(edge_pairs())
    kept = drop_copies(docs)
    assert kept.columns == docs.columns
    assert sorted((r.text or "") for r in kept.collect()) == sorted(exact_brute(edge_pairs()))
    assert dedup_report(docs_of([])).count() == 0


def join_brute(pairs):
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    sets = []
    for _, t in pairs:
        w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(lower))
        sets.append({tuple(w[i:i + 5]) for i in range(max(1, len(w) - 4))} if w else set())
    parent = list(range(len(pairs)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            if a and sets[j] and 100 * len(a & sets[j]) >= 80 * len(a | sets[j]):
                parent[root(i)] = root(j)
    least = {}
    for i, (d, _) in enumerate(pairs):
        least.setdefault(root(i), []).append(d)
    return sorted(((d, len(s), min((x for x in least[root(i)] if x is not None), default=None) if s else d)
                   for i, ((d, _), s) in enumerate(zip(pairs, sets))), key=str)


@pytest.mark.parametrize("which", ["near", "edge"])
def test_join_components(docs_of, near_pairs, which):
    from tallyspark.llm.ngram_join import link_components
    pairs = near_pairs if which == "near" else edge_pairs()
    got = link_components(docs_of(pairs)).select("doc_id", "n_shingles", "component_id").collect()
    assert sorted(map(tuple, got), key=str) == join_brute(pairs)


def test_join_crosses_components(docs_of):
    """Two texts that link no hub but each other, and a chain whose ends do not link."""
    from tallyspark.llm.ngram_join import link_components
    rng = random.Random(11)
    base = [f"t{i}" for i in range(100)]
    chain = []
    for k in range(12):
        chain.append((k + 1, " ".join(base)))
        for _ in range(2):
            base[rng.randrange(100)] = f"n{k}{rng.randrange(10 ** 6)}"
    rng.shuffle(chain)
    got = link_components(docs_of(chain)).select("doc_id", "n_shingles", "component_id").collect()
    assert sorted(map(tuple, got), key=str) == join_brute(chain)


def test_join_template_group(docs_of, monkeypatch):
    """One large group whose members have 2 to 20 % shingles of their own: few pairs link, some of them through further hubs."""
    from tallyspark.llm import ngram_join as J
    monkeypatch.setattr(J, "PAIRS_A_ROW", 0.01)
    monkeypatch.setattr(J, "HUBS", (2, 8))
    rng = random.Random(17)
    base = [f"t{i}" for i in range(120)]
    group = []
    for i in range(150):
        w = list(base)
        for _ in range(rng.randint(1, 5)):
            w[rng.randrange(120)] = f"own{i}x{rng.randrange(10 ** 6)}"
        group.append((i, " ".join(w)))
    got = J.link_components(docs_of(group)).select("doc_id", "n_shingles", "component_id").collect()
    assert sorted(map(tuple, got), key=str) == join_brute(group)


def test_join_turns_leave_shingles_of_few_pairs(docs_of, monkeypatch):
    """Lines that three texts have are not dealt out again in each turn that a large group needs."""
    from tallyspark.llm import ngram_join as J
    rng = random.Random(23)
    base, own = [f"t{i}" for i in range(100)], lambda n: [f"o{rng.randrange(10 ** 9)}" for _ in range(n)]
    group = []
    for i in range(60):
        w = list(base)
        for j in rng.sample(range(0, 100, 8), 4):
            w[j] = f"x{i}y{j}"
        group.append((i, " ".join(w)))
    for i in range(40):
        line = own(30)
        group += [(1000 + 3 * i + j, " ".join(line + own(8 + 4 * j))) for j in range(3)]
    seen, opens = [], J._open
    monkeypatch.setattr(J, "_open", lambda meeting, labels: (seen.append(meeting), opens(meeting, labels))[1])
    monkeypatch.setattr(J, "PAIRS_A_ROW", 3)
    monkeypatch.setattr(J, "HUBS", (2,))
    got = J.link_components(docs_of(group)).select("doc_id", "n_shingles", "component_id").collect()
    assert sorted(map(tuple, got), key=str) == join_brute(group)
    assert len(seen) > 1
    assert all(min(r[0] for r in m.groupBy("token").count().select("count").collect()) > 3 for m in seen[1:])


def test_join_drop(docs_of, near_pairs):
    from tallyspark.llm.ngram_join import drop_linked, link_components
    docs = docs_of(near_pairs + edge_pairs()[:3])
    kept = drop_linked(docs)
    assert kept.columns == docs.columns
    groups = {(c, n and 1) for _, n, c in join_brute(near_pairs)}
    assert kept.where("length(trim(text)) > 0").count() == len(groups)
    assert kept.where("text IS NULL OR text = ''").count() == 3
    assert link_components(docs_of([])).count() == 0


def test_components_of_a_path(spark):
    from tallyspark.llm.components import components
    edges = [(i, i + 1) for i in range(60)] + [(100, 101), (101, 102), (102, 100)]
    random.Random(3).shuffle(edges)
    got = {r.node: r.label for r in components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {**{i: 0 for i in range(1, 61)}, 101: 100, 102: 100}


def strings_brute(pairs, least):
    seen, out = {}, []
    key = lambda p: (p[0] is None, p[0] or 0)
    bodies = [(i, (t or "").encode()) for i, t in pairs]
    for i, b in bodies:
        for p in range(len(b) - least + 1):
            w = b[p:p + least]
            seen[w] = min(seen.get(w, (True, 1 << 63)), key((i, 0)))
    for i, b in bodies:
        gone = np.zeros(len(b), bool)
        for p in range(len(b) - least + 1):
            if seen[b[p:p + least]] < key((i, 0)):
                gone[p:p + least] = True
        kept = bytes(np.frombuffer(b, np.uint8)[~gone])
        runs = int((gone & ~np.append(False, gone[:-1])).sum()) if len(b) else 0
        out.append((i, len(b), int(gone.sum()), runs, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


@pytest.mark.parametrize("memory_rows", [1 << 21, 3])
def test_repeated_strings(docs_of, near_pairs, memory_rows):
    """Also with queues on disk."""
    from tallyspark.llm.suffix_dedup import remove_repeats
    pairs = near_pairs + [(d, t[:5000] if t else t) for d, t in edge_pairs()] + [(2000, "ab" * 300), (2001, "x" + "ba" * 200), (1999, "ab" * 40)]
    got = remove_repeats(docs_of(pairs), memory_rows=memory_rows).drop("kept").collect()
    assert sorted(map(tuple, got), key=str) == strings_brute(pairs, 50)


def test_repeated_strings_empty(docs_of):
    from tallyspark.llm.suffix_dedup import remove_repeats
    assert remove_repeats(docs_of([])).count() == 0


@pytest.mark.parametrize("on_disk", [False, True])
def test_induced_order(tmp_path, on_disk):
    from tallyspark.llm.suffix_dedup import InducedOrder
    rng = np.random.default_rng(4)
    rows = rng.integers(0, 3, (500, 12), dtype=np.uint8)
    sorter = InducedOrder(500, str(tmp_path) if on_disk else None, block=37)
    for j in range(11, -1, -1):
        sorter.step(np.ascontiguousarray(rows[:, j]))
        got = [bytes(rows[i, j:]) for i in sorter.order]
        assert got == sorted(got)
        for k in range(1, 500):
            same = next((m for m, (a, b) in enumerate(zip(got[k - 1], got[k])) if a != b), len(got[k]))
            assert sorter.prefix[k] == same
