"""Merge-dropout draws anew for every occurrence of a word."""

import numpy as np

MODEL = "/opt/tokenizers/piece_bpe_32k.model"


def words_of(coder, text, key):
    """Segmentations of the words of a text, in order."""
    from tallyspark.llm.merge_dropout import pieces
    table, out = pieces(MODEL).bytes, []
    for i in np.frombuffer(coder.encode(text, key), np.int32):
        if table[i].startswith(b" "):
            out.append([])
        out[-1].append(table[i])
    return [tuple(x) for x in out]


def test_a_word_is_drawn_anew_in_every_place_and_document():
    from tallyspark.llm.merge_dropout import Encoder
    coder = Encoder(MODEL, 7, 0.1)
    texts = [words_of(coder, " ".join(["international"] * 200), key) for key in range(20)]
    assert all(len(set(t)) > 5 for t in texts)
    assert len({x for t in texts for x in t}) > 20 and len({tuple(t) for t in texts}) == 20


def test_draws_have_the_rate_and_do_not_hang_on_what_is_kept():
    from tallyspark.llm import merge_dropout as m
    for rate in (0.1, 0.5, 0.37):
        bits = m.skip_bits(m.mix64(np.arange(20_000, dtype=np.uint64)), int(rate * 2 ** 64))
        share = [(bits >> np.uint64(k) & np.uint64(1)).mean() for k in range(64)]
        assert max(abs(s - rate) for s in share) < 0.02 and abs(np.mean(share) - rate) < 0.002
    text = " ".join(["the quick brown international organisation", "x" * 150, "überall ▁ token"] * 40)
    warm = m.Encoder(MODEL, 3, 0.2)
    for key in range(30):
        warm.encode(text, key)
    cold = m.Encoder(MODEL, 3, 0.2)
    assert warm.encode(text, 99) == cold.encode(text, 99) and warm.encode(text, 98) != warm.encode(text, 99)
    # the kept pieces are what a run of the agenda gives
    place, key = 0, m._mix(3 * 0x9E3779B97F4A7C15 + 99 & m.MASK)
    plain = []
    for place, w in enumerate(m.CHUNK.findall(" " + text)):
        k = m._mix(key + place * 0x9E3779B97F4A7C15 & m.MASK)
        plain += m.encode_word(w, warm.vocabulary, m.Draws(k, warm.skip_below))
    assert np.frombuffer(warm.encode(text, 99), np.int32).tolist() == plain


def slow_pieces(chunk, key, rate, seed_bits, vocabulary):
    """The agenda by plain scans: of all candidates that are not out, best rank, then leftmost; draws one by one."""
    mark, mask = "▁", (1 << 64) - 1

    def mixed(x):
        x = (x ^ (x >> 30)) * 0xBF58476D1CE4E5B9 & mask
        x = (x ^ (x >> 27)) * 0x94D049BB133111EB & mask
        return x ^ (x >> 31)

    def draw(n):
        at, bit = mixed(key + (n >> 6) & mask) if n >> 6 else key, 0
        for k, digit in enumerate(seed_bits, 1):
            one = mixed(at + k * 0x9E3779B97F4A7C15 & mask) >> (n & 63) & 1
            bit = bit | one if digit else bit & one
        return bit

    parts = [(mark, True) if c == " " else (c, c != mark) for c in chunk]  # a mark in the text never joins
    out, drawn = set(), 0
    while True:
        ranked = [(vocabulary.rank[a + b], i) for i, ((a, x), (b, y)) in enumerate(zip(parts, parts[1:]))
                  if x and y and a + b in vocabulary.rank and (i, a, b) not in out]
        if not ranked:
            break
        _, i = min(ranked)
        if rate:
            skip, drawn = draw(drawn), drawn + 1
            if skip:
                out.add((i, parts[i][0], parts[i + 1][0]))
                continue
        parts[i: i + 2] = [(parts[i][0] + parts[i + 1][0], True)]
        out = {(k - (k > i), a, b) for k, a, b in out if k not in (i - 1, i, i + 1)}
    ids = []
    for p, joins in parts:
        ids += [vocabulary.ids[p]] if joins and p in vocabulary.ids else [vocabulary.byte_ids[b] for b in p.encode()]
    return ids


def test_dropout_is_that_of_a_plain_agenda():
    import random

    import pyarrow as pa
    from tallyspark.llm import merge_dropout as m
    rng = random.Random(5)
    words = ["international", "the", "a", "x" * 45, "counterrevolutionaries", "überall", "▁mark▁", "naïve\ncafé", "日本語",
             "😀🎉", "\t", "", "", "aaaaaaaaaaaa", "organisation's", "0x7fffffffffff", "\u0000", "ab" * 20, "fgh" * 30]
    texts = [None, "", " ", "   ", "\n", " lead", "trail  "] + [" ".join(rng.choices(words, k=rng.randint(1, 40))) for _ in range(25)]
    keys = [rng.getrandbits(64) for _ in texts]
    for rate in (0.0, 0.1, 0.5, 0.97, 1.0):
        coder = m.Encoder(MODEL, 11, rate)
        ids, counts = coder.encode_column(pa.array(texts, pa.string()), np.array(keys, np.uint64))
        digits = m.digits_of(coder.skip_below)
        if rate == 1.0:
            assert not digits
            continue
        at = 0
        for text, key, n in zip(texts, keys, counts.tolist()):
            doc = m._mix(11 * 0x9E3779B97F4A7C15 + key & m.MASK)
            want = []
            for place, chunk in enumerate(m.CHUNK.findall(" " + text) if text else []):
                want += slow_pieces(chunk, m._mix(doc + place * 0x9E3779B97F4A7C15 & m.MASK), rate, digits, coder.vocabulary)
            assert ids[at: at + n].tolist() == want, (rate, text)
            assert m.decode_ids(want) == (text or "")
            at += n


def test_blocks_do_not_change_the_result(monkeypatch):
    import pyarrow as pa
    from tallyspark.llm import merge_dropout as m
    texts = pa.array([" ".join(f"word{i % 13} counterexample" for i in range(k)) for k in (0, 1, 50, 300)])
    keys = np.arange(4, dtype=np.uint64)
    coder = m.Encoder(MODEL, 2, 0.2)
    whole = coder.encode_column(texts, keys.copy())
    monkeypatch.setattr(m, "TOGETHER", 7)
    monkeypatch.setattr(m, "ABREAST", 3)
    parts = coder.encode_column(texts, keys.copy())
    assert all((a == b).all() for a, b in zip(whole, parts))
