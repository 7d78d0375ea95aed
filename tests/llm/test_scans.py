"""Scans, filters, tokenisation and archives against brute force, round trips and held-out labels."""

import gzip
import hashlib
import random
import re
import uuid
import zlib

import pytest

from .conftest import edge_pairs

KEY = "Zk9vQ2xT7mWp4RbN1sYh8dLc"


def secret_brute(text):
    text = text or ""
    word = "|".join("".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in w) for w in ("password", "passwd", "secret", "token"))
    assign = rf"({word}|[aA][pP][iI]_?[kK][eE][yY])[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)"
    spans = [(m.start(), 0, m.end()) for m in re.finditer(assign, text) if len(m[2]) >= 6]
    spans += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    spans += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 24]
    return ",".join(f"{('assign', 'access', 'hex')[k]}:{s}:{e}" for s, k, e in sorted(spans))


def test_secrets(docs_of):
    from tallyspark.llm.secret_scan import scan_secrets
    rng = random.Random(1)
    bits = ["PassWord = abc123", "token=token:abcdefgh", 'api_key: "Zz+/9_=-."', "AKIA" + "A1" * 8, "AKIA123", "0123456789abcdef" * 2, "é ß ", " ",
            "secret:x", "ABCDEF", "deadbeef" * 3 + "g", "toKen\n=abcdef", "\u212aey", "passwd'='hunter22", "überall "]
    pairs = [(i, "".join(rng.choice(bits) for _ in range(rng.randint(0, 12)))) for i in range(300)] + edge_pairs()
    pairs.append((5000, f"The signature follows: {KEY} and more words. The credential is administrator1administrator2"))
    got = scan_secrets(docs_of(pairs)).collect()
    assert len(got) == len(pairs)
    want = sorted(((i, hashlib.sha256(secret_brute(t).encode()).hexdigest()) for i, t in pairs), key=str)
    assert sorted(((r.doc_id, r.base_sha256) for r in got), key=str) == want
    base = sorted(((i, secret_brute(t)) for i, t in pairs), key=str)
    assert sorted(((r.doc_id, ",".join(s for s in r.spans.split(",") if s and not s.startswith("novel"))) for r in got), key=str) == base
    assert {r.doc_id: r.spans for r in got}[5000] == f"novel:23:{23 + len(KEY)}"
    for r in got:  # added spans lie apart from the base ones
        spans = sorted(zip(r.starts, r.ends, r.kinds))
        assert all(a[1] <= b[0] for a, b in zip(spans, spans[1:]) if "novel" in (a[2], b[2]))
    assert scan_secrets(docs_of([])).count() == 0


def test_marginal_bytes_tell_keys_from_words():
    from tallyspark.llm.secret_scan import marginal_bytes
    assert marginal_bytes(KEY.encode(), b"") >= 0.85 * len(KEY)
    assert marginal_bytes(KEY.encode(), KEY.encode() * 2) < 0.5 * len(KEY)
    assert marginal_bytes(b"public_key_password_2", b"") < 0.85 * 21


def edit(rng, text, ratio):
    s = list(text)
    for _ in range(int(ratio * len(s))):
        p, op = rng.randrange(len(s)), rng.randrange(3)
        if op == 0:
            s[p] = rng.choice("abcdefgh ")
        elif op == 1:
            del s[p]
        else:
            s.insert(p, rng.choice("abcdefgh "))
    return "".join(s)


def distance(a, b):
    """Least edits of a against any passage of b."""
    row = [0] * (len(b) + 1)
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return min(row)


def test_decontamination(spark, docs_of):
    from tallyspark.llm.decontaminate import best_passage, drop_leaks, find_leaks
    rng = random.Random(8)
    words = ["".join(rng.choice("abcdeinorst") for _ in range(rng.randint(2, 9))) for _ in range(400)]
    say = lambda n: " ".join(rng.choice(words) for _ in range(n))
    items = [(i, say(rng.choice([4, 20, 40, 60]))) for i in range(40)] + [(90, None), (91, ""), (92, "tiny"), (None, say(30))]
    pairs, want = [], set()
    for k in range(120):
        i, t = items[k % 40]
        hold = k % 3 > 0
        pairs.append((k, f"{say(rng.randint(0, 60))} {edit(rng, t, 0.05) if k % 3 == 2 else t if hold else ''} {say(rng.randint(0, 60))}"))
        if hold:
            want.add((k, i))
    docs = docs_of(pairs + [(None, items[1][1]), (500, None), (501, "")])
    table = spark.createDataFrame(items, "item_id long, text string")
    got = find_leaks(docs, table).collect()
    texts, known = dict(pairs), dict(items)
    for r in got:
        if r.doc_id is not None and r.item_id is not None:
            item = known[r.item_id].lower()
            assert r.edits <= 0.1 * len(item)
            assert distance(item, texts[r.doc_id].lower()) <= r.edits
            assert distance(item, texts[r.doc_id][r.start:r.end].lower()) <= r.edits
    found = {(r.doc_id, r.item_id) for r in got}
    assert {w for w in want if w[0] % 3 == 1} <= found  # verbatim: all
    edited = [w for w in want if w[0] % 3 == 2]
    assert sum(w in found for w in edited) >= 0.9 * len(edited)
    assert not any(d % 3 == 0 and distance(known[i], texts[d]) > 0.1 * len(known[i]) for d, i in found if d is not None and i is not None)
    assert (None, 1) in found
    kept = drop_leaks(docs, table)
    assert kept.columns == docs.columns
    assert {r.doc_id for r in kept.collect()} == {d for d, _ in pairs + [(None, 0), (500, 0), (501, 0)]} - {d for d, _ in found}
    assert find_leaks(docs, table.limit(0)).count() == 0 and find_leaks(docs_of([]), table).count() == 0
    assert best_passage(b"abcdefghij", b"xxabcdXfghijyy", 2, 1)[0] == 1


@pytest.mark.parametrize("ratio", [0.05, 0.1])
def test_recall_of_edited_items_by_size(ratio):
    """Up to the last edit that is accepted, for short items and long ones."""
    import numpy as np
    from tallyspark.llm.decontaminate import Index, find_items
    rng = random.Random(21)
    words = ["".join(rng.choice("abcdeinorst") for _ in range(rng.randint(2, 9))) for _ in range(400)]
    say = lambda size: " ".join(rng.choice(words) for _ in range(size // 3 + 2))[:size]
    for size in (16, 64, 80, 100, 140, 200):
        items = [(i, say(size).encode()) for i in range(150)]
        index, hits = Index(items, 0.1, 0.1, 0.98), 0
        for i, t in items:
            body = np.frombuffer(f"{say(100)} {edit(rng, t.decode(), ratio)} {say(100)}".encode(), np.uint8)
            hits += i in {found[1] for found in find_items(index, body, np.array([0]), np.array([len(body)]))}
        assert hits >= 0.95 * 150, (size, hits)


MODEL = "/opt/tokenizers/piece_bpe_32k.model"


def test_encoding_without_dropout_is_the_library():
    import sentencepiece
    from tallyspark.llm.merge_dropout import Encoder
    import numpy as np
    sp = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    coder = Encoder(MODEL, 1, 0.0)
    for t in ["Hello  world\n x", " a", "x ", "\tq\u0000\U0001F600é", "ﬁ２", " ", "naïve überlänge", "a" * 300]:
        assert np.frombuffer(coder.encode(t, 0), np.int32).tolist() == sp.encode(t)


def test_agendas_agree_and_seeds_vary():
    from tallyspark.llm import merge_dropout as m
    vocabulary, rng = m.pieces(MODEL), random.Random(2)
    below, other = int(0.2 * 2 ** 64), 0
    for _ in range(2000):
        w = "".join(rng.choice("theandofig tioner") for _ in range(rng.randint(1, 24))).replace(" ", "")
        a, b = m.merge_scan(list(w), vocabulary.rank, 99, below), m.merge_heap(list(w), vocabulary.rank, 99, below)
        assert a == b and "".join(a) == w
        other += m.merge_scan(list(w), vocabulary.rank, 100, below) != a
    assert other > 500


def test_round_trip(docs_of):
    from pyspark.sql import functions as F
    from tallyspark.llm.merge_dropout import decode_documents, encode_documents
    docs = docs_of(edge_pairs() + [(20, "a▁b ▁▁ c"), (21, "x" * 5000)])
    out = encode_documents(docs, seed=3, dropout=0.3)
    assert out.columns == [*docs.columns, "ids"]
    again = encode_documents(docs, seed=3, dropout=0.3)
    assert sorted((str(r.doc_id), str(r.text), r.ids) for r in out.collect()) == sorted((str(r.doc_id), str(r.text), r.ids) for r in again.collect())
    back = decode_documents(out.withColumn("pieces", F.col("ids")), "pieces")
    assert back.where("decoded <> coalesce(text, '')").count() == 0
    assert back.count() == docs.count() and encode_documents(docs_of([])).count() == 0


def test_warc(spark, tmp_path):
    from tallyspark.llm import warc
    from tallyspark.session import batch_rows, stage_table
    big, html = "<p>" + "x" * 200, "<html>\r\n\r\n WARC/1.1\r\nContent-Length: 3\r\n\r\n é " + "y" * 120
    pages = [(3, "http://a/", big), (1, "http://b/\r\nX: y", big), (1, "http://b/", big), (None, None, big), (7, "u", "short"), (8, "u", "short"),
             (9, None, None), (10, "u", html), (11, "u", html), (12, "u", ""), (13, "v", "z" * 300_000)]
    table = stage_table(spark.createDataFrame([(*p, 1, "x") for p in pages], "page_id long, url string, html string, record int, digest string"), "pages")
    got = warc.archive_table(table, str(tmp_path / "w"), file_bytes=400).collect()
    size = {hashlib.sha256(h.encode()).hexdigest(): len(h.encode()) for h in {p[2] or "" for p in pages}}
    assert all(size[r.payload_digest] == r.payload_bytes for r in got)
    assert sorted((str(r.key), r.record_type, str(r.refers_to)) for r in got) == sorted([
        ("3", "revisit", "1"), ("1", "response", "None"), ("1", "revisit", "1"), ("None", "revisit", "1"), ("7", "response", "None"),
        ("8", "response", "None"), ("9", "response", "None"), ("10", "response", "None"), ("11", "revisit", "10"), ("12", "response", "None"),
        ("13", "response", "None")])
    with batch_rows(spark, 1):
        records = warc.read_archives(spark, str(tmp_path / "w")).collect()
    by_key = {r.key: r for r in records if r.type == "response"}
    assert bytes(by_key["10"].payload).decode() == html and by_key["10"].digest == hashlib.sha256(html.encode()).hexdigest()
    assert all(bytes(r.payload) == b"" for r in records if r.type == "revisit")
    ids = [r.record_id for r in records]
    assert len(set(ids)) == len(pages) and all(str(uuid.UUID(i.removeprefix("urn:uuid:"))) == i.removeprefix("urn:uuid:") for i in ids)
    members, files = 0, [f.read_bytes() for f in (tmp_path / "w").glob("part-*")]
    for content in files:
        gzip.decompress(content)
        while content:  # each member is a whole record, the last one is empty
            reader = zlib.decompressobj(31)
            record, content = reader.decompress(content), reader.unused_data
            assert reader.eof and (record.startswith(b"WARC/1.1") and record.endswith(b"\r\n\r\n") if content else record == b"")
            members += bool(record)
    assert members == len(pages) and len(files) > 2
    warc.archive_table(table, str(tmp_path / "again"), file_bytes=1 << 20).count()
    with batch_rows(spark, 1):
        again = {r.record_id for r in warc.read_archives(spark, str(tmp_path / "again")).collect()}
    assert not again & set(ids)
    assert warc.archive_table(table.limit(0), str(tmp_path / "none")).count() == 0


def test_licenses(docs_of):
    from tallyspark.llm.license_scan import scan_licenses
    wrapped = ("Permission is hereby granted, free of charge, to any person obtaining a copy\nof this software and associated documentation files "
               "(the \"Software\"), to deal\nin the Software without restriction, including without limitation the rights\nto use, copy, modify, merge, "
               "publish, distribute, sublicense, and/or sell\ncopies of the Software, and to permit persons to whom the Software is\nfurnished to do so, "
               "subject to the following conditions:\n\nThe above copyright notice and this permission notice shall be included in all\ncopies or "
               "substantial portions of the Software.")
    pairs = [(1, "Some text\nReleased under the MIT License.\nmore"), (2, "x. Licensed under the Apache License, Version 2.0. y"),
             (3, wrapped), (4, "This work is licensed under the GNU General Public License, version 3.\nLicensed under CC BY-NC 4.0."),
             (5, "He wrote that MIT is a school"), (None, "All rights reserved.")] + edge_pairs()
    got = {(r.doc_id, r.license) for r in scan_licenses(docs_of(pairs)).collect()}
    assert got == {(1, "MIT"), (2, "Apache-2.0"), (3, "MIT"), (4, "GPL-3.0-only"), (4, "CC-BY-NC-4.0"), (None, "proprietary")}
    assert scan_licenses(docs_of([])).count() == 0


def levenshtein(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def test_automaton_is_edit_distance():
    from tallyspark.llm.toxicity import FUZZY_LENGTH, LEXICON, TermAutomaton
    automaton, rng = TermAutomaton(LEXICON), random.Random(6)
    for _ in range(4000):
        t = edit(rng, rng.choice(LEXICON), rng.choice([0, 0.1, 0.2, 0.4])).replace(" ", "é")
        fits = [d for term in LEXICON if (d := levenshtein(t, term)) <= (len(term) >= FUZZY_LENGTH)]
        assert automaton.edits(t) == min(fits, default=-1)


def test_toxicity(spark, docs_of):
    from tallyspark.llm.toxicity import LEXICON, Lexicon, drop_toxic, hit_counts, score_documents
    from tallyspark.session import stage_table
    lexicon = Lexicon(tuple(LEXICON), ("zorgling",))
    assert hit_counts("You are an IDIOT, a st0pid zorgling. He said \"what a moron\".", lexicon) == (1, 1, 1, 0, 1, 3)
    rng = random.Random(4)
    words = [f"word{i}" for i in range(500)]
    pairs, labels = [], []
    for i in range(600):
        t = [rng.choice(words) for _ in range(40)]
        bad = i % 10 == 0
        if bad:
            t[7] = rng.choice(["idiot", "moron", "disgustng", "grubnik"])
        pairs.append((i, " ".join(t)))
        labels.append((i, int(bad)))
    pairs += edge_pairs()[:3] + [(None, None)]
    stage = lambda df: stage_table(df, "cells")
    known = spark.createDataFrame(labels + [(7000, None), (None, 1)], "doc_id long, toxic int")
    docs = docs_of(pairs)
    got = score_documents(docs, known, stage).collect()
    assert len(got) == len(pairs) and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in got)
    truth = dict(labels)
    held = [r for r in got if r.held_out and r.doc_id >= 10]
    assert sum(r.predicted == truth[r.doc_id] for r in held) >= 0.97 * len(held)
    kept = drop_toxic(docs, known, stage)
    assert kept.columns == docs.columns and kept.count() == len(pairs) - sum(r.predicted for r in got)
    assert score_documents(docs, known.limit(0), stage).where("score < 0 OR score > 1").count() == 0
    assert score_documents(docs_of([]), known, stage).count() == 0


def url_brute(url, rules):
    host = path = ""
    if url is not None and "://" in url:
        rest = url.split("://", 1)[1]
        m = re.match(r"([^/?#]*)([^?#]*)", rest)
        host, path = re.sub("[A-Z]", lambda c: c[0].lower(), m[1]), m[2]
    fits = [(len(h) + len(p), len(h), h + p, v) for h, p, v in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
    best = max(fits, default=(0, 0, None, "allow"))
    return host, path, best[2], best[3]


@pytest.mark.parametrize("salts", [1, 7, 60])
def test_url_rules(spark, salts):
    from tallyspark.llm.url_rules import filter_urls
    rng = random.Random(9)
    hosts = ["org", "example.org", "a.example.org", "b.a.example.org", "com", "x.com", "EXAMPLE.Org", "ample.org", "", "org.", "é.org"]
    paths = ["", "/", "/en", "/en/", "/en/1", "/en/12", "/es/", "/es", "/en/1?q", "#x", "/\U0010FFFF", "/en/\U0010FFFF"]
    rules = [("org", "/", "allow"), ("org", "", "block"), ("example.org", "/en", "block"), ("example.org", "/en/1", "allow"), ("com", "/e", "block"),
             ("a.example.org", "/en/", "block"), ("example.org", "/en", "block"), ("x.com", "/\U0010FFFF", "block"), ("x.com", "/", "allow")]
    urls = [f"http://{rng.choice(hosts)}{rng.choice(paths)}" for _ in range(400)] + [None, "", "nothing", "http://", "a://b://c"] + ["http://x.com/e"] * 50
    df = spark.createDataFrame([(i % 300, u, "z", 1) for i, u in enumerate(urls)], "page_id int, url string, rhost string, found int")
    got = filter_urls(df, spark.createDataFrame(rules, "host string, path string, verdict string"), salts=salts).collect()
    want = sorted((i % 300, str(u), *map(str, url_brute(u, rules))) for i, u in enumerate(urls))
    assert sorted((r.page_id, str(r.url), r.host, r.path, str(r.rule), r.verdict) for r in got) == want
    empty = spark.createDataFrame([], "host string, path string, verdict string")
    assert {r.verdict for r in filter_urls(df, empty).collect()} == {"allow"} and filter_urls(df.limit(0), empty).count() == 0
