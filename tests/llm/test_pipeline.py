"""The corpus pipeline on small tables against a brute-force version of its stages."""

import random
import re

import pytest

TERMS = ["idiot", "moron", "scum"]


def shingles(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", text)
    return {tuple(w[i:i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    rng = random.Random(12)
    words = ["".join(rng.choice("abcdeinorst") for _ in range(rng.randint(3, 9))) for _ in range(600)]
    say = lambda n: " ".join(rng.choice(words) for _ in range(n))
    items = [(i, say(30)) for i in range(5)]
    texts, toxic, leaked = {}, set(), set()
    for i in range(0, 300):
        t = say(rng.randint(20, 60))
        if i % 7 == 0:
            w = t.split(" ")
            w[5], w[11] = rng.choice(TERMS), rng.choice(TERMS)
            t, _ = " ".join(w), toxic.add(i)
        elif i % 11 == 0:
            t = f"{say(10)} {rng.choice(items)[1]} {say(10)}"
            leaked.add(i)
        texts[i] = t
    for i in range(300, 360):  # copies, and copies but for the last word
        source = rng.randrange(300)
        texts[i] = texts[source] if i % 2 else texts[source].rsplit(" ", 1)[0] + " altered"
        (toxic.add(i) if source in toxic else leaked.add(i) if source in leaked else None)
    texts[400], texts[401], texts[402] = None, "", "   "
    folder = str(tmp_path_factory.mktemp("sf"))
    docs = [(i, t, "en", "s", len(t or "")) for i, t in texts.items()]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(i, 1, int(i in toxic)) for i in texts], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return folder, texts, toxic, leaked


def test_pipeline(spark, tables):
    import corpus_pipeline
    from tallyspark.llm.merge_dropout import decode_ids
    folder, texts, toxic, leaked = tables
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "exact dedup", "n-gram join", "decontamination", "encoding"]
    left = {i: t for i, t in texts.items() if i not in toxic}
    largest = {}
    for i, t in left.items():
        largest[t or ""] = max(i, largest.get(t or "", -1))
    left = {i: left[i] for i in largest.values()}
    kept = {}
    for i in sorted(left):  # links here are stars around one text: the smallest id of each group stays
        s = shingles(left[i] or "")
        if not any(s and 100 * len(s & k) >= 80 * len(s | k) for k in kept.values()):
            kept[i] = s
    want = set(kept) - leaked
    got = corpus_pipeline.run(spark, folder).collect()
    assert {r.doc_id for r in got} == want
    assert all(decode_ids(r.ids) == (texts[r.doc_id] or "") for r in got)
    assert set(got[0].asDict()) == {"doc_id", "text", "lang", "source", "n_chars", "ids"}


def test_stages_on_an_empty_table(spark, tables):
    import corpus_pipeline
    from tallyspark.session import stage_table, table
    folder = tables[0]
    docs = stage_table(table(spark, folder, "documents").limit(0), "none")
    for _, stage in corpus_pipeline.STAGES:
        docs = stage_table(stage(spark, docs, folder), "none")
        assert docs.count() == 0
