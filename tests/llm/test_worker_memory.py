"""What a Python worker holds: little beside the tables of fixed size, and nothing of a task that has ended."""

import random
import tracemalloc

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F


def test_shingles_and_counts_take_little_memory():
    from tallyspark.llm import ngram_join as J
    from tallyspark.llm.common import slices, utf8
    rng = random.Random(3)
    words = ["".join(rng.choice("abcdefgh") for _ in range(5)) for _ in range(5000)]
    batch = pa.record_batch([pa.array([" ".join(rng.choices(words, k=2000)) for _ in range(400)])], ["text"])
    J._powers.clear()
    tracemalloc.start()
    counts = J.BucketCounts()
    for part in slices(iter([batch]), "text", J.SLICE_BYTES):
        for s in J.shingle_sets(*utf8(part.column("text"))):
            counts.add(s)
    got = counts.total()
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 80e6
    want = np.zeros(len(got), np.uint32)
    for s in J.shingle_sets(*utf8(batch.column("text"))):
        np.add.at(want, J.bucket(s), 1)
    assert (got == want).all()


def test_prefixes_of_equal_sets_across_slices(spark, monkeypatch):
    """A task gives the prefix of equal sets once, be they in other slices; all rows have their component."""
    from tallyspark.llm import ngram_join as J
    text = "one two three four five six seven eight nine ten " * 3
    docs = spark.createDataFrame([(i, text if i % 2 else f"{text} w{i} x{i} y{i} z{i} a{i} b{i} c{i} d{i} e{i} f{i}") for i in range(40)], "doc_id long, text string").coalesce(1)
    monkeypatch.setattr(J, "SLICE_BYTES", 500)
    counts = np.ones(1 << J.BUCKET_BITS, np.uint32)
    given = J.prefixes(J._rows(docs, "text", "doc_id"), counts, J.WORDS, J.PERCENT).select("row").distinct().count()
    assert given == 21
    found = {r["doc_id"]: r["component_id"] for r in J.link_components(docs).collect()}
    assert found == {i: 1 if i % 2 else i for i in range(40)}


def test_no_lexicon_outlives_its_task(spark):
    from tallyspark.llm.toxicity import toxic_cell
    docs = spark.range(0, 200, 1, 8).select(F.concat_ws(" ", F.lit("you idiot"), F.col("id").cast("string")).alias("text"))
    for terms in (["first"], ["second"]):
        assert {r[0] for r in docs.select(toxic_cell(F.col("text"), terms)).collect()} != {0}

    def left(batches):
        import gc
        for _ in batches:
            gc.collect()
            yield pa.record_batch([pa.array([sum(type(x).__name__ == "Lexicon" for x in gc.get_objects())], pa.int64())], ["n"])

    assert spark.range(0, 64, 1, 8).mapInArrow(left, "n long").agg(F.max("n")).first()[0] == 0
