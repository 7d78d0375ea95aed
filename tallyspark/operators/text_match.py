"""Which of many probe strings occur in which texts: Aho-Corasick automata over partitioned probes.

The anchor of a probe is its first 1, 2, 3, 4, 8, 32 or 128 characters, whichever is the longest that fits.  Anchors
deal the probes into buckets; a bucket with more than ``PROBES`` of them is cut into chunks, and each chunk
becomes one automaton in one task.  A text sends to a bucket only its pieces that begin with an anchor of the
bucket and reach as far as the longest probe with an anchor of that length; pieces that overlap are joined.  So
a position of a text is looked at once per anchor length, and short probes (a single character, say) open
only pieces of their own length.  The automaton reads a piece once, however many probes it holds.

Most probes occur nowhere: those whose anchor is in no text go first, by a join of the anchors of both sides.
Known anchors are a bitmap of a fixed size: a full one lets more pieces through, no fewer.  A bucket that many texts
reach is spread over salts, each with a copy of the bucket's (bounded) probes.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from ..session import batch_rows, stage_table

ANCHORS = (1, 2, 3, 4, 8, 32, 128)
PROBES, PIECE_CHARS, SLICE_CHARS = 50_000, 8 << 20, 1 << 20
SLOT_BITS, BITMAP = 22, 32768  # positions of one of Spark's bitmaps
_ODD = np.uint64(0x9E3779B97F4A7C15)


def _codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)


def _anchor_hashes(codes: np.ndarray, length: int) -> np.ndarray:
    """A hash of the ``length`` characters from each place on."""
    n = len(codes) - length + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    return _hashed((codes[j: j + n] for j in range(length)), n)


def _hashed(characters: Iterable[np.ndarray], n: int) -> np.ndarray:
    """``n`` hashes of the first characters, the second ones, and so on."""
    out = np.zeros(n, np.uint64)
    for codes in characters:
        out *= _ODD
        out += codes + np.uint64(1)
    out ^= out >> np.uint64(31)
    out *= _ODD
    return out ^ (out >> np.uint64(29))


def _head_hashes(texts: pa.Array, length: int) -> np.ndarray:
    """A hash of the first ``length`` characters of each text (none is shorter)."""
    heads = pc.utf8_slice_codeunits(texts, 0, length)
    ends = np.frombuffer(heads.buffers()[1], np.int64 if pa.types.is_large_string(heads.type) else np.int32)[heads.offset:][:len(heads) + 1]
    data = heads.buffers()[2].to_pybytes()[ends[0]: ends[-1]]
    codes = np.frombuffer(data, np.uint8) if len(data) == length * len(texts) else _codes(data.decode())
    table = codes.reshape(len(texts), length)
    return _hashed((table[:, j].astype(np.uint64) for j in range(length)), len(texts))


def _slot(hashes: np.ndarray) -> np.ndarray:
    return (hashes >> np.uint64(64 - SLOT_BITS)).astype(np.int64)


def _number(hashes: np.ndarray) -> np.ndarray:
    """A hash as one of Spark's (signed) numbers, not negative."""
    return (hashes >> np.uint64(1)).astype(np.int64)


def with_anchors(probes: DataFrame) -> DataFrame:
    """``probes`` (with ``probe``, at least one character) and ``kind`` (number of the anchor length), ``slot, anchor``."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column("probe")
            kind = np.searchsorted(ANCHORS, pc.utf8_length(texts).to_numpy(zero_copy_only=False), "right") - 1
            first = np.zeros(len(texts), np.uint64)
            for k in np.unique(kind).tolist():
                at = np.flatnonzero(kind == k)
                first[at] = _head_hashes(texts.take(pa.array(at)), ANCHORS[k])
            yield pa.record_batch([*batch.columns, pa.array(kind.astype(np.int32)), pa.array(_slot(first)), pa.array(_number(first))],
                                  [*batch.schema.names, "kind", "slot", "anchor"])

    schema = StructType([*probes.schema.fields, *StructType.fromDDL("kind int, slot long, anchor long").fields])
    return probes.mapInArrow(run, schema)


def _known(probes: DataFrame) -> Broadcast:
    """By anchor length the bitmap of the probes' anchors and the length of the longest probe."""
    by_kind = F.expr(f"slot div {BITMAP}").alias("part")
    known = probes.groupBy("kind", by_kind).agg(F.bitmap_construct_agg(F.expr(f"slot % {BITMAP}")).alias("bits"), F.max(F.length("probe")).alias("reach"))
    bits = {k: bytearray(1 << SLOT_BITS >> 3) for k in range(len(ANCHORS))}
    reach = dict.fromkeys(bits, 0)
    for r in known.collect():  # at most a bitmap of a fixed size for each anchor length
        at = r["part"] * BITMAP >> 3
        bits[r["kind"]][at: at + (BITMAP >> 3)] = r["bits"]
        reach[r["kind"]] = max(reach[r["kind"]], r["reach"])
    return probes.sparkSession.sparkContext.broadcast({k: (bytes(b), reach[k]) for k, b in bits.items() if reach[k]})


def _slices(batch: pa.RecordBatch) -> Iterator[tuple[pa.RecordBatch, list[str]]]:
    values, a, held = batch.column("text").to_pylist(), 0, 0
    for i, t in enumerate(values):
        held += len(t)
        if held > SLICE_CHARS or i == len(values) - 1:
            yield batch.slice(a, i + 1 - a), values[a: i + 1]
            a, held = i + 1, 0


def _found(codes: np.ndarray, length: int, packed: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Places where a known anchor may begin, and all places' hashes."""
    hashes = _anchor_hashes(codes, length)
    slot = _slot(hashes)
    return np.flatnonzero(np.frombuffer(packed, np.uint8)[slot >> 3] >> (slot & 7).astype(np.uint8) & 1), hashes


def met_probes(texts: DataFrame, probes: DataFrame) -> DataFrame:
    """The ``probes`` (of :func:`with_anchors`) whose anchor is in one of the texts (``id, text``)."""
    shared = _known(probes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, values in _slices(batch):
                codes = _codes("".join(values))
                for kind, (packed, _) in shared.value.items():
                    at, hashes = _found(codes, ANCHORS[kind], packed)
                    numbers = np.unique(_number(hashes[at]))
                    if len(numbers):
                        yield pa.record_batch([pa.array(np.full(len(numbers), kind, np.int32)), pa.array(numbers)], ["kind", "anchor"])

    # stored, so that the probes are not shuffled when few anchors are left
    seen = stage_table(texts.select("text").mapInArrow(run, "kind int, anchor long").distinct(), "text-anchors")
    return probes.join(seen, ["kind", "anchor"], "left_semi")


def text_pieces(texts: DataFrame, probes: DataFrame, buckets: int) -> DataFrame:
    """``id, bucket, chars, pieces`` of texts (``id, text``) that have an anchor of the bucket's probes."""
    shared = _known(probes)

    def intervals(joined: str, ends: np.ndarray) -> tuple[np.ndarray, ...]:
        """(text, bucket, begin, end) of the pieces of texts that stand one after the other, joined where they touch."""
        codes, found = _codes(joined), []
        for kind, (packed, far) in shared.value.items():
            at, hashes = _found(codes, ANCHORS[kind], packed)
            text = np.searchsorted(ends, at, "right")
            inside = at < ends[-1] if len(ends) else np.zeros(len(at), bool)
            at, text = at[inside], text[inside]
            found.append((text, _number(hashes[at]) % buckets, at, np.minimum(at + far, ends[text])))
        text, bucket, begin, end = (np.concatenate(c) for c in zip(*found))
        order = np.lexsort((begin, bucket, text))
        text, bucket, begin, end = text[order], bucket[order], begin[order], end[order]
        if not len(text):
            return text, bucket, begin, end
        fresh = np.append(True, (text[1:] != text[:-1]) | (bucket[1:] != bucket[:-1]))
        group = np.cumsum(fresh) - 1
        width = len(joined) + 1
        furthest = np.maximum.accumulate(group * width + end) - group * width
        fresh[1:] |= begin[1:] > furthest[:-1]
        head = np.flatnonzero(fresh)
        return text[head], bucket[head], begin[head], furthest[np.append(head[1:], len(text)) - 1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, values in _slices(batch):
                joined = "".join(values)
                text, bucket, begin, end = intervals(joined, np.cumsum([len(t) for t in values]))
                if not len(text):
                    continue
                edges = np.flatnonzero(np.append(True, (text[1:] != text[:-1]) | (bucket[1:] != bucket[:-1])))
                stops = np.append(edges[1:], len(text)).tolist()
                lists = [list(dict.fromkeys(joined[begin[i]: end[i]] for i in range(a, b))) for a, b in zip(edges.tolist(), stops)]
                yield pa.record_batch([part.column("id").take(pa.array(text[edges])), pa.array(bucket[edges]),
                                       pa.array([sum(map(len, p)) for p in lists], pa.int64()), pa.array(lists, pa.list_(pa.string()))],
                                      ["id", "bucket", "chars", "pieces"])

    schema = StructType([StructField("id", texts.schema["id"].dataType), *StructType.fromDDL("bucket long, chars long, pieces array<string>").fields])
    return texts.mapInArrow(run, schema)


def run_automata(rows: DataFrame, id_field: StructField, value_field: StructField) -> DataFrame:
    """``id, value``: the least ``order`` of the probes in each row's pieces.

    rows: by ``bucket, chunk, salt`` first probes (``probe, rank, value``), then texts (``id, pieces``)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import ahocorasick
        now, words, automaton = None, [], None
        for batch in batches:
            keys = list(zip(*(batch.column(c).to_pylist() for c in ("bucket", "chunk", "salt"))))
            probe, value, pieces = (batch.column(c).to_pylist() for c in ("probe", "value", "pieces"))
            ids, found = [], []
            for i, key in enumerate(keys):
                if key != now:
                    now, words, automaton = key, [], None
                if probe[i] is not None:
                    words.append((probe[i], value[i]))
                    continue
                if not words:
                    continue
                if automaton is None:
                    automaton = ahocorasick.Automaton(ahocorasick.STORE_INTS)
                    words.sort(key=lambda w: [(x is not None, x.encode() if isinstance(x, str) else x) for x in w[1].values()])  # null first
                    for k, (word, _) in enumerate(words):
                        automaton.add_word(word, k)  # the number is the rank: the least one found is the best
                    automaton.make_automaton()
                best = min((k for piece in pieces[i] for _, k in automaton.iter(piece)), default=None)
                if best is not None:
                    ids.append(i)
                    found.append(words[best][1])
            if ids:
                yield pa.record_batch([batch.column("id").take(pa.array(ids)), pa.array(found, batch.column("value").type)], ["id", "value"])

    return rows.mapInArrow(run, StructType([id_field, value_field]))


def best_probe(texts: DataFrame, probes: DataFrame, per_automaton: int = PROBES, piece_chars: int = PIECE_CHARS) -> DataFrame:
    """``id, value``: for every text (``id, text``; null is empty) that contains a probe, the least ``value`` (a struct)
    of the probes (``probe, value``; distinct, not empty) in it.  ``probes`` has to be a stored table."""
    spark = texts.sparkSession
    texts = texts.select("id", F.coalesce("text", F.lit("")).alias("text"))
    anchored = stage_table(with_anchors(probes), "anchored-probes")
    with batch_rows(spark, 2000):
        met = stage_table(met_probes(texts, anchored), "met-probes")
    buckets = max(int(spark.conf.get("spark.sql.shuffle.partitions")), met.count() // per_automaton + 1)
    placed = met.withColumn("bucket", F.col("anchor") % buckets)
    with batch_rows(spark, 2000):
        pieces = stage_table(text_pieces(texts, placed, buckets), "pieces")
    of = F.ceil(F.col("n") / F.lit(per_automaton)).cast("int")
    chunks = placed.groupBy("bucket").agg(F.count(F.lit(1)).alias("n")).select("bucket", of.alias("chunks"))
    salts = pieces.groupBy("bucket").agg(F.ceil(F.sum("chars") / F.lit(piece_chars)).cast("int").alias("salts"))
    groups = stage_table(chunks.join(salts, "bucket"), "probe-groups")  # buckets that both sides have
    key = ["bucket", "chunk", "salt"]
    dealt = placed.join(groups, "bucket").select("bucket", F.pmod(F.xxhash64("probe"), F.col("chunks")).cast("int").alias("chunk"),
                                                 F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"), "probe", "value")
    sent = pieces.join(groups, "bucket").select("bucket", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("chunk"),
                                                F.pmod(F.xxhash64("id"), F.col("salts")).cast("int").alias("salt"), "id", "pieces")
    rows = dealt.unionByName(sent, allowMissingColumns=True).repartition(*key).sortWithinPartitions(*key, F.col("probe").isNull())
    with batch_rows(spark, 2000):
        found = stage_table(run_automata(rows.select(*key, "probe", "value", "id", "pieces"), StructField("id", texts.schema["id"].dataType),
                                         StructField("value", probes.schema["value"].dataType)), "probe-hits")
    return found.groupBy("id").agg(F.min("value").alias("value"))
