"""SentencePiece encoding with seeded merge-dropout, and decoding.

The model is the piece vocabulary (merge type, byte fallback) of a SentencePiece file; it is read,
never trained.  Encoding follows the merge agenda: all pairs of neighbours whose join is a piece
wait in a priority queue, best score first, then leftmost.  When a candidate is taken from the queue
it is skipped with probability ``dropout``.  The draws of an occurrence of a word come, in the order in
which the agenda takes its candidates, from a hash keyed by the seed, the document and the place of the
occurrence in it: a text has the same segmentation in every run and on every machine, another one under
another seed, and a word is drawn anew wherever it stands.

No piece holds a space mark after another character, so merges never cross from one word to the next
and words are encoded one by one.  The draws of an occurrence are the bits of a number.  A block of
occurrences is encoded together: the distinct words once without a skip, which also tells how many
draws they use, then every occurrence that has a skip among those draws, thousands of agendas side by
side as columns of arrays (a step takes one candidate from each agenda).  Words of more than 40 characters,
and agendas of more than 64 draws, are run one by one.  Nothing is kept between blocks.  Decoding gives
the text back exactly: spaces are marks, unknown characters and the mark character itself go to byte pieces.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import cache
from heapq import heapify, heappop, heappush
from operator import add

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StringType

from .common import GOLDEN, U64, bounded_batches, mix64, slices, utf8

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
MARK = "▁"
#: Spaces before a word go with it; white space other than blanks is part of words.
CHUNK = re.compile(r" *[^ ]+| +")
MASK = (1 << 64) - 1
#: Occurrences of a block; agendas run side by side; binary digits of the dropout; draws in a number.
TOGETHER, ABREAST, DIGITS, DRAWS = 1 << 18, 1 << 13, 24, 64
#: Rows and bytes of text of a batch: a text has about a piece id of four bytes per two bytes, held by a task four times over.
BATCH_ROWS, BATCH_BYTES = 500, 2 << 20
NO_RANK, SHORT = 1 << 30, 96
#: Most characters of a word in the width classes of the arrays.
WIDTHS = (6, 9, 12, 16, 24, 40)
#: Symbols of the arrays: pieces by rank, then characters of pieces; from here on code points that no piece has; the edge
#: beside a word; a place that was joined to the one before it.
APART = 1 << 21
EDGE, GONE, SYMBOL_BITS, PLACE_BITS = APART + 0x110000, -1, 22, 6


class Pieces:
    """Piece ids, merge scores and byte pieces of a model file."""

    def __init__(self, model: str):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=model)
        size = sp.get_piece_size()
        self.byte_ids = [0] * 256
        self.ids: dict[str, int] = {}
        self.bytes: list[bytes] = [b""] * size
        self.rank: dict[str, int] = {}
        merges = []
        for i in range(size):
            piece = sp.id_to_piece(i)
            if sp.is_byte(i):
                value = int(piece[3:5], 16)
                self.byte_ids[value] = i
                self.bytes[i] = bytes([value])
            elif not (sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i)):
                self.ids[piece] = i
                self.bytes[i] = piece.replace(MARK, " ").encode()
                if len(piece) > 1:
                    merges.append((-sp.get_score(i), i, piece))
        for rank, (_, _, piece) in enumerate(sorted(merges)):
            self.rank[piece] = rank
        if any(re.search(f"[^{MARK}]{MARK}", p) for p in self.ids):
            raise ValueError("a piece crosses a space: words cannot be encoded apart")


@cache
def pieces(model: str) -> Pieces:
    return Pieces(model)


def _mix(x: int) -> int:
    x = ((x ^ (x >> 30)) * 0xBF58476D1CE4E5B9) & MASK
    x = ((x ^ (x >> 27)) * 0x94D049BB133111EB) & MASK
    return x ^ (x >> 31)


def digits_of(skip_below: int) -> list[bool]:
    """Binary digits of the dropout (``skip_below`` of 2^64), the last one that is set first."""
    top = skip_below + (1 << 63 - DIGITS) >> 64 - DIGITS
    if top >> DIGITS:
        return []
    digits = [bool(top >> k & 1) for k in range(DIGITS)]
    return digits[digits.index(True):] if True in digits else [False]


def skip_bits(keys: np.ndarray, skip_below: int) -> np.ndarray:
    """64 independent draws per key, a set bit (with probability ``skip_below`` of 2^64) for a skip: random bits are
    joined along the binary digits of the probability, by OR at a 1 and by AND at a 0."""
    digits = digits_of(skip_below)
    if not digits:
        return np.full(len(keys), MASK, U64)
    bits = np.zeros(len(keys), U64)
    for k, one in enumerate(digits):
        drawn = mix64(keys + U64((k + 1) * int(GOLDEN) & MASK))
        bits = np.bitwise_or(bits, drawn, out=bits) if one else np.bitwise_and(bits, drawn, out=bits)
    return bits


class Draws:
    """The draws of one occurrence in order: the first 64 are the bits of a number, later ones are made when needed."""

    __slots__ = ("key", "below", "bits", "used")

    def __init__(self, key: int, below: int, bits: int | None = None):
        self.key, self.below, self.used = key, below, 0
        self.bits = self.block(0) if bits is None else bits

    def block(self, k: int) -> int:
        return int(skip_bits(np.array([_mix(self.key + k & MASK) if k else self.key & MASK], U64), self.below)[0])

    def skip(self) -> bool:
        n = self.used
        self.used = n + 1
        if n and not n & 63:
            self.bits = self.block(n >> 6)
        return self.bits >> (n & 63) & 1


def merge_scan(parts: list[str], rank: dict[str, int], key: int, skip_below: int, draws: Draws | None = None) -> list[str]:
    """The merge agenda of a short word, kept as one rank per pair of neighbours."""
    if skip_below and draws is None:
        draws = Draws(key, skip_below)
    if len(parts) < 2:
        return parts
    agenda = [rank.get(p, NO_RANK) if len(p) == 2 else NO_RANK for p in map(add, parts, parts[1:])]
    while (r := min(agenda)) < NO_RANK:
        i = agenda.index(r)
        if draws and draws.skip():
            agenda[i] = NO_RANK
            continue
        a = parts[i] = parts[i] + parts.pop(i + 1)
        del agenda[i]
        if i < len(agenda):
            agenda[i] = rank.get(a + parts[i + 1], NO_RANK) if parts[i + 1] else NO_RANK
        if i:
            agenda[i - 1] = rank.get(parts[i - 1] + a, NO_RANK) if parts[i - 1] else NO_RANK
        if not agenda:
            break
    return parts


def merge_heap(parts: list[str], rank: dict[str, int], key: int, skip_below: int, draws: Draws | None = None) -> list[str]:
    """The merge agenda of a long word, kept as a heap of (rank, place, joint length)."""
    if skip_below and draws is None:
        draws = Draws(key, skip_below)
    n = len(parts)
    left, right = list(range(-1, n - 1)), list(range(1, n + 1))
    agenda = [(rank[p], i, 2) for i, p in enumerate(map(add, parts, parts[1:])) if len(p) == 2 and p in rank]
    heapify(agenda)
    while agenda:
        r, i, size = heappop(agenda)
        j = right[i]
        if not parts[i] or j >= n or len(parts[i]) + len(parts[j]) != size or rank.get(parts[i] + parts[j]) != r:
            continue  # one of the two has been merged elsewhere
        if draws and draws.skip():
            continue
        a = parts[i] = parts[i] + parts[j]
        parts[j] = None
        k, h = right[j], left[i]
        right[i] = k
        if k < n:
            left[k] = i
            if parts[k] and (r := rank.get(a + parts[k])) is not None:
                heappush(agenda, (r, i, len(a) + len(parts[k])))
        if h >= 0 and parts[h] and (r := rank.get(parts[h] + a)) is not None:
            heappush(agenda, (r, h, len(parts[h]) + len(a)))
    return [p for p in parts if p is not None]


def encode_word(word: str, vocabulary: Pieces, draws: Draws | None) -> list[int]:
    """Piece ids of a chunk (blanks and a word); a candidate merge that a draw skips is out until a neighbour
    changes (no draws: no dropout)."""
    parts = list(word.replace(" ", MARK))
    if MARK in word:
        parts = [p if c != MARK else "" for p, c in zip(parts, word)]  # "" becomes byte pieces
    parts = (merge_scan if len(parts) <= SHORT else merge_heap)(parts, vocabulary.rank, 0, 0, draws)
    ids = list(map(vocabulary.ids.get, parts))
    if None in ids:
        ids = [x for p, i in zip(parts, ids) for x in ([i] if i is not None else [vocabulary.byte_ids[b] for b in (p or MARK).encode()])]
    return ids


class Symbols:
    """The vocabulary as arrays: symbols of code points, joins of two symbols in an open hash table, piece ids."""

    def __init__(self, vocabulary: Pieces):
        ids, rank = vocabulary.ids, vocabulary.rank
        number = dict(rank)
        for c in sorted({c for p in ids for c in p}):
            number.setdefault(c, len(number))
        self.of_char = np.arange(APART, EDGE, dtype=np.int32)
        for c in number.keys() - rank.keys():
            self.of_char[ord(c)] = number[c]
        self.of_char[ord(" ")] = self.of_char[ord(MARK)]
        self.of_char[ord(MARK)] = APART + ord(MARK)  # a mark in the text is no blank
        self.piece = np.array([ids[p] if p in ids else APART + ord(p) for p in number], np.int32)
        self.byte_ids = np.array(vocabulary.byte_ids, np.int32)
        pairs = np.array([(number[p[:i]], number[p[i:]], r) for p, r in rank.items() for i in range(1, len(p))
                          if p[:i] in number and p[i:] in number], np.int64).reshape(-1, 3)
        keys, size = pairs[:, 0] << SYMBOL_BITS | pairs[:, 1], max(8, (8 * len(pairs)).bit_length())
        self.shift, self.last = U64(64 - size), (1 << size) - 1
        self.keys, self.joint = np.full(1 << size, -1, np.int64), np.full(1 << size, NO_RANK, np.int32)
        slot, todo = self._slot(keys), np.arange(len(keys))
        while todo.size:
            free = todo[self.keys[slot[todo]] < 0]
            _, first = np.unique(slot[free], return_index=True)
            won = free[first]
            self.keys[slot[won]], self.joint[slot[won]] = keys[won], pairs[won, 2] << PLACE_BITS
            todo = todo[self.keys[slot[todo]] != keys[todo]]
            slot[todo] = slot[todo] + 1 & self.last

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return (keys.astype(U64) * GOLDEN >> self.shift).astype(np.int64)

    def join(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Rank of the joint piece, moved left by the bits of a place; NO_RANK where there is none."""
        keys = a.astype(np.int64) << SYMBOL_BITS | b
        slot = self._slot(keys)
        met = self.keys[slot]
        out = np.where(met == keys, self.joint[slot], NO_RANK).astype(np.int32)
        todo = np.flatnonzero((met != keys) & (met >= 0))
        while todo.size:
            slot[todo] = slot[todo] + 1 & self.last
            met = self.keys[slot[todo]]
            out[todo[met == keys[todo]]] = self.joint[slot[todo[met == keys[todo]]]]
            todo = todo[(met != keys[todo]) & (met >= 0)]
        return out

    def agendas(self, parts: np.ndarray) -> np.ndarray:
        """Candidates of words in columns (an edge above and below): rank and place of every pair of neighbours."""
        out = np.full(parts.shape, NO_RANK, np.int32)
        for i in range(1, len(parts) - 2):
            out[i] = self.join(parts[i], parts[i + 1]) + i
        return out

    def merge(self, parts: np.ndarray, agenda: np.ndarray, bits: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Runs the agendas of all columns.  Gives the parts that are left, and the draws used (-1: over 64, not ended)."""
        parts, agenda = np.array(parts, order="C"), np.array(agenda, order="C")
        wide, n = parts.shape
        left = np.repeat(np.arange(-1, wide - 1, dtype=np.int8)[:, None], n, 1)
        right = np.repeat(np.arange(1, wide + 1, dtype=np.int8)[:, None], n, 1)
        rows, drawn = np.arange(n), np.zeros(n, np.int64)
        out, used = np.full((wide, n), GONE, np.int32), np.full(n, -1, np.int64)
        for step in range(DRAWS + 1):
            low = agenda.min(axis=0)
            live = low < NO_RANK
            count = np.count_nonzero(live)
            if 4 * count < 3 * len(rows) or step == DRAWS:  # columns that have ended leave the arrays
                ended, on = np.flatnonzero(~live), np.flatnonzero(live)
                out[:, rows[ended]], used[rows[ended]] = parts[:, ended], drawn[ended]
                parts, agenda, left, right = (np.take(x, on, axis=1) for x in (parts, agenda, left, right))
                rows, drawn, bits, low, live = rows[on], drawn[on], bits[on], low[on], live[on]
            if not count or step == DRAWS:
                break
            drawn += live
            m, skip = len(rows), (bits >> U64(step) & U64(1)).astype(bool)
            out_of = np.flatnonzero(live & skip)
            agenda[low[out_of] & (1 << PLACE_BITS) - 1, out_of] = NO_RANK
            go = np.flatnonzero(live & ~skip)
            joint, i = low[go] >> PLACE_BITS, low[go] & (1 << PLACE_BITS) - 1
            parts_, agenda_, left_, right_ = parts.reshape(-1), agenda.reshape(-1), left.reshape(-1), right.reshape(-1)
            at = i * m + go
            joined = right_[at] * np.int64(m) + go
            after, before = right_[joined], left_[at]
            at_after, at_before = after * np.int64(m) + go, before * np.int64(m) + go
            parts_[at], parts_[joined], agenda_[joined] = joint, GONE, NO_RANK
            right_[at], left_[at_after] = after, i
            agenda_[at] = self.join(joint, parts_[at_after]) + i
            agenda_[at_before] = self.join(parts_[at_before], joint) + before
        return out, used

    def ids(self, parts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Piece ids of all columns, one after the other, and their number per column."""
        rows = parts.T
        here = (rows != GONE) & (rows != EDGE)
        symbols, counts = rows[here], here.sum(1)
        ids = symbols.copy()
        known = symbols < APART
        ids[known] = self.piece[symbols[known]]
        if (ids >= APART).any():  # characters without a piece: a piece per byte of UTF-8
            code = np.where(ids >= APART, ids - APART, 0)
            size = 1 + (code > 0x7F) + (code > 0x7FF) + (code > 0xFFFF)
            total = np.concatenate([[0], np.cumsum(size)])
            ends = np.cumsum(counts)
            counts = total[ends] - total[ends - counts]
            ids, code, of = np.repeat(ids, size), np.repeat(code, size), np.repeat(size, size)
            k = np.arange(len(ids)) - np.repeat(total[:-1], size)
            value = code >> 6 * (of - 1 - k)
            value = np.where(k, value & 0x3F | 0x80, np.where(of > 1, 0xF00 >> of & 0xFF | value, value))
            ids = np.where(ids >= APART, self.byte_ids[value & 0xFF], ids).astype(np.int32)
        return ids, counts


@cache
def symbols(model: str) -> Symbols:
    return Symbols(pieces(model))


def _runs(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Indexes ``start .. start + count`` of all runs, one after the other."""
    ends = np.cumsum(counts)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(starts - (ends - counts), counts)


class Encoder:
    """Encodes texts under one seed and dropout."""

    def __init__(self, model: str, seed: int, dropout: float):
        self.vocabulary, self.symbols, self.seed = pieces(model), symbols(model), seed
        self.skip_below = min(MASK, int(dropout * 2.0 ** 64))

    def encode(self, text: str, key: int) -> bytes:
        """Piece ids (int32) of a text in the document of this key; the dummy blank before it is part of the model's form."""
        ids, _ = self.encode_column(pa.array([text], pa.large_string()), np.array([key & MASK], U64))
        return ids.tobytes()

    def encode_column(self, texts: pa.Array, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Piece ids of all texts, one after the other, and their number per text (null is empty)."""
        texts = texts.cast(pa.large_string()).fill_null("")
        empty = pc.equal(pc.binary_length(texts), 0)
        nothing, space = (pa.scalar(x, pa.large_string()) for x in ("", " "))
        data, starts, ends = utf8(pc.if_else(empty, texts, pc.binary_join_element_wise(space, texts, nothing)))
        blank = data == ord(" ")
        first = blank.copy()
        first[1:] &= ~blank[:-1]
        first[starts[ends > starts]] = True
        offsets = np.append(np.flatnonzero(first), len(data))
        begins = np.searchsorted(offsets[:-1], starts)
        counts = np.searchsorted(offsets[:-1], ends) - begins
        place = np.arange(len(offsets) - 1) - np.repeat(begins, counts)
        text_keys = mix64(keys + U64(self.seed * int(GOLDEN) & MASK))
        word_keys = mix64(np.repeat(text_keys, counts) + place.astype(U64) * GOLDEN)
        del place, blank, first
        found = [self._encode_block(data, offsets[i: i + TOGETHER + 1], word_keys[i: i + TOGETHER])
                 for i in range(0, len(word_keys), TOGETHER)]
        if not found:
            return np.zeros(0, np.int32), np.zeros(len(texts), np.int64)
        total = np.concatenate([[0], np.cumsum(np.concatenate([n for _, n in found]))])
        return np.concatenate([ids for ids, _ in found]), total[begins + counts] - total[begins]

    def _encode_block(self, data: np.ndarray, offsets: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Piece ids of a block of occurrences (chunks of ``data``) and their number per occurrence."""
        base, n = offsets[0], len(keys)
        held = np.ascontiguousarray(data[base: offsets[-1]])
        chunks = pa.Array.from_buffers(pa.large_binary(), n, [None, pa.py_buffer(offsets - base), pa.py_buffer(held)])
        chunks = chunks.dictionary_encode()
        codes, words = chunks.indices.to_numpy(), chunks.dictionary
        drawn = skip_bits(keys.copy(), self.skip_below) if self.skip_below else np.zeros(n, U64)

        flat, starts, ends = utf8(words)
        points = np.frombuffer(flat.tobytes().decode().encode("utf-32-le"), np.uint32)
        heads = np.concatenate([[0], np.cumsum(flat & 0xC0 != 0x80)])
        at, size = heads[starts], heads[ends] - heads[starts]
        wide = np.searchsorted(WIDTHS, size)  # width class of a word; the last one: too wide
        column = np.zeros(len(words), np.int64)
        pool, pooled = [], 0
        word_start, word_count, word_low = np.zeros(len(words), np.int64), np.zeros(len(words), np.int64), np.full(len(words), MASK, U64)
        start, count = np.zeros(n, np.int64), np.full(n, -1, np.int64)
        state = {}
        for c, width in enumerate(WIDTHS):
            of = np.flatnonzero(wide == c)
            parts = np.full((width + 2, len(of)), EDGE, np.int32)
            for i in range(width):
                here = np.flatnonzero(size[of] > i)
                parts[i + 1, here] = self.symbols.of_char[points[at[of[here]] + i]]
            column[of] = np.arange(len(of))
            agenda = self.symbols.agendas(parts)
            state[c] = parts, agenda
            for i in range(0, len(of), ABREAST):
                block = slice(i, i + ABREAST)
                left, used = self.symbols.merge(parts[:, block], agenda[:, block], np.zeros(len(of[block]), U64))
                ids, counts = self.symbols.ids(left)
                pool.append(ids)
                word_start[of[block]], word_count[of[block]] = pooled + np.cumsum(counts) - counts, counts
                word_low[of[block]] = np.where(used < 0, MASK, (U64(1) << np.maximum(used, 0).astype(U64)) - U64(1))
                wide[of[block][used < 0]] = len(WIDTHS)
                pooled += len(ids)

        apart = wide[codes] == len(WIDTHS)
        plain = ~apart & (drawn & word_low[codes] == 0)
        start[plain], count[plain] = word_start[codes[plain]], word_count[codes[plain]]
        for c, (parts, agenda) in state.items():
            of = np.flatnonzero(~plain & (wide[codes] == c))
            for i in range(0, len(of), ABREAST):
                block = of[i: i + ABREAST]
                col = column[codes[block]]
                left, used = self.symbols.merge(parts[:, col], agenda[:, col], drawn[block])
                ids, counts = self.symbols.ids(left)
                pool.append(ids)
                start[block], count[block] = pooled + np.cumsum(counts) - counts, np.where(used < 0, -1, counts)
                pooled += len(ids)
        for i in np.flatnonzero(count < 0).tolist():
            draws = Draws(int(keys[i]), self.skip_below, int(drawn[i])) if self.skip_below else None
            ids = np.array(encode_word(words[int(codes[i])].as_py().decode(), self.vocabulary, draws), np.int32)
            pool.append(ids)
            start[i], count[i] = pooled, len(ids)
            pooled += len(ids)
        return np.concatenate(pool)[_runs(start, count)], count


@cache
def encoder(model: str, seed: int, dropout: float) -> Encoder:
    return Encoder(model, seed, dropout)


def decode_ids(ids: list[int], model: str = MODEL) -> str:
    table = pieces(model).bytes
    return b"".join([table[i] for i in ids]).decode().removeprefix(" ")


def _id_lists(ids: np.ndarray, counts: np.ndarray) -> pa.Array:
    if len(ids) > 0x7FFFFFFF:
        raise ValueError("a slice of texts has too many pieces for one batch")
    ends = np.concatenate([[0], np.cumsum(counts)])
    return pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(ids))


def encode_documents(docs: DataFrame, text: str = "text", salt: str = "doc_id", seed: int = 7, dropout: float = 0.1,
                     model: str = MODEL) -> DataFrame:
    """``docs`` with ``ids array<int>`` (an own column ``ids`` is replaced).

    Draws are keyed by ``seed``, the hash of ``salt`` and the place in the text; equal texts of one salt
    have equal ids.  A null or empty text has no ids; repeated rows repeat; an empty table stays empty."""
    bounded_batches(docs.sparkSession, BATCH_ROWS)
    own = [c for c in docs.columns if c != "ids"]
    rows = docs.select(*[F.col(f"`{c}`") for c in own], F.xxhash64(F.col(f"`{salt}`")).alias("__key"),
                       F.col(f"`{text}`").cast("string").alias("__text"))
    schema = docs.select(*[F.col(f"`{c}`") for c in own]).schema.add("ids", ArrayType(IntegerType()))
    names = [*own, "ids"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = encoder(model, seed, dropout)
        for batch in slices(batches, "__text", BATCH_BYTES):
            ids = _id_lists(*coder.encode_column(batch.column("__text"), batch.column("__key").to_numpy().astype(U64)))
            yield pa.record_batch([*(batch.column(i) for i in range(len(own))), ids], names)

    return rows.mapInArrow(run, schema)


def decode_documents(docs: DataFrame, ids: str = "ids", model: str = MODEL, keep: bool = False) -> DataFrame:
    """``docs`` with ``decoded`` in the place of the piece ids (``keep``: beside them); null ids give an empty text."""
    bounded_batches(docs.sparkSession, BATCH_ROWS)
    own = [c for c in docs.columns if c != "decoded" and (keep or c != ids)]
    rows = docs.select(*[F.col(f"`{c}`") for c in own], *([] if keep else [F.col(f"`{ids}`")]))
    schema = docs.select(*[F.col(f"`{c}`") for c in own]).schema.add("decoded", StringType())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pieces(model).bytes
        sizes = np.array([len(b) for b in table], np.int64)
        at = np.concatenate([[0], np.cumsum(sizes)])
        flat = np.frombuffer(b"".join(table), np.uint8)
        for batch in batches:
            lists = batch.column(ids)
            values = lists.flatten().to_numpy(zero_copy_only=False)
            counts = np.array([len(x) if x.is_valid else 0 for x in lists]) if lists.null_count else np.diff(lists.offsets.to_numpy())
            out, start = [], 0
            for n in counts.tolist():
                v = values[start: start + n]
                start += n
                length = sizes[v]
                if not n:
                    out.append("")
                    continue
                stops = np.cumsum(length)
                index = np.arange(stops[-1]) + np.repeat(at[v] - (stops - length), length)
                out.append(flat[index].tobytes().decode().removeprefix(" "))
            yield pa.record_batch([*(batch.column(i) for i in range(len(own))), pa.array(out, pa.string())], [*own, "decoded"])

    return rows.mapInArrow(run, schema)
