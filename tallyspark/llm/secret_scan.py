"""Secret scan: fixed patterns, and strings in a sensitive context that a primed compressor cannot shrink.

Novelty of a candidate is its marginal size: the bytes that zstandard needs for it when it is primed
with a dictionary of common identifiers and of the text around it (without the candidate).  Words,
names and repeated values of the text cost a few bytes.  A random key costs what any random string of its
length and alphabet does (about its length; less where zstandard codes the literals of a long one by
their frequency), and that is what a candidate is held against.  Letters alone are held against the letter
pairs of common words besides: a long word is new to the compressor too, but no random string.

A task works on slices of an Arrow batch.  Fast searches over a slice's bytes (key words, the access
key prefix, places where six bytes four apart are all hex digits, as any run of 24 has them) choose
the documents that the exact patterns then read as a whole; all other documents cannot have a span.
"""

from __future__ import annotations

import hashlib
import random
import re
from collections.abc import Iterator
from functools import cache, lru_cache

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame

from .common import bounded_batches, slices, utf8

KINDS = ("assign", "access", "hex", "novel")
#: The base patterns.
ASSIGN = re.compile(rb"([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]"
                    rb"|[Aa][Pp][Ii]_?[Kk][Ee][Yy])[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)")
ACCESS = re.compile(rb"AKIA[A-Z0-9]+")
HEX = re.compile(rb"[0-9a-f]{24,}")
MIN_ASSIGN, MIN_ACCESS = 6, 20
ASSIGN_WORDS = (b"password", b"passwd", b"secret", b"token", b"apikey", b"api_key")
#: Words that make the text after them sensitive.
CONTEXT_WORDS = (*ASSIGN_WORDS, b"api-key", b"access_key", b"access key", b"private_key", b"private key", b"credential",
                 b"bearer ", b"passphrase", b"authorization", b"signature")
CANDIDATE = re.compile(rb"[A-Za-z0-9+/_=.~-]{16,}")
#: What a compressor may know beforehand of code and configuration.
IDENTIFIERS = (b"public private protected static final class return function import export default const string number boolean true "
               b"false null undefined none self this username password passwd secret token api_key apikey access_key client_id "
               b"client_secret private_key public_key authorization bearer basic credential signature passphrase http:// https:// "
               b"www. .com .org .net localhost 127.0.0.1 example config settings environment variable database connection host port "
               b"user name value key id uuid version 1.0.0 2.0.0 0123456789 abcdefghijklmnopqrstuvwxyz ABCDEFGHIJKLMNOPQRSTUVWXYZ "
               b"lorem ipsum dolor sit amet changeme placeholder your_token_here xxxxxxxxxxxxxxxx ****************")

#: Common words, for the letter pairs of words.
WORDS = (b"the and that have for not with you this but from they say she will one all would there their what out about who get which "
         b"when make can like time just him know take people into year your good some could them see other than then now look only come "
         b"its over think also back after use two how our work first well way even new want because any these give day most us "
         b"information development international university government management available education department performance different "
         b"important following community environment application association technology professional relationship administration "
         b"communication organization understanding particularly responsibility characteristic configuration authentication "
         b"documentation implementation representation transaction distribution connection collection direction production function "
         b"description instruction permission session version business process service services system systems security server client "
         b"request response message number address account customer product project program computer network software hardware database "
         b"internet website content language english original national political economic financial medical scientific physical "
         b"chemical biological historical traditional additional special general central federal local social public private personal "
         b"individual experience reference difference conference science evidence influence sequence building meeting training "
         b"learning reading writing testing setting settings getting thinking working making looking running moving changed created "
         b"updated required provided included received described considered established developed increased released published "
         b"thoughtful wonderful beautiful successful powerful helpful quickly really usually probably certainly actually currently "
         b"journal article chapter section paragraph question answer problem solution example exercise student teacher school history "
         b"country state city street house family mother father brother sister friend children woman women water earth light night "
         b"morning evening summer winter string integer boolean object class method parameter variable constant exception interface "
         b"abstract default register controller manager handler factory builder provider listener component container template")
LIKE_RANDOM = 0.85

IS_HEX = np.zeros(256, bool)
IS_HEX[np.frombuffer(b"0123456789abcdef", np.uint8)] = True

SCHEMA = ("doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_novel long, "
          "kinds array<string>, starts array<long>, ends array<long>")


def base_spans(text: bytes) -> list[tuple[int, int, int]]:
    """(start, kind, end) in bytes of the fixed patterns, leftmost and not overlapping per kind."""
    found = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= MIN_ASSIGN]
    found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if len(m[0]) >= MIN_ACCESS]
    found += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return found


def marginal_bytes(candidate: bytes, around: bytes) -> int:
    """Bytes that the candidate adds to a frame primed with identifiers and the text around it."""
    primer = zstandard.ZstdCompressionDict(IDENTIFIERS + around, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
    coder = zstandard.ZstdCompressor(level=9, dict_data=primer, write_content_size=False, write_dict_id=False)
    return len(coder.compress(candidate)) - len(coder.compress(b""))


@lru_cache(1 << 14)
def random_bytes(length: int, alphabet: bytes) -> int:
    """Marginal bytes of a random string (a fixed one) of this length and alphabet."""
    return marginal_bytes(bytes(random.Random(length).choices(alphabet, k=length)), b"")


def alphabet_of(value: bytes) -> bytes:
    """The characters that a candidate could be made of: classes that it has a member of."""
    held = set(value)
    classes = (b"0123456789", b"abcdef" if not held & set(b"ghijklmnopqrstuvwxyz") else b"abcdefghijklmnopqrstuvwxyz",
               b"ABCDEF" if not held & set(b"GHIJKLMNOPQRSTUVWXYZ") else b"ABCDEFGHIJKLMNOPQRSTUVWXYZ")
    return b"".join(c for c in classes if held & set(c)) + bytes(sorted(held & set(b"+/_=.~-")))


@cache
def pair_costs() -> tuple[np.ndarray, float]:
    """Bits of a letter (1 to 26; 0: no letter) after another in common words, and their mean over random letters."""
    at = letters(WORDS)
    counts = np.full((27, 27), 0.25)
    np.add.at(counts, (at[:-1], at[1:]), 1)
    bits = -np.log2(counts / counts.sum(1, keepdims=True))
    return bits, float(bits[1:, 1:].mean())


def letters(value: bytes) -> np.ndarray:
    folded = (np.frombuffer(value, np.uint8) | 32).astype(np.int64) - 96
    return np.where((folded >= 1) & (folded <= 26), folded, 0)


def like_words(value: bytes) -> bool:
    """Whether the letter pairs are those of words rather than of random letters."""
    bits, mean = pair_costs()
    at = letters(value)
    inner = (at[:-1] > 0) & (at[1:] > 0)
    return not inner.any() or bits[at[:-1], at[1:]][inner].mean() < LIKE_RANDOM * mean


def is_novel(value: bytes, around: bytes, least: float = 0.85) -> bool:
    if not re.search(rb"[0-9]", value) and like_words(value):
        return False
    cost = marginal_bytes(value, around)
    return cost >= least * len(value) or cost >= 0.9 * random_bytes(len(value), alphabet_of(value))


def novel_spans(text: bytes, known: list[tuple[int, int, int]], reach: int = 64, around: int = 2048,
                least: float = 0.85) -> list[tuple[int, int, int]]:
    """Candidates that begin within ``reach`` bytes after a sensitive word, lie
    apart from the known spans and cost at least ``least`` of their length, or what a random string costs, when primed."""
    low, found, seen = text.lower(), [], set()
    for word in CONTEXT_WORDS:
        at = low.find(word)
        while at >= 0:
            end = at + len(word)
            for m in CANDIDATE.finditer(text, end, min(len(text), end + reach + 512)):
                start = m.start()
                if start - end > reach:
                    break
                value = m[0]
                if m.end() == end + reach + 512:  # the string goes on
                    value = CANDIDATE.match(text, start)[0]
                stop = start + len(value)
                if start in seen:
                    continue
                seen.add(start)
                if any(s < stop and start < e for s, _, e in known):
                    continue
                near = text[max(0, start - around): start] + b" " + text[stop: stop + around]
                if is_novel(value, near, least):
                    found.append((start, 3, stop))
            at = low.find(word, at + 1)
    kept, last = [], -1
    for s in sorted(found):  # a string found from two places is one span
        if s[0] >= last:
            kept.append(s)
            last = s[2]
    return kept


def suspects(data: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Rows of a slice in which a span is possible."""
    low, hits = data.tobytes(), []
    for words, body in (((b"AKIA",), low), ((*CONTEXT_WORDS,), low.lower())):
        for word in words:
            at = body.find(word)
            while at >= 0:
                hits.append(at)
                at = body.find(word, at + 1)
    h = IS_HEX[data[::4]]
    if len(h) >= 6:
        run = h[:-5] & h[1:-4] & h[2:-3] & h[3:-2] & h[4:-1] & h[5:]
        hits.extend((np.flatnonzero(run) * 4).tolist())
    if not hits:
        return np.zeros(0, np.int64)
    rows = np.searchsorted(starts, np.unique(np.array(hits, np.int64)), "right") - 1
    return np.unique(rows)


def scan_text(text: bytes) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, int]]]:
    """All spans and base spans of one text as (start, kind, end) in code points, sorted."""
    base = base_spans(text)
    spans = base + novel_spans(text, base)
    if not text.isascii():
        points = np.concatenate([[0], np.cumsum((np.frombuffer(text, np.uint8) & 0xC0) != 0x80)])
        as_points = lambda xs: sorted((int(points[s]), k, int(points[e])) for s, k, e in xs)
        return as_points(spans), as_points(base)
    return sorted(spans), sorted(base)


def joined(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in spans)


def scan_secrets(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """A row per row of ``docs`` with counts, the digest of the base spans, and all spans (also as
    arrays of kinds, starts and ends).  Offsets are code points, ends exclusive.

    A null or empty text has no spans; a null id stays null; repeated rows give repeated results; an
    empty table gives an empty result."""
    bounded_batches(docs.sparkSession)
    nothing = hashlib.sha256(b"").hexdigest()

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            data, starts, ends = utf8(batch.column("text"))
            n = batch.num_rows
            counts, digests, spans = np.zeros((4, n), np.int64), [nothing] * n, [""] * n
            lists = [([], [], [])] * n
            for r in suspects(data, starts):
                found, base = scan_text(data[starts[r]: ends[r]].tobytes())
                for k in range(4):
                    counts[k, r] = sum(1 for s in found if s[1] == k)
                digests[r], spans[r] = hashlib.sha256(joined(base).encode()).hexdigest(), joined(found)
                lists[r] = ([KINDS[k] for _, k, _ in found], [s for s, _, _ in found], [e for _, _, e in found])
            yield pa.record_batch([
                batch.column("doc_id").cast(pa.int64()), *(pa.array(c) for c in counts[:3]), pa.array(digests, pa.string()),
                pa.array(spans, pa.string()), pa.array(counts[3]),
                *(pa.array([x[j] for x in lists], pa.list_(t)) for j, t in enumerate((pa.string(), pa.int64(), pa.int64())))],
                [f.split()[0] for f in SCHEMA.split(", ")])

    return docs.selectExpr(f"`{doc_id}` AS doc_id", f"CAST(`{text}` AS string) AS text").mapInArrow(scan, SCHEMA)
