"""Toxicity scores: a lexicon met through Levenshtein automata, weighed by the words around each hit.

The lexicon is a trie.  A token is read by the intersection of the trie with the Levenshtein automaton
of each term: a state is the set of (trie node, edits so far) that the characters read can have
reached, and its successors are made when first asked for and kept, so that reading a token costs a
dictionary step per character and most tokens leave the automaton after two or three.

A hit is quotation when it stands within quotation marks or after a word of report, directed when
the reader is addressed near it, and plain abuse else.  Besides the given lexicon, terms are learned
from the labelled rows that may be learned from (a bounded sample of them): words that are many times
as frequent in toxic as in other texts.  Counts of exact and misspelled hits of both lexicons, and of
quoted and directed hits, each in a few steps, form one of ``CELLS`` cells; a logistic model over the
steps is fitted on the cell counts of all labelled rows.  The driver sees only those counts and the
learned terms.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from .common import bounded_batches

#: Terms of abuse; terms of five letters and more are also met with one edit.
LEXICON = ("idiot idiotic moron moronic stupid clown trash scum loser worthless pathetic disgusting imbecile dumbass "
           "scumbag vermin freak creep jerk bastard retard degenerate filthy subhuman").split()
FUZZY_LENGTH = 5
TOKEN = re.compile(r"[^\W_]+")
REPORT = re.compile(r"\b(?:said|says|saying|wrote|writes|quoted?|quotes|quoting|called|calls|reported|reports|according|"
                    r"word|term|slur|insult|phrase|expression)\b")
ADDRESS = re.compile(r"\b(?:you|your|you're|youre|yourself|u|ur)\b")
OPENING, CLOSING = "“«„", "”»“"
WINDOW = 60
#: Steps of the counts: exact and misspelled of the lexicon, exact and misspelled of learned terms, quoted, directed.
STEPS = (3, 3, 4, 3, 3, 3)
#: Bounds of the learned lexicon: labelled rows read for it and terms kept.
SAMPLE_ROWS, MOST_TERMS = 20_000, 500
CELLS = int(np.prod(STEPS))
#: Tokens remembered to meet no term (memory only: a forgotten token is read again).
MOST_CLEAN = 250_000
_OTHER = ""


class TermAutomaton:
    """Deterministic intersection of a lexicon trie with Levenshtein automata, made as it is used."""

    def __init__(self, terms: list[str], fuzzy_length: int = FUZZY_LENGTH):
        self.children: list[dict[str, int]] = [{}]
        self.allowed: dict[int, int] = {}  # end nodes: edits that the term tolerates
        for term in terms:
            node = 0
            for c in term:
                if c not in self.children[node]:
                    self.children[node][c] = len(self.children)
                    self.children.append({})
                node = self.children[node][c]
            self.allowed[node] = int(len(term) >= fuzzy_length)
        self.alphabet = {c for kids in self.children for c in kids}
        self.most = max(self.allowed.values(), default=0)
        self.ids: dict[frozenset, int] = {}
        self.sets: list[frozenset] = []
        self.steps: list[dict[str, int]] = []
        self.accepts: list[int] = []  # fewest edits of a term that ends here, -1: none
        self.start = self._state({(0, 0)})

    def _state(self, states: set[tuple[int, int]]) -> int:
        todo = list(states)
        while todo:  # letters of the term that the token leaves out
            node, edits = todo.pop()
            if edits < self.most:
                for kid in self.children[node].values():
                    if (kid, edits + 1) not in states:
                        states.add((kid, edits + 1))
                        todo.append((kid, edits + 1))
        best: dict[int, int] = {}
        for node, edits in states:
            best[node] = min(best.get(node, edits), edits)
        key = frozenset(best.items())
        if key not in self.ids:
            self.ids[key] = len(self.sets)
            self.sets.append(key)
            self.steps.append({})
            self.accepts.append(min((e for n, e in key if n in self.allowed and e <= self.allowed[n]), default=-1))
        return self.ids[key]

    def _step(self, state: int, c: str) -> int:
        c = c if c in self.alphabet else _OTHER
        if c not in self.steps[state]:
            nxt: set[tuple[int, int]] = set()
            for node, edits in self.sets[state]:
                if edits < self.most:
                    nxt.add((node, edits + 1))
                    nxt.update((kid, edits + 1) for kid in self.children[node].values())
                if c in self.children[node]:
                    nxt.add((self.children[node][c], edits))
            self.steps[state][c] = self._state(nxt) if nxt else -1
        return self.steps[state][c]

    def edits(self, token: str) -> int:
        """Fewest edits to a term that tolerates them, or -1."""
        state, steps = self.start, self.steps
        for c in token:
            nxt = steps[state].get(c)
            state = self._step(state, c) if nxt is None else nxt
            if state < 0:
                return -1
        return self.accepts[state]


def _in_quotes(before: str, after: str) -> bool:
    if before.count('"') % 2 and '"' in after:
        return True
    opened = max(before.rfind(c) for c in OPENING)
    return opened > max(before.rfind(c) for c in "”»") and any(c in after for c in CLOSING)


class Lexicon:
    """Automata of the given and the learned terms, and tokens known to meet neither."""

    def __init__(self, given: tuple[str, ...], learned: tuple[str, ...]):
        self.automata = (TermAutomaton(list(given)), TermAutomaton(list(learned)))
        self.clean: set[str] = set()

    def meet(self, token: str) -> int:
        """0: exact, 1: misspelled, 2 and 3: the same for learned terms, -1: no term."""
        given, learned = (a.edits(token) for a in self.automata)
        return given if given == 0 or learned < 0 else 2 + learned if learned == 0 or given < 0 else given


def hit_counts(text: str, lexicon: Lexicon) -> tuple[int, ...]:
    """Counts of the hits of a whole text, in the order of ``STEPS``."""
    low = text.lower()
    words = set(TOKEN.findall(low)) - lexicon.clean
    hits = {w: k for w in words if (k := lexicon.meet(w)) >= 0}
    lexicon.clean.update(words - hits.keys())
    counts = [0] * len(STEPS)
    if hits:
        for m in TOKEN.finditer(low):
            if (k := hits.get(m[0], -1)) < 0:
                continue
            before, after = low[max(0, m.start() - WINDOW): m.start()], low[m.end(): m.end() + WINDOW]
            if _in_quotes(before, after) or REPORT.search(before):
                counts[4] += 1
                continue
            counts[k] += 1
            counts[5] += bool(ADDRESS.search(before) or ADDRESS.search(after))
    return tuple(counts)


def cell_of(counts: tuple[int, ...]) -> int:
    cell = 0
    for n, steps in zip(counts, STEPS):
        cell = cell * steps + min(n, steps - 1)
    return cell


def toxic_cell(text: Column, learned: list[str], given: list[str] | None = None) -> Column:
    """The cell (0 to CELLS - 1) of a text's hits; a null or empty text has cell 0."""
    terms = tuple(given or LEXICON), tuple(learned)

    @pandas_udf("long")
    def cell(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        lexicon = Lexicon(*terms)  # goes with the task: a worker lives on
        for texts in batches:
            out = np.zeros(len(texts), np.int64)
            for i, t in enumerate(texts):
                if t:
                    out[i] = cell_of(hit_counts(t, lexicon))
                    if len(lexicon.clean) > MOST_CLEAN:
                        lexicon.clean.clear()
            yield pd.Series(out)

    return cell(text)


def learn_terms(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS, most_terms: int = MOST_TERMS,
                least_texts: int = 4, least_share: float = 0.005, lift: float = 10.0) -> list[str]:
    """Words that at least ``least_texts`` and ``least_share`` of the sample's toxic texts have, ``lift``
    times as often as the other texts.

    The sample: the ``sample_rows`` labelled rows with the smallest id hashes (not a prefix of the
    table).  Equal texts count once.  At most ``most_terms`` terms, the most telling ones."""
    sample = training_labels(labels).orderBy(F.xxhash64("l_id"), "l_id").limit(sample_rows)
    texts = docs.select("doc_id", "text").join(F.broadcast(sample), F.col("doc_id") == F.col("l_id"))  # bounded by sample_rows
    texts = texts.where("label IN (0, 1)").groupBy(F.sha2("text", 256).alias("d"), "label").agg(F.first("text").alias("text"))

    def words(batches):
        for batch in batches:
            counts = {}, {}
            for t, label in zip(batch["text"], batch["label"]):
                for w in set(TOKEN.findall((t or "").lower())):
                    if len(w) >= FUZZY_LENGTH and not w.isdigit():
                        counts[label][w] = counts[label].get(w, 0) + 1
            counts[1][""], counts[0][""] = int((batch["label"] == 1).sum()), int((batch["label"] == 0).sum())
            both = list(counts[0].keys() | counts[1].keys())
            yield pd.DataFrame({"word": both, "toxic": [counts[1].get(w, 0) for w in both], "other": [counts[0].get(w, 0) for w in both]})

    counts = texts.select("text", "label").mapInPandas(words, "word string, toxic long, other long")
    counts = counts.groupBy("word").agg(F.sum("toxic").alias("toxic"), F.sum("other").alias("other"))
    counts = counts.where((F.col("word") == "") | (F.col("toxic") >= least_texts))
    total = F.broadcast(counts.where("word = ''").select(F.col("toxic").alias("all_toxic"), F.col("other").alias("all_other")))  # one row
    ratio = (F.col("toxic") / F.col("all_toxic")) / ((F.col("other") + 0.5) / (F.col("all_other") + 1))
    told = counts.where("word <> ''").join(total).withColumn("ratio", ratio)
    told = told.where((F.col("ratio") >= lift) & (F.col("toxic") >= least_share * F.col("all_toxic")))
    return [r["word"] for r in told.orderBy(F.desc(F.col("ratio") * F.col("toxic")), "word").limit(most_terms).collect()]


def _design() -> np.ndarray:
    """A row per cell: a constant and, for every step of each count, whether it is reached."""
    steps = np.array(np.unravel_index(np.arange(CELLS), STEPS)).T
    cols = [np.ones(CELLS)] + [(steps[:, j] >= s).astype(float) for j, n in enumerate(STEPS) for s in range(1, n)]
    return np.stack(cols, 1)


def fit_cells(cells: DataFrame, ridge: float = 1.0) -> list[float]:
    """Scores (0 to 1) of all cells from rows ``cell, label``: a ridge logistic fit on the counts of all
    rows.  Without rows of both labels, plain hits score 0.9 and other cells 0.1."""
    counts = cells.where("label IN (0, 1)").groupBy("cell", "label").count().collect()  # at most 2 * CELLS rows
    n = np.zeros((2, CELLS))
    for r in counts:
        n[r["label"], r["cell"]] += r["count"]
    x = _design()
    if not n.sum(1).all():
        return np.where(x[:, [1, STEPS[0]]].any(1), 0.9, 0.1).tolist()
    w, total = np.zeros(x.shape[1]), n.sum(0)
    weight = np.full(x.shape[1], ridge)
    weight[0] = 1e-6
    for _ in range(50):  # Newton's method
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve(x.T @ (x * (total * p * (1 - p))[:, None]) + np.diag(weight), x.T @ (n[1] - total * p) - weight * w)
        w += np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-9:
            break
    return (1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))).tolist()


def held_out(doc_id: Column) -> Column:
    return F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0


def training_labels(labels: DataFrame) -> DataFrame:
    """``l_id, label`` of the labelled rows that may be learned from; a null id is left out."""
    return labels.where(~held_out(F.col("doc_id"))).select(F.col("doc_id").alias("l_id"), F.col("toxic").cast("int").alias("label"))


def cell_score(cell: Column, scores: list[float]) -> Column:
    return F.element_at(F.array(*[F.lit(s) for s in scores]), (cell + 1).cast("int"))


def fit(docs: DataFrame, labels: DataFrame, stage) -> tuple[list[str], list[float], DataFrame]:
    """Learned terms, scores of the cells, and ``doc_id, cell`` of all rows of ``docs (doc_id, text)``."""
    bounded_batches(docs.sparkSession)
    learned = learn_terms(docs, labels)
    cells = stage(docs.select("doc_id", toxic_cell(F.col("text"), learned).alias("cell")))
    scores = fit_cells(cells.join(training_labels(labels), F.col("doc_id") == F.col("l_id")).select("cell", "label"))
    return learned, scores, cells


def score_documents(docs: DataFrame, labels: DataFrame, stage, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """``doc_id, held_out, score, predicted, cell`` per row of ``docs``; ``stage`` writes and rereads a table.

    Only ``text`` enters a score.  Null and empty texts have no hits; a row with a null id is scored
    like any other (``held_out`` null); repeated rows repeat; an empty table gives an empty result."""
    _, scores, cells = fit(docs.select(F.col(f"`{doc_id}`").alias("doc_id"), F.col(f"`{text}`").cast("string").alias("text")), labels, stage)
    out = cells.withColumn("score", cell_score(F.col("cell"), scores))
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "cell")


def drop_toxic(docs: DataFrame, labels: DataFrame, stage, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """``docs`` without the rows whose score is 0.5 or more; all columns stay.

    The model is that of :func:`score_documents`; the texts are read a second time rather than shuffled."""
    own = docs.select(F.col(f"`{doc_id}`").alias("doc_id"), F.col(f"`{text}`").cast("string").alias("text"))
    learned, scores, _ = fit(own, labels, stage)
    scored = docs.withColumn("__cell", toxic_cell(F.col(f"`{text}`").cast("string"), learned))
    return scored.where(cell_score(F.col("__cell"), scores) < 0.5).drop("__cell")
