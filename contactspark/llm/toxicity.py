"""Toxicity from a learned lexicon, Levenshtein automata and context windows.

Terms (whole words, and word beginnings) that labels show to be toxic form a trie. Words of a text run through the product of
the trie and the Levenshtein automata of its terms, made deterministic lazily, so misspelled terms are found in one pass over
a word's letters. Each hit is judged in its window of words: quotation or report on one side, direct address on the other.
A logistic model over a few sums of hits gives the score.
"""

from __future__ import annotations

import math
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from contactspark.llm.common import id_and_text, materialise

#: Labelled rows that a model is fitted on at most, by the least hash of their id; half give the lexicon, half the weights.
MAX_LABELLED = 16_000
LEAST_TERM, PREFIXES, SURE = 4, (4, 5, 6), 5
#: A term needs this many toxic texts, this log-odds of its rates and this log-likelihood ratio against equal rates (or more,
#: where very many terms are tried).
LEAST_TEXTS, LEAST_ODDS, LEAST_EVIDENCE = 3, math.log(2), 10.0
WINDOW = 8
REMEMBERED = 200_000
EDGES = "\"'.,;:!?()[]{}<>*%&$#|/\\-_~`^+=@“”„«»‘’…"
QUOTES = "\"“”„«»"
# Words that report what others said, and words that address a reader.
REPORTING = frozenset("said says wrote writes called calls quoted quote quotes term word slur dit écrit sagte schrieb dijo escribió".split())
ADDRESS = frozenset("you your you're youre u du dich dein tu toi ton vous usted te".split())


class LexiconAutomaton:
    """A trie of terms, walked with up to ``edits`` errors for each term; states are made when first met."""

    def __init__(self, terms: list[tuple[str, bool, int]]):
        """terms: (term, whether it is a beginning of words, edits allowed)."""
        self.children: list[dict[str, int]] = [{}]
        self.whole: dict[int, tuple[int, int]] = {}
        self.begin: dict[int, tuple[int, int]] = {}
        self.allowed = [0]
        for at, (term, prefix, edits) in enumerate(terms):
            node = 0
            self.allowed[0] = max(self.allowed[0], edits)
            for c in term:
                if c not in self.children[node]:
                    self.children[node][c] = len(self.children)
                    self.children.append({})
                    self.allowed.append(0)
                node = self.children[node][c]
                self.allowed[node] = max(self.allowed[node], edits)
            (self.begin if prefix else self.whole)[node] = (at, edits)
        self.ids: dict[frozenset, int] = {}
        self.states: list[dict[int, int]] = []
        self.moves: list[dict[str, int]] = []
        self.start = self._state({0: 0})

    def _state(self, nodes: dict[int, int]) -> int:
        todo = list(nodes)
        while todo:  # letters of a term that the word leaves out
            node = todo.pop()
            for child in self.children[node].values():
                e = nodes[node] + 1
                if e <= self.allowed[child] and e < nodes.get(child, 99):
                    nodes[child] = e
                    todo.append(child)
        key = frozenset(nodes.items())
        if key not in self.ids:
            self.ids[key] = len(self.states)
            self.states.append(nodes)
            self.moves.append({})
        return self.ids[key]

    def _move(self, state: int, c: str) -> int:
        nodes: dict[int, int] = {}
        for node, e in self.states[state].items():
            if e + 1 <= self.allowed[node] and e + 1 < nodes.get(node, 99):
                nodes[node] = e + 1
            for letter, child in self.children[node].items():
                cost = e + (letter != c)
                if cost <= self.allowed[child] and cost < nodes.get(child, 99):
                    nodes[child] = cost
        return self._state(nodes) if nodes else -1

    def match(self, word: str) -> tuple[int, int] | None:
        """(term, edits) of the best term: fewest edits, then the first term; None if no term matches."""
        best, state = None, self.start
        for c in word:
            to = self.moves[state].get(c)
            if to is None:
                to = self.moves[state][c] = self._move(state, c)
            if to < 0:
                return best
            state = to
            if self.begin:
                for node, e in self.states[state].items():
                    if node in self.begin and e <= self.begin[node][1] and (best is None or (e, self.begin[node][0]) < (best[1], best[0])):
                        best = (self.begin[node][0], e)
        for node, e in self.states[state].items():
            if node in self.whole and e <= self.whole[node][1] and (best is None or (e, self.whole[node][0]) < (best[1], best[0])):
                best = (self.whole[node][0], e)
        return best


@dataclass
class Model:
    terms: list[tuple[str, bool, int]] = field(default_factory=list)
    weights: list[float] = field(default_factory=list)
    mean: list[float] = field(default_factory=lambda: [0.0] * 9)
    scale: list[float] = field(default_factory=lambda: [1.0] * 9)
    coefficients: list[float] = field(default_factory=lambda: [0.0] * 9)
    intercept: float = -2.0

    def score(self, features: np.ndarray) -> np.ndarray:
        z = ((features - np.array(self.mean)) / np.array(self.scale)) @ np.array(self.coefficients) + self.intercept
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


class Reader:
    """Features of texts under a lexicon."""

    def __init__(self, terms: list[tuple[str, bool, int]], weights: list[float]):
        self.automaton, self.weights = LexiconAutomaton(terms), weights
        self.known: dict[str, tuple[int, int] | None] = {}

    def hits(self, text: str) -> tuple[list[str], list[tuple[int, int, int, bool, bool]]]:
        """The words and (position, term, edits, quoted, aimed at a reader) of each hit."""
        words = text.lower().split()
        new = set(words).difference(self.known)
        if len(self.known) + len(new) > REMEMBERED:
            self.known, new = {}, set(words)
        match, known = self.automaton.match, self.known
        for w in new:
            known[w] = match(w.strip(EDGES))
        found = list(map(known.__getitem__, words))
        out = []
        if any(found):
            marks = None
            for i, hit in enumerate(found):
                if hit:
                    if marks is None:
                        marks = [sum(w.count(q) for q in QUOTES) for w in words]
                    low, high = max(0, i - WINDOW), i + WINDOW + 1
                    inside = sum(marks[low:i]) % 2 == 1 or any(q in words[i][:1] for q in QUOTES)
                    near = {w.strip(EDGES) for w in words[low:high]}
                    out.append((i, *hit, bool(inside and sum(marks[i:high])) or bool(near & REPORTING), bool(near & ADDRESS)))
        return words, out

    def features(self, text: str | None) -> list[float]:
        if not text:
            return [0.0] * 9
        words, hits = self.hits(text)
        exact = [(self.weights[t], quoted) for _, t, e, quoted, _ in hits if not e]
        fuzzy = [(self.weights[t], quoted) for _, t, e, quoted, _ in hits if e]
        log = math.log1p
        return [
            max((w for w, q in exact if not q), default=0.0),
            log(sum(w for w, q in exact if not q)),
            log(sum(w for w, q in exact if q)),
            log(sum(w for w, q in fuzzy if not q)),
            log(sum(w for w, q in fuzzy if q)),
            float(len({t for _, t, e, q, _ in hits if not e and not q}) > 1),
            min(1.0, 20 * len(exact) / max(1, len(words))),
            log(sum(aimed for *_, aimed in hits)),
            float(bool(exact)),
        ]


def remainder(id_col: Column, modulus: int) -> Column:
    """crc32 of the id as text, modulo; null for a null id."""
    return F.crc32(id_col.cast("string").cast("binary")) % modulus


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, modulus: int, held_out: int, most: int = MAX_LABELLED, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, text, label, half) of at most ``most`` labelled rows that are not held out, one for each labelled id."""
    ids = F.col("doc_id")
    known = labels.select(F.col(id_col).cast("long").alias("doc_id"), F.col(label).cast("int").alias("label")).where(F.col("label").isNotNull() & (remainder(ids, modulus) != held_out))
    known = known.groupBy("doc_id").agg(F.max("label").alias("label")).orderBy(F.md5(F.concat(F.lit("fit:"), ids.cast("string")).cast("binary")), "doc_id").limit(most)
    return id_and_text(docs, id_col, text_col).join(F.broadcast(known), "doc_id").withColumn("half", F.crc32(F.concat(F.lit("half:"), ids.cast("string")).cast("binary")) % 2)


def candidate_terms(text: str) -> set[str]:
    """Words of at least LEAST_TERM letters, and their beginnings marked by '*'."""
    words = {s for w in set(text.lower().split()) if len(s := w.strip(EDGES)) >= LEAST_TERM}
    return words | {w[:n] + "*" for n in PREFIXES for w in words if len(w) > n}


def log_odds(toxic: float, other: float, toxic_texts: int, other_texts: int) -> float:
    """Smoothed log-odds of a term's rate in toxic texts against its rate in others."""
    rate = lambda n, of: (n + 0.5) / (of - n + 0.5)
    return math.log(rate(toxic, toxic_texts) / rate(other, other_texts))


def mine(sample: DataFrame) -> list[tuple[str, int, int, float]]:
    """(term, toxic texts, other texts, log-odds) of terms whose rate in toxic texts is clearly over that in others, most
    frequent first; equal texts count once. Quoted uses don't rule a term out: rates are set against the class sizes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[bool, Counter] = {True: Counter(), False: Counter()}
        for batch in batches:
            for text, label in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                counts[label == 1].update(candidate_terms(text))
                counts[label == 1][""] += 1  # texts of the class
        terms = list(counts[True].keys() | counts[False].keys())
        if terms:
            yield pa.RecordBatch.from_pydict({"term": terms, "toxic": [counts[True][t] for t in terms], "other": [counts[False][t] for t in terms]})

    texts = sample.where("text is not null").groupBy(F.sha2("text", 256).alias("d")).agg(F.first("text").alias("text"), F.max("label").alias("label"))
    counted = texts.select("text", "label").mapInArrow(run, "term string, toxic long, other long").groupBy("term").agg(F.sum("toxic").alias("toxic"), F.sum("other").alias("other"))
    counted = materialise(counted, "toxicity-terms")
    size = counted.where("term = ''").first()
    if not size or not size["toxic"] or not size["other"]:
        return []
    toxic, other = F.col("toxic"), F.col("other")
    share = size["toxic"] / (size["toxic"] + size["other"])
    part = lambda n, p: F.when(n > 0, n * F.log(n / ((toxic + other) * p))).otherwise(0.0)
    odds = F.log((toxic + 0.5) / (size["toxic"] - toxic + 0.5) / ((other + 0.5) / (size["other"] - other + 0.5)))
    evidence = max(LEAST_EVIDENCE, math.log(counted.count()) + 1)  # as many terms are tried, so many may look toxic by chance
    clear = (toxic >= LEAST_TEXTS) & (odds >= LEAST_ODDS) & (part(toxic, share) + part(other, 1 - share) >= evidence)
    kept = counted.where("term <> ''").where(clear).orderBy(F.desc("toxic"), "term")
    return [(r["term"], r["toxic"], r["other"], log_odds(r["toxic"], r["other"], size["toxic"], size["other"])) for r in kept.collect()]


def lexicon(counts: list[tuple[str, int, int, float]]) -> tuple[list[tuple[str, bool, int]], list[float]]:
    """Terms for the automaton and their log-odds; a term that an accepted beginning covers as well is left out.

    Every word of SURE letters may be misspelled, and every longer beginning; shorter ones are too near to other words.
    """
    by = {t: (a, b) for t, a, b, _ in counts}
    terms, weights = [], []
    for term, toxic, _, odds in counts:
        stem, prefix = term.rstrip("*"), term.endswith("*")
        shorter = [stem[:n] + "*" for n in PREFIXES if n < len(stem)]
        if any(s in by and by[s][0] >= 2 * toxic for s in shorter):
            continue
        terms.append((stem, prefix, 0 if len(stem) < SURE + prefix else 1 + (len(stem) >= 9)))
        weights.append(min(6.0, odds))
    return terms, weights


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0, steps: int = 40) -> tuple[np.ndarray, np.ndarray, np.ndarray, float]:
    """Newton's method on standardised columns: (mean, scale, coefficients, intercept)."""
    mean, scale = x.mean(axis=0), x.std(axis=0)
    scale[scale < 1e-9] = 1.0
    z = np.hstack([(x - mean) / scale, np.ones((len(x), 1))])
    w, penalty = np.zeros(z.shape[1]), np.full(z.shape[1], ridge)
    penalty[-1] = 1e-6
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        step = np.linalg.solve((z * (p * (1 - p) + 1e-9)[:, None]).T @ z + np.diag(penalty), z.T @ (y - p) - penalty * w)
        w = w + step
        if np.abs(step).max() < 1e-8:
            break
    return mean, scale, w[:-1], float(w[-1])


def fit(docs: DataFrame, labels: DataFrame, modulus: int = 4, held_out: int = 2, most: int = MAX_LABELLED, id_col: str = "doc_id", text_col: str = "text") -> Model:
    """A model from at most ``most`` labelled documents; without labels it is one that gives every text the same low score."""
    sample = materialise(labelled_sample(docs, labels, "toxic", modulus, held_out, most, id_col, text_col), "toxicity-sample")
    terms, weights = lexicon(mine(sample.where("half = 0")))
    if not terms:
        return Model()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = Reader(terms, weights)
        for batch in batches:
            found = [reader.features(t) for t in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(found, pa.list_(pa.float64())), batch.column(1)], ["f", "label"])

    rows = sample.where("half = 1").select("text", "label").mapInArrow(run, "f array<double>, label int").toArrow()
    toxic = rows["label"].to_numpy() == 1
    if len(np.unique(toxic)) < 2:
        return Model()
    table = np.column_stack([toxic, rows["f"].combine_chunks().flatten().to_numpy().reshape(len(rows), -1)])
    table = table[np.lexsort(table.T)]  # sums in one order, whatever order the rows came in
    mean, scale, coefficients, intercept = logistic(table[:, 1:], table[:, 0])
    return Model(terms, weights, mean.tolist(), scale.tolist(), coefficients.tolist(), intercept)


def _scores(model: Model, reader: Reader, texts: pa.Array) -> np.ndarray:
    return model.score(np.array([reader.features(t) for t in texts.to_pylist()]).reshape(-1, 9))


def score(docs: DataFrame, model: Model, modulus: int = 4, held_out: int = 2, threshold: float = 0.3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, held_out, score, predicted) for every row, by its text alone.

    Null and empty texts have no hits and get the score of such texts. A row without id is not held out. Repeated rows get
    equal scores; further columns are ignored; an empty table gives no rows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = Reader(model.terms, model.weights)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(_scores(model, reader, batch.column(1)), pa.float64())], ["doc_id", "score"])

    scored = id_and_text(docs, id_col, text_col).mapInArrow(run, "doc_id long, score double")
    return scored.select("doc_id", F.coalesce(remainder(F.col("doc_id"), modulus) == held_out, F.lit(False)).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def keep_clean(docs: DataFrame, model: Model, threshold: float = 0.3, text_col: str = "text") -> DataFrame:
    """``docs`` without the rows whose score reaches the threshold; all columns are kept as they are, nothing is shuffled.

    Null and empty texts get the score of a text without hits; repeated rows stay or go alike; columns may have any name and
    hold nulls; an empty table gives no rows.
    """
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = Reader(model.terms, model.weights)
        for batch in batches:
            yield batch.filter(pa.array(_scores(model, reader, batch.column(at)) < threshold, pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def crc_remainder(doc_id: int, modulus: int) -> int:
    """What ``remainder`` gives, for a Python int."""
    return zlib.crc32(str(doc_id).encode()) % modulus
