"""Benchmark decontamination by pigeonhole edit matching.

A test item of n normalised bytes may differ by k = floor(rate * n) edits. Cut into k + 1 pieces, at least one piece of any
such copy is untouched, so exact hits of pieces (one Aho-Corasick pass) give every candidate, and Myers' bit-parallel
distance decides.
"""

from __future__ import annotations

import string
import uuid
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from contactspark.llm.common import id_and_text, materialise

_SPACES = bytes.maketrans((string.punctuation + string.whitespace).encode(), b" " * len(string.punctuation + string.whitespace))
SCHEMA = "doc_id long, item_id long, distance int, start long, end long, item_length int"
LEAK_NAMES = ["doc_id", "item_id", "distance", "start", "end", "item_length"]
LEAK_TYPES = [pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int32()]


def normalise(text: str | None) -> str:
    """Lower case, runs of ASCII punctuation and white space as one space; one character for each UTF-8 byte."""
    if not text:
        return ""
    return b" ".join(text.lower().encode("utf-8", "replace").translate(_SPACES).split()).decode("latin-1")


def pieces(item: str, budget: int) -> list[tuple[int, str]]:
    """``budget + 1`` pieces that cover the item: (offset, piece)."""
    n = budget + 1
    cuts = [len(item) * i // n for i in range(n + 1)]
    return [(a, item[a:b]) for a, b in zip(cuts, cuts[1:]) if b > a]


def masks(item: str) -> dict[str, int]:
    out: dict[str, int] = {}
    for i, c in enumerate(item):
        out[c] = out.get(c, 0) | 1 << i
    return out


def best_end(item_masks: dict[str, int], length: int, text: str) -> tuple[int, int]:
    """Myers: the least distance of the item to any substring of ``text``, and the first end (exclusive) that has it."""
    ones, top = (1 << length) - 1, 1 << (length - 1)
    pv, mv, score, best, end = ones, 0, length, length, 0
    for j, c in enumerate(text, 1):
        eq = item_masks.get(c, 0)
        xv = eq | mv
        xh = (((eq & pv) + pv) ^ pv) | eq
        ph = mv | (~(xh | pv) & ones)
        mh = pv & xh
        if ph & top:
            score += 1
        elif mh & top:
            score -= 1
        ph = ph << 1 & ones
        mh = mh << 1 & ones
        pv = mh | (~(xv | ph) & ones)
        mv = ph & xv
        if score < best:
            best, end = score, j
    return best, end


class Matcher:
    def __init__(self, items: Iterable[tuple[int, str]], rate: float):
        import ahocorasick

        self.items, by_piece = [], {}
        for item_id, item in items:
            budget = int(rate * len(item))
            at = len(self.items)
            self.items.append((item_id, item, budget, masks(item), masks(item[::-1])))
            for offset, piece in pieces(item, budget):
                by_piece.setdefault(piece, []).append((at, offset))
        self.automaton = ahocorasick.Automaton()
        for piece, where in by_piece.items():
            self.automaton.add_word(piece, (len(piece), where))
        if by_piece:
            self.automaton.make_automaton()
        self.empty = not by_piece

    def find(self, text: str) -> list[tuple[int, int, int, int, int]]:
        """(item_id, distance, start, end, length) of each item that ``text`` holds within the item's budget."""
        if self.empty or not text:
            return []
        diagonals: dict[int, set[int]] = {}
        for last, (size, where) in self.automaton.iter(text):
            for at, offset in where:
                diagonals.setdefault(at, set()).add(last + 1 - size - offset)
        out = []
        for at, found in diagonals.items():
            item_id, item, budget, forward, backward = self.items[at]
            best, best_to = budget + 1, -1
            for low, high in self._merged(sorted(found), 2 * budget):
                base = max(0, low - budget)
                window = text[base : high + len(item) + budget]
                exact = window.find(item) if budget else self._word(text, item, base, high + len(item)) - base
                distance, end = (0, exact + len(item)) if exact >= 0 else best_end(forward, len(item), window) if budget else (1, -1)
                if distance < best:
                    best, best_to = distance, base + end
                if best == 0:
                    break
            if best <= budget:
                back = text[max(0, best_to - len(item) - best) : best_to][::-1]
                _, length = best_end(backward, len(item), back) if best else (0, len(item))
                out.append((item_id, best, best_to - length, best_to, len(item)))
        return out

    @staticmethod
    def _word(text: str, item: str, low: int, high: int) -> int:
        """Where ``item`` stands in ``text[low:high]`` from border to border of words; below ``low`` if nowhere.

        A border is an end of the text or a space. Where the item itself begins or ends outside ASCII, as in scripts without
        spaces, none is asked for.
        """
        at = text.find(item, low, high)
        while at >= 0:
            end = at + len(item)
            if (at == 0 or text[at - 1] == " " or item[0] > "\x7f") and (end == len(text) or text[end] == " " or item[-1] > "\x7f"):
                return at
            at = text.find(item, at + 1, high)
        return low - 1

    @staticmethod
    def _merged(diagonals: list[int], gap: int) -> Iterator[tuple[int, int]]:
        low = high = diagonals[0]
        for d in diagonals[1:]:
            if d - high > gap:
                yield low, high
                low = d
            high = d
        yield low, high


_READY: dict[str, Matcher] = {}


def _matcher(name: str, block: Broadcast, rate: float) -> Matcher:
    """The matcher of a block, built once in each Python worker."""
    if name not in _READY:
        _READY.clear()
        _READY[name] = Matcher(block.value, rate)
    return _READY[name]


def _blocks(items: DataFrame, limit: int) -> Iterator[tuple[str, Broadcast]]:
    """The normalised items in blocks of at most ``limit`` bytes (or one item), sent to the executors one by one."""
    context = items.sparkSession.sparkContext
    block, size = [], 0
    for row in items.toLocalIterator():
        text = normalise(row["text"])
        if not text or row["doc_id"] is None:
            continue
        if block and size + len(text) > limit:
            yield uuid.uuid4().hex, context.broadcast(block)
            block, size = [], 0
        block.append((row["doc_id"], text))
        size += len(text)
    yield uuid.uuid4().hex, context.broadcast(block)


def leaks(docs: DataFrame, benchmark: DataFrame, rate: float = 0.06, block_bytes: int = 8_000_000, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """(doc_id, item_id, distance, start, end, item_length): every item that a document holds within its error budget.

    Places are bytes of the normalised text. The items reach the tasks in blocks of at most ``block_bytes``, one pass over
    the documents for each block; with more than one block a pass is written before the next is sent and its block freed, so what
    the tasks hold has a fixed bound however large the benchmark is. Null or empty texts hold nothing; items that are null,
    without id, or without a letter or digit take no part; an item whose budget is 0, as of every short one, is searched as it
    stands, from border to border of words; repeated documents each get their rows, repeated items each theirs; of several
    places with the least distance the first found is given.
    """

    def matches(name: str, block: Broadcast) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            find = _matcher(name, block, rate).find
            for batch in batches:
                rows = [(doc, *hit) for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()) for hit in find(normalise(text))]
                yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(LEAK_TYPES)], LEAK_NAMES)

        return id_and_text(docs, id_col, text_col).where(F.length("text") > 0).mapInArrow(run, SCHEMA)

    out, waiting = None, None
    for name, block in _blocks(id_and_text(benchmark, item_col, item_text_col), block_bytes):
        if waiting:
            out = _and(out, materialise(matches(*waiting), "leaks"))
            waiting[1].unpersist()
        waiting = name, block
    return _and(out, matches(*waiting))


def _and(some: DataFrame | None, more: DataFrame) -> DataFrame:
    return more if some is None else some.unionByName(more)


def decontaminate(docs: DataFrame, benchmark: DataFrame, rate: float = 0.06, block_bytes: int = 8_000_000, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """``docs`` without the rows that hold a test item, all columns kept as they are. Nothing is shuffled.

    One narrow pass for each block of items, written out before the next, so a task holds one block's automaton. Rows with a
    null or empty text stay, and so does every row if there are no items; repeated rows stay or go alike; columns may have
    any name and hold nulls; an empty table gives no rows.
    """
    schema, text_at, out, last = docs.schema, docs.columns.index(text_col), docs, None
    for name, block in _blocks(id_and_text(benchmark, item_col, item_text_col), block_bytes):

        def run(batches: Iterator[pa.RecordBatch], name: str = name, block: Broadcast = block) -> Iterator[pa.RecordBatch]:
            find = _matcher(name, block, rate).find
            for batch in batches:
                yield batch.filter(pa.array([not find(normalise(text)) for text in batch.column(text_at).to_pylist()], pa.bool_()))

        if last:
            out = materialise(out, "decontaminated")
            last.unpersist()
        out, last = out.mapInArrow(run, schema), block
    return out
