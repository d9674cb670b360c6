"""Document quality by attention-based multiple-instance learning.

A document is a bag of passages. A passage is encoded from its words - hashed words and word pairs, through a learned
embedding - and from shares of its kinds of characters; gated attention weighs the passages; the weighted sum of their codes
gives the document's score. Only documents have labels, so attention learns which passages tell.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from contactspark.llm.common import id_and_text
from contactspark.llm.toxicity import labelled_sample, remainder

#: Labelled documents, and bytes of their texts, that a model is fitted on at most: whole documents by the least hash of
#: their id, as many as fit. Every passage of them counts, and scoring reads every passage of every text.
MAX_LABELLED, MAX_FIT_BYTES = 6_000, 64 << 20
PASSAGE_WORDS = 80
BUCKETS, EMBED, CODE, GATE = 4096, 8, 16, 8
AT_ONCE = 1 << 17  # bytes of texts that are scored at once; a longer one alone
REPEAT = 6  # words in a run that counts as repeated within its document

_KINDS = np.full(256, 11, np.uint8)
_KINDS[:128] = 10
for _kind, _letters in enumerate((range(65, 91), range(97, 123), range(48, 58), b" ", b".", b",", b"!?", b"|", b"*", b"%$&#")):
    for _letter in _letters:
        _KINDS[_letter] = _kind
N_KINDS, N_FEATURES = 12, 17
_SPACE = ord(" ")
_ODD = np.uint64(0x9E3779B97F4A7C15)

#: A document: figures (a row for each passage), buckets of all words and pairs, how many of these each passage has.
Bag = tuple[np.ndarray, np.ndarray, np.ndarray]


def _word_hashes(whole: str, n: int) -> np.ndarray:
    """A number for each of the ``n`` words of a text, which stand a space apart; no letter's small form depends on what is beyond a space."""
    return np.fromiter(map(zlib.crc32, whole.lower().encode("utf-8", "replace").split(b" ")), np.uint64, n) + np.uint64(1)


def passages(text: str | None) -> Bag:
    """The passages of PASSAGE_WORDS words; a text without words is one passage without any."""
    return all_passages([text])[:3]


def all_passages(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """``joined`` passages of several texts, made at once; nothing of a text counts for another one."""
    lists = [(t or "").split() for t in texts]
    lengths = np.array([len(w) for w in lists])
    many = np.maximum(-(-lengths // PASSAGE_WORDS), 1)
    starts, ends = np.cumsum(many) - many, np.cumsum(lengths)
    nth = np.arange(many.sum()) - np.repeat(starts, many)
    sizes = np.minimum(np.repeat(lengths, many) - nth * PASSAGE_WORDS, PASSAGE_WORDS)
    out = np.zeros((len(sizes), N_FEATURES))
    words = list(chain.from_iterable(lists))
    if not words:
        return out, np.zeros(0, np.int32), sizes, starts
    n = sizes[sizes > 0]
    at = np.cumsum(n) - n
    single = _word_hashes(whole := " ".join(words), len(words)) * _ODD
    after = np.append(single[1:], 0).astype(np.uint64)
    after[ends[lengths > 0] - 1] = 0
    pair = (single ^ after >> np.uint64(7)) * _ODD
    counts, size = _byte_kinds(whole, at)
    doubled = np.flatnonzero(single[1:] == single[:-1])
    doubled = [i for i in doubled[~np.isin(doubled + 1, at)].tolist() if words[i] == words[i + 1]]
    out[sizes > 0] = np.column_stack([
        counts / np.maximum(size, 1)[:, None],
        [len(set(words[i:j])) for i, j in zip(at.tolist(), (at + n).tolist())] / n,
        np.bincount(np.searchsorted(at, doubled, "right") - 1, minlength=len(at)) / n,
        np.log(size / n),
        n / PASSAGE_WORDS,
        np.add.reduceat(_repeated(single, ends - lengths, ends), at) / n,
    ])
    buckets = np.empty(2 * len(words), np.int32)
    buckets[::2], buckets[1::2] = single >> np.uint64(52), pair >> np.uint64(52)
    return out, buckets, 2 * sizes, starts


def _byte_kinds(whole: str, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """How many bytes of each kind the passages have that begin at words ``at``, and how many in all. A space stands between each two
    words; one between two passages is in none."""
    raw = np.frombuffer(whole.encode("utf-8", "replace"), np.uint8)
    size = np.diff(np.concatenate([[0], np.flatnonzero(raw == _SPACE)[at[1:] - 1] + 1, [len(raw)]]))
    counts = np.bincount(np.repeat(np.arange(len(at)) * N_KINDS, size) + _KINDS[raw], minlength=len(at) * N_KINDS).reshape(-1, N_KINDS)
    counts[:-1, _KINDS[_SPACE]] -= 1
    size[:-1] -= 1
    return counts, size


def _repeated(single: np.ndarray, begins: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """1 for each word that begins a run of REPEAT words which its text has twice; a text's words lie from ``begins`` to ``ends``."""
    run = single.copy()
    for i in range(1, min(REPEAT, len(run))):
        head = run[:-i]
        head *= _ODD
        head += single[i:]
    again = np.zeros(len(run))
    for a, b in zip(begins.tolist(), (ends - REPEAT + 1).tolist()):
        if b > a + 1:
            ordered = np.sort(run[a:b])
            twice = ordered[1:][ordered[1:] == ordered[:-1]]
            if len(twice):
                again[a:b] = twice[np.searchsorted(twice, run[a:b]).clip(max=len(twice) - 1)] == run[a:b]
    return again


def joined(bags: list[Bag]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(figures, buckets, sizes, first passage of each bag) of several documents."""
    starts = np.cumsum([0] + [len(b[0]) for b in bags[:-1]])
    return *(np.concatenate([b[i] for b in bags]) for i in range(3)), starts


@dataclass
class Model:
    mean: np.ndarray
    scale: np.ndarray
    weights: dict[str, np.ndarray]

    def bags(self, x: np.ndarray, buckets: np.ndarray, sizes: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, dict[str, np.ndarray]]:
        """Logits of the bags that begin at ``starts``, and what the gradient needs."""
        w = self.weights
        words, full = np.zeros((len(sizes), EMBED)), sizes > 0
        if len(buckets):
            words[full] = np.add.reduceat(w["embed"].take(buckets, axis=0), (np.cumsum(sizes) - sizes)[full], axis=0) / sizes[full, None]
        z = np.hstack([(x - self.mean) / self.scale, words])
        h = np.tanh(z @ w["encode"] + w["encode_0"])
        tanh, gate = np.tanh(h @ w["attend"]), 1 / (1 + np.exp(-np.clip(h @ w["gate"], -30, 30)))
        a = (tanh * gate) @ w["weigh"]
        size = np.diff(np.append(starts, len(x)))
        e = np.exp(a - np.repeat(np.maximum.reduceat(a, starts), size))
        p = e / np.repeat(np.add.reduceat(e, starts), size)
        code = np.add.reduceat(p[:, None] * h, starts, axis=0)
        return code @ w["score"] + w["score_0"], {"z": z, "h": h, "tanh": tanh, "gate": gate, "p": p, "code": code, "size": size}

    def scores(self, bags: list[Bag]) -> np.ndarray:
        return self.joined_scores(*joined(bags))

    def joined_scores(self, x: np.ndarray, buckets: np.ndarray, sizes: np.ndarray, starts: np.ndarray) -> np.ndarray:
        logit, _ = self.bags(x, buckets, sizes, starts)
        return 1 / (1 + np.exp(-np.clip(logit, -30, 30)))

    def gradient(self, x: np.ndarray, buckets: np.ndarray, sizes: np.ndarray, starts: np.ndarray, y: np.ndarray) -> dict[str, np.ndarray]:
        w = self.weights
        logit, s = self.bags(x, buckets, sizes, starts)
        d = (1 / (1 + np.exp(-np.clip(logit, -30, 30))) - y) / len(y)
        dcode = np.repeat(d[:, None] * w["score"], s["size"], axis=0)
        dp = (dcode * s["h"]).sum(axis=1)
        da = s["p"] * (dp - np.repeat(np.add.reduceat(s["p"] * dp, starts), s["size"]))
        dtanh = da[:, None] * w["weigh"] * s["gate"] * (1 - s["tanh"] ** 2)
        dgate = da[:, None] * w["weigh"] * s["tanh"] * s["gate"] * (1 - s["gate"])
        dh = (s["p"][:, None] * dcode + dtanh @ w["attend"].T + dgate @ w["gate"].T) * (1 - s["h"] ** 2)
        dwords = (dh @ w["encode"].T)[:, N_FEATURES:] / np.maximum(sizes, 1)[:, None]
        embed = np.stack([np.bincount(buckets, np.repeat(d, sizes), BUCKETS) for d in dwords.T], axis=1)
        return {"score": s["code"].T @ d, "score_0": d.sum(), "weigh": (s["tanh"] * s["gate"]).T @ da, "attend": s["h"].T @ dtanh, "gate": s["h"].T @ dgate, "encode": s["z"].T @ dh, "encode_0": dh.sum(axis=0), "embed": embed}


def new_model(seed: int = 3) -> Model:
    r = np.random.default_rng(seed)
    shapes = {"encode": (N_FEATURES + EMBED, CODE), "encode_0": (CODE,), "attend": (CODE, GATE), "gate": (CODE, GATE), "weigh": (GATE,), "score": (CODE,), "score_0": ()}
    weights = {k: np.zeros(s) if k.endswith("_0") else r.normal(0, (2 / (s[0] + s[-1])) ** 0.5, s) for k, s in shapes.items()}
    return Model(np.zeros(N_FEATURES), np.ones(N_FEATURES), weights | {"embed": r.normal(0, 0.3, (BUCKETS, EMBED))})


def train(bags: list[Bag], labels: np.ndarray, epochs: int = 15, batch: int = 64, rate: float = 0.01, decay: float = 1e-4, seed: int = 3) -> Model:
    """Adam on the cross-entropy of the bags' labels."""
    model, r = new_model(seed), np.random.default_rng(seed)
    everything = np.concatenate([b[0] for b in bags])
    model.mean, model.scale = everything.mean(axis=0), everything.std(axis=0) + 1e-3
    share = min(max(labels.mean(), 1e-3), 1 - 1e-3)
    model.weights["score_0"] = np.array(np.log(share / (1 - share)))
    m = {k: np.zeros_like(v) for k, v in model.weights.items()}
    v = {k: np.zeros_like(x) for k, x in model.weights.items()}
    step, steps = 0, max(1, epochs * -(-len(bags) // batch))
    while step < max(steps, 400):  # few documents are read more often
        order = r.permutation(len(bags))
        for at in range(0, len(order), batch):
            g = model.gradient(*joined([bags[i] for i in order[at : at + batch]]), labels[order[at : at + batch]])
            step += 1
            for k in g:
                grad = g[k] + (0 if k.endswith("_0") else decay * model.weights[k])
                m[k], v[k] = 0.9 * m[k] + 0.1 * grad, 0.999 * v[k] + 0.001 * grad**2
                model.weights[k] = model.weights[k] - rate * max(0.02, 1 - step / max(steps, 400)) * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.999**step)) + 1e-8)
    return model


def fit(docs: DataFrame, labels: DataFrame, modulus: int = 3, held_out: int = 1, most: int = MAX_LABELLED, most_bytes: int = MAX_FIT_BYTES, id_col: str = "doc_id", text_col: str = "text") -> Model | None:
    """A model from at most ``most`` labelled documents of at most ``most_bytes`` in all; None if their labels don't differ.

    Labels without id or value, held-out ids and labels of unknown documents take no part; of several labels of an id the
    largest counts; null texts count as empty; rows that repeat id and text count once; further columns are ignored. Documents
    are taken in a seeded order by their lengths alone; one that doesn't fit into what is left of the bytes is skipped.
    """
    sample = labelled_sample(docs, labels, "quality", modulus, held_out, most, id_col, text_col)
    mark = F.xxhash64(F.coalesce("text", F.lit("")))
    sizes = sample.groupBy("doc_id", mark.alias("mark")).agg(F.max(F.coalesce(F.octet_length("text"), F.lit(0)) + 1).alias("size"))
    kept, left = [], most_bytes
    for r in sizes.orderBy(F.xxhash64("doc_id"), "doc_id", "mark").limit(most).collect():  # at most ``most`` rows without texts
        if r["size"] <= left:
            kept.append((r["doc_id"], r["mark"], len(kept)))
            left -= r["size"]
    if not kept:
        return None
    chosen = F.broadcast(docs.sparkSession.createDataFrame(kept, "doc_id long, mark long, at long"))
    sample = sample.withColumn("mark", mark).join(chosen, ["doc_id", "mark"]).dropDuplicates(["at"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bags = [passages(t) for t in batch.column(1).to_pylist()]
            lists = [pa.array([b[i].ravel() for b in bags], pa.list_(k)) for i, k in enumerate((pa.float32(), pa.int32(), pa.int64()))]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), *lists], ["at", "label", "figures", "buckets", "sizes"])

    rows = sample.select("at", "text", "label").mapInArrow(run, "at long, label int, figures array<float>, buckets array<int>, sizes array<long>").toArrow().sort_by("at")
    y = rows["label"].to_numpy() == 1
    if len(np.unique(y)) < 2:
        return None
    bags = [(f.values.to_numpy().astype(np.float64).reshape(-1, N_FEATURES), b.values.to_numpy(), s.values.to_numpy()) for f, b, s in zip(rows["figures"], rows["buckets"], rows["sizes"])]
    return train(bags, y.astype(float))


def at_once(texts: pa.Array) -> int:
    """How many of the first texts have AT_ONCE bytes in all, but one at least."""
    sizes = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False))
    return max(1, int(np.searchsorted(sizes, AT_ONCE, "right")))


def score(docs: DataFrame, model: Model | None, modulus: int = 3, held_out: int = 1, threshold: float = 0.5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, held_out, score, predicted, passages) for every row, by its text alone.

    Null and empty texts are one empty passage. Without a model every score is 0.5. A row without id is not held out.
    Repeated rows get equal scores; further columns are ignored; an empty table gives no rows.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = sent.value
        for batch in batches:
            at = 0
            while at < batch.num_rows:
                some = batch.slice(at, at_once(batch.column(1).slice(at)))
                bags = all_passages(some.column(1).to_pylist())
                s = np.full(some.num_rows, 0.5) if model is None else model.joined_scores(*bags)
                yield pa.RecordBatch.from_arrays([some.column(0), pa.array(s, pa.float64()), pa.array(np.diff(bags[3], append=len(bags[0])), pa.int32())], ["doc_id", "score", "passages"])
                at += some.num_rows

    scored = id_and_text(docs, id_col, text_col).mapInArrow(run, "doc_id long, score double, passages int")
    return scored.select("doc_id", F.coalesce(remainder(F.col("doc_id"), modulus) == held_out, F.lit(False)).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"), "passages")
