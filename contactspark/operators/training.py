"""Training of small models on tables: rows stay where they are, weights go out and sums come back.

A round is one pass. Each task starts from the weights that were sent; either it sums the gradient over its rows, for one step on
the driver, or it takes steps of its own over its rows in batches and returns its weights times its rows, which are averaged. All
that comes back are vectors that can be added, so those of very many tasks are summed by tasks before the driver gets them. Losses
of held-out rows, and the gradient of each loss there, belong to the weights that the round began with.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

Weights = dict[str, np.ndarray]
Arrays = dict[str, np.ndarray]
#: (weights, rows) -> for each loss (its sum over the rows, the gradient of that sum).
Losses = Callable[[Weights, Arrays], list[tuple[float, Weights]]]

#: Tasks whose vectors the driver sums itself.
DIRECT = 128


def arrays(batch: pa.RecordBatch) -> Arrays:
    """Columns as arrays; lists of one length become matrices."""
    out = {}
    for name, column in zip(batch.schema.names, batch.columns):
        if pa.types.is_list(column.type):
            out[name] = column.flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1) if batch.num_rows else np.zeros((0, 0))
        else:
            out[name] = column.to_numpy(zero_copy_only=False)
    return out


def flat(weights: Weights) -> np.ndarray:
    return np.concatenate([np.ravel(weights[k]) for k in sorted(weights)]) if weights else np.zeros(0)


def shaped(vector: np.ndarray, like: Weights) -> Weights:
    out, at = {}, 0
    for k in sorted(like):
        size = np.size(like[k])
        out[k] = vector[at : at + size].reshape(np.shape(like[k]))
        at += size
    return out


class Adam:
    def __init__(self, size: int, rate: float) -> None:
        self.rate, self.m, self.v, self.steps = rate, np.zeros(size), np.zeros(size), 0.0

    def step(self, weights: np.ndarray, gradient: np.ndarray) -> np.ndarray:
        self.steps += 1
        self.m, self.v = 0.9 * self.m + 0.1 * gradient, 0.999 * self.v + 0.001 * gradient**2
        return weights - self.rate * (self.m / (1 - 0.9**self.steps)) / (np.sqrt(self.v / (1 - 0.999**self.steps)) + 1e-8)


@dataclass
class Round:
    """Mean losses of a round's beginning over held-out rows (over all rows if none are held out), and what the losses weighed."""

    losses: list[float]
    norms: list[float]
    shares: list[float]
    rows: int
    weighted: float = field(default=0.0)


def summed(parts: DataFrame, tasks: int, size: int) -> np.ndarray:
    """Sum of the vectors (m binary)."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size)
        for batch in batches:
            for m in batch.column(0):
                total += np.frombuffer(m.as_py())
        yield pa.RecordBatch.from_pydict({"m": pa.array([total.tobytes()], pa.binary())})

    if tasks > DIRECT:
        parts = parts.repartition(int(tasks**0.5)).mapInArrow(add, "m binary")
    return sum((np.frombuffer(r["m"]) for r in parts.collect()), np.zeros(size))


def train(
    rows: DataFrame,
    weights: Weights,
    losses: Losses,
    rounds: int,
    kinds: int = 1,
    rate: float = 1e-3,
    batch: int = 0,
    held: str | None = None,
    pick: Callable[[Arrays, int, np.random.Generator], np.ndarray] | None = None,
    shares: list[float] | None = None,
    balance: tuple[int, str, float] | None = None,
    least: float = 0.01,
    patience: int | None = None,
    seed: int = 0,
) -> tuple[Weights, list[Round]]:
    """(weights, a ``Round`` for each round and one for the end) by Adam on the sum of ``kinds`` losses.

    ``batch`` 0: one step a round with the mean gradient of all rows; else local steps over batches of so many rows, then the
    mean of the tasks' weights and moments. ``held``: a boolean column; its rows only measure. ``pick``: a mask of the rows that a
    round trains on. ``shares``: what each loss weighs, 1 if not given. ``balance`` (loss, name, factor): that loss weighs as much
    as makes the norm of its gradient with respect to the named weights ``factor`` times that of the first loss, measured anew in
    each round. ``patience``: stop when the weighted loss hasn't fallen by the share ``least`` in so many rounds; the weights are
    those of the best round. Rows should be a written table, as each round reads them again; for local steps, dealt
    so that each task has some of every kind. No rows: the weights as they are.
    """
    spark, size = rows.sparkSession, len(flat(weights))
    adam = Adam(size, rate)
    shares = list(shares or [1.0] * kinds)
    vector = flat(weights)
    length = 3 + kinds * (1 + size) + 3 * size + 1
    history: list[Round] = []
    best, best_vector, since, tasks = np.inf, vector, 0, 1

    for turn in range(rounds + 1):
        sent = spark.sparkContext.broadcast((vector, adam.m, adam.v, adam.steps, shares))  # weights and their moments

        def run(batches: Iterator[pa.RecordBatch], turn: int = turn) -> Iterator[pa.RecordBatch]:
            start, m, v, steps, weigh = sent.value
            here = shaped(start, weights)
            own = Adam(size, rate)
            own.m, own.v, own.steps = m, v, steps
            moved, n, measured = start, 0, 0
            sums, gradients, pulled = np.zeros(kinds), np.zeros((kinds, size)), np.zeros(size)
            r = np.random.default_rng([seed, turn, TaskContext.get().partitionId()])
            for table in batches:
                a = arrays(table)
                out = a[held].astype(bool) if held else np.ones(table.num_rows, bool)
                if out.any():
                    measured += int(out.sum())
                    for k, (loss, g) in enumerate(losses(here, {c: x[out] for c, x in a.items()})):
                        sums[k] += loss
                        gradients[k] += flat(g)
                use = ~out if held else out
                if pick:
                    use = use & pick(a, turn, r)
                order = np.flatnonzero(use)
                n += len(order)
                if batch and turn < rounds:
                    r.shuffle(order)
                    for at in range(0, len(order), batch):
                        some = order[at : at + batch]
                        g = sum(w * flat(g) for w, (_, g) in zip(weigh, losses(shaped(moved, weights), {c: x[some] for c, x in a.items()})))
                        moved = own.step(moved, g / len(some))
                elif held and turn < rounds:
                    pulled += sum(w * flat(g) for w, (_, g) in zip(weigh, losses(here, {c: x[order] for c, x in a.items()})))
            back = [[1, n, measured], sums, gradients.ravel(), moved * n if batch else pulled, own.m * n, own.v * n, [own.steps * n]]
            yield pa.RecordBatch.from_pydict({"m": pa.array([np.concatenate(back).tobytes()], pa.binary())})

        total = summed(rows.mapInArrow(run, "m binary"), tasks, length)
        sent.destroy()
        tasks, n, measured, at = int(total[0]), total[1], max(total[2], 1.0), 3 + kinds
        if not total[2] and not n:
            return weights, history
        gradients = total[at : at + kinds * size].reshape(kinds, size) / measured
        rest = total[at + kinds * size :]
        named = [np.linalg.norm(shaped(g, weights)[balance[1]]) if balance else float(np.linalg.norm(g)) for g in gradients]
        now = Round((total[3:at] / measured).tolist(), [float(x) for x in named], list(shares), int(n))
        if balance:
            which, _, factor = balance
            shares[which] = float(factor * named[0] / named[which]) if named[which] > 0 else 0.0
            now.shares = list(shares)
        now.weighted = float(sum(w * x for w, x in zip(shares, now.losses)))
        history.append(now)
        if now.weighted < best * (1 - least):
            best, best_vector, since = now.weighted, vector, 0
        else:
            since += 1
            if now.weighted < best:
                best, best_vector = now.weighted, vector
        if turn == rounds or (patience and since >= patience) or not n:
            break
        if batch:
            vector, adam.m, adam.v, adam.steps = rest[:size] / n, rest[size : 2 * size] / n, rest[2 * size : 3 * size] / n, rest[3 * size] / n
        elif held:
            vector = adam.step(vector, rest[:size] / n)
        else:
            vector = adam.step(vector, sum(w * g for w, g in zip(shares, gradients)))
    return shaped(best_vector if patience else vector, weights), history
