"""Models that ``training`` fits on the executors: a tied auto-encoder, and a hyperedge scorer with self-attention.

A hyperedge is (cell, bin1, bin2). Each node has a feature vector; a per-type layer gives its static code, attention among the
three nodes (a node doesn't attend to itself) its dynamic code. The mean of the squared differences, weighed, and what is known
beside the nodes (distance, coverage, what the cell's neighbours have there) give the score. Features are joined to the hyperedges:
no table of features goes through the driver.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from contactspark.operators.training import Arrays, Weights, arrays


@dataclass
class TiedAutoEncoder:
    """Layers of the given widths; the decoder's matrices are the encoder's, turned. Inner layers pass through tanh."""

    widths: list[int]
    linear: bool = False

    def start(self, seed: int = 0, axes: np.ndarray | None = None) -> Weights:
        """Seeded weights; ``axes`` (numbers x components), such as principal ones, become the first layer's."""
        r = np.random.default_rng(seed)
        out: Weights = {}
        for k, (a, b) in enumerate(zip(self.widths, self.widths[1:])):
            out |= {f"w{k}": r.normal(0, (2 / (a + b)) ** 0.5, (a, b)), f"b{k}": np.zeros(b), f"c{k}": np.zeros(a)}
        if axes is not None:
            out["w0"][:, : axes.shape[1]] = axes[:, : self.widths[1]]
        return out

    def _through(self, w: Weights, x: np.ndarray) -> list[np.ndarray]:
        """What each layer gives, down to the code and up again."""
        depth = len(self.widths) - 1
        out = [x]
        for k in range(depth):
            z = out[-1] @ w[f"w{k}"] + w[f"b{k}"]
            out.append(z if self.linear or k == depth - 1 else np.tanh(z))
        for k in reversed(range(depth)):
            z = out[-1] @ w[f"w{k}"].T + w[f"c{k}"]
            out.append(z if self.linear or k == 0 else np.tanh(z))
        return out

    def code(self, w: Weights, x: np.ndarray) -> np.ndarray:
        return self._through(w, x)[len(self.widths) - 1]

    def losses(self, w: Weights, a: Arrays) -> list[tuple[float, Weights]]:
        """Squared error of the rows' numbers (column ``v``), the mean over a row's numbers, summed over rows."""
        x = a["v"].astype(float)
        out, depth = self._through(w, x), len(self.widths) - 1
        gap = out[-1] - x
        g = {k: np.zeros_like(v) for k, v in w.items()}
        d = 2 * gap / x.shape[1]
        for step, k in enumerate(range(depth)):  # up again, the last layer first
            if not self.linear and k:
                d = d * (1 - out[-1 - step] ** 2)
            below = out[-2 - step]
            g[f"c{k}"] += d.sum(axis=0)
            g[f"w{k}"] += d.T @ below
            d = d @ w[f"w{k}"]
        for k in reversed(range(depth)):
            if not self.linear and k < depth - 1:
                d = d * (1 - out[k + 1] ** 2)
            g[f"b{k}"] += d.sum(axis=0)
            g[f"w{k}"] += out[k].T @ d
            d = d @ w[f"w{k}"].T
        return [(float((gap**2).mean(axis=1).sum()), g)]

    def encoded(self, rows: DataFrame, w: Weights) -> DataFrame:
        """(id, v, error): the code of each (id, v) and its mean squared error."""
        kind = dict(rows.dtypes)["id"]

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                if batch.num_rows:
                    x = arrays(batch)["v"].astype(float)
                    out = self._through(w, x)
                    yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out[len(self.widths) - 1].tolist(), pa.list_(pa.float64())), pa.array(((out[-1] - x) ** 2).mean(axis=1))], ["id", "v", "error"])

        return rows.select("id", "v").mapInArrow(run, f"id {kind}, v array<double>, error double")


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


@dataclass
class Scorer:
    """``cell``, ``bin`` and ``side``: how many numbers a cell's, a bin's and a hyperedge's own features have."""

    cell: int
    bin: int
    side: int
    code: int = 16
    heads: int = 8
    width: int = 16

    def start(self, seed: int = 0) -> Weights:
        r = np.random.default_rng(seed)
        glorot = lambda *s: r.normal(0, (2 / (s[-2] + s[-1])) ** 0.5, s)
        w = {"cell": glorot(self.cell, self.code), "bin": glorot(self.bin, self.code), "out": glorot(self.heads * self.width, self.code), "score": r.normal(0, 0.1, self.code), "side": np.zeros(self.side), "bias": np.zeros(())}
        return w | {k: glorot(self.heads, self.code, self.width) for k in ("query", "key", "value")}

    def forward(self, w: Weights, a: Arrays) -> tuple[np.ndarray, dict[str, np.ndarray]]:
        x = [a["cell_v"], a["a_v"], a["b_v"]]
        s = np.stack([np.tanh(x[0] @ w["cell"]), np.tanh(x[1] @ w["bin"]), np.tanh(x[2] @ w["bin"])], axis=1)
        q, k, v = (np.einsum("nic,hcd->nhid", s, w[m]) for m in ("query", "key", "value"))
        e = np.einsum("nhid,nhjd->nhij", q, k) / np.sqrt(self.width)
        e[:, :, range(3), range(3)] = -np.inf
        p = np.exp(e - e.max(axis=-1, keepdims=True))
        p /= p.sum(axis=-1, keepdims=True)
        o = np.einsum("nhij,nhjd->nihd", p, v).reshape(len(s), 3, -1)
        dynamic = np.tanh(o @ w["out"])
        diff = dynamic - s
        pooled = (diff**2).mean(axis=1)
        return pooled @ w["score"] + a["side"] @ w["side"] + w["bias"], {"s": s, "q": q, "k": k, "v": v, "p": p, "o": o, "dynamic": dynamic, "diff": diff, "pooled": pooled}

    def losses(self, w: Weights, a: Arrays) -> list[tuple[float, Weights]]:
        """Cross-entropy of ``label`` on logits, and the squared error of the cells' features from their static codes."""
        z, t = self.forward(w, a)
        x, y = [a["cell_v"], a["a_v"], a["b_v"]], a["label"].astype(float)
        loss = float(np.sum(np.maximum(z, 0) + np.log1p(np.exp(-np.abs(z))) - z * y))
        dz, n = sigmoid(z) - y, len(y)
        g = {"score": t["pooled"].T @ dz, "side": a["side"].T @ dz, "bias": np.array(dz.sum())}
        ddiff = dz[:, None, None] * w["score"] * 2 * t["diff"] / 3
        dpre = ddiff * (1 - t["dynamic"] ** 2)
        g["out"] = np.einsum("nix,nic->xc", t["o"], dpre)
        do = (dpre @ w["out"].T).reshape(n, 3, self.heads, self.width)
        dv = np.einsum("nhij,nihd->nhjd", t["p"], do)
        dp = np.einsum("nihd,nhjd->nhij", do, t["v"])
        de = t["p"] * (dp - (dp * t["p"]).sum(axis=-1, keepdims=True)) / np.sqrt(self.width)
        dq, dk = np.einsum("nhij,nhjd->nhid", de, t["k"]), np.einsum("nhij,nhid->nhjd", de, t["q"])
        ds = -ddiff
        for name, d in (("query", dq), ("key", dk), ("value", dv)):
            g[name] = np.einsum("nic,nhid->hcd", t["s"], d)
            ds = ds + np.einsum("nhid,hcd->nic", d, w[name])
        ds = ds * (1 - t["s"] ** 2)
        g["cell"] = x[0].T @ ds[:, 0]
        g["bin"] = x[1].T @ ds[:, 1] + x[2].T @ ds[:, 2]

        s = t["s"][:, 0]
        gap = s @ w["cell"].T - x[0]
        back = 2 * gap / self.cell
        recon = {k: np.zeros_like(v) for k, v in w.items()}
        recon["cell"] = back.T @ s + x[0].T @ ((back @ w["cell"]) * (1 - s**2))
        return [(loss, g), (float((gap**2).mean(axis=1).sum()), recon)]


def standardised(rows: DataFrame) -> DataFrame:
    """(id, v): each number of the vectors less its mean, over its deviation; constant ones are 0. Missing numbers count as 0."""
    width = rows.agg(F.max(F.size("v"))).first()[0] or 0
    number = lambda i: F.coalesce(F.get("v", F.lit(i)), F.lit(0.0)).cast("double")
    found = rows.agg(*[f(number(i)) for i in range(width) for f in (F.avg, F.stddev_pop)]).first() if width else []
    return rows.select("id", F.array(*[(number(i) - (found[2 * i] or 0.0)) / float(found[2 * i + 1] or 0.0) if (found[2 * i + 1] or 0.0) > 1e-12 else F.lit(0.0) for i in range(width)]).cast("array<double>").alias("v"))


def featured(edges: DataFrame, cells: DataFrame, bins: DataFrame, evidence: DataFrame | None = None) -> DataFrame:
    """``edges`` (cell_id, a, b, ...) with ``cell_v``, ``a_v``, ``b_v`` and ``side``.

    ``cells`` and ``bins`` (id, v, coverage); rows without features are left out. ``side``: two terms of the distance, the
    coverages of the three nodes, and of ``evidence`` (cell_id, a, b, v), such as the neighbours' maps, log1p; 0 if there is none.
    """
    out = edges
    for key, table in (("cell", cells), ("a", bins), ("b", bins)):
        on = "cell_id" if key == "cell" else key
        out = out.join(table.select(F.col("id").alias(on), F.col("v").alias(f"{key}_v"), F.col("coverage").alias(f"{key}_c")), on)
    known = F.lit(0.0)
    if evidence is not None:
        out = out.join(evidence.select("cell_id", "a", "b", F.col("v").alias("__known")), ["cell_id", "a", "b"], "left")
        known = F.log1p(F.coalesce("__known", F.lit(0.0)))
    gap = F.abs(F.col("b") - F.col("a")).cast("double")
    side = F.array(F.log1p(gap), gap / 100, "cell_c", "a_c", "b_c", known)
    return out.select(*edges.columns, "cell_v", "a_v", "b_v", side.alias("side"))


def impute(model: Scorer, weights: Weights, pairs: DataFrame, activation: str = "sigmoid") -> DataFrame:
    """``pairs`` (cell_id, a, b and what ``featured`` adds) as (cell_id, a, b, p), in batches on the executors; weights go along."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                z, _ = model.forward(weights, arrays(batch.select(["cell_v", "a_v", "b_v", "side"])))
                yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(sigmoid(z) if activation == "sigmoid" else np.logaddexp(0, z))], ["cell_id", "a", "b", "p"])

    return pairs.select(*[F.col(c).cast("long").alias(c) for c in ("cell_id", "a", "b")], "cell_v", "a_v", "b_v", "side").mapInArrow(run, "cell_id long, a long, b long, p double")
