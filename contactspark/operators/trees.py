"""Ward's agglomeration as rounds of joins: in each round all pairs that are each other's nearest become one cluster.

Ward's distance follows from sizes and centres, n m / (n + m) |a - b|^2, so a merged cluster needs no table of distances: its size
and centre are sums. A merge never brings two clusters nearer than either was, so merging all mutual pairs at once gives the same
tree as merging the closest pair again and again. Equal distances are ordered by a hash of the two ids. A cluster keeps a list of
its nearest ones and how near all others can be. A round leads all clusters past new ones and those whose list is used up; a new one is
told to all that have it nearer than that.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import md5

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from contactspark.operators.grid import Rows, packed, sweep
from contactspark.operators.order import place
from contactspark.operators.tables import materialise

#: Clusters that one task finishes.
LAST = 16384

#: Clusters that a list has at most, and what a product of short floats may be off by at most, as a share of both squares.
LIST, ROUGH = 8, 1e-5


def _order(a: int, b: int) -> str:
    return md5(f"{min(a, b)}:{max(a, b)}".encode()).hexdigest()


def _bounding(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
    """(left, right, scale): left @ right times scale is at most the square of the distance of each two rows, and less by ``ROUGH`` of both
    squares or so. Rows are moved to their middle and scaled before they become short; those that are no numbers are far."""
    known = [np.isfinite(x).all(axis=1, keepdims=True) for x in (a, b)]
    middle = a.mean(axis=0, where=known[0]) if known[0].any() else np.zeros(a.shape[1])
    a, b = (np.where(k, x - middle, 0.0) for k, x in zip(known, (a, b)))
    long = max(float(np.abs(x).max(initial=0.0)) for x in (a, b))
    kind, long = (np.float32, long) if 1e-100 < long < 1e100 else (np.float64, 1.0)
    a, b = a / long, b / long
    share = 1 - ROUGH * max(1, a.shape[1] / 64)
    squares = [np.where(k, (x**2).sum(axis=1, keepdims=True) * share, np.inf) for k, x in zip(known, (a, b))]
    left, right = np.hstack([-2 * a, squares[0], np.ones((len(a), 1))]), np.hstack([b, np.ones((len(b), 1)), squares[1]])
    return left.astype(kind), np.ascontiguousarray(right.astype(kind).T), long * long


class Closest:
    """Fold of the ``LIST`` nearest clusters by Ward's distance, with sizes as groups: products of short floats, each with its bound, find few
    candidates, differences decide.

    Vectors end with a number of their own: 1 for a new cluster of the looking ones; of the others the distance up to which a new one
    is told to them at once, negative for none.
    """

    def start(self, x: Rows) -> tuple[np.ndarray, ...]:
        n = len(x[0])
        return np.full(n, np.inf), np.full(n, -1), np.full((n, LIST), np.inf), np.full((n, LIST), -1)

    def meet(self, x: Rows, y: Rows, state: tuple[np.ndarray, ...]) -> list[np.ndarray] | None:
        if not len(x[0]) or not len(y[0]):
            return None
        own, others, v, w, m = x[0], y[0], x[1][:, :-1], y[1][:, :-1], y[2]
        new, reach = x[1][:, -1] > 0, y[1][:, -1]
        waits = bool(new.any() and (reach >= 0).any())
        known = bool(np.intersect1d(own, others).size)
        left, right, scale = _bounding(v, w)
        same = bool((x[2] == x[2][0]).all() and (m == m[0]).all())
        unit = scale * (x[2][0] * m[0] / (x[2][0] + m[0])) if same else scale
        told = []
        for at in range(0, len(own), 256):
            ids, a, n, young = (part[at : at + 256] for part in (own, v, x[2], new))
            best, nearest, far, who = (part[at : at + 256] for part in state)
            exact = lambda i, j: n[i] * m[j] / (n[i] + m[j]) * ((a[i] - w[j]) ** 2).sum(axis=1)
            low = left[at : at + 256] @ right
            if not same:
                low /= ((1 / n)[:, None] + 1 / m).astype(low.dtype)
            if known:
                low[ids[:, None] == others] = np.inf
            if waits and young.any():
                i, j = np.nonzero(low <= np.clip(reach / unit * (1 + 1e-6), -1, np.finfo(low.dtype).max).astype(low.dtype))
                i, j = (k[young[i] & np.isfinite(low[i, j])] for k in (i, j))
                d = exact(i, j)
                near = d <= reach[j]
                told.append((others[j[near]], ids[i[near]], d[near], reach[j[near]]))
            rows = np.flatnonzero((least := low.min(axis=1)) <= far[:, -1] / unit * (1 + 1e-6))
            rows = rows[np.isfinite(least[rows])]
            if not len(rows):
                continue
            limit, some = far[rows, -1], low[rows]
            if np.isinf(limit).any() and len(others) > LIST:
                first = np.argpartition(some, LIST - 1, axis=1)[:, :LIST]
                sure = exact(np.repeat(rows, LIST), first.ravel()).reshape(first.shape).max(axis=1)
                limit = np.where(np.isfinite(np.take_along_axis(some, first, axis=1)).all(axis=1), np.minimum(limit, sure), limit)
            i, j = np.nonzero((some <= (limit / unit * (1 + 1e-6))[:, None]) & np.isfinite(some))
            i = rows[i]
            d = exact(i, j)
            i, j, d = (k[np.isfinite(d)] for k in (i, j, d))
            # the nearest one, by the order of the pair where distances are equal
            least = best.copy()
            np.minimum.at(least, i, d)
            ties = np.flatnonzero(d == least[i])
            starts = np.flatnonzero(np.diff(i[ties], prepend=-1))
            for row, one in zip(i[ties][starts], np.split(ties, starts[1:])):
                some = others[j[one]].tolist() + ([int(nearest[row])] if best[row] == d[one[0]] else [])
                best[row], nearest[row] = d[one[0]], some[0] if len(some) == 1 else min(some, key=lambda k: _order(int(ids[row]), k))
            rows, at_row = np.unique(i, return_inverse=True)
            at_row = np.concatenate([np.repeat(np.arange(len(rows)), LIST), at_row])
            d, j = np.concatenate([far[rows].ravel(), d]), np.concatenate([who[rows].ravel(), others[j]])
            sorted_ = np.lexsort((j, d, at_row))
            take = sorted_[np.searchsorted(at_row[sorted_], np.arange(len(rows)))[:, None] + np.arange(LIST)]
            far[rows], who[rows] = d[take], j[take]
        if not told:
            return None
        who, by, d, reach = (np.concatenate(c) for c in zip(*told))
        return [who, by, d, reach, np.full(len(d), 2)] if len(d) else None

    def rows(self, x: Rows, state: tuple[np.ndarray, ...]) -> list[np.ndarray]:
        """(id, nbr, d, r, kind): kind 0 is the nearest one, 1 the list; 2 are new ones that were told."""
        best, nearest, far, who = state
        found, listed = np.isfinite(best), np.isfinite(far)
        ids = np.concatenate([x[0][found], np.repeat(x[0], listed.sum(axis=1))])
        d = np.concatenate([best[found], far[listed]])
        return [ids, np.concatenate([nearest[found], who[listed]]), d, np.zeros(len(d)), np.repeat([0, 1], [found.sum(), listed.sum()])]


def _finish(ids: np.ndarray, n: np.ndarray, c: np.ndarray, turn: int) -> Iterator[tuple]:
    """(round, left, right, size, height) until one cluster is left."""
    fold, count = Closest(), len(ids)
    look, new = np.ones(count, bool), np.zeros(count, bool)
    # the nearest one and the list of each, the distance that all others have at least, and the nearest one's index
    d, who, reach = np.full((count, LIST + 1), np.inf), np.full((count, LIST + 1), -1), np.full(count, -1.0)
    while len(ids) > 1:
        own = np.flatnonzero(look)
        some = ids[look], np.column_stack([c[look], new[look]]), n[look]
        state, told = fold.start(some), []
        for at in range(0, len(ids), 1024):
            part = slice(at, at + 1024)
            told.append(fold.meet(some, (ids[part], np.column_stack([c[part], np.where(look[part], -1.0, reach[part])]), n[part]), state))
        best, nearest, far, listed = state
        reach[own] = far[:, -1]
        d[own], who[own] = np.column_stack([best, np.where((far < far[:, -1:]) & (listed != nearest[:, None]), far, np.inf)]), np.column_stack([nearest, listed])
        for x in told:
            for row, by, near, _, _ in zip(np.searchsorted(ids, x[0]).tolist(), *(k.tolist() for k in x[1:])) if x else ():
                free = np.flatnonzero(np.isinf(d[row, 1:]))
                at = 1 + int(free[0] if len(free) else d[row, 1:].argmax())
                if not len(free):  # the farthest one goes
                    reach[row] = min(reach[row], max(d[row, at], near))
                    if near >= d[row, at]:
                        continue
                d[row, at], who[row, at] = near, by
        least = d.min(axis=1)
        if not np.isfinite(least).any():  # distances that are no numbers
            return
        near = who[np.arange(len(ids)), d.argmin(axis=1)]
        for row in np.flatnonzero(((d == least[:, None]).sum(axis=1) > 1) & np.isfinite(least)).tolist():
            near[row] = min(who[row, d[row] == least[row]].tolist(), key=lambda k: _order(int(ids[row]), k))
        place = np.minimum(np.searchsorted(ids, near), len(ids) - 1)  # ids ascend
        pairs = np.flatnonzero((near[place] == ids) & (ids < near) & np.isfinite(least))
        if not len(pairs):
            return
        gone, new = np.zeros(len(ids), bool), np.zeros(len(ids), bool)
        for i, j in zip(pairs.tolist(), place[pairs].tolist()):
            c[i] = (n[i] * c[i] + n[j] * c[j]) / (n[i] + n[j])
            n[i] += n[j]
            new[i], gone[j] = True, True
            yield turn, int(ids[i]), int(ids[j]), int(n[i]), float(np.sqrt(2 * least[i]))
        d[(new | gone)[np.minimum(np.searchsorted(ids, who), len(ids) - 1)]] = np.inf
        look = new | ~((d.min(axis=1) < reach) | np.isfinite(d[:, 0]))
        ids, n, c, d, who, reach, look, new = (x[~gone] for x in (ids, n, c, d, who, reach, look, new))
        turn += 1


MERGES = "turn int, left long, right long, size long, height double"


def ward(rows: DataFrame) -> DataFrame:
    """(turn, left, right, size, height): one merge for each row of (id, v) but one.

    Clusters go by their least id: ``right`` joins ``left``, and is never named again. ``height`` is sqrt(2 n m / (n + m)) times the
    distance of the centres. Equal rows are put together first, at height 0, however many they are. Ids must differ; rows with a
    null id, vector or component take no part, vectors must have one length. One row or none gives no merges.
    """
    good = rows.where(F.col("id").isNotNull() & F.col("v").isNotNull() & ~F.exists("v", lambda x: x.isNull()))
    good = good.select(F.col("id").cast("long").alias("id"), F.transform("v", lambda x: x.cast("double")).alias("v"))
    alike = good.groupBy("v").agg(F.min("id").alias("left"), F.count("*").alias("n"))
    some = alike.where("n > 1").select(F.col("v").alias("w"), "left")
    same = good.join(some, F.col("v") == F.col("w")).select("left", "id")
    doubles = place(same, ["left"], ["id"], "at").where("at > 0").select(F.lit(0).alias("turn"), "left", F.col("id").alias("right"), (F.col("at") + 1).alias("size"), F.lit(0.0).alias("height"))
    merges = [materialise(doubles, "ward-merges")]
    clusters = materialise(alike.select(F.col("left").alias("id"), "v", "n", F.lit(0.0).alias("new"), F.lit(-1.0).alias("r"), F.lit(None).cast("array<struct<nbr:bigint,d:double,sure:boolean>>").alias("l")), "ward-clusters")
    turn, before = 1, None
    order = F.md5(F.concat_ws(":", F.least("id", "nbr"), F.greatest("id", "nbr")).cast("binary"))
    blocks = lambda rows, last: packed(rows.select("id", F.array_append("v", F.col(last)).alias("v"), F.col("n").alias("g")))

    while (count := clusters.count()) > LAST:
        if count == before:  # distances that are no numbers
            count = 0
            break
        before = count
        found = sweep(blocks(clusters.where("r < 0"), "new"), blocks(clusters, "r"), Closest(), "id long, nbr long, d double, r double, kind long")
        found = materialise(found, "ward-found")
        # others may have come in parts, each with a nearest one and a list
        lists = found.where("kind < 2").groupBy("id").agg(F.min(F.when(F.col("kind") == 0, F.struct("d", order.alias("o"), "nbr"))).alias("m"), F.array_sort(F.collect_list(F.when(F.col("kind") == 1, F.struct("d", "nbr")))).alias("l"))
        lists = lists.withColumn("r", F.coalesce(F.get("l", F.lit(LIST - 1))["d"], F.lit(float("inf"))))
        entry = lambda d, nbr, sure: F.struct(nbr.alias("nbr"), d.alias("d"), F.lit(sure).alias("sure"))
        listed = F.transform(F.filter("l", lambda x: (x["d"] < F.col("r")) & (x["nbr"] != F.col("m.nbr"))), lambda x: entry(x["d"], x["nbr"], False))
        lists = lists.select("id", "r", F.concat(F.array(entry(F.col("m.d"), F.col("m.nbr"), True)), listed).alias("l"))
        lists = lists.unionByName(clusters.where("r >= 0").select("id", "r", "l")).select("id", "r", F.inline("l"))
        known = lists.unionByName(found.where("kind = 2").select("id", "r", "nbr", "d", F.lit(False).alias("sure")))
        near = known.groupBy("id").agg(F.min(F.struct("d", order.alias("o"), "nbr")).alias("m")).select("id", "m.nbr", "m.d")
        pairs = near.groupBy(F.least("id", "nbr").alias("left"), F.greatest("id", "nbr").alias("right")).agg(F.min("d").alias("d"), F.count("*").alias("k")).where("k = 2")
        a = clusters.select(F.col("id").alias("left"), F.col("v").alias("a"), F.col("n").alias("na"))
        b = clusters.select(F.col("id").alias("right"), F.col("v").alias("b"), F.col("n").alias("nb"))
        size = F.col("na") + F.col("nb")
        centre = F.zip_with("a", "b", lambda p, q: (F.col("na") * p + F.col("nb") * q) / size)
        joined = materialise(pairs.join(a, "left").join(b, "right").select("left", "right", "d", size.alias("size"), centre.alias("v")), "ward-joined")
        merges.append(joined.select(F.lit(turn).alias("turn"), "left", "right", "size", F.sqrt(2 * F.col("d")).alias("height")))
        gone = joined.select(F.explode(F.array("left", "right")).alias("id"))
        left = known.join(gone, "id", "left_anti").join(gone.withColumnRenamed("id", "nbr"), "nbr", "left_anti")
        # the nearest of a list is the nearest of all if it is nearer than what the list leaves out
        left = left.groupBy("id").agg(F.max("r").alias("r"), F.min("d").alias("d"), F.max("sure").alias("sure"), F.collect_list(F.struct("nbr", "d", "sure")).alias("l"))
        kept = left.where("d < r OR sure").select("id", "r", "l")
        old = clusters.join(gone, "id", "left_anti").select("id", "v", "n", F.lit(0.0).alias("new"))
        new = joined.select(F.col("left").alias("id"), "v", F.col("size").alias("n"), F.lit(1.0).alias("new"))
        clusters = materialise(old.unionByName(new).join(kept, "id", "left").select("id", "v", "n", "new", F.coalesce("r", F.lit(-1.0)).alias("r"), "l"), "ward-clusters")
        turn += 1

    def rest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(list(batches)) if count else None
        if table is not None and len(table) > 1:
            c = np.array(table["v"].to_pylist(), float)
            out = list(_finish(table["id"].to_numpy().copy(), table["n"].to_numpy().copy(), c, turn))
            kinds = [pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.float64()]
            yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*out), kinds)], [c.split()[0] for c in MERGES.split(", ")])

    if count > 1:
        merges.append(materialise(clusters.select("id", "v", "n").repartition(1).sortWithinPartitions("id").mapInArrow(rest, MERGES), "ward-merges"))  # LAST rows at most
    out = merges[0]
    for some in merges[1:]:
        out = out.unionByName(some)
    return out


def cut(merges: DataFrame, ids: DataFrame, k: int) -> DataFrame:
    """(id, cluster): the clusters, by their least id, that are left when the ``k`` - 1 highest merges are undone.

    Rows of ``ids`` (id) that no merge names are clusters of their own. A row's way up is halved in each round of a self join.
    """
    highest = merges.orderBy(F.desc("height"), F.desc("turn"), F.desc("left"), F.desc("right")).limit(k - 1).select("right") if k > 1 else merges.select("right").limit(0)
    kept = merges.join(highest, "right", "left_anti").select(F.col("right").alias("id"), F.col("left").alias("up"))
    steps = materialise(ids.select(F.col("id").cast("long").alias("id")).join(kept, "id", "left").select("id", F.coalesce("up", "id").alias("up")), "ward-cut")
    while True:
        above = steps.select(F.col("id").alias("up"), F.col("up").alias("top"))
        new = materialise(steps.join(above, "up", "left").select("id", F.coalesce("top", "up").alias("up"), (F.coalesce("top", "up") != F.col("up")).alias("moved")), "ward-cut")
        steps = new.select("id", "up")
        if not new.where("moved").limit(1).count():
            return steps.select("id", F.col("up").alias("cluster"))
