"""Near-duplicate detection by min-max hashing.

Every permutation of a document's shingle set gives two signature values, its minimum and its maximum, so a signature of 2p
values costs p hash evaluations. Bands of the signature meet in buckets; links are confirmed on the full sets. Equal sets are
one node from the start. A bucket is first tied to two pivots, so a group of m copies costs about m comparisons, and only
what is then still apart is compared further, the most alike first. Components come from alternating large and small stars.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from contactspark.llm.common import id_and_text, materialise

ROWS = 4  # signature values in a band
MISS = 1e-5  # chance that a pair exactly at the threshold shares no band
CHUNK = 4096  # members of a bucket that meet in one group at most
BLOCK_BYTES = 1 << 19  # of sets that are fetched together for the last comparisons
REMEMBERED = 400_000
SEED = 20_240_501
SALTS = 32  # tasks that the edges of one node are dealt over
FEATURES = "doc_id long, mark long, n_shingles long, digest binary, bands array<long>, signature binary"


class Shingler:
    """Sets of hashed shingles: distinct runs of ``words`` words, A-Z in lower case, words between ASCII white space."""

    def __init__(self, words: int):
        self.words, self.known = words, {}
        self.odd = np.random.default_rng(SEED).integers(1, 1 << 63, words + 1, dtype=np.uint64) * np.uint64(2) + np.uint64(1)

    def of(self, text: str | None) -> np.ndarray:
        words = text.encode("utf-8", "replace").lower().split() if text else []
        known = self.known
        new = set(words).difference(known)
        if len(known) + len(new) > REMEMBERED:
            known.clear()
            new = set(words)
        known.update((w, xxhash.xxh64_digest(w)) for w in new)
        h = np.frombuffer(b"".join(map(known.__getitem__, words)), ">u8").astype(np.uint64)
        if len(h) < self.words:
            return np.array([xxhash.xxh64_intdigest(h.tobytes(), len(h))], np.uint64) if len(h) else h
        n = len(h) - self.words + 1
        out = np.zeros(n, np.uint64)
        for i in range(self.words):
            out = (out ^ h[i : i + n]) * self.odd[i]
            out ^= out >> np.uint64(29)
        out *= self.odd[-1]
        out ^= out >> np.uint64(32)
        out.sort()
        return out[np.concatenate([[True], out[1:] != out[:-1]])]


def bands_for(percent: int) -> int:
    return max(2, math.ceil(math.log(MISS) / math.log(1 - (percent / 100) ** ROWS)))


def signature(shingles: np.ndarray, odd: np.ndarray, values: int) -> np.ndarray:
    """Minimum and maximum of each permutation, ``values`` of them in all."""
    low, high = np.full(len(odd), np.iinfo(np.int64).max), np.full(len(odd), np.iinfo(np.int64).min)
    for at in range(0, len(shingles), 8192):
        z = np.multiply.outer(odd, shingles[at : at + 8192]).view(np.int64)
        low, high = np.minimum(low, z.min(axis=1)), np.maximum(high, z.max(axis=1))
    return np.stack([low, high], axis=1).ravel()[:values].view(np.uint64)


def features(docs: DataFrame, words: int, percent: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, mark of the text, n_shingles, digest of the set, band hashes, 16-bit signature values) of every row."""
    bands = bands_for(percent)
    values = bands * ROWS
    odd = np.random.default_rng(SEED + 1).integers(1, 1 << 63, (values + 1) // 2, dtype=np.uint64) * np.uint64(2) + np.uint64(1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler = Shingler(words)
        for batch in batches:
            for at in range(0, batch.num_rows, 2000):
                some = batch.slice(at, 2000)
                sizes, digests, keys, marks = [], [], [], []
                for text in some.column(1).to_pylist():
                    s = shingler.of(text)
                    sizes.append(len(s))
                    digests.append(xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None)
                    if not len(s):
                        keys.append([])
                        marks.append(b"")
                        continue
                    sig = signature(s, odd, values)
                    keys.append([xxhash.xxh64_intdigest(sig[i * ROWS : (i + 1) * ROWS].tobytes(), i) - (1 << 63) for i in range(bands)])
                    marks.append((sig >> np.uint64(20)).astype(np.uint16).tobytes())
                yield pa.RecordBatch.from_arrays([some.column(0), some.column(2), pa.array(sizes, pa.int64()), pa.array(digests, pa.binary()), pa.array(keys, pa.list_(pa.int64())), pa.array(marks, pa.binary())], ["doc_id", "mark", "n_shingles", "digest", "bands", "signature"])

    return id_and_text(docs, id_col, text_col).withColumn("mark", F.xxhash64("text")).mapInArrow(run, FEATURES)


def _with_least(edges: DataFrame) -> DataFrame:
    """``edges`` (a, b) with m, the least of a and its neighbours b. A node of very many edges is dealt over SALTS tasks."""
    salted = edges.withColumn("salt", F.pmod(F.xxhash64("b"), F.lit(SALTS)))
    parts = salted.groupBy("a", "salt").agg(F.min("b").alias("m"))
    least = parts.withColumn("m", F.least("a", F.min("m").over(Window.partitionBy("a"))))  # SALTS rows for a node at most
    return salted.join(least.repartition("a", "salt"), ["a", "salt"]).select("a", "b", "m")


def _is_star_forest(edges: DataFrame) -> bool:
    """Whether every node is either the child of one other or the parent of some."""
    ends = edges.select(F.explode(F.array(F.struct(F.col("a").alias("n"), F.lit(1).alias("up"), F.lit(0).alias("down")), F.struct(F.col("b").alias("n"), F.lit(0).alias("up"), F.lit(1).alias("down")))).alias("e")).select("e.*")
    return ends.groupBy("n").agg(F.sum("up").alias("up"), F.max("down").alias("down")).where("up > 1 OR (up > 0 AND down > 0)").isEmpty()


def components(edges: DataFrame) -> DataFrame:
    """(node, component) for every node of ``edges`` (a, b): the least node that is reachable.

    Alternating large and small stars; each round is written once. Edges of earlier calls may come back as
    (node, component), as they are stars already.
    """
    edges = materialise(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    while not _is_star_forest(edges):
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        large = _with_least(both).where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        both = _with_least(large).select(F.explode(F.array(F.struct(F.col("b").alias("a"), F.col("m").alias("b")), F.struct(F.col("a"), F.col("m").alias("b")))).alias("e")).select("e.a", "e.b")
        edges = materialise(both.where("a <> b").distinct(), "stars")
    return edges.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(edges.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())


def alike(x: np.ndarray, y: np.ndarray, percent: int) -> bool:
    """Whether two sorted sets reach the threshold."""
    if len(x) > len(y):
        x, y = y, x
    if 100 * len(x) < percent * len(y):
        return False
    both = int(np.count_nonzero(y[np.minimum(np.searchsorted(y, x), len(y) - 1)] == x))
    return 100 * both >= percent * (len(x) + len(y) - both)


def _confirm(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose full sets reach the threshold."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for i in range(batch.num_rows):
                x, y = (np.frombuffer(batch.column(k)[i].as_buffer(), "<u8") for k in (2, 3))
                if alike(x, y, percent):
                    keep.append(i)
            yield pa.RecordBatch.from_arrays([batch.column(k).take(pa.array(keep, pa.int64())) for k in (0, 1)], ["a", "b"])

    left = sets.select(F.col("rep").alias("a"), F.col("set").alias("x"))
    right = sets.select(F.col("rep").alias("b"), F.col("set").alias("y"))
    return pairs.join(left, "a").join(right, "b").select("a", "b", "x", "y").mapInArrow(run, "a long, b long")


def _apart(members: DataFrame, percent: int, nearest: int | None) -> DataFrame:
    """Pairs of one bucket in different components that are alike enough by their signatures, packed by the blocks they are in.

    ``members``: (bucket, band, rep, component, signature, block). The rows outside a bucket's largest component meet all its
    rows, in groups of CHUNK by CHUNK at most; a pair counts in the first band that it shares. With ``nearest``, only so many
    partners for each row and component. Returns (x, y, pairs): blocks x <= y and int64 pairs (rep of x, rep of y).
    """
    by_component = members.groupBy("bucket", "component").agg(F.count("*").alias("n"))
    top = by_component.groupBy("bucket").agg(F.max(F.struct("n", F.col("component"))).alias("top"), F.sum("n").alias("all"), F.count("*").alias("parts")).where("parts > 1")
    top = top.select("bucket", F.col("top.component").alias("main"), F.ceil(F.col("all") / CHUNK).alias("columns"), F.ceil((F.col("all") - F.col("top.n")) / CHUNK).alias("lines"))
    rows = members.join(top, "bucket").withColumn("at", F.xxhash64("rep", F.lit(5)))
    grid = lambda n: F.sequence(F.lit(0).cast("long"), F.col(n) - 1)
    right = rows.withColumn("column", F.expr("pmod(at, columns)")).withColumn("line", F.explode(grid("lines"))).withColumn("out", F.lit(False))
    left = rows.where("component <> main").withColumn("line", F.expr("pmod(at, lines)")).withColumn("column", F.explode(grid("columns"))).withColumn("out", F.lit(True))
    least = percent / 100

    def run(key: tuple, table: pa.Table) -> pa.Table:
        out = np.array(table["out"].to_pylist())
        rep, part, block = (table[c].to_numpy() for c in ("rep", "component", "block"))
        band = table["band"][0].as_py()
        sig = np.array([np.frombuffer(s, np.uint16) for s in table["signature"].to_pylist()])
        floor = least - 4.5 * math.sqrt(least * (1 - least) / sig.shape[1])
        rr, pr, br, sr = rep[~out], part[~out], block[~out], sig[~out]
        pairs = []
        for i in np.flatnonzero(out):
            same = sr == sig[i]
            share = same.mean(axis=1)
            ok = np.flatnonzero((share >= floor) & (pr != part[i]))
            ok = ok[same[ok].reshape(len(ok), sig.shape[1] // ROWS, ROWS).all(axis=2).argmax(axis=1) == band]
            if nearest and len(ok) > nearest:
                ok = ok[np.argsort(-share[ok], kind="stable")]
                taken: dict[int, int] = {}
                some = []
                for j in ok.tolist():
                    taken[pr[j]] = taken.get(pr[j], 0) + 1
                    if taken[pr[j]] <= nearest:
                        some.append(j)
                ok = np.array(some, int)
            # rows outside the largest component meet each other in both roles; one is enough
            pairs.append(np.stack([np.full(len(ok), block[i]), br[ok], np.full(len(ok), rep[i]), rr[ok]], axis=1))
        found = np.concatenate(pairs) if pairs else np.zeros((0, 4), np.int64)
        turn = (found[:, 0] > found[:, 1]) | (found[:, 0] == found[:, 1]) & (found[:, 2] > found[:, 3])
        found[turn] = found[turn][:, [1, 0, 3, 2]]
        found = found[np.lexsort(found.T[::-1])]
        cuts = np.flatnonzero((np.diff(found[:, 0]) != 0) | (np.diff(found[:, 1]) != 0)) + 1
        packs = [g for g in np.split(found, cuts) if len(g)]
        return pa.table({"x": pa.array([int(g[0, 0]) for g in packs], pa.int64()), "y": pa.array([int(g[0, 1]) for g in packs], pa.int64()), "pairs": pa.array([np.unique(g[:, 2:], axis=0).tobytes() for g in packs], pa.binary())})

    columns = ["bucket", "line", "column", "band", "rep", "component", "signature", "block", "out"]
    grouped = right.select(*columns).unionByName(left.select(*columns)).groupBy("bucket", "line", "column")
    return grouped.applyInArrow(run, "x long, y long, pairs binary").groupBy("x", "y").agg(F.collect_list("pairs").alias("pairs"))


def _blocks(members: DataFrame, sets: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rep, block) and (block, rows): sets packed in blocks of about BLOCK_BYTES, those that share buckets together."""
    least = members.groupBy("bucket").agg(F.min("rep").alias("f"))
    home = members.join(least, "bucket").groupBy("rep").agg(F.min("f").alias("family"))
    sized = sets.select("rep", F.octet_length("set").alias("bytes")).join(home, "rep")
    parts = sized.groupBy("family").agg(F.ceil(F.sum("bytes") / BLOCK_BYTES).alias("k"))
    block = materialise(sized.join(parts, "family").select("rep", F.xxhash64("family", F.pmod(F.xxhash64("rep"), F.col("k"))).alias("block")), "blocks")
    return block, materialise(sets.join(block, "rep").groupBy("block").agg(F.collect_list(F.struct("rep", "set")).alias("rows")), "set-blocks")


def _confirm_packed(packs: DataFrame, blocks: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) of ``_apart`` whose full sets reach the threshold; blocks meet, not rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(batch.num_rows):
                x, y = ({r["rep"].as_py(): np.frombuffer(r["set"].as_buffer(), "<u8") for r in batch.column(k)[at]} for k in (1, 2))
                todo = np.concatenate([np.frombuffer(p, np.int64).reshape(-1, 2) for p in batch.column(0)[at].as_py()])
                links = [(a, b) for a, b in np.unique(todo, axis=0).tolist() if alike(x[a], y[b], percent)]
                yield pa.RecordBatch.from_arrays([pa.array([min(p) for p in links], pa.int64()), pa.array([max(p) for p in links], pa.int64())], ["a", "b"])

    left = blocks.select(F.col("block").alias("x"), F.col("rows").alias("xs"))
    right = blocks.select(F.col("block").alias("y"), F.col("rows").alias("ys"))
    return packs.join(left, "x").join(right, "y").select("pairs", "xs", "ys").mapInArrow(run, "a long, b long")


def near_duplicates(docs: DataFrame, words: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) for every row of ``docs``.

    Two documents are linked if 100 * |A and B| >= percent * |A or B| for their sets of ``words``-word shingles; a text of
    fewer words is one shingle, a null or wordless text has none and no link. component_id is the least doc_id reachable;
    kept holds for that document. A row without id has no link, a null component and is kept. Rows that repeat an id are
    judged each by its own text. Further columns are ignored; an empty table gives no rows.
    """
    return _judged(docs, words, percent, id_col, text_col).drop("mark")


def _judged(docs: DataFrame, words: int, percent: int, id_col: str, text_col: str) -> DataFrame:
    """``near_duplicates`` with the mark (a hash) of each row's text."""
    found = materialise(features(docs, words, percent, id_col, text_col), "features")
    known = found.where("digest is not null and doc_id is not null")
    reps = materialise(known.groupBy("digest").agg(F.min("doc_id").alias("rep"), F.first("bands").alias("bands"), F.first("signature").alias("signature")), "reps")
    members = reps.select(F.posexplode("bands").alias("band", "bucket"), "rep")
    order = F.struct(F.xxhash64("rep", "bucket").alias("h"), F.col("rep").alias("r"))
    shared = members.groupBy("bucket").agg(F.count("*").alias("n"), F.min(order).alias("p"), F.max(order).alias("q")).where("n > 1").select("bucket", F.col("p.r").alias("p"), F.col("q.r").alias("q"))
    members = materialise(members.join(shared, "bucket"), "buckets")
    needed = members.select("rep").distinct().join(reps.select("rep", "digest"), "rep")

    def sets_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler = Shingler(words)
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                some = batch.slice(at, 500)
                sets = [shingler.of(t).tobytes() for t in some.column(2).to_pylist()]
                same = [i for i, (s, d) in enumerate(zip(sets, some.column(1).to_pylist())) if xxhash.xxh3_128_digest(s) == d]
                yield pa.RecordBatch.from_arrays([some.column(0).take(pa.array(same, pa.int64())), pa.array([sets[i] for i in same], pa.binary())], ["rep", "set"])

    texts = id_and_text(docs, id_col, text_col).withColumnRenamed("doc_id", "rep")
    sets = materialise(texts.join(needed, "rep").select("rep", "digest", "text").mapInArrow(sets_of, "rep long, set binary").dropDuplicates(["rep"]), "sets")

    pairs = members.select(F.explode(F.array("p", "q")).alias("pivot"), "rep").where("pivot <> rep").select(F.least("pivot", "rep").alias("a"), F.greatest("pivot", "rep").alias("b")).distinct()
    pairs = materialise(pairs, "pairs")
    part = components(_confirm(pairs, sets, percent))
    block, packed = _blocks(members, sets)
    known_rows = reps.select("rep", "signature").join(block, "rep")
    for nearest in (3, None):
        joined = part.withColumnRenamed("node", "rep")
        open_rows = members.select("bucket", "band", "rep").join(joined, "rep", "left").withColumn("component", F.coalesce("component", "rep"))
        packs = _apart(open_rows.join(known_rows, "rep"), percent, nearest)
        stars = part.select(F.col("node").alias("a"), F.col("component").alias("b"))
        part = components(stars.unionByName(_confirm_packed(packs, packed, percent)))
    part = part.withColumnRenamed("node", "rep")
    classes = reps.select("digest", "rep").join(part, "rep", "left").select("digest", F.coalesce("component", "rep").alias("component_id"))
    linked = known.select("doc_id", "mark", "n_shingles", "digest").join(classes, "digest").select("doc_id", "mark", "n_shingles", "component_id")
    alone = found.where("digest is null or doc_id is null").select("doc_id", "mark", "n_shingles", F.col("doc_id").alias("component_id"))
    return linked.unionByName(alone).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def drop_near_duplicates(docs: DataFrame, words: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with one document of each group, all columns kept.

    Rows without id, null texts and texts without words stay. Of rows that repeat an id and a text one stays, if it has words.
    Rows that repeat an id with different texts are judged each by its own. An empty table gives no rows.
    """
    found = materialise(_judged(docs, words, percent, id_col, text_col), "near-duplicates")
    same = lambda other: (docs[id_col].cast("long") == other["__id"]) & (F.xxhash64(docs[text_col].cast("string")) == other["__mark"])
    row = [F.col("doc_id").alias("__id"), F.col("mark").alias("__mark")]
    gone = found.where("not kept").select(*row).distinct()
    left = docs.join(gone, same(gone), "left_anti")
    twice = found.where("kept AND n_shingles > 0 AND doc_id IS NOT NULL").groupBy(*row).agg(F.count("*").alias("__n")).where("__n > 1").select("__id", "__mark")
    twice = materialise(twice, "repeated-ids")
    if twice.isEmpty():
        return left
    again = left.join(twice, same(twice), "left_semi").dropDuplicates([id_col, text_col])
    return left.join(twice, same(twice), "left_anti").unionByName(again)
