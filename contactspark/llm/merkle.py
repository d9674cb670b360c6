"""A Merkle manifest of a table: leaves of rows, a tree for each group, a tree of the groups' roots, and a proof for every row.

Every ``ARITY`` consecutive nodes become one, the last run of a level fewer or even one, until one node is left. The tree of a
group's rows in order is built like ``combineByKey`` on the parent's place: a task keeps partial parents, each child that
arrives is put at its index, and a parent whose children are all there (how many follows from the group's size) at once
becomes a child of its own parent. What is still partial at a task's end meets in a shuffle, keyed by the block of ``LEVELS``
levels that holds it, so a round closes ``LEVELS`` levels and no task gets more than one block of a tree at a time.

Finished parents are kept with their children's digests. These links are read from the root down, block by block, to give each
row the digests beside its path; the rows of one group are dealt over blocks of ``ARITY ** LEVELS``, however large the group.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from hashlib import sha256

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from contactspark.llm.common import materialise
from contactspark.operators.order import place

ARITY = 16
BITS = ARITY.bit_length() - 1
#: Levels that one round of combining closes, and one round of proofs descends: a block has ARITY ** LEVELS nodes at its foot.
LEVELS = 3
#: Partial parents that a task holds before it passes them on; rows in order need few, this bounds rows in any order.
MOST_OPEN = 100_000
#: Rows of an output batch: a path may be some kilobytes long.
OUT_ROWS = 256

PARTIAL, LINK, ROOT = 0, 1, 2
NODES = "state int, tree string, n long, level int, at long, children array<string>"


def digest(text: str) -> str:
    return sha256(text.encode()).hexdigest()


def height(n: int) -> int:
    """Levels above ``n`` nodes."""
    levels = 0
    while n > 1:
        n, levels = -(-n // ARITY), levels + 1
    return levels


def arity(n: int, level: int, at: int) -> int:
    """Children of node ``at`` of ``level`` in a tree of ``n`` leaves (level 0)."""
    return min(ARITY, -(-n // ARITY ** (level - 1)) - ARITY * at)


def batches_of(rows: Iterable[tuple], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    held: list[tuple] = []

    def batch() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held), schema.types)], schema=schema)

    for row in rows:
        held.append(row)
        if len(held) == OUT_ROWS:
            yield batch()
            held = []
    if held:
        yield batch()


def rows_of(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple]:
    for batch in batches:
        yield from zip(*(c.to_pylist() for c in batch.columns))


NODE_SCHEMA = pa.schema([("state", pa.int32()), ("tree", pa.string()), ("n", pa.int64()), ("level", pa.int32()), ("at", pa.int64()), ("children", pa.list_(pa.string()))])


def combine(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Partial parents (tree, n, level, at, children with nulls where none came) to links, roots and what is still partial."""

    def events() -> Iterator[tuple]:
        partial: dict[tuple, list[str | None]] = {}
        for tree, n, level, at, children in rows_of(batches):
            while True:
                known = partial.get((tree, level, at))
                if known is None:
                    known = partial[tree, level, at] = [None] * arity(n, level, at)
                for i, child in enumerate(children):
                    if child is not None:
                        known[i] = child
                if None in known:
                    break
                del partial[tree, level, at]
                yield LINK, tree, n, level, at, known
                up = digest("".join(known))
                if level == height(n):
                    yield ROOT, tree, n, level, at, [up]
                    break
                # the parent's digest is an event of its own: it arrives one level up
                children, level, at = [None] * (at % ARITY) + [up], level + 1, at // ARITY
            sizes[tree] = n
            if len(partial) >= MOST_OPEN:
                yield from passed_on(partial)
        yield from passed_on(partial)

    sizes: dict[str | None, int] = {}

    def passed_on(partial: dict[tuple, list[str | None]]) -> Iterator[tuple]:
        for (tree, level, at), children in partial.items():
            yield PARTIAL, tree, sizes[tree], level, at, children
        partial.clear()
        sizes.clear()

    yield from batches_of(events(), NODE_SCHEMA)


class Forest:
    """``links`` (tree, n, level, at, children) and ``roots`` (tree, n, root) of leaves (tree, n, at, digest, ...).

    A tree of one leaf has no links; its root is the leaf. A null tree is a tree of its own. ``n`` is the tree's size and
    ``at`` the leaf's place from 0, without gaps.
    """

    def __init__(self, leaves: DataFrame) -> None:
        most = leaves.agg(F.max("n")).first()[0] or 0
        self.levels = height(most)
        slot = F.concat(F.array_repeat(F.lit(None).cast("string"), (F.col("at") % ARITY).cast("int")), F.array("digest"))
        nodes = leaves.where("n > 1").select("tree", "n", F.lit(1).alias("level"), F.shiftright("at", BITS).alias("at"), slot.alias("children"))
        done = []
        for top in range(0, self.levels + LEVELS, LEVELS):
            if top:  # the first round takes the leaves as they lie, in order for the most part
                block = F.expr(f"shiftright(at, {BITS} * greatest({top} - level, 0))")
                nodes = nodes.repartition("tree", F.greatest("level", F.lit(top)), block)
            out = materialise(nodes.select("tree", "n", "level", "at", "children").mapInArrow(combine, NODES), "merkle-nodes")
            done.append(out.where(F.col("state") != PARTIAL))
            nodes = out.where(F.col("state") == PARTIAL)
        every = done[0]
        for some in done[1:]:
            every = every.unionByName(some)
        self.links = every.where(F.col("state") == LINK).drop("state")
        alone = leaves.where("n = 1").select("tree", "n", F.col("digest").alias("root"))
        self.roots = every.where(F.col("state") == ROOT).select("tree", "n", F.col("children")[0].alias("root")).unionByName(alone)

    def descend(self, tops: DataFrame, leaves: DataFrame, finish: Callable[[tuple, "Block"], tuple], schema: str) -> DataFrame:
        """What ``finish`` makes of every leaf and the block it lies in.

        ``tops`` (tree, n, above array<string>, note string): for each tree the digests before and after its root's path, from
        the root up, and a text that goes along. ``leaves`` (tree, n, at, and a struct ``payload``).
        """
        kinds = dict(leaves.dtypes)["payload"]
        empty, no_text = F.lit(None).cast("array<string>"), F.lit(None).cast("string")
        entry = F.greatest(F.lit(1), F.ceil(F.expr(" + ".join(f"CAST(n > {ARITY**k} AS INT)" for k in range(60 // BITS))) / LEVELS))  # rounds to a tree's top
        tops = tops.withColumn("entry", entry)
        known = None
        for r in range(max(1, -(-self.levels // LEVELS)), 0, -1):
            above = tops.where(F.col("entry") == r).select("tree", "n", F.lit(0).cast("long").alias("at"), "above", "note")
            above = above if known is None else above.unionByName(known)
            block = F.expr(f"shiftright(at, {BITS} * ({LEVELS * r} - level))")
            rows = above.select("tree", F.col("at").alias("block"), F.lit(0).alias("kind"), "n", F.lit(LEVELS * r).alias("level"), "at", F.col("above").alias("digests"), "note", F.lit(None).cast(kinds).alias("payload"))
            links = self.links.where(f"level > {LEVELS * (r - 1)} AND level <= {LEVELS * r}")
            rows = rows.unionByName(links.select("tree", block.alias("block"), F.lit(1).alias("kind"), "n", "level", "at", F.col("children").alias("digests"), no_text.alias("note"), F.lit(None).cast(kinds).alias("payload")))
            if r == 1:
                rows = rows.unionByName(leaves.select("tree", F.shiftright("at", BITS * LEVELS).alias("block"), F.lit(2).alias("kind"), "n", F.lit(0).alias("level"), "at", empty.alias("digests"), no_text.alias("note"), "payload"))
            dealt = rows.repartition("tree", "block").sortWithinPartitions("tree", "block", "kind", F.desc("level"), "at")
            dealt = dealt.select("tree", "block", "kind", "n", "level", "at", "digests", "note", "payload")
            if r == 1:
                return dealt.mapInArrow(_leaves(finish, schema), schema)
            known = materialise(dealt.mapInArrow(_children(LEVELS * (r - 1)), "tree string, n long, at long, above array<string>, note string"), "merkle-paths")
        raise AssertionError("a descent has one round at least")


class Block:
    """The digests of one block of a tree, and the paths that they give."""

    def __init__(self, n: int, top: int, above: list[str], note: str) -> None:
        self.top, self.above, self.note = min(top, height(n)), above, note
        self.links: dict[tuple[int, int], list[str]] = {}
        self._paths: dict[tuple[int, int], list[str]] = {}
        self._folds: dict[tuple[int, int, str], str] = {}

    def path(self, level: int, at: int) -> list[str]:
        """[before, after, before, after, ...] of a node, from its own level up to the root."""
        if level >= self.top:
            return self.above
        found = self._paths.get((level, at))
        if found is None:
            children, i = self.links[level + 1, at // ARITY], at % ARITY
            found = ["".join(children[:i]), "".join(children[i + 1 :]), *self.path(level + 1, at // ARITY)]
            if level:  # leaves are asked for once
                self._paths[level, at] = found
        return found

    def fold(self, level: int, at: int, text: str) -> str:
        """The root that a node's place and some digest for it give; what meets on the way up is hashed once."""
        found = self._folds.get((level, at, text))
        if found is None:
            found = text
            if level >= self.top:
                for before, after in zip(self.above[::2], self.above[1::2]):
                    found = digest(before + found + after)
            else:
                children, i = self.links[level + 1, at // ARITY], at % ARITY
                found = self.fold(level + 1, at // ARITY, digest("".join([*children[:i], text, *children[i + 1 :]])))
            if level:
                self._folds[level, at, text] = found
        return found


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[Block, int, str | None, int, int, int, list[str], dict]]:
    block, here = None, None
    for tree, number, kind, n, level, at, digests, note, payload in rows_of(batches):
        if kind == 0:
            block, here = Block(n, level, digests, note), (tree, number)
        elif (tree, number) != here:
            raise ValueError(f"nodes of tree {tree!r} lie in a block that nothing above leads to")
        elif kind == 1:
            block.links[level, at] = digests
        if kind:
            yield block, kind, tree, n, level, at, digests, payload


def _children(foot: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """The blocks under a block: one for each node of level ``foot``, with the path above it."""
    schema = pa.schema([("tree", pa.string()), ("n", pa.int64()), ("at", pa.int64()), ("above", pa.list_(pa.string())), ("note", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[tuple]:
            for block, _, tree, n, level, at, digests, _ in _blocks(batches):
                if level == foot + 1:
                    for i in range(len(digests)):
                        yield tree, n, ARITY * at + i, block.path(foot, ARITY * at + i), block.note

        yield from batches_of(rows(), schema)

    return run


def _leaves(finish: Callable[[tuple, Block], tuple], schema: str) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    types = {"string": pa.string(), "long": pa.int64(), "boolean": pa.bool_(), "array<string>": pa.list_(pa.string())}
    made = pa.schema([(c.split()[0], types[c.split()[1]]) for c in schema.split(", ")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = (finish((at, payload), block) for block, kind, _, _, _, at, _, payload in _blocks(batches) if kind == 2)
        yield from batches_of(rows, made)

    return run


def leaf(columns: list[Column]) -> Column:
    """sha256 of the columns, each ``-`` if null, else its count of UTF-8 bytes, a colon and itself (numbers in decimal)."""
    parts = [F.coalesce(F.concat(F.octet_length(c).cast("string"), F.lit(":"), c), F.lit("-")) for c in (c.cast("string") for c in columns)]
    return F.sha2(F.concat(*parts), 256)


def _proof(key: tuple, block: Block) -> tuple:
    at, row = key
    path = block.path(0, at)
    subroot, root = block.note.split(" ")
    folded = block.fold(0, at, row["shown"] or row["leaf"])
    return row["doc_id"], row["leaf"], subroot, root, digest("".join(path)), folded, folded == root


def _path(key: tuple, block: Block) -> tuple:
    at, row = key
    return row["name"], block.path(0, at)


def manifest(docs: DataFrame, shown: DataFrame | None = None, group: str = "source", columns: tuple[str, ...] = ("doc_id", "source", "lang", "n_chars", "text")) -> DataFrame:
    """(doc_id, leaf, subroot, root, proof_sha256, folded_root, verified) for every row of ``docs``.

    ``shown``: the same rows with a further column ``__shown``, the text that is shown for verification; null if it is the
    original. Rows of a group are ordered by doc_id and, where that repeats, by their leaf; null ids come first. A null group is
    a group of its own and the first. Equal rows have equal leaves and each its own proof. Nulls and empty texts are told apart
    by the leaf. The proof of the only row of the only group is the digest of nothing. An empty table gives no rows; further
    columns of ``docs`` are ignored.
    """
    rows = (shown if shown is not None else docs.withColumn("__shown", F.lit(None).cast("string"))).select(*columns, F.col(group).cast("string").alias("__group"), "__shown")
    own = [F.col(c) for c in columns]
    altered = F.when(F.col("__shown").isNotNull(), leaf([F.col("__shown") if c == "text" else F.col(c) for c in columns]))
    hashed = materialise(rows.select(F.col("__group").alias("tree"), F.col("doc_id").cast("long").alias("doc_id"), leaf(own).alias("leaf"), altered.alias("shown")), "merkle-leaves")
    placed = place(hashed, ["tree"], ["doc_id", "leaf"], "at")
    counted = hashed.groupBy("tree").agg(F.count("*").alias("n")).withColumnRenamed("tree", "__tree")
    placed = placed.join(counted, F.col("tree").eqNullSafe(F.col("__tree"))).drop("__tree")
    leaves = materialise(placed.select("tree", "n", "at", F.col("leaf").alias("digest"), F.struct("doc_id", "leaf", "shown").alias("payload")), "merkle-placed")
    rows_forest = Forest(leaves)

    groups = materialise(rows_forest.roots.select(F.col("tree").alias("name"), F.col("n").alias("rows"), F.col("root").alias("digest")), "merkle-groups")
    count = groups.count()
    tops = materialise(place(groups, [], ["name"], "at").select(F.lit("groups").alias("tree"), F.lit(count).cast("long").alias("n"), "at", "digest", F.struct("name").alias("payload")), "merkle-tops")
    groups_forest = Forest(tops)
    root = groups_forest.roots.first()
    spark = docs.sparkSession
    start = spark.createDataFrame([("groups", count, [], "")] if root else [], "tree string, n long, above array<string>, note string")
    paths = groups_forest.descend(start, tops, _path, "name string, above array<string>").withColumnRenamed("name", "__name")
    above = groups.join(paths, F.col("name").eqNullSafe(F.col("__name"))).select(F.col("name").alias("tree"), F.col("rows").alias("n"), "above", F.concat("digest", F.lit(f" {root['root'] if root else ''}")).alias("note"))
    return rows_forest.descend(above, leaves, _proof, "doc_id long, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean")
