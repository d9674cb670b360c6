"""Removal of repeated passages by suffix arrays.

A byte goes if a string of ``length`` bytes over it also starts somewhere else. Sorting every suffix of a corpus would move it
many times over, so suffixes are first dealt to shards by content: each window of ``length`` bytes is named by the least hash
of its short grams, neighbouring windows named by the same place form a block, and a name that occurs once can't repeat. Blocks equal to
another block repeat as a whole. The others meet by name in shards; each shard builds a suffix array by Larsson-Sadakane
refinement and common prefixes by Kasai's rule, both in numpy. A name with very many different blocks is split over several
shards, whose sorted lists of distinct windows, each once, are then merged by binary search: a window that N blocks have is in
N / ``SPLIT`` lists at most. Names and windows are compared by hashes of 64 and 128 bits, not byte by byte.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from contactspark.llm.common import materialise

GRAM = 32  # bytes; windows are named by their least gram
PLACE = np.uint64(31)  # bits for a place in a text; the first of equal grams counts
SPLIT = 400  # different blocks of one name that go to one shard
SHARD_BYTES = 1 << 20
HOT_KINDS = 1000
_RANDOM = np.random.default_rng(9_2024)
_LETTERS = _RANDOM.integers(0, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_ODD = _RANDOM.integers(0, 1 << 63, 16, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def gram_hashes(data: np.ndarray) -> np.ndarray:
    """A 64-bit hash of the GRAM bytes from each place."""
    h, width, level = _LETTERS[data], 1, 0
    while width < GRAM:
        h = h[:-width] * _ODD[level] + h[width:]
        h ^= h >> np.uint64(31)
        width, level = 2 * width, level + 1
    return h * _ODD[-1]


def sliding_minimum(h: np.ndarray, width: int) -> np.ndarray:
    size = 1
    while 2 * size <= width:
        h = np.minimum(h[:-size], h[size:])
        size *= 2
    return np.minimum(h[: len(h) - (width - size)], h[width - size :]) if size < width else h


def blocks(data: bytes, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[int]]:
    """(names, first windows, numbers of windows, digests of the bytes) of the blocks of a text."""
    h = gram_hashes(np.frombuffer(data, np.uint8))
    least = sliding_minimum(h >> PLACE << PLACE | np.arange(len(h), dtype=np.uint64), length - GRAM + 1)
    place = (least & np.uint64((1 << 31) - 1)).astype(np.int64)
    new = np.flatnonzero(np.concatenate([[True], place[1:] != place[:-1]]))
    sizes = np.diff(np.append(new, len(place)))
    view, digest = memoryview(data), xxhash.xxh3_64_intdigest
    marks = [digest(view[a : a + n + length - 1]) for a, n in zip(new.tolist(), sizes.tolist())]
    return h[place[new]], new, sizes, marks


def suffix_array(data: np.ndarray) -> np.ndarray:
    """Larsson-Sadakane: sort by eight bytes, then refine only the groups that are still equal, doubling the depth."""
    n = len(data)
    padded = np.concatenate([data.astype(np.uint64) + np.uint64(1), np.zeros(7, np.uint64)])  # 9 bits: an end sorts first
    key = np.zeros(n, np.uint64)
    depth = 7
    for i in range(depth):
        key = key << np.uint64(9) | padded[i : i + n]
    order = np.argsort(key)
    ordered = key[order]
    rank = np.empty(n + 1, np.int64)
    rank[n] = -1
    first = np.flatnonzero(np.concatenate([[True], ordered[1:] != ordered[:-1]]))
    size = np.diff(np.append(first, n))
    rank[order] = np.repeat(first, size)
    while True:
        place = np.flatnonzero(np.repeat(size > 1, size))  # places in the order whose group is open
        if not len(place):
            return order
        at = order[place]
        group = rank[at]
        behind = rank[np.minimum(at + depth, n)] + 1
        again = np.argsort(group * (n + 1) + behind)
        order[place] = at[again]
        group, behind = group[again], behind[again]
        start = np.concatenate([[True], (group[1:] != group[:-1]) | (behind[1:] != behind[:-1])])
        rank[order[place]] = place[np.maximum.accumulate(np.where(start, np.arange(len(place)), 0))]
        heads = np.ones(n, bool)
        heads[place] = start
        size = np.diff(np.append(np.flatnonzero(heads), n))
        depth *= 2


def common_prefixes(data: np.ndarray, order: np.ndarray) -> np.ndarray:
    """Kasai: the common prefix of each suffix in the order with the one before it; 0 for the first.

    Along the text a prefix is at most one shorter than the last; where the letters before both suffixes are equal it is
    exactly one shorter, so only the other places are compared.
    """
    n = len(data)
    before = np.full(n, -1, np.int64)
    before[order[1:]] = order[:-1]
    prev = np.concatenate([[-1], data[:-1].astype(np.int64)])
    free = (before < 0) | (np.arange(n) == 0) | (before == 0)
    free |= np.where(free, True, prev != prev[before])
    free |= np.concatenate([[True], before[:-1] < 0])  # nothing is known after the first suffix of the order
    places = np.flatnonzero(free & (before >= 0))
    found = np.zeros(n, np.int64)
    a, b, live = places.copy(), before[places], np.arange(len(places))
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    words = np.ascontiguousarray(np.lib.stride_tricks.sliding_window_view(padded, 8)).view("<u8").ravel()  # eight bytes from each place
    while len(live):
        differ = words[a] ^ words[b]
        low = (differ & (~differ + np.uint64(1))).astype(np.float64)  # the first bit that differs
        same = np.where(differ == 0, 8, np.log2(np.where(low > 0, low, 1)).astype(np.int64) >> 3)
        same = np.minimum(same, n - np.maximum(a, b))
        found[places[live]] += same
        on = same == 8
        a, b, live = a[on] + 8, b[on] + 8, live[on]
    base = np.maximum.accumulate(np.where(free, np.arange(n), 0))
    plcp = np.maximum(found[base] - (np.arange(n) - base), 0)
    plcp[before < 0] = 0
    return plcp[order]


def _runs(block: np.ndarray, offset: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(block, first, last) of each run of consecutive offsets in a block."""
    order = np.lexsort((offset, block))
    block, offset = block[order], offset[order]
    first = np.flatnonzero(np.concatenate([[True], (block[1:] != block[:-1]) | (offset[1:] != offset[:-1] + 1)])) if len(block) else np.zeros(0, int)
    last = np.append(first[1:], len(block)) - 1 if len(block) else first
    return block[first], offset[first], offset[last]


def _merge(starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The union of intervals."""
    order = np.argsort(starts, kind="stable")
    starts, ends = starts[order], np.maximum.accumulate(ends[order])
    new = np.concatenate([[True], starts[1:] > ends[:-1]])
    return starts[new], np.append(ends[np.flatnonzero(new)[1:] - 1], ends[-1])


SPANS = pa.schema([("doc", pa.int64()), ("mark", pa.int64()), ("low", pa.int64()), ("high", pa.int64())])


def _repeated_in(shard: pa.Table, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of the blocks' windows: (block, offset, class by content, whether the class has another window of the shard)."""
    texts = [v.as_buffer() for v in shard["data"].combine_chunks()]
    data = np.concatenate([np.frombuffer(t, np.uint8) for t in texts])
    sizes = np.array([len(t) for t in texts])
    starts = np.cumsum(sizes) - sizes
    block = np.repeat(np.arange(len(texts)), sizes)
    offset = np.arange(len(data)) - starts[block]
    order = suffix_array(data)
    kinds = np.cumsum(common_prefixes(data, order) < length)
    whole = (sizes[block] - offset >= length)[order]
    places, kinds = order[whole], kinds[whole]
    count = np.bincount(kinds)
    return block[places], offset[places], kinds, count[kinds] > 1


def _distinct(lists: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first half, second half, number of lists) of each distinct digest in lists that have a digest once each, ascending."""
    rows = np.concatenate([x[:, :2] for x in lists])
    high, low = np.ascontiguousarray(rows[:, 0]).view(np.uint64), rows[:, 1]
    order = np.lexsort((low, high))
    high, low = high[order], low[order]
    first = np.flatnonzero(np.concatenate([[True], (high[1:] != high[:-1]) | (low[1:] != low[:-1])]))
    return high[first], low[first], np.diff(np.append(first, len(high)))


def spans(docs: DataFrame, length: int = 200) -> DataFrame:
    """(doc, mark, low, high): byte ranges of ``docs`` (doc, mark, text) that repeated strings cover; ranges may overlap."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["name", "digest", "doc", "mark", "start", "n"]
        for batch in batches:
            out: list[list] = [[] for _ in names]
            for doc, mark, text in zip(*(batch.column(i).to_pylist() for i in range(3))):
                data = text.encode("utf-8", "replace") if text else b""
                if len(data) >= length:
                    name, at, n, digest = blocks(data, length)
                    for column, values in zip(out, (name.view(np.int64), np.array(digest, np.uint64).view(np.int64), np.full(len(at), doc), np.full(len(at), mark), at, n)):
                        column.append(values)
            if out[0]:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c).astype(np.int64)) for c in out], names)

    found = materialise(docs.mapInArrow(cut, "name long, digest long, doc long, mark long, start long, n long"), "blocks")
    names = materialise(found.groupBy("name").agg(F.count("*").alias("times")).where("times > 1").select("name"), "names")
    found = materialise(found.join(names, "name"), "shared-blocks")
    kinds = found.groupBy("name", "digest").agg(F.count("*").alias("times"), F.min(F.struct("doc", "mark", "start", "n")).alias("one"))
    kinds = materialise(kinds, "kinds")
    # blocks that hold more than a thousandth of all rows are at most a thousand kinds: they are sent to every task, so that
    # their rows don't meet in one
    often = kinds.where("times > 1").select("name", "digest", (F.col("times") > found.count() / HOT_KINDS).alias("hot"))
    hot = F.broadcast(often.where("hot").select("name", "digest"))
    whole = found.join(hot, ["name", "digest"], "left_semi").unionByName(found.join(hot, ["name", "digest"], "left_anti").join(often.where("not hot").select("name", "digest"), ["name", "digest"], "left_semi"))
    whole = materialise(whole.select("doc", "mark", F.col("start").alias("low"), (F.col("start") + F.col("n") + (length - 1)).alias("high")), "whole")

    several = materialise(kinds.groupBy("name").agg(F.count("*").alias("kinds")).where("kinds > 1"), "several")
    to_sort = materialise(kinds.join(several, "name").select("name", "digest", "kinds", "times", "one.*"), "to-sort")
    total = to_sort.agg(F.sum(F.col("n") + (length - 1)), F.sum(F.when(F.col("kinds") > SPLIT, F.col("n")))).first()
    shards, ranges = max(256, (total[0] or 0) // SHARD_BYTES), max(64, (total[1] or 0) // 200_000)
    split = F.col("kinds") > SPLIT
    shard = F.when(split, F.xxhash64("name", F.pmod("digest", F.ceil(F.col("kinds") / SPLIT)))).otherwise(F.pmod(F.xxhash64("name"), F.lit(shards)))
    wanted = to_sort.select("doc", "mark", F.struct(shard.alias("shard"), split.alias("split"), (F.col("times") > 1).alias("done"), "start", "n").alias("want"))
    wanted = wanted.groupBy("doc", "mark").agg(F.collect_list("want").alias("wants"))

    def fetch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for doc, mark, text, wants in zip(*(batch.column(i).to_pylist() for i in range(4))):
                data = text.encode("utf-8", "replace")
                rows += [(w["shard"], w["split"], w["done"], doc, mark, w["start"], data[w["start"] : w["start"] + w["n"] + length - 1]) for w in wants]
            kinds = [pa.int64(), pa.bool_(), pa.bool_(), pa.int64(), pa.int64(), pa.int64(), pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], ["shard", "split", "done", "doc", "mark", "start", "data"])

    sorting = docs.join(wanted, ["doc", "mark"]).select("doc", "mark", "text", "wants").mapInArrow(fetch, "shard long, split boolean, done boolean, doc long, mark long, start long, data binary")

    def sort_shard(table: pa.Table) -> pa.Table:
        """Ranges that repeat within the shard; of split names also each distinct window once, packed by range of its digest.

        A window goes with its place if the shard has it there alone and nothing else tells yet that it repeats.
        """
        block, offset, kind, repeated = _repeated_in(table, length)
        doc, mark, start, done, apart = (table[c].to_numpy() for c in ("doc", "mark", "start", "done", "split"))
        out: list[tuple] = []
        loose = repeated & ~done[block]
        at, low, high = _runs(block[loose], offset[loose])
        columns = (doc[at], mark[at], start[at] + low, start[at] + high + length)
        out += [(*row, None, None, None) for row in zip(*(c.tolist() for c in columns))]
        if len(apart) and apart[0]:  # a shard of a split name has no other names
            first = np.flatnonzero(np.diff(kind, prepend=-1))  # classes follow each other in the order of suffixes
            block, offset, known = block[first], offset[first], (repeated | done[block])[first]
            texts = [memoryview(v.as_buffer()) for v in table["data"].combine_chunks()]
            digests = np.array([[d >> 64, d & (1 << 64) - 1] for d in (xxhash.xxh3_128_intdigest(texts[b][o : o + length]) for b, o in zip(block.tolist(), offset.tolist()))], np.uint64).reshape(-1, 2)
            order = np.lexsort((digests[:, 1], digests[:, 0]))
            to = (digests[order, 0] % np.uint64(ranges)).astype(np.int64)
            packed = np.stack([digests[order, 0].view(np.int64), digests[order, 1].view(np.int64), doc[block[order]], mark[block[order]], start[block[order]] + offset[order], known[order].astype(np.int64)], axis=1)
            for r in np.unique(to).tolist():
                out.append((None, None, None, None, r, int(table["shard"][0].as_py()), packed[to == r].tobytes()))
        kinds = [pa.int64()] * 6 + [pa.binary()]
        return pa.Table.from_arrays([pa.array([x[i] for x in out], k) for i, k in enumerate(kinds)], ["doc", "mark", "low", "high", "range", "shard", "windows"])

    sorted_shards = materialise(sorting.groupBy("shard").applyInArrow(sort_shard, "doc long, mark long, low long, high long, range long, shard long, windows binary"), "sorted-shards")

    def merge(table: pa.Table) -> pa.Table:
        """Windows of one shard that another shard has as well: each sorted list is looked up in the distinct windows of all."""
        lists = [np.frombuffer(v.as_buffer(), np.int64).reshape(-1, 6) for v in table["windows"].combine_chunks()]
        distinct = _distinct(lists)
        keep = np.concatenate([rows[among(rows, distinct) & (rows[:, 5] == 0)][:, 2:5] for rows in lists])
        to = (keep[:, 0] ^ keep[:, 1]) % ranges
        return pa.table({"bucket": pa.array(np.unique(to)), "hits": pa.array([keep[to == t].tobytes() for t in np.unique(to).tolist()], pa.binary())})

    def among(rows: np.ndarray, distinct: tuple[np.ndarray, np.ndarray, np.ndarray]) -> np.ndarray:
        """Whether more than one list has each row's window."""
        high, low, lists = distinct
        mine = np.ascontiguousarray(rows[:, 0]).view(np.uint64)
        at = np.searchsorted(high, mine)
        while (other := np.flatnonzero(low[at] != rows[:, 1])).size:  # equal halves of different digests
            at[other] += 1
        return lists[at] > 1

    def join_hits(table: pa.Table) -> pa.Table:
        """The single windows of the same documents as ranges."""
        keep = np.concatenate([np.frombuffer(v.as_buffer(), np.int64).reshape(-1, 3) for v in table["hits"].combine_chunks()])
        keep = keep[np.lexsort((keep[:, 2], keep[:, 1], keep[:, 0]))]
        first = np.flatnonzero(np.concatenate([[True], (np.diff(keep[:, 0]) != 0) | (np.diff(keep[:, 1]) != 0) | (np.diff(keep[:, 2]) > length)]))
        last = np.append(first[1:], len(keep)) - 1
        return pa.Table.from_arrays([pa.array(keep[first, 0]), pa.array(keep[first, 1]), pa.array(keep[first, 2]), pa.array(keep[last, 2] + length)], schema=SPANS)

    merged = sorted_shards.where("windows is not null").groupBy("range").applyInArrow(merge, "bucket long, hits binary")
    merged = merged.groupBy("bucket").applyInArrow(join_hits, "doc long, mark long, low long, high long")
    inside = sorted_shards.where("windows is null").select("doc", "mark", "low", "high")
    return whole.unionByName(inside).unionByName(merged)


def without_repeats(docs: DataFrame, length: int = 200, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, spans, kept) for every row; ``kept`` is what is left of the UTF-8 bytes.

    Strings are judged on the input, overlaps count, the same document counts as elsewhere, and nothing matches across
    documents. A null text is empty; texts shorter than ``length`` lose nothing; repeated rows and rows that repeat an id are
    documents of their own, so equal texts of at least ``length`` bytes lose everything; ids may be null; further columns are
    ignored; an empty table gives no rows.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    doc_id = F.col(id_col).cast("long")
    rows = docs.select(doc_id.alias("doc_id"), F.coalesce(doc_id, F.lit(0).cast("long")).alias("doc"), F.xxhash64(text).alias("mark"), text.alias("text"))  # equal texts have equal cuts, so a null id may share 0's
    cuts = spans(rows.select("doc", "mark", "text"), length).groupBy("doc", "mark").agg(F.collect_set(F.struct("low", "high")).alias("cuts"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for doc, text, cuts in zip(*(batch.column(i).to_pylist() for i in range(3))):
                data = text.encode("utf-8", "replace")
                low, high = _merge(np.array([c["low"] for c in cuts]), np.array([c["high"] for c in cuts])) if cuts else (np.zeros(0, int), np.zeros(0, int))
                low, high = low.tolist(), high.tolist()
                kept = b"".join(data[a:b] for a, b in zip([0, *high], [*low, len(data)]))
                out.append((doc, len(data), len(data) - len(kept), len(low), [{"low": a, "high": b} for a, b in zip(low, high)], kept))
            kinds = [pa.int64()] * 4 + [pa.list_(pa.struct([("low", pa.int64()), ("high", pa.int64())])), pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in out], k) for i, k in enumerate(kinds)], ["doc_id", "n_bytes", "n_removed", "n_spans", "spans", "kept"])

    schema = "doc_id long, n_bytes long, n_removed long, n_spans long, spans array<struct<low: long, high: long>>, kept binary"
    return rows.join(cuts, ["doc", "mark"], "left").select("doc_id", "text", "cuts").mapInArrow(run, schema)

