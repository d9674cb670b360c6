"""Document fingerprints: a homomorphic hash of the multiset of a text's paragraphs.

A paragraph is what lies between line feeds. A fingerprint is a vector of two parts, and the vector of a multiset is the sum of
the vectors of its members, so that the order doesn't matter and members come and go by addition and subtraction:

* ``EXACT`` numbers of 64 bits from SHAKE-256 of each whole paragraph, summed modulo 2^64: equal for equal multisets, and for
  others only by a chance of about 2^-64 for each number;
* ``LANES`` numbers of 32 bits, summed modulo 2^32, to which each run of ``RUN`` words of a paragraph adds 1 or -1 by the bits of
  its BLAKE2b digest: the squared length of a difference tells how many runs differ, and so how alike two texts are.
"""

from __future__ import annotations

import base64
from collections.abc import Iterable, Iterator
from hashlib import blake2b, shake_256

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

EXACT, LANES = 16, 256
#: Words of a run; a word of more than ``LONG`` letters, as where a script has no spaces, counts as several.
RUN, LONG = 5, 24
#: Characters of the texts that are hashed at a time.
CHUNK = 1 << 20

#: (members' exact sums, members' lane sums), a row for each multiset.
Sums = tuple[np.ndarray, np.ndarray]


def paragraphs(text: str) -> list[str]:
    return text.split("\n")


def runs(paragraph: str) -> list[str]:
    words = paragraph.split()
    if any(len(w) > LONG for w in words):
        words = [w[i : i + LONG] for w in words for i in range(0, len(w), LONG)]
    return [" ".join(words[i : i + RUN]) for i in range(0, len(words), RUN)]


def _sums(parts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Sums of consecutive rows, ``counts[i]`` of them in row i of the result."""
    out = np.zeros((len(counts), parts.shape[1]), parts.dtype)
    full = np.flatnonzero(counts)
    if len(full):
        out[full] = np.add.reduceat(parts, (np.cumsum(counts) - counts)[full], axis=0)
    return out


def multisets(members: Iterable[list[str]]) -> Sums:
    """The vectors of multisets of paragraphs."""
    whole, pieces, n_whole, n_pieces = [], [], [], []
    for paras in members:
        before = len(pieces)
        for p in paras:
            whole.append(shake_256(p.encode("utf-8", "surrogatepass")).digest(8 * EXACT))
            pieces += [blake2b(r.encode("utf-8", "surrogatepass"), digest_size=LANES // 8).digest() for r in runs(p)]
        n_whole.append(len(paras))
        n_pieces.append(len(pieces) - before)
    exact = _sums(np.frombuffer(b"".join(whole), "<u8").reshape(-1, EXACT), np.array(n_whole))
    counts = np.array(n_pieces)
    lanes = np.zeros((len(counts), LANES), np.uint32)
    bits, at = np.frombuffer(b"".join(pieces), np.uint8).reshape(-1, LANES // 8), 0
    for i, n in enumerate(counts):  # a slice for each text: bits are opened for one text at a time, a long one in parts
        for low in range(at, at + n, 1 << 14):
            some = np.unpackbits(bits[low : min(at + n, low + (1 << 14))], axis=1)
            lanes[i] += 2 * some.sum(axis=0, dtype=np.uint32) - np.uint32(len(some))
        at += n
    return exact, lanes


def insert(a: Sums, b: Sums) -> Sums:
    """The vectors of the multisets with those of ``b`` added."""
    return a[0] + b[0], a[1] + b[1]


def delete(a: Sums, b: Sums) -> Sums:
    """The vectors of the multisets with those of ``b`` taken out."""
    return a[0] - b[0], a[1] - b[1]


def written(sums: Sums) -> list[str]:
    """Base64 of the numbers, little-endian, exact ones first."""
    return [base64.b64encode(e.astype("<u8").tobytes() + x.astype("<u4").tobytes()).decode() for e, x in zip(*sums)]


def read(texts: list[str]) -> Sums:
    raw = [base64.b64decode(t) for t in texts]
    return np.array([np.frombuffer(r, "<u8", EXACT) for r in raw]).reshape(-1, EXACT), np.array([np.frombuffer(r, "<u4", LANES, 8 * EXACT) for r in raw]).reshape(-1, LANES)


def likeness(a: Sums, b: Sums) -> np.ndarray:
    """1 - |difference|^2 / (|a|^2 + |b|^2) over the lanes, from 0 to 1; 1 if and only if the exact parts agree.

    It estimates twice the runs in common over the runs of both, with a standard deviation of at most 1 / sqrt(LANES).
    """
    x, y = (s[1].view(np.int32).astype(float) for s in (a, b))
    lengths = (x * x).sum(axis=1) + (y * y).sum(axis=1)
    gap = (a[1] - b[1]).view(np.int32).astype(float)
    alike = 1 - (gap * gap).sum(axis=1) / np.where(lengths > 0, lengths, 1)
    equal = (a[0] == b[0]).all(axis=1)
    return np.where(equal, 1.0, np.where(lengths > 0, np.clip(alike, 0, np.nextafter(1, 0)), 0.0))


def edited(text: str, following: str) -> str:
    """``text`` with its last floor(length / 2) characters replaced by the first as many of the next text."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


def change(text: str, following: str) -> tuple[list[str], list[str]]:
    """(paragraphs that leave, paragraphs that come) when ``text`` is edited; those before the cut stay as they are."""
    half = len(text) // 2
    cut = len(text) - half
    start = text.rfind("\n", 0, cut) + 1
    return paragraphs(text[start:]), paragraphs(text[start:cut] + following[:half])


SCHEMA = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def _compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of one bucket in order, then those that follow it; each own row meets the row after it."""
    from hashlib import sha256

    names = [c.split()[0] for c in SCHEMA.split(", ")]

    def result(rows: list[tuple], last: Sums | None) -> tuple[pa.RecordBatch, Sums]:
        """Of all rows but the last; ``last`` are the sums of the first one, where they are known."""
        texts = [r[2] for r in rows]
        own = multisets(paragraphs(t) for t in texts[last is not None :])
        if last is not None:
            own = np.concatenate([last[0], own[0]]), np.concatenate([last[1], own[1]])
        mine, following = (own[0][:-1], own[1][:-1]), (own[0][1:], own[1][1:])
        changes = [change(a, b) for a, b in zip(texts, texts[1:])]
        new = insert(delete(mine, multisets(c[0] for c in changes)), multisets(c[1] for c in changes))
        shas = [sha256(edited(a, b).encode("utf-8", "surrogatepass")).hexdigest() for a, b in zip(texts, texts[1:])]
        out = [pa.array([r[1] for r in rows[:-1]], pa.int64()), pa.array([len(t) for t in texts[:-1]], pa.int64()), pa.array(shas, pa.string()), pa.array(written(mine)), pa.array(written(new)), pa.array(likeness(mine, new)), pa.array(likeness(mine, following))]
        return pa.RecordBatch.from_arrays(out, names), (own[0][-1:], own[1][-1:])

    held: list[tuple] = []  # (after, doc_id, text): the first has no result yet
    known, size = None, 0
    for batch in batches:
        for after, doc_id, text in zip(*(c.to_pylist() for c in batch.columns)):
            if held and held[-1][0]:
                continue  # one row after the bucket's own is enough
            held.append((after, doc_id, text))
            size += len(text)
            if size >= CHUNK and len(held) > 1:
                out, known = result(held, known)
                yield out
                held, size = held[-1:], len(text)
    if len(held) > 1:
        yield result(held, known)[0]


#: A place in the order of rows: (id given, id, hash of the text).
Place = tuple[int, int, int]
#: Stands for the first row of an id, whatever its hash.
FIRST = -(1 << 63)


def _places(some: list[Place]) -> Column:
    return F.array(*[F.struct(F.lit(g).alias("given"), F.lit(i).cast("long").alias("id"), F.lit(t).cast("long").alias("tie")) for g, i, t in some])


def _bucket(bounds: list[Place], key: Column) -> Column:
    """The number of the last of ``bounds``, ascending, that isn't above ``key``: first among every so many, then among those after it."""
    step = max(1, int(len(bounds) ** 0.5))
    below = lambda some: F.size(F.filter(some, lambda b: b <= key))
    start = F.greatest(below(_places(bounds[::step])) - 1, F.lit(0)) * step
    return start + F.greatest(below(F.slice(_places(bounds), start + 1, F.lit(step))) - 1, F.lit(0))


def _bounds(rows: DataFrame, buckets: int) -> list[Place]:
    """The first place of each bucket, ascending: one for each bucket on the driver.

    Rows (given, id, tie) are cut at quantiles of their ids; an id, or the lack of one, that spans several is cut by the hash of
    its rows' texts. Quantiles come rounded, so the first places are looked up after.
    """
    n, nulls = rows.agg(F.count("*"), F.count_if(F.col("given") == 0)).first()
    if not n:
        return []
    shares = [i / buckets for i in range(1, buckets)]
    found = rows.where("given = 1").agg(F.percentile_approx("id", shares, 100 * buckets).alias("q")).first()["q"] if shares and n > nulls else []
    spans = {(1, i): found.count(i) for i in set(found or []) if found.count(i) > 1}
    spans |= {(0, 0): buckets * nulls // n} if buckets * nulls > 2 * n else {}
    cuts: set[Place] = {(1, i, FIRST) for i in found or []} | {(1, FIRST, FIRST)}
    key = [F.col("given"), F.col("id")]
    tie = F.lit(FIRST).cast("long")
    if spans:
        hot = F.struct(*key).isin([F.struct(F.lit(g), F.lit(i).cast("long")) for g, i in spans])
        most = max(spans.values())
        ties = F.percentile_approx("tie", [i / most for i in range(1, most)], 100 * most)
        cuts |= {(r["given"], r["id"], t) for r in rows.where(hot).groupBy("given", "id").agg(ties.alias("q")).collect() for t in r["q"]}
        tie = F.when(hot, F.col("tie")).otherwise(tie)
    key = F.struct(*key, tie.alias("tie"))
    firsts = rows.groupBy(_bucket(sorted(cuts), key).alias("bucket")).agg(F.min(key).alias("first")).collect()
    return sorted(tuple(r["first"]) for r in firsts)


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", buckets: int | None = None) -> DataFrame:
    """(doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next) for every row of ``docs``.

    The next document is that of the next id, after the last the first; of rows that repeat an id (or have none: these come
    first) that of the next hash of the text. A null text counts as empty; an empty text is one empty paragraph. The edited
    text's fingerprint is made from the text's own by taking out the paragraphs after the cut and putting in the new ones. An
    only row is its own next; an empty table gives no rows; further columns are ignored.

    Texts are shuffled once, into ``buckets`` (the session's shuffle partitions) of consecutive ids; the first rows of a bucket
    also go to the one before. Rows that repeat both id and text lie in one bucket.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    doc_id = F.col(id_col).cast("long")
    rows = docs.select(doc_id.isNotNull().cast("int").alias("given"), F.coalesce(doc_id, F.lit(0).cast("long")).alias("id"), F.xxhash64(text).alias("tie"), text.alias("text"))
    bounds = _bounds(rows, buckets or int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    if not bounds:
        return docs.sparkSession.createDataFrame([], SCHEMA)
    rows = rows.withColumn("bucket", _bucket(bounds, F.struct("given", "id", "tie")))
    first = F.element_at(_places(bounds), F.col("bucket") + 1)
    leads = (first["given"] == F.col("given")) & (first["id"] == F.col("id")) & ((first["tie"] == F.col("tie")) | (first["tie"] == F.lit(FIRST)))
    place = lambda bucket, after: F.struct(bucket.cast("int").alias("bucket"), F.lit(after).alias("after"))
    own, before = place(F.col("bucket"), False), place(F.pmod(F.col("bucket") - 1, F.lit(len(bounds))), True)
    dealt = rows.select("given", "id", "tie", "text", F.explode(F.when(leads, F.array(own, before)).otherwise(F.array(own))).alias("to"))
    dealt = dealt.select("to.bucket", "to.after", "given", "id", "tie", "text").repartitionById(len(bounds), "bucket")
    return dealt.sortWithinPartitions("after", "given", "id", "tie").select("after", F.when(F.col("given") == 1, F.col("id")).alias("doc_id"), "text").mapInArrow(_compare, SCHEMA)
