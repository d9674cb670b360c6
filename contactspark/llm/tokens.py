"""Token ids as fixed-width packed blocks.

Each id takes the least number of bits that the vocabulary needs. A block holds the ids of whole consecutive documents with
their lengths, so any document is found from its block's row and unpacked by numpy without reading other blocks. Blocks are
rows of a Parquet table, which any store that Spark writes to can hold: (part, block, first, least_id, greatest_id, doc_ids,
lengths, n_ids, bits, payload); ``first`` is the number of ids before the block in its part, and parts follow each other in
ascending doc_id.
"""

from __future__ import annotations

import json
import re
import sys
import uuid
import zlib
from array import array
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from contactspark.llm.common import id_and_text, materialise, run_dir

BLOCK_SCHEMA = "part int, block int, first long, least_id long, greatest_id long, doc_ids array<long>, lengths array<int>, n_ids long, bits int, payload binary"
BLOCK_COLUMNS = [c.split()[0] for c in BLOCK_SCHEMA.split(", ")]
BLOCK_IDS = 1 << 16
#: Words whose ids a Python worker remembers at most.
REMEMBERED = 600_000


def bits_for(vocabulary: int) -> int:
    return max(1, (vocabulary - 1).bit_length())


def pack(ids: np.ndarray, bits: int) -> bytes:
    """Little-endian bit packing: bit j of id i is bit ``i * bits + j`` of the payload."""
    if bits in (8, 16, 32):
        return ids.astype(f"<u{bits // 8}").tobytes()
    planes = (ids.astype(np.uint64)[:, None] >> np.arange(bits, dtype=np.uint64)) & np.uint64(1)
    return np.packbits(planes.astype(np.uint8).ravel(), bitorder="little").tobytes()


def unpack(payload: bytes, bits: int, start: int, n: int) -> np.ndarray:
    """Ids ``start`` to ``start + n`` of a payload; only their bytes are touched."""
    if bits in (8, 16, 32):
        return np.frombuffer(payload, f"<u{bits // 8}", n, start * bits // 8).astype(np.uint32)
    low = start * bits
    raw = np.frombuffer(payload, np.uint8, (low + n * bits + 7) // 8 - low // 8, low // 8)
    planes = np.unpackbits(raw, bitorder="little")[low % 8 : low % 8 + n * bits].reshape(n, bits)
    return (planes.astype(np.uint32) << np.arange(bits, dtype=np.uint32)).sum(axis=1, dtype=np.uint32)


# The pre-tokenizer and normalisers under which no token reaches across white space.
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
NORMALISERS = ({"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"})


def splits_at_spaces(config: dict) -> bool:
    """Whether a tokenizer file drops white space before its model, word by word: read from the file's own parts."""
    within = lambda part, key: part.get(key, []) if part and part.get("type") == "Sequence" else [part]
    normal, before = within(config.get("normalizer"), "normalizers"), within(config.get("pre_tokenizer"), "pretokenizers")
    if not all(n in normal for n in NORMALISERS) or len(normal) != len(NORMALISERS) or len(before) != 2 or config.get("truncation") or config.get("padding"):
        return False
    cut, to_bytes = before
    words = cut.get("type") == "Split" and cut.get("pattern") == {"Regex": SPLIT} and cut.get("behavior") == "Removed" and cut.get("invert") is True
    return words and to_bytes.get("type") == "ByteLevel" and not to_bytes.get("add_prefix_space") and to_bytes.get("use_regex") is False


class Words(dict):
    """The ids of words, learned as they are first asked for; once there are ``REMEMBERED`` all are forgotten."""

    def __init__(self, learn: Callable[[str], bytes]) -> None:
        super().__init__()
        self.learn = learn

    def __missing__(self, word: str) -> bytes:
        if len(self) >= REMEMBERED:
            self.clear()
        found = self[word] = self.learn(word)
        return found


class Encoder:
    """Ids of whole texts, by the tokenizer file at ``path``.

    If the file's own normaliser and pre-tokenizer show that it lowers the case, drops white space and never looks across it,
    the words of a Latin text are encoded once each and remembered; every other text, and every text under another file, is
    encoded as a whole. Both give the ids of ``Tokenizer.encode`` on the whole text. A word of letters goes right to the
    file's model, in the letters that the file's pre-tokenizer writes for each; other words go through the whole tokenizer.
    """

    #: Texts of Latin letters, digits, ASCII punctuation and usual white space. Without U+0130, whose lower case is two letters.
    LATIN = re.compile("[\t\n\r -~À-ÖØ-öø-įı-ɏ]*")
    TAIL = re.compile(r"[!-/:-@\[-`{-~]+(?=[\t\n\r ])")  # punctuation before white space
    LETTERS = re.compile(r"[^\W\d_]+")

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as file:
            config = json.load(file)
        self.added = [t["content"] for t in config.get("added_tokens") or []]
        self.by_word = splits_at_spaces(config)
        self.vocabulary = self.tokenizer.get_vocab_size()
        self.wide, self.code = (2, "H") if self.vocabulary <= 1 << 16 else (4, "I")
        self.kind = f"<u{self.wide}"
        self.words = Words(self._learn)
        self.letters: dict[int, str] = {}
        if self.by_word:
            normal, before = self.tokenizer.normalizer.normalize_str, self.tokenizer.pre_tokenizer.pre_tokenize_str
            for c in map(chr, range(0x61, 0x250)):
                if self.LETTERS.fullmatch(c) and normal(c) == c and len(piece := before(c)) == 1:
                    self.letters[ord(c)] = piece[0][0]

    def _bytes(self, ids: list[int]) -> bytes:
        out = array(self.code, ids)
        if sys.byteorder == "big":
            out.byteswap()
        return out.tobytes()

    def _raw(self, texts: list[str]) -> list[bytes]:
        return [self._bytes(e.ids) for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _learn(self, word: str) -> bytes:
        if self.LETTERS.fullmatch(word):
            if word.isascii():  # letters that stand for themselves
                return self._bytes([t.id for t in self.tokenizer.model.tokenize(word)])
            if all(ord(c) in self.letters for c in word):
                return self._bytes([t.id for t in self.tokenizer.model.tokenize(word.translate(self.letters))])
        return self._raw([word])[0]

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """The ids of each text as little-endian integers of ``kind``."""
        if not self.by_word:
            return self._raw([t or "" for t in texts])
        latin, tail = self.LATIN.fullmatch, self.TAIL.sub
        plain = [not t or latin(t) is not None and not any(a in t for a in self.added) for t in texts]
        get = self.words.__getitem__
        return [(b"".join(map(get, tail(r" \g<0>", t.lower()).split())) if t else b"") if p else self._raw([t])[0] for t, p in zip(texts, plain)]


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    return Encoder(path)


def encoded(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, tie, ids): the ids of each whole text as little-endian integers; ``tie`` is a hash of the text."""
    batch_docs = 256

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(tokenizer)
        for batch in batches:
            for at in range(0, batch.num_rows, batch_docs):
                some = batch.slice(at, batch_docs)
                yield pa.RecordBatch.from_arrays([some.column(0), some.column(2), pa.array(enc.encode(some.column(1).to_pylist()), pa.binary())], ["doc_id", "tie", "ids"])

    return id_and_text(docs, id_col, text_col).withColumn("tie", F.xxhash64("text")).mapInArrow(run, "doc_id long, tie long, ids binary")


def write_ids(docs: DataFrame, path: str, tokenizer: str, end_id: int = 1, id_col: str = "doc_id", text_col: str = "text", partitions: int | None = None) -> None:
    """Encode every whole text, append ``end_id`` and write the blocks at ``path``, in ascending doc_id.

    Texts are encoded where they lie; only ids are sorted. Null texts count as empty: they have the end id only. Null ids come
    first. Rows of one id follow each other by a hash of their text; repeated rows are all written. An empty table gives an
    empty file. Further columns are ignored. ``tokenizer`` is a file that every executor has.
    """
    n = partitions or max(64, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, part = encoder(tokenizer), TaskContext.get().partitionId()
        bits, end = bits_for(max(enc.vocabulary, end_id + 1)), np.array([end_id], enc.kind).tobytes()
        wide, block, first = np.dtype(enc.kind).itemsize, 0, 0
        ids, data, size = [], [], 0

        def flush() -> pa.RecordBatch:
            nonlocal block, first, ids, data, size
            lengths, known = [len(x) // wide for x in data], [i for i in ids if i is not None]
            payload = pack(np.frombuffer(b"".join(data), enc.kind), bits)
            columns = [part, block, first, min(known, default=None), max(known, default=None), ids, lengths, size, bits, payload]
            kinds = [pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int32()), pa.int64(), pa.int32(), pa.binary()]
            out = pa.RecordBatch.from_arrays([pa.array([c], k) for c, k in zip(columns, kinds)], BLOCK_COLUMNS)
            block, first = block + 1, first + size
            ids, data, size = [], [], 0
            return out

        for batch in batches:
            for doc, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                ids.append(doc)
                data.append(raw + end)
                size += len(raw) // wide + 1
                if size >= BLOCK_IDS:
                    yield flush()
        if ids:
            yield flush()

    rows = materialise(encoded(docs, tokenizer, id_col, text_col), "encoded")  # the bounds of ranges read it a second time
    rows = rows.repartitionByRange(n, "doc_id", "tie").sortWithinPartitions("doc_id", "tie").select("doc_id", "ids")
    rows.mapInArrow(run, BLOCK_SCHEMA).write.option("compression", "zstd").parquet(path)


def open_ids(spark: SparkSession, path: str) -> DataFrame:
    """The blocks at ``path`` with ``start``: the number of ids before each block in the whole file."""
    blocks = spark.read.schema(BLOCK_SCHEMA).parquet(path)
    along = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # a row for each part
    parts = blocks.groupBy("part").agg(F.sum("n_ids").alias("ids")).select("part", F.coalesce(F.sum("ids").over(along), F.lit(0)).alias("before"))
    return blocks.join(F.broadcast(parts), "part").withColumn("start", F.col("before") + F.col("first")).drop("before")


def digests(blocks: DataFrame) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document of ``open_ids``, from the unpacked ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                ids = unpack(row["payload"], row["bits"], 0, row["n_ids"]).astype("<u4")
                lengths = np.array(row["lengths"], np.int64)
                ends = np.cumsum(lengths)
                crc = [zlib.crc32(ids[e - n : e].tobytes()) for e, n in zip(ends.tolist(), lengths.tolist())]
                yield pa.RecordBatch.from_arrays([pa.array(row["doc_ids"], pa.int64()), pa.array(row["start"] + ends - lengths), pa.array(lengths), pa.array(crc, pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])

    return blocks.select("start", "doc_ids", "lengths", "n_ids", "bits", "payload").mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def read_document(blocks: DataFrame, doc_id: int) -> list[np.ndarray]:
    """Random access: the ids of each row of one document. Only blocks whose range of ids holds it are read."""
    out, wanted = [], F.lit(doc_id).cast("long")
    for row in blocks.where((F.col("least_id") <= wanted) & (F.col("greatest_id") >= wanted) & F.array_contains("doc_ids", wanted)).orderBy("start").toLocalIterator():
        at = np.concatenate([[0], np.cumsum(row["lengths"])])
        out += [unpack(row["payload"], row["bits"], int(at[i]), n) for i, (d, n) in enumerate(zip(row["doc_ids"], row["lengths"])) if d == doc_id]
    return out


def written(docs: DataFrame, tokenizer: str, end_id: int = 1) -> DataFrame:
    """Write the ids of ``docs`` in the run's folder and read them back as ``digests``."""
    spark = docs.sparkSession
    path = f"{run_dir(spark)}/ids-{uuid.uuid4().hex}"
    write_ids(docs, path, tokenizer, end_id)
    return digests(open_ids(spark, path))
