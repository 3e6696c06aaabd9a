"""Token ids in fixed-width bit-packed shards, in key order, with random access.

A shard is a byte string that describes itself: a header, the keys of its
documents with the end of each in ids, the byte offset of each block, then the
blocks. A block holds ``block_ids`` ids at the least number of bits that the
vocabulary needs, first bit lowest, padded to a whole byte; numpy unpacks any
block on its own. Shards lie as rows of a Parquet table in the shared folder, so
Spark's committer guards the writes against lost executors; ``export`` puts them
into plain files.

Defined results: a null text has only the end id. Null keys come first; rows
with one key are ordered by a hash of the text, then by text. An empty table gives an empty result.
"""

from __future__ import annotations

import functools
import os
import re
import struct
import unicodedata
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import frugal, partitions_for, shared_folder
from .pretoken import LETTER, NUMBER, OTHER, Arena, Words, class_table, disputed, slices

MAGIC, HEADER = b"FLTOKEN1", struct.Struct("<8sIIQQ")
#: Ids of a block, and about how many ids a shard holds (it ends with a whole document).
BLOCK_IDS, SHARD_IDS = 4096, 2_000_000
#: Words that are encoded in one call.
TOGETHER = 200
#: Words that a worker remembers between tasks; characters worked on at once. They bound memory only.
MEMO, BLOCK, RUN = 400_000, 6_000_000, 1_500_000
SHARD_SCHEMA = "part int, seq int, before long, n_docs long, n_ids long, shard binary"


def bits_for(vocabulary: int) -> int:
    """Bits of the largest id of a vocabulary."""
    return max(1, (vocabulary - 1).bit_length())


def pack(ids: np.ndarray, bits: int) -> bytes:
    """The lowest ``bits`` bits of each id, end to end."""
    if bits in (8, 16, 32):
        return ids.astype(f"<u{bits // 8}").tobytes()
    spread = (ids.astype(np.uint32)[:, None] >> np.arange(bits, dtype=np.uint32)) & np.uint32(1)
    return np.packbits(spread.astype(np.uint8).ravel(), bitorder="little").tobytes()


def unpack(data: bytes | memoryview, n: int, bits: int) -> np.ndarray:
    """The first n ids of packed bytes, as uint32."""
    if bits in (8, 16, 32):
        return np.frombuffer(data, dtype=f"<u{bits // 8}", count=n).astype(np.uint32)
    spread = np.unpackbits(np.frombuffer(data, dtype=np.uint8), count=n * bits, bitorder="little").reshape(n, bits)
    return spread.astype(np.uint32) @ (np.uint32(1) << np.arange(bits, dtype=np.uint32))


def make_shard(keys: list[int | None], ends: np.ndarray, ids: np.ndarray, bits: int, block_ids: int = BLOCK_IDS) -> bytes:
    """One shard of documents whose ids lie end to end."""
    blocks = [pack(ids[i : i + block_ids], bits) for i in range(0, len(ids), block_ids)]
    offsets = np.zeros(len(blocks) + 1, dtype="<u8")
    np.cumsum([len(b) for b in blocks], out=offsets[1:])
    null = np.array([k is None for k in keys], dtype=np.uint8)
    numbers = np.array([0 if k is None else k for k in keys], dtype="<i8")
    head = HEADER.pack(MAGIC, bits, block_ids, len(keys), len(ids))
    return b"".join([head, null.tobytes(), numbers.tobytes(), ends.astype("<u8").tobytes(), offsets.tobytes(), *blocks])


class Shard:
    """Reads a shard: all of it, one document, or any range of ids."""

    def __init__(self, data: bytes | memoryview):
        magic, self.bits, self.block_ids, self.n_docs, self.n_ids = HEADER.unpack_from(data)
        if magic != MAGIC:
            raise ValueError("these bytes are no token shard")
        at, n = HEADER.size, self.n_docs
        self.null = np.frombuffer(data, np.uint8, n, at).astype(bool)
        self.keys = np.frombuffer(data, "<i8", n, at + n)
        self.ends = np.frombuffer(data, "<u8", n, at + 9 * n).astype(np.int64)
        n_blocks = -(-self.n_ids // self.block_ids)
        self.offsets = np.frombuffer(data, "<u8", n_blocks + 1, at + 17 * n).astype(np.int64)
        self.payload = memoryview(data)[at + 17 * n + 8 * (n_blocks + 1) :]

    def ids(self, begin: int, end: int) -> np.ndarray:
        """The ids from begin to end, by unpacking only the blocks that hold them."""
        if begin >= end:
            return np.zeros(0, dtype=np.uint32)
        first, last = begin // self.block_ids, (end - 1) // self.block_ids
        parts = [unpack(self.payload[self.offsets[b] : self.offsets[b + 1]], min(self.block_ids, self.n_ids - b * self.block_ids), self.bits) for b in range(first, last + 1)]
        return np.concatenate(parts)[begin - first * self.block_ids : end - first * self.block_ids]

    def document(self, i: int) -> np.ndarray:
        return self.ids(int(self.ends[i - 1]) if i else 0, int(self.ends[i]))


class WordBpe:
    """A tokenizer of the tokenizers library whose words are encoded once and remembered.

    It holds for tokenizers that put texts into NFC and lower case, drop white
    space and merge each word on its own. Texts in which an added token's string
    stands go through the library whole.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.size = self.tokenizer.get_vocab_size()
        added = [re.escape(t.content) for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.added = re.compile("|".join(added)).search if added else lambda _: None
        self.arena = Arena()
        self.classes = class_table().copy()
        split = self.tokenizer.pre_tokenizer.pre_tokenize_str
        for c in disputed().tolist():  # Unicode versions differ: the library decides
            one = [lead for lead in ("a", "!") if len(split(f"{lead}{chr(c)}")) == 1]
            self.classes[c] = LETTER if one == ["a"] else OTHER if one == ["!"] else NUMBER

    @staticmethod
    def normal(text: str) -> str:
        if not text.isascii():
            text = unicodedata.normalize("NFC", text).replace("Σ", "σ")  # the library lower-cases letter by letter
        return text.lower()

    def whole(self, text: str) -> list[int]:
        return self.tokenizer.encode(text, add_special_tokens=False).ids

    def each(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of words end to end, and how many each has. Words are encoded ``TOGETHER``, with spaces between, and told apart by where their tokens begin."""
        ids, counts = [], []
        for a in range(0, len(words), TOGETHER):
            line = b" ".join(words[a : a + TOGETHER]).decode("utf-8")
            made = self.tokenizer.encode(line, add_special_tokens=False)
            own = np.array(made.ids, dtype=np.int32)
            space = np.flatnonzero(np.frombuffer(line.encode("utf-32-le"), dtype="<u4") == 0x20)
            begin = np.array(made.offsets, dtype=np.int64).reshape(-1, 2)[:, 0]
            ids.append(own)
            counts.append(np.bincount(np.searchsorted(space, begin), minlength=len(space) + 1))
        return np.concatenate(ids), np.concatenate(counts)

    def encode_block(self, texts: list[str | None]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """For each run of texts: the ids end to end, and where each text begins (and the end)."""
        if len(self.arena.row) > MEMO:
            self.arena = Arena()
        odd = {i: self.whole(t) for i, t in enumerate(texts) if t and self.added(t)}
        texts = ["" if t is None or i in odd else self.normal(t) for i, t in enumerate(texts)]
        parts = [(a, b, Words(texts[a:b], bare=True, classes=self.classes)) for a, b in slices(texts, RUN)]
        known = self.arena.row
        new = list({w: None for _, _, p in parts for w in p.words if w not in known})
        if new:
            self.arena.add(new, *self.each(new))
        for a, b, part in parts:
            ids, at = self.arena.expand(part)
            if any(a <= i < b for i in odd):
                pieces = [odd.get(a + k, ids[x:y]) for k, (x, y) in enumerate(zip(at.tolist(), at[1:].tolist()))]
                ids = np.concatenate([np.asarray(x, dtype=np.int64) for x in pieces])
                at = np.concatenate([[0], np.cumsum([len(x) for x in pieces])])
            yield ids, at


@functools.cache
def loaded(path: str) -> WordBpe:
    """The tokenizer of a file, read once in each worker."""
    return WordBpe(path)


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def write_shards(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", end_id: int = 2, path: str | None = None, folder: str | None = None) -> str:
    """Encodes the texts, appends ``end_id`` to each, and writes shards in ascending key order; returns the folder.

    One range shuffle of the texts; each partition streams its rows in order and
    holds one shard at a time.
    """
    spark = docs.sparkSession
    path = path or default_vocabulary()
    folder = folder or f"{shared_folder(spark)}/framelake-tokens-{uuid.uuid4().hex}"

    def shards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, bpe = TaskContext.get().partitionId(), loaded(path)
        bits = bits_for(max(bpe.size, end_id + 1))
        seq = before = held = 0
        keys: list[int | None] = []
        sizes: list[np.ndarray] = []
        runs: list[np.ndarray] = []

        def flush() -> pa.RecordBatch:
            nonlocal seq, before, held, keys, sizes, runs
            ends = np.cumsum(np.concatenate(sizes))
            blob = make_shard(keys, ends, np.concatenate(runs), bits)
            row = pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([seq], pa.int32()), pa.array([before], pa.int64()), pa.array([len(keys)], pa.int64()), pa.array([held], pa.int64()), pa.array([blob], pa.binary())], names=["part", "seq", "before", "n_docs", "n_ids", "shard"])
            seq, before, held, keys, sizes, runs = seq + 1, before + held, 0, [], [], []
            return row

        for batch in batches:
            ids_of, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            done = 0
            for a, b in slices([t or "" for t in texts], BLOCK):
                for ids, at in bpe.encode_block(texts[a:b]):
                    n = len(at) - 1
                    ended = np.insert(ids, at[1:], end_id)
                    ends = at[1:] + np.arange(1, n + 1)
                    for x, y in whole_documents(ends, SHARD_IDS - held):
                        begin = int(ends[x - 1]) if x else 0
                        keys += ids_of[done + x : done + y]
                        sizes.append(np.diff(ends[x:y], prepend=begin))
                        runs.append(ended[begin : int(ends[y - 1])])
                        held += int(ends[y - 1]) - begin
                        if held >= SHARD_IDS:
                            yield flush()
                    done += n
        if keys:
            yield flush()

    rows = docs.select(F.col(id_col).cast("long").alias("key"), F.col(text_col).alias("text"))
    ordered = rows.repartitionByRange(partitions_for(spark), "key", F.xxhash64("text")).sortWithinPartitions("key", F.xxhash64("text"), "text")
    ordered.mapInArrow(frugal(shards), SHARD_SCHEMA).write.parquet(folder)
    return folder


def whole_documents(ends: np.ndarray, room: int) -> Iterator[tuple[int, int]]:
    """Ranges of documents that fill the room left in a shard, then whole shards."""
    x, n, base = 0, len(ends), 0
    while x < n:
        y = min(n, int(np.searchsorted(ends, base + max(1, room))) + 1)
        yield x, y
        base, x, room = int(ends[y - 1]), y, SHARD_IDS


def read_shards(spark, folder: str, id_name: str = "doc_id") -> DataFrame:
    """One row per document of the shards: key, start, n_tokens, ids_crc32; ids are unpacked block-wise.

    ``start`` needs the ids of all earlier partitions: one sum per partition
    goes to the driver, as many numbers as the writer had partitions.
    """
    table = spark.read.schema(SHARD_SCHEMA).parquet(folder)
    totals = table.groupBy("part").agg(F.sum("n_ids").alias("n")).collect()
    base, at = {}, 0
    for row in sorted(totals):
        base[row["part"]] = at
        at += row["n"]

    def documents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, before, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
                shard = Shard(data.as_buffer())
                ids = shard.ids(0, shard.n_ids).astype("<u4")
                begin = np.concatenate([[0], shard.ends[:-1]])
                view = memoryview(ids).cast("B")
                sums = [zlib.crc32(view[4 * a : 4 * b]) for a, b in zip(begin.tolist(), shard.ends.tolist(), strict=True)]
                keys = pa.array(shard.keys, pa.int64(), mask=shard.null)
                yield pa.RecordBatch.from_arrays([keys, pa.array(begin + (base[part] + before), pa.int64()), pa.array(shard.ends - begin, pa.int64()), pa.array(sums, pa.int64())], names=[id_name, "start", "n_tokens", "ids_crc32"])

    return table.select("part", "before", "shard").mapInArrow(frugal(documents), f"{id_name} long, start long, n_tokens long, ids_crc32 long")


def export(spark, folder: str, to: str) -> list[str]:
    """Writes each shard into a plain file ``part-seq.tok`` of a local folder, one at a time."""
    os.makedirs(to, exist_ok=True)
    out = []
    for row in spark.read.schema(SHARD_SCHEMA).parquet(folder).orderBy("part", "seq").toLocalIterator():
        out.append(f"{to}/{row['part']:06d}-{row['seq']:06d}.tok")
        with open(out[-1], "wb") as f:
            f.write(row["shard"])
    return out
