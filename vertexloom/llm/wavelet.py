"""Token ids in wavelet matrices: one file for each shard of documents.

A file holds a header, the shard's alphabet (its distinct ids in order), the bit-planes of the places
of its ids in the alphabet from the highest bit down, and a table of documents. Each plane is cut into blocks; a block is kept as packed bits under zstd, with the number
of ones before it in a directory. Access, rank and select read only the blocks they touch.

Layout (little-endian): MAGIC; u64 tokens, u32 planes, u32 documents, u32 bits in a block, u32 distinct
ids; for each plane u64 zeros; for each plane and block u64 ones before it, u64 byte offset, u32 bytes, u32 unused;
i64 doc_id, u8 doc_id is present, padded to 8, u64 end (exclusive) of each document; u32 distinct ids, padded to 8; the blocks.

Nulls: a null text is empty (it still gets the end id); a null doc_id sorts first and is kept null.
Repeated rows and ids are documents of their own, in the order of (doc_id, hash of the text). Empty tables give no
file and no row. Further columns are left aside.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import file_system, fresh, stored, text_or_empty, tidied, tokenizer_path
from .tokens import encoder

MAGIC = b"VLWM0002"
HEAD = struct.Struct("<QIIII")
BLOCK = np.dtype([("ones", "<u8"), ("at", "<u8"), ("bytes", "<u4"), ("unused", "<u4")])
DOC = np.dtype([("doc_id", "<i8"), ("present", "u1"), ("pad", "u1", 7), ("end", "<u8")])
BLOCK_BITS = 1 << 18
SHARD_TOKENS = 1 << 22
READERS = 100_000


def pack(ids: np.ndarray, doc_ids: list[int | None], ends: np.ndarray, block_bits: int = BLOCK_BITS) -> bytes:
    """The bytes of a shard's file. ends: where each document ends in ids."""
    seen = np.bincount(ids) if len(ids) and ids.max() < 1 << 20 else None
    alphabet = (np.flatnonzero(seen) if seen is not None else np.unique(ids)).astype("<u4")
    planes = max(1, (len(alphabet) - 1).bit_length()) if len(ids) else 1
    blocks = -(-len(ids) // block_bits)
    zeros, entries, bodies = np.zeros(planes, "<u8"), np.zeros((planes, blocks), BLOCK), []
    docs = np.zeros(len(doc_ids), DOC)
    docs["doc_id"] = [x or 0 for x in doc_ids]
    docs["present"] = [x is not None for x in doc_ids]
    docs["end"] = ends
    at = len(MAGIC) + HEAD.size + zeros.nbytes + entries.nbytes + docs.nbytes + -(-alphabet.nbytes // 8) * 8
    z = zstandard.ZstdCompressor(level=1)
    place = np.uint16 if planes <= 16 else np.uint32
    if seen is not None:
        codes = np.zeros(len(seen), place)
        codes[alphabet] = np.arange(len(alphabet))
        now = codes.take(ids)
    else:
        now = np.searchsorted(alphabet, ids).astype(place)
    for level in range(planes):
        bits = ((now >> (planes - 1 - level)) & 1).astype(bool)
        packed, ones = np.packbits(bits), 0
        for b in range(blocks):
            body = z.compress(packed[b * block_bits // 8 : (b + 1) * block_bits // 8].tobytes())
            entries[level, b] = (ones, at, len(body), 0)
            ones += int(np.count_nonzero(bits[b * block_bits : (b + 1) * block_bits]))
            at += len(body)
            bodies.append(body)
        zeros[level] = len(bits) - ones
        if level + 1 < planes:
            now = np.concatenate([np.compress(~bits, now), np.compress(bits, now)])
    return b"".join([MAGIC, HEAD.pack(len(ids), planes, len(docs), block_bits, len(alphabet)), zeros.tobytes(), entries.tobytes(), docs.tobytes(), alphabet.tobytes().ljust(-(-alphabet.nbytes // 8) * 8, b"\0"), *bodies])


class WaveletFile:
    """Random access to a shard's file through `read_at(offset, size)`."""

    def __init__(self, read_at):
        self.read_at = read_at
        head = read_at(0, len(MAGIC) + HEAD.size)
        if head[: len(MAGIC)] != MAGIC:
            raise ValueError("not a wavelet file")
        self.n, self.planes, docs, self.block_bits, distinct = HEAD.unpack(head[len(MAGIC) :])
        blocks = -(-self.n // self.block_bits)
        at = len(head)
        self.zeros = np.frombuffer(read_at(at, 8 * self.planes), "<u8").astype(np.int64)
        at += 8 * self.planes
        self.entries = np.frombuffer(read_at(at, BLOCK.itemsize * self.planes * blocks), BLOCK).reshape(self.planes, blocks)
        at += self.entries.nbytes
        self.docs = np.frombuffer(read_at(at, DOC.itemsize * docs), DOC)
        self.alphabet = np.frombuffer(read_at(at + self.docs.nbytes, 4 * distinct), "<u4")
        self._kept: dict[tuple[int, int], tuple[np.ndarray, np.ndarray]] = {}

    @classmethod
    def of_bytes(cls, data: bytes) -> WaveletFile:
        return cls(lambda at, size: data[at : at + size])

    def packed(self, level: int, b: int) -> np.ndarray:
        e = self.entries[level, b]
        data = self.read_at(int(e["at"]), int(e["bytes"]))
        return np.frombuffer(zstandard.decompress(data), np.uint8)

    def block(self, level: int, b: int) -> tuple[np.ndarray, np.ndarray]:
        """Packed bits of a block and the ones before each byte of it."""
        if (level, b) not in self._kept:
            if len(self._kept) >= 64:
                self._kept.pop(next(iter(self._kept)))
            bits = self.packed(level, b)
            before = np.concatenate([[0], np.cumsum(np.bitwise_count(bits), dtype=np.int64)])
            self._kept[level, b] = bits, before
        return self._kept[level, b]

    def bit(self, level: int, i: int) -> int:
        bits, _ = self.block(level, i // self.block_bits)
        at = i % self.block_bits
        return int(bits[at >> 3]) >> (7 - (at & 7)) & 1

    def ones(self, level: int, i: int) -> int:
        """Ones among the first i bits of a plane."""
        if i >= self.n:
            return self.n - int(self.zeros[level])
        b, at = divmod(i, self.block_bits)
        bits, before = self.block(level, b)
        part = int(bits[at >> 3]) >> (8 - (at & 7)) if at & 7 else 0
        return int(self.entries[level, b]["ones"]) + int(before[at >> 3]) + part.bit_count()

    def access(self, i: int) -> int:
        """The token at position i."""
        if not 0 <= i < self.n:
            raise IndexError(i)
        value = 0
        for level in range(self.planes):
            bit = self.bit(level, i)
            value = value << 1 | bit
            i = int(self.zeros[level]) + self.ones(level, i) if bit else i - self.ones(level, i)
        return int(self.alphabet[value])

    def code(self, token: int) -> int:
        """Place of a token in the alphabet, -1 if it does not occur."""
        at = int(np.searchsorted(self.alphabet, token)) if 0 <= token < 1 << 32 else len(self.alphabet)
        return at if at < len(self.alphabet) and self.alphabet[at] == token else -1

    def rank(self, token: int, i: int) -> int:
        """How often the token occurs among the first i."""
        if (token := self.code(token)) < 0:
            return 0
        lo, hi = 0, min(max(i, 0), self.n)
        for level in range(self.planes):
            a, b, z = self.ones(level, lo), self.ones(level, hi), int(self.zeros[level])
            lo, hi = (z + a, z + b) if token >> (self.planes - 1 - level) & 1 else (lo - a, hi - b)
        return hi - lo

    def count(self, token: int) -> int:
        return self.rank(token, self.n)

    def select(self, token: int, k: int) -> int:
        """Position of the k-th occurrence (from 0) of the token, -1 if there are not so many."""
        if k < 0 or k >= self.count(token):
            return -1
        token, start = self.code(token), 0
        for level in range(self.planes):
            a = self.ones(level, start)
            start = int(self.zeros[level]) + a if token >> (self.planes - 1 - level) & 1 else start - a
        at = start + k
        for level in reversed(range(self.planes)):
            one = token >> (self.planes - 1 - level) & 1
            at = self.find(level, at - int(self.zeros[level]) if one else at, one)
        return at

    def find(self, level: int, k: int, one: int) -> int:
        """Position of the k-th one or zero of a plane."""
        return int(self.find_all(level, np.array([k]), one)[0])

    def find_all(self, level: int, ks: np.ndarray, one: int) -> np.ndarray:
        """Positions of the ones or zeros of a plane with these numbers (ascending); each block is unpacked once."""
        ones = self.entries[level]["ones"].astype(np.int64)
        before = ones if one else np.arange(len(ones)) * self.block_bits - ones
        blocks = np.searchsorted(before, ks, side="right") - 1
        out = np.empty(len(ks), np.int64)
        for b in np.unique(blocks).tolist():
            here = blocks == b
            size = min(self.block_bits, self.n - b * self.block_bits)
            bits = np.unpackbits(self.block(level, b)[0], count=size)
            out[here] = b * self.block_bits + np.flatnonzero(bits == one)[ks[here] - before[b]]
        return out

    def locate(self, token: int) -> list[int]:
        """All positions of the token: the range of its occurrences is carried up plane by plane."""
        many = self.count(token)
        if not many:
            return []
        code, start = self.code(token), 0
        for level in range(self.planes):
            a = self.ones(level, start)
            start = int(self.zeros[level]) + a if code >> (self.planes - 1 - level) & 1 else start - a
        at = np.arange(start, start + many)
        for level in reversed(range(self.planes)):
            one = code >> (self.planes - 1 - level) & 1
            at = self.find_all(level, at - int(self.zeros[level]) if one else at, one)
        return at.tolist()

    def decode(self) -> np.ndarray:
        """All tokens, from the lowest plane up."""
        values = np.zeros(self.n, np.uint16 if self.planes <= 16 else np.uint32)
        for level in reversed(range(self.planes)):
            packed = [self.packed(level, b) for b in range(self.entries.shape[1])]
            bits = np.unpackbits(np.concatenate(packed), count=self.n).view(bool) if packed else np.zeros(0, bool)
            z = int(self.zeros[level])
            values[z:] |= 1 << (self.planes - 1 - level)
            up = np.empty_like(values)
            up[np.flatnonzero(~bits)] = values[:z]
            up[np.flatnonzero(bits)] = values[z:]
            values = up
        return self.alphabet.take(values)


SHARDS = "file string, part long, number long, documents long, tokens long"


def write_shards(docs: DataFrame, end_id: int = 2, path: str | None = None, shard_tokens: int = SHARD_TOKENS) -> DataFrame:
    """Encodes and writes all documents in ascending doc_id; returns SHARDS and `begin`, the tokens of all files before, for every file. part and number give the order."""
    path = path or tokenizer_path("word_bpe_49k.json")
    spark = docs.sparkSession
    root = fresh(spark, "wavelet")
    fs, top = file_system(root)
    fs.create_dir(top, recursive=True)
    end = np.array([end_id], "<u4").tobytes()

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, files, folder = encoder(path), *file_system(root)
        ctx = TaskContext.get()
        ids: list[bytes] = []
        doc_ids: list[int | None] = []
        lengths: list[int] = []
        number = held = 0

        def close() -> pa.RecordBatch:
            nonlocal number, held
            name = f"{ctx.partitionId()}-{number}.wm"
            data = pack(np.frombuffer(b"".join(ids), "<u4"), doc_ids, np.cumsum(lengths))
            with files.open_output_stream(f"{folder}/{name}.{ctx.taskAttemptId()}", compression=None) as out:
                out.write(data)
            files.move(f"{folder}/{name}.{ctx.taskAttemptId()}", f"{folder}/{name}")  # whole or absent, also when a task runs twice
            row = (f"{root}/{name}", ctx.partitionId(), number, len(doc_ids), sum(lengths))
            number, held = number + 1, 0
            for x in (ids, doc_ids, lengths):
                x.clear()
            return pa.record_batch([pa.array([x]) for x in row], names=["file", "part", "number", "documents", "tokens"])

        for b in batches:
            for at in range(0, b.num_rows, 256):
                part = b.slice(at, 256)
                for d, x in zip(part.column(0).to_pylist(), enc.encode(part.column(1).to_pylist()), strict=True):
                    ids.append(x + end)
                    doc_ids.append(d)
                    lengths.append(len(x) // 4 + 1)
                    held += lengths[-1]
                    if held >= shard_tokens:
                        yield close()
        if doc_ids:
            yield close()

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text")).withColumn("tie", F.xxhash64("text"))
    ordered = rows.repartitionByRange("doc_id", "tie").sortWithinPartitions("doc_id", "tie").select("doc_id", "text")
    made = stored(ordered.mapInArrow(tidied(write), SHARDS), "shards")
    # tokens of earlier parts: a row for each part; and of earlier files of the part
    parts = made.groupBy("part").agg(F.sum("tokens").alias("n"))
    before = F.coalesce(F.sum("n").over(W.orderBy("part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    own = F.coalesce(F.sum("tokens").over(W.partitionBy("part").orderBy("number").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    return made.withColumn("own", own).join(parts.select("part", before.alias("before")), "part").select(*[x.split()[0] for x in SHARDS.split(", ")], (F.col("before") + F.col("own")).alias("begin"))


def open_file(name: str) -> WaveletFile:
    fs, path = file_system(name)
    handle = fs.open_input_file(path)
    return WaveletFile(lambda at, size: handle.read_at(size, at))


def read_shards(spark: SparkSession, shards: DataFrame, tokens: bool = True) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 and (if asked) tokens of each document, from the files (file, begin)."""
    schema = "doc_id long, start long, n_tokens long, ids_crc32 long" + ", tokens array<int>" * tokens

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for name, first in zip(*(b.column(i).to_pylist() for i in (0, 1)), strict=True):
                w = open_file(name)
                ids = w.decode()
                ends = w.docs["end"].astype(np.int64)
                starts = np.concatenate([[0], ends[:-1]])
                crc = [zlib.crc32(ids[a:z]) for a, z in zip(starts.tolist(), ends.tolist(), strict=True)]
                cols = [pa.array(w.docs["doc_id"], pa.int64(), mask=w.docs["present"] == 0), pa.array(starts + first), pa.array(ends - starts), pa.array(crc, pa.int64())]
                names = ["doc_id", "start", "n_tokens", "ids_crc32"]
                if tokens:
                    cols.append(pa.ListArray.from_arrays(pa.array(np.append(starts, ends[-1:]), pa.int32()), pa.array(ids.astype(np.int32))))
                    names.append("tokens")
                yield pa.record_batch(cols, names=names)

    files = shards.select("file", "begin").repartition(max(1, min(READERS, shards.count())), "file")
    return files.mapInArrow(tidied(read), schema)
