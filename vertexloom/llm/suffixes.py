"""Repeated byte windows across documents, by a depth-limited radix sort of suffixes.

A window is a string of `length` bytes; it is repeated in a document if it also starts in a document
with a smaller doc_id. Suffixes are ordered only through `length` bytes, by passes over digits of 8
bytes from the most significant on; after each pass only groups of equals go on, and the groups left at
the end are exactly the repeated windows.

Ordering every suffix would move each byte of the corpus `length` times, so suffixes are first narrowed
down, exactly: each window has one anchor, the least of the hashes of its k-byte strings, which depends
on the window's bytes alone. Equal windows have equal anchors. A first round finds the anchors' hashes
that occur in two documents or more (hashes travel sorted, as compressed differences, and the answer is
a bit for each). Only the stretches of text around such anchors are then sent to the partition of their
anchor, once for each chunk of documents and different stretch, where their suffixes are sorted. The
answer is a bit for each window. Hashes only narrow down: equality is decided on bytes.

Documents travel in chunks of about `chunk` bytes, compressed; chunks are the unit of both rounds, so a
stretch shared by many documents is sent once a chunk, whatever its number of copies.

Nulls: a null text is empty; a null doc_id counts as smaller than all others. Rows with the same doc_id
are one document's parts as far as repeats go: they are never repeats of each other; each gets its row.
Texts shorter than a window are kept whole. Empty tables give an empty result. Further columns are left
aside.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import stored, text_or_empty, tidied

LENGTH = 50
CHUNK = 1 << 20
BLOCK = 1 << 19
MOST_DOCS = 1 << 15
NULL_ID = -(1 << 63)
HASH_BITS = 48
BUCKET_BYTES = 16 << 20

CHUNKS = "chunk long, docs binary, text binary, rest binary"
PARTS = "bucket int, chunk long, n int, body binary"
ANSWERS = "chunk long, bucket int, body binary"


def squeeze(data: bytes) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(data)


def unsqueeze(data: bytes) -> bytes:
    return zstandard.ZstdDecompressor().decompress(data)


def planes(values: np.ndarray) -> bytes:
    """Integers by planes of bytes, compressed."""
    values = np.ascontiguousarray(values)
    return squeeze(values.view(np.uint8).reshape(-1, values.itemsize).T.tobytes())


def unplanes(data: bytes, kind, n: int) -> np.ndarray:
    size = np.dtype(kind).itemsize
    return np.ascontiguousarray(np.frombuffer(unsqueeze(data), np.uint8).reshape(size, n).T).view(kind).reshape(n)


def mix32(x: np.ndarray) -> np.ndarray:
    x ^= x >> np.uint32(15)
    x *= np.uint32(0x2C1B3C6D)
    x ^= x >> np.uint32(13)
    return x


def mix64(x: np.ndarray) -> np.ndarray:
    x ^= x >> np.uint64(31)
    x *= np.uint64(0x7FB5D329728EA185)
    x ^= x >> np.uint64(29)
    x *= np.uint64(0x81DADEF4BC2DD44D)
    return x ^ (x >> np.uint64(32))


_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd base and of its inverse, modulo 2**32."""
    if n not in _powers:
        _powers.clear()
        base = 0x01000193
        _powers[n] = tuple(np.cumprod(np.full(n, b, np.uint32), dtype=np.uint32) for b in (base, pow(base, -1, 1 << 32)))
    return _powers[n]


def running_min(x: np.ndarray, width: int) -> np.ndarray:
    """Least of each `width` neighbours from a position on."""
    n, have = len(x) - width + 1, 1
    while have * 2 <= width:
        x = np.minimum(x[:-have], x[have:])
        have *= 2
    return np.minimum(x[:n], x[width - have : width - have + n]) if have < width else x[:n]


def stretches(data: np.ndarray, ends: np.ndarray, length: int, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(anchor, first window, last window, document) of all stretches of windows with one anchor.

    data: the bytes of all documents of a chunk; ends: where each ends. Works block by block.
    """
    width = length - k + 1
    out = []
    n = len(data) - length + 1
    for lo in range(0, max(0, n), BLOCK):
        hi = min(n, lo + BLOCK)
        part = data[lo : hi + length - 1]
        up, down = powers(BLOCK + length)
        sums = np.zeros(len(part) + 1, np.uint32)
        np.cumsum(part * up[: len(part)], dtype=np.uint32, out=sums[1:])
        grams = (sums[k:] - sums[:-k]) * down[: len(part) - k + 1]
        key = mix32(grams).astype(np.uint64) << np.uint64(32)
        key |= np.arange(len(key), dtype=np.uint64)
        anchor = (running_min(key, width) & np.uint64(0xFFFFFFFF)).astype(np.int64)
        # windows that lie in one document, cut where the anchor or the document changes
        first = int(np.searchsorted(ends, lo, side="right"))
        starts, stops = [], []
        for d in range(first, len(ends)):
            a, z = max(lo, int(ends[d - 1]) if d else 0), min(hi, int(ends[d]) - length + 1)
            if a >= hi:
                break
            if z > a:
                starts.append((a, d))
                stops.append(z)
        if not starts:
            continue
        begin, doc = np.array(starts, np.int64).T
        stop = np.array(stops, np.int64)
        valid = np.zeros(hi - lo + 1, np.int8)
        valid[begin - lo] += 1
        np.subtract.at(valid, stop - lo, 1)
        inside = np.cumsum(valid[:-1], dtype=np.int8).astype(bool)
        new = inside.copy()
        new[1:] &= (anchor[1:] != anchor[:-1]) | ~inside[:-1]
        new[begin - lo] = True
        a = np.flatnonzero(new)
        which = np.searchsorted(begin - lo, a, side="right") - 1
        z = np.minimum(np.append(a[1:], hi - lo), stop[which] - lo) - 1
        out.append((anchor[a] + lo, a + lo, z + lo, doc[which]))
    if not out:
        return tuple(np.zeros(0, np.int64) for _ in range(4))
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def words_at(data: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The 8 bytes from each position on, as big-endian numbers; data is padded by 8 bytes at least."""
    view = np.lib.stride_tricks.as_strided(data, (len(data) - 7, 8), (1, 1))
    return np.ascontiguousarray(view[at]).view(">u8").reshape(-1).astype(np.uint64)


def anchor_hashes(padded: np.ndarray, anchor: np.ndarray, k: int) -> np.ndarray:
    x = np.zeros(len(anchor), np.uint64)
    for i, at in enumerate([*range(0, k - 7, 8), k - 8]):
        x = mix64((x + np.uint64(i + 1)) * np.uint64(0x9E3779B97F4A7C15) + words_at(padded, anchor + at))
    return x >> np.uint64(64 - HASH_BITS)


def anchor_bytes(length: int) -> int:
    """Bytes of the strings among which a window of `length` bytes has its anchor."""
    return max(8, length // 2 + 1)


class Chunk:
    """Documents of a chunk, and its stretches."""

    def __init__(self, docs: bytes, text: bytes, length: int):
        table = np.frombuffer(docs, np.int64).reshape(-1, 3)  # doc_id, is not null, bytes
        self.doc_id, self.present, self.sizes = table.T
        self.key = np.where(self.present == 1, self.doc_id, NULL_ID)
        self.ends = np.cumsum(self.sizes)
        self.padded = np.frombuffer(unsqueeze(text) + bytes(length + 32), np.uint8)
        self.data = self.padded[: int(self.ends[-1])]
        self.length, self.k = length, anchor_bytes(length)
        self.anchor, self.first, self.last, self.doc = stretches(self.data, self.ends, length, self.k)
        self.hash = anchor_hashes(self.padded, self.anchor, self.k)

    def seen(self) -> tuple[np.ndarray, np.ndarray]:
        """The distinct hashes in order, and whether each occurs in several documents of the chunk."""
        order = np.argsort(self.hash, kind="stable")
        h, d = self.hash[order], self.key[self.doc[order]]
        heads = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]])) if len(h) else np.zeros(0, np.int64)
        if not len(heads):
            return h, np.zeros(0, bool)
        return h[heads], np.minimum.reduceat(d, heads) != np.maximum.reduceat(d, heads)

    def repeated(self, answers: dict[int, bytes], buckets: int) -> np.ndarray:
        """The stretches whose anchor's hash occurs in several documents of the corpus."""
        h, _ = self.seen()
        edges = bucket_edges(h, buckets)
        flag = np.zeros(len(h), bool)
        for b, body in answers.items():
            lo, hi = edges[b], edges[b + 1]
            flag[lo:hi] = np.unpackbits(np.frombuffer(body, np.uint8), count=hi - lo)
        hot = h[flag]
        if not len(hot):
            return np.zeros(0, np.int64)
        at = np.minimum(np.searchsorted(hot, self.hash), len(hot) - 1)
        return np.flatnonzero(hot[at] == self.hash)

    def items(self, here: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(item of each stretch of `here`, a stretch for each item, least doc of each item); items are the distinct stretches by hash, then bytes."""
        words = self.content(here)
        digest = np.zeros(len(here), np.uint64)
        for i in range(words.shape[1]):
            digest = mix64((digest + np.uint64(i + 1)) * np.uint64(0x9E3779B97F4A7C15) + words[:, i])
        order = np.lexsort((self.key[self.doc[here]], digest, self.hash[here]))
        w, h = words[order], self.hash[here][order]
        new = np.ones(len(order), bool)
        new[1:] = (h[1:] != h[:-1]) | (w[1:] != w[:-1]).any(axis=1)  # bytes decide
        item = np.empty(len(order), np.int64)
        item[order] = np.cumsum(new) - 1
        heads = order[new]
        return item, heads, self.key[self.doc[here[heads]]]

    def content(self, here: np.ndarray) -> np.ndarray:
        """Bytes of the stretches from the first window on, padded with zeros, as words; the last word holds the number of windows."""
        a, many = self.first[here], self.last[here] - self.first[here] + 1
        size = many + self.length - 1
        most = 2 * self.length - self.k
        cols = -(-most // 8)
        words = np.zeros((len(here), cols + 1), np.uint64)
        for i in range(cols):
            left = np.clip(size - 8 * i, 0, 8)
            got = np.flatnonzero(left)
            w = words_at(self.padded, np.minimum(a[got] + 8 * i, len(self.padded) - 8))
            words[got, i] = w & ~((np.uint64(1) << ((8 - left[got]) * 8).astype(np.uint64)) - np.uint64(1))
        words[:, cols] = many
        return words


def bucket_edges(sorted_hashes: np.ndarray, buckets: int) -> np.ndarray:
    """Where each bucket's range of hashes begins, and the end."""
    bounds = np.array([(b << HASH_BITS) // buckets for b in range(buckets)], np.uint64)
    return np.append(np.searchsorted(sorted_hashes, bounds), len(sorted_hashes))


def radix_groups(words: np.ndarray, many: np.ndarray, least: np.ndarray, length: int) -> np.ndarray:
    """For each window of each stretch (in order): the least document among the equal windows.

    words: bytes of the stretches as big-endian words; many: windows of each; least: document of each.
    """
    raw = np.ascontiguousarray(words.astype(">u8")).view(np.uint8)
    raw = np.pad(raw, ((0, 0), (0, 8))).reshape(-1)
    row = np.repeat(np.arange(len(many)), many)
    offset = np.arange(len(row)) - np.repeat(np.cumsum(many) - many, many)
    at = row * (words.shape[1] * 8 + 8) + offset
    best = least[row]
    live, group = np.arange(len(row)), np.zeros(len(row), np.int64)
    for depth in range(0, length, 8):
        digit = words_at(raw, at[live] + depth)
        if length - depth < 8:
            digit >>= np.uint64(8 * (8 - (length - depth)))
        order = np.lexsort((digit, group)) if depth else np.argsort(digit, kind="stable")
        g, d = group[order], digit[order]
        new = np.ones(len(order), bool)
        new[1:] = (d[1:] != d[:-1]) | (g[1:] != g[:-1])
        heads = np.flatnonzero(new)
        size = np.diff(np.append(heads, len(order)))
        number = np.cumsum(new) - 1
        keep = size[number] > 1  # a suffix unlike all others is done
        live, group = live[order[keep]], number[keep]
        if not len(live):
            return best
    heads = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]]))
    low = np.minimum.reduceat(best[live], heads)
    best[live] = np.repeat(low, np.diff(np.append(heads, len(group))))
    return best


def make_chunks(docs: DataFrame, size: int = CHUNK, carry: tuple[str, ...] = ()) -> DataFrame:
    """CHUNKS of the documents, written to the shared folder. rest: the columns to carry, as an Arrow stream."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, ids, parts, rest, held = TaskContext.get().partitionId() << 32, [], [], [], 0

        def close() -> pa.RecordBatch:
            nonlocal number, held
            head = np.array([(d or 0, d is not None, len(x)) for d, x in zip(ids, parts, strict=True)], np.int64)
            sink = pa.BufferOutputStream()
            if carry:
                with pa.ipc.new_stream(sink, rest[0].schema) as out:
                    for x in rest:
                        out.write_batch(x)
            row = (number, head.tobytes(), squeeze(b"".join(parts)), squeeze(sink.getvalue().to_pybytes()) if carry else b"")
            number, held = number + 1, 0
            for x in (ids, parts, rest):
                x.clear()
            return pa.record_batch([pa.array([x]) for x in row], names=["chunk", "docs", "text", "rest"])

        for b in batches:
            others, begin = b.select(b.schema.names[2:]), 0
            for i, (d, x) in enumerate(zip(b.column(0).to_pylist(), b.column(1), strict=True)):
                data = x.as_buffer().to_pybytes()
                if parts and (held + len(data) > size or len(parts) >= MOST_DOCS):
                    rest.append(others.slice(begin, i - begin))
                    begin = i
                    yield close()
                ids.append(d)
                parts.append(data)
                held += len(data)
            rest.append(others.slice(begin))
        if parts:
            yield close()

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text"), *(F.col(f"`{c}`").alias(f"__vl_{i}") for i, c in enumerate(carry)))
    return stored(rows.mapInArrow(tidied(run), CHUNKS), "chunks", "uncompressed")


def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, list[dict]]]:
    """Rows by bucket; a partition holds whole buckets."""
    found: dict[int, list[dict]] = {}
    for b in batches:
        for r in b.to_pylist():
            found.setdefault(r["bucket"], []).append(r)
    yield from found.items()


def find_repeats(docs: DataFrame, length: int = LENGTH, chunk: int = CHUNK, carry: tuple[str, ...] = ()) -> DataFrame:
    """A chunk with the answers of both rounds a row: CHUNKS, seen, windows, buckets."""
    if length < 16:
        raise ValueError("windows of 16 bytes at least")
    chunks = make_chunks(docs, chunk, carry)
    spark = docs.sparkSession
    packed = chunks.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets = int(max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-3 * packed // BUCKET_BYTES)))

    def anchors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for r in rows_of(batches):
            h, several = Chunk(r["docs"], r["text"], length).seen()
            edges = bucket_edges(h, buckets)
            value = h << np.uint64(1) | several
            step = value.copy()
            step[1:] -= value[:-1]
            heads = edges[:-1][edges[:-1] < edges[1:]]
            step[heads] = value[heads]
            out = [(b, r["chunk"], int(edges[b + 1] - edges[b]), planes(step[edges[b] : edges[b + 1]])) for b in range(buckets) if edges[b] < edges[b + 1]]
            if out:
                yield part_batch(out)

    def several(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for bucket, rows in gather(batches):
            values = [np.cumsum(unplanes(r["body"], np.uint64, r["n"])) for r in rows]
            whole = np.concatenate(values)
            order = np.sort(whole)
            h = order >> np.uint64(1)
            again = np.flatnonzero(h[1:] == h[:-1])
            hot = np.unique(np.concatenate([h[again], h[np.flatnonzero(order & np.uint64(1))]]))
            out = []
            for r, v in zip(rows, values, strict=True):
                v = v >> np.uint64(1)
                bits = hot[np.minimum(np.searchsorted(hot, v), len(hot) - 1)] == v if len(hot) else np.zeros(len(v), bool)
                if bits.any():
                    out.append((r["chunk"], bucket, np.packbits(bits).tobytes()))
            if out:
                yield answer_batch(out)

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for r in rows_of(batches):
            c = Chunk(r["docs"], r["text"], length)
            here = c.repeated(answers_of(r["seen"]), buckets)
            if not len(here):
                continue
            _, heads, least = c.items(here)
            own = here[heads]
            words = c.content(own)
            edges = bucket_edges(c.hash[own], buckets)
            out = []
            for b in range(buckets):
                lo, hi = int(edges[b]), int(edges[b + 1])
                if lo < hi:
                    out.append((b, r["chunk"], hi - lo, squeeze(least[lo:hi].tobytes() + words[lo:hi].astype(">u8").tobytes())))
            yield part_batch(out)

    def sort(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for bucket, rows in gather(batches):
            bodies = [unsqueeze(r["body"]) for r in rows]
            ns = [r["n"] for r in rows]
            least = np.concatenate([np.frombuffer(x[: 8 * n], np.int64) for x, n in zip(bodies, ns, strict=True)])
            words = np.concatenate([np.frombuffer(x[8 * n :], ">u8").reshape(n, -1) for x, n in zip(bodies, ns, strict=True)]).astype(np.uint64)
            del bodies
            masks = window_masks(words, least, length)  # a row of words for each item
            edges = np.cumsum([0, *ns])
            yield answer_batch([(r["chunk"], bucket, squeeze(masks[a:z].tobytes())) for r, a, z in zip(rows, edges, edges[1:])])

    def answers(found: DataFrame, name: str) -> DataFrame:
        return found.groupBy("chunk").agg(F.collect_list(F.struct("bucket", "body")).alias(name))  # a chunk's own bits

    seen = answers(chunks.mapInArrow(tidied(anchors), PARTS).repartitionById(buckets, F.col("bucket")).mapInArrow(tidied(several), ANSWERS), "seen")
    known = chunks.join(stored(seen, "seen"), "chunk", "left")
    sent = known.filter("seen is not null").mapInArrow(tidied(send), PARTS).repartitionById(buckets, F.col("bucket"))
    windows = answers(sent.mapInArrow(tidied(sort), ANSWERS), "windows")
    return known.join(stored(windows, "windows"), "chunk", "left").withColumn("buckets", F.lit(buckets))


def mask_words(length: int) -> int:
    """32-bit words that hold a bit for each window of a stretch."""
    return -(-(length - anchor_bytes(length) + 1) // 32)


def window_masks(words: np.ndarray, least: np.ndarray, length: int) -> np.ndarray:
    """For each item, a bit for each window that also starts in a smaller document, in mask_words words. Equal stretches are sorted once."""
    digest = np.zeros(len(words), np.uint64)
    for i in range(words.shape[1]):
        digest = mix64((digest + np.uint64(i + 1)) * np.uint64(0x9E3779B97F4A7C15) + words[:, i])
    order = np.lexsort((least, digest))
    w = words[order]
    new = np.ones(len(order), bool)
    new[1:] = (w[1:] != w[:-1]).any(axis=1)
    kind = np.empty(len(order), np.int64)
    kind[order] = np.cumsum(new) - 1
    heads = order[new]
    many = words[heads, -1].astype(np.int64)
    best = radix_groups(words[heads, :-1], many, least[heads], length)
    start = np.cumsum(many) - many
    # a window's bit for an item: the least document of its equals is smaller than the item's own
    masks = np.zeros((len(words), mask_words(length)), np.uint32)
    own_many, own_start = many[kind], start[kind]
    for j in range(int(many.max())):
        has = np.flatnonzero(own_many > j)
        masks[has, j // 32] |= (best[own_start[has] + j] < least[has]).astype(np.uint32) << np.uint32(j % 32)
    return masks


def rows_of(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    for b in batches:
        for i in range(b.num_rows):
            yield {n: c[0].as_py() for n, c in zip(b.schema.names, b.slice(i, 1).columns, strict=True)}


def part_batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.record_batch([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), (pa.int32(), pa.int64(), pa.int32(), pa.binary()), strict=True)], names=["bucket", "chunk", "n", "body"])


def answer_batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.record_batch([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), (pa.int64(), pa.int32(), pa.binary()), strict=True)], names=["chunk", "bucket", "body"])


def answers_of(rows: list[dict] | None) -> dict[int, bytes]:
    return {r["bucket"]: r["body"] for r in rows or []}


def removed(r: dict, length: int) -> tuple[Chunk, np.ndarray]:
    """A chunk and, for each of its bytes, whether a repeated window covers it."""
    c = Chunk(r["docs"], r["text"], length)
    cover = np.zeros(len(c.data) + 1, np.int32)
    here = c.repeated(answers_of(r["seen"]), r["buckets"])
    if len(here):
        item, heads, least = c.items(here)
        own = here[heads]
        edges = bucket_edges(c.hash[own], r["buckets"])
        masks = np.zeros((len(own), mask_words(length)), np.uint32)
        for b, body in answers_of(r["windows"]).items():
            masks[edges[b] : edges[b + 1]] = np.frombuffer(unsqueeze(body), np.uint32).reshape(-1, masks.shape[1])
        many = c.last[here] - c.first[here] + 1
        mask = masks[item]
        later = c.key[c.doc[here]] > least[item]  # the same stretch in a smaller document of the chunk
        for j in range(int(many.max())):
            hit = np.flatnonzero((many > j) & (later | ((mask[:, j // 32] >> np.uint32(j % 32)) & 1 == 1)))
            start = c.first[here[hit]] + j
            np.add.at(cover, start, 1)
            np.add.at(cover, start + length, -1)
    return c, np.cumsum(cover[:-1]) > 0


SPANS = "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary"


def remove_repeats(docs: DataFrame, length: int = LENGTH, chunk: int = CHUNK, digest: bool = False, text: bool = False, carry: tuple[str, ...] = ()) -> DataFrame:
    """SPANS of each row: bytes, removed bytes, maximal removed runs, and what is kept (with digest: its SHA-256; with text: a string without characters cut in two).

    Columns to carry come behind, under their names; two of the same name are told apart by place only.
    """
    found = find_repeats(docs, length, chunk, carry)
    names = [x.split()[0] for x in SPANS.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for r in rows_of(batches):
            c, gone = removed(r, length)
            begin = c.ends - c.sizes
            runs = np.concatenate([[False], gone])
            head = gone & ~runs[:-1]
            head[begin[c.sizes > 0]] = gone[begin[c.sizes > 0]]  # a run never crosses documents
            sums = [np.concatenate([[0], np.cumsum(x)]) for x in (gone, head)]
            n_removed, n_spans = (s[c.ends] - s[begin] for s in sums)
            kept = []
            for a, z, n in zip(begin.tolist(), c.ends.tolist(), n_removed.tolist(), strict=True):
                own = c.data[a:z]
                data = own.tobytes() if not n else own[~gone[a:z]].tobytes()
                kept.append(hashlib.sha256(data).digest() if digest else data.decode("utf-8", "ignore") if text else data)
            cols = [pa.array(c.doc_id, mask=c.present == 0), pa.array(c.sizes), pa.array(n_removed), pa.array(n_spans), pa.array(kept, pa.string() if text else pa.binary())]
            if carry:
                rest = pa.ipc.open_stream(unsqueeze(r["rest"])).read_all().combine_chunks()
                cols += [x.chunk(0) if x.num_chunks else pa.array([], x.type) for x in rest.columns]
            yield pa.record_batch(cols, names=[*names, *(f"__vl_{i}" for i in range(len(carry)))])

    schema = T.StructType.fromDDL(SPANS.replace("kept binary", "kept string") if text else SPANS)
    for i, name in enumerate(carry):
        schema = schema.add(f"__vl_{i}", docs.schema[name].dataType)
    return found.mapInArrow(tidied(run), schema).toDF(*names, *carry)
