"""SimHash near-duplicates with a Gray-order hierarchical index.

Two fingerprints of 64 bits that differ in at most d bits agree on one of d+1 blocks of bits. Every
distinct fingerprint goes to a bucket for each block; in a bucket the fingerprints are sorted by Gray
rank and an index is built over runs of them: an upper node holds the bits that all below it share, a
lower node only those that its parent does not hold, and a search adds up the differences on its way
down and drops a whole node as soon as they exceed d. A node whose members are known to be linked with
the query already is dropped as well, so a dense bucket does not make all its pairs.

A bucket above a size is dealt out again by the blocks of its remaining bits, so a hot block value is
no single task. Buckets give links to one member of each linked set; components are joined up by
star rounds. Equal fingerprints count as one node.

Nulls: a null text has no words and the fingerprint zero, linked like any other; rows with a null
doc_id get the component of the numbered rows with their fingerprint, null if there are none. Repeated
rows share a fingerprint and a component. Empty tables give an empty result. Further columns are left aside.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, stored, text_or_empty, tidied
from .components import components

SEED = 42
BITS = 64
DISTANCE = 3
FAN = 8
BUCKET = 2048
DEPTH = 3
WORK = 1 << 21

LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))


def fingerprint(text: str | None, words: int = 3) -> int:
    """64 bits: a bit is one if it is set in over half the hashes of the word shingles."""
    parts = (text or "").encode().translate(LOWER).split()
    if not parts:
        return 0
    flat = b" ".join(parts)
    lengths = np.fromiter(map(len, parts), np.int64, len(parts))
    ends = np.cumsum(lengths + 1) - 1
    starts = ends - lengths
    n = max(1, len(parts) - words + 1)
    last = ends[words - 1 :] if len(parts) >= words else ends[-1:]
    h = xxhash.xxh64_intdigest
    counts = np.zeros(BITS, np.int64)
    for at in range(0, n, 1 << 16):
        a, z = starts[at : min(n, at + (1 << 16))].tolist(), last[at : at + (1 << 16)].tolist()
        counts += bit_counts(np.array([h(flat[i:j], SEED) for i, j in zip(a, z, strict=True)], np.uint64))
    return majority(counts, n)


def bit_counts(hashes: np.ndarray) -> np.ndarray:
    """How many of the hashes have each bit set, the highest bit first."""
    return np.unpackbits(hashes.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.uint32).astype(np.int64)


def majority(counts: np.ndarray, n: int) -> int:
    """The fingerprint of n hashes by their bits' counts."""
    return int.from_bytes(np.packbits(2 * counts > n).tobytes())


def fingerprints(docs: DataFrame, words: int = 3) -> DataFrame:
    """(doc_id, bits long) of every row."""

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            bits = np.fromiter((fingerprint(x.as_py(), words) for x in b.column(1)), np.uint64, b.num_rows)
            yield pa.record_batch([b.column(0), pa.array(bits.view(np.int64))], names=["doc_id", "bits"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text")).mapInArrow(tidied(make), "doc_id long, bits long")


def gray_rank(x: np.ndarray) -> np.ndarray:
    """Position of each code in the reflected Gray order."""
    x = x.copy()
    for s in (1, 2, 4, 8, 16, 32):
        x ^= x >> np.uint64(s)
    return x


class GrayIndex:
    """Hierarchical index over codes sorted by (group, Gray rank); groups are searched apart but side by side."""

    def __init__(self, codes: np.ndarray, group: np.ndarray, fan: int = FAN):
        self.codes, n = codes, len(codes)
        group = np.cumsum(np.concatenate([[0], group[1:] != group[:-1]])) if n else group
        self.group = group
        # For each level, from the single codes up: first child of each node, shared bits, their values, last code below.
        self.levels = [(np.arange(n + 1), np.full(n, ~np.uint64(0)), codes, np.arange(n))]
        owner = group
        while n and len(owner) > group[-1] + 1:
            new = np.concatenate([[True], owner[1:] != owner[:-1]])
            first_of = np.maximum.accumulate(np.where(new, np.arange(len(owner)), 0))
            heads = np.flatnonzero((np.arange(len(owner)) - first_of) % fan == 0)
            _, mask, value, last = self.levels[-1]
            lead = np.repeat(value[heads], np.diff(np.append(heads, len(owner))))
            shared = np.bitwise_and.reduceat(mask & ~(value ^ lead), heads)
            self.levels.append((np.append(heads, len(owner)), shared, value[heads], last[np.append(heads[1:], len(owner)) - 1]))
            owner = owner[heads]

    def near(self, queries: np.ndarray, distance: int, label: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Pairs (query, later code) of a group within the distance; with labels, not those of nodes that share the query's label."""
        q, node = queries, self.group[queries]
        _, mask, value, last = self.levels[-1]
        diff = np.bitwise_count((self.codes[q] ^ value[node]) & mask[node]).astype(np.int64)
        for level in range(len(self.levels) - 1, -1, -1):
            _, mask, _, last = self.levels[level]
            keep = (diff <= distance) & (last[node] > q)
            if label is not None:
                low, high = self.spread(level, label)
                keep &= (low[node] != high[node]) | (low[node] != label[q])
            q, node, diff = q[keep], node[keep], diff[keep]
            if not level:
                return q, node
            first = self.levels[level][0]
            many = first[node + 1] - first[node]
            parent = np.repeat(node, many)
            child = np.repeat(first[node] - np.concatenate([[0], np.cumsum(many)[:-1]]), many) + np.arange(int(many.sum()))
            q, diff = np.repeat(q, many), np.repeat(diff, many)
            _, low_mask, low_value, _ = self.levels[level - 1]
            rest = low_mask[child] & ~mask[parent]  # bits that the parent has not counted
            diff = diff + np.bitwise_count((self.codes[q] ^ low_value[child]) & rest)
            node = child
        return q, node

    def spread(self, level: int, label: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Smallest and largest label below each node of a level."""
        last = self.levels[level][3]
        first = np.concatenate([[0], last[:-1] + 1])
        return np.minimum.reduceat(label, first), np.maximum.reduceat(label, first)


def join_up(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Labels after linking a and b; a label is the smallest position of its set."""
    while len(a):
        la, lb = label[a], label[b]
        apart = la != lb
        if not apart.any():
            break
        a, b, la, lb = a[apart], b[apart], la[apart], lb[apart]
        low = np.minimum(la, lb)
        np.minimum.at(label, np.maximum(la, lb), low)
        while True:
            up = label[label]
            if (up == label).all():
                break
            label = up
    return label


def bucket_links(codes: np.ndarray, group: np.ndarray, distance: int = DISTANCE) -> np.ndarray:
    """For codes sorted by (group, Gray rank): position of the first code of each one's linked set in its group."""
    index, label = GrayIndex(codes, group), np.arange(len(codes))
    if not len(codes):
        return label
    sizes = np.bincount(index.group)[index.group]
    work = np.cumsum(sizes)
    at = 0
    while at < len(codes):
        end = max(at + 1, int(np.searchsorted(work, (work[at - 1] if at else 0) + WORK)))
        q, c = index.near(np.arange(at, end), distance, label if at else None)
        label = join_up(label, q, c)
        at = end
    return label


def child_masks(mask: int, blocks: int) -> list[int]:
    """The free bits of a mask in even blocks, each added to the mask."""
    free = [i for i in range(BITS) if not mask >> i & 1]
    edges = [len(free) * i // blocks for i in range(blocks + 1)]
    return [mask | sum(1 << b for b in free[lo:hi]) for lo, hi in zip(edges, edges[1:])]


def signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def links(nodes: DataFrame, distance: int = DISTANCE, bucket: int = BUCKET, depth: int = DEPTH, put=stored) -> DataFrame:
    """Links (a, b) between the ids of nodes (bits, node) that connect all bits within the distance. bits are distinct. put stores a table."""
    spark = nodes.sparkSession
    blocks = distance + 1
    masks, found = [0], []
    rows = nodes.select(F.lit(0).cast("long").alias("mask"), "bits", "node")
    for level in range(depth):
        pairs = [(signed(m), signed(c)) for m in masks for c in child_masks(m, blocks)]
        masks = [c for m in masks for c in child_masks(m, blocks)]
        if level:
            dealt = rows.join(F.broadcast(spark.createDataFrame(pairs, "mask long, child long")), "mask")  # blocks ** depth rows
        else:
            dealt = rows.withColumn("child", F.explode(F.array(*[F.lit(c) for _, c in pairs])))
        dealt = dealt.select(F.col("child").alias("mask"), F.col("bits").bitwiseAND(F.col("child")).alias("value"), "bits", "node")
        sizes = dealt.groupBy("mask", "value").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
        sized = put(dealt.join(sizes, ["mask", "value"]), "buckets")
        last = level == depth - 1
        found.append(sized if last else sized.filter(F.col("n") <= bucket))
        rows = sized.filter(F.col("n") > bucket).select("mask", "bits", "node")
        if last or rows.isEmpty():
            break

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for b in batches:
            held.append(b)
            if sum(x.num_rows for x in held) < 1 << 15:
                continue
            whole = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
            mask, value = (whole.column(i).to_numpy() for i in (0, 1))
            inner = np.flatnonzero((mask[1:] != mask[:-1]) | (value[1:] != value[:-1]))
            if len(inner):
                cut = int(inner[-1]) + 1  # the last bucket may go on
                yield from links_of(whole.slice(0, cut))
                held = [whole.slice(cut)]
            else:
                held = [whole]
        if held:
            yield from links_of(pa.Table.from_batches(held).combine_chunks().to_batches()[0])

    def links_of(b: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        mask, value, bits, node = (b.column(i).to_numpy() for i in range(4))
        new = np.cumsum(np.concatenate([[0], (mask[1:] != mask[:-1]) | (value[1:] != value[:-1])]))
        codes = bits.view(np.uint64)
        order = np.lexsort((gray_rank(codes), new))
        label = bucket_links(codes[order], new[order], distance)
        here = np.flatnonzero(label != np.arange(len(label)))
        yield pa.record_batch([pa.array(node[order][here]), pa.array(node[order][label[here]])], names=["a", "b"])

    buckets = found[0]
    for x in found[1:]:
        buckets = buckets.union(x)
    dealt = buckets.select("mask", "value", "bits", "node").repartition("mask", "value").sortWithinPartitions("mask", "value")
    return dealt.mapInArrow(tidied(search), "a long, b long").distinct()


def near_duplicates(docs: DataFrame, words: int = 3, distance: int = DISTANCE, bucket: int = BUCKET) -> DataFrame:
    """(doc_id, bits long, component_id long) of every row."""
    marked = stored(fingerprints(docs, words), "simhash")
    nodes = stored(marked.groupBy("bits").agg(F.min("doc_id").alias("node")), "nodes")
    scratch = Scratch(docs.sparkSession, "simhash")
    linked = components(links(nodes.filter("node is not null"), distance, bucket, put=scratch.stored))
    scratch.drop()
    named = nodes.join(linked, "node", "left").select("bits", F.coalesce("component", "node").alias("component_id"))
    return marked.join(named, "bits").select("doc_id", "bits", "component_id")
