"""Groups of near copies: SimHash proposes, exact resemblance of word shingles decides, shared prefixes find the rest.

A text stands for the set of hashes of its shingles (five lower-cased words; a text of fewer words is one
shingle); two texts are linked at a Jaccard index of 4/5 or more. At that index, fingerprints of 64 bits differ in ten
bits in the mean, which no index by Hamming distance can search in full. So the links of the SimHash
index (within three bits) are proposals, and the rest comes from prefixes: sets that reach 4/5 share one
of their first n - ceil(4n/5) + 1 members in any order that holds for all sets, so each set goes to a
bucket for each of these. The order puts first what a sample holds seldom; it changes the work, never the
result. Lengths and counts of hashes by their low bits rule out pairs that cannot reach 4/5, and the sets themselves decide.

A small bucket makes all its pairs. In a large one, sorted by the Gray rank of the (rotated) fingerprints,
each member is paired with the nearest of the next few. Each set is first held against its nearest
candidate alone, then against those that this leaves in other groups; then, in large buckets,
what is outside of the largest group is held against all other groups, dealt out in cells of bounded size: first
the nearest of each, and what then still is in different groups once more. So a group of n near copies doesn't
make its pairs, and no link between groups is lost. Groups are the components of the links. Only texts of
candidates move for a check: a bitmap drops most others before the shuffle.

Nulls: a null text is empty; texts without words are alike. Rows with a null doc_id take no part. Repeated rows and
unlike texts under one doc_id: a row is told by (doc_id, hash of its text), and repeated rows are one. Empty tables give
an empty result. Further columns are left aside.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import simhash, sketch
from .common import Scratch, stored, text_or_empty, tidied
from .components import components

SAMPLE = 64
COMMON = 50_000
SMALL = 16
AHEAD = 8
CELL = 2048
COUNTS = 128
BITMAP = 1 << 24


def shingle_sets(texts: list[bytes]) -> list[np.ndarray]:
    """The sorted distinct hashes of each text's shingles."""
    return sketch.sketches(texts, k=sys.maxsize)


def set_key(hashes: np.ndarray) -> int:
    return xxhash.xxh64_intdigest(hashes.tobytes()) - (1 << 63)


def prefix(hashes: np.ndarray, common: np.ndarray, times: np.ndarray) -> np.ndarray:
    """The first n - ceil(4n/5) + 1 hashes in order of (times in the sample, hash)."""
    n = len(hashes)
    many = n - (4 * n + 4) // 5 + 1 if n else 0
    if not len(common):
        return hashes[:many]
    at = np.minimum(np.searchsorted(common, hashes), len(common) - 1)
    seen = np.where(common[at] == hashes, times[at], 0)
    return hashes[np.argsort(seen, kind="stable")[:many]]


def low_counts(hashes: np.ndarray) -> bytes:
    return np.minimum(np.bincount((hashes & np.uint64(COUNTS - 1)).astype(np.int64), minlength=COUNTS), 255).astype(np.uint8).tobytes()


def fine_counts(hashes: np.ndarray) -> bytes:
    """Counts by as many low bits as give a half to one member a count, or COUNTS of them."""
    size = max(COUNTS, 1 << len(hashes).bit_length())
    return np.minimum(np.bincount((hashes & np.uint64(size - 1)).astype(np.int64), minlength=size), 255).astype(np.uint8).tobytes()


def fine_apart(x: np.ndarray, y: np.ndarray) -> int:
    """A bound from below of the members that only one of two sets has."""
    x, y = (x, y) if len(x) <= len(y) else (y, x)
    if (y == 255).any() or (x == 255).any():  # counts that stop at 255 can't be added up
        return 0 if len(x) < len(y) else int(np.abs(x.astype(np.int64) - y).sum())
    return int(np.abs(x.astype(np.int64) - y.reshape(-1, len(x)).sum(axis=0, dtype=np.int64)).sum())


def sets_of(batch: pa.RecordBatch, column: int) -> list[np.ndarray]:
    return shingle_sets([x.as_py().encode() for x in batch.column(column)])


def bits_of(hashes: np.ndarray) -> int:
    """SimHash fingerprint of a set of shingle hashes, as a signed number."""
    return simhash.signed(simhash.majority(simhash.bit_counts(hashes), len(hashes))) if len(hashes) else 0


def common_shingles(docs: DataFrame, sample: int = SAMPLE) -> tuple[np.ndarray, np.ndarray]:
    """(hashes in ascending order, times): of a sample of texts, the commonest COMMON shingles that at least three distinct ones hold."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sets = sets_of(b, 0)
            yield pa.record_batch([pa.array(np.concatenate([*sets, np.zeros(0, np.uint64)]).view(np.int64))], names=["h"])

    some = docs.select(text_or_empty().alias("text")).filter(F.pmod(F.xxhash64("text"), F.lit(sample)) == 0).dropDuplicates(["text"])
    counts = some.mapInArrow(tidied(run), "h long").groupBy("h").agg(F.count(F.lit(1)).alias("n")).filter("n > 2")
    top = counts.orderBy(F.desc("n"), "h").limit(COMMON).collect()  # COMMON rows at most
    hashes, times = np.array([r.h for r in top], np.int64).view(np.uint64), np.array([r.n for r in top], np.int64)
    order = np.argsort(hashes)
    return hashes[order], times[order]


def marked_rows(docs: DataFrame) -> DataFrame:
    """(doc_id, tie, key, n, bits, counts, fine, prefix) of every row of docs (doc_id, tie, text)."""
    common, times = common_shingles(docs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sets = sets_of(b, 2)
            cols = [
                b.column(0),
                b.column(1),
                pa.array([set_key(s) for s in sets], pa.int64()),
                pa.array([len(s) for s in sets], pa.int64()),
                pa.array([bits_of(s) for s in sets], pa.int64()),
                pa.array([low_counts(s) for s in sets], pa.binary()),
                pa.array([fine_counts(s) for s in sets], pa.binary()),
                pa.array([prefix(s, common, times).view(np.int64) for s in sets], pa.list_(pa.int64())),
            ]
            yield pa.record_batch(cols, names=["doc_id", "tie", "key", "n", "bits", "counts", "fine", "prefix"])

    return docs.select("doc_id", "tie", "text").mapInArrow(tidied(run), "doc_id long, tie long, key long, n long, bits long, counts binary, fine binary, prefix array<long>")


def runs(batches: Iterator[pa.RecordBatch], columns: int, least: int = 1 << 15) -> Iterator[pa.RecordBatch]:
    """Batches of rows sorted by the first columns, put together so that no group of these is cut."""
    held: list[pa.RecordBatch] = []
    for b in batches:
        held.append(b)
        if sum(x.num_rows for x in held) < least:
            continue
        whole = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
        new = np.zeros(whole.num_rows - 1, bool)
        for i in range(columns):
            x = whole.column(i).to_numpy()
            new |= x[1:] != x[:-1]
        inner = np.flatnonzero(new)
        cut = int(inner[-1]) + 1 if len(inner) else 0  # the last group may go on
        if cut:
            yield whole.slice(0, cut)
        held = [whole.slice(cut)]
    if sum(x.num_rows for x in held):
        yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]


def neighbours(token: np.ndarray, bits: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each row (sorted by token) the one that differs least in bits among the next AHEAD of its token in Gray order, all bits rotated by the token."""
    turn = (token % 64).astype(np.uint64)
    code = bits.view(np.uint64)
    order = np.lexsort((simhash.gray_rank(code << turn | code >> (np.uint64(63) - turn) >> np.uint64(1)), token))
    t, c = token[order], code[order]
    best, to = np.full(len(order), 65), np.full(len(order), -1)
    for k in range(1, min(AHEAD, len(order) - 1) + 1):
        apart = np.bitwise_count(c[k:] ^ c[:-k]).astype(np.int64)
        apart[t[k:] != t[:-k]] = 65
        at = np.flatnonzero(apart < best[:-k])
        best[at], to[at] = apart[at], at + k
    have = np.flatnonzero(to >= 0)
    return order[have], order[to[have]]


def first_pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(a, b, token): pairs of the buckets (token, n, key, bits); a row without b is a member of a large bucket."""
    for whole in runs(batches, 1):
        token, n, key, bits = (whole.column(i).to_numpy() for i in range(4))
        start = np.flatnonzero(np.concatenate([[True], token[1:] != token[:-1]]))
        size = np.diff(np.append(start, len(token)))
        first, many = np.repeat(start, size), np.repeat(size, size)
        at = np.arange(len(token))
        left, right = [], []
        for k in range(1, SMALL):
            ok = (at + k < first + many) & (many <= SMALL)
            left.append(at[ok])
            right.append(at[ok] + k)
        large = np.flatnonzero(many > SMALL)
        if len(large):
            i, j = neighbours(token[large], bits[large])
            left.append(large[i])
            right.append(large[j])
        a, b = np.concatenate(left), np.concatenate(right)
        near = 5 * np.minimum(n[a], n[b]) >= 4 * np.maximum(n[a], n[b])
        pairs = np.unique(np.stack([np.minimum(key[a], key[b])[near], np.maximum(key[a], key[b])[near]]), axis=1)
        gone = np.concatenate([np.zeros(pairs.shape[1], bool), np.ones(len(large), bool)])
        cols = [
            pa.array(np.concatenate([pairs[0], key[large]])),
            pa.array(np.concatenate([pairs[1], key[large]]), mask=gone),
            pa.array(np.concatenate([np.zeros(pairs.shape[1], np.int64), token[large]]), mask=~gone),
        ]
        yield pa.record_batch(cols, names=["a", "b", "token"])


def vectors(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(-1, COUNTS).astype(np.int16)


def possible(na: np.ndarray, nb: np.ndarray, apart: np.ndarray) -> np.ndarray:
    """Whether sets that differ in so many members at least can reach 4/5."""
    return (9 * apart <= na + nb) & (5 * np.minimum(na, nb) >= 4 * np.maximum(na, nb))


def cross_pairs(batches: Iterator[pa.RecordBatch], nearest: bool) -> Iterator[pa.RecordBatch]:
    """(a, b): pairs of a cell (token, x, y, n, key, label, counts) that are not in one group and may reach 4/5; of each member outside of the largest group all, or the nearest."""
    for whole in runs(batches, 3, 1 << 12):
        token, x, y, n, key, label = (whole.column(i).to_numpy() for i in range(6))
        counts = vectors(whole.column(6))
        new = (token[1:] != token[:-1]) | (x[1:] != x[:-1]) | (y[1:] != y[:-1])
        edges = np.concatenate([[0], np.flatnonzero(new) + 1, [len(token)]])
        for lo, hi in zip(edges, edges[1:]):
            kinds, where, many = np.unique(label[lo:hi], return_inverse=True, return_counts=True)
            beside = np.flatnonzero(where != np.argmax(many)) + lo  # pairs within the largest group are none
            for at in range(0, len(beside), 32):
                some = beside[at : at + 32]
                a = int(np.searchsorted(n[lo:hi], -(-4 * n[some[0]] // 5))) + lo  # sorted by n
                z = int(np.searchsorted(n[lo:hi], 5 * n[some[-1]] // 4, side="right")) + lo
                apart = np.abs(counts[some, None] - counts[None, a:z]).sum(axis=2, dtype=np.int64)
                ok = possible(n[some, None], n[None, a:z], apart) & (label[some, None] != label[None, a:z])
                if nearest:
                    i = np.flatnonzero(ok.any(axis=1))
                    j = np.where(ok[i], apart[i], 1 << 30).argmin(axis=1)
                else:
                    i, j = np.nonzero(ok)
                p, q = key[some[i]], key[a + j]
                pairs = np.unique(np.stack([np.minimum(p, q), np.maximum(p, q)]), axis=1)
                if pairs.shape[1]:
                    yield pa.record_batch([pa.array(pairs[0]), pa.array(pairs[1])], names=["a", "b"])


def by_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of (a, b, na, nb, ca, cb) the pairs that may reach 4/5."""
    for b in batches:
        if b.num_rows:
            apart = np.abs(vectors(b.column(4)) - vectors(b.column(5))).sum(axis=1, dtype=np.int64)
            ok = pa.array(possible(b.column(2).to_numpy(), b.column(3).to_numpy(), apart))
            yield b.select(["a", "b"]).filter(ok)


def by_fine(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of (a, b, na, nb, fa, fb) the pairs that may reach 4/5: (a, b, apart)."""
    for b in batches:
        both = zip(b.column(4), b.column(5), strict=True)
        apart = np.array([fine_apart(*(np.frombuffer(v.as_buffer(), np.uint8) for v in x)) for x in both], np.int64)
        ok = pa.array(possible(b.column(2).to_numpy(), b.column(3).to_numpy(), apart))
        yield pa.record_batch([b.column(0), b.column(1), pa.array(apart)], names=["a", "b", "apart"]).filter(ok)


def narrowed(pairs: DataFrame, nodes: DataFrame, put) -> DataFrame:
    """The distinct pairs (a, b) that may reach 4/5 by their fine counts, and how far apart they are at least."""
    a, b = nodes.select("key", "n", "fine").toDF("a", "na", "fa"), nodes.select("key", "n", "fine").toDF("b", "nb", "fb")
    both = pairs.distinct().join(a, "a").join(b, "b").select("a", "b", "na", "nb", "fa", "fb")
    return put(both.mapInArrow(tidied(by_fine), "a long, b long, apart long"), "pairs")


def by_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of (a, b, text of a, text of b) the pairs that reach 4/5."""
    for whole in batches:
        for at in range(0, whole.num_rows, 256):
            b = whole.slice(at, 256)
            ok = [9 * len(np.intersect1d(s, t, assume_unique=True)) >= 4 * (len(s) + len(t)) for s, t in zip(sets_of(b, 2), sets_of(b, 3), strict=True)]
            yield b.select(["a", "b"]).filter(pa.array(ok, pa.bool_()))


def bitmap(keys: DataFrame, h: Column) -> np.ndarray:
    """BITMAP bits, those of the hashes h set; the driver gets BITMAP / 64 words at most."""
    bit = keys.select(F.pmod(h, F.lit(BITMAP)).alias("bit"))
    one = F.expr("shiftleft(1L, cast(bit % 64 as int))")
    words = bit.groupBy(F.shiftright("bit", 6).alias("at")).agg(F.bit_or(one).alias("word")).toArrow()
    out = np.zeros(BITMAP // 64, np.int64)
    out[words.column("at").to_numpy()] = words.column("word").to_numpy()
    return out


def verified(pairs: DataFrame, nodes: DataFrame, docs: DataFrame, put) -> DataFrame:
    """The pairs (a, b) of keys whose sets reach 4/5; docs are (doc_id, tie, text)."""
    ends = pairs.select(F.col("a").alias("key")).union(pairs.select("b")).distinct()
    wanted = put(ends.join(nodes.select("key", "doc_id", "tie"), "key"), "wanted")
    h = F.xxhash64("doc_id", "tie")
    held = docs.sparkSession.sparkContext.broadcast(bitmap(wanted, h))  # BITMAP / 8 bytes

    def maybe(x: pd.Series) -> pd.Series:
        bit = x.to_numpy() % BITMAP
        return pd.Series((held.value[bit >> 6] >> (bit & 63)) & 1 == 1)

    some = docs.filter(F.pandas_udf(maybe, "boolean")(h))
    own = Scratch(docs.sparkSession, "texts")
    texts = own.stored(some.join(wanted, ["doc_id", "tie"]).select("key", "text"), "texts")
    if texts.count() > wanted.count():  # repeated rows
        texts = texts.dropDuplicates(["key"])
    a, b = texts.toDF("a", "ta"), texts.toDF("b", "tb")
    links = put(pairs.select("a", "b").join(a, "a").join(b, "b").select("a", "b", "ta", "tb").mapInArrow(tidied(by_sets), "a long, b long"), "links")
    own.drop()
    return links


def proposals(nodes: DataFrame, put) -> DataFrame:
    """Pairs (a, b) by SimHash: equal fingerprints, and links of the Gray-order index."""
    codes = put(nodes.groupBy("bits").agg(F.min("key").alias("node")), "codes")
    same = nodes.join(codes, "bits").filter("key <> node").select(F.col("node").alias("a"), F.col("key").alias("b"))
    index = simhash.links(codes, put=put)
    both = same.union(index)
    return both.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))


def apart_from(pairs: DataFrame, label: DataFrame) -> DataFrame:
    """The pairs (a, b) whose ends are in different groups."""
    la, lb = label.toDF("a", "la"), label.toDF("b", "lb")
    return pairs.join(la, "a", "left").join(lb, "b", "left").filter("coalesce(la, a) <> coalesce(lb, b)").select("a", "b")


def nearest_of(pairs: DataFrame) -> DataFrame:
    """Of the pairs (a, b, apart) those with the nearest of an end."""
    ways = pairs.select("a", "b", "apart").union(pairs.select("b", "a", "apart"))
    best = ways.groupBy("a").agg(F.min(F.struct("apart", "b")).alias("to")).select("a", F.col("to.b").alias("b"))
    return best.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def near_copies(docs: DataFrame) -> DataFrame:
    """(doc_id, tie, component) of every row with a doc_id; tie is the hash of the text, component names the group."""
    scratch = Scratch(docs.sparkSession, "likeness")
    put = scratch.stored
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text")).filter("doc_id is not null")
    rows = rows.withColumn("tie", F.xxhash64("text"))
    marked = put(marked_rows(rows), "marked")
    nodes = put(marked.dropDuplicates(["key"]), "nodes")  # any row of a set stands for it
    entries = nodes.select(F.explode("prefix").alias("token"), "n", "key", "bits").repartition("token").sortWithinPartitions("token", "n", "key")
    found = put(entries.mapInArrow(tidied(first_pairs), "a long, b long, token long"), "found")
    short = nodes.select("key", "n", "counts")
    a, b = short.toDF("a", "na", "ca"), short.toDF("b", "nb", "cb")
    both = found.filter("b is not null").select("a", "b").union(proposals(nodes, put)).distinct().join(a, "a").join(b, "b").select("a", "b", "na", "nb", "ca", "cb")
    pairs = narrowed(both.mapInArrow(tidied(by_counts), "a long, b long"), nodes, put)

    links = verified(put(nearest_of(pairs), "nearest"), nodes, rows, put)
    label = components(links).toDF("key", "label")
    links = links.union(verified(put(apart_from(pairs, label), "rest"), nodes, rows, put))
    large = put(found.filter("b is null").select("token", F.col("a").alias("key")), "large")
    for nearest in (True, False):
        label = put(components(links).toDF("key", "label"), "labels")
        far = narrowed(across(large, label, short, put, nearest), nodes, put)
        far = put(nearest_of(far), "nearest") if nearest else far.select("a", "b")
        if far.isEmpty():
            break
        links = links.union(verified(far, nodes, rows, put))
    label = components(links).toDF("key", "component")
    out = stored(marked.select("doc_id", "tie", "key").join(label, "key", "left").select("doc_id", "tie", F.coalesce("component", "key").alias("component")), "groups")
    scratch.drop()
    return out


def across(large: DataFrame, label: DataFrame, short: DataFrame, put, nearest: bool) -> DataFrame:
    """Pairs (a, b) of keys across groups within the large buckets (token, key) that may reach 4/5: all, or the nearest of a key in each bucket."""
    named = put(large.join(label, "key", "left").select("token", "key", F.coalesce("label", "key").alias("label")), "named")
    split = named.groupBy("token").agg(F.min("label").alias("lo"), F.max("label").alias("hi"), F.count(F.lit(1)).alias("many")).filter("lo <> hi")
    rows = named.join(split.select("token", F.ceil(F.col("many") / CELL).cast("int").alias("cells")), "token").join(short, "key")
    rows = rows.withColumn("own", F.pmod(F.xxhash64("key"), F.col("cells")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("cells") - 1)))
    dealt = rows.select("token", F.least("own", "other").alias("x"), F.greatest("own", "other").alias("y"), "n", "key", "label", "counts")
    dealt = dealt.repartition("token", "x", "y").sortWithinPartitions("token", "x", "y", "n")
    return dealt.mapInArrow(tidied(lambda batches: cross_pairs(batches, nearest)), "a long, b long")
