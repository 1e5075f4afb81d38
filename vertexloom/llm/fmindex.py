"""Benchmark decontamination with an FM-index for each shard of documents.

Test phrases are windows of 13 words of the benchmark's items (an item of fewer words is one window). A
shard (documents of SHARD_BYTES) keeps only its runs of words that the benchmark may have, as a
bitmap of word hashes tells, and of these the runs that are long enough for the shortest window, since no
window can lie elsewhere. Over these runs, parted by an end mark, stands one FM-index: words get numbers
from the shard's own vocabulary; the Burrows-Wheeler transform is in a wavelet matrix for ranks, with counts
of smaller words, and every 8th suffix position. All windows are searched backward at once, their
occurrences are located by steps to the next sampled position, and hit words are merged into spans.

The windows lie in blocks of bounded size in the shared folder. A task reads one block after another, turns its
words into the shard's numbers, searches the shard's index for it and lets it go. So neither the driver nor a task
holds more of the benchmark than a block, and the bitmap of VOCABULARY bits.

Nulls: a null text or item has no words; an item with a null id is searched and its hits count, but it
is not among the item ids. Items that share an id are one item. Repeated documents each get their row.
Empty tables: without items every document is clean; without documents the result is empty. Further
columns are kept; those named n_words, spans or items, in any case, are replaced.
"""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import file_system, fresh, tidied

WINDOW = 13
SAMPLE_RATE = 8
BLOCK_BYTES = 1 << 20
SHARD_BYTES = 8 << 20
VOCABULARY = 1 << 24
KNOWN = 200_000

# Bytes of words are 0-9, a-z and all beyond ASCII; A-Z are lowered, others part words.
WORD_TABLE = bytes(b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else b + 32 if 65 <= b <= 90 else 32 for b in range(256))


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode().translate(WORD_TABLE).split()


class Phrases:
    """The distinct windows of some items over the numbers of their own words, with the items of each window."""

    def __init__(self, items: list[tuple[int | None, str | None]], window: int = WINDOW):
        vocabulary: dict[bytes, int] = {}
        found: dict[tuple[int, ...], set[int | None]] = {}
        for item, text in items:
            ids = [vocabulary.setdefault(w, len(vocabulary) + 1) for w in words_of(text)]
            for at in range(max(1, len(ids) - window + 1) if ids else 0):
                found.setdefault(tuple(ids[at : at + window]), set()).add(item)
        windows = sorted(found, key=lambda w: (len(w), w))
        self.words = list(vocabulary)
        self.items = [sorted((x for x in found[w] if x is not None)) for w in windows]
        self.lengths = np.array([len(w) for w in windows], np.int64)
        self.shortest = int(self.lengths.min()) if windows else 0
        # Windows right-aligned, so that backward search starts in the last column.
        self.table = np.zeros((len(windows), window), np.int32)
        for i, w in enumerate(windows):
            self.table[i, window - len(w) :] = w

    def within(self, numbers: dict[bytes, int]) -> tuple[np.ndarray, np.ndarray]:
        """(windows over other numbers, their places) of the windows whose words all have one."""
        to = np.zeros(len(self.words) + 1, np.int32)
        to[1:] = [numbers.get(w, 0) for w in self.words]
        table = to[self.table]
        whole = np.flatnonzero(((table > 0) == (self.table > 0)).all(axis=1))
        return table[whole], whole


def word_bit(word: bytes) -> int:
    return xxhash.xxh64_intdigest(word) % VOCABULARY


class Vocabulary:
    """Whether a word may be one of the benchmark's: a bitmap, and a bounded memory of words seen."""

    def __init__(self, words: np.ndarray):
        self.bits, self.seen = words, {}

    def known(self, words: list[bytes]) -> np.ndarray:
        out = list(map(self.seen.get, words))
        for i, x in enumerate(out):
            if x is None:
                bit = word_bit(words[i])
                out[i] = bool(self.bits[bit >> 6] >> np.int64(bit & 63) & 1)
                if len(self.seen) < KNOWN:
                    self.seen[words[i]] = out[i]
        return np.array(out, bool)


class Ranks:
    """Wavelet matrix over the transform: how often a symbol occurs before a position, for many at once."""

    def __init__(self, symbols: np.ndarray, top: int):
        self.levels = max(1, int(top).bit_length())
        self.ones, self.zeros, now = [], [], symbols
        for level in range(self.levels - 1, -1, -1):
            bits = (now >> level) & 1
            self.ones.append(np.concatenate([[0], np.cumsum(bits, dtype=np.int32)]))
            kept = bits.astype(bool)
            self.zeros.append(len(now) - int(self.ones[-1][-1]))
            now = np.concatenate([np.compress(~kept, now), np.compress(kept, now)])

    def rank(self, symbols: np.ndarray, at: np.ndarray) -> np.ndarray:
        lo, hi = np.zeros_like(at), at
        for k in range(self.levels):
            one = (symbols >> (self.levels - 1 - k)) & 1 == 1
            a, b = self.ones[k][lo], self.ones[k][hi]
            lo, hi = np.where(one, self.zeros[k] + a, lo - a), np.where(one, self.zeros[k] + b, hi - b)
        return hi - lo

    def access(self, at: np.ndarray) -> np.ndarray:
        value, at = np.zeros_like(at), at.copy()
        for k in range(self.levels):
            before = self.ones[k][at].astype(np.int64)
            one = self.ones[k][at + 1] > before
            value = value * 2 + one
            at = np.where(one, self.zeros[k] + before, at - before)
        return value


def suffix_order(symbols: np.ndarray) -> np.ndarray:
    """Order of all suffixes, by doubling of the sorted prefix."""
    n = len(symbols)
    rank, step = np.unique(symbols, return_inverse=True)[1].astype(np.int64), 1
    while True:
        second = np.zeros(n, np.int64)
        second[: n - step] = rank[step:] + 1
        key = rank * (n + 1) + second
        order = np.argsort(key, kind="stable")
        new = np.empty(n, np.int64)
        new[order] = np.concatenate([[0], np.cumsum(key[order][1:] != key[order][:-1])])
        rank, step = new, step * 2
        if step >= n or rank[order[-1]] == n - 1:
            return np.argsort(rank, kind="stable")


class FMIndex:
    """Index over symbols 1.. with end marks 0; the whole is ended by the least symbol."""

    def __init__(self, symbols: np.ndarray, rate: int = SAMPLE_RATE):
        text = np.append(symbols.astype(np.int64) + 1, 0)  # 0 ends the whole, 1 is the end mark
        order = suffix_order(text)
        self.n, top = len(text), int(text.max())
        bwt = text[order - 1]
        self.ranks = Ranks(bwt, top)
        counts = np.bincount(text, minlength=top + 2)
        self.smaller = np.concatenate([[0], np.cumsum(counts)])
        self.top = top
        self.sampled = order % rate == 0
        self.place = np.cumsum(self.sampled) - 1
        self.samples = order[self.sampled]

    def search(self, table: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ranges of suffixes that start with each row of the table; its zeros at the left are no symbols."""
        lo, hi = np.zeros(len(table), np.int64), np.full(len(table), self.n, np.int64)
        for c in range(table.shape[1] - 1, -1, -1):
            live = np.flatnonzero((table[:, c] > 0) & (lo < hi))
            if not len(live):
                continue
            s = table[live, c].astype(np.int64) + 1
            known = s <= self.top
            lo[live[~known]] = hi[live[~known]] = 0
            live, s = live[known], s[known]
            lo[live], hi[live] = self.smaller[s] + self.ranks.rank(s, lo[live]), self.smaller[s] + self.ranks.rank(s, hi[live])
        return lo, np.maximum(lo, hi)

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Text positions of suffix rows, by steps to the next sampled one."""
        out, rows, steps, live = np.empty(len(rows), np.int64), rows.copy(), 0, np.arange(len(rows))
        while len(live):
            done = self.sampled[rows]
            out[live[done]] = self.samples[self.place[rows[done]]] + steps
            live, rows = live[~done], rows[~done]
            s = self.ranks.access(rows)
            rows = self.smaller[s] + self.ranks.rank(s, rows)
            steps += 1
        return out


def search_shard(texts: list[str | None], vocabulary: Vocabulary, shortest: int, blocks: Callable[[], Iterable[Phrases]]) -> list[tuple[int, list[tuple[int, int]], list[int]]]:
    """For each text: number of words, hit spans of words (start, end), item ids."""
    numbers: dict[bytes, int] = {}
    counts, runs, starts, size = [], [], [], 0
    for d, text in enumerate(texts):
        words = words_of(text)
        counts.append(len(words))
        if not shortest or len(words) < shortest:
            continue
        known = np.concatenate([[False], vocabulary.known(words), [False]])
        edge = np.flatnonzero(known[1:] != known[:-1])
        for a, z in zip(edge[::2].tolist(), edge[1::2].tolist(), strict=True):
            if z - a >= shortest:
                runs.append(np.fromiter((numbers.setdefault(w, len(numbers) + 1) for w in words[a:z]), np.int32, z - a))
                starts.append((size, d, a))
                size += z - a + 1
    out = [(n, [], []) for n in counts]
    if not runs:
        return out
    mark = np.zeros(1, np.int32)
    index = FMIndex(np.concatenate([x for r in runs for x in (r, mark)]))
    begin, doc, first = (np.array(x, np.int64) for x in zip(*starts, strict=True))
    found: dict[int, tuple[list[tuple[int, int]], set[int]]] = {}
    for phrases in blocks():
        table, place = phrases.within(numbers)
        lo, hi = index.search(table)
        many = hi - lo
        which = np.repeat(np.arange(len(many)), many)
        rows = np.repeat(lo - np.concatenate([[0], np.cumsum(many)[:-1]]), many) + np.arange(int(many.sum())) if len(many) else np.zeros(0, np.int64)
        at = index.locate(rows)
        run = np.searchsorted(begin, at, side="right") - 1
        d, start, which = doc[run], first[run] + at - begin[run], place[which]
        end = start + phrases.lengths[which]
        order = np.lexsort((end, start, d))
        for i, a, z in zip(d[order].tolist(), start[order].tolist(), end[order].tolist(), strict=True):
            spans, _ = found.setdefault(i, ([], set()))
            if spans and spans[-1][0] <= a <= spans[-1][1]:
                spans[-1] = (spans[-1][0], max(spans[-1][1], z))
            else:
                spans.append((a, z))
        for i, w in np.unique(np.stack([d, which]), axis=1).T.tolist():
            found[i][1].update(phrases.items[w])
        for i in {*d.tolist()}:
            found[i] = (merged(found[i][0]), found[i][1])
    for i, (spans, items) in found.items():
        out[i] = (counts[i], spans, sorted(items))
    return out


BLOCKS = "block binary, shortest int"


def write_blocks(items: DataFrame, window: int = WINDOW, size: int = BLOCK_BYTES) -> tuple[str, int, int]:
    """(folder, blocks, words of the shortest window): the items' windows in blocks of bounded bytes of text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[int | None, str | None]] = []
        room = size
        for b in batches:
            for at in range(b.num_rows):
                item, text = (c[at].as_py() for c in b.columns)
                held.append((item, text))
                room -= len(text or "") + 64
                if room <= 0:
                    yield block(held)
                    held, room = [], size
        if held:
            yield block(held)

    def block(held: list[tuple[int | None, str | None]]) -> pa.RecordBatch:
        p = Phrases(held, window)
        return pa.record_batch([pa.array([pickle.dumps(p)], pa.binary()), pa.array([p.shortest or None], pa.int32())], names=["block", "shortest"])

    spark = items.sparkSession
    path = fresh(spark, "phrases")
    rows = items.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")).filter("text is not null")
    rows.mapInArrow(run, BLOCKS).write.option("compression", "zstd").parquet(path)
    got = spark.read.schema(BLOCKS).parquet(path).agg(F.count("shortest"), F.min("shortest")).first()
    return path, got[0], got[1] or 0


def read_blocks(path: str) -> Iterator[Phrases]:
    """The blocks of a folder, one at a time."""
    import pyarrow.fs as pafs
    import pyarrow.parquet as pq

    fs, top = file_system(path)
    names = sorted(f.path for f in fs.get_file_info(pafs.FileSelector(top)) if f.path.endswith(".parquet"))
    for name in names:
        with fs.open_input_file(name) as f:
            for b in pq.ParquetFile(f).iter_batches(batch_size=1, columns=["block"]):
                for x in b.column(0).to_pylist():
                    yield pickle.loads(x)


def vocabulary_bits(spark: SparkSession, path: str) -> np.ndarray:
    """The bitmap of the blocks' words; the driver gets VOCABULARY / 64 numbers at most."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for x in b.column(0).to_pylist():
                words = pickle.loads(x).words
                yield pa.record_batch([pa.array([word_bit(w) for w in words], pa.int32())], names=["bit"])

    bits = spark.read.schema(BLOCKS).parquet(path).select("block").mapInArrow(run, "bit int")
    one = F.expr("shiftleft(1L, bit % 64)")
    got = bits.groupBy(F.shiftright("bit", 6).alias("at")).agg(F.bit_or(one).alias("word")).toArrow()
    out = np.zeros(VOCABULARY // 64, np.int64)
    out[got.column("at").to_numpy()] = got.column("word").to_numpy()
    return out


SPANS = T.ArrayType(T.StructType().add("start", "integer").add("end", "integer"))

# A benchmark of one block stays with its worker, so that it is read once for all shards: the folder, and the block.
_only: list[tuple[str, Phrases]] = []


def blocks_for(path: str, many: int) -> Callable[[], Iterable[Phrases]]:
    def blocks() -> Iterable[Phrases]:
        if many != 1:
            return read_blocks(path)
        if not _only or _only[0][0] != path:
            _only[:] = [(path, p) for p in read_blocks(path) if p.shortest]
        return [p for _, p in _only]

    return blocks


def contamination(docs: DataFrame, items: DataFrame, window: int = WINDOW, block_bytes: int = BLOCK_BYTES, cut: bool = False) -> DataFrame:
    """docs with n_words (long), spans (of hit words) and items (ids, sorted); columns of these names, in any case, are replaced. With cut, hit words are taken out of the text."""
    spark = docs.sparkSession
    path, many, shortest = write_blocks(items, window, block_bytes)
    known = spark.sparkContext.broadcast(vocabulary_bits(spark, path))  # VOCABULARY / 8 bytes
    plain = docs.toDF(*(f"c{i}" for i in range(len(docs.columns))))  # names may clash but for their case
    keep = [i for i, c in enumerate(docs.columns) if c.lower() not in ("n_words", "spans", "items")]
    at = keep.index(docs.columns.index("text"))
    rows = plain.select(*[F.col(f"c{i}").cast("string").alias(f"c{i}") if docs.columns[i] == "text" else F.col(f"c{i}") for i in keep])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary, blocks = Vocabulary(known.value), blocks_for(path, many)
        for whole in batches:
            sizes = np.cumsum(np.array(pa.compute.binary_length(whole.column(at)).fill_null(0).to_numpy(zero_copy_only=False), np.int64))
            lo = 0
            while lo < whole.num_rows:
                hi = max(lo + 1, int(np.searchsorted(sizes, (sizes[lo - 1] if lo else 0) + SHARD_BYTES, side="right")))
                yield from marked(whole.slice(lo, hi - lo), vocabulary, blocks)
                lo = hi

    def marked(b: pa.RecordBatch, vocabulary: Vocabulary, blocks: Callable[[], Iterable[Phrases]]) -> Iterator[pa.RecordBatch]:
        texts = b.column(at).to_pylist()
        found = search_shard(texts, vocabulary, shortest, blocks)
        spans = pa.array([[{"start": a, "end": z} for a, z in s] for _, s, _ in found], pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())])))
        new = [pa.array([n for n, _, _ in found], pa.int64()), spans, pa.array([i for _, _, i in found], pa.list_(pa.int64()))]
        old = list(b.columns)
        if cut:
            old[at] = pa.array([cut_words(t, s) if s else t for t, (_, s, _) in zip(texts, found, strict=True)], pa.string())
        for start in range(0, b.num_rows, 512):
            yield pa.record_batch([c.slice(start, 512) for c in (*old, *new)], names=[*b.schema.names, "n_words", "spans", "items"])

    schema = T.StructType(list(rows.schema.fields)).add("n_words", "long").add("spans", SPANS).add("items", T.ArrayType(T.LongType()))
    return rows.mapInArrow(tidied(run), schema).toDF(*(docs.columns[i] for i in keep), "n_words", "spans", "items")


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, z in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], z))
        else:
            out.append((a, z))
    return out


def cut_words(text: str, spans: list[tuple[int, int]]) -> str:
    """The text without the spans of words; what stood around a span is parted as before."""
    data = text.encode()
    flat = data.translate(WORD_TABLE)
    out, at, word, i, n = [], 0, 0, 0, len(data)
    for a, z in spans:
        while word < a:  # to the end of word a-1
            while flat[i] == 32:
                i += 1
            j = flat.find(b" ", i)
            i = n if j < 0 else j
            word += 1
        while flat[i] == 32:
            i += 1
        out.append(data[at:i])
        while word < z:
            while flat[i] == 32:
                i += 1
            j = flat.find(b" ", i)
            i = n if j < 0 else j
            word += 1
        at = i
    out.append(data[at:])
    return b"".join(out).decode()
