"""Bottom-k sketches of word-shingle hashes.

A sketch holds the k smallest distinct hashes of a document's shingles (five lower-cased words; a text
of fewer words is one shingle). Sketches of parts merge into that of the whole, and two sketches
estimate resemblance, containment and the number of distinct shingles.

Nulls: a null text is empty and has the empty sketch, which is like another empty one (1) and unlike all
others (0). A null doc_id sorts first. Repeated rows follow one another in the order. Empty tables give
an empty result; a single document's next is itself. Further columns are left aside.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import tidied

from .ordered import with_lookahead

K = 256
WORDS = 5
BLOCK = 1 << 20

LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
SPACE = np.isin(np.arange(256), [9, 10, 11, 12, 13, 32])
BASE = 0x9E3779B97F4A7C15


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_powers: list[np.ndarray] = []


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd base and of its inverse, modulo 2**64."""
    if not _powers or len(_powers[0]) < n:
        size = max(n, BLOCK * 2)
        _powers[:] = [np.cumprod(np.full(size, b, np.uint64), dtype=np.uint64) for b in (BASE, pow(BASE, -1, 1 << 64))]
    return _powers[0], _powers[1]


def shingle_hashes(texts: list[bytes], words: int = WORDS) -> list[np.ndarray]:
    """Hashes of all shingles of each text, repeats included."""
    data = np.frombuffer(b" ".join(texts).translate(LOWER) + b" ", np.uint8)
    up, down = powers(len(data))
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(data * up[: len(data)], dtype=np.uint64, out=sums[1:])
    space = np.concatenate([[True], SPACE[data]])
    start = np.flatnonzero(space[:-1] & ~space[1:])
    end = np.flatnonzero(~space[:-1] & space[1:])
    word = mix((sums[end] - sums[start]) * down[start])
    edges = np.cumsum([0, *(len(x) + 1 for x in texts)])
    first = np.searchsorted(start, edges)
    n = len(word) - words + 1
    whole = np.zeros(max(n, 0), np.uint64)
    for j in range(words):
        if n > 0:
            whole = whole * np.uint64(BASE) + word[j : j + n]
    whole = mix(whole)
    out = []
    for a, z in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
        if z - a >= words:
            out.append(whole[a : z - words + 1])
        elif z > a:
            short = np.zeros(1, np.uint64)
            for w in word[a:z]:
                short = short * np.uint64(BASE) + w
            out.append(mix(short + np.uint64(z - a)))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def bottom(hashes: np.ndarray, k: int = K) -> np.ndarray:
    """The k smallest distinct hashes in order."""
    if len(hashes) > 4 * k:
        low = np.unique(hashes[hashes < np.uint64(int((1 << 64) - 1) * 3 * k // len(hashes))])
        if len(low) >= k:
            return low[:k]
    return np.unique(hashes)[:k]


def sketches(texts: list[bytes], k: int = K, words: int = WORDS) -> list[np.ndarray]:
    """Sketch of each text; texts go through in blocks, a long one in parts that overlap by a shingle's words less one."""
    out: list[np.ndarray] = []
    block: list[bytes] = []
    held = 0
    for x in texts:
        if len(x) > BLOCK:
            out += [bottom(h, k) for h in shingle_hashes(block, words)] if block else []
            block, held = [], 0
            got = np.zeros(0, np.uint64)
            for part in overlapping(x, words):
                got = merge(got, bottom(shingle_hashes([part], words)[0], k), k)
            out.append(got)
            continue
        block.append(x)
        held += len(x)
        if held >= BLOCK:
            out += [bottom(h, k) for h in shingle_hashes(block, words)]
            block, held = [], 0
    return out + ([bottom(h, k) for h in shingle_hashes(block, words)] if block else [])


def overlapping(text: bytes, words: int) -> Iterator[bytes]:
    """A long text in parts that hold each shingle once whole."""
    parts = text.split()
    if len(parts) < words:
        yield text
        return
    size = 1 << 16
    for at in range(0, len(parts) - words + 1, size):
        yield b" ".join(parts[at : at + size + words - 1])


def merge(a: np.ndarray, b: np.ndarray, k: int = K) -> np.ndarray:
    """Sketch of the union."""
    return np.unique(np.concatenate([a, b]))[:k]


def resemblance(a: np.ndarray, b: np.ndarray, k: int = K) -> float:
    """Estimated share of common shingles among all of both."""
    if not len(a) and not len(b):
        return 1.0
    both = np.sort(np.concatenate([a, b]))
    same = both[:-1] == both[1:]
    new = np.concatenate([[True], ~same])
    upto = min(k, int(new.sum()))
    last = np.flatnonzero(new)[upto - 1]
    return float(np.count_nonzero(same[: last + 1] if last + 1 <= len(same) else same)) / upto


def distinct(a: np.ndarray, k: int = K) -> float:
    """Estimated number of distinct shingles; exact below k."""
    return float(len(a)) if len(a) < k else (k - 1) * 2.0**64 / float(a[k - 1])


def containment(a: np.ndarray, b: np.ndarray, k: int = K) -> float:
    """Estimated share of a's shingles that b has as well."""
    if not len(a):
        return 1.0
    common = resemblance(a, b, k) * distinct(merge(a, b, k), k)
    return min(1.0, common / distinct(a, k))


def write_sketch(a: np.ndarray) -> str:
    return base64.b64encode(a.astype("<u8").tobytes()).decode()


def read_sketch(text: str) -> np.ndarray:
    return np.frombuffer(base64.b64decode(text), "<u8")


def edited(text: str, other: str) -> str:
    """The last quarter of the code points replaced by the first as many (or all) of the other text."""
    many = len(text) // 4
    return text[: len(text) - many] + other[:many]


SCHEMA = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def fingerprint_edits(docs: DataFrame, k: int = K, words: int = WORDS) -> DataFrame:
    """SCHEMA of every row: sketches of its text and of the text edited with the next document's, and likenesses."""

    def block(rows: list[tuple[int | None, str]], last: tuple[int | None, str]) -> pa.RecordBatch:
        nexts = [*(t for _, t in rows[1:]), last[1]]
        changed = [edited(t, n).encode() for (_, t), n in zip(rows, nexts, strict=True)]
        own = sketches([t.encode() for _, t in rows] + [last[1].encode()], k, words)
        new = sketches(changed, k, words)
        n = len(rows)
        cols = [
            pa.array([d for d, _ in rows], pa.int64()),
            pa.array([len(t) for _, t in rows], pa.int64()),
            pa.array([hashlib.sha256(x).hexdigest() for x in changed], pa.string()),
            pa.array([write_sketch(x) for x in own[:n]], pa.string()),
            pa.array([write_sketch(x) for x in new], pa.string()),
            pa.array([resemblance(a, b, k) for a, b in zip(own, new)], pa.float64()),
            pa.array([resemblance(a, b, k) for a, b in zip(own, own[1:])], pa.float64()),
        ]
        return pa.record_batch(cols, names=[x.split()[0] for x in SCHEMA.split(", ")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple[int | None, str]] = []
        held = 0
        for b in batches:
            for d, t, look in zip(*(b.column(i) for i in (1, 2, 3)), strict=True):
                if look.as_py():
                    if rows:
                        yield block(rows, (d.as_py(), t.as_py()))
                        rows = []
                    continue  # further rows with the first id behind
                rows.append((d.as_py(), t.as_py()))
                held += len(rows[-1][1])
                if held >= BLOCK and len(rows) > 1:
                    yield block(rows[:-1], rows[-1])
                    rows, held = rows[-1:], 0

    return with_lookahead(docs).mapInArrow(tidied(run), SCHEMA)
