"""Language identification: multinomial naive Bayes over hashed character n-grams.

Training takes all labelled texts, or a share of them by hash that holds `sample` in the mean, and of each
the whole text. Counts are summed by (language, bucket) before they are sent to the driver, where they
are as many as languages times buckets at most; with many languages buckets get fewer, so that the matrix
stays within MODEL numbers. Log-probabilities and the log shares of languages among the learned texts (the
prior) are broadcast. A batch of texts is scored at once: the n-grams of many texts are looked up as
rows of the matrix and added up by text.

The score is the probability of the predicted language under the model with the evidence of each text
cut to `evidence` n-grams' worth, so that long texts do not all score one.

Nulls: a null text, or one without a letter, is predicted as `und` with score 0; rows with a null label
are not learned from. Repeated rows count as often as they come. Without any labelled text, every text
is `und`. Ties go to the language that sorts first. Very long texts are scored in pieces that overlap by
an n-gram less one, which gives the same sums. Empty tables give an empty result. Further columns are
kept; those named lang_pred or score, in any case, are replaced.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import tidied

BUCKETS = 1 << 16
ORDERS = (1, 2, 3)
SAMPLE = 20_000
EVIDENCE = 50.0
UNKNOWN = "und"
MODEL = 1 << 24
PIECE = 1 << 18
# Odd multipliers that mix the characters of an n-gram.
MULTIPLIERS = (0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D)

LETTER = re.compile(r"[^\W\d_]")


def code_points(text: str) -> np.ndarray:
    """Lower-case characters between single bounds; all that is no letter is one bound."""
    points = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    letter = (points >= 0x80) | ((points >= 97) & (points <= 122))
    points = np.where(letter, points, np.uint32(32))
    keep = letter.copy()
    keep[1:] |= letter[:-1]  # one bound behind each run of letters
    return np.concatenate([[np.uint32(32)], points[keep], [np.uint32(32)]]).astype(np.uint32)


def features(points: np.ndarray, buckets: int = BUCKETS, orders: tuple[int, ...] = ORDERS, starts: int | None = None) -> np.ndarray:
    """Bucket of every n-gram, or of those that begin among the first `starts` points."""
    out, mixed = [], np.zeros(len(points), np.uint32)
    shift = np.uint32(32 - (buckets - 1).bit_length())
    for n in range(1, max(orders) + 1):
        if len(points) < n:
            break
        mixed = (mixed[: len(points) - n + 1] ^ points[n - 1 :]) * np.uint32(MULTIPLIERS[(n - 1) % 3]) + np.uint32(n)
        if n in orders:
            out.append((((mixed ^ (mixed >> np.uint32(15))) * np.uint32(0x2C1B3C6D)) >> shift)[:starts])
    return np.concatenate(out).astype(np.int64) if out else np.zeros(0, np.int64)


def pieces(points: np.ndarray, buckets: int, size: int | None = None) -> Iterator[np.ndarray]:
    """The buckets of all n-grams of a text, of bounded numbers at a time."""
    size = size or PIECE
    for at in range(0, max(1, len(points)), size):
        yield features(points[at : at + size + max(ORDERS) - 1], buckets, starts=size)


def train(docs: DataFrame, usable: Column, sample: int = SAMPLE, buckets: int = BUCKETS) -> tuple[list[str], np.ndarray, np.ndarray]:
    """(languages, log-probability of each bucket and language, log share of each language) from rows that are usable and labelled."""
    rows = docs.filter(usable & F.col("lang").isNotNull() & F.col("text").isNotNull()).select(F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text"), F.xxhash64(F.lit(17), "doc_id").alias("at"))
    sizes = rows.agg(F.count(F.lit(1)), F.countDistinct("lang")).first()
    total, many = sizes[0], sizes[1]
    if not total:
        return [], np.zeros((buckets, 0), np.float32), np.zeros(0)
    while many * buckets > MODEL and buckets > 256:
        buckets //= 2
    if total > sample:  # all of them, or a share by hash whose mean is the sample
        rows = rows.filter(F.col("at") < F.lit(int(-(2**63) + 2**64 * (sample / total))))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        for b in batches:
            for lang, text in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                own = sums.setdefault(lang, np.zeros(buckets + 1, np.int64))
                for f in pieces(code_points(text.as_py()), buckets):
                    own[:buckets] += np.bincount(f, minlength=buckets)
                own[buckets] += 1  # texts
            if len(sums) * buckets > MODEL:
                yield from summed(sums)
                sums = {}
        yield from summed(sums)

    def summed(sums: dict[str, np.ndarray]) -> Iterator[pa.RecordBatch]:
        for lang, s in sums.items():
            at = np.flatnonzero(s)
            yield pa.record_batch([pa.array([lang] * len(at), pa.string()), pa.array(at, pa.int32()), pa.array(s[at], pa.int64())], names=["lang", "bucket", "n"])

    parts = rows.select("lang", "text").mapInArrow(tidied(count), "lang string, bucket int, n long")
    got = parts.groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toPandas()  # languages x buckets rows at most
    langs = sorted(got["lang"].unique())
    counts = np.zeros((buckets + 1, len(langs)))
    for k, lang in enumerate(langs):
        own = got[got["lang"] == lang]
        counts[own["bucket"].to_numpy(), k] = own["n"].to_numpy()
    return langs, *model_of(counts[:buckets], counts[buckets])


def model_of(counts: np.ndarray, texts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(log-probabilities, log shares) of counts by (bucket, language) and texts by language, smoothed by a half and by one."""
    smooth = counts + 0.5
    prior = np.log((texts + 1) / (texts.sum() + len(texts)))
    return np.log(smooth / smooth.sum(axis=0)).astype(np.float32), prior


def sums_of(texts: list[np.ndarray], matrix: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(summed rows of the matrix, number of n-grams) of each text's code points, a block of n-grams at a time."""
    sums, sizes = np.zeros((len(texts), matrix.shape[1])), np.zeros(len(texts), np.int64)
    block: list[np.ndarray] = []
    owners: list[int] = []
    held = 0

    def flush() -> None:
        nonlocal held
        if held:
            lengths = np.array([len(f) for f in block])
            starts = np.cumsum(lengths) - lengths
            np.add.at(sums, owners, np.add.reduceat(matrix[np.concatenate(block)], starts, axis=0, dtype=np.float64))
            np.add.at(sizes, owners, lengths)
        block.clear()
        owners.clear()
        held = 0

    for i, points in enumerate(texts):
        for f in pieces(points, len(matrix)):
            if not len(f):
                continue
            block.append(f)
            owners.append(i)
            held += len(f)
            if held >= PIECE:
                flush()
    flush()
    return sums, sizes


def scores(texts: list[str | None], langs: list[str], matrix: np.ndarray, prior: np.ndarray, evidence: float = EVIDENCE) -> tuple[list[str], list[float]]:
    """(language, score) of each text."""
    best, sure = [UNKNOWN] * len(texts), [0.0] * len(texts)
    here = [i for i, x in enumerate(texts) if langs and x is not None and LETTER.search(x)]
    if not here:
        return best, sure
    sums, sizes = sums_of([code_points(texts[i]) for i in here], matrix)
    top = np.argmax(sums + prior, axis=1)
    z = sums / np.maximum(sizes, 1)[:, None] * np.minimum(sizes, evidence)[:, None] + prior
    p = np.exp(z - z.max(axis=1, keepdims=True))
    p /= p.sum(axis=1, keepdims=True)
    for i, k, own in zip(here, top.tolist(), p, strict=True):
        best[i], sure[i] = langs[k], float(own[k])
    return best, sure


def predict(docs: DataFrame, langs: list[str], weights: np.ndarray, prior: np.ndarray, evidence: float = EVIDENCE) -> DataFrame:
    """docs with lang_pred (string) and score (double); columns of these names, in any case, are replaced."""
    model = docs.sparkSession.sparkContext.broadcast((langs, weights, prior))  # MODEL numbers at most
    plain = docs.toDF(*(f"c{i}" for i in range(len(docs.columns))))  # names may clash but for their case
    keep = [i for i, c in enumerate(docs.columns) if c.lower() not in ("lang_pred", "score")]
    at = keep.index(docs.columns.index("text"))
    rows = plain.select(*[F.col(f"c{i}").cast("string").alias(f"c{i}") if docs.columns[i] == "text" else F.col(f"c{i}") for i in keep])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for start in range(0, whole.num_rows, 512):
                b = whole.slice(start, 512)
                best, sure = scores(b.column(at).to_pylist(), *model.value, evidence)
                yield pa.record_batch([*b.columns, pa.array(best, pa.string()), pa.array(sure, pa.float64())], names=[*b.schema.names, "lang_pred", "score"])

    schema = T.StructType(list(rows.schema.fields)).add("lang_pred", "string").add("score", "double")
    return rows.mapInArrow(tidied(run), schema).toDF(*(docs.columns[i] for i in keep), "lang_pred", "score")


def held_out() -> Column:
    """Whether a row is kept from training: crc32 of the doc_id as text leaves 0 modulo 5; a null id is never held out."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, F.lit(False))


def identify(docs: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """docs with held_out, lang_pred and score, learned from the rows that are not held out."""
    return predict(docs.withColumn("held_out", held_out()), *train(docs, ~held_out(), sample))
