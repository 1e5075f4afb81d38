"""The two segmented binary edge formats: SVC-II and HIP.

A graph lies in segments; a vertex is (segment, offset). Numbers are 32-bit big-endian. The header file
is `info`. Its strings are written here as a 16-bit length and UTF-8 bytes; no file of another writer
was at hand to compare that with.

SVC-II: `src-i-j` and `dest-i-j` hold the offsets of the edges from segment i to j, `label-i-j` their
labels if there are any. HIP: `src-s` and `dst-s` hold the edges out of segment s, by target segment
and offset (`in-src-s`, `in-dst-s` those into it); in the compact form the source file holds
(offset, count) for each run.

Executors read an edge file pair at a time in pieces of PIECE numbers, from any file system that pyarrow
knows; a writer's task writes the files of its segment under a name of its own and renames them.
"""

from __future__ import annotations

import io
import struct
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.index import with_row_number
from ..graph import Graph
from ..storage import file_system, stored

# Fixed values of the formats.
SVCII_VERSION = 31
HIP_MAGIC = 17
HIP_NORMAL, HIP_COMPACT = 0, 1
INFO = "info"
PIECE = 1 << 18


class GraphFormatError(ValueError):
    """A header or an edge file is not what it should be."""


def put(out: io.BytesIO, *numbers: int) -> None:
    out.write(struct.pack(f">{len(numbers)}i", *numbers))


def put_text(out: io.BytesIO, text: str) -> None:
    data = text.encode()
    out.write(struct.pack(">H", len(data)) + data)


class Reader:
    def __init__(self, data: bytes):
        self.data, self.at = data, 0

    def number(self, what: str, least: int | None = None) -> int:
        if self.at + 4 > len(self.data):
            raise GraphFormatError(f"the header ends before {what}")
        value = struct.unpack_from(">i", self.data, self.at)[0]
        self.at += 4
        if least is not None and value < least:
            raise GraphFormatError(f"{what} is {value}")
        return value

    def text(self, what: str) -> str:
        if self.at + 2 > len(self.data):
            raise GraphFormatError(f"the header ends before {what}")
        n = struct.unpack_from(">H", self.data, self.at)[0]
        self.at += 2 + n
        return self.data[self.at - n : self.at].decode()


@dataclass
class Header:
    """What both headers say: vertices of each segment, edges from segment to segment, the root, and forms of HIP segments."""

    sizes: list[int]
    counts: list[list[int]]
    root: tuple[int, int] | None = None
    info: str = ""
    labels: int = 0
    forms: list[int] = field(default_factory=list)

    @property
    def segments(self) -> int:
        return len(self.sizes)

    def bases(self) -> list[int]:
        """First global id of each segment."""
        return [0, *np.cumsum(self.sizes)[:-1].tolist()]

    def to_svcii(self) -> bytes:
        out = io.BytesIO()
        put(out, SVCII_VERSION)
        put_text(out, self.info)
        put(out, self.segments, *(self.root or (-1, -1)), self.labels, -1, 0, *self.sizes)
        for row in self.counts:
            put(out, *row)
        return out.getvalue()

    @classmethod
    def of_svcii(cls, data: bytes) -> Header:
        r = Reader(data)
        if (version := r.number("version")) != SVCII_VERSION:
            raise GraphFormatError(f"version is {version}, not {SVCII_VERSION}")
        info = r.text("info")
        n = r.number("segments", 1)
        root = (r.number("root segment"), r.number("root offset"))
        if root[0] >= n:
            raise GraphFormatError(f"root segment {root[0]} of {n}")
        labels = r.number("labels")
        r.number("tau")
        r.number("unused")
        sizes = [r.number(f"states of segment {i}", 0) for i in range(n)]
        counts = [[r.number(f"edges {i}-{j}", 0) for j in range(n)] for i in range(n)]
        return cls(sizes, counts, None if root[0] < 0 else root, info, labels)

    def to_hip(self) -> bytes:
        out = io.BytesIO()
        put(out, HIP_MAGIC)
        put_text(out, self.info)
        put(out, self.segments, *(self.root or (-1, -1)), 1)
        put_text(out, "localhost")
        put(out, 1)
        put_text(out, ".")
        for s in range(self.segments):
            into = [self.counts[i][s] for i in range(self.segments)]
            put(out, self.sizes[s], *self.counts[s], *into, 0, 0, self.forms[s], self.forms[s])
        return out.getvalue()

    @classmethod
    def of_hip(cls, data: bytes) -> Header:
        r = Reader(data)
        if (magic := r.number("magic")) != HIP_MAGIC:
            raise GraphFormatError(f"magic is {magic}, not {HIP_MAGIC}")
        info = r.text("info")
        n = r.number("segments", 1)
        root = (r.number("root segment"), r.number("root offset"))
        hosts = [r.text("host") for _ in range(r.number("hosts", 1))]
        dirs = [r.text("folder") for _ in range(r.number("folders", 1))]
        sizes, counts, forms = [], [], []
        for s in range(n):
            sizes.append(r.number(f"states of segment {s}", 0))
            counts.append([r.number(f"edges {s}-{j}", 0) for j in range(n)])
            for j in range(n):
                r.number(f"edges {j}-{s}", 0)
            if not 0 <= r.number("host") < len(hosts) or not 0 <= r.number("folder") < len(dirs):
                raise GraphFormatError(f"segment {s} has an unknown host or folder")
            forms.append(r.number("form"))
            r.number("form of edges in")
        return cls(sizes, counts, None if root[0] < 0 else root, info, forms=forms)

    def describe(self, spark: SparkSession) -> DataFrame:
        """(segment, states, edges_out, edges_in) of the header."""
        rows = [(s, self.sizes[s], sum(self.counts[s]), sum(c[s] for c in self.counts)) for s in range(self.segments)]
        return spark.createDataFrame(rows, "segment int, states long, edges_out long, edges_in long")


def read_bytes(folder: str, name: str) -> bytes:
    fs, path = file_system(f"{folder}/{name}")
    with fs.open_input_file(path) as f:
        return f.read()


def numbers_in_pieces(folder: str, name: str, n: int) -> Iterator[np.ndarray]:
    """The n numbers of a file, PIECE at a time; the file has to hold just so many."""
    fs, path = file_system(f"{folder}/{name}")
    with fs.open_input_stream(path, compression=None) as f:
        for at in range(0, n, PIECE):
            want = 4 * min(PIECE, n - at)
            data = f.read(want)
            if len(data) != want:
                raise GraphFormatError(f"{name} has {at + len(data) // 4} numbers, its header says {n}")
            yield np.frombuffer(data, ">i4")
        if f.read(1):
            raise GraphFormatError(f"{name} has more than the {n} numbers of its header")


def runs_in_pieces(folder: str, name: str, n: int) -> Iterator[np.ndarray]:
    """The n numbers that a file of (number, count) stands for, PIECE at a time."""
    fs, path = file_system(f"{folder}/{name}")
    value, left, done = 0, 0, 0
    held: list[np.ndarray] = []
    room = PIECE
    with fs.open_input_stream(path, compression=None) as f:
        while data := f.read(8 * PIECE):
            if len(data) % 8:
                raise GraphFormatError(f"{name} ends within a run")
            for value, left in np.frombuffer(data, ">i4").reshape(-1, 2).tolist():
                done += left
                while left:
                    take = min(left, room)
                    held.append(np.full(take, value, np.int32))
                    left, room = left - take, room - take
                    if not room:
                        yield np.concatenate(held)
                        held, room = [], PIECE
    if done != n:
        raise GraphFormatError(f"{name} has {done} numbers, its header says {n}")
    if held:
        yield np.concatenate(held)


def raw_numbers(spark: SparkSession, folder: str, pattern: str) -> DataFrame:
    """(file, at, value) of files of 32-bit big-endian numbers whose names match a glob: what is in them, whatever they mean. Rest bytes are an error."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(folder).select("path", "length")

    def load(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for uri, size in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                if size % 4:
                    raise GraphFormatError(f"{uri} has {size % 4} bytes over")
                top, _, name = uri.rpartition("/")
                at = 0
                for x in numbers_in_pieces(top, name, size // 4):
                    yield pa.record_batch([pa.array([name] * len(x)), pa.array(np.arange(at, at + len(x))), pa.array(x.astype(np.int64))], names=["file", "at", "value"])
                    at += len(x)

    return files.mapInArrow(load, "file string, at long, value long")


def read_header(path: str, form: str) -> Header:
    return (Header.of_svcii if form == "svcii" else Header.of_hip)(read_bytes(path, INFO))


def segment_owner(segment: int, segments: int, workers: int) -> int:
    """The worker that reads a segment: blocks in order, the first `segments mod workers` one larger."""
    each, more = divmod(segments, workers)
    return segment // (each + 1) if segment < more * (each + 1) else more + (segment - more * (each + 1)) // each


def read_graph(spark: SparkSession, path: str, form: str) -> Graph:
    """A graph of either format; ids go through the segments in order. Edges carry `label` if the files have labels."""
    head = read_header(path, form)
    bases, labelled = head.bases(), form == "svcii" and head.labels > 1
    schema = "src long, dst long" + ", label int" * labelled
    if form == "svcii":
        units = [(i, j, head.counts[i][j]) for i in range(head.segments) for j in range(head.segments) if head.counts[i][j]]
    else:
        units = [(i, -1, sum(head.counts[i])) for i in range(head.segments) if sum(head.counts[i])]

    def load(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i, j, n in zip(*(b.column(k).to_pylist() for k in range(3)), strict=True):
                if form == "svcii":
                    names = [f"src-{i}-{j}", f"dest-{i}-{j}"] + [f"label-{i}-{j}"] * labelled
                    ends = np.array([n])
                    firsts = np.array([bases[j]])
                else:
                    names = [f"src-{i}", f"dst-{i}"]
                    ends, firsts = np.cumsum(head.counts[i]), np.array(bases)
                    if head.forms[i] not in (HIP_NORMAL, HIP_COMPACT):
                        raise GraphFormatError(f"segment {i} has the unknown form {head.forms[i]}")
                compact = form == "hip" and head.forms[i] == HIP_COMPACT
                sources = runs_in_pieces(path, names[0], n) if compact else numbers_in_pieces(path, names[0], n)
                others = [numbers_in_pieces(path, x, n) for x in names[1:]]
                at = 0
                for src, dst, *label in zip(sources, *others, strict=True):
                    target = np.searchsorted(ends, np.arange(at, at + len(dst)), side="right")
                    cols = [pa.array(src.astype(np.int64) + bases[i]), pa.array(dst.astype(np.int64) + firsts[target])]
                    yield pa.record_batch(cols + [pa.array(x.astype(np.int32)) for x in label], names=["src", "dst", "label"][: len(cols) + len(label)])
                    at += len(dst)

    files = spark.createDataFrame(units, "i int, j int, n long").repartition(max(1, len(units)))
    root = None if head.root is None else bases[head.root[0]] + head.root[1]
    return Graph(spark.range(sum(head.sizes)).select("id"), files.mapInArrow(load, schema), root)


def place(graph: Graph, segments: int, colocated: int = 1, policy: str = "round", seed: int = 1) -> DataFrame:
    """(id, segment, offset): vertices in the order of ids, in groups of `colocated`, round-robin or at random."""
    rows = with_row_number(graph.vertices.select("id"), "id")
    group = F.floor(F.col("row") / colocated).cast("long")
    segment = F.pmod(group, F.lit(segments)) if policy == "round" else F.pmod(F.xxhash64(F.lit(seed), group), F.lit(segments))
    placed = rows.select("id", segment.cast("int").alias("segment"))
    numbered = with_row_number(placed, "segment", "id")
    firsts = numbered.groupBy("segment").agg(F.min("row").alias("first"))  # a row a segment
    return numbered.join(F.broadcast(firsts), "segment").select("id", "segment", (F.col("row") - F.col("first")).cast("int").alias("offset"))


def write_graph(graph: Graph, path: str, form: str, segments: int = 4, compact: bool = False, policy: str = "round", colocated: int = 1, info: str = "") -> DataFrame:
    """Writes a graph in either format; returns (id, segment, offset). A task writes all files of a segment, edges in order."""
    if form not in ("svcii", "hip"):
        raise GraphFormatError(f"unknown format {form}")
    spark = graph.spark
    fs, top = file_system(path)
    fs.create_dir(top, recursive=True)
    places = stored(place(graph, segments, colocated, policy), "places")
    labelled = "label" in graph.edges.columns and form == "svcii"
    a = places.select(F.col("id").alias("src"), F.col("segment").alias("i"), F.col("offset").alias("a"))
    b = places.select(F.col("id").alias("dst"), F.col("segment").alias("j"), F.col("offset").alias("b"))
    edges = graph.edges.join(a, "src").join(b, "dst").select("i", "j", "a", "b", *(["label"] if labelled else []))
    edges = stored(edges, "placed")
    sizes = {r[0]: r[1] for r in places.groupBy("segment").count().collect()}  # a row a segment
    counts = {(r[0], r[1]): r[2] for r in edges.groupBy("i", "j").count().collect()}  # a row a pair of segments
    labels = edges.select("label").distinct().count() if labelled else 0

    def files(key: int, other: str, transposed: bool):
        def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            out: dict[str, object] = {}
            target, folder = file_system(path)
            mine = f".{TaskContext.get().taskAttemptId()}"
            held: tuple[int, int] | None = None  # compact: run in work

            def stream(name: str):
                if name not in out:
                    out[name] = target.open_output_stream(f"{folder}/{name}{mine}", compression=None)
                return out[name]

            def emit(name: str, values: np.ndarray) -> None:
                stream(name).write(np.ascontiguousarray(values).astype(">i4").tobytes())

            for batch in batches:
                cols = {n: batch.column(n).to_numpy(zero_copy_only=False) for n in batch.schema.names}
                i, j = cols["i"], cols["j"]
                if form == "svcii":
                    cut = np.flatnonzero((i[1:] != i[:-1]) | (j[1:] != j[:-1])) + 1
                    for lo, hi in zip([0, *cut], [*cut, len(i)]):
                        if hi > lo:
                            pair = f"{i[lo]}-{j[lo]}"
                            emit(f"src-{pair}", cols["a"][lo:hi])
                            emit(f"dest-{pair}", cols["b"][lo:hi])
                            if "label" in cols:
                                emit(f"label-{pair}", cols["label"][lo:hi])
                    continue
                own, far, owner, prefix = (cols["b"], cols["a"], j, "in-") if transposed else (cols["a"], cols["b"], i, "")
                cut = np.flatnonzero(owner[1:] != owner[:-1]) + 1
                for lo, hi in zip([0, *cut], [*cut, len(i)]):
                    if hi <= lo:
                        continue
                    s = int(owner[lo])
                    near, wide = (f"{prefix}dst-{s}", f"{prefix}src-{s}") if transposed else (f"src-{s}", f"dst-{s}")
                    emit(wide, far[lo:hi])
                    if not compact:
                        emit(near, own[lo:hi])
                        continue
                    part = (i if transposed else j)[lo:hi]
                    run = np.flatnonzero(np.concatenate([[True], (own[lo:hi][1:] != own[lo:hi][:-1]) | (part[1:] != part[:-1])]))
                    size = np.diff(np.append(run, hi - lo))
                    emit(near, np.stack([own[lo:hi][run], size], axis=1).reshape(-1))
            names = list(out)
            for name in names:
                out[name].close()
                target.move(f"{folder}/{name}{mine}", f"{folder}/{name}")
            yield pa.record_batch([pa.array(names, pa.string())], names=["file"])

        order = {"svcii": ["i", "j", "a", "b"], "hip": ["j", "i", "b", "a"] if transposed else ["i", "j", "a", "b"]}[form]
        dealt = edges.repartitionById(segments, F.col("j" if transposed else "i")).sortWithinPartitions(*order)
        return dealt.mapInArrow(write, "file string").collect()  # names of files

    files(0, "j", False)
    if form == "hip":
        files(1, "i", True)
    if graph.root is not None:
        got = places.filter(F.col("id") == graph.root).first()
        root = (got.segment, got.offset) if got else None
    else:
        root = None
    head = Header([sizes.get(s, 0) for s in range(segments)], [[counts.get((i, j), 0) for j in range(segments)] for i in range(segments)], root, info, labels, [HIP_COMPACT if compact else HIP_NORMAL] * segments)
    with fs.open_output_stream(f"{top}/{INFO}", compression=None) as f:
        f.write(head.to_svcii() if form == "svcii" else head.to_hip())
    return places
