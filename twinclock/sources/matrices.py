"""Matrix files of level 5 as a data source: muscle recordings, EEG recordings, trial blocks, and entries or rows of any named matrix.

A file is a partition. Variables that are not asked for are skipped by their headers; a compressed one is unpacked only as far as
its name. The format itself keeps a variable below 2 GB, and a task holds one wanted variable at a time. Files of version 7.3 hold another
format and are an error, as are files without what is asked for.
"""

from __future__ import annotations

import io
import re
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from .archives import listed, opened
from .recordings import CHUNK

#: Number types of the format, and the classes of its matrices.
NUMBERS = {1: "i1", 2: "u1", 3: "i2", 4: "u2", 5: "i4", 6: "u4", 7: "f4", 9: "f8", 12: "i8", 13: "u8"}
MATRIX, PACKED, UTF8, UTF16, UTF32 = 14, 15, 16, 17, 18
CELL, STRUCT, CHAR, SPARSE, FIRST_NUMBER, LAST_NUMBER = 1, 2, 4, 5, 6, 15
NOT_BIPOLAR = ("aux", "trigger", "multiple", "sync")
FIRST_CHANNELS = 10
BLOCK = 1 << 16


class Elements:
    """Reads the elements of a level-5 stream one after the other."""

    def __init__(self, f, order: str):
        self.f, self.order = f, order

    def head(self) -> tuple[int, int, bytes | None] | None:
        raw = self.f.read(8)
        if len(raw) < 8:
            return None
        kind, size = struct.unpack(self.order + "II", raw)
        if kind >> 16:  # a small element holds its data in the tag
            return kind & 0xFFFF, kind >> 16, raw[4 : 4 + (kind >> 16)]
        return kind, size, None

    def data(self) -> tuple[int, bytes]:
        kind, size, data = self.head() or (0, 0, b"")
        if data is None:
            data = self.f.read(size)
            self.f.read(-size % 8)
        return kind, data

    def numbers(self) -> np.ndarray:
        kind, data = self.data()
        if kind == UTF8:
            return np.array([ord(c) for c in data.decode()], np.uint32)
        if kind in (UTF16, UTF32):
            kind = 4 if kind == UTF16 else 6
        return np.frombuffer(data, self.order + NUMBERS[kind]) if kind else np.zeros(0)

    def title(self) -> tuple[int, int, list[int], str]:
        """Class, flags, dimensions and name of the matrix that begins here."""
        flags = int(self.numbers()[0])
        dims = [int(n) for n in self.numbers()]
        return flags & 0xFF, flags, dims, self.data()[1].decode("latin-1")

    def matrix(self):
        head = self.head()
        if head is None or head[1] == 0:
            return np.zeros((0, 0))
        return self.body(*self.title()[:3])

    def body(self, kind: int, flags: int, dims: list[int]):
        n = int(np.prod(dims)) if dims else 0
        if kind == CELL:
            return [self.matrix() for _ in range(n)]
        if kind == STRUCT:
            width = int(self.numbers()[0])
            raw = self.data()[1]
            names = [raw[k : k + width].split(b"\0")[0].decode("latin-1") for k in range(0, len(raw), width)]
            rows = [{name: self.matrix() for name in names} for _ in range(n)]
            return rows[0] if n == 1 else rows
        if kind == CHAR:
            signs = self.numbers()
            if not n:
                return ""
            signs = signs.reshape(dims, order="F")
            texts = ["".join(map(chr, row)) for row in signs.reshape(len(signs), -1)]
            return texts[0] if len(texts) == 1 else texts
        if kind == SPARSE:
            rows, ends, values = self.numbers(), self.numbers(), self.numbers()
            out = np.zeros(dims)
            out[rows, np.repeat(np.arange(dims[1]), np.diff(ends))] = values
            return out
        if not FIRST_NUMBER <= kind <= LAST_NUMBER:
            raise ValueError(f"a matrix of class {kind} is not known")
        real = self.numbers().astype(float)
        if flags & 0x0800:
            self.numbers()  # the imaginary part
        return real.reshape(dims, order="F")


def variable(f, wanted: str):
    """The named variable of an open file, or None."""
    head = f.read(128)
    order = {b"IM": "<", b"MI": ">"}.get(head[126:128])
    if order is None or head[124:128] not in (b"\x00\x01IM", b"\x01\x00MI"):
        raise ValueError("not a matrix file of level 5")
    while True:
        at = f.tell()
        raw = f.read(8)
        if len(raw) < 8:
            return None
        kind, size = struct.unpack(order + "II", raw)
        if kind == PACKED:
            first = zlib.decompressobj().decompress(f.read(min(size, 4096)), 1024)
            inner = Elements(io.BytesIO(first), order)
            if inner.head() and inner.title()[3] == wanted:
                f.seek(at + 8)
                return Elements(io.BytesIO(zlib.decompress(f.read(size))), order).matrix()
        elif kind == MATRIX and size:
            own = Elements(f, order)
            title = own.title()
            if title[3] == wanted:
                return own.body(*title[:3])
        f.seek(at + 8 + size)


def texts(value) -> list[str]:
    """Texts of a char matrix or a cell of them."""
    if isinstance(value, str):
        return [value] if value else []
    return [x if isinstance(x, str) else "".join(texts(x)) for x in value] if isinstance(value, list) else []


def number(value) -> float | None:
    """The first number of a field; texts of numbers count, others and missing ones are none."""
    try:
        x = float(value) if isinstance(value, str) else float(np.ravel(value)[0])
    except (ValueError, IndexError, TypeError):
        return None
    return x if np.isfinite(x) else None


def axis(value) -> np.ndarray:
    return np.ravel(value).astype(float) if isinstance(value, np.ndarray) else np.zeros(0)


def chunks(samples: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    for k in range(0, max(1, len(samples)), CHUNK):
        yield k // CHUNK, samples[k : k + CHUNK]


def emg(read) -> Iterator[tuple]:
    """ch, label, adapter, fs, chunk, samples: the first ten channels that are no trigger, sync or auxiliary ones."""
    data = read("Data")
    if not isinstance(data, list) or not data or not isinstance(data[0], np.ndarray) or data[0].ndim != 2:
        raise ValueError("no muscle data")
    x = data[0].T if data[0].shape[0] > data[0].shape[1] else data[0]
    fs = number(read("SamplingFrequency"))
    if fs is None:
        times = read("Time")
        steps = np.diff(axis(times[0])) if isinstance(times, list) and times else np.zeros(0)
        step = float(np.median(steps)) if len(steps) else 0.0
        if not (np.isfinite(step) and step > 0):
            raise ValueError("no rate")
        fs = 1 / step
    names = texts(read("Description"))
    own = [k for k, t in enumerate(names) if k < len(x) and not any(w in t.lower() for w in NOT_BIPOLAR)][:FIRST_CHANNELS]
    label = lambda n, k: f"BIP_{n:02d}" + (f"_{re.sub(r'\s+', '_', names[k].strip())}" if names else "")
    for n, k in enumerate(own or range(min(FIRST_CHANNELS, len(x))), 1):
        for chunk, part in chunks(x[k]):
            yield k, label(n, k) if own or not names else f"BIP_{n:02d}", "", fs, chunk, part


def eeg(read) -> Iterator[tuple]:
    """ch, label, x, y, z, fs, chunk, samples of a recording's channels."""
    own = read("EEG")
    if not isinstance(own, dict) or not isinstance(own.get("data"), np.ndarray) or number(own.get("srate")) is None:
        raise ValueError("no EEG data with a rate")
    data = own["data"].reshape(own["data"].shape[0], -1, order="F")
    places = own.get("chanlocs")
    places = [places] if isinstance(places, dict) else places if isinstance(places, list) else []
    for k, x in enumerate(data):
        at = places[k] if k < len(places) and isinstance(places[k], dict) else {}
        label = at.get("labels")
        for chunk, part in chunks(x):
            yield k, label if isinstance(label, str) and label else f"E{k + 1}", *[number(at.get(c)) for c in "XYZ"], number(own["srate"]), chunk, part


def trials(read) -> Iterator[tuple]:
    """dims, labels, times, start, values of a block of trials, the first axis fastest."""
    own = read("erp_sensor")
    block = own.get("trials") if isinstance(own, dict) else None
    if not isinstance(block, np.ndarray) or not block.size or block.ndim > 3:
        raise ValueError("no block of trials with three axes")
    times = next((t for t in (axis(own.get(n)) for n in ("time_axis", "time_ms", "time")) if len(t)), np.zeros(0))
    flat, dims = block.ravel(order="F"), [*block.shape, 1, 1][:3]
    labels = texts(own.get("label"))
    for k in range(0, len(flat), BLOCK):
        yield dims, labels, times.tolist(), k, flat[k : k + BLOCK]


def named(read, path: str) -> np.ndarray:
    """A matrix by its name; fields of structures follow after dots."""
    first, *rest = path.split(".")
    own = read(first)
    for name in rest:
        own = own.get(name) if isinstance(own, dict) else None
    if not isinstance(own, np.ndarray):
        raise ValueError(f"no matrix {path}")
    return own.reshape(own.shape[0], -1, order="F")


def rows_of(read, path: str) -> Iterator[tuple]:
    for i, x in enumerate(named(read, path), 1):
        for chunk, part in chunks(x):
            yield i, chunk, part


def entries_of(read, path: str) -> Iterator[tuple]:
    x = named(read, path)
    for i, j in zip(*np.nonzero(x), strict=True):
        yield int(i) + 1, int(j) + 1, float(x[i, j])


KINDS = {
    "emg": (emg, "ch int, label string, adapter string, fs double, chunk int, samples array<double>"),
    "eeg": (eeg, "ch int, label string, x double, y double, z double, fs double, chunk int, samples array<double>"),
    "trials": (trials, "dims array<int>, labels array<string>, times array<double>, start long, values array<double>"),
    "rows": (rows_of, "row long, chunk int, samples array<double>"),
    "entries": (entries_of, "row long, col long, v double"),
}


class File(InputPartition):
    def __init__(self, path: str):
        self.path = path


class MatrixReader(DataSourceReader):
    def __init__(self, options: dict[str, str], schema):
        self.options, self.schema = dict(options), schema

    def partitions(self) -> list[File]:
        return [File(p) for p in listed(self.options["path"], self.options.get("glob", "*.mat"))]

    def read(self, partition: File) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        if partition is None:  # no file fits
            return
        make, more = KINDS[self.options["kind"]][0], [self.options["variable"]] if "variable" in self.options else []
        kind = to_arrow_schema(self.schema)
        fs, path = opened(partition.path)
        with fs.open_input_file(path) as f:

            def read(name: str):
                f.seek(0)
                return variable(f, name)

            held = []
            try:
                for row in make(read, *more):
                    held.append((partition.path, *row))
                    if len(held) == (4096 if self.options["kind"] == "entries" else 1):
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held, strict=True), kind.types, strict=True)], schema=kind)
                        held = []
            except ValueError as e:
                raise ValueError(f"{partition.path}: {e}") from None
        if held:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held, strict=True), kind.types, strict=True)], schema=kind)


class MatrixSource(DataSource):
    """Options: path, glob, kind (see `KINDS`), variable (of kinds rows and entries)."""

    @classmethod
    def name(cls) -> str:
        return "mat_level5"

    def schema(self) -> str:
        return "path string, " + KINDS[self.options["kind"]][1]

    def reader(self, schema) -> MatrixReader:
        return MatrixReader(self.options, schema)


def matrix_files(spark: SparkSession, path: str, kind: str, **options) -> DataFrame:
    """path and the columns of that kind, of every file under `path`."""
    spark.dataSource.register(MatrixSource)
    return spark.read.format("mat_level5").options(path=path, kind=kind, **options).load()


def eeg_signals(spark: SparkSession, path: str, runs: DataFrame, glob: str = "*.set") -> DataFrame:
    """pair, phase, ch, samples of the runs' EEG files, as `couple` takes them; runs: pair, phase, path. A channel is a row."""
    parts = matrix_files(spark, path, "eeg", glob=glob).join(runs.select("pair", "phase", "path"), "path")
    whole = F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("chunk", "samples"))), lambda x: x["samples"]))
    return parts.groupBy("pair", "phase", F.col("label").alias("ch")).agg(whole.alias("samples"))


def trial_blocks(spark: SparkSession, path: str, glob: str = "erp_timecourses_sensor.mat") -> tuple[DataFrame, DataFrame]:
    """Blocks (path, start, values) and heads (path, dims, labels, times) of all files of trials, as `projection.trial_tensors` takes them."""
    rows = matrix_files(spark, path, "trials", glob=glob)
    return rows.select("path", "start", "values"), rows.where("start = 0").select("path", "dims", "labels", "times")
