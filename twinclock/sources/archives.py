"""Raw archives (tar of a channel description and interleaved 16-bit samples) as a data source that reads and writes by range.

Reading: the tar headers say where the samples lie, so a file of any length is split into ranges of frames without being
unpacked; a task holds one chunk of frames at a time. Filters on otb, ch and chunk reach the reader where the session allows it
(`spark.sql.python.filterPushdown.enabled`): other files, channels and ranges are not read.

Writing: an archive is written by one task as its frames come, under a hidden folder; the driver moves all files into place when all
tasks are done, and removes the folder if one fails. Paths are those that Arrow's file systems know.
"""

from __future__ import annotations

import posixpath
import re
import tarfile
import uuid
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor
from contextlib import suppress
from dataclasses import dataclass
from fnmatch import fnmatch

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual, WriterCommitMessage

from .recordings import CHUNK, channel_table

READ_SCHEMA = "otb string, ch int, label string, adapter string, fs double, chunk int, samples array<double>"
WRITE_COLUMNS = ("source", "name", "total", "seq", "frames")


def opened(path: str) -> tuple[pafs.FileSystem, str]:
    """The file system of a path and the path within it."""
    if re.match("^file:/(?!/)", path):
        path = path[5:]
    return pafs.FileSystem.from_uri(path) if re.match(r"^[a-z0-9+.-]+://", path) else (pafs.LocalFileSystem(), path)


def listed(root: str, glob: str) -> list[str]:
    """Files under a folder (or the file itself) whose name fits, in the form that Spark's readers give."""
    fs, own = opened(root)
    scheme = re.match(r"^([a-z0-9+.-]+://[^/]*)", root) if "://" in root and not root.startswith("file:") else None
    info = fs.get_file_info(own)
    files = [info] if info.is_file else fs.get_file_info(pafs.FileSelector(own, recursive=True))
    paths = sorted(f.path for f in files if f.is_file and fnmatch(posixpath.basename(f.path), glob))
    if scheme is None:
        return ["file:" + p for p in paths]
    inside = lambda p: p if p.startswith("/") else "/" + p.split("/", 1)[1]  # noqa: E731  object stores put the bucket first
    return [scheme.group(1) + inside(p) for p in paths]


@dataclass
class Layout:
    """Where an archive's samples lie, and what they are."""

    path: str
    fs: float
    n: int
    channels: list[tuple[int, str, str, str]]
    offset: int
    frames: int
    members: list[tuple[str, int, int]]  # name, place and size of all files
    sig: str

    def wanted(self, which: str) -> list[int]:
        by_index = {i: (p, c, a) for i, p, c, a in self.channels if i < self.n}
        if which == "aux":
            return [i for i, (p, c, _) in sorted(by_index.items()) if "AUX" in p and "Trigger" in c]
        if which == "bipolar":
            return [i for i, (_, _, a) in sorted(by_index.items()) if re.search("bipolar|ad8x2", a, re.I)][:10] or [*range(min(10, self.n))]
        return [*range(self.n)]

    def label(self, i: int) -> tuple[str, str]:
        for k, p, c, a in self.channels:
            if k == i:
                return f"{p} {c}".strip(), a
        return "", ""


def layout(path: str) -> Layout:
    """From the tar headers and the description alone; a last partial frame is left out, as are samples beyond the file's end."""
    fs, own = opened(path)
    with fs.open_input_file(own) as f, tarfile.open(fileobj=f, mode="r:") as tar:
        with suppress(tarfile.ReadError):  # the file breaks off; the members before are known
            tar.getmembers()
        members = sorted((m.name, m.offset_data, m.size) for m in tar.members if m.isfile())
        found = None
        for name, place, size in sorted((m for m in members if m[0].endswith(".xml")), key=lambda m: (not m[0].endswith("_08.xml"), m[0])):
            f.seek(place)
            try:
                found = channel_table(f.read(size))
                break
            except (SyntaxError, TypeError, ValueError):  # no description
                continue
        samples = next((m for m in members if m[0].endswith(".sig")), None)
        if found is None or samples is None:
            raise ValueError(f"{path}: no {'samples' if found else 'description of the channels'}")
        f.seek(0, 2)
        size = min(samples[2], f.tell() - samples[1])
    rate, n, channels = found
    return Layout(path, rate, n, channels, samples[1], max(0, size) // (2 * n), members, samples[0])


class Range(InputPartition):
    def __init__(self, where: Layout, first: int, last: int, channels: list[int]):
        self.where, self.first, self.last, self.channels = where, first, last, channels


class ArchiveReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.path = options["path"]
        self.glob = options.get("glob", "*.otb+")
        self.which = options.get("wanted", "all")
        self.chunk = int(options.get("chunk", CHUNK))
        self.bytes = int(options.get("partitionBytes", 128 << 20))
        self.files: set[str] | None = None
        self.channels: set[int] | None = None
        self.low, self.high = 0, 1 << 62

    def partitions(self) -> list[Range]:
        files = [p for p in listed(self.path, self.glob) if self.files is None or p in self.files]
        out = []
        with ThreadPoolExecutor(32) as pool:
            for own in pool.map(layout, files):
                channels = [i for i in own.wanted(self.which) if self.channels is None or i in self.channels]
                chunks = max(1, -(-own.frames // self.chunk))  # a recording without frames has one empty chunk
                step = max(1, self.bytes // (2 * own.n * self.chunk))
                first, last = max(0, self.low), min(chunks - 1, self.high)
                if channels:
                    out += [Range(own, k, min(k + step - 1, last), channels) for k in range(first, last + 1, step)]
        return out

    def read(self, partition: Range) -> Iterator[pa.RecordBatch]:
        if partition is None:  # no file fits
            return
        own = partition.where
        fs, path = opened(own.path)
        labels = [own.label(i) for i in partition.channels]
        kind = pa.schema([("otb", pa.string()), ("ch", pa.int32()), ("label", pa.string()), ("adapter", pa.string()), ("fs", pa.float64()), ("chunk", pa.int32()), ("samples", pa.list_(pa.float64()))])
        k = len(partition.channels)
        with fs.open_input_file(path) as f:
            for chunk in range(partition.first, partition.last + 1):
                at = chunk * self.chunk
                n = max(0, min(self.chunk, own.frames - at))
                f.seek(own.offset + 2 * own.n * at)
                frames = np.frombuffer(f.read(2 * own.n * n), "<i2").reshape(n, own.n)
                samples = pa.ListArray.from_arrays(pa.array(np.arange(k + 1) * n, pa.int32()), pa.array(frames[:, partition.channels].T.ravel().astype(float)))
                cols = [[own.path] * k, partition.channels, [x[0] for x in labels], [x[1] for x in labels], [own.fs] * k, [chunk] * k]
                yield pa.RecordBatch.from_arrays([*[pa.array(c, t) for c, t in zip(cols, kind.types, strict=False)], samples], schema=kind)


class FilteredReader(ArchiveReader):
    """The reader where the session hands filters on; Spark refuses one that takes them where it doesn't."""

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        for f in filters:
            column = f.attribute[0] if hasattr(f, "attribute") and len(f.attribute) == 1 else None
            values = {f.value} if isinstance(f, EqualTo) else set(f.value) if isinstance(f, In) else None
            if column == "otb" and values is not None:
                self.files = values if self.files is None else self.files & values
            elif column == "ch" and values is not None:
                self.channels = values if self.channels is None else self.channels & values
            elif column == "chunk" and isinstance(f, (EqualTo, GreaterThanOrEqual, GreaterThan, LessThanOrEqual, LessThan)):
                if not isinstance(f, (LessThan, LessThanOrEqual)):
                    self.low = max(self.low, f.value + isinstance(f, GreaterThan))
                if not isinstance(f, (GreaterThan, GreaterThanOrEqual)):
                    self.high = min(self.high, f.value - isinstance(f, LessThan))
            else:
                yield f


@dataclass
class Written(WriterCommitMessage):
    files: list[str]


def whole_numbers(x: np.ndarray) -> np.ndarray:
    """Rounded half away from zero and kept within 16 bits; missing samples are zero."""
    x = np.nan_to_num(x, nan=0.0, posinf=40000.0, neginf=-40000.0)
    return np.clip(np.trunc(x + np.copysign(0.5, x)), -32768, 32767).astype("<i2")


class ArchiveWriter(DataSourceArrowWriter):
    """Rows: source (archive whose other members are kept), name, total (frames), seq, frames (channel by sample), in order of name and seq."""

    def __init__(self, options: dict[str, str], overwrite: bool):
        self.path, self.overwrite = options["path"].rstrip("/"), overwrite
        self.hidden = f"{self.path}/_temporary-{uuid.uuid4().hex}"
        fs, own = opened(self.path)
        if not overwrite and fs.get_file_info(own).type != pafs.FileType.NotFound:
            raise ValueError(f"{self.path} exists")
        fs.create_dir(opened(self.hidden)[1], recursive=True)

    def write(self, batches: Iterator[pa.RecordBatch]) -> Written:
        files, own, seen = [], None, set()
        for batch in batches:
            for row in batch.to_pylist():
                if own is None or own.name != row["name"]:
                    if own is not None:
                        files.append(own.close())
                    if row["name"] in seen:
                        raise ValueError(f"{row['name']}: its rows don't follow each other")
                    seen.add(row["name"])
                    own = ArchiveFile(f"{self.hidden}/{uuid.uuid4().hex}", row["name"], row["source"], row["total"])
                own.add(np.array(row["frames"], float))
        if own is not None:
            files.append(own.close())
        return Written(files)

    def commit(self, messages: list[Written | None]) -> None:
        fs, own = opened(self.path)
        names = [f for m in messages if m is not None for f in m.files]
        final = [posixpath.basename(f.split("\t")[1]) for f in names]
        if len(set(final)) < len(final):
            self.abort(messages)
            raise ValueError("an archive was written by several tasks")
        for f in fs.get_file_info(pafs.FileSelector(own)) if self.overwrite else ():
            if f.is_file:
                fs.delete_file(f.path)
        for f, name in zip(names, final, strict=True):
            fs.move(opened(f.split("\t")[0])[1], f"{own}/{name}")
        fs.delete_dir(opened(self.hidden)[1])

    def abort(self, messages: list[Written | None]) -> None:
        fs, hidden = opened(self.hidden)
        if fs.get_file_info(hidden).type != pafs.FileType.NotFound:
            fs.delete_dir(hidden)
        own = opened(self.path)[1]
        if not self.overwrite and not fs.get_file_info(pafs.FileSelector(own)):
            fs.delete_dir(own)


class ArchiveFile:
    """An archive that grows frame by frame; the number of frames is known at the start, since tar puts it first."""

    def __init__(self, place: str, name: str, source: str, total: int):
        self.place, self.name, self.total, self.count = place, name, total, 0
        self.source = layout(source)
        fs, own = opened(place)
        self.out = fs.open_output_stream(own)
        fs, own = opened(source)
        with fs.open_input_file(own) as f:
            for member, at, size in self.source.members:
                if not member.endswith(".sig"):
                    self._header(member, size)
                    f.seek(at)
                    self.out.write(f.read(size))
                    self._pad(size)
        self._header(self.source.sig, 2 * self.source.n * total)

    def _header(self, member: str, size: int) -> None:
        info = tarfile.TarInfo(member)
        info.size = size
        self.out.write(info.tobuf(format=tarfile.GNU_FORMAT))

    def _pad(self, size: int) -> None:
        self.out.write(b"\0" * (-size % tarfile.BLOCKSIZE))

    def add(self, frames: np.ndarray) -> None:
        if len(frames) != self.source.n:
            raise ValueError(f"{self.name}: {len(frames)} channels, {self.source.n} in {self.source.path}")
        self.count += frames.shape[1]
        self.out.write(whole_numbers(frames).T.tobytes())

    def close(self) -> str:
        if self.count != self.total:
            raise ValueError(f"{self.name}: {self.count} frames, {self.total} were announced")
        self._pad(2 * self.source.n * self.total)
        self.out.write(b"\0" * (2 * tarfile.BLOCKSIZE))
        self.out.close()
        return f"{self.place}\t{self.name}"


class ArchiveSource(DataSource):
    """Options: path, glob, wanted (all, aux, bipolar), chunk (frames), partitionBytes."""

    @classmethod
    def name(cls) -> str:
        return "otb_archive"

    def schema(self) -> str:
        return READ_SCHEMA

    def reader(self, schema) -> ArchiveReader:
        return (FilteredReader if self.options.get("pushdown") == "true" else ArchiveReader)(self.options)

    def writer(self, schema, overwrite: bool) -> ArchiveWriter:
        return ArchiveWriter(self.options, overwrite)


def archive_ranges(spark: SparkSession, path: str, wanted: str = "all", **options) -> DataFrame:
    """otb, ch (index from 0), label, adapter, fs, chunk, samples: chunks of the wanted channels, split over tasks by range."""
    spark.dataSource.register(ArchiveSource)
    pushdown = spark.conf.get("spark.sql.python.filterPushdown.enabled")
    return spark.read.format("otb_archive").options(path=path, wanted=wanted, pushdown=pushdown, **options).load()


def movement_frames(chunks: DataFrame, segments: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """source, name, total, seq, frames: the samples of each archive's segments one after the other, overlaps twice.

    chunks: all channels, as `archive_ranges` gives them; segments: otb, segment_id, sample_start, sample_stop (from 1, both ends
    inside). Each piece is what one segment has of one chunk. Samples beyond the recording are left out; an archive without
    samples in any segment gives no rows.
    """
    first, stop = F.col("chunk").cast("long") * chunk + 1, F.col("chunk").cast("long") * chunk + F.size("samples")
    wanted = segments.select("otb", "segment_id", "sample_start", "sample_stop")
    # only the chunks that a segment reaches are joined to it
    reached = wanted.withColumn("chunk", F.explode(F.sequence(F.expr(f"(sample_start - 1) div {chunk}"), F.expr(f"(greatest(sample_stop, sample_start) - 1) div {chunk}")))).withColumn("chunk", F.col("chunk").cast("int"))
    a, b = F.greatest(first, F.col("sample_start")), F.least(stop, F.col("sample_stop"))
    met = chunks.select("otb", "ch", "chunk", "samples").join(reached, ["otb", "chunk"]).where(a <= b)
    part = F.slice("samples", (a - first + 1).cast("int"), (b - a + 1).cast("int"))
    pieces = met.groupBy("otb", "segment_id", "chunk").agg(F.array_sort(F.collect_list(F.struct("ch", part.alias("x")))).alias("x"))
    pieces = pieces.withColumns({"frames": F.transform("x", lambda x: x["x"]), "size": F.size(F.col("x")[0]["x"]).cast("long")})
    total = pieces.groupBy("otb").agg(F.sum("size").alias("total"))
    name = F.concat(F.regexp_extract("otb", r"([^/]+?)(\.[^./]*)?$", 1), F.lit("_movement_only.otb+"))
    return pieces.join(total, "otb").select(F.col("otb").alias("source"), name.alias("name"), "total", F.struct("segment_id", "chunk").alias("seq"), "frames")


def movement_report(frames: DataFrame, segments: DataFrame, rates: DataFrame) -> DataFrame:
    """otb, enabled, rule_used, n_segments, n_samples, duration_s of every archive in `rates` (otb, fs)."""
    own = frames.groupBy(F.col("source").alias("otb")).agg(F.max("total").alias("n_samples"))
    rule = segments.groupBy("otb").agg(F.first("rule_used").alias("rule_used"), F.count("*").alias("n_segments"))
    out = rates.select("otb", "fs").distinct().join(rule, "otb", "left").join(own, "otb", "left")
    n = F.coalesce("n_samples", F.lit(0))
    return out.select("otb", (n > 0).alias("enabled"), F.coalesce("rule_used", F.lit("")).alias("rule_used"), F.coalesce("n_segments", F.lit(0)).alias("n_segments"), n.alias("n_samples"), (n / F.col("fs")).alias("duration_s"))


def write_movement_archives(frames: DataFrame, path: str, overwrite: bool = False) -> None:
    """One archive a source under `path`, which must be new or is emptied; frames as `movement_frames` gives them."""
    spark = frames.sparkSession
    spark.dataSource.register(ArchiveSource)
    # archives of one name from different folders are numbered
    names = frames.select("source", "name").distinct()
    numbered = names.withColumn("k", F.row_number().over(Window.partitionBy("name").orderBy("source")))
    unique = F.when(F.col("k") == 1, F.col("name")).otherwise(F.concat(F.col("k").cast("string"), F.lit("_"), F.col("name")))
    named = frames.join(numbered.select("source", F.col("k"), unique.alias("unique")), "source")
    rows = named.select("source", F.col("unique").alias("name"), "total", "seq", "frames").repartition("source").sortWithinPartitions("source", "seq")
    rows.write.format("otb_archive").mode("overwrite" if overwrite else "append").option("path", path).save()
