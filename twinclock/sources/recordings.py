"""Recordings as tables: event tracks and headers (XML), raw archives (tar of XML and int16 samples), reports, folders of runs."""

from __future__ import annotations

import io
import re
import tarfile
import xml.etree.ElementTree as ET

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.names import pair_side, pair_tokens, phase, report_place, sanitized, side_compatible, similarity, tokens
from ..functions.times import iso_micros

EVENT = r"<event>\s*<beginTime>([^<]*)</beginTime>\s*<duration>([^<]*)</duration>\s*<code>([^<]*)</code>"
CHUNK = 1 << 16  # samples of a channel in a row
AUX = {4: "DIN4", 3: "DIN5", 2: "DIN1"}


def text_files(spark: SparkSession, path: str, glob: str) -> DataFrame:
    """path and whole text of every file under `path` whose name fits."""
    files = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", glob).text(path, wholetext=True)
    return files.select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text"))


def folder(path: Column) -> Column:
    """The path without its last part."""
    return F.regexp_replace(path, "/[^/]*$", "")


def recording_headers(spark: SparkSession, path: str) -> DataFrame:
    """mff, start_us, offset, duration_s of every recording folder, from its info and epochs files."""
    info = text_files(spark, path, "info.xml").select(folder(F.col("path")).alias("mff"), F.regexp_extract("text", "<recordTime>([^<]*)</recordTime>", 1).alias("iso"))
    epochs = text_files(spark, path, "epochs.xml").select(folder(F.col("path")).alias("mff"), F.regexp_extract("text", "<endTime>([0-9]+)</endTime>", 1).cast("double").alias("end_us"))
    return info.join(epochs, "mff", "left").select("mff", iso_micros(F.col("iso")).alias("start_us"), F.regexp_extract("iso", r"(Z|[+-]\d\d:\d\d)$", 1).alias("offset"), (F.col("end_us") / 1e6).alias("duration_s"))


def recording_events(spark: SparkSession, path: str, codes: list[str] | None = None, glob: str = "Events*.xml") -> DataFrame:
    """mff, ord, t (seconds since the recording began), code of all events, or of the given codes."""
    tracks = text_files(spark, path, glob).select(folder(F.col("path")).alias("mff"), "text")
    all_ = F.arrays_zip(F.regexp_extract_all("text", F.lit(EVENT), F.lit(1)).alias("begin"), F.regexp_extract_all("text", F.lit(EVENT), F.lit(3)).alias("code"))
    rows = tracks.select("mff", F.posexplode(all_).alias("ord", "e")).select("mff", "ord", iso_micros(F.col("e.begin")).alias("us"), F.trim(F.col("e.code")).alias("code"))
    rows = rows.where(F.col("code").isin(codes)) if codes else rows
    return rows.join(recording_headers(spark, path).select("mff", "start_us"), "mff").select("mff", "ord", ((F.col("us") - F.col("start_us")) / 1e6).alias("t"), "code")


def channel_table(xml: bytes) -> tuple[float, int, list[tuple[int, str, str, str]]]:
    """Rate, number of channels and (index from 0, prefix, id, adapter) of a device description."""
    root = ET.fromstring(xml)
    rows = []
    for adapter in root.iter("Adapter"):
        first = int(adapter.get("ChannelStartIndex", "0"))
        for channel in adapter.iter("Channel"):
            rows.append((first + int(channel.get("Index", "0")), channel.get("Prefix", ""), channel.get("ID", ""), f"{adapter.get('ID', '')} {adapter.get('Description', '')}".strip()))
    return float(root.get("SampleFrequency")), int(root.get("DeviceTotalChannels")), rows


def read_archive(content: bytes):
    """(rate, number of channels, channels, samples by frame) of an archive; a last partial frame is dropped."""
    with tarfile.open(fileobj=io.BytesIO(content)) as tar:
        names = sorted(m.name for m in tar.getmembers() if m.isfile())
        found = None
        for name in sorted((n for n in names if n.endswith(".xml")), key=lambda n: (not n.endswith("_08.xml"), n)):
            try:
                found = channel_table(tar.extractfile(name).read())
                break
            except (ET.ParseError, TypeError, ValueError):
                continue
        if found is None:
            raise ValueError("no description of the channels")
        raw = tar.extractfile(next(n for n in names if n.endswith(".sig"))).read()
    rate, n, channels = found
    frames = len(raw) // (2 * n)
    return rate, n, channels, np.frombuffer(raw, "<i2", frames * n).reshape(frames, n)


def archive_signals(spark: SparkSession, path: str, wanted: str = "all", glob: str = "*.otb+") -> DataFrame:
    """otb, ch (index from 0), label, adapter, fs, chunk, samples: chunks of every channel of every archive under `path`.

    wanted: `all`, `aux` (trigger inputs) or `bipolar` (the first ten of bipolar adapters, else the first ten channels). Only
    the wanted channels leave the reader; archives of any size are split over tasks by ranges of frames.
    """
    from .archives import archive_ranges

    return archive_ranges(spark, path, wanted, glob=glob)


def whole_archive_signals(spark: SparkSession, path: str, wanted: str = "all", glob: str = "*.otb+") -> DataFrame:
    """otb, ch (index from 0), label, adapter, fs, chunk, samples: chunks of every channel of every archive under `path`.

    Each archive is one row of Spark's own binary reader, so it must be below its limit of 2 GB: for stores that only Spark can open.
    wanted: `all`, `aux` (trigger inputs) or `bipolar` (the first ten of bipolar adapters, else the first ten channels). Only
    the wanted channels leave the reader.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", glob).load(path).select("path", "content")

    def run(batches):
        for part in batches:
            for name, content in zip(part["path"], part["content"], strict=True):
                fs, n, channels, frames = read_archive(content)
                by_index = {i: (p, c, a) for i, p, c, a in channels if i < n}
                if wanted == "aux":
                    own = [i for i, (p, c, _) in sorted(by_index.items()) if "AUX" in p and "Trigger" in c]
                elif wanted == "bipolar":
                    own = [i for i, (_, _, a) in sorted(by_index.items()) if re.search("bipolar|ad8x2", a, re.I)][:10] or [*range(min(10, n))]
                else:
                    own = [*range(n)]
                for i in own:
                    p, c, a = by_index.get(i, ("", "", ""))
                    for k in range(0, max(1, len(frames)), CHUNK):
                        yield pd.DataFrame([{"otb": name, "ch": i, "label": f"{p} {c}".strip(), "adapter": a, "fs": fs, "chunk": k // CHUNK, "samples": frames[k : k + CHUNK, i].astype(float)}])

    return files.mapInPandas(run, "otb string, ch int, label string, adapter string, fs double, chunk int, samples array<double>")


def whole_channels(chunks: DataFrame) -> DataFrame:
    """otb, ch, label, fs, samples: the chunks of a channel in order."""
    samples = F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("chunk", "samples"))), lambda x: x["samples"]))
    return chunks.groupBy("otb", "ch", "label", "fs").agg(samples.alias("samples"))


def archive_bytes(rate: float, channels: list[tuple[int, str, str, str]], frames: np.ndarray, name: str = "recording") -> bytes:
    """An archive of a description and samples, which are rounded and kept within 16 bits."""
    root = ET.Element("Device", SampleFrequency=f"{rate:g}", DeviceTotalChannels=str(frames.shape[1]))
    for index, prefix, id_, adapter in channels:
        own = ET.SubElement(root, "Adapter", ChannelStartIndex=str(index), ID=adapter, Description="")
        ET.SubElement(own, "Channel", Index="0", Prefix=prefix, ID=id_)
    samples = np.clip(np.floor(np.abs(frames) + 0.5) * np.sign(frames), -32768, 32767).astype("<i2")
    out = io.BytesIO()
    with tarfile.open(fileobj=out, mode="w") as tar:
        for member, content in ((f"{name}_08.xml", ET.tostring(root)), (f"{name}.sig", samples.tobytes())):
            header = tarfile.TarInfo(member)
            header.size = len(content)
            tar.addfile(header, io.BytesIO(content))
    return out.getvalue()


def match_files(mff: DataFrame, otb: DataFrame, session: str = "session") -> DataFrame:
    """session, mff, otb, state, msg: one-to-one by name within a session; what finds no partner is a SKIP row.

    In order of the mff names, each takes the unused otb with the highest score of at least one. A session's few
    files meet in one group.
    """

    def run(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        left, right = a.sort_values("path"), b.sort_values("path")
        name = (a if len(a) else b)[session].iloc[0]
        used, rows = set(), []
        for path, own in zip(left["path"], left["words"], strict=True):
            best = (0, None)
            for other, words in zip(right["path"], right["words"], strict=True):
                score = _score(set(own), set(words))
                if other not in used and score > best[0]:
                    best = (score, other)
            used.add(best[1])
            rows.append((name, path, best[1], "OK" if best[1] else "SKIP", "" if best[1] else "no EMG file fits"))
        rows += [(name, None, p, "SKIP", "no EEG folder fits") for p in right["path"] if p not in used]
        return pd.DataFrame(rows, columns=[session, "mff", "otb", "state", "msg"])

    cols = [F.col(session), F.col("path"), tokens(F.col("path")).alias("words")]
    a, b = mff.select(*cols), otb.select(*cols)
    kind = a.schema[session].dataType.simpleString()
    return a.groupBy(session).cogroup(b.groupBy(session)).applyInPandas(run, f"{session} {kind}, mff string, otb string, state string, msg string")


def _score(a: set[str], b: set[str]) -> int:
    if not a or not b:
        return 0
    sides = [next((s for s in ("dx", "sx") if s in w), "") for w in (a, b)]
    return len(a & b) + (0 if "" in sides else 2 if sides[0] == sides[1] else -2)


def runs_in(spark: SparkSession, root: str) -> DataFrame:
    """pair, phase, mff, otb, state, msg, layout of all runs under `root`, in folders by subject and session or by pair and phase."""
    heads = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", "info.xml").format("binaryFile").load(root).select(folder(F.col("path")).alias("path"))
    archives = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", "*.otb+").format("binaryFile").load(root).select("path")
    place = lambda df: df.withColumns({"subject": F.regexp_extract("path", r"/(sub-[^/]+)/", 1), "ses": F.regexp_extract("path", r"/(ses-[^/]+)/", 1), "old": F.regexp_extract("path", r"/([^/]+)/(pre|post)/(?:eeg|emg)/", 1), "old_phase": F.regexp_extract("path", r"/([^/]+)/(pre|post)/(?:eeg|emg)/", 2)})
    session = F.when(F.col("old") != "", F.concat_ws("/", "old", "old_phase")).otherwise(F.concat_ws("/", F.nullif("subject", F.lit("")), F.nullif("ses", F.lit(""))))
    matched = match_files(place(heads).withColumn("session", session), place(archives).withColumn("session", session))
    by_side = Window.partitionBy("session")
    pair = F.when(F.count("*").over(by_side) > 1, F.concat_ws("_", "session", sanitized(F.regexp_extract(F.coalesce("mff", "otb"), r"([^/]+?)(\.[^./]*)?$", 1)))).otherwise(F.col("session"))
    return matched.select(pair.alias("pair"), phase(F.col("session")).alias("phase"), "mff", "otb", "state", "msg", F.when(F.col("session").rlike("^(sub-|ses-)"), "bids").otherwise("legacy").alias("layout"))


def reports(spark: SparkSession, root: str) -> DataFrame:
    """The run reports (JSON, one document a file) under `root`, with pair and phase from their place where they don't say so."""
    df = spark.read.option("multiLine", True).option("recursiveFileLookup", True).option("pathGlobFilter", "report.json").json(root)
    pair, phase_ = report_place(F.col("_metadata.file_path"))
    have = set(df.columns)
    return df.withColumns({"pair": F.coalesce("pair", pair) if "pair" in have else pair, "phase": F.coalesce("phase", phase_) if "phase" in have else phase_, "report_path": F.col("_metadata.file_path")})


def best_source(runs: DataFrame, files: DataFrame, least: int = 2) -> DataFrame:
    """runs (pair, given, local) with source and how it was found: given, beside the report, or by the most common words.

    Only files that share a word with the pair's name are scored.
    """
    words = runs.select("pair", F.explode(tokens(F.col("pair"))).alias("w"))
    listed = files.select("path", F.explode(tokens(F.col("path"))).alias("w"))
    pairs = words.join(listed, "w").select("pair", "path").distinct()
    score = similarity(tokens(F.col("pair")), tokens(F.col("path")))
    best = pairs.withColumn("score", score).where(F.col("score") >= least).groupBy("pair").agg(F.min_by("path", F.struct(-F.col("score"), F.col("path"))).alias("scored"))
    out = runs.join(best, "pair", "left")
    how = F.when(F.col("given").isNotNull(), "given").when(F.col("local").isNotNull(), "local").when(F.col("scored").isNotNull(), "scored").otherwise("none")
    return out.select(*runs.columns, F.coalesce("given", "local", "scored").alias("source"), how.alias("status"))


def source_of_runs(runs: DataFrame, files: DataFrame, least: int = 2) -> DataFrame:
    """runs (pair, phase, given, local) with source and status: from_report, local_match, indexed_match_n, indexed_not_matched or not_found.

    files: path and ord of the source files that an index of folders found. Where neither the report names a file nor one lies beside it,
    the file on the right side with the most words of the pair's name wins, at least `least` (one or more), the first of equal ones.
    Equal names are asked for once, and meet the files that hold a word of theirs.
    """
    names = runs.where("given is null and local is null").select("pair", "phase").distinct()
    worded = names.select("pair", "phase", pair_side(F.col("pair")).alias("side"), F.explode(pair_tokens(F.col("pair"), F.col("phase"))).alias("w"))
    held = worded.select("w").distinct().join(files.select("ord", "path").distinct(), F.contains(F.lower("path"), F.col("w")))
    scored = worded.join(held, "w").where(side_compatible(F.col("side"), F.col("path"))).groupBy("pair", "phase", "ord", "path").agg(F.count("*").alias("score")).where(F.col("score") >= least)
    best = scored.groupBy(F.col("pair").alias("pair_"), F.col("phase").alias("phase_")).agg(F.max("score").alias("score_"), F.max_by("path", F.struct("score", -F.col("ord"), "path")).alias("path_"))
    empty = files.limit(1).agg((F.count("*") == 0).alias("empty_"))  # one row
    out = runs.join(best, F.col("pair").eqNullSafe(F.col("pair_")) & F.col("phase").eqNullSafe(F.col("phase_")), "left").join(F.broadcast(empty))
    found = F.col("path_").isNotNull()
    source = F.coalesce("given", "local", "path_")
    status = F.when(F.col("given").isNotNull(), "from_report").when(F.col("local").isNotNull(), "local_match").when(F.col("empty_"), "not_found")
    return out.select(*runs.columns, source.alias("source"), F.coalesce(status, F.when(found, F.concat(F.lit("indexed_match_"), F.col("score_").cast("string"))), F.lit("indexed_not_matched")).alias("status"))
