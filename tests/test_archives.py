"""Archives read by range against whole reads, filters that reach the reader, and movement archives read back."""

import os
import tempfile

import numpy as np
import pytest
from pyspark.sql import functions as F
from twinclock.sources import archives, recordings


def folder():
    return tempfile.mkdtemp(prefix="spark-", dir="/tmp")


CHANNELS = [(0, "IN1", "bic", "AD8x2"), (1, "IN2", "tri", "AD8x2"), (2, "AUX 4", "Trigger", "AUX")]


def archive(path, n, seed=0, cut=0):
    frames = np.random.default_rng(seed).integers(-3000, 3000, (n, 3)).astype(float)
    content = recordings.archive_bytes(2000, CHANNELS, frames, name=os.path.basename(path).split(".")[0])
    with open(path, "wb") as f:
        f.write(content[: len(content) - cut] if cut else content)
    return frames


def samples(df):
    rows = df.orderBy("otb", "ch", "chunk").collect()
    out = {}
    for r in rows:
        out.setdefault((os.path.basename(r.otb), r.ch), []).extend(r.samples)
    return out


def test_ranges_give_what_a_whole_read_gives(spark):
    root = folder()
    os.makedirs(f"{root}/sub")
    want = {"a.otb+": archive(f"{root}/a.otb+", 1003, 1), "b.otb+": archive(f"{root}/sub/b.otb+", 64, 2), "none.otb+": archive(f"{root}/none.otb+", 0)}
    df = archives.archive_ranges(spark, root, chunk=100, partitionBytes=2 * 3 * 100 * 2)
    got = samples(df)
    assert {k: np.array(v).tolist() for k, v in got.items()} == {(n, c): x[:, c].tolist() for n, x in want.items() for c in range(3)}
    per_task = df.where("otb like '%/a.otb+'").groupBy(F.spark_partition_id().alias("p")).agg(F.countDistinct("chunk").alias("n")).collect()
    assert sorted(r.n for r in per_task) == [1, 2, 2, 2, 2, 2]  # 11 chunks, two a task
    whole = recordings.whole_archive_signals(spark, root)
    assert samples(whole) == got and {r.otb for r in whole.select("otb").distinct().collect()} == {r.otb for r in df.select("otb").distinct().collect()}
    assert [r.label for r in df.where("otb like '%/a.otb+' and chunk = 3").orderBy("ch").collect()] == ["IN1 bic", "IN2 tri", "AUX 4 Trigger"]
    assert archives.archive_ranges(spark, root, glob="*.other").count() == 0


def test_partial_frames_and_cut_files(spark):
    root = folder()
    frames = archive(f"{root}/x.otb+", 500, 3)
    where = archives.layout(f"{root}/x.otb+")
    with open(f"{root}/x.otb+", "rb") as f:
        content = f.read()
    with open(f"{root}/x.otb+", "wb") as f:
        f.write(content[: where.offset + 2 * 3 * 200 + 4])  # the copy broke off within frame 201
    got = samples(archives.archive_ranges(spark, root, chunk=64))
    assert got["x.otb+", 1] == frames[:200, 1].tolist()
    with open(f"{root}/bad.otb+", "wb") as f:
        f.write(recordings.archive_bytes(1, CHANNELS, frames).replace(b".sig", b".gis"))
    with pytest.raises(Exception, match="no samples"):
        archives.archive_ranges(spark, root).count()


def test_filters_reach_the_reader(spark):
    root = folder()
    archive(f"{root}/a.otb+", 1000, 1)
    archive(f"{root}/b.otb+", 1000, 2)
    name = "spark.sql.python.filterPushdown.enabled"
    before = spark.conf.get(name)
    spark.conf.set(name, "true")
    try:
        df = archives.archive_ranges(spark, root, chunk=100, partitionBytes=1).where(f"otb = 'file:{root}/a.otb+' and ch in (0, 2) and chunk >= 3 and chunk < 5")
        assert df.rdd.getNumPartitions() == 2
        assert sorted((r.ch, r.chunk) for r in df.collect()) == [(0, 3), (0, 4), (2, 3), (2, 4)]
    finally:
        spark.conf.set(name, before)


def segments(spark, rows):
    return spark.createDataFrame(rows, "otb string, segment_id long, sample_start long, sample_stop long, rule_used string")


def test_movement_archives_hold_the_segments(spark):
    root, out = folder(), folder() + "/out"
    os.makedirs(f"{root}/1"), os.makedirs(f"{root}/2")
    a, b = archive(f"{root}/1/a.otb+", 1000, 1), archive(f"{root}/2/a.otb+", 300, 2)
    archive(f"{root}/quiet.otb+", 50)
    first, second = f"file:{root}/1/a.otb+", f"file:{root}/2/a.otb+"
    own = segments(spark, [(first, 1, 95, 310, "beep_to_start"), (first, 2, 300, 305, "beep_to_start"), (second, 1, 290, 400, "beep_to_end_fallback")])
    chunks = archives.archive_ranges(spark, root, chunk=100).withColumn("samples", F.transform("samples", lambda x: F.when(x > 2900, x * 20.5).otherwise(x - 0.5)))
    frames = archives.movement_frames(chunks, own, chunk=100)
    archives.write_movement_archives(frames, out)
    assert sorted(os.listdir(out)) == ["2_a_movement_only.otb+", "a_movement_only.otb+"]
    kept = lambda x: np.clip(np.where(x > 2900, np.floor(x * 20.5 + 0.5), np.where(x > 0, np.floor(x), x - 1)), -32768, 32767)  # noqa: E731  halves go away from zero
    got = samples(archives.archive_ranges(spark, out))
    for name, want in (("a_movement_only.otb+", np.concatenate([a[94:310], a[299:305]])), ("2_a_movement_only.otb+", b[289:300])):
        assert [got[name, c] for c in range(3)] == [kept(want[:, c]).tolist() for c in range(3)]
    assert archives.layout(f"{out}/a_movement_only.otb+").channels == archives.layout(first).channels
    report = {os.path.basename(r.otb) + r.rule_used: (r.enabled, r.n_segments, r.n_samples, r.duration_s) for r in archives.movement_report(frames, own, chunks).collect()}
    assert report["a.otb+beep_to_start"] == (True, 2, 222, 0.111) and report["quiet.otb+"] == (False, 0, 0, 0.0)
    with pytest.raises(Exception, match="exists"):
        archives.write_movement_archives(frames, out)


def test_a_failed_task_leaves_nothing(spark):
    root, out = folder(), folder() + "/out"
    for k in range(4):
        archive(f"{root}/{k}.otb+", 200, k)
    own = segments(spark, [(f"file:{root}/{k}.otb+", 1, 1, 100, "r") for k in range(4)])
    frames = archives.movement_frames(archives.archive_ranges(spark, root), own)
    wrong = frames.withColumn("total", F.when(F.col("name").startswith("2_"), F.col("total") + 1).otherwise(F.col("total")))
    with pytest.raises(Exception, match="were announced"):
        archives.write_movement_archives(wrong, out)
    assert not os.path.exists(out)
    archives.write_movement_archives(frames, out)
    assert len(os.listdir(out)) == 4
