"""Recordings with a known clock map through files, alignment and validation; streams; the entry points."""

import os
import tempfile

import numpy as np
import pytest
from pyspark.sql import functions as F
from twinclock.operators import match
from twinclock.plans import flows
from twinclock.sources import recordings, sinks
from twinclock.streaming import edges as live


def recording(spark, a=1.00002, b=3.1, jitter=0.0, n=30, drop=0, bounce=False, seed=0):
    rng = np.random.default_rng(seed)
    key = 10 + np.cumsum(rng.uniform(4, 6, n))
    ref = {"DIN4": key, "DIN5": key + rng.uniform(0.8, 1.4, n), "DIN1": np.arange(5, key[-1] + 5, 0.1)}
    raw, events = [], []
    for code, t in ref.items():
        own = (t - b) / a + rng.uniform(-jitter, jitter, len(t))
        own = own[drop:] if code == "DIN4" else own
        own = np.sort(np.concatenate([own, own + 0.005])) if bounce and code != "DIN1" else own
        raw += [("p", "pre", code, float(x)) for x in own]
        events += [("p", "pre", 0, float(x), code) for x in t]
    runs = [("p", "pre", float(key[-1] + 20), 2000.0, 10**7)]
    make = spark.createDataFrame
    return make(raw, "pair string, phase string, aux string, t double"), make(events, "pair string, phase string, ord int, t double, code string"), make(runs, "pair string, phase string, duration_s double, fs double, n_samples long")


@pytest.mark.parametrize("case", [{}, {"jitter": 0.001, "drop": 2, "bounce": True}])
def test_known_clock_is_recovered(spark, case):
    raw, events, runs = recording(spark, **case)
    out = flows.align(raw, events, runs)
    r = out["fits"].first()
    assert r.state == "OK" and r.a == pytest.approx(1.00002, abs=2e-5) and r.b == pytest.approx(3.1, abs=2e-3) and r.mad < 0.001
    assert (r.lag_a, r.lag_b) == (-case.get("drop", 0), 0)
    assert out["trials"].count() >= 27 and out["segments"].count() == out["trials"].count()
    if not case:
        predicted = out["events"].where(F.col("code").startswith("DIN")).select("pair", "phase", "code", "t")
        got = flows.validate(predicted, events.select("pair", "phase", "code", "t"), out["fits"], match.criteria(spark))
        assert got["summary"].first().ready


def test_unstable_run_is_an_error_row(spark):
    raw, events, runs = recording(spark, a=1.05)
    out = flows.align(raw, events, runs)
    assert [r.state for r in out["fits"].collect()] == ["ERR"] and out["trials"].count() == 0


def test_files(spark):
    root = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    mff = f"{root}/sub-01/ses-pre/sub01_reach_dx.mff"
    os.makedirs(mff)
    for name, text in {"info.xml": "<f><recordTime>2024-01-01T10:00:00.000000+01:00</recordTime></f>", "epochs.xml": "<e><endTime>60000000</endTime></e>", "Events_8 DINs.xml": "<t><event><beginTime>2024-01-01T10:00:01.500000+01:00</beginTime><duration>1</duration><code>DIN4</code></event><event>\n<beginTime>2024-01-01T09:00:02.000000+00:00</beginTime><duration>1</duration><code>DIN5</code></event></t>"}.items():
        with open(f"{mff}/{name}", "w") as f:
            f.write(text)
    frames = np.array([[1, 100], [2, 0], [40000, -5]], float)
    with open(f"{root}/sub-01/ses-pre/sub01_reach_dx_emg.otb+", "wb") as f:
        f.write(recordings.archive_bytes(2000, [(0, "IN1", "bic", "AD8x2"), (1, "AUX 4", "Trigger", "AUX")], frames))
    h = recordings.recording_headers(spark, root).first()
    assert (h.duration_s, h.offset) == (60.0, "+01:00")
    assert [(round(r.t, 6), r.code) for r in recordings.recording_events(spark, root, ["DIN4", "DIN5"]).orderBy("t").collect()] == [(1.5, "DIN4"), (2.0, "DIN5")]
    got = {r.label: (r.fs, r.samples) for r in recordings.whole_channels(recordings.archive_signals(spark, root)).collect()}
    assert got == {"IN1 bic": (2000.0, [1.0, 2.0, 32767.0]), "AUX 4 Trigger": (2000.0, [100.0, 0.0, -5.0])}
    assert [r.ch for r in recordings.archive_signals(spark, root, "aux").collect()] == [1]
    assert [r.ch for r in recordings.archive_signals(spark, root, "bipolar").collect()] == [0]
    r = recordings.runs_in(spark, root).first()
    assert (r.phase, r.state, r.layout) == ("pre", "OK", "bids") and r.otb.endswith(".otb+")
    cut = recordings.read_archive(recordings.archive_bytes(1000, [], frames))
    assert cut[:2] == (1000.0, 2)


def test_sinks(spark):
    root = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    track = spark.createDataFrame([(1, 0, 0.5, "DIN4", 0, "Z"), (1, 1, 1.5, "DIN4", 0, "Z"), (1, 2, 1.0, "beep", 0, "Z")], "run int, ord int, t double, code string, start_us long, offset string")
    rows = sinks.event_track(track, ["run"]).orderBy("gidx").collect()
    assert [(r.gidx, r.cidx, r.code) for r in rows] == [(1, 1, "DIN4"), (2, 1, "beep"), (3, 2, "DIN4")] and rows[1].beginTime == "1970-01-01T00:00:01.000000Z"
    sinks.write_events_xml(sinks.event_track(track, ["run"]), f"{root}/xml")
    sinks.write_csv(sinks.event_rows(track).withColumn("note", F.lit('a;"b"')), f"{root}/csv", ";")
    back = spark.read.options(header=True, sep=";", quote='"', escape='"').csv(f"{root}/csv").orderBy("time").collect()
    assert len(back) == 3 and back[0].note == 'a;"b"' and back[0].time == "0.500000"
    sinks.write_reports(spark.createDataFrame([("p", "pre", 1.0)], "pair string, phase string, a double"), f"{root}/reports")
    with pytest.raises(Exception, match="(?i)exists"):
        sinks.write_csv(track, f"{root}/csv")


def test_streams(spark):
    root = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    for k, part in enumerate([[9.0, 9.0, 1.0], [1.0, 9.0, 1.0], [9.0, 1.0, 9.0]]):
        spark.createDataFrame([(1, float(3 * k + i), v) for i, v in enumerate(part)], "run int, t double, value double").coalesce(1).write.parquet(f"{root}/in/{k}")
    source = spark.readStream.schema("run int, t double, value double").option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(f"{root}/in")
    for name, f, want in (("low", lambda s: live.falling_edges(s, "run", "t", "value", 5.0), [2.0, 5.0, 7.0]), ("gap", lambda s: live.min_gap(s, "run", "t", 2.5), [0.0, 3.0, 6.0])):
        q = f(source).writeStream.format("memory").queryName(name).outputMode("append").trigger(availableNow=True).option("checkpointLocation", f"{root}/{name}").start()
        q.awaitTermination(120)
        assert sorted(r.t for r in spark.table(name).collect()) == want


def test_coupling_flow(spark):
    rng, fs, n = np.random.default_rng(2), 250.0, 4000
    common = np.sin(2 * np.pi * 20 * np.arange(n) / fs) + 1
    rows = lambda xs: [("p", "pre", c, [*map(float, x)]) for c, x in xs.items()]
    schema = "pair string, phase string, ch string, samples array<double>"
    eeg = spark.createDataFrame(rows({"C3": common + rng.normal(size=n), "C4": rng.normal(size=n)}), schema)
    emg = spark.createDataFrame(rows({f"m{k}": np.abs(common * (k + 1) + 0.1 * rng.normal(size=n)) for k in range(3)}), schema)
    spans = spark.createDataFrame([("p", "pre", k + 1, 1 + 1000 * k, 1000 * (k + 1)) for k in range(4)], "pair string, phase string, trial int, i1 long, i2 long")
    regions = spark.createDataFrame([("left", ["c3"]), ("right", ["C4"])], "name string, labels array<string>")
    out = flows.couple(eeg, emg, spans, regions, fs, surrogates=10)
    by = {(r.roi): r for r in out["bands"].where("trial = 1 and syn = 1").collect()}
    assert by["left"].beta_peak > by["right"].beta_peak and by["left"].beta_peak_hz == pytest.approx(20, abs=1)
    assert out["totals"].count() == 1
    table = out["table"].collect()
    assert table and all(r.cluster_id is not None and r.beta_mean_ci95_low <= r.beta_mean_ci95_high and 0 < r.zcoh_surrogate_p <= r.zcoh_surrogate_q <= 1 for r in table)
    assert {r.scope for r in out["sides"].collect()} == {"all", *[f"syn_{r.synergy:02d}" for r in table]}
    assert out["summary"].first().n_synergies == len(table)


def test_entry(spark):
    if not os.path.isdir("/root/testdata/sf0.001"):
        pytest.skip("needs the small tables")
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert entry.entry(spark).count() > 0


def test_a_code_without_matches_fails_the_residuals(spark):
    """Medians of one code alone don't pass for both."""
    raw, events, runs = recording(spark)
    out = flows.align(raw, events, runs)
    predicted = out["events"].where("code in ('DIN1', 'DIN4')").select("pair", "phase", "code", "t")
    got = flows.validate(predicted, events.select("pair", "phase", "code", "t"), out["fits"], match.criteria(spark))["summary"].first()
    assert not got.ready and got.median_ms is None and "high_residuals" in got.reason
