"""Hand-computed cases of the clock and trial operators."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F
from twinclock.functions import names as N
from twinclock.functions import numbers as X
from twinclock.functions import times as T
from twinclock.operators import coupling, edges, fit, match, reports, signals, synergies, trials


def frame(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


def samples(spark, xs):
    return frame(spark, [(1, i, float(x)) for i, x in enumerate(xs)], "run int, o int, v double")


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


@pytest.mark.parametrize("xs,fs,want", [([10, 10, 10, 0, 0, 10, 0, 10], 4, [0.75, 1.5]), ([0, 0, 10, 10, 10], 1, [0.0])])
def test_falling_edges(spark, xs, fs, want):
    got = edges.falling_edges(samples(spark, xs), ["run"], ["o"], "v").orderBy("i").collect()
    assert [(r.i - 1) / fs for r in got] == want


def test_min_gap_counts_from_the_last_kept(spark):
    df = frame(spark, [(1, t) for t in (0.3, 0.0, 0.05, 0.1, 0.15)], "run int, t double")
    assert sorted(r.t for r in edges.min_gap(df, ["run"], "t", 0.12).collect()) == [0.0, 0.15, 0.3]


def test_clean_edges_widens_the_gap(spark):
    times = [k + d for k in range(20) for d in (0.0, 0.15)]
    want = frame(spark, [(1, 20, 0.12)], "run int, expected int, gap double")
    got = edges.clean_edges(frame(spark, [(1, t) for t in times], "run int, t double"), want, ["run"]).collect()
    assert len(got) == 20 and got[0].n_raw == 40 and got[0].min_gap_s == pytest.approx(0.18)


def test_plausible_counts(spark):
    got = [one(spark, edges.plausible_count(F.lit(n), F.lit(20))) for n in (11, 12, 36, 37)]
    assert got == [False, True, True, False]
    assert one(spark, edges.plausible_count(F.lit(0), F.lit(0)))


@pytest.mark.parametrize("lag,x,y,want", [(1, [0, 1, 2, 3], [11, 12, 13], [(1, 11), (2, 12), (3, 13)]), (-1, [1, 2, 3], [10, 11, 12], [(1, 11), (2, 12)])])
def test_pairs_at_a_lag(spark, lag, x, y, want):
    a = frame(spark, [(1, k + 1, float(v)) for k, v in enumerate(x)], "run int, k int, x double")
    b = frame(spark, [(1, k + 1, float(v)) for k, v in enumerate(y)], "run int, k int, y double")
    assert sorted((r.x, r.y) for r in fit.ordinal_pairs(a, b, ["run"], [lag]).collect()) == want


def test_fit_and_guardrail(spark):
    df = frame(spark, [(1, float(x), 1.0001 * x + 0.5) for x in range(1, 5)], "run int, x double, y double")
    r = fit.linear(df, ["run"]).withColumns({"ppm": fit.drift_ppm(F.col("a")), "ok": fit.stable(F.col("a"), F.col("mad"))}).first()
    assert (r.a, r.b, r.mad, r.ppm) == pytest.approx((1.0001, 0.5, 0.0, 100.0), abs=1e-6) and r.ok
    assert not one(spark, fit.stable(F.lit(1.05), F.lit(0.0))) and not one(spark, fit.stable(F.lit(None).cast("double"), F.lit(0.0)))


def stream(spark, ts):
    return frame(spark, [(1, k + 1, float(t)) for k, t in enumerate(ts)], "run int, k int, t double")


def test_valid_trials(spark):
    pairs = trials.paired(stream(spark, [1, 3, 5, 7]), stream(spark, [1.5, 3.04, 7.2, 7.5]), ["run"])
    assert sorted(r.k for r in trials.valid(pairs).collect()) == [1, 4]
    assert sorted(r.k for r in trials.valid(pairs, 0.0).collect()) == [1, 2, 4]


def test_reconstructed_offsets_and_clamp(spark):
    made = lambda k, b: trials.reconstructed(trials.paired(stream(spark, k), stream(spark, b), ["run"]), ["run"], F.lit(100.0)).first()
    r = made([10], [11])
    assert (r.t_start, r.t_keyboard, r.t_beep, r.t_end) == pytest.approx((7.8, 10, 11, 11.64))
    assert made([1], [2]).t_start == 0.0


def test_segments(spark):
    t = frame(spark, [(1, 1, 0.0, 1.0, 1.5, 2.14)], "run int, trial int, t_start double, t_keyboard double, t_beep double, t_end double")
    w = trials.movement_windows(t, ["run"]).withColumns({"a": F.lit(1.0), "b": F.lit(0.0)})
    r = trials.segments(w, ["run"], 100.0, F.lit(10_000)).first()
    assert (r.rule_used, r.sample_start, r.sample_stop, r.n_samples, r.duration_s) == ("beep_to_end_fallback", 151, 214, 64, 0.64)


def test_as_of_trials(spark):
    w = trials.first_before_next(stream(spark, [1, 5, 9]), stream(spark, [0.5, 3, 3.5, 9.2]), ["run"], ["t"])
    got = trials.event_trials(w, ["run"], 100.0, F.lit(5000)).collect()
    assert [(r.i1, r.i2) for r in got] == [(101, 300)]


def test_fixed_epochs(spark):
    got = trials.fixed_epochs(stream(spark, [0.1, 1.0, 10.0, 28.1]), ["run"], 1000.0, F.lit(30000)).collect()
    assert sorted((r.t, r.i1, r.i2) for r in got) == [(1.0, 801, 3001), (10.0, 9802, 12001)]  # 1 - 0.199 falls just short of 0.801


def test_trials_stay_within_the_recording(spark):
    w = frame(spark, [(1, -0.5, 0.8), (2, 9.0, 30.0), (3, 1.0, 1.2)], "run int, t double, t_start double")
    got = sorted((r.run, r.i1, r.i2) for r in trials.event_trials(w, ["run"], 100.0, F.lit(1000)).collect())
    assert got == [(1, 1, 80), (2, 901, 1000)]
    spans = w.select("run", F.col("t").alias("t_from"), F.col("t_start").alias("t_to"))
    assert sorted((r.run, r.i1, r.i2) for r in trials.seconds_to_trials(spans, ["run"], 100.0, F.lit(1000)).collect()) == got


def test_edges_without_expected_events_stay(spark):
    want = frame(spark, [(1, 2, 0.12)], "run int, expected int, gap double")
    got = edges.clean_edges(frame(spark, [(1, 0.0), (2, 0.0), (2, 0.05), (2, 1.0)], "run int, t double"), want, ["run"]).collect()
    assert sorted((r.run, r.t, r.ratio) for r in got) == [(1, 0.0, 0.5), (2, 0.0, None), (2, 1.0, None)]


def test_sources_of_runs(spark):
    from twinclock.sources import recordings

    files = frame(spark, [(0, "/a/sub01_reach_sx/sources.mat"), (1, "/a/sub01_reach_dx/sources.mat"), (2, "/a/sub02/sources.mat")], "ord int, path string")
    runs = frame(spark, [("sub01_reach_dx", "pre", "x.mat", None), ("sub01_reach_dx", "post", None, "y.mat"), ("sub01_reach_dx", "pre", None, None), ("other", "pre", None, None)], "pair string, phase string, given string, local string")
    got = [(r.source, r.status) for r in recordings.source_of_runs(runs, files).collect()]
    assert got == [("x.mat", "from_report"), ("y.mat", "local_match"), ("/a/sub01_reach_dx/sources.mat", "indexed_match_3"), (None, "indexed_not_matched")]
    assert {r.status for r in recordings.source_of_runs(runs.where("given is null and local is null"), files.limit(0)).collect()} == {"not_found"}


def test_sources_of_equal_names_are_sought_once(spark):
    from twinclock.sources import recordings

    files = frame(spark, [(0, "/a/SUB1_reach_left.mat"), (1, "/a/sub1_reach_right.mat"), (2, "/b/sub1_reach_dx.mat"), (2, "/b/sub1_reach_dx.mat")], "ord int, path string")
    runs = frame(spark, [(k, ("sub1_reach_dx", "sub1_reach_sx", "sub1_reach", None)[k % 4], None if k % 8 < 4 else "", None, None) for k in range(16)], "k int, pair string, phase string, given string, local string")
    out = recordings.source_of_runs(runs, files)
    want = [("/b/sub1_reach_dx.mat", "indexed_match_3"), ("/a/SUB1_reach_left.mat", "indexed_match_2"), ("/a/SUB1_reach_left.mat", "indexed_match_2"), (None, "indexed_not_matched")]
    assert [(r.source, r.status) for r in sorted(out.collect(), key=lambda r: r.k)] == want * 4
    assert "collect_list" not in out._jdf.queryExecution().optimizedPlan().toString()  # the files are no array that each run goes through


def test_matching_metrics_and_blockers(spark):
    rows = lambda ts: frame(spark, [(1, "DIN4", t) for t in ts], "run int, code string, t double")
    keys = ["run", "code"]
    pairs = match.matched(rows([1.005, 2.0, 3.5, 3.515]), rows([1.0, 2.03, 3.505]), keys, 0.02)
    got = sorted(((r.t_ref, round(r.res_ms, 6)) for r in pairs.collect() if r.res_ms is not None))
    assert got == [(1.0, 5.0), (3.505, -5.0)]
    m = match.metrics(pairs, keys).first()
    assert (m.recall, m.precision, m.n_match) == pytest.approx((2 / 3, 0.5, 2))
    b = sorted((r.issue, r.t, r.severity) for r in match.blockers(pairs, keys, "code", F.lit(20.0)).collect())
    assert b == [("extra", 2.0, "MED"), ("extra", 3.515, "MED"), ("missing", 2.03, "HIGH")]


def test_missing_recall_is_not_ready(spark):
    row = [(1, 30, 30, None, 0.99, 1.0, 2.0, 0.5, 0, 10.0), (2, 30, 30, 0.99, 0.99, 1.0, 2.0, 0.5, 0, 9000.0)]
    runs = frame(spark, row, "run int, n_din4 int, n_din5 int, recall_din4 double, recall_din5 double, median_ms double, p95_ms double, mad_ms double, n_high int, drift_ppm double")
    got = {r.run: (r.ready, r.reason, r.drift_warning) for r in match.readiness(runs, match.criteria(spark)).collect()}
    assert got == {1: (False, "low_recall", False), 2: (True, "alignment_good_for_csc_high_drift_corrected", True)}
    one_ = match.readiness(runs, match.criteria(spark)).where("run = 1").first()
    assert (one_.excess_ms, one_.threshold_ms, one_.margin_ms) == (0.0, 8.0, 6.0)
    checks = {r.check: (r.threshold, r.value, r["pass"]) for r in match.check_rows(runs.where("run = 1"), match.criteria(spark), ["run"]).collect()}
    assert checks["recall_din4"] == (">= 0.98", "NaN", "FALSE") and checks["mad_ms"] == ("<= 1.0", "0.500000", "TRUE") and checks["drift_ppm"][0] == "warning if > 2000"


def test_numbers(spark):
    array = F.array(*[F.lit(float(v)) for v in (1, 2, 3, 4)])
    assert one(spark, X.percentile_mid(array, 0.95)) == 4.0
    assert one(spark, X.percentile_mid(array, 0.5)) == 2.5
    assert one(spark, X.upper_median(array)) == 3.0
    assert one(spark, X.fisher_z(F.lit(0.25))) == pytest.approx(0.549306, abs=1e-6)
    assert one(spark, coupling.confidence_level(F.lit(21))) == pytest.approx(0.139108, abs=1e-6)
    assert [one(spark, X.duration_class(F.lit(v))) for v in (0.74, 0.75, 1.25, 1.26)] == ["short", "mid", "mid", "long"]
    assert [one(spark, X.third(F.lit(i), F.lit(10))) for i in range(1, 11)] == [1] * 3 + [2] * 3 + [3] * 4
    assert one(spark, X.finite(F.lit(float("nan")))) is None and one(spark, X.finite(F.lit(float("inf")))) is None
    assert (one(spark, X.fixed(F.lit(None).cast("double"), 2)), one(spark, X.fixed(F.lit(1.5), 3))) == ("NaN", "1.500")
    assert abs(frame(spark, [(3.0,), (-3.0,)], "a double").agg(X.circular_mean(F.col("a"))).first()[0]) == pytest.approx(math.pi)
    assert frame(spark, [(float(v),) for v in (1, 2, 3, 4)], "a double").agg(X.percentile_n1(F.col("a"), 0.95)).first()[0] == pytest.approx(3.85)
    assert one(spark, trials.resampled(F.array(F.lit(1.0), F.lit(3.0)), F.lit(3))) == [1.0, 2.0, 3.0]


def test_false_discovery(spark):
    df = frame(spark, [(1, 1, 0.01), (1, 2, 0.04), (1, 3, 0.03), (1, 4, 0.005), (1, 5, None)], "run int, s int, p double")
    got = {r.s: r.q for r in reports.false_discovery(df, ["run"], "p").collect()}
    assert [got[k] for k in (1, 2, 3, 4)] == pytest.approx([0.02, 0.04, 0.04, 0.02]) and got[5] is None


def test_names(spark):
    assert one(spark, N.tokens(F.lit("x/Sub01_reachDX_bic.otb+"))) == ["bicipite", "reach"]
    assert one(spark, N.prepost_key(F.lit("sub01_sespre_dx"))) == "sub01_ses_dx"
    assert one(spark, N.is_movement(F.lit("sub01 reach"))) and not one(spark, N.is_movement(F.lit("reach rest")))
    assert [one(spark, N.phase(F.lit(s))) for s in ("ses-pre", "a/post/eeg", "ses-03", "expression")] == ["pre", "post", "03", "session"]
    assert one(spark, N.side_of_name(F.lit("single"))) == "" and one(spark, N.side_of_name(F.lit("sub1_sin_x"))) == "sx"


def test_iso_times(spark):
    us = one(spark, T.iso_micros(F.lit("2024-02-29T23:59:59.999999+01:30")))
    assert us == 1709245799999999
    assert one(spark, T.iso_text(F.lit(us), F.lit("+01:30"))) == "2024-02-29T23:59:59.999999+01:30"
    assert one(spark, T.iso_text(F.lit(us + 1), F.lit("-02:00"))) == "2024-02-29T20:30:00.000000-02:00"
    assert one(spark, T.iso_micros(F.lit("yesterday"))) is None


def test_filters_pass_and_stop():
    fs, t = 1000.0, np.arange(4000) / 1000.0
    level = lambda f, s: np.std(signals.zero_phase(np.sin(2 * np.pi * f * t), s)[1000:3000]) * np.sqrt(2)
    band, stop, low = signals.butterworth(4, (20, 450), fs, "band"), signals.butterworth(2, (49, 51), fs, "stop"), signals.butterworth(4, (10,), fs, "low")
    assert level(100, band) == pytest.approx(1, abs=0.01) and level(2, band) < 0.01
    assert level(50, stop) < 0.1 and level(80, stop) == pytest.approx(1, abs=0.01)
    assert level(1, low) == pytest.approx(1, abs=0.01) and level(100, low) < 0.01
    assert level(10, low) == pytest.approx(0.5, abs=0.01)
    assert signals.zero_phase(np.full(200, 3.0), low) == pytest.approx(3.0)


def test_coherence_of_a_shared_rhythm(spark):
    rng, fs, n = np.random.default_rng(0), 250.0, 5000
    common = np.sin(2 * np.pi * 20 * np.arange(n) / fs)
    e, h = common + rng.normal(size=n), common + rng.normal(size=n)
    df = frame(spark, [(1, [*map(float, e)], [*map(float, h)]), (2, [*map(float, e)], [*map(float, e)]), (3, [1.0] * 20, [1.0] * 20)], "run int, e array<double>, h array<double>")
    curves = signals.coherence(df, ["run"], fs)
    got = {r.run: r for r in coupling.band_metrics(signals.curve_points(curves, ["run"]), ["run"]).collect()}
    assert set(got) == {1, 2}
    assert got[1].beta_peak_hz == pytest.approx(20, abs=1) and 0 <= got[1].beta_mean <= 1
    assert got[2].beta_mean == pytest.approx(1)
    stats = coupling.trial_statistics(df.where("run = 1").withColumn("f", F.lit(1)), ["f", "run"], fs, 20, 8.0)
    test = coupling.surrogate_test(stats, ["f", "run"], ["f"]).first()
    assert test.p < 0.5 and test.q >= test.p


def test_synergies(spark):
    rng = np.random.default_rng(1)
    w, h = rng.random((5, 2)), rng.random((2, 300))
    got = synergies.extract(w @ h, 0)
    assert got["vaf"] >= 0.9 and got["vaf"] <= 1 and got["w"].shape[1] <= 3 and 0 < got["stability"] <= 1 + 1e-9


def test_nearest_and_mirror(spark):
    p = frame(spark, [(k, float(k), 0.0, 0.0) for k in range(10)], "point int, x double, y double, z double")
    t = frame(spark, [("a", 3.2, 0.0, 0.0)], "name string, x double, y double, z double")
    assert [r.point for r in signals.nearest(p, t, 3).orderBy("rank").collect()] == [3, 4, 2]
    c = frame(spark, [("C3", 0.0, 1.0, 0.0), ("C4", 0.0, -1.1, 0.0), ("Cz", 0.0, 0.1, 0.0)], "ch string, x double, y double, z double")
    got = {r.ch: r.mirror for r in signals.mirrored(c).collect()}
    assert got["C3"] == "C4" and got["C4"] == "C3"


@pytest.mark.parametrize("seed", [4096, 3])
def test_ranks_by_ranges(spark, seed):
    """Mean ranks and false-discovery rates with ties, nulls and a null key, against a plain version."""
    rng = random.Random(seed)
    rows = [(k, i, rng.choice([None, rng.random(), 0.25, 0.5])) for k in ("a", "b", None) for i in range(60)]
    df = spark.createDataFrame([*rows, ("lone", 0, 0.125), ("empty", 0, None)], "run string, i int, p double")
    ranks = {(r.run, r.i): r.r for r in reports.mid_ranks(df.where("p is not null"), ["run"], {"r": "p"}).collect()}
    rates = {(r.run, r.i): r.q for r in reports.false_discovery(df, ["run"], "p").collect()}
    assert len(rates) == df.count()
    for k, i, p in rows:
        own = sorted(x for key, _, x in rows if key == k and x is not None)
        if p is None:
            assert rates[k, i] is None
            continue
        assert ranks[k, i] == sum(x < p for x in own) + (own.count(p) + 1) / 2
        assert rates[k, i] == pytest.approx(min(1.0, *(x * len(own) / (n + 1) for n, x in enumerate(own) if x >= p)))
    assert (ranks["lone", 0], rates["lone", 0], rates["empty", 0]) == (1.0, 0.125, None)


@pytest.mark.parametrize("seed", [4096, 3])
def test_ranked_pivot_with_ties_and_missing_means(spark, seed):
    rng = random.Random(seed)
    rows = [(k, c, None if k % 7 == 0 else float(rng.randrange(4))) for k in range(40) for c in "xy"]
    df = spark.createDataFrame(rows, "k int, c string, v double")
    got = {r.k: r["rank"] for r in reports.ranked_pivot(df, "k", "c", "v", ["x", "y"], "of_").collect()}
    mean = {k: None if k % 7 == 0 else sum(v for key, _, v in rows if key == k) / 2 for k in range(40)}
    order = sorted(mean, key=lambda k: (mean[k] is not None, -(mean[k] or 0), k))
    assert got == {k: n + 1 for n, k in enumerate(order)}
    assert reports.ranked_pivot(df.limit(0), "k", "c", "v", ["x", "y"], "of_").count() == 0


def plain_section(x, b, a, y1, y2):
    """Sample by sample."""
    out, x1, x2 = [], x[0], x[0]
    for v in x.tolist():
        y = b[0] * v + b[1] * x1 + b[2] * x2 - a[1] * y1 - a[2] * y2
        x2, x1, y2, y1 = x1, v, y1, y
        out.append(y)
    return out


@pytest.mark.parametrize("n", [1, 5, 64, 65, 1000])
def test_sections_by_blocks(n):
    x = np.random.default_rng(n).normal(size=n)
    for b, a in signals.butterworth(4, (20, 450), 1000.0, "band") + signals.butterworth(2, (49, 51), 1000.0, "stop"):
        assert signals.run_section(x, b, a, 0.3, -0.2) == pytest.approx(plain_section(x, b, a, 0.3, -0.2), abs=1e-10)


@pytest.mark.parametrize("mains", [50.0, 500.0])
def test_envelopes_of_long_signals(spark, mains):
    """Pieces give what the whole signal gives, wherever blocks end."""
    rng = np.random.default_rng(5)
    x = {"a": rng.normal(size=30_000 if mains > 400 else 150_000) * 1e3, "b": rng.normal(size=4001), "tiny": np.array([1.0])}
    rows = []
    for run, v in x.items():
        cuts = sorted({0, len(v), *rng.integers(0, len(v), 40).tolist()})
        rows += [(run, a, v[a:b].tolist()) for a, b in zip(cuts, cuts[1:], strict=False)]
    blocks = frame(spark, rows, "run string, start long, samples array<double>")
    got = {}
    for r in signals.long_envelopes(blocks, ["run"], 1000.0, mains=mains, span=4001).orderBy("run", "start").collect():
        got.setdefault(r.run, []).extend(r.samples)
    margin = signals.memory_of(sum(signals.envelope_filters(1000.0, mains=mains), []))
    assert margin < len(x["a"]) / 2
    for run, v in x.items():
        assert got[run] == pytest.approx(signals.envelope(v, 1000.0, mains=mains).tolist(), rel=1e-9, abs=1e-9)


def plain_correlation(x, y):
    """By orthogonal bases of the centred columns."""
    qx, qy = (np.linalg.qr(v - v.mean(0))[0] for v in (x, y))
    return np.linalg.svd(qx.T @ qy, compute_uv=False)[0]


@pytest.mark.parametrize(("rows", "fan"), [(4096, 64), (30, 2)])
def test_canonical_correlation_by_sums(spark, monkeypatch, rows, fan):
    monkeypatch.setattr(coupling, "BLOCK_ROWS", rows)
    monkeypatch.setattr(coupling, "FAN", fan)
    rng = np.random.default_rng(2)
    x, y = rng.normal(size=(400, 3)) + 50, rng.normal(size=(400, 4))
    near = y.copy()
    near[:, 1] += 0.5 * x[:, 0]
    flat = near.copy()
    flat[:, 3] = flat[:, 2] * 2
    cases = {"far": (x, y), "near": (x, near), "flat": (x, flat), "few": (x[:39], near[:39]), "narrow": (x[:, :1], near), None: (x[:60], near[:60])}
    table = [(k, a.tolist(), b.tolist()) for k, (xs, ys) in cases.items() for a, b in zip(xs, ys, strict=True)]
    table += [("near", [float("nan"), 1.0, 2.0], [1.0] * 4), ("near", None, [1.0] * 4)]
    got = {r.k: (r.r1, r.p) for r in coupling.canonical(frame(spark, table, "k string, a array<double>, b array<double>").repartition(5), ["k"], "a", "b").collect()}
    for k in ("far", "near", None):
        assert got[k][0] == pytest.approx(plain_correlation(*cases[k]), abs=1e-9)
    assert got["flat"][0] == pytest.approx(plain_correlation(x, flat[:, :3]), abs=1e-9)
    assert got["near"][1] == pytest.approx(1 / 101) and 1 / 101 < got["far"][1] <= 1
    assert got["few"] == got["narrow"] == (None, None) and len(got) == 6


def test_factors_of_long_recordings(spark):
    """Blocks of trials give the factors that all samples together give from the same start, and the chosen number and fit of the group version."""
    rng = np.random.default_rng(6)
    w, rows, x = rng.random((4, 2)), [], {}
    for run in ("a", None):
        for t in range(3):
            h = rng.random((2, 20 + t)) ** 3
            x[run, t] = w @ h
            rows += [(run, f"c{c}", t, [*(x[run, t][c] * (c + 1)).tolist(), *[9.0] * (c if t == 1 else 0)]) for c in range(4)]
    rows += [("a", "c0", 7, [1.0] * 30)]  # a trial without the other channels
    cuts = frame(spark, [r for r in rows if r[0] is not None], "run string, ch string, trial int, samples array<double>")
    blocks = synergies.scaled_blocks(synergies.trial_blocks(cuts, ["run"]), ["run"])
    whole = np.hstack([x["a", t] * np.arange(1, 5)[:, None] for t in range(3)])
    scaled = whole / np.array([synergies.percentile_mid(c, 0.95) for c in whole])[:, None]
    got = {r.trial: np.array(r.x).reshape(4, r.n) for r in blocks.collect()}
    assert np.hstack([got[t] for t in range(3)]) == pytest.approx(scaled) and len(got) == 3
    weights, activations, fits = synergies.long_factors(blocks, frame(spark, [("a", 2, 5)], "run string, k int, rep int"), ["run"], 6, seed=3)
    head = {"run": "a"}
    v = synergies.start_of(head, ["run"], 2, 5, 3, 4, None)
    h = np.hstack([synergies.start_of(head | {"trial": t}, ["run"], 2, 5, 3, 0, 20 + t) for t in range(3)])
    for _ in range(6):
        h *= (v.T @ scaled) / (v.T @ v @ h + synergies.EPS)
        v *= (scaled @ h.T) / (v @ (h @ h.T) + synergies.EPS)
    assert np.array(weights.first().w).reshape(4, 2) == pytest.approx(v)
    own = {r.trial: np.array(r.h).reshape(2, -1) for r in activations.collect()}
    assert np.hstack([own[t] for t in range(3)]) == pytest.approx(h)
    assert (fits.first().vaf, fits.first().vaf_min) == pytest.approx(synergies.accounted(scaled, v @ h))


def test_synergies_of_long_recordings(spark, monkeypatch):
    monkeypatch.setattr(synergies, "MOST", 2)
    rng = np.random.default_rng(7)
    w = np.array([[1.0, 0.0], [0.8, 0.1], [0.0, 1.0]])
    rows = [("a", f"c{c}", t, v.tolist()) for t in range(2) for c, v in enumerate(w @ rng.random((2, 40)) ** 2)]
    cuts = frame(spark, rows, "run string, ch string, trial int, samples array<double>")
    out = synergies.long_synergies(cuts, ["run"], rounds=12, repeats=2, repeat_rounds=12)
    plain = synergies.synergies(cuts, ["run"])
    assert out.schema.names == plain.schema.names
    got, want = out.collect(), plain.collect()
    assert sorted((r.syn, r.trial, len(r.samples)) for r in got) == sorted((r.syn, r.trial, len(r.samples)) for r in want) and got[0].n_syn == 2
    assert got[0].vaf > 0.85 and 0 < got[0].stability <= 1 + 1e-9 and all(len(r.weights) == 3 for r in got)


def test_quantiles_of_far_values(spark):
    """Both rules against plain versions: ties, one far value, nulls, infinite values, a null key and a key without numbers."""
    rng = random.Random(8)
    rows = [(k, rng.choice([rng.random(), 0.5, 1e-9 * rng.random(), None])) for k in ("a", None) for _ in range(301)] + [("a", 1e12), ("a", float("inf")), ("none", None), ("one", 2.0)]
    df = frame(spark, rows, "k string, v double")
    places = {"n1": lambda q, n: q * (n - 1), "mid": lambda q, n: min(max(q * n + 0.5, 1), n) - 1}
    for rule, place in places.items():
        got = {r.k: (r.lo, r.hi) for r in reports.quantiles(df, ["k"], "v", {"lo": 0.25, "hi": 0.95}, rule).collect()}
        for k in ("a", None, "one"):
            own = sorted(v for key, v in rows if key == k and v is not None and v < 1e300)
            for g, q in zip(got[k], (0.25, 0.95), strict=True):
                at = place(q, len(own))
                a, b = own[int(at)], own[min(int(at) + 1, len(own) - 1)]
                assert g == pytest.approx(a + (b - a) * (at - int(at)))
        assert got["none"] == (None, None)


def test_split_by_state_by_hand(spark):
    rows = [("few", p, 1.0) for p in (1.0, 2.0, 3.0, 4.0, None)] + [("one", float(p), 1.0) for p in range(7)]
    rows += [("ok", float(p), None if p == 9 else 10.0 * p) for p in range(10)]
    got = {r.k: r for r in reports.split_by_state(frame(spark, rows, "k string, p double, v double"), ["k"], "p", "v").collect()}
    assert (got["few"].n, got["few"].n_active, got["few"].active, got["few"].rest, got["few"].delta) == (4, 0, None, None, None)
    assert (got["one"].n, got["one"].n_active, got["one"].active) == (7, 2, None)
    assert (got["ok"].n, got["ok"].n_active, got["ok"].active, got["ok"].rest, got["ok"].delta) == (10, 3, 75.0, 30.0, 45.0)
    assert got["ok"].ratio == 2.5


def test_mirror_by_hand(spark):
    c = [("C1", 0.0, 1.0, 0.0), ("Cz", 0.0, 0.0, 0.0), ("C2", 0.0, -5.0, 0.0), ("bad", None, 1.0, 0.0), ("inf", 0.0, float("inf"), 0.0)]
    got = {r.ch: r.mirror for r in signals.mirrored(frame(spark, c, "ch string, x double, y double, z double")).collect()}
    assert got == {"C1": "C2", "C2": "C1", "Cz": "C1", "bad": "bad", "inf": "inf"}
    lone = frame(spark, [("r", "C1", 0.0, 1.0, 0.0), ("s", "C2", 0.0, -1.0, 0.0), ("s", "C4", 0.0, -3.0, 0.0)], "run string, ch string, x double, y double, z double")
    assert {(r.run, r.ch): r.mirror for r in signals.mirrored(lone, ["run"]).collect()} == {("r", "C1"): "C1", ("s", "C2"): "C4", ("s", "C4"): "C2"}


def test_bootstrap_of_few_values(spark):
    df = frame(spark, [("one", 3.0), ("one", float("inf")), ("none", None), ("two", 1.0), ("two", 2.0)], "k string, v double")
    got = {r.k: (r.low, r.high) for r in coupling.bootstrap_mean(df, ["k"], "v", resamples=10).collect()}
    assert got["one"] == (3.0, 3.0) and got["none"] == (None, None) and got["two"] == (1.0, 2.0)


@pytest.mark.parametrize("segments", [256, 2])
def test_coherence_of_long_signals(spark, monkeypatch, segments):
    """Pieces add up to the whole signal's curve; a signal shorter than a window goes."""
    monkeypatch.setattr(signals, "SEGMENTS", segments)
    rng = np.random.default_rng(5)
    whole, blocks = [], []
    for run, n in ((1, 64 * 20), (2, 64 * 7), (3, 64)):
        e = rng.normal(size=n)
        h = e + rng.normal(size=n)
        whole.append((run, e.tolist(), h.tolist()))
        blocks += [(run, a, e[a : a + 64].tolist(), h[a : a + 64].tolist()) for a in range(0, n, 64)]
    want = {r.run: r for r in signals.coherence(frame(spark, whole, "run int, e array<double>, h array<double>"), ["run"], 160.0).collect()}
    got = {r.run: r for r in signals.long_coherence(frame(spark, blocks, "run int, start int, e array<double>, h array<double>"), ["run"], 160.0).collect()}
    assert set(got) == set(want) == {1, 2}
    for run, r in want.items():
        assert got[run].n_segments == r.n_segments
        for name in ("f", "c", "ic", "re", "im"):
            assert np.allclose(got[run][name], r[name])
        assert np.allclose(np.exp(1j * np.array(got[run].angle)), np.exp(1j * np.array(r.angle)))
