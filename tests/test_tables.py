"""Hand-computed cases of the tables of synergies, and of reports with missing numbers."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F
from twinclock.functions import names as N
from twinclock.functions import numbers as X
from twinclock.operators import coupling, match, reports, signals, tables

KEYS = ["run", "syn"]
CURVES = "run string, syn int, trial int, roi string, n_segments int, f array<double>, c array<double>, ic array<double>, angle array<double>, re array<double>, im array<double>"
THIRDS = "run string, syn int, trial int, roi string, early double, middle double, late double"
WHOLE = "run string, syn int, trial int, lag_ms double, lag_beta double, null array<double>, null_z array<double>"


def curve(syn, trial, roi, c, n=4):
    """Frequencies 10, 15, 25 and 40 Hz, coherence c at 15 and 25, nearly none elsewhere; a phase of a quarter turn more each step."""
    values = [0.01, c, c / 2, 0.01]
    angle = [0.0, 0.0, math.pi / 2, math.pi]
    return ("a", syn, trial, roi, n, [10.0, 15.0, 25.0, 40.0], values, [v / 10 for v in values], angle, [math.sqrt(v) * math.cos(p) for v, p in zip(values, angle)], [math.sqrt(v) * math.sin(p) for v, p in zip(values, angle)])


def tables_of(spark, clusters=None, intervals=None):
    curves = [curve(1, 1, "Mot_LPCG", 0.4), curve(1, 1, "x_MOT_rpcg", 0.2), curve(1, 2, "Mot_LPCG", 0.8, 2), curve(2, 1, "SMA", 0.6)]
    thirds = [("a", 1, 1, "Mot_LPCG", 0.1, 0.2, 0.3), ("a", 1, 1, "x_MOT_rpcg", 0.3, None, 0.7), ("a", 1, 2, "Mot_LPCG", 0.4, 0.4, 0.4)]
    whole = [("a", 1, 1, 10.0, 0.5, [0.1, 0.9, 0.2], [0.1, 0.2, 0.3]), ("a", 1, 2, 20.0, None, [0.1, 0.9, 0.3], [0.1, 0.2, float("nan")])]
    frame = spark.createDataFrame
    return tables.synergy_table(frame(curves, CURVES), frame(thirds, THIRDS), frame(whole, WHOLE), KEYS, clusters, intervals)


def test_table_of_synergies_by_hand(spark):
    table = tables_of(spark, spark.createDataFrame([("a", 1, 2)], "run string, syn int, cluster int"), spark.createDataFrame([("a", 1, 0.1, 0.9)], "run string, syn int, low double, high double"))
    assert table.columns == ["run", *tables.COLUMNS] and len(tables.COLUMNS) == 43
    got = {r.synergy: r.asDict() for r in table.collect()}
    one, two = got[1], got[2]
    # trial 1 is 0.3 at 15 Hz and 0.15 at 25 Hz, trial 2 is 0.8 and 0.4; the mean curve has 0.55 and 0.275
    assert (one["peak_coherence"], one["peak_hz"]) == pytest.approx((0.55, 15.0))
    assert one["beta_mean_13_30_hz"] == pytest.approx(0.4125) and one["beta_auc_13_30_hz"] == pytest.approx(10 * 0.825 / 2)
    assert one["mean_1_45_hz"] == pytest.approx((0.55 + 0.275 + 0.02) / 4) and one["im_beta_mean_13_30_hz"] == pytest.approx(0.04125)
    assert one["zcoh_beta_peak"] == pytest.approx(math.atanh(math.sqrt(0.55))) and one["zcoh_beta_peak_hz"] == 15.0
    # of four values the 95th percentile is the largest, and none is above it
    assert one["zcoh_threshold_95"] == pytest.approx(one["zcoh_beta_peak"]) and one["zcoh_sigfrac_beta"] == 0
    # only the first trial has both sides
    assert (one["m1_left_beta_13_30_hz"], one["m1_right_beta_13_30_hz"]) == pytest.approx(((0.3 + 0.6) / 2, 0.15))
    assert one["m1_delta_l_minus_r_13_30_hz"] == pytest.approx(0.15) and one["lateralization_li_motR_minus_motL"] == pytest.approx(-0.15 / 0.45)
    assert one["m1_delta_l_minus_r_13_20_hz"] == pytest.approx(0.2) and one["m1_delta_l_minus_r_20_30_hz"] == pytest.approx(0.1)
    assert one["m1_delta_l_minus_r_early"] == pytest.approx(-0.2) and one["m1_delta_l_minus_r_middle"] is None and one["m1_delta_l_minus_r_late"] == pytest.approx(-0.4)
    # trials: 0.225 and 0.6
    assert one["beta_stability_std"] == pytest.approx(0.375 / math.sqrt(2)) and one["beta_stability_cv"] == pytest.approx(0.375 / math.sqrt(2) / 0.4125)
    assert (one["beta_early"], one["beta_middle"], one["beta_late"]) == pytest.approx((0.3, 0.3, 0.45)) and one["beta_delta_late_minus_early"] == pytest.approx(0.15)
    assert one["phase_beta_mean_rad"] == pytest.approx(math.pi / 4) and one["psi_beta"] == pytest.approx(((0.4 + 0.2) / 2 + 0.8) / 2 / math.sqrt(2))
    assert (one["lag_opt_ms"], one["beta_mean_lagopt_13_30_hz"]) == (15.0, 0.5)
    # means of turned signals are 0.1, 0.9 and 0.25; one of them is as large. Of z none of 0.1, 0.2 and 0.3 is
    assert (one["surrogate_p"], one["surrogate_q"], one["surrogate_sig"]) == (0.5, 0.5, False)
    assert (one["zcoh_surrogate_p"], one["zcoh_surrogate_q"], one["zcoh_surrogate_sig"]) == (0.25, 0.25, False)
    assert one["c95"] == two["c95"] == pytest.approx(1 - 0.05 ** (1 / 5))
    assert (one["cluster_id"], one["beta_mean_ci95_low"], one["beta_mean_ci95_high"]) == (2, 0.1, 0.9)
    # a synergy without sides, thirds, turned signals and resampled means keeps what its curve says
    assert two["beta_mean_13_30_hz"] == pytest.approx(0.45) and two["beta_stability_std"] == 0 and two["surrogate_sig"] is False
    assert all(two[c] is None for c in ("m1_left_beta_13_30_hz", "lateralization_li_motR_minus_motL", "beta_early", "lag_opt_ms", "surrogate_p", "zcoh_surrogate_q", "cluster_id", "beta_mean_ci95_low"))


def test_sides_and_totals(spark):
    table = tables_of(spark)
    sides = {r.scope: r for r in tables.side_table(table, ["run"]).collect()}
    assert set(sides) == {"all", "syn_01", "syn_02"}
    assert sides["all"].m1_delta_l_minus_r_13_30_hz == pytest.approx(0.15) and sides["syn_02"].m1_left_beta_13_30_hz is None
    total = tables.synergy_totals(table, ["run"]).first()
    assert (total.n_synergies, total.beta_peak_all, total.beta_peak_hz_all) == pytest.approx((2, 0.6, 15.0))
    assert total.beta_mean_all == pytest.approx((0.4125 + 0.45) / 2) and (total.surrogate_p_min, total.zcoh_surrogate_q_min, total.surrogate_sig_count) == (0.5, 0.25, 0)


def test_table_of_nothing(spark):
    empty = lambda schema: spark.createDataFrame([], schema)
    table = tables.synergy_table(empty(CURVES), empty(THIRDS), empty(WHOLE), KEYS)
    assert table.count() == 0 and tables.synergy_totals(table, ["run"]).count() == 0


def test_turned_signals_of_z(spark):
    """Each pair of means comes from one and the same turn by 10 to 90 % of the length."""
    n, fs, win = 700, 250.0, 200
    rng = np.random.default_rng(3)
    e, h = rng.normal(size=n), rng.normal(size=n)
    df = spark.createDataFrame([(1, e.tolist(), h.tolist())], "run int, e array<double>, h array<double>")
    got = coupling.trial_statistics(df, ["run"], fs, 12, None).first()
    assert len(got.null) == len(got.null_z) == 12 and got.lag_ms is None
    f = np.fft.rfftfreq(512, 1 / fs)
    beta = (f >= 13) & (f <= 30)

    def parts(x):
        return np.array([np.fft.rfft(x[k : k + win] * np.hamming(win), 512)[beta] for k in range(0, n - win + 1, win // 2)])

    turns = []
    for s in range(n // 10, n * 9 // 10 + 1):
        x, y = parts(e), parts(np.roll(h, s))
        c = np.abs((x * y.conj()).mean(0)) ** 2 / ((np.abs(x) ** 2).mean(0) * (np.abs(y) ** 2).mean(0))
        turns.append((c.mean(), np.arctanh(np.sqrt(c)).mean()))
    for pair in zip(got.null, got.null_z, strict=True):
        assert min(abs(pair[0] - c) + abs(pair[1] - z) for c, z in turns) < 1e-9


def test_mean_signal(spark):
    df = spark.createDataFrame([(1, "a", [1.0, 2.0]), (1, "b", [3.0, 6.0]), (2, "a", [5.0, 7.0])], "k int, roi string, e array<double>")
    assert {r.k: r.e for r in signals.mean_signal(df, ["k"], "roi", "e").collect()} == {1: [2.0, 4.0], 2: [5.0, 7.0]}


def test_blocker_table(spark):
    df = spark.createDataFrame([("DIN4", 1.0, None, None), ("DIN1", None, 2.5, None), ("DIN1", 3.0, 3.031, 31.0), ("DIN4", 3.0, 3.001, -1.0)], "code string, t_ref double, t_pred double, res_ms double")
    got = sorted(map(tuple, match.blocker_table(df, ["code"], "code", match.limit_ms(F.col("code"))).collect()))
    assert got == [
        ("DIN1", "extra_event", "LOW", "", "2.500000", "", "Event in OTB not matched"),
        ("DIN1", "large_residual", "MED", "3.000000", "3.031000", "31.000", "|delta|>30 ms"),
        ("DIN4", "missing_event", "HIGH", "1.000000", "", "", "Event in MFF not matched"),
    ]


def test_texts_of_missing_numbers(spark):
    df = spark.createDataFrame([(None,), (float("nan"),), (float("inf"),), (1.25,)], "v double")
    assert [r.t for r in df.select(X.fixed(F.col("v"), 1, "").alias("t")).collect()][:3] == ["", "", ""]
    assert [r.t for r in df.select(X.fixed(F.col("v"), 2).alias("t")).collect()] == ["NaN", "NaN", "NaN", "1.25"]


def test_texts_round_the_exact_number(spark):
    df = spark.createDataFrame([(0.25, 0.0125), (25.45, 1.005), (2.5, 0.01295), (-0.3, 2.0**70), (-0.0, -1e-9)], "v double, w double")
    assert [r.t for r in df.select(X.fixed(F.col("v"), 1).alias("t")).collect()] == ["0.2", "25.4", "2.5", "-0.3", "-0.0"]
    got = [r.t for r in df.select(X.number_range(F.col("v"), F.col("w"), 3).alias("t")).collect()]
    assert got == ["0.250-0.013", "25.450-1.005", "2.500-0.013", "-0.300-1180591620717411303424.000", "-0.000--0.000"]
    assert [r.t for r in df.select(X.fixed(F.col("w"), 4).alias("t")).collect()][2] == "0.0129"


def test_whole_numbers_keep_their_sign(spark):
    df = spark.createDataFrame([(-0.3,), (0.3,), (-0.5,), (2.5,), (-2.5,), (None,), (float("nan"),)], "v double")
    assert [r.t for r in df.select(X.fixed(X.whole(F.col("v")), 0, "").alias("t")).collect()] == ["-0", "0", "-1", "3", "-3", "", ""]


def test_trial_means_do_not_hang_on_the_order_of_the_sum(spark):
    df = spark.createDataFrame([(1, 0.1), (1, 0.2), (1, 0.3)], "run int, duration_s double").coalesce(1)
    assert {reports.trial_means(df.orderBy(o), ["run"]).first().mean_s for o in (F.asc("duration_s"), F.desc("duration_s"))} == {0.2}


@pytest.mark.parametrize("schema,rows,want", [
    ("run int, n_samples int, duration_s double", [(1, 100, 2.0), (1, -5, None), (1, 200, 4.0)], (150.0, 3.0)),
    ("run int, start_sample int, end_sample int, run_median_duration_sec double", [(1, 11, 20, 1.5), (1, 1, 30, 1.5)], (20.0, 1.5)),
    ("run int, duration_sec double", [(1, 0.0), (1, 0.5)], (None, 0.5)),
    ("run int, other int", [(1, 1)], (None, None)),
])
def test_trial_means_from_what_is_there(spark, schema, rows, want):
    got = reports.trial_means(spark.createDataFrame(rows, schema), ["run"]).first()
    assert (got.mean_samples, got.mean_s) == want


def test_two_curves_are_one_group(spark):
    two = spark.createDataFrame([("a", 1, [0.0, 1.0, 0.0]), ("a", 2, [1.0, 0.0, 1.0])], "run string, syn int, v array<double>")
    assert {(r.cluster, r.k, r.silhouette) for r in coupling.profile_clusters(two, ["run"], "syn", "v").collect()} == {(1, 1, None)}


def test_words_of_a_pair_count_once(spark):
    df = spark.createDataFrame([("reach_reach_dx", "post"), ("a_bids", None)], "pair string, phase string")
    assert [r.w for r in df.select(N.pair_tokens(F.col("pair"), F.col("phase")).alias("w")).collect()] == [["reach", "dx", "post"], []]
