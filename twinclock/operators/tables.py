"""Tables of a run's synergies: mean curves and trials drawn together, tests against turned signals, left against right, totals.

Keys end with the synergy: `keys` is (run..., syn), a unit is keys, trial and roi. Missing numbers are null.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.numbers import circular_mean, finite, fisher_z, percentile_mid
from .coupling import BANDS, EPS, confidence_level, lateral
from .reports import false_discovery, same_keys
from .signals import curve_points

#: What the names of regions of the left and of the right motor cortex hold, in lower case.
LEFT, RIGHT = "mot_lpcg", "mot_rpcg"

#: The columns of the table of synergies, in order.
COLUMNS = [
    "synergy", "cluster_id", "peak_coherence", "peak_hz", "mean_1_45_hz",
    "beta_peak_coherence", "beta_peak_hz", "beta_mean_13_30_hz", "beta_auc_13_30_hz",
    "zcoh_beta_peak", "zcoh_beta_peak_hz", "zcoh_beta_mean", "zcoh_threshold_95", "zcoh_sigfrac_beta",
    "zcoh_surrogate_p", "zcoh_surrogate_q", "zcoh_surrogate_sig",
    "beta_mean_lagopt_13_30_hz", "lag_opt_ms", "psi_beta",
    "m1_left_beta_13_30_hz", "m1_right_beta_13_30_hz", "m1_delta_l_minus_r_13_30_hz",
    "m1_delta_l_minus_r_early", "m1_delta_l_minus_r_middle", "m1_delta_l_minus_r_late",
    "m1_delta_l_minus_r_13_20_hz", "m1_delta_l_minus_r_20_30_hz",
    "im_beta_mean_13_30_hz", "phase_beta_mean_rad",
    "surrogate_p", "surrogate_q", "surrogate_sig",
    "beta_mean_ci95_low", "beta_mean_ci95_high", "beta_stability_std", "beta_stability_cv",
    "beta_early", "beta_middle", "beta_late", "beta_delta_late_minus_early",
    "lateralization_li_motR_minus_motL", "c95",
]
#: The columns of left and right, which have a table of their own.
SIDES = [c for c in COLUMNS if c.startswith("m1_")]


def inside(band: str, f: str = "f") -> Column:
    return F.col(f).between(*BANDS[band])


def mean_curves(points: DataFrame, keys: list[str]) -> DataFrame:
    """keys, i, f, c, ic: the mean of a trial's regions, then of the trials."""
    trial = points.groupBy(*keys, "trial", "i").agg(F.min("f").alias("f"), F.avg("c").alias("c"), F.avg("ic").alias("ic"))
    return trial.groupBy(*keys, "i").agg(F.min("f").alias("f"), F.avg("c").alias("c"), F.avg("ic").alias("ic"))


def curve_metrics(curves: DataFrame, keys: list[str]) -> DataFrame:
    """keys, and of each mean curve its peaks, means and area, and the same of z with its threshold and the share of beta above it.

    curves: keys, i, f, c, ic. Of equal peaks the lowest frequency counts.
    """
    w = Window.partitionBy(*keys).orderBy("f")
    z = curves.withColumns({"z": fisher_z(F.col("c")), "f1": F.lead("f").over(w), "c1": F.lead("c").over(w)})
    wide, beta = inside("wide"), inside("beta")
    peak_at = lambda own, v: F.min_by("f", F.when(own, F.struct(-F.col(v), F.col("f"))))
    of = lambda own, v: F.when(own, F.col(v))
    area = F.when(beta & inside("beta", "f1"), (F.col("f1") - F.col("f")) * (F.col("c") + F.col("c1")) / 2)
    out = z.groupBy(*keys).agg(
        F.max(of(wide, "c")).alias("peak_coherence"), peak_at(wide, "c").alias("peak_hz"), F.avg(of(wide, "c")).alias("mean_1_45_hz"),
        F.max(of(beta, "c")).alias("beta_peak_coherence"), peak_at(beta, "c").alias("beta_peak_hz"), F.avg(of(beta, "c")).alias("beta_mean_13_30_hz"), F.sum(area).alias("beta_auc_13_30_hz"), F.avg(of(beta, "ic")).alias("im_beta_mean_13_30_hz"),
        F.max(of(beta, "z")).alias("zcoh_beta_peak"), peak_at(beta, "z").alias("zcoh_beta_peak_hz"), F.avg(of(beta, "z")).alias("zcoh_beta_mean"), percentile_mid(F.collect_list(of(wide, "z")), 0.95).alias("zcoh_threshold_95"), F.collect_list(of(beta, "z")).alias("beta_z"),
    )
    above = F.size(F.filter("beta_z", lambda x: x > F.col("zcoh_threshold_95")))
    return out.withColumn("zcoh_sigfrac_beta", F.when(F.col("zcoh_threshold_95").isNotNull() & (F.size("beta_z") > 0), above / F.size("beta_z"))).drop("beta_z")


def unit_metrics(points: DataFrame, unit: list[str]) -> DataFrame:
    """unit, beta, low, high (means of coherence over the bands), angle and psi (phase slope) over beta."""
    w = Window.partitionBy(*unit).orderBy("f")
    step = points.where(inside("beta")).withColumns({"re1": F.lead("re").over(w), "im1": F.lead("im").over(w)})
    band = lambda name: F.avg(F.when(inside(name), F.col("c")))
    return step.groupBy(*unit).agg(F.avg("c").alias("beta"), band("low_beta").alias("low"), band("high_beta").alias("high"), circular_mean(F.col("angle")).alias("angle"), F.sum(F.col("re") * F.col("im1") - F.col("im") * F.col("re1")).alias("psi"))


def trial_metrics(units: DataFrame, keys: list[str]) -> DataFrame:
    """keys, trial and the means over regions, left and right among them; a difference needs both sides.

    units: keys, trial, roi, beta, low, high, angle, psi, early, middle, late.
    """
    name = F.lower("roi")
    left, right = name.contains(LEFT), name.contains(RIGHT)
    values = ("beta", "low", "high", "early", "middle", "late")
    sides = [F.avg(F.when(own, F.col(v))).alias(f"{v}_{side}") for v in values for side, own in (("l", left), ("r", right))]
    means = units.groupBy(*keys, "trial").agg(*[F.avg(v).alias(v) for v in ("beta", "early", "middle", "late", "psi")], circular_mean(F.col("angle")).alias("angle"), *sides)
    delta = {f"delta_{v}": F.col(f"{v}_l") - F.col(f"{v}_r") for v in values}
    return means.withColumns({**delta, "li": lateral(F.col("beta_r"), F.col("beta_l"))})


def turned_tests(observed: DataFrame, nulls: DataFrame, keys: list[str], family: list[str]) -> DataFrame:
    """keys and p, q, sig of the means of coherence and of z against those of turned signals; q within a family of tests.

    observed: keys, beta, z; nulls: keys, null, null_z (arrays of equal length, one of each trial). The s-th values of the trials
    are averaged before they are compared. Without an observed number or without turned ones there is no p.
    """
    each = nulls.select(*keys, F.posexplode(F.arrays_zip("null", "null_z")).alias("s", "x"))
    means = each.groupBy(*keys, "s").agg(F.avg(finite(F.col("x.null"))).alias("null"), F.avg(finite(F.col("x.null_z"))).alias("null_z"))
    own = observed.select(*keys, finite(F.col("beta")).alias("beta"), finite(F.col("z")).alias("z"))
    both = same_keys(means, own, keys)
    share = lambda v, x: F.when(F.count(v) > 0, (1 + F.count_if(F.col(v) >= F.col(x))) / (F.count(v) + 1))
    p = both.groupBy(*keys).agg(F.when(F.first("beta").isNotNull(), share("null", "beta")).alias("surrogate_p"), F.when(F.first("z").isNotNull(), share("null_z", "z")).alias("zcoh_surrogate_p"))
    out = same_keys(observed.select(*keys), p, keys, "left")
    for name in ("surrogate", "zcoh_surrogate"):
        out = false_discovery(out, family, f"{name}_p").withColumnRenamed("q", f"{name}_q")
        out = out.withColumn(f"{name}_sig", F.coalesce(F.col(f"{name}_q") < 0.05, F.lit(False)))
    return out


def synergy_table(curves: DataFrame, thirds: DataFrame, whole: DataFrame, keys: list[str], clusters: DataFrame | None = None, intervals: DataFrame | None = None) -> DataFrame:
    """The run's keys and `COLUMNS`, one row for each synergy that has a curve; what is not given (clusters, intervals) is null.

    curves: keys, trial, roi, n_segments, arrays f, c, ic, angle, re, im (as of `coherence`); thirds: keys, trial, roi, early, middle,
    late; whole: keys, trial, lag_ms, lag_beta, null, null_z, of the mean over regions; clusters: keys, cluster; intervals: keys, low,
    high. The level c95 goes by the segments of all trials of a run, regions counted once.
    """
    run, syn, trial = keys[:-1], keys[-1], [*keys, "trial"]
    points = curve_points(curves, [*trial, "roi"])
    table = curve_metrics(mean_curves(points, keys), keys)
    units = same_keys(unit_metrics(points, [*trial, "roi"]), thirds.select(*trial, "roi", "early", "middle", "late"), [*trial, "roi"], "left")
    spread = F.when(F.count("beta") > 1, F.stddev_samp("beta")).when(F.count("beta") == 1, 0.0)
    mean = {"m1_left_beta_13_30_hz": "beta_l", "m1_right_beta_13_30_hz": "beta_r", "m1_delta_l_minus_r_13_30_hz": "delta_beta", "m1_delta_l_minus_r_early": "delta_early", "m1_delta_l_minus_r_middle": "delta_middle", "m1_delta_l_minus_r_late": "delta_late", "m1_delta_l_minus_r_13_20_hz": "delta_low", "m1_delta_l_minus_r_20_30_hz": "delta_high", "psi_beta": "psi", "beta_early": "early", "beta_middle": "middle", "beta_late": "late", "lateralization_li_motR_minus_motL": "li"}
    by_trial = trial_metrics(units, keys).groupBy(*keys).agg(*[F.avg(v).alias(k) for k, v in mean.items()], circular_mean(F.col("angle")).alias("phase_beta_mean_rad"), spread.alias("beta_stability_std"), (spread / F.greatest(F.avg("beta"), F.lit(EPS))).alias("beta_stability_cv"))
    lags = whole.groupBy(*keys).agg(F.avg(finite(F.col("lag_beta"))).alias("beta_mean_lagopt_13_30_hz"), F.avg(finite(F.col("lag_ms"))).alias("lag_opt_ms"))
    observed = table.select(*keys, F.col("beta_mean_13_30_hz").alias("beta"), F.col("zcoh_beta_mean").alias("z"))
    segments = curves.groupBy(*run, "trial").agg(F.max("n_segments").alias("n")).groupBy(*run).agg(confidence_level(F.sum("n")).alias("c95"))
    table = same_keys(same_keys(table, by_trial, keys, "left"), lags, keys, "left")
    table = same_keys(table, turned_tests(observed, whole, keys, run), keys, "left")
    table = same_keys(table, segments, run, "left")
    more = {"cluster_id": (clusters, "cluster", "int"), "beta_mean_ci95_low": (intervals, "low", "double"), "beta_mean_ci95_high": (intervals, "high", "double")}
    for name, (source, column, kind) in more.items():
        if source is None:
            table = table.withColumn(name, F.lit(None).cast(kind))
        else:
            table = same_keys(table, source.select(*keys, F.col(column).alias(name)), keys, "left")
    table = table.withColumns({"synergy": F.col(syn), "beta_delta_late_minus_early": F.col("beta_late") - F.col("beta_early")})
    return table.select(*run, *COLUMNS)


def side_table(table: DataFrame, run: list[str]) -> DataFrame:
    """run, scope (`all`, or the synergy as syn_01) and `SIDES` of a `synergy_table`; `all` is the mean of the synergies that have a number."""
    sets = table.groupingSets([[*run, "synergy"], run], *run, "synergy").agg(F.grouping("synergy").alias("g_"), *[F.avg(c).alias(c) for c in SIDES])
    return sets.select(*run, F.when(F.col("g_") == 1, "all").otherwise(F.format_string("syn_%02d", F.col("synergy").cast("int"))).alias("scope"), *SIDES)


def synergy_totals(table: DataFrame, run: list[str]) -> DataFrame:
    """run and the totals over a `synergy_table`: means, but the largest peaks with their frequencies, the least p and q, the number of significant ones."""
    mean = {
        "beta_mean_all": "beta_mean_13_30_hz", "beta_auc_all": "beta_auc_13_30_hz", "zcoh_beta_mean_all": "zcoh_beta_mean", "zcoh_threshold_beta_all": "zcoh_threshold_95", "zcoh_sigfrac_beta_all": "zcoh_sigfrac_beta",
        "beta_mean_lagopt_all": "beta_mean_lagopt_13_30_hz", "lag_opt_ms_all": "lag_opt_ms", "psi_beta_all": "psi_beta", "im_beta_mean_all": "im_beta_mean_13_30_hz", "beta_ci95_low_all": "beta_mean_ci95_low", "beta_ci95_high_all": "beta_mean_ci95_high", "beta_stability_cv_all": "beta_stability_cv",
        "gesture_delta_late_minus_early_all": "beta_delta_late_minus_early", "lateralization_li_all": "lateralization_li_motR_minus_motL", "m1_l_beta_all": "m1_left_beta_13_30_hz", "m1_r_beta_all": "m1_right_beta_13_30_hz", "m1_delta_l_minus_r_all": "m1_delta_l_minus_r_13_30_hz",
        "m1_delta_l_minus_r_early": "m1_delta_l_minus_r_early", "m1_delta_l_minus_r_middle": "m1_delta_l_minus_r_middle", "m1_delta_l_minus_r_late": "m1_delta_l_minus_r_late", "m1_delta_l_minus_r_13_20": "m1_delta_l_minus_r_13_20_hz", "m1_delta_l_minus_r_20_30": "m1_delta_l_minus_r_20_30_hz",
    }
    at_peak = lambda f, v: F.min_by(f, F.when(F.col(v).isNotNull(), F.struct(-F.col(v), F.col("synergy"))))
    tests = [x for name in ("surrogate", "zcoh_surrogate") for x in (F.min(f"{name}_p").alias(f"{name}_p_min"), F.min(f"{name}_q").alias(f"{name}_q_min"), F.count_if(f"{name}_sig").alias(f"{name}_sig_count"))]
    return table.groupBy(*run).agg(F.count("*").alias("n_synergies"), F.max("c95").alias("c95"), *[F.avg(c).alias(k) for k, c in mean.items()], F.max("beta_peak_coherence").alias("beta_peak_all"), at_peak("beta_peak_hz", "beta_peak_coherence").alias("beta_peak_hz_all"), F.max("zcoh_beta_peak").alias("zcoh_beta_peak_all"), at_peak("zcoh_beta_peak_hz", "zcoh_beta_peak").alias("zcoh_beta_peak_hz_all"), *tests)
