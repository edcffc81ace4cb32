"""The batch flows: align clocks, validate an alignment, couple EEG regions and muscle synergies."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.numbers import fisher_z
from ..operators import coupling, edges, fit, match, reports, signals, synergies, tables, trials
from ..operators.storage import cut

KEYS = ["pair", "phase"]
#: First gap of the two task channels, seconds.
TASK_GAP = 0.12


def by_code(events: DataFrame, code: str) -> DataFrame:
    return fit.numbered(events.where(F.col("code") == code), KEYS, ["t", "ord"]).select(*KEYS, "k", "t")


def align(raw_edges: DataFrame, events: DataFrame, runs: DataFrame, keys: list[str] | None = None) -> dict[str, DataFrame]:
    """fits (with a status for every run), events mapped to the reference clock, trials and segments.

    raw_edges: pair, phase, aux (DIN4, DIN5, DIN1 of the channel), t. events: pair, phase, ord, t, code. runs: pair, phase,
    duration_s, fs, n_samples. A run that fails a check keeps a row with state ERR and the reason; the others go on.
    """
    steps = edges.step_median(events.where("code = 'DIN1'"), KEYS, ["t", "ord"], "t")
    counts = events.where(F.col("code").isin("DIN1", "DIN4", "DIN5")).groupBy(*KEYS, F.col("code").alias("aux")).agg(F.count("*").alias("expected"))
    wanted = counts.join(steps, KEYS, "left").select(*KEYS, "aux", "expected", F.when(F.col("aux") == "DIN1", edges.sync_gap(F.col("step_median"))).otherwise(TASK_GAP).alias("gap"))
    clean = cut(edges.clean_edges(raw_edges, wanted, [*KEYS, "aux"]))
    # the two task channels decide; a channel without any edge has a count of zero
    edges_of = clean.groupBy(*KEYS, "aux").agg(F.first("n_clean").alias("n_clean"))
    gate = counts.where(F.col("aux").isin("DIN4", "DIN5")).join(edges_of, [*KEYS, "aux"], "left").groupBy(*KEYS).agg(F.bool_and(edges.plausible_count(F.coalesce("n_clean", F.lit(0)), F.col("expected"))).alias("plausible"))
    own = {c: fit.numbered(clean.where(F.col("aux") == c), KEYS, ["t"]).select(*KEYS, "k", F.col("t").alias("x")) for c in ("DIN4", "DIN5")}
    ref = {c: by_code(events, c).withColumnRenamed("t", "y") for c in ("DIN4", "DIN5")}
    lags = cut(fit.best_lags((own["DIN4"], ref["DIN4"]), (own["DIN5"], ref["DIN5"]), KEYS))
    # the i-th matched keyboard and the i-th matched beep are a trial, judged on where the first fit puts them
    matched = []
    for c, lag in (("DIN4", "lag_a"), ("DIN5", "lag_b")):
        shifted = own[c].join(lags.select(*KEYS, lag, "a", "b"), KEYS).withColumn("k", F.col("k") - F.col(lag)).drop(lag)
        both = shifted.join(ref[c], [*KEYS, "k"]).withColumn("i", F.row_number().over(Window.partitionBy(*KEYS).orderBy("k")))
        matched.append(both.select(*KEYS, F.col("i").alias("k"), "x", "y", (F.col("a") * F.col("x") + F.col("b")).alias("t")))
    keyboard, beep = (cut(m) for m in matched)
    good = trials.valid(trials.paired(keyboard.select(*KEYS, "k", "t"), beep.select(*KEYS, "k", "t"), KEYS)).select(*KEYS, "k")
    enough = good.groupBy(*KEYS).agg((F.count("*") >= 2).alias("enough"))
    points = keyboard.unionByName(beep).join(good.withColumn("good", F.lit(True)), [*KEYS, "k"], "left").join(enough, KEYS, "left")
    # with fewer than two valid trials all matched pairs stay, and the fit of the lag search with them
    base = cut(points.where(F.coalesce("good", F.lit(False)) | ~F.coalesce("enough", F.lit(False))).select(*KEYS, "x", "y", F.coalesce("enough", F.lit(False)).alias("refit")))
    valid = base.where("refit")
    refitted = fit.better_line(fit.linear(valid, KEYS), fit.endpoint_line(valid, KEYS), KEYS)
    line = cut(refitted.unionByName(lags.select(*KEYS, "a", "b", "mad").join(refitted, KEYS, "left_anti")))
    sync = clean.where("aux = 'DIN1'").select(*KEYS, "t")
    refined = fit.refit_with_sync(base.drop("refit"), sync, events.where("code = 'DIN1'").select(*KEYS, "t"), line, KEYS)
    ok = fit.stable(F.col("a"), F.col("mad"))
    fits = runs.join(refined, KEYS, "left").join(gate, KEYS, "left").join(lags.select(*KEYS, "lag_a", "lag_b"), KEYS, "left")
    why = F.when(F.col("plausible").isNull(), "no edges").when(~F.col("plausible"), "counts are not plausible").when(F.col("a").isNull(), "no fit").when(~ok, "the fit is not stable")
    fits = cut(fits.withColumns({"drift_ppm": fit.drift_ppm(F.col("a")), "state": F.when(why.isNull(), "OK").otherwise("ERR"), "msg": F.coalesce(why, F.lit(""))}))
    good_runs = fits.where("state = 'OK'").select(*KEYS, "a", "b", "duration_s", "fs", "n_samples")
    mapped = clean.join(good_runs, KEYS).select(*KEYS, "a", "b", "duration_s", "fs", "n_samples", (F.col("a") * F.col("t") + F.col("b")).alias("t"), F.col("aux").alias("code")).where(F.col("t").between(0, F.col("duration_s") + 0.1))
    # edges are numbered as the reference's events: the lag tells how many the recording missed at its start
    at = lambda c, lag: fit.numbered(mapped.where(F.col("code") == c), KEYS, ["t"]).join(lags.select(*KEYS, lag), KEYS).select(*KEYS, (F.col("k") - F.col(lag)).alias("k"), "t")
    pairs = trials.valid(trials.paired(at("DIN4", "lag_a"), at("DIN5", "lag_b"), KEYS)).join(good_runs, KEYS)
    made = cut(trials.reconstructed(pairs, KEYS, F.col("duration_s")))
    rows = trials.movement_windows(made, KEYS).join(good_runs, KEYS)
    fs = F.col("fs")
    return {"fits": fits, "events": trials.task_events(made, mapped, KEYS), "trials": made, "segments": trials.segments(rows, KEYS, fs, F.col("n_samples"))}


def validate(predicted: DataFrame, reference: DataFrame, fits: DataFrame, limits: DataFrame, tolerance: float = 0.02, profile: str = "very_strict") -> dict[str, DataFrame]:
    """summary (readiness of every run), per code metrics, blockers, and pre/post differences.

    predicted, reference: pair, phase, code, t. The reference must be the original events, not ones that an alignment wrote.
    """
    keys = [*KEYS, "code"]
    pairs = match.matched(predicted, reference, keys, tolerance)
    per_code = match.metrics(pairs, keys)
    found = match.blockers(pairs, keys, "code", match.limit_ms(F.col("code")))
    task = per_code.where(F.col("code").isin("DIN4", "DIN5"))
    at = lambda code, c: F.max(F.when(F.col("code") == code, F.col(c)))
    worst = lambda c: F.when(at("DIN4", c).isNotNull() & at("DIN5", c).isNotNull(), F.max(c))  # noqa: E731  a code without matches fails
    wide = task.groupBy(*KEYS).agg(at("DIN4", "n_ref").alias("n_din4"), at("DIN5", "n_ref").alias("n_din5"), at("DIN4", "recall").alias("recall_din4"), at("DIN5", "recall").alias("recall_din5"), *[worst(c).alias(c) for c in ("median_ms", "p95_ms")])
    high = found.groupBy(*KEYS).agg(F.count_if(F.col("severity") == "HIGH").alias("n_high"))
    runs = fits.select(*KEYS, (F.col("mad") * 1000).alias("mad_ms"), "drift_ppm").join(wide, KEYS, "left").join(high, KEYS, "left").withColumn("n_high", F.coalesce("n_high", F.lit(0)))
    summary = match.readiness(runs, limits, profile)
    from ..functions.names import prepost_key

    keyed = summary.withColumn("key", prepost_key(F.col("pair")))
    delta = reports.difference(keyed, ["key"], "phase", "pre", "post", ["pair"], ["recall_din4", "recall_din5", "median_ms", "p95_ms", "mad_ms", "drift_ppm"])
    return {"summary": summary, "checks": match.check_rows(runs, limits, KEYS, profile), "metrics": per_code, "blockers": found, "prepost": delta}


def couple(eeg: DataFrame, emg: DataFrame, spans: DataFrame, regions: DataFrame, fs: float, surrogates: int = 40, least_segments: int = 2) -> dict[str, DataFrame]:
    """synergies, curves, band metrics by trial and region, trials, tests, the table of synergies, left against right, and totals of runs.

    eeg: pair, phase, ch, samples; emg: the same, envelopes on the same clock and rate; spans: pair, phase, trial, i1, i2.
    Region means and synergies meet by trial number. Curves of fewer than `least_segments` segments say nothing and go. Lags and
    turned signals take the mean over regions, thirds each region.
    """
    means = signals.region_means(eeg, regions, KEYS).withColumnRenamed("roi", "ch")
    e = trials.cut_samples(means, spans, KEYS)
    found = synergies.synergies(trials.cut_samples(emg, spans, KEYS), KEYS)
    both = cut(found.select(*KEYS, "syn", "trial", F.col("samples").alias("h")).join(e.select(*KEYS, "trial", F.col("ch").alias("roi"), F.col("samples").alias("e")), [*KEYS, "trial"]))
    own, unit = [*KEYS, "syn"], [*KEYS, "syn", "trial", "roi"]
    curves = cut(signals.coherence(both, unit, fs).where(F.col("n_segments") >= least_segments))
    points = signals.curve_points(curves, unit)
    bands = coupling.band_metrics(points, unit)
    thirds = coupling.trial_statistics(both, unit, fs, 0, None)
    mean = signals.mean_signal(both, [*own, "trial"], "roi", "e").join(both.groupBy(*own, "trial").agg(F.first("h").alias("h")), [*own, "trial"])
    whole = cut(coupling.trial_statistics(mean, [*own, "trial"], fs, surrogates))
    profile = tables.mean_curves(points, own).where(F.col("f").between(*coupling.BANDS["profile"]))
    shapes = profile.groupBy(*own).agg(F.transform(F.array_sort(F.collect_list(F.struct("i", fisher_z(F.col("c")).alias("z")))), lambda p: p["z"]).alias("z"))
    clusters = coupling.profile_clusters(shapes, KEYS, "syn", "z").select(*own, "cluster")
    per_trial = bands.groupBy(*own, "trial").agg(F.avg("beta_mean").alias("beta"))
    table = cut(tables.synergy_table(curves, thirds, whole, own, clusters, coupling.bootstrap_mean(per_trial, own, "beta")))
    metrics = table.select(*KEYS, F.col("synergy").alias("syn"), F.col("beta_mean_13_30_hz").alias("beta_mean"), F.col("beta_peak_coherence").alias("beta_peak"), F.col("beta_auc_13_30_hz").alias("beta_auc"), F.col("surrogate_p").alias("p"), F.col("surrogate_q").alias("q"), F.col("surrogate_sig").alias("significant"))
    return {"synergies": found, "curves": curves, "bands": bands, "trials": thirds.drop("null", "null_z", "lag_ms", "lag_beta"), "whole": whole.drop("null", "null_z"), "table": table, "sides": tables.side_table(table, KEYS), "metrics": metrics, "totals": coupling.metric_totals(metrics, KEYS), "summary": tables.synergy_totals(table, KEYS)}
