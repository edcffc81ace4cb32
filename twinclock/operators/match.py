"""Predicted against reference events: one-to-one matching, residuals, blockers, readiness."""

from __future__ import annotations

from collections import deque

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.numbers import fixed
from ..functions.walks import walk

#: Thresholds of the three profiles. Counts, recall, median and 95 % of residuals (ms), spread (ms), blockers, drift (ppm).
CRITERIA = (
    ("standard", 20, 20, 0.95, 5.0, 15.0, 2.0, 0, 5000.0),
    ("strict", 20, 20, 0.97, 4.0, 10.0, 1.5, 0, 3000.0),
    ("very_strict", 20, 20, 0.98, 3.0, 8.0, 1.0, 0, 2000.0),
)
CRITERIA_SCHEMA = "profile string, min_din4 int, min_din5 int, min_recall double, max_median_ms double, max_p95_ms double, max_mad_ms double, max_high int, warn_drift_ppm double"


def criteria(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(CRITERIA), CRITERIA_SCHEMA)


def matched(predicted: DataFrame, reference: DataFrame, keys: list[str], tolerance: float) -> DataFrame:
    """keys, t_pred, t_ref, res_ms: pairs and, with nulls on one side, what is left over. Inputs: keys, t.

    Both sides are put in one order by time. Events that wait for a partner are all of one side; the first of them pairs with the
    next event of the other side if that is within the tolerance, else it stays alone.
    """
    side = lambda df, k: df.select(*keys, F.col("t").cast("double").alias("t"), F.lit(k).alias("side")).where("t is not null")

    def walker():
        waiting: deque[float] = deque()
        of = 0

        def step(row):
            nonlocal of
            if row is None:
                yield from (alone(x) for x in waiting)
                return
            t, own = row
            while waiting and of != own:
                first = waiting.popleft()
                if t - first <= tolerance:
                    yield (first, t, 1000 * (first - t)) if of == 0 else (t, first, 1000 * (t - first))
                    return
                yield alone(first)
            of = own
            waiting.append(t)

        def alone(x: float):
            return (x, None, None) if of == 0 else (None, x, None)

        return step

    columns = {"t_pred": pa.float64(), "t_ref": pa.float64(), "res_ms": pa.float64()}
    return walk(side(predicted, 0).unionByName(side(reference, 1)), keys, ["t", "side"], walker, columns, "t_pred double, t_ref double, res_ms double")


def metrics(pairs: DataFrame, keys: list[str]) -> DataFrame:
    """keys, n_pred, n_ref, n_match, recall, precision, median, 95 % and largest residual of `matched` rows; ratios over none are null."""
    res = F.abs("res_ms")
    n = pairs.groupBy(*keys).agg(F.count("t_pred").alias("n_pred"), F.count("t_ref").alias("n_ref"), F.count("res_ms").alias("n_match"), F.median(res).alias("median_ms"), F.percentile(res, F.lit(0.95)).alias("p95_ms"), F.max(res).alias("max_ms"))
    return n.withColumns({"recall": F.try_divide("n_match", "n_ref"), "precision": F.try_divide("n_match", "n_pred")})


def severity(code: Column, issue: Column) -> Column:
    task = code.isin("DIN4", "DIN5")
    return F.when(issue == "missing", F.when(task, "HIGH").otherwise("MED")).when(issue == "extra", F.when(task, "MED").otherwise("LOW")).otherwise(F.when(task, "HIGH").otherwise("MED"))


def blockers(pairs: DataFrame, keys: list[str], code: str, limit_ms: Column) -> DataFrame:
    """keys, issue (missing, extra, residual), t, res_ms, severity."""
    issue = F.when(F.col("t_pred").isNull(), "missing").when(F.col("t_ref").isNull(), "extra").when(F.abs("res_ms") > limit_ms, "residual")
    found = pairs.select(*keys, issue.alias("issue"), F.coalesce("t_ref", "t_pred").alias("t"), "res_ms").where("issue is not null")
    return found.withColumn("severity", severity(F.col(code), F.col("issue")))


def blocker_table(pairs: DataFrame, keys: list[str], code: str, limit_ms: Column) -> DataFrame:
    """keys, issue, severity, time_mff_s, time_pred_s, delta_ms, note: `blockers` as a report writes them, numbers as texts, empty where a side misses."""
    issue = F.when(F.col("t_pred").isNull(), "missing").when(F.col("t_ref").isNull(), "extra").when(F.abs("res_ms") > limit_ms, "residual")
    named = F.when(F.col("i_") == "missing", "missing_event").when(F.col("i_") == "extra", "extra_event").otherwise("large_residual")
    note = F.when(F.col("i_") == "missing", "Event in MFF not matched").when(F.col("i_") == "extra", "Event in OTB not matched").otherwise(F.format_string("|delta|>%.0f ms", limit_ms.cast("double")))
    found = pairs.withColumn("i_", issue).where("i_ is not null")
    return found.select(*keys, named.alias("issue"), severity(F.col(code), F.col("i_")).alias("severity"), fixed(F.col("t_ref"), 6, "").alias("time_mff_s"), fixed(F.col("t_pred"), 6, "").alias("time_pred_s"), fixed(F.col("res_ms"), 3, "").alias("delta_ms"), note.alias("note"))


def excess(value: Column, limit: Column, upper: bool = True) -> Column:
    """How far a value is beyond its limit, at least zero; null without a value."""
    return F.when(value.isNotNull(), F.greatest(value - limit if upper else limit - value, F.lit(0.0)))


def limit_ms(code: Column) -> Column:
    """Residuals beyond this many milliseconds are blockers."""
    return F.when(code == "DIN1", 30.0).otherwise(20.0)


def combined_excess(values: dict[str, str]) -> Column:
    """The largest of value less limit over the given columns (value -> limit), at least zero; missing values take no part, null if all miss."""
    beyond = [F.col(v) - F.col(m) for v, m in values.items()]
    most = F.greatest(*beyond) if len(beyond) > 1 else beyond[0]
    return F.when(most.isNotNull(), F.greatest(most, F.lit(0.0)))


#: What a run that is not ready is told, check by check.
REASONS = {"counts": "insufficient_trials", "recall": "low_recall", "residual": "high_residuals", "fit": "high_fit_error", "blockers": "blocking_differences"}


def readiness(runs: DataFrame, limits: DataFrame, profile: str = "very_strict") -> DataFrame:
    """runs with ready, reason, drift_warning and the excesses, under a profile of `criteria`.

    runs: n_din4, n_din5, recall_din4, recall_din5, median_ms, p95_ms, mad_ms, n_high, drift_ppm. A missing value fails its check.
    excess_ms is the largest excess of residuals and fit, margin_ms what is left up to the limit of p95_ms (threshold_ms).
    """
    own = runs.join(F.broadcast(limits.where(F.col("profile") == profile)))  # one row
    c = F.col
    checks = {
        "counts": (c("n_din4") >= c("min_din4")) & (c("n_din5") >= c("min_din5")),
        "recall": (c("recall_din4") >= c("min_recall")) & (c("recall_din5") >= c("min_recall")),
        "residual": (c("median_ms") <= c("max_median_ms")) & (c("p95_ms") <= c("max_p95_ms")),
        "fit": c("mad_ms") <= c("max_mad_ms"),
        "blockers": c("n_high") <= c("max_high"),
    }
    held = {k: F.coalesce(v, F.lit(False)) for k, v in checks.items()}
    drift = F.coalesce(F.abs("drift_ppm") > c("warn_drift_ppm"), F.lit(False))
    failed = F.array_compact(F.array(*[F.when(~v, REASONS[k]) for k, v in held.items()]))
    reason = F.when(F.size(failed) > 0, F.array_join(F.array_compact(F.concat(failed, F.array(F.when(drift, "high_clock_drift_warning")))), ";")).when(drift, "alignment_good_for_csc_high_drift_corrected").otherwise("alignment_good_for_csc")
    out = own.withColumns({**{f"ok_{k}": v for k, v in held.items()}, "reason": reason, "drift_warning": drift, "over_median_ms": excess(c("median_ms"), c("max_median_ms")), "over_p95_ms": excess(c("p95_ms"), c("max_p95_ms")), "under_recall": excess(F.least("recall_din4", "recall_din5"), c("min_recall"), upper=False), "excess_ms": combined_excess({"median_ms": "max_median_ms", "p95_ms": "max_p95_ms", "mad_ms": "max_mad_ms"}), "threshold_ms": c("max_p95_ms"), "margin_ms": c("max_p95_ms") - c("p95_ms")})
    ready = F.lit(True)
    for k in held:
        ready &= c(f"ok_{k}")
    return out.withColumn("ready", ready).drop(*limits.columns)


def check_rows(runs: DataFrame, limits: DataFrame, keys: list[str], profile: str = "very_strict") -> DataFrame:
    """keys, check, threshold, value (text), pass (TRUE or FALSE), note: one row for each single check of a run."""
    own = runs.join(F.broadcast(limits.where(F.col("profile") == profile)))  # one row
    c = F.col
    least = lambda v, m, d: (v, F.format_string(f">= %.{d}f", c(m).cast("double")), c(v), c(v) >= c(m), F.lit(""))
    most = lambda v, m, d: (v, F.format_string(f"<= %.{d}f", c(m).cast("double")), c(v), c(v) <= c(m), F.lit(""))
    drift = F.coalesce(F.abs("drift_ppm") > c("warn_drift_ppm"), F.lit(False))
    warning = ("drift_ppm", F.format_string("warning if > %.0f", c("warn_drift_ppm")), c("drift_ppm"), F.lit(True), F.when(drift, "HIGH DRIFT WARNING (corrected in alignment)").otherwise(""))
    listed = [least("n_din4", "min_din4", 0), least("n_din5", "min_din5", 0), least("recall_din4", "min_recall", 2), least("recall_din5", "min_recall", 2), most("median_ms", "max_median_ms", 1), most("p95_ms", "max_p95_ms", 1), most("mad_ms", "max_mad_ms", 1), most("n_high", "max_high", 0), warning]
    row = lambda name, threshold, value, passed, note: F.struct(F.lit(name).alias("check"), threshold.alias("threshold"), fixed(value.cast("double"), 6).alias("value"), F.when(F.coalesce(passed, F.lit(False)), "TRUE").otherwise("FALSE").alias("pass"), note.alias("note"))
    return own.select(*keys, F.explode(F.array(*[row(*x) for x in listed])).alias("x")).select(*keys, "x.*")
