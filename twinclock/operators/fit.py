"""The affine clock map: ordinal pairs at a lag, least squares with a robust spread, lag search, refits, guardrail."""

from __future__ import annotations

from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

MAX_LAG, LEAST_PAIRS = 8, 10
MOST_SYNC_PAIRS = 400


def numbered(events: DataFrame, keys: list[str], order: list[str], name: str = "k") -> DataFrame:
    return events.withColumn(name, F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))


def ordinal_pairs(x: DataFrame, y: DataFrame, keys: list[str], lags: list[int]) -> DataFrame:
    """keys, lag, k, x, y: the (k + lag)-th x with the k-th y. x: keys, k, x; y: keys, k, y.

    The lags are a short list, so each x row is listed once for each lag and meets y by equality.
    """
    listed = x.withColumn("lag", F.explode(F.array(*[F.lit(v) for v in lags]))).withColumn("k", F.col("k") - F.col("lag"))
    return listed.join(y, [*keys, "k"]).select(*keys, "lag", "k", "x", "y")


def linear(pairs: DataFrame, keys: list[str]) -> DataFrame:
    """keys, n, a, b, mad: y = a x + b by least squares, and the median distance from it."""
    fits = pairs.groupBy(*keys).agg(F.count("*").alias("n"), F.regr_slope("y", "x").alias("a"), F.regr_intercept("y", "x").alias("b")).where("a is not null")
    spread = pairs.join(fits, keys).groupBy(*keys).agg(F.median(F.abs(F.col("y") - F.col("a") * F.col("x") - F.col("b"))).alias("mad"))
    return fits.join(spread, keys)


def drift_ppm(a: Column) -> Column:
    return (a - 1) * 1e6


def endpoint_line(pairs: DataFrame, keys: list[str]) -> DataFrame:
    """keys, a, b, mad of the line through the first and last pair."""
    ends = pairs.groupBy(*keys).agg(F.min_by(F.struct("x", "y"), "x").alias("p"), F.max_by(F.struct("x", "y"), "x").alias("q")).where("q.x > p.x")
    slope = (F.col("q.y") - F.col("p.y")) / (F.col("q.x") - F.col("p.x"))
    lines = ends.select(*keys, slope.alias("a"), (F.col("p.y") - slope * F.col("p.x")).alias("b"))
    spread = pairs.join(lines, keys).groupBy(*keys).agg(F.median(F.abs(F.col("y") - F.col("a") * F.col("x") - F.col("b"))).alias("mad"))
    return lines.join(spread, keys)


def better_line(squares: DataFrame, ends: DataFrame, keys: list[str]) -> DataFrame:
    """The endpoint line where its spread is no larger, else least squares."""
    e = ends.select(*keys, F.struct("a", "b", "mad").alias("e"))
    own = F.struct("a", "b", "mad")
    best = F.when(F.col("e.mad") <= F.col("mad"), F.col("e")).otherwise(own)
    return squares.join(e, keys, "left").select(*keys, best.alias("f")).select(*keys, "f.a", "f.b", "f.mad")


def lag_fits(x: np.ndarray, y: np.ndarray, max_lag: int) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """For each lag with enough pairs, the (k + lag)-th x with the k-th y."""
    out = {}
    for lag in range(-max_lag, max_lag + 1):
        first = max(0, -lag)
        n = min(len(y), len(x) - lag) - first
        if n >= LEAST_PAIRS:
            out[lag] = (x[first + lag : first + lag + n], y[first : first + n])
    return out


def best_lags(first: tuple[DataFrame, DataFrame], second: tuple[DataFrame, DataFrame], keys: list[str], max_lag: int = MAX_LAG, digits: int = 12) -> DataFrame:
    """keys, lag_a, lag_b, n, a, b, mad: the lags of two channels with the least spread of the common fit.

    Ties go to the first lags; scores that agree to `digits` decimals are ties. A run's four short lists of times meet in one
    group, in which all fits of the grid are made; a recording bounds them.
    """
    sides = [first[0], first[1].withColumnRenamed("y", "x"), second[0], second[1].withColumnRenamed("y", "x")]
    every = reduce(DataFrame.unionByName, [df.select(*keys, F.lit(i).alias("side"), "k", "x") for i, df in enumerate(sides)])
    schema = ", ".join(f"{k} {every.schema[k].dataType.simpleString()}" for k in keys)

    def run(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("k")
        x4, y4, x3, y3 = (part.loc[part["side"] == i, "x"].to_numpy(float) for i in range(4))
        best = None
        others = lag_fits(x3, y3, max_lag)
        for lag_a, (xa, ya) in lag_fits(x4, y4, max_lag).items():
            for lag_b, (xb, yb) in others.items():
                x, y = np.concatenate([xa, xb]), np.concatenate([ya, yb])
                dx = x - x.mean()
                spread = float(dx @ dx)
                if spread <= 0:
                    continue
                a = float(dx @ (y - y.mean())) / spread
                b = float(y.mean() - a * x.mean())
                mad = float(np.median(np.abs(y - a * x - b)))
                own = (round(mad + 1e-9 * abs(a - 1), digits), lag_a, lag_b, len(x), a, b, mad)
                if best is None or own[:3] < best[:3]:
                    best = own
        rows = [] if best is None else [{**{k: part[k].iloc[0] for k in keys}, **dict(zip(("lag_a", "lag_b", "n", "a", "b", "mad"), best[1:], strict=True))}]
        return pd.DataFrame(rows, columns=[*keys, "lag_a", "lag_b", "n", "a", "b", "mad"])

    return every.groupBy(*keys).applyInPandas(run, f"{schema}, lag_a int, lag_b int, n long, a double, b double, mad double")


def without_outliers(points: DataFrame, keys: list[str], r: str, least: float) -> DataFrame:
    """Points whose residual is within three median deviations (or `least`) of the median."""
    middle = points.groupBy(*keys).agg(F.median(r).alias("med"))
    spread = points.join(middle, keys).groupBy(*keys, "med").agg(F.median(F.abs(F.col(r) - F.col("med"))).alias("dev"))
    return points.join(spread, keys).where(F.abs(F.col(r) - F.col("med")) <= F.greatest(3 * F.col("dev"), F.lit(least))).drop("med", "dev")


def stable(a: Column, mad: Column) -> Column:
    """The guardrail: slope within two percent of one, spread within half a second."""
    return F.coalesce((F.abs(a - 1) <= 0.02) & (mad <= 0.5), F.lit(False))


def evenly(n: int, most: int) -> np.ndarray:
    """At most `most` places of 0 .. n - 1, evenly spaced."""
    return np.arange(n) if n <= most else np.unique(np.floor(np.linspace(0, n - 1, most) + 0.5).astype(int))


def merge_sorted(a: np.ndarray, b: np.ndarray, tolerance: float) -> tuple[np.ndarray, np.ndarray]:
    """One-to-one pairs of two sorted arrays: walk both, pair what is within the tolerance, else pass the smaller."""
    i = j = 0
    left, right = [], []
    while i < len(a) and j < len(b):
        if abs(a[i] - b[j]) <= tolerance:
            left.append(i)
            right.append(j)
            i, j = i + 1, j + 1
        elif a[i] < b[j]:
            i += 1
        else:
            j += 1
    return np.array(left, int), np.array(right, int)


def sync_pairs(sync: np.ndarray, reference: np.ndarray, a: float, b: float) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of the dense channel that may refine a fit; none if too few or too uncertain."""
    none = np.empty(0), np.empty(0)
    if len(sync) < 2 or len(reference) < 2:
        return none
    tolerance = float(np.clip(0.35 * np.median(np.diff(reference)), 0.008, 0.05))
    i, j = merge_sorted(a * sync + b, reference, tolerance)
    if len(i) < 20 or len(i) / min(len(sync), len(reference)) < 0.3:
        return none
    r = reference[j] - (a * sync[i] + b)
    near = np.abs(r - np.median(r)) <= max(3 * np.median(np.abs(r - np.median(r))), 0.003)
    if near.sum() >= 20:
        i, j = i[near], j[near]
    some = evenly(len(i), MOST_SYNC_PAIRS)
    return sync[i[some]], reference[j[some]]


def refit_with_sync(base: DataFrame, sync: DataFrame, reference: DataFrame, fits: DataFrame, keys: list[str], checked: bool = True) -> DataFrame:
    """keys, a, b, mad, n_sync, used: the fit over base points and sync pairs. With `checked`, only where its spread is no larger.

    base: keys, x, y; sync and reference: keys, t; fits: keys, a, b, mad. The points of one run meet in one group.
    """

    def run(part: pd.DataFrame) -> pd.DataFrame:
        own = {k: part[k].iloc[0] for k in keys}
        a, b, mad = (float(part[c].iloc[0]) for c in ("a", "b", "mad"))
        get = lambda kind, c: part.loc[part.kind == kind, c].to_numpy(float)
        x, y = sync_pairs(np.sort(get("sync", "x")), np.sort(get("reference", "x")), a, b)
        used = False
        if len(x):
            xs, ys = np.concatenate([get("base", "x"), x]), np.concatenate([get("base", "y"), y])
            slope, offset = np.polyfit(xs, ys, 1)
            spread = float(np.median(np.abs(ys - slope * xs - offset)))
            if not checked or spread <= mad:
                a, b, mad, used = float(slope), float(offset), spread, True
        return pd.DataFrame([{**own, "a": a, "b": b, "mad": mad, "n_sync": len(x), "used": used}])

    no_y = F.lit(None).cast("double").alias("y")
    rows = [base.select(*keys, F.lit("base").alias("kind"), "x", "y"), sync.select(*keys, F.lit("sync").alias("kind"), F.col("t").alias("x"), no_y), reference.select(*keys, F.lit("reference").alias("kind"), F.col("t").alias("x"), no_y)]
    every = reduce(DataFrame.unionByName, rows).join(fits.select(*keys, "a", "b", "mad"), keys)
    schema = ", ".join(f"{k} {every.schema[k].dataType.simpleString()}" for k in keys)
    return every.groupBy(*keys).applyInPandas(run, f"{schema}, a double, b double, mad double, n_sync long, used boolean")
