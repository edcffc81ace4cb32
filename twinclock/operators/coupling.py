"""Coupling of two signals over frequencies: band metrics as column expressions, resampling statistics in grouped numpy."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.numbers import circular_mean, fisher_z
from .reports import false_discovery, same_keys
from .signals import cross, spectra, welch_window
from .storage import cut

#: Bands in Hz, both ends inside.
BANDS = {"wide": (1.0, 45.0), "beta": (13.0, 30.0), "low_beta": (13.0, 20.0), "high_beta": (20.0, 30.0), "profile": (10.0, 28.0)}
EPS = float(np.finfo(float).eps)


def band_metrics(points: DataFrame, keys: list[str]) -> DataFrame:
    """keys and mean, peak, peak frequency, area of the coherence, mean z, circular mean angle and phase slope in the beta band.

    points: keys, i, f, c, angle, re, im. Neighbours in frequency come from one window over each curve.
    """
    low, high = BANDS["beta"]
    w = Window.partitionBy(*keys).orderBy("f")
    inside = points.where(F.col("f").between(low, high))
    step = inside.withColumns({"f1": F.lead("f").over(w), "c1": F.lead("c").over(w), "re1": F.lead("re").over(w), "im1": F.lead("im").over(w)})
    area = F.sum((F.col("f1") - F.col("f")) * (F.col("c") + F.col("c1")) / 2)
    slope = F.sum(F.col("re") * F.col("im1") - F.col("im") * F.col("re1"))
    return step.groupBy(*keys).agg(F.avg("c").alias("beta_mean"), F.max("c").alias("beta_peak"), F.min_by("f", F.struct(-F.col("c"), F.col("f"))).alias("beta_peak_hz"), area.alias("beta_auc"), F.avg(fisher_z(F.col("c"))).alias("z_mean"), circular_mean(F.col("angle")).alias("angle"), slope.alias("psi"))


def confidence_level(n_segments):
    """The coherence that independent signals exceed in one case of twenty."""
    return F.when(n_segments > 1, 1 - F.pow(F.lit(0.05), 1 / (n_segments - 1)))


def lateral(right, left):
    return (right - left) / F.greatest(right + left, F.lit(EPS))


def z_profile(points: DataFrame, keys: list[str]) -> DataFrame:
    """keys, z_mean, z_peak, z_threshold (95 % of the curve's own wide band), share of beta above it."""
    from ..functions.numbers import percentile_mid

    z = points.where(F.col("f").between(*BANDS["wide"])).withColumn("z", fisher_z(F.col("c")))
    level = z.groupBy(*keys).agg(percentile_mid(F.collect_list("z"), 0.95).alias("z_threshold"))
    beta = z.where(F.col("f").between(*BANDS["beta"])).join(level, keys)
    return beta.groupBy(*keys, "z_threshold").agg(F.avg("z").alias("z_mean"), F.max("z").alias("z_peak"), F.avg((F.col("z") > F.col("z_threshold")).cast("double")).alias("z_share"))


def band_mean(fx: np.ndarray, fy: np.ndarray, f: np.ndarray) -> float:
    low, high = BANDS["beta"]
    return float(cross(fx, fy)["c"][(f >= low) & (f <= high)].mean()) if len(fx) else float("nan")


def band_z(fx: np.ndarray, fy: np.ndarray, f: np.ndarray) -> tuple[float, float]:
    """Means of the coherence and of z over the beta band."""
    if not len(fx):
        return float("nan"), float("nan")
    low, high = BANDS["beta"]
    c = cross(fx, fy)["c"][(f >= low) & (f <= high)]
    return float(c.mean()), float(np.arctanh(np.sqrt(np.clip(c, 0, 1 - 1e-9))).mean())


def thirds(n: int) -> list[tuple[int, int]]:
    a, b = n // 3, 2 * n // 3
    return [(0, a), (a, b), (b, n)]


def trial_statistics(pairs: DataFrame, keys: list[str], fs: float, surrogates: int = 40, max_lag_ms: float | None = 50.0, seed: int = 0) -> DataFrame:
    """keys, beta, early, middle, late, lag_ms, lag_beta, null, null_z (arrays): what needs a trial's samples again and again.

    pairs: keys, e, h. A row is a trial of a region and synergy, so the work spreads by row. Surrogates turn h by 10 to
    90 % of its length; the seed goes with the row's keys. Positive lags: h comes later. Without a largest lag none is sought.
    """
    win, overlap, nfft = welch_window(fs)
    f = np.fft.rfftfreq(nfft, 1 / fs)
    schema = ", ".join(f"{k} {pairs.schema[k].dataType.simpleString()}" for k in keys)
    part_of = lambda x: spectra(x, fs, win, overlap, nfft)
    clean = lambda v: None if v != v else v

    def run(batches):
        for part in batches:
            rows = []
            for own in part.to_dict("records"):
                n = min(len(own["e"]), len(own["h"]))
                e, h = (np.asarray(own[c], float)[:n] for c in ("e", "h"))
                fe, fh = part_of(e), part_of(h)
                third = [band_mean(part_of(e[a:b]), part_of(h[a:b]), f) for a, b in thirds(n)]
                best, most = (float("nan"), float("nan")), max(1, int((max_lag_ms or 0) / 1000 * fs + 0.5))
                for lag in range(-most, most + 1) if len(fe) and max_lag_ms is not None else ():
                    a, b = (e[: n - lag], h[lag:]) if lag >= 0 else (e[-lag:], h[: n + lag])
                    v = band_mean(part_of(a), part_of(b), f)
                    if v == v and not v <= best[1]:
                        best = (1000 * lag / fs, v)
                rng = np.random.default_rng([seed, int(pd.util.hash_pandas_object(pd.Series([str([own[k] for k in keys])]), index=False).iloc[0] % (1 << 31))])
                turns = (rng.uniform(0.1, 0.9, surrogates) * n + 0.5).astype(int)
                null = [band_z(fe, part_of(np.roll(h, s)), f) for s in turns] if len(fe) else []
                rows.append({**{k: own[k] for k in keys}, "beta": clean(band_mean(fe, fh, f)), "early": clean(third[0]), "middle": clean(third[1]), "late": clean(third[2]), "lag_ms": clean(best[0]), "lag_beta": clean(best[1]), "null": [b for b, _ in null], "null_z": [z for _, z in null]})
            yield pd.DataFrame(rows, columns=[*keys, "beta", "early", "middle", "late", "lag_ms", "lag_beta", "null", "null_z"])

    return pairs.select(*keys, "e", "h").mapInPandas(run, f"{schema}, beta double, early double, middle double, late double, lag_ms double, lag_beta double, null array<double>, null_z array<double>")


def surrogate_test(trials: DataFrame, keys: list[str], family: list[str]) -> DataFrame:
    """keys, beta, p, q, significant: the mean over trials against the means of the surrogates; q within a family of tests."""
    null = trials.select(*keys, F.posexplode("null").alias("s", "v")).groupBy(*keys, "s").agg(F.avg("v").alias("v"))
    mean = trials.groupBy(*keys).agg(F.avg("beta").alias("beta"))
    p = null.join(mean, keys).groupBy(*keys, "beta").agg(((1 + F.count_if(F.col("v") >= F.col("beta"))) / (F.count("v") + 1)).alias("p"))
    return false_discovery(p, family, "p").withColumn("significant", F.coalesce(F.col("q") < 0.05, F.lit(False)))


def bootstrap_mean(df: DataFrame, keys: list[str], value: str, resamples: int = 500, alpha: float = 0.05, seed: int = 0) -> DataFrame:
    """keys, low, high: order statistics of means of resampled finite values (100 resamples at least); both are the value if there is but one.

    A group's values are the trials of a run.
    """
    schema = ", ".join(f"{k} {df.schema[k].dataType.simpleString()}" for k in keys)
    resamples = max(100, resamples)
    lower, upper = max(1, int(alpha / 2 * resamples)), int(np.ceil((1 - alpha / 2) * resamples))

    def run(part: pd.DataFrame) -> pd.DataFrame:
        own = {k: part[k].iloc[0] for k in keys}
        v = part[value].to_numpy(float)
        v = np.sort(v[np.isfinite(v)])
        if len(v) < 2:
            lone = float(v[0]) if len(v) else None
            return pd.DataFrame([{**own, "low": lone, "high": lone}])
        rng = np.random.default_rng([seed, int(pd.util.hash_pandas_object(pd.Series([str(own)]), index=False).iloc[0] % (1 << 31))])
        means = np.sort(rng.choice(v, (resamples, len(v))).mean(1))
        return pd.DataFrame([{**own, "low": means[lower - 1], "high": means[upper - 1]}])

    return df.select(*keys, value).groupBy(*keys).applyInPandas(run, f"{schema}, low double, high double")


BLOCK_ROWS = 4096  # rows that are permuted among each other
FAN = 64  # sums that meet in one task


def correlation_of_sums(n: float, sx: np.ndarray, sy: np.ndarray, xx: np.ndarray, yy: np.ndarray, xy: np.ndarray) -> float:
    """First canonical correlation from sums of rows and of their products; directions without spread are left out."""
    roots = []
    for s, m in ((sx, xx), (sy, yy)):
        values, vectors = np.linalg.eigh(m - np.outer(s, s) / n)
        good = values > max(values.max(), 0.0) * 1e-12
        roots.append(vectors[:, good] / np.sqrt(values[good]))
    inner = roots[0].T @ (xy - np.outer(sx, sy) / n) @ roots[1]
    return float(min(1.0, np.linalg.svd(inner, compute_uv=False)[0])) if inner.size else 0.0


def summed(parts: DataFrame, keys: list[str], most: int) -> DataFrame:
    """keys, values: elementwise sums of arrays; parts: keys, part (from 0, below `most`), values. `FAN` at most meet in a task."""
    kinds = ", ".join(f"{k} {parts.schema[k].dataType.simpleString()}" for k in [*keys, "part"])

    def add(own: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame([{**{k: own[k].iloc[0] for k in keys}, "part": own["up"].iloc[0], "values": np.sum(own["values"].to_list(), axis=0)}])

    while most > 1:
        parts = parts.withColumn("up", F.expr(f"part div {FAN}").cast(parts.schema["part"].dataType)).groupBy(*keys, "up").applyInPandas(add, f"{kinds}, values array<double>")
        most = -(-most // FAN)
    return parts.drop("part")


def canonical(rows: DataFrame, keys: list[str], x: str, y: str, permutations: int = 100, seed: int = 0) -> DataFrame:
    """keys, r1, p: first canonical correlation of two arrays of columns over a run's rows; null under 40 rows or two columns.

    Rows fall into random blocks of some `BLOCK_ROWS`; each gives its sums and, for each permutation, the products of x with y permuted
    within the block, which is a permutation of all rows. Sums of blocks add up by a tree, so no run is gathered. Which
    permutations are drawn hangs on the seed and on the rows' places in their files. Rows with a missing or infinite number are left out.
    """
    schema = ", ".join(f"{k} {rows.schema[k].dataType.simpleString()}" for k in keys)
    real = lambda c: F.forall(c, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    good = rows.select(*keys, F.col(x).cast("array<double>").alias("x_"), F.col(y).cast("array<double>").alias("y_"), F.xxhash64(F.lit(seed), x, y, F.monotonically_increasing_id()).alias("draw_"))
    good = cut(good.where(real("x_") & real("y_")))
    counts = good.groupBy(*keys).agg(F.count("*").alias("n_"))
    most = counts.agg(F.max("n_")).first()[0] or 0
    blocks = F.greatest(F.lit(1), F.ceil(F.col("n_") / BLOCK_ROWS))
    placed = same_keys(good, counts, keys).withColumn("part", F.pmod("draw_", blocks).cast("int"))

    def sums(own: pd.DataFrame) -> pd.DataFrame:
        own = own.sort_values("draw_", kind="stable")
        a, b = (np.array(own[c].tolist(), float) for c in ("x_", "y_"))
        rng = np.random.default_rng([seed, len(own), int(own["draw_"].iloc[0]) & 0x7FFFFFFF])
        head = {k: own[k].iloc[0] for k in [*keys, "part"]}
        moments = np.concatenate([[len(own)], a.sum(0), b.sum(0), (a.T @ a).ravel(), (b.T @ b).ravel()])
        orders = [np.arange(len(b)), *[rng.permutation(len(b)) for _ in range(permutations)]]
        return pd.DataFrame([{**head, "draw": k - 1, "width": a.shape[1], "values": v} for k, v in enumerate([moments, *[(a.T @ b[o]).ravel() for o in orders]])])

    made = placed.groupBy(*keys, "part").applyInPandas(sums, f"{schema}, part int, draw int, width int, values array<double>")
    totals = summed(made, [*keys, "draw", "width"], -(-most // BLOCK_ROWS))

    def judge(own: pd.DataFrame) -> pd.DataFrame:
        head, by, d = {k: own[k].iloc[0] for k in keys}, dict(zip(own["draw"], own["values"], strict=True)), int(own["width"].iloc[0])
        n, e = by[-1][0], len(by[0]) // d if d else 0
        if n < 40 or d < 2 or e < 2:
            return pd.DataFrame([{**head, "r1": None, "p": None}])
        sx, sy, xx, yy = np.split(by[-1][1:], np.cumsum([d, e, d * d]))
        r = [correlation_of_sums(n, sx, sy, xx.reshape(d, d), yy.reshape(e, e), by[k].reshape(d, e)) for k in range(permutations + 1)]
        return pd.DataFrame([{**head, "r1": r[0], "p": (1 + sum(v >= r[0] for v in r[1:])) / (permutations + 1)}])

    out = totals.groupBy(*keys).applyInPandas(judge, f"{schema}, r1 double, p double")  # a row for each permutation
    return same_keys(rows.select(*keys).distinct(), out, keys, "left")


def silhouette(d: np.ndarray, labels: np.ndarray) -> float:
    """Mean silhouette; lone members are left out; not a number for fewer than three rows."""
    if len(d) < 3:
        return float("nan")
    out = []
    for i in range(len(d)):
        same = (labels == labels[i]) & (np.arange(len(d)) != i)
        others = [d[i, labels == k].mean() for k in np.unique(labels) if k != labels[i]]
        if same.any() and others:
            a, b = d[i, same].mean(), min(others)
            out.append((b - a) / max(a, b, EPS))
    return float(np.mean(out)) if out else float("nan")


def cosine_groups(x: np.ndarray, k: int, rng: np.random.Generator, restarts: int = 25, rounds: int = 80) -> tuple[np.ndarray, float]:
    """Labels and loss of k groups of unit rows by cosine; empty groups start anew at the worst row."""
    best = (np.zeros(len(x), int), np.inf)
    for _ in range(restarts):
        centers = x[rng.choice(len(x), k, replace=False)]
        labels = None
        for _ in range(rounds):
            near = x @ centers.T
            new = near.argmax(1)
            for j in np.setdiff1d(np.arange(k), new):
                new[near.max(1).argmin()] = j
            if labels is not None and (new == labels).all():
                break
            labels = new
            centers = np.array([x[labels == j].mean(0) if (labels == j).any() else centers[j] for j in range(k)])
            centers /= np.maximum(np.linalg.norm(centers, axis=1, keepdims=True), EPS)
        loss = float((1 - (x * centers[labels]).sum(1)).sum())
        if loss < best[1]:
            best = (labels, loss)
    return best


def profile_clusters(profiles: DataFrame, keys: list[str], item: str, values: str, most: int = 5, seed: int = 0) -> DataFrame:
    """keys, item, cluster, k, silhouette: a run's curves, centred and scaled, in the number of groups with the best silhouette.

    Fewer than three curves, or none with a silhouette, are one group.
    """
    schema = ", ".join(f"{k} {profiles.schema[k].dataType.simpleString()}" for k in [*keys, item])

    def run(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values(item)
        x = np.array(part[values].tolist(), float)
        x = x - x.mean(1, keepdims=True)
        x /= np.maximum(np.linalg.norm(x, axis=1, keepdims=True), EPS)
        d = np.maximum(1 - x @ x.T, 0)
        np.fill_diagonal(d, 0)
        best = (-np.inf, np.inf, 1, np.zeros(len(x), int))
        for k in range(2, min(most, len(x)) + 1):
            labels, loss = cosine_groups(x, k, np.random.default_rng([seed, k]))
            s = silhouette(d, labels)
            if np.isfinite(s) and (s > best[0] or (abs(s - best[0]) < 1e-9 and loss < best[1])):
                best = (s, loss, k, labels)
        return pd.DataFrame({**{k: part[k] for k in keys}, item: part[item], "cluster": best[3] + 1, "k": best[2], "silhouette": best[0] if np.isfinite(best[0]) else None})

    return profiles.select(*keys, item, values).groupBy(*keys).applyInPandas(run, f"{schema}, cluster int, k int, silhouette double")


def profile_distance(profiles: DataFrame, keys: list[str], item: str, values: str) -> DataFrame:
    """keys, a, b, distance: one less the correlation of the profiles of a run's items (a short list of synergies or labels)."""
    mean = lambda v: F.aggregate(v, F.lit(0.0), lambda s, x: s + x) / F.size(v)
    centred = profiles.select(*keys, item, F.transform(values, lambda x: x - mean(F.col(values))).alias("v"))
    unit = centred.select(*keys, item, F.transform("v", lambda x: x / F.greatest(F.sqrt(F.aggregate("v", F.lit(0.0), lambda s, y: s + y * y)), F.lit(EPS))).alias("v"))
    a, b = unit.select(*keys, F.col(item).alias("a"), F.col("v").alias("u")), unit.select(*keys, F.col(item).alias("b"), "v")
    both = a.join(b, keys) if keys else a.join(F.broadcast(b))
    dot = F.aggregate(F.zip_with("u", "v", lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)
    return both.select(*keys, "a", "b", F.when(F.col("a") == F.col("b"), 0.0).otherwise(F.greatest(1 - dot, F.lit(0.0))).alias("distance"))


def metric_totals(metrics: DataFrame, keys: list[str]) -> DataFrame:
    """keys and the totals over synergies: means, but the largest peak, the least p and q, and the number of significant ones."""
    return metrics.groupBy(*keys).agg(F.avg("beta_mean").alias("beta_mean_all"), F.max("beta_peak").alias("beta_peak_all"), F.avg("beta_auc").alias("beta_auc_all"), F.min("p").alias("p_min"), F.min("q").alias("q_min"), F.count_if("significant").alias("n_significant"))
