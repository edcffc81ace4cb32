"""Muscle synergies: non-negative factors of channel envelopes, their fit and stability."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .coupling import summed
from .reports import quantiles
from .storage import cut, stored

EPS = np.finfo(float).eps
MOST, ROUNDS, REPEATS, REPEAT_ROUNDS = 6, 150, 8, 120
TARGET, TARGET_CHANNEL = 0.90, 0.75


def percentile_mid(x: np.ndarray, q: float) -> float:
    v = np.sort(x)
    return float(np.interp(q * len(v) + 0.5, np.arange(1, len(v) + 1), v))


def factor(x: np.ndarray, k: int, rounds: int, rng: np.random.Generator) -> tuple[np.ndarray, np.ndarray]:
    """x is about w @ h, by multiplicative updates from a random start."""
    w, h = rng.random((x.shape[0], k)) + EPS, rng.random((k, x.shape[1])) + EPS
    for _ in range(rounds):
        h *= (w.T @ x) / (w.T @ w @ h + EPS)
        w *= (x @ h.T) / (w @ (h @ h.T) + EPS)
    return w, h


def accounted(x: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Share of the sum of squares that y accounts for: of all, and of the worst channel."""
    own = 1 - ((x - y) ** 2).sum(1) / np.maximum((x**2).sum(1), EPS)
    return float(1 - ((x - y) ** 2).sum() / max((x**2).sum(), EPS)), float(own.min())


def unit_columns(w: np.ndarray) -> np.ndarray:
    return w / np.maximum(np.sqrt((w**2).sum(0)), EPS)


def greedy_mean(s: np.ndarray) -> float:
    """Mean of the largest entries that are taken one after the other, with their row and column struck."""
    s, out = s.copy(), []
    for _ in range(min(s.shape)):
        i, j = np.unravel_index(np.argmax(s), s.shape)
        out.append(s[i, j])
        s[i, :], s[:, j] = -np.inf, -np.inf
    return float(np.mean(out)) if out else float("nan")


def extract(x: np.ndarray, seed: int) -> dict:
    """Scale channels by their 95 % value, take the fewest synergies that reach the targets, or else the best number."""
    scale = np.array([percentile_mid(c, 0.95) for c in x])
    scaled = np.maximum(x, 0) / np.where(scale <= EPS, 1, scale)[:, None]
    best = None
    for k in range(1, min(MOST, len(x)) + 1):
        w, h = factor(scaled, k, ROUNDS, np.random.default_rng([seed, k]))
        vaf, least = accounted(scaled, w @ h)
        if best is None or vaf > best["vaf"]:
            best = {"w": w, "h": h, "vaf": vaf, "vaf_min": least}
        if vaf >= TARGET and least >= TARGET_CHANNEL:
            best = {"w": w, "h": h, "vaf": vaf, "vaf_min": least}
            break
    k, own = best["w"].shape[1], unit_columns(best["w"])
    again = [factor(scaled, k, REPEAT_ROUNDS, np.random.default_rng([seed, k, r + 1]))[0] for r in range(REPEATS)]
    return best | {"stability": float(np.mean([greedy_mean(own.T @ unit_columns(w)) for w in again]))}


def synergies(cuts: DataFrame, keys: list[str], seed: int = 0) -> DataFrame:
    """keys, syn, n_syn, vaf, vaf_min, stability, weights (by channel name), trial, samples: one row for each synergy and trial.

    cuts: keys, ch, trial, samples. A run's envelopes are one group, since all its channels and trials share the factors;
    a recording bounds them. Trials are cut to the shortest channel. The seed goes with the run's keys.
    """
    schema = ", ".join(f"{k} {cuts.schema[k].dataType.simpleString()}" for k in keys)

    def run(part: pd.DataFrame) -> pd.DataFrame:
        own = {k: part[k].iloc[0] for k in keys}
        channels, trials = sorted(part["ch"].unique()), sorted(part["trial"].unique())
        table = {(c, t): np.asarray(s, float) for c, t, s in zip(part["ch"], part["trial"], part["samples"], strict=True)}
        trials = [t for t in trials if all((c, t) in table for c in channels)]
        if not trials:
            return pd.DataFrame(columns=[*keys, "syn", "n_syn", "vaf", "vaf_min", "stability", "channels", "weights", "trial", "samples"])
        sizes = [min(len(table[c, t]) for c in channels) for t in trials]
        x = np.array([np.concatenate([table[c, t][:n] for t, n in zip(trials, sizes, strict=True)]) for c in channels])
        got = extract(x, seed + int(pd.util.hash_pandas_object(pd.Series([str(own)]), index=False).iloc[0] % (1 << 31)))
        rows, ends = [], np.cumsum(sizes)
        for j in range(got["w"].shape[1]):
            for t, n, e in zip(trials, sizes, ends, strict=True):
                rows.append({**own, "syn": j + 1, "n_syn": got["w"].shape[1], "vaf": got["vaf"], "vaf_min": got["vaf_min"], "stability": got["stability"], "channels": channels, "weights": got["w"][:, j], "trial": t, "samples": got["h"][j, e - n : e]})
        return pd.DataFrame(rows)

    trial = cuts.schema["trial"].dataType.simpleString()
    return cuts.groupBy(*keys).applyInPandas(run, f"{schema}, syn int, n_syn int, vaf double, vaf_min double, stability double, channels array<string>, weights array<double>, trial {trial}, samples array<double>")


def accounted_for(points: DataFrame, keys: list[str], channel: str, x: str, y: str) -> DataFrame:
    """keys, vaf, vaf_min of a table of values x and their reconstruction y."""
    sums = points.groupBy(*keys, channel).agg(F.sum((F.col(x) - F.col(y)) ** 2).alias("e"), F.sum(F.col(x) ** 2).alias("s"))
    own = 1 - F.col("e") / F.greatest("s", F.lit(float(EPS)))
    return sums.groupBy(*keys).agg((1 - F.sum("e") / F.greatest(F.sum("s"), F.lit(float(EPS)))).alias("vaf"), F.min(own).alias("vaf_min"))


def trial_blocks(cuts: DataFrame, keys: list[str]) -> DataFrame:
    """keys, trial, channels, n, x (channel by sample in one array): the trials that have all of their recording's channels, cut to the shortest."""
    names = cuts.groupBy(*keys).agg(F.array_sort(F.collect_set("ch")).alias("channels"))  # a recording's channels
    own = cuts.groupBy(*keys, "trial").agg(F.array_sort(F.collect_list(F.struct("ch", "samples"))).alias("own"))
    own = own.join(names, keys).where(F.transform("own", lambda c: c["ch"]) == F.col("channels"))
    n = F.array_min(F.transform("own", lambda c: F.size(c["samples"])))
    return own.withColumn("n", n).where("n > 0").select(*keys, "trial", "channels", "n", F.flatten(F.transform("own", lambda c: F.slice(c["samples"], F.lit(1), F.col("n")))).cast("array<double>").alias("x"))


def scaled_blocks(blocks: DataFrame, keys: list[str]) -> DataFrame:
    """Blocks without negative values, each channel over its 95 % value (or one if that is nothing)."""
    long = blocks.select(*keys, "n", F.posexplode("x").alias("at", "v")).select(*keys, F.expr("at div n").cast("int").alias("c"), "v")
    top = quantiles(long, [*keys, "c"], "v", {"top": 0.95}, "mid").withColumn("top", F.when(F.col("top") > float(EPS), F.col("top")).otherwise(1.0))
    tops = top.groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(F.struct("c", "top"))), lambda t: t["top"]).alias("tops"))
    scaled = F.transform("x", lambda v, i: F.greatest(v, F.lit(0.0)) / F.get("tops", F.floor(i / F.col("n")).cast("int")))
    return blocks.join(tops, keys).withColumn("x", scaled).drop("tops")


def start_of(own: dict, keys: list[str], k: int, rep: int, seed: int, m: int, n: int | None) -> np.ndarray:
    """The start of a recording's weights (n is None), or of a trial's activations."""
    name = str([own[key] for key in keys]) + ("" if n is None else f"/{own['trial']}")
    rng = np.random.default_rng([seed, k, rep, int(pd.util.hash_pandas_object(pd.Series([name]), index=False).iloc[0] % (1 << 31))])
    return rng.random((m, k) if n is None else (k, n)) + EPS


def long_factors(blocks: DataFrame, candidates: DataFrame, keys: list[str], rounds: int, seed: int = 0) -> tuple[DataFrame, DataFrame, DataFrame]:
    """weights (keys, k, rep, w), activations (keys, k, rep, trial, h) and fits (keys, k, rep, vaf, vaf_min) of recordings that no task holds.

    blocks as `trial_blocks` gives them; candidates: keys, k, rep. All candidates take a round together: each block moves its activations
    and gives its products with them, the sums of which move the weights. Two jobs a round, on written tables: a block's
    activations stay with it, only the few sums travel.
    """
    kinds = ", ".join(f"{c} {blocks.schema[c].dataType.simpleString()}" for c in [*keys, "trial"])
    heads = ", ".join(f"{c} {blocks.schema[c].dataType.simpleString()}" for c in keys)
    unit = [*keys, "k", "rep"]
    cells = f"{kinds}, k int, rep int, n int, x array<double>, h array<double>, sums array<double>"
    width = blocks.groupBy(*keys).agg(F.first(F.size("channels")).alias("m"), F.count("*").alias("blocks"))
    most = width.agg(F.max("blocks")).first()[0] or 0
    few = candidates.count() <= 10_000
    as_matrix = lambda v, n: np.asarray(v, float).reshape(-1, n)

    def begin(batches):
        for part in batches:
            part["w"] = [start_of(r, keys, int(r["k"]), int(r["rep"]), seed, int(r["m"]), None).ravel() for r in part.to_dict("records")]
            yield part[[*unit, "m", "w"]]

    def begin_blocks(batches):
        for part in batches:
            part["h"] = [start_of(r, keys, int(r["k"]), int(r["rep"]), seed, 0, int(r["n"])).ravel() for r in part.to_dict("records")]
            part["sums"] = [[]] * len(part)
            yield part[[*keys, "trial", "k", "rep", "n", "x", "h", "sums"]]

    def move_blocks(batches):
        for part in batches:
            hs, sums = [], []
            for r in part.to_dict("records"):
                x, h, w = as_matrix(r["x"], int(r["n"])), as_matrix(r["h"], int(r["n"])), as_matrix(r["w"], int(r["k"]))
                h = h * (w.T @ x) / (w.T @ w @ h + EPS)
                hs.append(h.ravel())
                sums.append(np.concatenate([(x @ h.T).ravel(), (h @ h.T).ravel()]))
            part["h"], part["sums"] = hs, sums
            yield part[[*keys, "trial", "k", "rep", "n", "x", "h", "sums"]]

    def move_weights(batches):
        for part in batches:
            ws = []
            for r in part.to_dict("records"):
                k, m = int(r["k"]), int(r["m"])
                w, v = as_matrix(r["w"], k), np.asarray(r["values"], float)
                ws.append((w * v[: m * k].reshape(m, k) / (w @ v[m * k :].reshape(k, k) + EPS)).ravel())
            part["w"] = ws
            yield part[[*unit, "m", "w"]]

    def errors(batches):
        for part in batches:
            rows = []
            for r in part.to_dict("records"):
                x, h, w = as_matrix(r["x"], int(r["n"])), as_matrix(r["h"], int(r["n"])), as_matrix(r["w"], int(r["k"]))
                rows.append(np.concatenate([((x - w @ h) ** 2).sum(1), (x**2).sum(1)]))
            part["values"] = rows
            yield part[[*unit, "trial", "values"]]

    def added(parts: DataFrame) -> DataFrame:
        numbered = parts.withColumn("part", F.pmod(F.xxhash64("trial"), F.lit(max(1, most))).cast("int")).drop("trial")
        return summed(numbered, unit, max(2, most))  # a first round even for one block: several may share a number

    weights = candidates.select(*keys, F.col("k").cast("int").alias("k"), F.col("rep").cast("int").alias("rep")).join(width.select(*keys, "m"), keys)
    weights = stored(weights.mapInPandas(begin, f"{heads}, k int, rep int, m int, w array<double>"))
    state = blocks.select(*keys, "trial", "n", "x").join(weights.select(*unit), keys)
    state = stored(state.mapInPandas(begin_blocks, cells))
    small = lambda: F.broadcast(weights.select(*unit, "w")) if few else weights.select(*unit, "w")
    for _ in range(rounds):
        state = stored(state.join(small(), unit).mapInPandas(move_blocks, cells))
        moved = weights.join(added(state.select(*unit, "trial", F.col("sums").alias("values"))), unit)
        weights = stored(moved.mapInPandas(move_weights, f"{heads}, k int, rep int, m int, w array<double>"))
    e = added(state.join(small(), unit).mapInPandas(errors, f"{heads}, k int, rep int, trial {blocks.schema['trial'].dataType.simpleString()}, values array<double>"))
    half = F.floor(F.size("values") / 2).cast("int")
    e = e.withColumns({"e": F.slice("values", F.lit(1), half), "s": F.slice("values", half + 1, half)})
    total = lambda c: F.aggregate(c, F.lit(0.0), lambda a, v: a + v)
    own = F.array_min(F.zip_with("e", "s", lambda a, b: 1 - a / F.greatest(b, F.lit(float(EPS)))))
    fits = e.select(*unit, (1 - total("e") / F.greatest(total("s"), F.lit(float(EPS)))).alias("vaf"), own.alias("vaf_min"))
    return weights.select(*unit, "w"), state.select(*unit, "trial", "h"), fits


def long_synergies(cuts: DataFrame, keys: list[str], seed: int = 0, rounds: int = ROUNDS, repeats: int = REPEATS, repeat_rounds: int = REPEAT_ROUNDS) -> DataFrame:
    """What `synergies` gives, for recordings of any number of trials; starts are drawn by trial, so factors differ from its by their start alone."""
    blocks = cut(scaled_blocks(trial_blocks(cuts, keys), keys))
    width = blocks.groupBy(*keys).agg(F.first(F.size("channels")).alias("m"), F.first("channels").alias("channels"))
    candidates = width.select(*keys, F.explode(F.sequence(F.lit(1), F.least(F.lit(MOST), F.col("m")))).alias("k"), F.lit(0).alias("rep"))
    weights, activations, fits = long_factors(blocks, candidates, keys, rounds, seed)
    enough = (F.col("vaf") >= TARGET) & (F.col("vaf_min") >= TARGET_CHANNEL)
    best = fits.groupBy(*keys).agg(F.min(F.when(enough, F.col("k"))).alias("first"), F.min_by("k", F.struct(-F.col("vaf"), F.col("k"))).alias("most"))
    chosen = cut(best.select(*keys, F.coalesce("first", "most").alias("k")))
    again, _, _ = long_factors(blocks, chosen.select(*keys, "k", F.explode(F.sequence(F.lit(1), F.lit(repeats))).alias("rep")), keys, repeat_rounds, seed)
    kept = weights.join(chosen, [*keys, "k"]).withColumnRenamed("w", "own").drop("rep")
    heads = ", ".join(f"{c} {blocks.schema[c].dataType.simpleString()}" for c in keys)

    def likeness(batches):
        for part in batches:
            pairs = [[unit_columns(np.asarray(v, float).reshape(-1, int(k))) for v in (a, b)] for a, b, k in zip(part["own"], part["w"], part["k"], strict=True)]
            part["like"] = [greedy_mean(a.T @ b) for a, b in pairs]
            yield part[[*keys, "like"]]

    stable = again.join(kept, [*keys, "k"]).mapInPandas(likeness, f"{heads}, like double").groupBy(*keys).agg(F.avg("like").alias("stability"))
    wide = kept.join(fits.drop("rep"), [*keys, "k"]).join(stable, keys, "left").join(width, keys)
    each = wide.select(*keys, "k", "vaf", "vaf_min", "stability", "channels", "own", F.explode(F.sequence(F.lit(1), F.col("k"))).alias("syn"))
    column = F.transform(F.sequence(F.lit(0), F.size("channels") - 1), lambda c: F.get("own", c * F.col("k") + F.col("syn") - 1))
    each = each.withColumn("weights", column).join(activations.drop("rep"), [*keys, "k"])
    n = F.floor(F.size("h") / F.col("k")).cast("int")
    samples = F.slice("h", ((F.col("syn") - 1) * n + 1).cast("int"), n)
    return each.select(*keys, "syn", F.col("k").alias("n_syn"), "vaf", "vaf_min", "stability", "channels", "weights", "trial", samples.alias("samples"))
