"""Signals as arrays of samples: zero-phase Butterworth filters, envelopes, resampling, regions, spectra."""

from __future__ import annotations

from collections.abc import Callable
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.numbers import finite


@lru_cache(maxsize=1024)
def butterworth(order: int, edges: tuple[float, ...], fs: float, kind: str) -> list[tuple[np.ndarray, np.ndarray]]:
    """Sections (b, a) of second order of a low, band or stop filter, by the bilinear transform of the analog prototype."""
    poles = np.exp(1j * np.pi * (2 * np.arange(1, order + 1) + order - 1) / (2 * order))
    w = [2 * fs * np.tan(np.pi * e / fs) for e in edges]
    if kind == "low":
        p, z, gain = poles * w[0], np.empty(0, complex), None
    else:
        center, width = np.sqrt(w[0] * w[1]), w[1] - w[0]
        q = poles * width / 2 if kind == "band" else width / 2 / poles
        root = np.sqrt(q**2 - center**2)
        p = np.concatenate([q + root, q - root])
        z = np.zeros(order, complex) if kind == "band" else np.concatenate([np.full(order, 1j * center), np.full(order, -1j * center)])
    zp, zz = (2 * fs + p) / (2 * fs - p), (2 * fs + z) / (2 * fs - z)
    zz = np.concatenate([zz, -np.ones(len(zp) - len(zz))])
    pairs = lambda r: [*zip(*_conjugates(r), strict=True)]
    sections = [(np.real(np.poly(b)), np.real(np.poly(a))) for b, a in zip(pairs(zz), pairs(zp), strict=True)]
    at = 1.0 if kind in ("low", "stop") else np.exp(2j * np.arctan(np.sqrt(w[0] * w[1]) / (2 * fs)))
    gain = np.prod([abs(np.polyval(b, at) / np.polyval(a, at)) for b, a in sections])
    return [(sections[0][0] / gain, sections[0][1]), *sections[1:]]


def _conjugates(roots: np.ndarray) -> tuple[list[complex], list[complex]]:
    """Roots in conjugate pairs; real roots pair with each other, the lowest with the highest."""
    upper = sorted((r for r in roots if r.imag > 1e-9), key=lambda r: (r.real, r.imag))
    real = sorted(r.real for r in roots if abs(r.imag) <= 1e-9)
    half = len(real) // 2
    return [*upper, *real[:half]], [*(np.conj(r) for r in upper), *real[::-1][:half]]


STEP = 64  # samples that one product of matrices filters at once


@lru_cache(maxsize=256)
def section_blocks(b: tuple[float, ...], a: tuple[float, ...]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """One section over `STEP` samples: outputs from inputs, outputs from the state before, state after from inputs, and from the state before."""
    b0, b1, b2 = b
    _, a1, a2 = a
    move, enter = np.array([[-a1, 1.0], [-a2, 0.0]]), np.array([b1 - a1 * b0, b2 - a2 * b0])
    powers = [np.eye(2)]
    for _ in range(STEP):
        powers.append(move @ powers[-1])
    response = np.array([b0, *[(p @ enter)[0] for p in powers[: STEP - 1]]])
    lag = np.subtract.outer(np.arange(STEP), np.arange(STEP))
    through = np.where(lag >= 0, response[np.maximum(lag, 0)], 0.0)
    return through, np.array([p[0] for p in powers[:STEP]]), np.array([p @ enter for p in powers[STEP - 1 :: -1]]).T, powers[STEP]


def run_section(x: np.ndarray, b: np.ndarray, a: np.ndarray, y1: float, y2: float) -> np.ndarray:
    """One section over x; the state before is a steady one at the values y1 and y2.

    Blocks of `STEP` samples are filtered from rest all at once; only the two numbers that a block hands to the next go step by step.
    """
    if not len(x):
        return np.empty(0)
    through, seen, left, carried = section_blocks(tuple(map(float, b)), tuple(map(float, a)))
    n = -(-len(x) // STEP)
    blocks = np.zeros(n * STEP)
    blocks[: len(x)] = x
    blocks = blocks.reshape(n, STEP)
    s2 = b[2] * x[0] - a[2] * y1
    state = (float(b[1] * x[0] - a[1] * y1 + b[2] * x[0] - a[2] * y2), float(s2))
    ends = (blocks @ left.T).tolist()
    (c00, c01), (c10, c11) = carried.tolist()
    states = []
    for e0, e1 in ends:
        states.append(state)
        state = (c00 * state[0] + c01 * state[1] + e0, c10 * state[0] + c11 * state[1] + e1)
    return (blocks @ through.T + np.array(states) @ seen.T).ravel()[: len(x)]


def zero_phase(x: np.ndarray, sections: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """Forward and backward over the signal, which is mirrored at its ends."""
    pad = min(len(x) - 1, 3 * (2 * len(sections) + 1))
    if pad < 1:
        return x.copy()
    y = np.concatenate([2 * x[0] - x[pad:0:-1], x, 2 * x[-1] - x[-2 : -pad - 2 : -1]])
    for _ in range(2):
        for b, a in sections:
            steady = y[0] * b.sum() / a.sum() if abs(a.sum()) > 1e-12 else 0.0
            y = run_section(y, b, a, steady, steady)
        y = y[::-1]
    return y[pad:-pad]


def envelope_filters(fs: float, low_pass: float = 10.0, mains: float = 50.0) -> tuple[list, list]:
    """The filters before and after the absolute value: band 20 to 450 Hz, notches at the mains' multiples up to 400 Hz, low pass; all bounded by the rate."""
    top = min(450.0, fs / 2 - 1)
    before = [butterworth(4, (20.0, top), fs, "band")] if top > 20 else []
    before += [butterworth(2, (f - 1, f + 1), fs, "stop") for f in np.arange(mains, 401, mains) if f + 1 < fs / 2]
    return before, [butterworth(4, (min(low_pass, fs / 4),), fs, "low")]


def envelope(x: np.ndarray, fs: float, low_pass: float = 10.0, mains: float = 50.0) -> np.ndarray:
    """The signal's filtered absolute value, see `envelope_filters`."""
    before, after = envelope_filters(fs, low_pass, mains)
    for f in before:
        x = zero_phase(x, f)
    x = np.abs(x)
    for f in after:
        x = zero_phase(x, f)
    return x


FORGOTTEN = 1e-13  # what is left of a sample where a filter has forgotten it


def memory_of(filters: list) -> int:
    """Samples after which filters, one after the other, have forgotten a sample, by their slowest poles."""
    slowest = [max(np.abs(np.roots(a)).max() for _, a in f) for f in filters]
    return int(sum(1.3 * np.log(FORGOTTEN) / np.log(r) + 6 * len(f) + 3 for r, f in zip(slowest, filters, strict=True)))


def in_pieces(blocks: DataFrame, keys: list[str], f: Callable[[np.ndarray], np.ndarray], margin: int, span: int) -> DataFrame:
    """keys, start, samples: f over signals that no row can hold, piece by piece.

    blocks: keys, start (of the first sample, from 0), samples, without gaps. A piece is `span` samples and `margin` on
    either side, which f sees and which go afterwards; f must not look farther than that.
    """
    stop = F.col("start") + F.size("samples") - 1
    first, last = F.greatest(F.lit(0), F.floor((F.col("start") - margin) / span)), F.floor((stop + margin) / span)
    placed = blocks.where(F.size("samples") > 0).select(*keys, "start", "samples", F.explode(F.sequence(first, last)).alias("piece"))
    low, high = F.col("piece") * span - margin, (F.col("piece") + 1) * span + margin
    skip = F.greatest(F.lit(0), low - F.col("start"))
    part = F.slice("samples", (skip + 1).cast("int"), F.greatest(F.lit(0), F.least(F.size("samples"), high - F.col("start")) - skip).cast("int"))
    pieces = placed.select(*keys, "piece", (F.col("start") + skip).alias("start"), part.alias("samples")).where(F.size("samples") > 0)
    pieces = pieces.groupBy(*keys, "piece").agg(F.array_sort(F.collect_list(F.struct("start", "samples"))).alias("own"))  # a piece and its margins
    schema = ", ".join(f"{k} {blocks.schema[k].dataType.simpleString()}" for k in keys)

    def run(batches):
        for part in batches:
            rows = []
            for own in part.to_dict("records"):
                x = np.concatenate([np.asarray(b["samples"], float) for b in own["own"]])
                begin, at = int(own["own"][0]["start"]), int(own["piece"]) * span
                if begin + len(x) > at:  # else only the margin reaches the signal
                    rows.append({**{k: own[k] for k in keys}, "start": at, "samples": f(x)[at - begin :][:span]})
            yield pd.DataFrame(rows, columns=[*keys, "start", "samples"])

    return pieces.mapInPandas(run, f"{schema}, start long, samples array<double>")


def long_envelopes(blocks: DataFrame, keys: list[str], fs: float, low_pass: float = 10.0, mains: float = 50.0, span: int | None = None) -> DataFrame:
    """What `envelope` gives, for signals in blocks (keys, start, samples) of any number, in pieces with as much margin as the filters remember."""
    before, after = envelope_filters(fs, low_pass, mains)
    margin = memory_of(before + after)
    return in_pieces(blocks, keys, lambda x: envelope(x, fs, low_pass, mains), margin, span or max(1 << 18, 4 * margin))


def regrid(t: np.ndarray, x: np.ndarray, grid: np.ndarray) -> np.ndarray:
    """Linear on the grid; outside and at missing samples the nearest good value, zero if there is none."""
    good = np.isfinite(x)
    return np.interp(grid, t[good], x[good]) if good.any() else np.zeros(len(grid))


def map_samples(signals: DataFrame, f: Callable[..., np.ndarray], *extra: str, column: str = "samples") -> DataFrame:
    """`column` replaced by f(samples, *extra columns) of each row."""
    names = signals.columns

    def run(batches):
        for part in batches:
            part[column] = [f(np.asarray(x, float), *e) for x, *e in zip(part[column], *[part[c] for c in extra], strict=True)]
            yield part[names]

    return signals.mapInPandas(run, signals.schema)


def envelopes(signals: DataFrame, low_pass: float = 10.0) -> DataFrame:
    """signals: any keys, fs, samples array<double>. A channel is a row, so channels spread over tasks."""
    return map_samples(signals, lambda x, fs: envelope(x, float(fs), low_pass), "fs")


def aligned(signals: DataFrame, fs_out: float, n_out: str) -> DataFrame:
    """samples (fs, and the clock map a, b of the row) on the grid of the other clock."""
    return map_samples(signals, lambda x, fs, a, b, n: regrid(a * np.arange(len(x)) / fs + b, x, np.arange(int(n)) / fs_out), "fs", "a", "b", n_out)


def resampled(signals: DataFrame, fs_out: float) -> DataFrame:
    def to(x: np.ndarray, fs: float) -> np.ndarray:
        n = max(1, int(len(x) * fs_out / fs + 0.5))
        return x if fs == fs_out else regrid(np.arange(len(x)) / fs, x, np.arange(n) / fs_out)

    return map_samples(signals, to, "fs")


def region_means(signals: DataFrame, regions: DataFrame, keys: list[str]) -> DataFrame:
    """keys, roi, samples, n_channels: the mean over a region's channels, sample by sample.

    regions: name, labels array; labels are compared in lower case. The short list of regions is broadcast if Spark finds it small.
    """
    of = regions.select(F.col("name").alias("roi"), F.explode("labels").alias("label")).withColumn("label", F.lower("label"))
    long = signals.withColumn("label", F.lower("ch")).join(of, "label").select(*keys, "roi", "label", F.posexplode("samples").alias("i", "x"))
    means = long.groupBy(*keys, "roi", "i").agg(F.avg("x").alias("x"), F.count("*").alias("n"))
    return means.groupBy(*keys, "roi").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "x"))), lambda p: p["x"]).alias("samples"), F.max("n").alias("n_channels"))


FEW_TARGETS = 1024


def nearest(points: DataFrame, targets: DataFrame, k: int, at: tuple[str, ...] = ("x", "y", "z"), keys: list[str] | None = None) -> DataFrame:
    """keys, name, point, distance2, rank: the k points (of a recording) nearest to each target; ties to the smaller point.

    targets is a stated list, held against all points: broadcast up to `FEW_TARGETS`, else dealt in blocks with the points. Every
    task keeps its own best k before any exchange.
    """
    keys = keys or []
    few = targets.limit(FEW_TARGETS + 1).count() <= FEW_TARGETS
    own = targets.select("name", *[F.col(c).alias(f"{c}_t") for c in at])
    d = sum(((F.col(c) - F.col(f"{c}_t")) ** 2 for c in at), F.lit(0.0))
    both = points.join(F.broadcast(own) if few else own).select(*keys, "name", "point", d.alias("distance2"))
    rank = F.row_number().over(Window.partitionBy(*keys, "name").orderBy("distance2", "point"))
    return both.withColumn("rank", rank).where(F.col("rank") <= k)


def mirrored(channels: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """keys, ch, mirror: the other channel nearest to the mirrored place (y is negated), strictly of the other half if there is one.

    channels: keys (of a recording), ch, x, y, z; numbers that are missing or not finite are no place. A channel without a place or
    without a partner is its own mirror; a channel in the middle takes the nearest of all others. Ties go to the first by name. Only
    the channels of one recording meet.
    """
    keys = keys or []
    real = channels.select(*keys, "ch", *[finite(F.col(c).cast("double")).alias(c) for c in "xyz"])
    a = real.select(*keys, *[F.col(c).alias(f"{c}_a") for c in ("ch", *"xyz")], F.lit(1).alias("all_"))
    b = real.where("x is not null and y is not null and z is not null").withColumn("all_", F.lit(1))
    d = (F.col("x_a") - F.col("x")) ** 2 + (F.col("y_a") + F.col("y")) ** 2 + (F.col("z_a") - F.col("z")) ** 2
    other_half = (F.abs("y_a") > 1e-6) & (F.signum("y_a") * F.signum("y") < 0)
    pairs = a.join(b, [*keys, "all_"]).where((F.col("ch_a") != F.col("ch")) & d.isNotNull())
    best = pairs.groupBy(*keys, "ch_a").agg(F.min_by("ch", F.struct((~other_half).cast("int"), d, F.col("ch"))).alias("mirror"))
    return a.join(best, [*keys, "ch_a"], "left").select(*keys, F.col("ch_a").alias("ch"), F.coalesce("mirror", "ch_a").alias("mirror"))


def mean_signal(signals: DataFrame, keys: list[str], by: str, samples: str) -> DataFrame:
    """keys, samples: the mean of a key's signals, sample by sample; they are as long as each other (regions of one trial)."""
    own = signals.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(F.col(by).alias("k"), F.col(samples).alias("x")))).alias("own"))
    total = F.aggregate(F.slice("own", 2, F.greatest(F.size("own") - 1, F.lit(1))), F.get("own", F.lit(0))["x"], lambda s, r: F.zip_with(s, r["x"], lambda a, b: a + b))
    return own.select(*keys, F.transform(total, lambda x: x / F.size("own")).alias(samples))


def welch_window(fs: float) -> tuple[int, int, int]:
    """Window, overlap and transform length."""
    win = max(128, int(0.8 * fs + 0.5))
    return win, int(win / 2 + 0.5), max(512, 1 << (win - 1).bit_length())


def spectra(x: np.ndarray, fs: float, win: int, overlap: int, nfft: int) -> np.ndarray:
    """Transforms of the signal's windowed segments, segment by frequency; none if it is shorter than a window."""
    hop = win - overlap
    n = (len(x) - overlap) // hop
    if n < 1:
        return np.empty((0, nfft // 2 + 1), complex)
    places = np.arange(n)[:, None] * hop + np.arange(win)
    return np.fft.rfft(x[places] * np.hamming(win), nfft, axis=1)


def cross(fx: np.ndarray, fy: np.ndarray) -> dict[str, np.ndarray]:
    """Coherence, its imaginary part, phase and the complex coherency from segments' transforms."""
    pxx, pyy, pxy = (np.abs(fx) ** 2).mean(0), (np.abs(fy) ** 2).mean(0), (fx * np.conj(fy)).mean(0)
    power = np.maximum(pxx * pyy, np.finfo(float).eps)
    c = pxy / np.sqrt(power)
    return {"c": np.clip(np.abs(pxy) ** 2 / power, 0, 1), "ic": np.abs(pxy.imag) / np.sqrt(power), "angle": np.angle(pxy), "re": c.real, "im": c.imag}


def coherence(pairs: DataFrame, keys: list[str], fs: float) -> DataFrame:
    """keys, n_segments, and arrays f, c, ic, angle, re, im of each row's signals e and h; rows shorter than a window go."""
    win, overlap, nfft = welch_window(fs)
    schema = ", ".join(f"{k} {pairs.schema[k].dataType.simpleString()}" for k in keys)

    def run(batches):
        f = np.fft.rfftfreq(nfft, 1 / fs)
        for part in batches:
            rows = []
            for own in part.to_dict("records"):
                n = min(len(own["e"]), len(own["h"]))
                fx, fy = (spectra(np.asarray(own[c], float)[:n], fs, win, overlap, nfft) for c in ("e", "h"))
                if len(fx):
                    rows.append({**{k: own[k] for k in keys}, "n_segments": len(fx), "f": f, **cross(fx, fy)})
            yield pd.DataFrame(rows, columns=[*keys, "n_segments", "f", "c", "ic", "angle", "re", "im"])

    return pairs.select(*keys, "e", "h").mapInPandas(run, f"{schema}, n_segments int, f array<double>, c array<double>, ic array<double>, angle array<double>, re array<double>, im array<double>")


SEGMENTS = 256  # segments of a long signal that one task transforms at once


def long_coherence(blocks: DataFrame, keys: list[str], fs: float) -> DataFrame:
    """What `coherence` gives, for signals that no row can hold; blocks: keys, start (of its first sample, from 0), e, h (arrays of equal length).

    Blocks follow each other without gaps. Pieces of `SEGMENTS` segments, which overlap as segments do, are transformed by
    themselves, and their sums of spectra add up in Spark. Signals shorter than a window go.
    """
    win, overlap, nfft = welch_window(fs)
    span = SEGMENTS * (win - overlap)
    first = F.greatest(F.lit(0), F.floor((F.col("start") - overlap) / span))
    last = F.floor((F.col("start") + F.size("e") - 1) / span)
    placed = blocks.where(F.size("e") > 0).select(*keys, "start", "e", "h", F.explode(F.sequence(first, last)).alias("piece"))
    pieces = placed.groupBy(*keys, "piece").agg(F.array_sort(F.collect_list(F.struct("start", "e", "h"))).alias("own"))
    schema = ", ".join(f"{k} {blocks.schema[k].dataType.simpleString()}" for k in keys)
    sums = ("pxx", "pyy", "re", "im")

    def run(batches):
        for part in batches:
            rows = []
            for own in part.to_dict("records"):
                skip = int(own["piece"]) * span - int(own["own"][0]["start"])
                signal = [np.concatenate([np.asarray(b[c], float) for b in own["own"]])[max(0, skip) :][: span + overlap] for c in ("e", "h")]
                fx, fy = (spectra(x, fs, win, overlap, nfft) for x in signal)
                if len(fx):
                    pxy = (fx * np.conj(fy)).sum(0)
                    rows.append({**{k: own[k] for k in keys}, "n": len(fx), "pxx": (np.abs(fx) ** 2).sum(0), "pyy": (np.abs(fy) ** 2).sum(0), "re": pxy.real, "im": pxy.imag})
            yield pd.DataFrame(rows, columns=[*keys, "n", *sums])

    parts = pieces.mapInPandas(run, f"{schema}, n int, " + ", ".join(f"{c} array<double>" for c in sums))
    points = parts.select(*keys, "n", F.posexplode(F.arrays_zip(*sums)).alias("i", "p")).groupBy(*keys, "i").agg(F.sum("n").cast("int").alias("n"), *[(F.sum(f"p.{c}") / F.sum("n")).alias(c) for c in sums])
    power = F.greatest(F.col("pxx") * F.col("pyy"), F.lit(float(np.finfo(float).eps)))
    root = F.sqrt(power)
    c = F.least(F.lit(1.0), (F.col("re") ** 2 + F.col("im") ** 2) / power)
    values = {"f": F.col("i") * (fs / nfft), "c": c, "ic": F.abs("im") / root, "angle": F.atan2("im", "re"), "re": F.col("re") / root, "im": F.col("im") / root}
    curve = F.array_sort(F.collect_list(F.struct("i", *[v.alias(k) for k, v in values.items()])))
    out = points.groupBy(*keys).agg(F.max("n").alias("n_segments"), curve.alias("curve"))
    return out.select(*keys, "n_segments", *[F.col(f"curve.{k}").alias(k) for k in values])


def curve_points(curves: DataFrame, keys: list[str]) -> DataFrame:
    """The curves' arrays as rows: keys, i, f, c, ic, angle, re, im."""
    names = ("f", "c", "ic", "angle", "re", "im")
    return curves.select(*keys, F.posexplode(F.arrays_zip(*names)).alias("i", "p")).select(*keys, "i", *[F.col(f"p.{n}").alias(n) for n in names])


def in_band(f: Column, low: float, high: float) -> Column:
    return f.between(low, high)
