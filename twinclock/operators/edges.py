"""Trigger edges: falling edges of sampled levels, minimum gaps between kept edges, plausible counts, counters."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.numbers import upper_median
from ..functions.walks import walk

FIRST_GAP = 0.12
HEAD = 20_000  # samples whose median sets the level


def falling_edges(samples: DataFrame, keys: list[str], order: list[str], value: str) -> DataFrame:
    """The samples (with their ordinal i, from 1) at which the value falls under its run's level.

    The level is halfway between the upper median of the first `HEAD` samples and the least value. A first sample under
    the level counts. Null values take no part.
    """
    w = Window.partitionBy(*keys).orderBy(*order)
    numbered = samples.where(F.col(value).isNotNull()).withColumn("i", F.row_number().over(w))
    levels = numbered.groupBy(*keys).agg(((upper_median(F.collect_list(F.when(F.col("i") <= HEAD, F.col(value)))) + F.min(value)) / 2).alias("level"))
    low = numbered.join(levels, keys).withColumn("low", F.col(value) < F.col("level"))
    return low.withColumn("before", F.lag("low", 1, False).over(w)).where("low and not before").drop("low", "before")


def min_gap(edges: DataFrame, keys: list[str], t: str, gap: float) -> DataFrame:
    """keys and t of the edges that are kept: the first, then each that is at least `gap` after the last kept one."""

    def walker():
        last = None

        def step(row):
            nonlocal last
            if row is not None and row[0] is not None and (last is None or row[0] - last >= gap):
                last = row[0]
                yield (last,)

        return step

    return walk(edges.select(*keys, F.col(t).cast("double").alias(t)), keys, [t], walker, {t: pa.float64()}, f"{t} double")


def keep_gap(times: np.ndarray, gap: float) -> np.ndarray:
    out: list[float] = []
    for x in times.tolist():
        if not out or x - out[-1] >= gap:
            out.append(x)
    return np.array(out)


def clean_edges(edges: DataFrame, expected: DataFrame, keys: list[str], t: str = "t", gap: str = "gap", n: str = "expected") -> DataFrame:
    """keys, t, n_raw, n_clean, min_gap_s, ratio: gaps widen by half until the count is near the expected one.

    expected: keys, the first gap and the expected count of each run and channel. Channels without expected events keep
    `FIRST_GAP` and every edge that it leaves.
    """

    def run(part: pd.DataFrame) -> pd.DataFrame:
        raw = np.sort(part[t].to_numpy(float))
        wide, want = float(part[gap].iloc[0]), int(part[n].iloc[0])
        kept = keep_gap(raw, wide)
        while want > 0 and len(kept) > max(np.ceil(1.6 * want), want + 8) and wide < 0.5:
            wide *= 1.5
            kept = keep_gap(raw, wide)
        own = {k: part[k].iloc[0] for k in keys}
        return pd.DataFrame({**own, t: kept, "n_raw": len(raw), "n_clean": len(kept), "min_gap_s": wide, "ratio": len(kept) / want if want > 0 else None})

    joined = edges.join(expected, keys, "left").withColumns({gap: F.coalesce(gap, F.lit(FIRST_GAP)), n: F.coalesce(n, F.lit(0))})
    schema = ", ".join(f"{k} {joined.schema[k].dataType.simpleString()}" for k in keys)
    return joined.groupBy(*keys).applyInPandas(run, f"{schema}, {t} double, n_raw long, n_clean long, min_gap_s double, ratio double")


def plausible_count(n_edges, n_expected):
    """Whether so many edges fit the expected events; true if none are expected."""
    low, high = F.greatest(F.lit(10), F.floor(n_expected * 0.6)), F.ceil(n_expected * 1.8)
    return F.when(n_expected <= 0, True).otherwise(n_edges.between(low, high))


def sync_gap(step):
    """First gap of the dense channel: a quarter of the reference's median step, 4 to 50 ms; 8 ms if unknown."""
    return F.coalesce(F.least(F.greatest(step * 0.25, F.lit(0.004)), F.lit(0.05)), F.lit(0.008))


def step_median(events: DataFrame, keys: list[str], order: list[str], t: str) -> DataFrame:
    w = Window.partitionBy(*keys).orderBy(*order)
    return events.withColumn("step", F.col(t) - F.lag(t).over(w)).groupBy(*keys).agg(F.median("step").alias("step_median"))


def code_counts(events: DataFrame, keys: list[str], code: str) -> DataFrame:
    return events.groupBy(*keys, code).agg(F.count("*").alias("n"))


def counters(events: DataFrame, keys: list[str], order: list[str], code: str) -> DataFrame:
    """gidx, the event's number in its run, and cidx, its number among those of its code."""
    every = Window.partitionBy(*keys).orderBy(*order)
    return events.withColumns({"gidx": F.row_number().over(every), "cidx": F.row_number().over(Window.partitionBy(*keys, code).orderBy(*order))})
