"""Edges on streams: the last level and the last kept time are a run's whole state."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def falling_edges(samples: DataFrame, key: str, t: str, value: str, level: float) -> DataFrame:
    """key, t of samples under the level whose predecessor was not; samples of a run must arrive in order of their batches."""

    def run(k: tuple, parts: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        low = state.get[0] if state.exists else False
        rows = pd.concat([*parts]).sort_values(t)
        now = rows[value] < level
        before = now.shift(1, fill_value=low)
        if len(now):
            state.update((bool(now.iloc[-1]),))
        yield pd.DataFrame({key: k[0], t: rows.loc[now & ~before, t].astype(float)})

    kind = samples.schema[key].dataType.simpleString()
    return samples.select(key, F.col(t).cast("double").alias(t), value).groupBy(key).applyInPandasWithState(run, f"{key} {kind}, {t} double", "low boolean", "append", "NoTimeout")


def min_gap(edges: DataFrame, key: str, t: str, gap: float) -> DataFrame:
    """key, t of edges at least `gap` after the last kept one of their run."""

    def run(k: tuple, parts: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        last = state.get[0] if state.exists else None
        kept = []
        for x in sorted(pd.concat([*parts])[t].tolist()):
            if last is None or x - last >= gap:
                kept.append(x)
                last = x
        if last is not None:
            state.update((float(last),))
        yield pd.DataFrame({key: k[0], t: pd.Series(kept, dtype=float)})

    kind = edges.schema[key].dataType.simpleString()
    return edges.select(key, F.col(t).cast("double").alias(t)).groupBy(key).applyInPandasWithState(run, f"{key} {kind}, {t} double", "last double", "append", "NoTimeout")


def epochs(triggers: DataFrame, samples: DataFrame, before: float, after: float, late: str = "10 seconds") -> DataFrame:
    """run, trigger, ts, value: samples around triggers. triggers: run, trigger (timestamp); samples: run, ts, value."""
    a = triggers.select("run", "trigger").withWatermark("trigger", late)
    b = samples.select(F.col("run").alias("run_"), "ts", "value").withWatermark("ts", late)
    low, high = F.col("trigger") - F.make_interval(secs=F.lit(before)), F.col("trigger") + F.make_interval(secs=F.lit(after))
    return a.join(b, (F.col("run") == F.col("run_")) & (F.col("ts") >= low) & (F.col("ts") <= high)).drop("run_")
