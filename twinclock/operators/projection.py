"""Signals of brain regions from sensors: kernel, projection and spatial filter as tables of matrix entries, sensors in blocks of time.

Entries are rows (keys, row, column, v), numbered from 1; what is missing is zero. The short side goes first: a region's mean over its
voxels is one row of the spatial filter, which meets the projection and then the kernel, so no product of two large matrices is formed.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .signals import nearest

EPS = 2.220446049250313e-16
CHANNELS = 32  # channels of a block of sensors
ORDERS = ((3, 2, 1), (3, 1, 2), (2, 3, 1), (2, 1, 3), (1, 3, 2), (1, 2, 3))  # Fixed values: orders of the axes, the first that fits counts


def product(left: DataFrame, right: DataFrame, keys: list[str], outer: str, inner: str, column: str) -> DataFrame:
    """keys, outer, column, v: sums over `inner` of left (keys, outer, inner, v) times right (keys, inner, column, v)."""
    both = left.withColumnRenamed("v", "v_").join(right, [*keys, inner])
    return both.groupBy(*keys, outer, column).agg(F.sum(F.col("v_") * F.col("v")).alias("v"))


def combined(projection: DataFrame, kernel: DataFrame, keys: list[str]) -> tuple[DataFrame, DataFrame]:
    """projection (keys, i, j, v), and kernel (keys, j, ch, v) of each recording that go together.

    Where the projection has as many columns as the kernel has rows, it stays. Else the kernel's rows are three directions of
    each place and their mean is taken, by a projection made for it; rows that are no multiple of three are an error.
    """
    rows = kernel.groupBy(*keys).agg(F.max("j").alias("rows_"))
    columns = projection.groupBy(*keys).agg(F.max("j").alias("columns_"))
    fit = rows.join(columns, keys, "left").withColumn("fits_", F.coalesce(F.col("rows_") == F.col("columns_"), F.lit(False)))
    bad = F.raise_error(F.concat(F.lit("kernel of "), F.col("rows_").cast("string"), F.lit(" rows fits no projection")))
    fit = fit.withColumn("fits_", F.when(~F.col("fits_") & (F.col("rows_") % 3 != 0), bad.cast("boolean")).otherwise(F.col("fits_")))
    own = projection.join(fit.where("fits_").select(*keys), keys)
    made = fit.where("not fits_").select(*keys, F.explode(F.sequence(F.lit(1), F.col("rows_").cast("int"))).alias("j"))
    made = made.select(*keys, F.expr("(j - 1) div 3 + 1").alias("i"), F.col("j").cast("long").alias("j"), F.lit(1 / 3).alias("v"))
    kind = dict(projection.dtypes)
    return own.select(*keys, "i", "j", "v").unionByName(made.select(*keys, F.col("i").cast(kind["i"]).alias("i"), F.col("j").cast(kind["j"]).alias("j"), "v")), kernel


def region_filters(voxels: DataFrame, spatial: DataFrame, projection: DataFrame, kernel: DataFrame, regions: DataFrame, keys: list[str], k: int = 25) -> tuple[DataFrame, DataFrame]:
    """Filters (keys, roi, ch, v) of every region, and the map of regions: keys, roi, n_voxels, voxel and distance of the nearest.

    voxels: keys, voxel, x, y, z, inside; spatial: keys, voxel, i, v; projection: keys, i, j, v; kernel: keys, j, ch, v; regions: name, x, y, z.
    A region is the mean over its k nearest voxels inside; where that is zero throughout, the nearest voxel alone.
    """
    inside = voxels.where("inside").select(*keys, F.col("voxel").alias("point"), "x", "y", "z")
    near = nearest(inside, regions, k, keys=keys).select(*keys, F.col("name").alias("roi"), F.col("point").alias("voxel"), "distance2", "rank")
    table = near.groupBy(*keys, "roi").agg(F.count("*").alias("n_voxels"), F.min_by("voxel", "rank").alias("voxel"), F.sqrt(F.min("distance2")).alias("distance"))
    met = near.join(spatial, [*keys, "voxel"])
    rows = met.groupBy(*keys, "roi", "i").agg(F.sum("v").alias("sum_"), F.sum(F.when(F.col("rank") == 1, F.col("v"))).alias("first_"))
    any_ = F.max((F.abs("sum_") > 0).cast("int")).over(Window.partitionBy(*keys, "roi")) == 1
    weight = rows.withColumn("any_", any_).join(table.select(*keys, "roi", "n_voxels"), [*keys, "roi"])
    weight = weight.select(*keys, "roi", "i", F.when(F.col("any_"), F.col("sum_") / F.col("n_voxels")).otherwise(F.coalesce("first_", F.lit(0.0))).alias("v"))
    projection, kernel = combined(projection, kernel, keys)
    return product(product(weight, projection, keys, "roi", "i", "j"), kernel, keys, "roi", "j", "ch"), table


def filtered(sensors: DataFrame, filters: DataFrame, keys: list[str]) -> DataFrame:
    """keys, roi, block, samples: sensors (keys, ch, block, samples) weighted by each region's filter.

    Blocks of time by blocks of channels are multiplied by themselves, then the blocks of channels add up.
    """
    rows = filters.groupBy(*keys, "ch").agg(F.map_from_entries(F.collect_list(F.struct("roi", "v"))).alias("weights"))  # the few regions
    part = F.floor((F.dense_rank().over(Window.partitionBy(*keys).orderBy("ch")) - 1) / CHANNELS).cast("int")
    parts = rows.withColumn("part", part)  # a recording's few hundred channels
    met = sensors.select(*keys, "ch", "block", "samples").join(parts, [*keys, "ch"])
    kinds = ", ".join(f"{c} {met.schema[c].dataType.simpleString()}" for c in [*keys, "block"])
    roi = filters.schema["roi"].dataType.simpleString()

    def run(own: pd.DataFrame) -> pd.DataFrame:
        head = {c: own[c].iloc[0] for c in [*keys, "block"]}
        names = sorted({r for w in own["weights"] for r in dict(w)})
        w = np.array([[dict(x).get(r, 0.0) for x in own["weights"]] for r in names])
        return pd.DataFrame([{**head, "roi": r, "samples": s} for r, s in zip(names, w @ np.vstack(own["samples"].to_list()), strict=True)])

    partial = met.groupBy(*keys, "block", "part").applyInPandas(run, f"{kinds}, roi {roi}, samples array<double>")
    lists = partial.groupBy(*keys, "roi", "block").agg(F.collect_list("samples").alias("all_"))  # one of each block of channels
    add = lambda a, b: F.zip_with(a, b, lambda x, y: x + y)
    return lists.select(*keys, "roi", "block", F.aggregate(F.slice("all_", F.lit(2), F.size("all_")), F.col("all_")[0], add).alias("samples"))


def standard(blocks: DataFrame, keys: list[str]) -> DataFrame:
    """blocks (keys, block, samples) less each signal's mean, over its deviation (n - 1) if that is above zero."""
    total = F.aggregate("samples", F.lit(0.0), lambda s, x: s + x)
    mean = blocks.groupBy(*keys).agg((F.sum(total) / F.sum(F.size("samples"))).alias("mean_"), F.sum(F.size("samples")).alias("n_"))
    own = blocks.join(mean, keys)
    square = F.aggregate(F.transform("samples", lambda x: (x - F.col("mean_")) * (x - F.col("mean_"))), F.lit(0.0), lambda s, x: s + x)
    spread = own.groupBy(*keys).agg(F.sqrt(F.sum(square) / F.nullif(F.first("n_") - 1, F.lit(0).cast("long"))).alias("sd_"))
    scale = F.when(F.col("sd_") > EPS, F.col("sd_")).otherwise(1.0)
    out = own.join(spread, keys)
    return out.select(*keys, "block", F.transform("samples", lambda x: (x - F.col("mean_")) / scale).alias("samples"))


def source_regions(sensors: DataFrame, voxels: DataFrame, spatial: DataFrame, projection: DataFrame, kernel: DataFrame, regions: DataFrame, keys: list[str]) -> tuple[DataFrame, DataFrame]:
    """Standardised signals of the regions (keys, roi, block, samples), and the map of regions."""
    filters, table = region_filters(voxels, spatial, projection, kernel, regions, keys)
    return standard(filtered(sensors, filters, keys), [*keys, "roi"]), table


def rate_of_axis(times, default: float = 1000.0):
    """Samples a second of an array of milliseconds: by the median step, `default` for fewer than two."""
    steps = F.sort_array(F.zip_with(F.slice(times, 2, F.greatest(F.size(times) - 1, F.lit(0))), F.slice(times, 1, F.greatest(F.size(times) - 1, F.lit(0))), lambda a, b: a - b))
    n = F.size(steps)
    middle = (F.get(steps, F.floor((n - 1) / 2).cast("int")) + F.get(steps, F.floor(n / 2).cast("int"))) / 2
    return F.when(F.size(times) >= 2, 1000 / F.abs(middle)).otherwise(default)


def trial_tensors(blocks: DataFrame, heads: DataFrame, keys: list[str]) -> DataFrame:
    """keys, trial, c (from 1), ch (label), fs, samples of blocks of trials, channels and times whose axes come in any order.

    heads: keys, dims (array of three), labels and times (arrays, empty if unknown); blocks: keys, start (from 0), values: the cells in
    order, the first axis fastest, cut anywhere. The axes are those of the first of `ORDERS` whose channels fit the labels
    and whose times fit the time axis; none fits: trials, channels, times. Channels without labels are E1, E2 and so on.
    """
    size = lambda axis: F.get("dims", F.lit(axis - 1))
    fits = lambda o: ((F.size("labels") == 0) | (size(o[1]) == F.size("labels"))) & ((F.size("times") == 0) | (size(o[2]) == F.size("times")))
    order = F.coalesce(*[F.when(fits(o), F.array(*[F.lit(a) for a in o])) for o in ORDERS], F.array(F.lit(1), F.lit(2), F.lit(3)))
    own = heads.select(*keys, "dims", "labels", order.alias("order"), rate_of_axis(F.col("times")).alias("fs"))
    cells = blocks.join(own, keys).select(*keys, "dims", "order", "labels", "fs", "start", F.posexplode("values").alias("pos", "v"))
    flat = F.col("start").cast("long") + F.col("pos")
    d1, d2 = size(1).cast("long"), size(2).cast("long")
    at = F.array((flat % d1), F.floor(flat / d1) % d2, F.floor(flat / (d1 * d2)))
    place = lambda k: F.get("at", F.get("order", F.lit(k)) - 1)
    cells = cells.withColumn("at", at).select(*keys, "labels", "fs", (place(0) + 1).alias("trial"), (place(1) + 1).alias("c"), place(2).alias("t"), "v")
    rows = cells.groupBy(*keys, "fs", "labels", "trial", "c").agg(F.transform(F.array_sort(F.collect_list(F.struct("t", "v"))), lambda x: x["v"]).alias("samples"))  # a trial's samples
    label = F.coalesce(F.get("labels", (F.col("c") - 1).cast("int")), F.concat(F.lit("E"), F.col("c").cast("string")))
    return rows.select(*keys, "trial", "c", label.alias("ch"), "fs", "samples")
