"""Reports on keys: pre/post and side differences, rankings, pivots, ranges, trial tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.names import phase_order, short_label, side_of_name, subject_order
from ..functions.numbers import duration_class, finite, fixed, max_finite, mean_finite, min_finite, number_range
from .storage import cut


def first_by(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The first row of each key."""
    rest = [c for c in df.columns if c not in keys]
    return df.groupBy(*keys).agg(F.min_by(F.struct(*rest), F.struct(*order)).alias("r")).select(*keys, *[F.col(f"r.{c}").alias(c) for c in rest])


def difference(df: DataFrame, key: list[str], of: str, low: str, high: str, order: list[str], values: list[str]) -> DataFrame:
    """key and, for each value, its first at `low`, its first at `high`, and the difference; only keys that have both.

    One grouping does the work of joining the table with itself.
    """
    row = F.struct(*values)
    at = lambda v: F.min_by(F.when(F.col(of) == v, row), F.when(F.col(of) == v, F.struct(*order)))
    both = df.where(F.col(of).isin(low, high)).groupBy(*key).agg(at(low).alias("a"), at(high).alias("b")).where("a is not null and b is not null")
    return both.select(*key, *[x for v in values for x in (F.col(f"a.{v}").alias(f"{v}_{low}"), F.col(f"b.{v}").alias(f"{v}_{high}"), (F.col(f"b.{v}") - F.col(f"a.{v}")).alias(f"{v}_delta"))])


def trend(delta: Column, flat: float) -> Column:
    return F.when(delta > flat, "up").when(delta < -flat, "down").when(delta.isNotNull(), "flat")


def drift_rows(runs: DataFrame, order: list[str]) -> DataFrame:
    """row_type, key, phase, side, drift_ppm: sessions, post less pre, and left less right, in one table.

    runs: key, phase, side, drift_ppm, and `order`.
    """
    sessions = runs.where("drift_ppm is not null").select(F.lit("session").alias("row_type"), "key", "phase", "side", "drift_ppm")
    phases = difference(runs.where("drift_ppm is not null"), ["key", "side"], "phase", "pre", "post", order, ["drift_ppm"])
    sides = difference(runs.where("drift_ppm is not null"), ["key", "phase"], "side", "dx", "sx", order, ["drift_ppm"])
    none = F.lit(None).cast("string")
    out = sessions.unionByName(phases.select(F.lit("post_pre").alias("row_type"), "key", none.alias("phase"), "side", F.col("drift_ppm_delta").alias("drift_ppm")))
    return out.unionByName(sides.select(F.lit("sx_dx").alias("row_type"), "key", "phase", none.alias("side"), F.col("drift_ppm_delta").alias("drift_ppm")))


def ranked_pivot(df: DataFrame, row: str, column: str, value: str, columns: list, prefix: str, order: str | None = None) -> DataFrame:
    """row, rank (by mean value: missing ones first, then the largest), mean, and the mean for each of the columns.

    Equal means go by the least `order` of their rows, the order in which the rows are given, or else by row.
    """
    wide = df.groupBy(row).pivot(column, columns).agg(F.avg(value))
    means = df.groupBy(row).agg(F.avg(value).alias("mean"), F.min(order or row).alias("order_"))
    ranked = running_sums(means, [], [F.desc_nulls_first("mean"), "order_"], F.lit(1))
    out = ranked.select(row, "mean", F.col("upto_").cast("int").alias("rank")).join(wide, row)
    return out.select(row, "rank", "mean", *[F.col(f"`{c}`").alias(f"{prefix}{c}") for c in columns])


def total_and_detail(df: DataFrame, by: str, value: str) -> DataFrame:
    """by (`all` for the total), n, mean, max."""
    sets = df.groupingSets([[by], []], by).agg(F.grouping(by).alias("g"), F.count(value).alias("n"), F.avg(value).alias("mean"), F.max(value).alias("max"))
    return sets.select(F.when(F.col("g") == 1, "all").otherwise(F.col(by).cast("string")).alias(by), "n", "mean", "max")


def trial_table(trials: DataFrame, keys: list[str], duration: str) -> DataFrame:
    """trials with their class and the run's quartiles and flags (under the first, over the third)."""
    q = quantiles(trials, keys, duration, {"q1": 0.25, "q2": 0.5, "q3": 0.75}, "n1")
    d = F.col(duration)
    return same_keys(trials, q, keys).withColumns({"duration_class": duration_class(d), "is_short": d <= F.col("q1"), "is_long": d >= F.col("q3")})


def same_keys(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """left with the other columns of right, which has each key once; null keys are equal to each other."""
    if not keys:
        return left.join(F.broadcast(right))  # one row
    named = right.withColumnsRenamed({k: f"{k}_of_" for k in keys})
    on = F.lit(True)
    for k in keys:
        on &= F.col(k).eqNullSafe(F.col(f"{k}_of_"))
    return left.join(named, on, how).drop(*[f"{k}_of_" for k in keys])


def by_range(df: DataFrame, keys: list[str], order: list[Column | str]) -> DataFrame:
    """df with part_: ranges of (keys, order) of about equal size, numbered in order.

    The ranges' ends come from a sample of the rows, so neither a key with most of the rows nor a few far values make a part large;
    they are drawn once, since the table is kept. Rows that are equal in all of (keys, order) share a part.
    """
    return cut(df.repartitionByRange(*keys, *order).withColumn("part_", F.spark_partition_id()))


def running_sums(df: DataFrame, keys: list[str], order: list[Column | str], weight: Column) -> DataFrame:
    """df with part_, upto_ (the key's weights up to the row, in `order`) and all_ (the key's weights); nulls are where `order` has them."""
    own = by_range(df.withColumn("weight_", weight), keys, order)
    sums = own.groupBy(*keys, "part_").agg(F.sum("weight_").alias("sum_"))
    earlier = F.sum("sum_").over(Window.partitionBy(*keys).orderBy("part_")) - F.col("sum_")
    before = sums.select(*keys, "part_", earlier.alias("before_"), F.sum("sum_").over(Window.partitionBy(*keys)).alias("all_"))
    inside = Window.partitionBy(*keys, "part_").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    joined = same_keys(own, before, [*keys, "part_"])
    return joined.withColumn("upto_", F.col("before_") + F.sum("weight_").over(inside)).drop("before_", "weight_")


def quantiles(df: DataFrame, keys: list[str], value: str, shares: dict[str, float], rule: str = "n1") -> DataFrame:
    """keys and exact quantiles (new column -> share) of the finite values; null for keys without any.

    rule: `n1` puts the first of the sorted values at 0 and the last at 1, `mid` the k-th of n at (k - 0.5) / n; linear between them.
    A key's different values are counted, summed up range by range, and the two around each place picked, so no key is gathered.
    """
    v = finite(F.col(value).cast("double"))
    counts = df.groupBy(*keys, v.alias("v_")).agg(F.count("*").alias("n_"))
    upto = running_sums(counts.where("v_ is not null"), keys, ["v_"], F.col("n_"))
    n = F.col("all_")
    at = {name: F.lit(q) * (n - 1) + 1 if rule == "n1" else F.least(F.greatest(F.lit(q) * n + 0.5, F.lit(1.0)), n.cast("double")) for name, q in shares.items()}
    ends = [F.min(F.when(F.col("upto_") >= F.least(F.floor(x) + k, n), F.col("v_"))).alias(f"{name}_{k}_") for name, x in at.items() for k in (0, 1)]
    picked = upto.groupBy(*keys, "all_").agg(*ends)
    low, high = (lambda name: F.col(f"{name}_0_")), (lambda name: F.col(f"{name}_1_"))
    found = picked.select(*keys, *[(low(name) + (high(name) - low(name)) * (x - F.floor(x))).alias(name) for name, x in at.items()])
    return same_keys(df.select(*keys).distinct(), found, keys, "left") if keys else found


def false_discovery(df: DataFrame, keys: list[str], p: str) -> DataFrame:
    """df with q, the smallest false-discovery rate at which p is found; rows without p keep none, equal p share theirs.

    Only a key's different values are put in order, range by range.
    """
    counts = df.where(F.col(p).isNotNull()).groupBy(*keys, p).agg(F.count("*").alias("n_"))
    ranked = running_sums(counts, keys, [p], F.col("n_")).withColumn("q_", F.col(p) * F.col("all_") / F.col("upto_"))
    least = ranked.groupBy(*keys, "part_").agg(F.min("q_").alias("least_"))
    later = F.min("least_").over(Window.partitionBy(*keys).orderBy(F.desc("part_")).rowsBetween(Window.unboundedPreceding, -1))
    after = least.select(*keys, "part_", later.alias("after_"))
    down = Window.partitionBy(*keys, "part_").orderBy(F.desc(p)).rowsBetween(Window.unboundedPreceding, 0)
    rates = same_keys(ranked, after, [*keys, "part_"]).select(*keys, p, F.least(F.lit(1.0), F.min("q_").over(down), "after_").alias("q"))
    found = same_keys(df.where(F.col(p).isNotNull()), rates, [*keys, p])
    return found.unionByName(df.where(F.col(p).isNull()).withColumn("q", F.lit(None).cast("double")))


def mid_ranks(df: DataFrame, keys: list[str], names: dict[str, str]) -> DataFrame:
    """df with mean ranks (new column -> column of numbers); equal values share theirs, nulls come last."""
    out = df
    for new, c in names.items():
        counts = df.groupBy(*keys, c).agg(F.count("*").alias("n_"))
        ranks = running_sums(counts, keys, [F.asc_nulls_last(c)], F.col("n_")).select(*keys, c, (F.col("upto_") - (F.col("n_") - 1) / 2.0).alias(new))
        out = same_keys(out, ranks, [*keys, c])
    return out


def spearman(df: DataFrame, keys: list[str], x: str, y: str, least: int = 6) -> DataFrame:
    """keys, n, rho over rows with both values; null for fewer than `least`."""
    ranks = mid_ranks(df.where(F.col(x).isNotNull() & F.col(y).isNotNull()), keys, {"rx_": x, "ry_": y})
    return ranks.groupBy(*keys).agg(F.count("*").alias("n"), F.corr("rx_", "ry_").alias("rho")).withColumn("rho", F.when(F.col("n") >= least, F.col("rho")))


def split_by_state(df: DataFrame, keys: list[str], power: str, value: str, share: float = 0.7, least: int = 6, each: int = 3) -> DataFrame:
    """keys, n (rows with a finite power), n_active (power at or above its percentile), mean of the finite values in active rows and in the
    others, delta and ratio. Under `least` rows n_active is 0; the means are null then and under `each` rows of either state.
    """
    real = df.withColumn("power_", finite(F.col(power).cast("double")))
    rows = same_keys(real, quantiles(real, keys, "power_", {"level_": share}, "mid"), keys)
    active = F.col("power_") >= F.col("level_")
    mean = lambda own: mean_finite(F.when(own, F.col(value).cast("double")))
    out = rows.groupBy(*keys).agg(F.count("power_").alias("n"), F.count_if(active).alias("n_active"), mean(active).alias("active"), mean(~active).alias("rest"))
    out = out.withColumn("n_active", F.when(F.col("n") >= least, F.col("n_active")).otherwise(0).cast("long"))
    enough = (F.col("n_active") >= each) & (F.col("n") - F.col("n_active") >= each)
    out = out.withColumns({c: F.when(enough, F.col(c)) for c in ("active", "rest")})
    return out.withColumns({"delta": F.col("active") - F.col("rest"), "ratio": F.when(F.abs("rest") > 2.220446049250313e-16, F.col("active") / F.col("rest"))})


def positive_mean(x: Column) -> Column:
    """Mean of the values above zero to nine digits, so that the order of the sum decides no later rounding; null without any."""
    return F.round(F.avg(F.when(finite(x) > 0, x)), 9)


def trial_means(cuts: DataFrame, keys: list[str]) -> DataFrame:
    """keys, mean_samples, mean_s: means of the positive numbers of a run's trials.

    Without a column n_samples, samples are counted from start_sample to end_sample, both inside; without duration_s (or duration_sec),
    run_median_duration_sec stands for it. A number is null if its columns miss.
    """
    has = set(cuts.columns)
    none = F.lit(None).cast("double")
    samples = F.col("n_samples") if "n_samples" in has else F.col("end_sample") - F.col("start_sample") + 1 if {"start_sample", "end_sample"} <= has else none
    seconds = next((F.col(c) for c in ("duration_s", "duration_sec", "run_median_duration_sec") if c in has), none)
    return cuts.groupBy(*keys).agg(positive_mean(samples.cast("double")).alias("mean_samples"), positive_mean(seconds.cast("double")).alias("mean_s"))


#: The ranges of the final table, by metric: heading and digits.
RANGES = {"beta_mean": ("Beta mean", 3), "beta_peak": ("Beta peak", 3), "beta_peak_hz": ("Beta Peak Hz", 2), "z_mean": ("zCoh mean", 3), "z_peak": ("zCoh peak", 3)}


def final_table(runs: DataFrame, metrics: DataFrame, cuts: DataFrame, keys: list[str]) -> DataFrame:
    """One row of texts for each good run, with the ranges of its metrics and the means of its trials, and the columns to sort by.

    runs: keys (pair and phase among them), status, eeg_mode, n_trials, n_synergies, vaf; metrics: keys, the metrics of `RANGES` and q;
    cuts: keys and the columns of `trial_means`. Runs on sources stand for all as soon as there is one.
    """
    good = runs.where(F.trim(F.lower("status")) == "ok").withColumn("source_", F.trim(F.lower("eeg_mode")) == "source_net")
    any_source = good.agg(F.coalesce(F.max("source_"), F.lit(False)).alias("any_"))  # one row
    own = good.join(F.broadcast(any_source)).where(~F.col("any_") | F.col("source_")).drop("source_", "any_")
    ranges = metrics.groupBy(*keys).agg(*[f(F.col(m)).alias(f"{m}_{n}") for m in RANGES for f, n in ((min_finite, "low"), (max_finite, "high"))], min_finite(F.col("q")).alias("q_min"))
    means = trial_means(cuts, keys)
    wide = own.join(ranges, keys, "left").join(means, keys, "left")
    named = {heading: number_range(F.col(f"{m}_low"), F.col(f"{m}_high"), d) for m, (heading, d) in RANGES.items()}
    side = side_of_name(F.col("pair"))
    return wide.select(
        short_label(F.col("pair"), F.lower("phase")).alias("Run"), F.lower("phase").alias("Phase"), fixed(F.col("n_trials").cast("double"), 0, "").alias("Trials"), fixed(F.col("mean_samples"), 1, "").alias("Mean samples"),
        fixed(F.col("mean_s"), 3, "").alias("Mean sec"), fixed(F.col("n_synergies").cast("double"), 0, "").alias("Synergies"), fixed(F.col("vaf"), 3, "").alias("VAF"), fixed(F.col("q_min"), 4, "").alias("FDR q min"),
        *[v.alias(k) for k, v in named.items()],
        subject_order(F.col("pair")).alias("subject_order"), phase_order(F.col("phase")).alias("phase_order"), F.when(side == "dx", 1).when(side == "sx", 2).otherwise(3).alias("side_order"),
    )
