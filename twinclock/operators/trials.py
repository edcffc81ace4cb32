"""Task events and trials: valid ordinals, as-of windows, reconstructed events, movement segments on the sample grid."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.numbers import clamp

#: Seconds from the trigger to start, keyboard, beep and end where no template says otherwise.
OFFSETS = {"start": -2.2, "keyboard": 0.0, "beep": 0.0, "end": 0.64}
KEY_GAP = 0.05


def paired(keyboard: DataFrame, beep: DataFrame, keys: list[str]) -> DataFrame:
    """keys, k, t_keyboard, t_beep, t_next (the next keyboard): the k-th of both. Inputs: keys, k, t."""
    w = Window.partitionBy(*keys).orderBy("k")
    own = keyboard.withColumn("t_next", F.lead("t").over(w)).withColumnRenamed("t", "t_keyboard")
    return own.join(beep.withColumnRenamed("t", "t_beep"), [*keys, "k"]).select(*keys, "k", "t_keyboard", "t_beep", "t_next")


def valid(pairs: DataFrame, gap: float = KEY_GAP) -> DataFrame:
    """Pairs whose beep comes more than `gap` after their keyboard and before the next one."""
    return pairs.where((F.col("t_keyboard") + gap < F.col("t_beep")) & (F.col("t_next").isNull() | (F.col("t_beep") < F.col("t_next"))))


def clamped(t: Column, duration: Column) -> Column:
    return clamp(t, F.lit(0.0), F.greatest(duration - 1e-6, F.lit(0.0)))


def reconstructed(pairs: DataFrame, keys: list[str], duration: Column, offsets: dict[str, float] | None = None) -> DataFrame:
    """keys, trial, t_start, t_keyboard, t_beep, t_end of trials in order before and after they are clamped to the recording.

    A trial needs start < keyboard < beep < end < next keyboard. Trials are numbered anew among those that stay.
    """
    off = OFFSETS | (offsets or {})
    times = pairs.select(*keys, "k", (F.col("t_keyboard") + off["start"]).alias("t_start"), (F.col("t_keyboard") + off["keyboard"]).alias("t_keyboard"), (F.col("t_beep") + off["beep"]).alias("t_beep"), (F.col("t_beep") + off["end"]).alias("t_end"), "t_next", duration.alias("duration"))
    in_order = (F.col("t_start") < F.col("t_keyboard")) & (F.col("t_keyboard") < F.col("t_beep")) & (F.col("t_beep") < F.col("t_end")) & (F.col("t_next").isNull() | (F.col("t_end") < F.col("t_next")))
    names = ("t_start", "t_keyboard", "t_beep", "t_end")
    kept = times.where(in_order).withColumns({n: clamped(F.col(n), F.col("duration")) for n in names}).where(in_order)
    return kept.withColumn("trial", F.row_number().over(Window.partitionBy(*keys).orderBy("k"))).select(*keys, "trial", *names)


def task_events(trials: DataFrame, triggers: DataFrame, keys: list[str]) -> DataFrame:
    """keys, t, code: the trials' four events and the triggers (keys, t, code) together."""
    four = F.explode(F.array(*[F.struct(F.col(f"t_{c}").alias("t"), F.lit(c).alias("code")) for c in OFFSETS]))
    return trials.select(*keys, four.alias("e")).select(*keys, "e.t", "e.code").unionByName(triggers.select(*keys, "t", "code"))


def template_offsets(templates: DataFrame, keys: list[str]) -> DataFrame:
    """keys, k (from the last), code, offset: task events of a template against its triggers, aligned at the tail.

    templates: keys, code (DIN4, DIN5, start, keyboard, beep, end), t. Start and keyboard refer to DIN4, beep and end to DIN5.
    """
    tail = templates.withColumn("k", F.row_number().over(Window.partitionBy(*keys, "code").orderBy(F.desc("t"))))
    base = tail.where(F.col("code").isin("DIN4", "DIN5")).select(*keys, "k", F.col("code").alias("ref"), F.col("t").alias("t_ref"))
    own = tail.where(F.col("code").isin(*OFFSETS)).withColumn("ref", F.when(F.col("code").isin("start", "keyboard"), "DIN4").otherwise("DIN5"))
    return own.join(base, [*keys, "k", "ref"]).select(*keys, "k", "code", (F.col("t") - F.col("t_ref")).alias("offset"))


def resampled(values: Column, n: Column) -> Column:
    """The array stretched to n values, linear in between; one value is repeated."""
    size = F.size(values)
    place = lambda i: i * (size - 1) / F.greatest(n - 1, F.lit(1))
    value = lambda i: F.get(values, F.floor(place(i)).cast("int")) + (F.get(values, F.least(F.floor(place(i)).cast("int") + 1, size - 1)) - F.get(values, F.floor(place(i)).cast("int"))) * (place(i) - F.floor(place(i)))
    return F.when((n <= 0) | (size == 0), F.array().cast("array<double>")).otherwise(F.transform(F.sequence(F.lit(0), (n - 1).cast("int")), value))


def first_before_next(beeps: DataFrame, starts: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """keys, t, t_next, t_start: for each beep the first start after it and before the next beep; beeps without one go.

    Both streams are put in one order, and each beep looks ahead to the next start: no pairs are made.
    """
    rest = [c for c in order if c != "t"]
    both = beeps.select(*keys, "t", *rest, F.lit(0).alias("is_start")).unionByName(starts.select(*keys, "t", *rest, F.lit(1).alias("is_start")))
    # from the last row to the first, so that the frame only grows
    later = Window.partitionBy(*keys).orderBy(F.desc("t"), "is_start", *[F.desc(c) for c in rest]).rowsBetween(Window.unboundedPreceding, -1)
    next_ = lambda kind: F.last(F.when(F.col("is_start") == kind, F.col("t")), ignorenulls=True).over(later)
    seen = both.select("*", next_(1).alias("t_start"), next_(0).alias("t_next"))
    return seen.where("is_start = 0 and t_start is not null and (t_next is null or t_start < t_next)").select(*keys, *rest, "t", "t_next", "t_start")


def least_samples(fs: float) -> int:
    return max(50, int(0.5 * fs + 0.5))


def most_samples(fs: float) -> int:
    return max(1, int(3 * fs + 0.5))


def window_samples(t_from: Column, t_to: Column, fs: float, n_samples: Column) -> tuple[Column, Column]:
    """First and last sample (from 1) of a stretch of time, kept within the recording."""
    return F.greatest(F.floor(t_from * fs) + 1, F.lit(1)).cast("long"), F.least(F.ceil(t_to * fs), n_samples).cast("long")


def event_trials(windows: DataFrame, keys: list[str], fs: float, n_samples: Column, clamp_long: bool = True) -> DataFrame:
    """keys, i1, i2 (from 1, both inside) of windows (t to t_start); too short ones go, long ones are cut to three seconds."""
    first, last = window_samples(F.col("t"), F.col("t_start"), fs, n_samples)
    if clamp_long:
        last = F.least(last, first + most_samples(fs) - 1)
    own = windows.select(*keys, first.alias("i1"), last.alias("i2"))
    return own.where((F.col("i2") > F.col("i1")) & (F.col("i2") - F.col("i1") + 1 >= least_samples(fs)))


def seconds_to_trials(spans: DataFrame, keys: list[str], fs: float, n_samples: Column) -> DataFrame:
    """keys, i1, i2 of stretches of time (t_from to t_to) on another rate's grid; too short ones go."""
    first, last = window_samples(F.col("t_from"), F.col("t_to"), fs, n_samples)
    own = spans.select(*keys, first.alias("i1"), last.alias("i2"))
    return own.where((F.col("i2") > F.col("i1")) & (F.col("i2") - F.col("i1") + 1 >= least_samples(fs)))


def fixed_epochs(beeps: DataFrame, keys: list[str], fs: float, n_samples: Column, before: float = 0.199, after: float = 2.0) -> DataFrame:
    """keys, t, i1, i2 of epochs around beeps, both ends inside, that lie wholly within the recording and are not too short."""
    start, end = F.col("t") - before, F.col("t") + after
    inside = beeps.where((start >= 0) & (end <= (n_samples - 1) / fs))
    own = inside.select(*keys, "t", (F.floor(start * fs) + 1).cast("long").alias("i1"), (F.floor(end * fs) + 1).cast("long").alias("i2"))
    return own.where((F.col("i2") > F.col("i1")) & (F.col("i2") - F.col("i1") + 1 >= least_samples(fs)))


def movement_windows(trials: DataFrame, keys: list[str]) -> DataFrame:
    """trials with t_from, t_to and rule_used: beep to start where any trial of the run has that order, else beep to end."""
    has = F.max((F.col("t_start") > F.col("t_beep")).cast("int")).over(Window.partitionBy(*keys)) == 1
    return trials.withColumns({"rule_used": F.when(has, "beep_to_start").otherwise("beep_to_end_fallback"), "t_from": F.col("t_beep"), "t_to": F.when(has, F.col("t_start")).otherwise(F.col("t_end"))}).where("t_to > t_from")


def segments(windows: DataFrame, keys: list[str], fs: float | Column, n_samples: Column) -> DataFrame:
    """keys, trial, rule_used, segment_id, times on both clocks, sample_start, sample_stop, n_samples, duration_s.

    windows: keys, trial, rule_used, t_from, t_to and the clock map a, b. Samples count from 1, both ends inside.
    """
    back = lambda t: (F.col(t) - F.col("b")) / F.col("a")
    own = windows.withColumns({"s_from": back("t_from"), "s_to": back("t_to"), "n_": n_samples})
    own = own.withColumns({"sample_start": F.greatest(F.floor(F.col("s_from") * fs) + 1, F.lit(1)).cast("long"), "sample_stop": F.least(F.ceil(F.col("s_to") * fs), F.col("n_")).cast("long")}).where("sample_stop >= sample_start")
    size = F.col("sample_stop") - F.col("sample_start") + 1
    return own.select(*keys, "trial", "rule_used", F.row_number().over(Window.partitionBy(*keys).orderBy("sample_start", "trial")).cast("long").alias("segment_id"), "t_from", "t_to", "s_from", "s_to", "sample_start", "sample_stop", size.alias("n_samples"), (size / fs).alias("duration_s"))


def cut_samples(signals: DataFrame, spans: DataFrame, keys: list[str], least: int = 50) -> DataFrame:
    """signals (keys, ch, samples array) cut at spans (keys, trial, i1, i2): keys, ch, trial, samples; short or non-finite ones go."""
    part = F.slice("samples", F.col("i1").cast("int"), (F.col("i2") - F.col("i1") + 1).cast("int"))
    cut = signals.join(spans, keys).select(*keys, "ch", "trial", part.alias("samples"))
    return cut.where((F.size("samples") >= least) & F.forall("samples", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))))


def join_samples(cuts: DataFrame, keys: list[str]) -> DataFrame:
    """keys, ch, samples: the cuts of a channel one after the other, overlaps twice."""
    parts = F.transform(F.array_sort(F.collect_list(F.struct("trial", "samples"))), lambda x: x["samples"])
    return cuts.groupBy(*keys, "ch").agg(F.flatten(parts).alias("samples"))


def paired_trials(eeg: DataFrame, emg: DataFrame, keys: list[str], least: int = 50) -> DataFrame:
    """keys, trial, eeg, emg: matched by trial number and cut to the shorter; trials shorter than `least` go."""
    both = eeg.select(*keys, "trial", F.col("samples").alias("eeg")).join(emg.select(*keys, "trial", F.col("samples").alias("emg")), [*keys, "trial"])
    n = F.least(F.size("eeg"), F.size("emg"))
    return both.where(n >= least).select(*keys, "trial", F.slice("eeg", F.lit(1), n).alias("eeg"), F.slice("emg", F.lit(1), n).alias("emg"))
