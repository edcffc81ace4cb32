"""Lists of regions: names, places and channels, turned to the other half for movements of the left side."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .signals import FEW_TARGETS, mirrored

#: Name, place (MNI) and channels of the regions of the scalp list, which are those of the half opposite to the right hand.
SCALP = (
    ("fc5", (-50, 15, 55), "E56"),
    ("fc1", (-25, 20, 70), "E24"),
    ("fz", (0, 35, 60), "E14"),
    ("cz", (0, -20, 80), "E9"),
    ("c3", (-40, -20, 65), "E59"),
    ("t7", (-65, -20, 10), "E68"),
    ("cp5", (-60, -45, 25), "E75"),
    ("cp1", (-30, -45, 70), "E80"),
)
#: The motor list; the channels of four regions differ between its two versions.
MOTOR = (
    ("mot_lpcg", (-38, -24, 56), "E111 E112 E120 E133 E145"),
    ("mot_rpcg", (38, -24, 56), "E229 E230 E231 E234 E235"),
    ("pmd_l", (-26, -6, 58), "E90 E91 E92 E103 E146"),
    ("pmd_r", (26, -6, 58), "E239 E240 E235 E237 E230 E232 E233 E229"),
    ("sma_l", (-6, -6, 58), "E72 E133 E120 E112 E43 E17"),
    ("sma_r", (6, -6, 58), "E208 E216 E217 E226 E227 E236"),
    ("spl_l", (-24, -58, 62), "E76 E77 E78 E86 E87 E88"),
    ("spl_r", (24, -56, 62), "E154 E155 E156 E164 E165 E166"),
    ("ips_l", (-34, -46, 52), "E83 E84 E85 E94 E95 E96"),
    ("ips_r", (34, -44, 52), "E165 E156 E147 E157 E158"),
)
MOTOR_BATCH = {
    "pmd_l": "E90 E91 E92 E103 E146 E156",
    "pmd_r": "E239 E240 E242 E243 E245 E247 E248 E250 E251 E256",
    "sma_l": "E173 E174 E187 E188 E197 E198",
    "ips_r": "E145 E146 E147 E156 E157 E158",
}
#: Names of the scalp list on either half; those in the middle keep their channels.
OTHER_HALF = {"fc5": "fc6", "fc1": "fc2", "fz": "fz", "cz": "cz", "c3": "c4", "t7": "t8", "cp5": "cp6", "cp1": "cp2"}
MIDDLE = ("fz", "cz")


def listed(spark: SparkSession, which: str) -> DataFrame:
    """ord, name, x, y, z, labels of the list `scalp`, `motor` (for trials) or `motor_batch`."""
    rows = {"scalp": SCALP, "motor": MOTOR, "motor_batch": tuple((n, at, MOTOR_BATCH.get(n, c)) for n, at, c in MOTOR)}[which]
    return spark.createDataFrame([(k, n, *map(float, at), c.split()) for k, (n, at, c) in enumerate(rows, 1)], "ord int, name string, x double, y double, z double, labels array<string>")


def for_side(regions: DataFrame, runs: DataFrame, channels: DataFrame, keys: list[str]) -> DataFrame:
    """keys, ord, name, x, y, z, labels: each run's regions, those of side `sx` on the other half.

    There names change by `OTHER_HALF` (others stay), channels become their mirrors by geometry and x changes its sign, but for
    the regions in the middle. runs: keys, side; channels: keys, ch, x, y, z. A channel without a mirror, or not in the
    recording, stays. The list of regions is broadcast up to `FEW_TARGETS` rows.
    """
    few = regions.limit(FEW_TARGETS + 1).count() <= FEW_TARGETS
    own = runs.select(*keys, F.coalesce(F.lower("side") == "sx", F.lit(False)).alias("turn_")).join(F.broadcast(regions) if few else regions)
    low = F.lower("name")
    moved = F.col("turn_") & ~low.isin(*MIDDLE)
    names = F.create_map(*[F.lit(x) for pair in OTHER_HALF.items() for x in pair])
    name = F.when(F.col("turn_"), F.coalesce(names[low], F.col("name"))).otherwise(F.col("name"))
    x = F.when(moved & F.coalesce(F.abs("x") < float("inf"), F.lit(False)), -F.col("x")).otherwise(F.col("x"))
    rows = own.select(*keys, "ord", name.alias("name"), x.alias("x"), "y", "z", moved.alias("moved_"), F.posexplode_outer("labels").alias("at_", "label_"))
    mirror = mirrored(channels, keys).groupBy(*keys, F.lower("ch").alias("low_")).agg(F.min("mirror").alias("mirror_"))
    met = rows.withColumn("low_", F.when(F.col("moved_"), F.lower("label_"))).join(mirror, [*keys, "low_"], "left")
    label = F.struct("at_", F.coalesce("mirror_", "label_").alias("label"))
    lists = met.groupBy(*keys, "ord", "name", "x", "y", "z").agg(F.array_sort(F.collect_list(F.when(F.col("at_").isNotNull(), label))).alias("own_"))  # a region's channels
    return lists.select(*keys, "ord", "name", "x", "y", "z", F.col("own_.label").alias("labels"))


def summary(name: Column, n: Column, labels: Column) -> Column:
    """`name[n]:E1;E2` of a region."""
    return F.concat(name, F.lit("["), n.cast("string"), F.lit("]:"), F.array_join(labels, ";"))


def summaries(regions: DataFrame, keys: list[str]) -> DataFrame:
    """keys, text: the regions of each run in order, ` | ` between them. regions: keys, ord, name, n (channels found), labels."""
    parts = F.array_sort(F.collect_list(F.struct("ord", summary(F.col("name"), F.col("n"), F.col("labels")).alias("text"))))
    return regions.groupBy(*keys).agg(F.array_join(F.transform(parts, lambda p: p["text"]), " | ").alias("text"))
