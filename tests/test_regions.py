"""Lists of regions, their mirrored form by hand, and their text."""

from pyspark.sql import functions as F
from twinclock.operators import regions

CHANNELS = [("E56", 1.0, 3.0, 0.0), ("E57", 1.0, -3.1, 0.0), ("e59", 0.0, 2.0, 1.0), ("E60", 0.0, -2.0, 1.1), ("E14", 2.0, 0.0, 1.0)]


def test_regions_of_either_side(spark):
    runs = spark.createDataFrame([("r", "SX"), ("d", "dx"), ("none", None)], "run string, side string")
    channels = spark.createDataFrame([(r, *c) for r in ("r", "d") for c in CHANNELS], "run string, ch string, x double, y double, z double")
    own = regions.listed(spark, "scalp")
    extra = spark.createDataFrame([(9, "mine", None, 1.0, 2.0, ["E57", "E56", "X1"]), (10, "bare", 1.0, 1.0, 2.0, [])], own.schema)
    got = {(r.run, r.ord): (r.name, r.x, r.labels) for r in regions.for_side(own.unionByName(extra), runs, channels, ["run"]).collect()}
    assert len(got) == 30
    assert got["r", 1] == ("fc6", 50.0, ["E57"]) and got["r", 5] == ("c4", 40.0, ["E60"])
    assert got["r", 3] == ("fz", 0.0, ["E14"]) and got["r", 2] == ("fc2", 25.0, ["E24"])  # not in this recording
    assert got["r", 9] == ("mine", None, ["E56", "E57", "X1"]) and got["r", 10] == ("bare", -1.0, [])
    for r in ("d", "none"):
        assert got[r, 1] == ("fc5", -50.0, ["E56"]) and got[r, 9] == ("mine", None, ["E57", "E56", "X1"])


def test_lists_and_text(spark):
    motor, batch = ({r.name: r.labels for r in regions.listed(spark, w).collect()} for w in ("motor", "motor_batch"))
    assert [n for n in motor if motor[n] != batch[n]] == ["pmd_l", "pmd_r", "sma_l", "ips_r"] and len(motor) == 10
    own = regions.listed(spark, "motor").where("ord <= 2").select(F.lit("r").alias("run"), "ord", "name", F.lit(3).alias("n"), F.slice("labels", 1, 2).alias("labels"))
    assert regions.summaries(own, ["run"]).first().text == "mot_lpcg[3]:E111;E112 | mot_rpcg[3]:E229;E230"
